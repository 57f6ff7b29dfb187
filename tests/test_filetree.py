"""The file tree source: dealing out subtrees, streams, and reading files in pieces."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from siftfold import cli
from siftfold.functions import kernels
from siftfold.model import ConfigurationError, InvalidPathError
from siftfold.operators import grouping
from siftfold.sources import filetree
from siftfold.streaming.pipeline import StreamingPipeline


def tree(root, wide=5, deep=3):
    made = []

    def grow(at, depth):
        for i in range(wide):
            f = at / f"f{i}.txt"
            f.write_bytes(b"%d-%d" % (depth, i))
            made.append(str(f))
            if depth < deep:
                (at / f"d{i}").mkdir()
                grow(at / f"d{i}", depth + 1)

    grow(root, 0)
    return made


@pytest.mark.parametrize("wanted", [1, 7, 40, 10_000])
def test_units_cover_each_directory_once(tmp_path, wanted):
    made = tree(tmp_path)
    o = filetree._Options({"path": str(tmp_path)})
    found = filetree.units(o, wanted)
    seen = [d for u in found for d in filetree._Units([u]).directories(o)]
    assert sorted(seen) == sorted({(os.path.dirname(p), p[len(str(tmp_path)) :].count("/")) for p in made})
    assert wanted > 200 or len(found) >= wanted


def test_depth_and_missing_roots(tmp_path):
    tree(tmp_path)
    shallow = filetree._Options({"path": str(tmp_path), "maxdepth": "2"})
    for wanted in (1, 1000):
        assert {d for u in filetree.units(shallow, wanted) for _, d in filetree._Units([u]).directories(shallow)} == {1, 2}
    with pytest.raises(InvalidPathError):
        filetree.units(filetree._Options({"path": str(tmp_path / "gone")}), 4)


def test_scan_in_any_number_of_partitions(spark, tmp_path):
    made = tree(tmp_path, 3, 3)
    for n in (1, 3, 16):
        df = filetree.scan(spark, str(tmp_path), partitions=n)
        assert sorted(r.path for r in df.collect()) == sorted(made) and df.rdd.getNumPartitions() == n


def test_stream_has_each_file_once(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    tree(root, 2, 2)
    filetree.register(spark)
    seen = []

    def each(df, batch):
        seen.append(sorted((os.path.relpath(r.path, root), bytes(r.content)) for r in df.select("path", "content").collect()))

    def go():
        time.sleep(0.2)
        stream = spark.readStream.format("filetree").option("withContent", "true").option("partitions", "3").load(str(root))
        StreamingPipeline(lambda d: d).start(stream, "files", f"{tmp_path}/c", "append", each=each).awaitTermination()
        rows = [r for batch in seen for r in batch]
        seen.clear()
        return rows

    assert len(go()) == 2 + 4 + 8
    assert go() == []
    (root / "d0" / "new.txt").write_bytes(b"new")
    (root / "f0.txt").write_bytes(b"changed")
    assert sorted(go()) == [("d0/new.txt", b"new"), ("f0.txt", b"changed")]
    (root / "f1.txt").unlink()
    assert go() == []
    (root / "last.txt").write_bytes(b"")
    assert go() == [("last.txt", b"")]


def test_offset_never_goes_back(tmp_path):
    tree(tmp_path, 2, 1)
    reader = filetree._StreamReader(filetree._Options({"path": str(tmp_path), "settle": "0"}))
    one = reader.latestOffset()["until"]
    time.sleep(0.05)
    (tmp_path / "d1" / "f1.txt").unlink()
    two = reader.latestOffset()["until"]
    assert two > one and reader.partitions({"until": two}, {"until": two}) == []
    held = filetree._StreamReader(filetree._Options({"path": str(tmp_path), "settle": "3600"}))
    assert held.latestOffset()["until"] < one


@pytest.mark.parametrize("algorithm", sorted(grouping.HASHES))
def test_checksums_equal_those_of_contents(spark, tmp_path, monkeypatch, algorithm):
    for i, n in enumerate((0, 1, 3, 4, 31, 32, 33, 1000, (1 << 20) + 17)):
        (tmp_path / f"{i}").write_bytes(bytes((i + j * 7) % 251 for j in range(n)))
    got = {r.path: r.checksum for r in filetree.with_file_checksum(filetree.scan(spark, str(tmp_path)), algorithm).collect()}
    want = {r.path: r.checksum for r in grouping.with_checksum(filetree.scan(spark, str(tmp_path), withContent=True), algorithm).collect()}
    assert got == want and len(got) == 9


def test_samples_equal_those_of_contents(spark, tmp_path):
    sizes = (0, 63, 64, 100, 3000, 3001, 10_001)
    for n in sizes:
        (tmp_path / f"{n}").write_bytes(os.urandom(n))
    got = {int(os.path.basename(r.path)): r.quick for r in filetree.with_file_samples(filetree.scan(spark, str(tmp_path)), 1000).collect()}
    for n in sizes:
        data = (tmp_path / f"{n}").read_bytes()
        assert got[n] == (str(kernels.rolling_checksum(kernels.three_samples(data, 1000)[0])) if n >= 64 else None)


def test_duplicate_files_are_those_of_contents(spark, tmp_path):
    common = os.urandom(5000)
    for name, data in {
        "a": common, "b": common, "c": common[:2400] + b"?" + common[2401:], "d": common[:10] + b"?" + common[11:], "e": b"", "f": b"", "g": b"x", "h": b"y", "i": b"x", "j": b"alone",
    }.items():
        (tmp_path / name).write_bytes(data)
    rows = filetree.duplicate_files(filetree.scan(spark, str(tmp_path)), 100).collect()
    want = grouping.duplicates_direct(filetree.scan(spark, str(tmp_path), withContent=True)).collect()
    assert {(r.path, r.checksum) for r in rows} == {(r.path, r.checksum) for r in want}
    assert {os.path.basename(r.path) for r in rows} == {"a", "b", "e", "f", "g", "i"}


def test_files_that_vanish(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(b"same" * 50)
    found = filetree.scan(spark, str(tmp_path)).cache()
    assert found.count() == 2
    (tmp_path / "b").unlink()
    rows = {os.path.basename(r.path): r for r in filetree.with_file_checksum(found).collect()}
    assert rows["a"].error is None and rows["b"].checksum is None and "b" in rows["b"].error
    assert filetree.duplicate_files(found).count() == 0
    with pytest.raises(ConfigurationError):
        filetree.with_file_checksum(found, "none")


def test_empty_tree(spark, tmp_path):
    assert filetree.duplicate_files(filetree.scan(spark, str(tmp_path))).count() == 0
    assert filetree.with_file_samples(filetree.scan(spark, str(tmp_path)).where(F.lit(False))).count() == 0


def test_command_line_reads_only_what_repeats(spark, tmp_path, capsys):
    root = tmp_path / "r"
    root.mkdir()
    for name in ("a", "b"):
        (root / name).write_bytes(b"twice" * 1000)
    (root / "c").write_bytes(b"once" * 1000)
    assert cli.main([str(root), "--format", "csv"]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert len(lines) == 3 and all(f"{root}/{n}," in "".join(lines) for n in "ab")
