import csv
import hashlib
import json
import math
import os
from datetime import UTC, datetime

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftfold.config import Config
from siftfold.functions import exprs, kernels
from siftfold.model import ConfigurationError, PipelineError, RunError
from siftfold.operators import grouping, similarity
from siftfold.plans import pipeline, report
from siftfold.sources import filetree
from siftfold.streaming.pipeline import StreamingPipeline, enrich_metadata, enrich_quick_check, enrich_statistics


def loop_checksum(data):
    h = c = 0
    for b in data:
        h = (31 * h + b) % 2**64
        c = (c + h) % 2**64
    return c


def loop_running(data):
    s, votes = 0, [0] * 64
    for b in data:
        s = (31 * s + b) % 2**64
        for k in range(64):
            votes[k] += 1 if s >> k & 1 else -1
    out = sum(1 << k for k in range(64) if votes[k] > 0)
    return out - 2**64 if out >= 2**63 else out


@given(st.binary(max_size=300))
def test_kernels_against_loops(data):
    assert kernels.rolling_checksum(data) == loop_checksum(data)
    assert kernels.running_simhash(data) == loop_running(data)
    votes = [0] * 64
    for i in range(len(data) - 3):
        h = 0
        for b in data[i : i + 4]:
            h = h * 31 + b
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
    assert kernels.shingle_simhash(data) == sum(1 << k for k in range(64) if votes[k] > 0)


def test_entropy_and_samples():
    assert kernels.entropy(b"") == 0 and kernels.entropy(b"AAAA") == 0
    assert math.isclose(kernels.entropy(bytes(range(256))), 8)
    assert kernels.three_samples(b"abcdefghij", 2) == (b"ab" + b"ef" + b"ij", 3)
    assert kernels.three_samples(b"abcdef", 2) == (b"ab", 1) and kernels.three_samples(b"", 2) == (b"", 1)
    assert kernels.blocks(b"") == [] and len(kernels.blocks(b"x" * 100)) == 10


def corpus(spark, rows):
    return spark.createDataFrame([(i, f"/r/{i}.txt", datetime.fromtimestamp(i, UTC), bytearray(b)) for i, b in rows], "id long, path string, modified timestamp, content binary").withColumn("size", F.octet_length("content").cast("long"))


def test_types_and_structure(spark):
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"PK\x03\x04", b"plain text", b"\x00\x01\x02\xff", b"abc", b"\x1f\x8b\x08\x00", b"MZ\x90\x00", bytes(range(255))]
    got = [tuple(r) for r in spark.createDataFrame([(bytearray(h),) for h in heads], "h binary").select(exprs.mime_type(F.col("h")), exprs.structure_flags(F.col("h"))["is_text"], exprs.structure_flags(F.col("h"))["is_binary"]).collect()]
    assert [g[0] for g in got] == ["image/jpeg", "image/png", "application/zip", "text/plain", None, None, "application/gzip", "application/x-executable", None]
    assert got[3][1:] == (True, False) and got[8][2]


def test_staged_equals_direct_and_report(spark):
    big = b"x" * 5000
    rows = [(1, b"a" * 1024), (2, b"a" * 1024), (3, b"b" * 2048), (4, b"b" * 2048), (5, b"b" * 2048), (6, b"c" * 1024), (7, b"short"), (8, b"short"), (9, big + b"1"), (10, big + b"2")]
    df = corpus(spark, rows)
    direct = grouping.duplicates_direct(df)
    staged = grouping.duplicates_staged(df, 64)
    assert {r.id for r in direct.collect()} == {r.id for r in staged.collect()} == {1, 2, 3, 4, 5, 7, 8}
    large = direct.where("size >= 1024")
    s = report.report_stats(large, 100).first()
    assert (s.duplicate_groups, s.duplicate_files, s.potential_savings) == (2, 5, 5120)
    members = report.report_members(large)
    assert {r.path for r in members.where("is_primary").collect()} == {"/r/2.txt", "/r/5.txt"}
    text = report.render(large, 100, 2.0, {"directory": "/r"}, "csv")
    assert len(list(csv.reader(text.splitlines()))) == 6
    assert len(json.loads(report.render(large, 100, 2.0, {}, "json"))["duplicate_groups"]) == 2
    assert "No duplicates" in report.render(large.where("false"), 1, 0.0, {})


def test_csv_field(spark):
    got = spark.createDataFrame([("a",), ("a,b",), ('a"b',), ("a\nb",)], "s string").select(exprs.csv_field(F.col("s"))).collect()
    assert [r[0] for r in got] == ["a", '"a,b"', '"a""b"', '"a\nb"']


def test_similarity_and_leaders(spark):
    one, two = b"The quick brown fox. " * 60, b"Entirely other words, 12345! " * 50
    df = corpus(spark, [(1, one), (2, one), (3, two), (4, bytes(range(256)) * 4)])
    prints = similarity.fingerprints(df)
    pairs = {(r.id_a, r.id_b): r.similarity for r in similarity.similar_pairs(prints, 85).collect()}
    assert pairs[1, 2] > 95 and (1, 4) not in pairs
    assert {(r.id, r.leader) for r in similarity.leader_clusters(prints.select("id"), similarity.similar_pairs(prints)).collect()} >= {(1, 1), (2, 1), (4, 4)}
    f = prints.where("id = 1").first()
    assert math.isclose(sum(f.frequency_distribution), 1)


def test_fingerprints_of_long_documents(spark, tmp_path):
    from siftfold import catalog

    texts = [None, "", "short", "a" * 65_536, "a" * 65_537, "é" * 40_000, "x" + "é" * 40_000]  # the last is cut within a character
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.fingerprint for r in catalog.q_fingerprint16(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()[:65_536]).hexdigest()[:32].upper() for i, t in enumerate(texts)}
    assert got[3] == got[4]


def test_leader_clusters_equal_greedy(spark):
    rng = np.random.default_rng(3)
    n = 30
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (50, 2)) if a != b})
    leader = {}
    for i in range(n):
        if i not in leader:
            leader[i] = i
            for j in range(i + 1, n):
                if j not in leader and (i, j) in edges:
                    leader[j] = i
    got = similarity.leader_clusters(spark.range(n), spark.createDataFrame(edges, "id_a long, id_b long"))
    assert {r.id: r.leader for r in got.collect()} == leader


def test_leader_clusters_lose_no_row(spark):
    n = 8
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "id_a long, id_b long")  # a row is settled each round
    assert {r.id: r.leader for r in similarity.leader_clusters(spark.range(n), chain).collect()} == {i: i - i % 2 for i in range(n)}
    with pytest.raises(RunError):
        similarity.leader_clusters(spark.range(n), chain, rounds=3)
    with pytest.raises(ValueError):
        similarity.leader_clusters(spark.range(1, n), chain)


def test_stages(spark):
    df = corpus(spark, [(1, b"same text here"), (2, b"same text here"), (3, b"other text her!"), (4, b"zz")])
    assert {r.disposition for r in pipeline.MetadataStage().apply(df).collect()} == {"duplicates"}
    assert {r.id for r in pipeline.QuickCheckStage().apply(df).collect()} == {1, 2}
    assert {r.id for r in pipeline.HashStage().apply(df).collect()} == {1, 2}
    assert pipeline.run_sequential(df.where("false"), [pipeline.MetadataStage()]).count() == 0
    assert {r.id for r in pipeline.run_parallel(df, [pipeline.QuickCheckStage(), pipeline.HashStage()]).collect()} == {1, 2}
    with pytest.raises(PipelineError):
        pipeline.run_sequential(df, [])


def test_filetree(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 100)
    (tmp_path / "_b.TXT").write_bytes(b"x" * 100)
    (tmp_path / "empty.md").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"h" * 50)
    os.makedirs(tmp_path / "d1" / "d2")
    (tmp_path / "d1" / "c.txt").write_bytes(b"y" * 10)
    (tmp_path / "d1" / "d2" / "e.txt").write_bytes(b"z" * 10)
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    names = lambda **o: {os.path.basename(r.path) for r in filetree.scan(spark, str(tmp_path), **o).collect()}
    assert names() == {"a.txt", "_b.TXT", "empty.md", "c.txt", "e.txt"}
    assert names(maxDepth=2) == {"a.txt", "_b.TXT", "empty.md", "c.txt"}
    assert names(extensions="txt", minSize=50) == {"a.txt", "_b.TXT"}
    assert ".hidden" in names(includeHidden="true")
    df = filetree.scan(spark, str(tmp_path), withContent=True)
    assert {os.path.basename(r.path) for r in df.where("size >= 100").collect()} == {"a.txt", "_b.TXT"}
    assert {os.path.basename(r.path) for r in grouping.duplicates_direct(df).collect()} == {"a.txt", "_b.TXT"}


def test_streaming_enrichment(spark, tmp_path):
    docs = corpus(spark, [(1, b"k" * 300), (2, b"k" * 300), (3, b"t")])
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    StreamingPipeline(enrich_metadata, enrich_quick_check, enrich_statistics).start(stream, "enriched", f"{tmp_path}/c", "append").awaitTermination()
    rows = {r.id: r for r in spark.table("enriched").collect()}
    assert rows[1].quick_check.sample_checksum == str(loop_checksum(b"k" * 300)) and rows[3].quick_check is None
    assert rows[1].statistical_info.entropy == 0 and rows[3].statistical_info is None
    with pytest.raises(PipelineError):
        StreamingPipeline().plan(stream)


@pytest.mark.parametrize("threshold, ok", [(0, True), (95, True), (100, True), (101, False)])
def test_config(threshold, ok):
    if ok:
        assert Config(similarity_threshold=threshold).validate()
    else:
        with pytest.raises(ConfigurationError):
            Config(similarity_threshold=threshold).validate()


def test_config_env():
    c = Config.load(env={"SIFTFOLD_MAX_DEPTH": "5", "SIFTFOLD_MIN_FILE_SIZE": "1024", "SIFTFOLD_MODE": "remove"})
    assert (c.max_depth, c.min_file_size, c.mode) == (5, 1024, "remove")


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
