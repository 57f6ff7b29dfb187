import glob
import json
import os
from collections import Counter
from datetime import UTC, datetime
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftfold import catalog, metrics, storage
from siftfold.config import Config
from siftfold.functions import exprs
from siftfold.model import ConfigurationError
from siftfold.operators import grouping, similarity
from siftfold.plans import pipeline, report
from siftfold.sources import filetree
from siftfold.streaming.pipeline import StreamingPipeline, enrich_quick_check, enrich_statistics, groups_of_stream

SF = "/root/testdata/sf0.001"


def corpus(spark, rows):
    return spark.createDataFrame([(i, f"/r/{i}.txt", datetime.fromtimestamp(i, UTC), None if b is None else bytearray(b)) for i, b in rows], "id long, path string, modified timestamp, content binary").withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))


def _plain(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda t: Counter(tuple(map(_plain, r)) for r in t[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_filters_filter(spark):
    n = catalog._docs(spark, SF).count()
    for name in ("q_extension_filter", "q_depth_filter", "q_hidden_filter", "q_directory_filter", "q_type_filter", "q_min_size_filter"):
        assert 0 < catalog.QUERIES[name](spark, SF).count() < n, name


def test_statistical_stage_in_both_pipelines(spark):
    one, two = b"The quick brown fox. " * 60, bytes(range(256)) * 5
    for rows, want in (([(1, one), (2, one), (3, two)], {1, 2}), ([(1, two), (2, one), (3, one)], {2, 3}), ([(1, one), (2, two)], None)):
        df = corpus(spark, rows)
        stage = pipeline.StatisticalStage()
        out = stage.apply(df).collect()
        assert {r.disposition for r in out} == {"duplicates" if want else "skip"}
        found = pipeline.run_sequential(df, [stage, pipeline.HashStage()]).collect()
        if want:
            assert {r.id for r in out} == {r.id for r in found} == want and len({r.group_key for r in found}) == 1
        else:
            assert {r.group_key for r in found} == {"single:1", "single:2"}
        assert {r.id for r in pipeline.run_parallel(df, [pipeline.StatisticalStage()]).collect()} == (want or set())


def test_continue_goes_to_the_next_stage(spark):
    df = corpus(spark, [(1, b"same head"), (2, b"same head"), (3, b"other one")])
    got = pipeline.run_sequential(df, [pipeline.QuickCheckStage(), pipeline.HashStage()]).collect()
    assert {r.id for r in got} == {1, 2}
    assert {r.group_key for r in pipeline.run_sequential(df, [pipeline.QuickCheckStage()]).collect()} == {"size:9"}


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_pairs_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(9)
    rows = [(i, bytes(rng.choice(list(b"abcdefgh "), 400 + int(rng.integers(5))).tolist()) if i % 4 else b"x" * i) for i in range(23)]
    prints = similarity.fingerprints(corpus(spark, rows))
    held = prints.collect()
    want = {}
    for a, b in combinations(held, 2):
        ham = 64 - bin((a.simhash ^ b.simhash) & (2**64 - 1)).count("1")
        x, y = np.array(a.frequency_distribution), np.array(b.frequency_distribution)
        norm = np.linalg.norm(x) * np.linalg.norm(y)
        want[min(a.id, b.id), max(a.id, b.id)] = 40 * ham / 64 + (40 * float(x @ y) / norm if norm else 0) + 20 * (8 - abs(a.entropy - b.entropy)) / 8
    got = {(r.id_a, r.id_b): r.similarity for r in similarity.similar_pairs(prints, 70, block).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 70})
    assert similarity.similar_pairs(prints.where("false"), 70, block).count() == 0


def test_group_similarity_equals_all_pairs(spark):
    rng = np.random.default_rng(10)
    some = lambda v: None if rng.random() < 0.3 else v
    rows = [(i, int(rng.integers(3)), 100 + int(rng.integers(2)), some(str(rng.integers(2))), some(int(rng.integers(-(2**62), 2**62))), some(str(rng.integers(2)))) for i in range(60)] + [(99, 9, 1, None, None, None)]
    df = spark.createDataFrame(rows, "id long, g int, size long, quick string, simhash long, checksum string")
    want = {}
    for g in {r[1] for r in rows}:
        mine, sims = [r for r in rows if r[1] == g], []
        for a, b in combinations(mine, 2):
            f = [float(a[2] == b[2])]
            f += [float(a[k] == b[k]) for k in (3, 5) if a[k] is not None and b[k] is not None]
            if a[4] is not None and b[4] is not None:
                f.append(1 - bin((a[4] ^ b[4]) & (2**64 - 1)).count("1") / 64)
            sims.append(100 * sum(f) / len(f))
        want[g] = (len(mine), pytest.approx(float(np.mean(sims)) if sims else 0.0))
    assert {r.g: (r.n, r.similarity) for r in similarity.group_similarity(df, "g").collect()} == want
    short = similarity.group_similarity(df.select("id", "g", "size"), "g").collect()
    assert {r.g for r in short} == set(want)


def test_group_ids_over_many_ranges(spark):
    rows = [(i, bytes([65 + i % 37]) * (20 + i % 37)) for i in range(150)]
    members = grouping.duplicates_direct(corpus(spark, rows))
    got = report.report_groups(members).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 38)) and [(r.size, r.checksum) for r in got] == sorted((r.size, r.checksum) for r in got)
    doc = json.loads(report.json_groups(report.report_members(members)).where("group_id = 1").first().json)
    assert set(doc) == {"id", "identifier", "similarity", "total_size", "potential_savings", "files"} and set(doc["files"][0]) == {"path", "size", "modified", "file_type", "is_primary"}
    text = report.render(members, 150, 1.0, {})
    assert "Group 1: 5 files, 100 B, 80 B could be saved" in text
    assert report.render(members, 150, 1.0, {}, "csv").splitlines()[1].startswith("1,100,")


def test_staged_reads_paths_as_keys(spark):
    df = corpus(spark, [(1, b"a" * 700), (2, b"a" * 700), (3, b"b" * 700), (4, b"c")]).drop("id")
    assert {r.path for r in grouping.duplicates_staged(df, 64).collect()} == {"/r/1.txt", "/r/2.txt"}


def test_unreadable_contents_have_a_sample_of_their_own(spark):
    s = corpus(spark, [(1, None), (2, b"")]).select("id", grouping.content_sample().alias("s")).collect()
    s = {r.id: r.s for r in s}
    assert bytes(s[1].header) == b"\xff" and bytes(s[2].header) == b"" and s[1].mime_type is None and not s[1].structure_hints.is_binary


def test_unreadable_entries_pass_no_size_filter(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * 500)
    (tmp_path / "gone").mkdir()
    o = filetree._Options({"path": str(tmp_path), "minsize": "100"})
    rows = list(filetree.files(str(tmp_path / "missing"), 1, o))
    assert len(rows) == 1 and rows[0][1] is None and rows[0][8]
    reader = filetree._Reader(o)
    given = [filetree.GreaterThanOrEqual(("size",), 100)]
    assert list(reader.pushFilters(given)) == given and reader.o.min_size == 100
    assert filetree.scan(spark, str(tmp_path)).where("size >= 100").count() == 1


def test_types_and_directories(spark):
    rows = [("/a/b/x", "text/plain"), ("/a/.git/y", "image/png"), ("/c/z", None), ("/b", "text/html")]
    df = spark.createDataFrame(rows, "path string, file_type string")
    names = lambda d: {r.path for r in d.collect()}
    assert names(grouping.by_type(df, ["text"])) == {"/a/b/x", "/b"} and names(grouping.by_type(df, [], ["image", "text/html"])) == {"/a/b/x", "/c/z"}
    assert names(grouping.outside(df, [".git", "b"])) == {"/c/z", "/b"} and names(grouping.outside(df, [])) == {r[0] for r in rows}


def test_counters_and_streams(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for i in range(5):
        (tmp_path / "f" / f"{i}.txt").write_bytes(b"x" * (i + 1))
    c = metrics.ScanCounters(filetree.scan(spark, str(tmp_path / "f"), withContent=True))
    assert c.df.count() == 5
    assert c.snapshot() == {"files": 5, "bytes": 15, "errors": 0, "directories": 1} and len(c.lines(2.0)) == 5

    docs = corpus(spark, [(i, b"k" * 300) for i in range(6)]).withColumn("quick_check", F.lit("there")).withColumn("statistical_info", F.lit(None).cast("struct<entropy:double,simhash:bigint,fingerprint:binary>"))
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen, total = [], metrics.PipelineMetrics()

    def each(df, batch):
        if batch == 1:
            raise ValueError("no")
        seen.append(df.count())

    with metrics.listening(spark, None) as listener:
        q = StreamingPipeline(enrich_statistics).start(stream, "s", f"{tmp_path}/c", "append", each=metrics.counted(each, total))
        q.awaitTermination()
    s = total.snapshot()
    assert s["errors"] == 1 and s["files_processed"] == sum(seen) < 6 and s["batches"] == len(seen)
    assert metrics.stream_snapshot(q) == {"rows": sum(seen), "batches": 3, "complete": True}  # the batch that failed read nothing
    assert listener.rows is not None and metrics.workers(spark)["slots"] >= 1 and metrics.Priority.LOW < metrics.Priority.CRITICAL
    with metrics.prioritised(spark, metrics.Priority.HIGH):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "high"
    groups = groups_of_stream(spark, stream.select("size", "content"), f"{tmp_path}/c2", f"{tmp_path}/out").collect()
    assert [(r.size, r.n) for r in groups] == [(300, 6)] and len(os.listdir(f"{tmp_path}/out")) == 1


def test_what_is_there_already_stays(spark):
    df = corpus(spark, [(1, b"k" * 300), (2, b"k" * 300)])
    done = enrich_statistics(enrich_quick_check(df))
    kind = {f.name: f.dataType for f in done.schema.fields}
    marked = done.withColumn("quick_check", F.when(F.col("id") == 1, F.struct(F.lit("7").alias("sample_checksum"), F.lit(1).cast("long").alias("sample_size"), F.lit(1).alias("samples_taken"))).cast(kind["quick_check"]))
    got = {r.id: r for r in enrich_statistics(enrich_quick_check(marked)).collect()}
    assert got[1].quick_check.sample_checksum == "7" and got[2].quick_check.sample_size == 300 and got[1].statistical_info.entropy == 0


def test_temporary_tables(spark):
    class Conf:
        def getConf(self):
            return {}

    first = storage.mark(spark)
    t = storage.written(spark.range(3), "x")
    path = t.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.exists(path)
    storage.release(spark, first)
    assert not os.path.exists(path)

    class Cluster:
        sparkContext = type("C", (), {"getConf": lambda self: {}, "master": "spark://x", "applicationId": "a"})()
        conf = type("R", (), {"get": lambda self, k, d: d})()

    with pytest.raises(ConfigurationError):
        storage.shared_dir(Cluster())


def test_config_lists_and_defaults():
    c = Config.load(env={"SIFTFOLD_EXCLUDE_DIRECTORIES": ".git,node_modules", "SIFTFOLD_INCLUDE_TYPES": "text"})
    assert c.exclude_directories == (".git", "node_modules") and c.include_types == ("text",) and Config().parallel_scan is False


def test_shown_sizes_and_times(spark):
    r = spark.sql("select timestamp_micros(-1) as a, timestamp_seconds(90061) as b").select(exprs.timestamp_text(F.col("a")), exprs.timestamp_text(F.col("b"))).first()
    assert tuple(r) == ("unknown", "1970-01-02 01:01:01")
    assert [x[0] for x in spark.createDataFrame([(0,), (1023,), (1024,), (1 << 40,)], "n long").select(exprs.human_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KiB", "1.0 TiB"]
