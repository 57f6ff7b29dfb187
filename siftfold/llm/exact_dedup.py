"""Exact dedup: a log-structured merge index of digests, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftfold.llm.common import Bitmap, ascii_lower, join_groups, keep_one, scratch, table, written


#: Batches of the log, each flushed as a run of its own.
FLUSHES = 3


class DigestIndex:
    """A log-structured merge index of digests in the shared folder: (digest, keep_id, n), n the number of rows.

    ``flush`` takes entries by batches: each batch's memtables are aggregated to one entry a digest and written as a run
    sorted by digest. ``compact`` merges runs two by two, level by level, until one is left: of each run only the entries
    that the filter of the other's digests lets through meet in the sort-merge join, which keeps the smallest (or largest)
    identifier and adds the rows up; the others can have no partner and go on as they are. Filters are read, not trusted: an
    entry they let through without need finds no partner and stays. ``rows`` bounds the entries, and sizes the filters.
    """

    def __init__(self, spark: SparkSession, rows: int, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        self.spark, self.rows, self.keep, self.runs = spark, rows, keep, []
        self.path = scratch(spark, "digest-index")
        self.written = 0

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        self.written += 1
        return self.spark.read.schema(schema).parquet(path)

    def flush(self, entries: DataFrame, batches: int = 1) -> None:
        """``entries``: digest binary, id, batch (0 to batches - 1). All runs come from one job."""
        pick = F.min if self.keep == "smallest" else F.max
        memtables = entries.groupBy("digest", "batch").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        path = f"{self.path}/flush-{self.written}"
        memtables.sortWithinPartitions("batch", "digest").write.partitionBy("batch").parquet(path)
        run = self._read(path, T.StructType([*memtables.drop("batch").schema.fields, T.StructField("batch", T.IntegerType())]))
        self.runs += [run.where(F.col("batch") == k).drop("batch") for k in range(batches)]

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        a_filter, b_filter = (Bitmap(x.select("digest"), self.rows) for x in (a, b))
        least = F.least if self.keep == "smallest" else F.greatest  # of a null and an id, both take the id
        a_hits = b_filter.keep(a, "digest")
        b_hits = a_filter.keep(b, "digest").select("digest", F.col("keep_id").alias("other_id"), F.col("n").alias("other_n"))
        met = a_hits.hint("merge").join(b_hits, "digest", "full").select(
            "digest", least("keep_id", "other_id").alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("other_n", F.lit(0))).alias("n")
        )
        merged = met.unionByName(b_filter.leave(a, "digest")).unionByName(a_filter.leave(b, "digest"))
        path = f"{self.path}/merged-{self.written}"
        merged.sortWithinPartitions("digest").write.parquet(path)
        return self._read(path, merged.schema)

    def compact(self) -> DataFrame:
        """One entry a digest: digest, keep_id, n."""
        while len(self.runs) > 1:
            merged = [self._merged(*self.runs[i : i + 2]) for i in range(0, len(self.runs) - 1, 2)]
            self.runs = merged + self.runs[2 * len(merged) :]
        return self.runs[0]


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest: Callable[[Column], Column] = lambda text: F.sha2(text.cast("binary"), 256),
    flushes: int = FLUSHES,
) -> DataFrame:
    """A row per row of ``docs``: id, keep_id (of the copy that stays), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are copies of
    each other. Of equal texts the row with the smallest (or largest) id stays; where several rows have that id, all of
    them do. A null id is never that id, unless all of them are null. Equal digests are no more than candidates: the bytes of all hits are compared, and
    digests that several texts share are resolved by the texts. Texts count whole, however long. Other columns are not read; an empty table gives an
    empty result. ``digest`` gives hexadecimal digits, for tests of collisions.
    """
    spark = docs.sparkSession
    text = ascii_lower(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"))
    # the log: what memtables take, by batches of rows
    logged = rows.select(F.unhex(digest(F.col("text"))).alias("digest"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "id")
    entries = written(logged, "digest-log")
    total = entries.count()
    index = DigestIndex(spark, total, keep)
    index.flush(entries.select("digest", "id", F.pmod(F.xxhash64("id", "sha"), F.lit(flushes)).cast("int").alias("batch")), flushes)
    groups = written(index.compact().where("n > 1"), "digest-groups")
    n_groups = groups.count()

    named = rows.withColumn("digest", F.unhex(digest(F.col("text"))))
    maybe = Bitmap(groups.select("digest"), n_groups).keep(named, "digest")
    pick = F.min if keep == "smallest" else F.max
    by_text = maybe.groupBy("digest", "text").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    seen = by_text.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    shared = written(seen.where("texts > 1").select("digest"), "digest-collisions")

    found = join_groups(entries, groups, "digest", "n", total)
    if not shared.isEmpty():
        apart = rows.withColumn("digest", F.unhex(digest(F.col("text")))).join(shared, "digest", "left_semi")
        which = apart.groupBy("digest", "text").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        apart = apart.join(which, ["digest", "text"]).select("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "id", "keep_id", "n")
        found = found.join(shared, "digest", "left_anti").select(apart.columns).unionByName(apart)
    keep_id = F.coalesce("keep_id", "id")
    return found.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the smallest id; rows with equal ids and texts count as one.

    Null and empty texts are equal; a null id is kept only where all ids of the group are null, and then each such text once;
    long texts count whole; an empty table gives an empty result; columns may have any name.
    """
    found = exact_dedup(docs, id_col, text_col).where("group_size > 1").select(F.col(id_col).alias("id"), "kept", "text_sha256")
    sha = F.sha2(ascii_lower(docs[text_col]).cast("binary"), 256)
    key = lambda id_, sha: F.concat_ws(":", F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("null")), sha)
    return keep_one(docs, found.select(key(F.col("id"), F.col("text_sha256")).alias("_key"), "kept"), key(docs[id_col], sha))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
