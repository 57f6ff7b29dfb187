"""What the operators of this package share: tables, the shared folder, written tables, worker batches."""

from __future__ import annotations

import ctypes
import gc
import math
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftfold.storage import scratch, written  # noqa: F401

#: One token of the query contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one: beside it no name can clash with theirs. ``select("row.*")`` gives them back."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # translate() works by character; where every character is one byte, lower() does the same much faster
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(column: Column, n: int) -> Column:
    """crc32(value as text) mod n, by which the contracts hold rows out."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def labelled(docs: DataFrame, labels: DataFrame, what: str, held_out: int, of: int, sample: int, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """id, y, text, lang of at most ``sample`` labelled documents, written: the first by order of a hash of the id, one row an id.

    Ids whose crc32 as text mod ``of`` is ``held_out`` are left out, so are null ids and null labels. Of several labels of an
    id the largest counts, of several documents with an id the least text.
    """
    known = labels.select(labels[id_col].alias("id"), labels[what].cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(bucket_of(F.col("id"), of) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), (docs[lang_col] if lang_col in docs.columns else F.lit(None).cast("string")).alias("lang"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # sample rows: a bounded broadcast
    found = rows.join(F.broadcast(known), "id").groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct("text", "lang")).alias("d"))
    return written(found.select("id", "y", "d.text", "d.lang"), "labelled")


def text_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def by_bytes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of about ``most`` bytes; a larger row is alone."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def give_back() -> None:
    """Returns freed memory to the system: workers and the driver live on, and share their machine with the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, most: int = 1000) -> DataFrame:
    """``df`` through ``run``, by mapInArrow. The session's Arrow batches get ``most`` rows at most, as texts may be long; else
    each task holds batches of 10,000 texts outside the heap. Where the setting is lower already it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= most:
        df.sparkSession.conf.set(name, str(most))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidied, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """Columns named c0, c1 ...: mapInArrow takes no names with dots."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def slices(batch: pa.RecordBatch, most: int = 2 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    for a, b in by_bytes(sizes, most):
        yield batch.slice(a, b - a)


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is one of the installed public tokenizer files."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Groups with over this share of all rows are looked up by a broadcast; there can't be more than its inverse.
HOT_SHARE = 1 / 2000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` on ``key``, where ``groups`` has one row a key and ``n`` tells how many rows it has.

    Rows of hot groups don't meet in one task: their groups, 2000 at most, are broadcast.
    """
    most = max(64, int(total * HOT_SHARE))
    hot, warm = groups.where(F.col(n) > most), groups.where(F.col(n) <= most)
    columns = [*rows.columns, *(c for c in groups.columns if c != key)]
    a = rows.join(F.broadcast(hot), key).select(columns)
    b = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(warm, key, "left").select(columns)
    return a.unionByName(b)


class Bitmap:
    """A filter of keys, small enough to be broadcast: 16 bits a key, but 2**27 (16 MB) at most. It keeps all rows whose
    key is among ``keys``, and some others: about one in 16, and more as the bound is reached."""

    LEAST, MOST, PAGE = 1 << 15, 1 << 27, 1 << 15

    def __init__(self, keys: DataFrame, n: int):
        self.bits = min(max(1 << math.ceil(math.log2(16 * max(n, 1))), self.LEAST), self.MOST)
        at = self._at(F.col(keys.columns[0]))
        pages = keys.select((at / self.PAGE).cast("int").alias("_page"), (at % self.PAGE).alias("_bit"))
        self.pages = pages.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))

    def _at(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def keep(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key is in the filter; of the others none has a key among those it was made of."""
        return self._marked(rows, key).where(F.coalesce("_set", F.lit(False))).select(rows.columns)

    def leave(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows that keep() leaves out."""
        return self._marked(rows, key).where(~F.coalesce("_set", F.lit(False))).select(rows.columns)

    def _marked(self, rows: DataFrame, key: str) -> DataFrame:
        bit = self._at(F.col(key)) % self.PAGE
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        paged = rows.withColumn("_page", (self._at(F.col(key)) / self.PAGE).cast("int"))
        return paged.join(F.broadcast(self.pages), "_page", "left").withColumn("_set", is_set)


def row_key(id_: Column, text: Column) -> Column:
    """Tells rows apart by id and text; null ids and texts have keys too."""
    return F.concat_ws(":", F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("null")), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))


def keep_one(docs: DataFrame, members: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows that ``members`` (_key, kept) does not keep, and one row of each kept key.

    Only rows that a filter of the members' keys lets through are shuffled; the others stay where they are.
    """
    members = written(members.groupBy("_key").agg(F.max("kept").alias("kept")), "members")
    keyed = docs.select(whole_row(docs).alias("row"), key.alias("_key"))
    filter_ = Bitmap(members.select("_key"), members.count())
    maybe = filter_.keep(keyed, "_key").join(members.where(~F.col("kept")).select("_key"), "_key", "left_anti").dropDuplicates(["_key"])
    return filter_.leave(keyed, "_key").select("row").unionByName(maybe.select("row")).select("row.*")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: for each node that has an edge, (node, root), root the least node of its component.

    ``edges``: a, b of any ordered type, repeated and in any direction. Alternates the large-star and small-star steps
    (Kiveris et al. 2014), which keep the number of edges and halve the depth, until nothing changes. Nodes of high degree
    are no group of rows in one task: minima are aggregated, and given back by joins that AQE splits.
    """
    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        joined = both.join(least, "a")
        if large:  # neighbours greater than the node move to its least neighbour
            moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # a > b here: the node and its lesser neighbours move to the least of them
            moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where(F.col("a") > F.col("b")).distinct()

    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    mark = None
    for _ in range(rounds):
        now = written(stars(stars(now, True), False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
