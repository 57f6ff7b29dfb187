"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftfold.llm.common import WORD, table, whole_row, word_count, written

#: Characters that lower a document's quality weight by their share of its text.
JUNK = "$%&*#!|"
#: The order of a source's documents is cut so fine at each of LEVELS refinements.
FANOUT, LEVELS = 1024, 2


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: less for a larger share of junk characters; 1 for empty texts."""
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    clean = F.char_length(F.translate(text, JUNK, ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(0.1) + F.lit(0.9) * clean / n)


def _uniform(id_: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A target for each source: min(most * size, level * weight), with the one level that gives share * all sizes.

    That is where sharing by weight and resharing the excess of full sources ends. ``sizes``: skey, source,
    source_size; it has a row per source, so these windows see as many rows as there are sources.
    """
    rank = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy("fill", "skey")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    after = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("fill", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min_by("level", F.when(F.col("level") <= F.col("fill"), F.struct("fill", "skey"))).over(W.partitionBy())
    found = F.max(F.col("level") <= F.col("fill")).over(W.partitionBy())
    target = F.when(found, F.least("cap", level * F.col("weight"))).otherwise(F.col("cap"))
    return s.select("skey", "source_size", target.alias("target"))


class Mix:
    """Decides how often each row of ``docs`` is taken.

    Sources, by code point and null last, weigh ``weights``, repeating; they share ``share`` times all words, none over
    ``most`` times its own. Complete epochs (all rows of a source) come first; the rest of the target goes to the
    documents of smallest key -ln(u) / quality weight, u uniform by a hash of the id, as long as each is more than half
    within it, so a source misses its target by half a document at most. Documents without words (null, empty or blank)
    take nothing, and a source or table of such documents alone has target 0. Texts count whole, however long. Equal
    keys are ordered by id, then size; rows equal in these are alike, and any of them may be the last one taken. Repeated
    rows are mixed each. Reruns agree. An empty table gives an empty result. Other columns may have any name.

    No task sees a whole source: where the rest ends is found among sums of ``fanout`` ranges of the key, refined
    ``levels`` times, and only documents of the last range, one in fanout ** levels, are sorted. Texts are read once for
    sizes and keys, which are written as narrow rows.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, fanout: int = FANOUT, levels: int = LEVELS):
        self.docs, self.text = docs, docs[text_col]
        cells = fanout**levels
        key = -F.log(_uniform(docs[id_col], seed)) / quality_weight(docs[text_col])
        # The share of an exponential law below the key: as the key orders, and from 0 to 1.
        cell = F.least(F.floor((F.lit(1.0) - F.exp(-key)) * cells), F.lit(cells - 1)).cast("long")
        skey = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("~"))
        self.placed = [docs[id_col].alias("id"), key.alias("key"), cell.alias("cell"), skey.alias("skey")]
        self.rows = written(docs.select(*self.placed, word_count(docs[text_col]).alias("size"), docs[source_col].alias("source")), "mix-rows")
        # what is summed below: (source, range of the key), not documents
        slim = written(self.rows.groupBy("skey", "cell").agg(F.sum("size").alias("size"), F.min("source").alias("source")), "mix-sizes")
        sizes = slim.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
        plan = _targets(sizes, tuple(weights), share, most)
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        plan = written(plan.withColumn("before", F.lit(0).cast("long")).withColumn("edge", F.lit(0).cast("long")), "mix-targets")
        for k in range(levels):
            width = fanout ** (levels - 1 - k)
            inside = slim if k == 0 else slim.join(plan.select("skey", "edge"), "skey").where(F.floor(F.col("cell") / (width * fanout)) == F.col("edge"))
            sums = inside.groupBy("skey", F.floor(F.col("cell") / width).alias("sub")).agg(F.sum("size").alias("n"))
            upto = F.sum("n").over(W.partitionBy("skey").orderBy("sub"))
            sums = sums.withColumn("upto", upto).join(plan.select("skey", F.col("before").alias("base"), "rest"), "skey")
            first = F.when(F.col("base") + F.col("upto") > F.col("rest"), F.col("sub"))
            found = sums.groupBy("skey").agg(F.min(first).alias("sub"), F.max("sub").alias("last"), F.min_by(F.col("base") + F.col("upto") - F.col("n"), first).alias("base"), F.max(F.col("base") + F.col("upto")).alias("full"))
            # where the rest holds all rows, as in a source without words, the edge is after the last range, and stays there
            edges = found.select("skey", F.coalesce("sub", F.col("last") + 1).alias("finer"), F.coalesce("base", "full").alias("upto"))
            plan = plan.join(edges, "skey", "left").withColumn("edge", F.coalesce("finer", F.col("edge") * fanout)).withColumn("before", F.coalesce("upto", "before"))
            plan = written(plan.drop("finer", "upto"), "mix-edges")
        self.plan = plan

    def decided(self, rows: DataFrame, size: Column, some: Column) -> DataFrame:
        """``rows`` (id, key, cell, skey, and what ``size`` and ``some``, whether there are words, read) with source_size, target, times."""
        columns = rows.columns
        rows = rows.join(self.plan, "skey")
        at_edge = rows.where(F.col("cell") == F.col("edge")).withColumn("_size", size)
        so_far = F.sum("_size").over(W.partitionBy("skey").orderBy("key", "id", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size")
        at_edge = at_edge.withColumn("extra", (F.col("before") + so_far + F.col("_size") / 2 <= F.col("rest")).cast("int")).drop("_size")
        others = rows.where(F.col("cell") != F.col("edge")).withColumn("extra", (F.col("cell") < F.col("edge")).cast("int"))
        times = F.when(some, F.col("epochs") + F.col("extra")).otherwise(F.lit(0)).cast("long")
        return others.unionByName(at_edge).select(*columns, "source_size", "target", times.alias("times"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row per row of ``docs``: id, size (words), source_size, target (of its source), times, taken = times * size; see Mix."""
    mix = Mix(docs, id_col, **options)
    d = mix.decided(mix.rows.drop("source"), F.col("size"), F.col("size") > 0)
    return d.select(F.col("id").alias(id_col), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as Mix takes it, with the columns of ``docs``; see there for nulls, ties and empty tables."""
    mix = Mix(docs, **options)
    rows = docs.select(*mix.placed, mix.text.alias("text"), whole_row(docs).alias("row"))
    d = mix.decided(rows, word_count(F.col("text")), F.coalesce(F.rlike("text", F.lit(WORD)), F.lit(False))).where("times > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(text, '') AS t,
         (('0x' || left(md5('0:' || coalesce(doc_id::VARCHAR, '')), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, size,
             -ln(u) / CASE WHEN length(t) = 0 THEN 1::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * length(translate(t, '$%&*#!|', '')) / length(t) END AS key
      FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM k GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, source_size * 2::DOUBLE AS cap,
             1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, cap / weight AS fill,
             (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= fill ORDER BY fill, r LIMIT 1)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
x AS (SELECT *, CASE WHEN size > 0 THEN epochs + CASE WHEN before + size / 2::DOUBLE <= rest THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS times FROM p)
SELECT doc_id, size, source_size, target, times, times * size AS taken FROM x
"""
