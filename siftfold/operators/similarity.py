"""Similar content: pairs, mean similarity of groups, greedy clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftfold.functions import exprs, kernels
from siftfold.model import RunError
from siftfold.storage import scratch, written

#: Rows of a block; two blocks are compared at once.
BLOCK = 1024


def fingerprints(df: DataFrame, block: int = 4096, least: int = 10, most: int = 1000) -> DataFrame:
    """id, entropy, frequency_distribution, simhash, file_size, blocks_analyzed."""
    return df.select("id", kernels.fingerprint_udf(block, least, most)(F.col("content")).alias("f")).select("id", "f.*")


def similar_pairs(prints: DataFrame, threshold: float = 85.0, block: int = BLOCK) -> DataFrame:
    """Pairs id_a < id_b with a combined similarity of ``threshold`` or more: 40 % Hamming, 40 % cosine, 20 % entropy.

    All pairs are looked at, as no key loses none: rows are dealt to blocks by a hash of the id, and each pair of blocks is a
    group of its own, two blocks at most in memory. Within it the Hamming test, which must leave 85 possible, comes first,
    then one matrix product gives all cosines. Fingerprints are written once; ``block`` rows a block.
    """
    rows = written(prints.select("id", "entropy", "simhash", "frequency_distribution"), "fingerprints")
    blocks = max(1, math.ceil(rows.count() / block))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other")
    dealt = dealt.repartition("i", "j").sortWithinPartitions("i", "j")
    id_type = prints.schema["id"]
    schema = T.StructType([T.StructField("id_a", id_type.dataType), T.StructField("id_b", id_type.dataType), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            starts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(i)]
            for a, b in zip(starts, starts[1:], strict=False):
                if (i[a], j[a]) != at:
                    if held:
                        yield _pairs_of(held, at, threshold, schema)
                    at, held = (i[a], j[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield _pairs_of(held, at, threshold, schema)

    return dealt.mapInArrow(run, schema)


def _pairs_of(parts: list[pa.RecordBatch], at: tuple[int, int], threshold: float, schema: T.StructType) -> pa.RecordBatch:
    """Of one pair of blocks."""
    t = pa.Table.from_batches(parts)
    ids, mine = t.column("id").to_pylist(), t.column("mine").to_numpy()
    entropy, hashes = t.column("entropy").to_numpy(), t.column("simhash").to_numpy().view(np.uint64)
    freq = np.array(t.column("frequency_distribution").to_pylist(), np.float64).reshape(len(ids), -1)
    norm = np.linalg.norm(freq, axis=1)
    freq = freq / np.where(norm > 0, norm, 1)[:, None]
    left, right = (np.flatnonzero(mine == k) for k in at)
    hamming = 64.0 - np.bitwise_count(hashes[left][:, None] ^ hashes[right][None, :])
    near = 40 * hamming / 64 + 60 >= threshold - 1e-9
    similarity = 40 * hamming / 64 + 40 * (freq[left] @ freq[right].T) + 20 * (8 - np.abs(entropy[left][:, None] - entropy[right][None, :])) / 8
    x, y = np.nonzero(near & (similarity >= threshold - 1e-9))
    found = [(*sorted((ids[left[a]], ids[right[b]])), float(similarity[a, b])) for a, b in zip(x.tolist(), y.tolist(), strict=True) if at[0] != at[1] or ids[left[a]] < ids[right[b]]]
    cols = list(zip(*found, strict=True)) or [(), (), ()]
    kind = t.schema.field("id").type
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], kind), pa.array(cols[2], pa.float64())], names=schema.names)


def leader_clusters(ids: DataFrame, pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Greedy clusters by ascending id: id, leader. A row without a similar earlier leader leads; others join the earliest.

    Rounds settle rows whose earlier neighbours are settled: one with an earlier leader among them is a member, one
    whose earlier neighbours all are members leads. The state is cut from its lineage each round. Each round settles the
    least open id at least, so rounds go on until none is open; with ``rounds``, rows open after so many are an error.
    """
    spark = ids.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    edges = pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("earlier")).checkpoint()
    state = ids.select("id").join(edges.select("id").distinct(), "id", "left_anti").select("id", F.lit("leader").alias("role")).checkpoint()
    open_ = edges.select("id").distinct().checkpoint()
    done, parts = 0, max(state.rdd.getNumPartitions(), open_.rdd.getNumPartitions())
    while not open_.isEmpty():
        if done == rounds:
            raise RunError(f"rows without a cluster after {rounds} rounds")
        seen = open_.join(edges, "id").join(state.withColumnRenamed("id", "earlier"), "earlier", "left")
        led = F.max(F.coalesce(F.col("role") == "leader", F.lit(False)))
        settled = seen.groupBy("id").agg(led.alias("led"), F.min(F.coalesce(F.col("role") == "member", F.lit(False))).alias("free")).where("led or free")
        settled = settled.select("id", F.when(F.col("led"), "member").otherwise("leader").alias("role")).checkpoint()
        if settled.isEmpty():
            raise ValueError("pairs with ids that are not among the rows")
        # the union would have the more partitions the more rounds there are
        state = state.unionByName(settled).coalesce(parts).checkpoint()
        open_ = open_.join(settled, "id", "left_anti").checkpoint()
        done += 1
    leaders = state.where("role = 'leader'").select(F.col("id").alias("earlier"))
    first = edges.join(leaders, "earlier", "left_semi").groupBy("id").agg(F.min("earlier").alias("leader"))
    members = state.where("role = 'member'").join(first, "id").select("id", "leader")
    return state.where("role = 'leader'").select("id", F.col("id").alias("leader")).unionByName(members)


def pair_similarity(checksum: bool, simhash: bool, full_hash: bool):
    """Mean of the factors that are there: equal sizes, equal checksums, Hamming similarity, equal full hashes."""
    same = lambda c: F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), 1.0).otherwise(0.0)
    parts = [same("size")]
    if checksum:
        parts.append(F.when(F.col("quick_a").isNotNull() & F.col("quick_b").isNotNull(), same("quick")))
    if simhash:
        both = F.col("simhash_a").isNotNull() & F.col("simhash_b").isNotNull()
        parts.append(F.when(both, exprs.hamming_similarity(F.col("simhash_a"), F.col("simhash_b"))))
    if full_hash:
        parts.append(F.when(F.col("checksum_a").isNotNull() & F.col("checksum_b").isNotNull(), same("checksum")))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return total / n


def group_similarity(df: DataFrame, key: str) -> DataFrame:
    """Mean similarity, times 100, of all pairs of a group's members; 0 for one member. See pair_similarity().

    No pair is made: members that have the same factors are a kind, of which a group has eight at most. Pairs with an equal
    value follow from how often a kind has it, and Hamming distances from how often it has each bit.
    """
    factors = [c for c in ("quick", "simhash", "checksum") if c in df.columns]
    kind = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(factors)), F.lit(0))
    rows = df.select(F.col(key).alias("k"), F.col("size").alias("f_size"), kind.alias("kind"), *(F.col(c).alias(f"f_{c}") for c in factors))
    ones = F.array(*(F.sum(F.coalesce(F.call_function("shiftright", "f_simhash", F.lit(b)).bitwiseAND(F.lit(1)), F.lit(0))) for b in range(64))) if "simhash" in factors else F.array(F.lit(0).cast("long"))
    kinds = rows.groupBy("k", "kind").agg(F.count(F.lit(1)).alias("n"), ones.alias("ones"))
    listed = kinds.groupBy("k").agg(F.collect_list(F.struct("kind", "n", "ones")).alias("l"), F.sum("n").alias("members"))  # 8 at most
    pairs = listed.select("k", "members", F.explode("l").alias("a"), "l").select("k", "members", "a", F.explode("l").alias("b")).where("a.kind <= b.kind")
    same = F.col("a.kind") == F.col("b.kind")
    many = F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    pairs = pairs.select("k", "members", F.col("a.kind").alias("kind_a"), F.col("b.kind").alias("kind_b"), many.alias("pairs"), "a", "b", same.alias("same"))
    both = F.col("kind_a").bitwiseAND(F.col("kind_b"))
    total, n = F.lit(0.0), F.lit(1)
    for c in ("size", *(c for c in factors if c != "simhash")):
        counts = rows.where(F.col(f"f_{c}").isNotNull()).groupBy("k", f"f_{c}", "kind").agg(F.count(F.lit(1)).alias("x"))
        values = counts.groupBy("k", f"f_{c}").agg(F.collect_list(F.struct("kind", "x")).alias("l"))  # 8 at most
        values = values.select("k", F.explode("l").alias("a"), "l").select("k", "a", F.explode("l").alias("b")).where("a.kind <= b.kind")
        equal = F.when(F.col("a.kind") == F.col("b.kind"), F.col("a.x") * (F.col("a.x") - 1) / 2).otherwise(F.col("a.x") * F.col("b.x"))
        values = values.groupBy("k", F.col("a.kind").alias("kind_a"), F.col("b.kind").alias("kind_b")).agg(F.sum(equal).alias(f"equal_{c}"))
        pairs = pairs.join(values, ["k", "kind_a", "kind_b"], "left")
        has = F.lit(True) if c == "size" else both.bitwiseAND(F.lit(1 << factors.index(c))) != 0
        total = total + F.when(has, F.coalesce(F.col(f"equal_{c}"), F.lit(0.0))).otherwise(F.lit(0.0))
        n = n if c == "size" else n + has.cast("int")
    if "simhash" in factors:
        has = both.bitwiseAND(F.lit(1 << factors.index("simhash"))) != 0
        across = F.aggregate(F.zip_with("a.ones", "b.ones", lambda x, y: x * (F.col("b.n") - y) + y * (F.col("a.n") - x)), F.lit(0).cast("long"), lambda s, x: s + x)
        apart = F.when(F.col("same"), across / 2).otherwise(across)  # within a kind each pair is met twice
        total, n = total + F.when(has, F.col("pairs") - apart / 64).otherwise(F.lit(0.0)), n + has.cast("int")
    means = pairs.groupBy("k").agg(F.max("members").alias("n"), F.sum(total / n).alias("sum"), F.sum("pairs").alias("pairs"))
    return means.select(F.col("k").alias(key), "n", F.coalesce(F.try_divide(F.col("sum") * 100, F.col("pairs")), F.lit(0.0)).alias("similarity"))
