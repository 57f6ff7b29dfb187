"""Batch stages and the pipelines that compose them.

A stage maps rows to rows with two more columns: ``disposition`` (continue, skip or duplicates) and ``group_key``. Grouping is
global, never by chunk or partition.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftfold.config import BatchOptions
from siftfold.model import PipelineError
from siftfold.operators import grouping, similarity
from siftfold.storage import written


class Stage(Protocol):
    name: str

    def apply(self, df: DataFrame) -> DataFrame: ...


def _with_counts(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    return df.join(counts, key)


class MetadataStage:
    """Groups by size, from min_size on. If a size repeats: duplicates, single rows as groups of one; else skip all."""

    name = "metadata"

    def __init__(self, min_size: int = 0):
        self.min_size = min_size

    def apply(self, df: DataFrame) -> DataFrame:
        rows = _with_counts(df.where(F.col("size") >= self.min_size).withColumn("group_key", F.concat(F.lit("size:"), F.col("size").cast("string"))), "group_key")
        most = rows.agg(F.max("members").alias("most"))
        return rows.join(F.broadcast(most)).withColumn("disposition", F.when(F.col("most") > 1, "duplicates").otherwise("skip")).drop("members", "most")  # most has one row


class QuickCheckStage:
    """Groups by header, footer, type and structure; the size is no part of the key. None repeats: skip; all do: duplicates; else the repeated ones continue."""

    name = "quick_check"

    def __init__(self, options: BatchOptions = BatchOptions()):
        self.options = options

    def apply(self, df: DataFrame) -> DataFrame:
        o = self.options
        sample = grouping.content_sample(o.header_size, o.footer_size, o.max_file_size)
        key = F.sha2(F.to_json(F.struct(F.hex(sample["header"]).alias("h"), F.hex(sample["footer"]).alias("f"), sample["mime_type"].alias("m"), sample["structure_hints"].alias("s"))), 256)
        rows = _with_counts(df.withColumn("group_key", F.concat(F.lit("sample:"), key)), "group_key")
        ends = rows.agg(F.max("members").alias("most"), F.min("members").alias("least"))
        verdict = F.when(F.col("most") == 1, "skip").when(F.col("least") > 1, "duplicates").otherwise("continue")
        rows = rows.join(F.broadcast(ends)).withColumn("disposition", verdict)  # ends has one row
        return rows.where((F.col("disposition") != "continue") | (F.col("members") > 1)).drop("members", "most", "least")


class StatisticalStage:
    """Greedy clusters of similar fingerprints. The verdict is one for the stage: if any cluster has two rows or more, these
    clusters are duplicates, and single rows are left out; else all rows skip."""

    name = "statistical"

    def __init__(self, options: BatchOptions = BatchOptions()):
        self.options = options

    def apply(self, df: DataFrame) -> DataFrame:
        o = self.options
        prints = similarity.fingerprints(df, o.block_size, o.min_blocks, o.max_blocks)
        clusters = similarity.leader_clusters(df.select("id"), similarity.similar_pairs(prints, o.similarity_threshold))
        rows = _with_counts(df.join(clusters, "id").withColumn("group_key", F.concat(F.lit("cluster:"), F.col("leader").cast("string"))), "group_key")
        most = rows.agg(F.max("members").alias("most"))
        rows = rows.join(F.broadcast(most)).withColumn("disposition", F.when(F.col("most") > 1, "duplicates").otherwise("skip"))  # most has one row
        return rows.where("members > 1 or most = 1").drop("members", "most", "leader")


class HashStage:
    """Groups by size and full hash; rows without content are unique. Duplicates only; unique rows are left out."""

    name = "hash"

    def __init__(self, algorithm: str = "sha256"):
        self.algorithm = algorithm

    def apply(self, df: DataFrame) -> DataFrame:
        rows = grouping.with_checksum(df, self.algorithm)
        rows = rows.withColumn("checksum", F.coalesce("checksum", F.concat(F.lit("unique_"), "path")))
        rows = rows.withColumn("group_key", F.concat(F.lit("hash:"), F.col("size").cast("string"), F.lit(":"), "checksum"))
        return _with_counts(rows, "group_key").where("members > 1").withColumn("disposition", F.lit("duplicates")).drop("members")


def run_sequential(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """id, group_key. Continue feeds the next stage; skip parks all rows as groups of one and duplicates are the result: both
    end the run. What is left after the last stage is grouped by size."""
    if not stages:
        raise PipelineError("a pipeline needs a stage")
    for stage in stages:
        # the decisions are written once, and contents joined back where the next stage needs them
        out = written(stage.apply(df).select("id", "group_key", "disposition"), f"stage-{stage.name}")
        first = out.select("disposition").first()
        if first is None:
            return out.select("id", "group_key")
        if first.disposition == "skip":
            return out.select("id", F.concat(F.lit("single:"), F.col("id").cast("string")).alias("group_key"))
        if first.disposition == "duplicates":
            return out.select("id", "group_key")
        df = df.join(out.select("id"), "id", "left_semi")
    return df.select("id", F.concat(F.lit("size:"), F.col("size").cast("string")).alias("group_key"))


def run_parallel(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """id, group_key: each stage drops what it skips, the others go on; at the end rows are grouped by size, two or more a group."""
    if not stages:
        raise PipelineError("a pipeline needs a stage")
    for stage in stages:
        df = stage.apply(df).where("disposition <> 'skip'").drop("disposition", "group_key")
    return grouping.members_of_groups(df, "size").select("id", F.concat(F.lit("size:"), F.col("size").cast("string")).alias("group_key"))


def flatten_groups(groups: DataFrame, members: str = "members") -> DataFrame:
    """A row per member of nested groups: group_key, and the fields of the member."""
    return groups.select("group_key", F.explode(members).alias("m")).select("group_key", "m.*")
