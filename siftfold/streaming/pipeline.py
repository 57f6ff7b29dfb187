"""The same operators on Structured Streaming: stateless enrichment, stateful grouping until the end of the input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftfold.functions import exprs, kernels
from siftfold.model import PipelineError
from siftfold.operators import grouping
from siftfold.storage import remove


def enrich_metadata(df: DataFrame, min_size: int = 0) -> DataFrame:
    return df.where(F.col("size") >= min_size).withColumn("file_type", exprs.mime_type(exprs.first_bytes(F.col("content"), 512)))


def enrich_quick_check(df: DataFrame, sample_size: int = 8192) -> DataFrame:
    """Rows of under 64 bytes pass without a checksum; one that is there already stays."""
    wanted = F.col("size") >= 64
    if "quick_check" in df.columns:
        found = F.when(wanted & F.col("quick_check").isNull(), kernels.quick_check_udf(sample_size)(F.col("content")))
        return df.withColumn("quick_check", F.coalesce("quick_check", found))
    return df.withColumn("quick_check", F.when(wanted, kernels.quick_check_udf(sample_size)(F.col("content"))))


def enrich_statistics(df: DataFrame) -> DataFrame:
    """Rows of under 256 bytes pass without statistics; those that are there already stay."""
    prefix = exprs.first_bytes(F.col("content"), kernels.PREFIX)
    info = F.struct(kernels.entropy_udf(prefix).alias("entropy"), kernels.shingle_simhash_udf(prefix).alias("simhash"), F.unhex(F.substring(F.sha2(prefix, 256), 1, 32)).alias("fingerprint"))
    wanted = F.col("size") >= 256
    if "statistical_info" in df.columns:
        return df.withColumn("statistical_info", F.coalesce("statistical_info", F.when(wanted & F.col("statistical_info").isNull(), info)))
    return df.withColumn("statistical_info", F.when(wanted, info))


def duplicate_groups(df: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Running state: size, checksum, n, total_size of all groups of two or more. Its state is a counter a group, not the rows."""
    return grouping.groups_by(grouping.with_checksum(df, algorithm), "size", "checksum")


class StreamingPipeline:
    """Stages (DataFrame to DataFrame) over a stream, run to the end of what is there, or on."""

    def __init__(self, *stages: Callable[[DataFrame], DataFrame]):
        self.stages = list(stages)

    def add_stage(self, stage: Callable[[DataFrame], DataFrame]) -> StreamingPipeline:
        self.stages.append(stage)
        return self

    def plan(self, stream: DataFrame) -> DataFrame:
        if not self.stages:
            raise PipelineError("a pipeline needs a stage")
        for stage in self.stages:
            stream = stream.transform(stage)
        return stream

    @property
    def stage_count(self) -> int:
        return len(self.stages)

    def start(self, stream: DataFrame, sink: str, checkpoint: str, mode: str = "complete", each: Callable[[DataFrame, int], None] | None = None, deadline: float | None = None) -> StreamingQuery:
        """To the end of what is there, or with ``deadline`` on and on, a batch each so many seconds. ``each`` is called with
        every batch; the size of batches is the source's (maxFilesPerTrigger). See metrics.counted() for its errors."""
        trigger = {"availableNow": True} if deadline is None else {"processingTime": f"{max(1, round(deadline * 1000))} milliseconds"}
        writer = self.plan(stream).writeStream.outputMode(mode).trigger(**trigger).option("checkpointLocation", checkpoint)
        return (writer.foreachBatch(each) if each else writer.format("memory").queryName(sink)).start()


def groups_of_stream(spark: SparkSession, stream: DataFrame, checkpoint: str, out: str, algorithm: str = "sha256") -> DataFrame:
    """All groups at the end of the input, written to ``out`` by the last batch and read from there."""
    done: list[int] = []

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{batch}")
        done.append(batch)
        if len(done) > 1:  # each batch has all groups
            remove(spark, f"{out}/{done[-2]}")

    StreamingPipeline(lambda d: duplicate_groups(d, algorithm)).start(stream, "groups", checkpoint, each=each).awaitTermination()
    return spark.read.parquet(f"{out}/{done[-1]}") if done else spark.createDataFrame([], "size long, checksum string, n long, total_size long")
