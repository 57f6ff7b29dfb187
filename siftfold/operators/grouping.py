"""Groups of equal content: by size, sample, checksum; staged pruning; singletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftfold.functions import exprs, kernels
from siftfold.model import ConfigurationError
from siftfold.storage import written

HASHES = {
    "sha256": lambda c: F.sha2(c, 256),
    "sha512": lambda c: F.sha2(c, 512),
    "sha1": F.sha1,
    "md5": F.md5,
    "crc32": lambda c: F.hex(F.crc32(c)),
    "xxhash64": lambda c: F.hex(F.xxhash64(c)),
}


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    if algorithm not in HASHES:
        raise ConfigurationError(f"hash_algorithm must be one of {', '.join(HASHES)}")
    return HASHES[algorithm](content)


def groups_by(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: n and total_size."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size")).where("n > 1")


def members_of_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs more than once. Sizes and checksums, not rows, are aggregated and joined back."""
    return df.join(groups_by(df, *keys).select(*keys), list(keys), "left_semi")


def unique_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs once."""
    return df.join(groups_by(df, *keys).select(*keys), list(keys), "left_anti")


def with_checksum(df: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """A checksum that is there already is used again."""
    computed = content_hash(F.col("content"), algorithm)
    return df.withColumn("checksum", F.coalesce("checksum", computed) if "checksum" in df.columns else computed)


def duplicates_direct(df: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Members of groups of equal content: group by size and full hash."""
    return members_of_groups(with_checksum(df, algorithm).drop("content"), "size", "checksum")


def duplicates_staged(df: DataFrame, sample_size: int = 8192, algorithm: str = "sha256", key: str | None = None) -> DataFrame:
    """As duplicates_direct(), by cheap keys first: size, sampled checksum (from 64 bytes on), simhash (from 256), full hash.

    Rows that a cheap key shows to be unique are not read further. Each step reads the input once and writes narrow rows
    (``key``, by which rows are told apart: id, or path where there is none); contents are read again for survivors alone.
    """
    key = key or ("id" if "id" in df.columns else "path")
    sizes = written(df.select(key, "size"), "sizes")
    left = df.join(members_of_groups(sizes, "size").select(key), key, "left_semi")
    quick = F.when(F.col("size") >= 64, kernels.quick_check_udf(sample_size)(F.col("content"))["sample_checksum"])
    simhash = F.when(F.col("size") >= 256, kernels.shingle_simhash_udf(exprs.first_bytes(F.col("content"), kernels.PREFIX)))
    sampled = left.select(key, "size", F.coalesce(quick, F.lit("0")).alias("quick"), F.coalesce(simhash, F.lit(0).cast("long")).alias("simhash"))
    kept = written(members_of_groups(written(sampled, "samples"), "size", "quick", "simhash").select(key), "survivors")
    return duplicates_direct(df.join(kept, key, "left_semi"), algorithm)


def with_primary(members: DataFrame, *keys: str) -> DataFrame:
    """rank: newest first, then by path; the first is the primary."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("modified").desc(), "path"))
    return members.withColumn("rank", rank.cast("long")).withColumn("is_primary", F.col("rank") == 1)


def content_sample(header_size: int = 4096, footer_size: int = 1024, max_size: int = 10 << 30) -> Column:
    """Header, footer (of contents over footer_size), type and structure; larger files than max_size count as empty. Contents
    that can't be read (null) have the one byte FF as header, and nothing else that is known of them."""
    content = F.when(F.col("size") > max_size, F.unhex(F.lit(""))).otherwise(F.col("content"))
    header = exprs.first_bytes(content, header_size)
    footer = F.when((F.col("size") > footer_size) & (F.col("size") <= max_size), exprs.last_bytes(content, footer_size))
    # each field has its own case: one around the whole struct would be evaluated for every field of a group key
    seen = exprs.structure_flags(F.coalesce(header, F.unhex(F.lit(""))))
    return F.struct(F.coalesce(header, F.unhex(F.lit("FF"))).alias("header"), footer.alias("footer"), exprs.mime_type(header).alias("mime_type"), seen.alias("structure_hints"))


def by_extension(df: DataFrame, extensions: list[str]) -> DataFrame:
    """None listed: all rows; else rows without extension go too."""
    return df.where(F.coalesce(F.col("extension").isin([e.lower().lstrip(".") for e in extensions]), F.lit(False))) if extensions else df


def by_type(df: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """By file type or its first part (text, text/plain); none included: all. Rows of unknown type are never included by name."""
    kind = F.coalesce(F.col("file_type"), F.lit(""))
    among = lambda names: kind.isin(list(names)) | F.element_at(F.split(kind, "/"), 1).isin(list(names))
    df = df.where(among(include)) if include else df
    return df.where(~among(exclude)) if exclude else df


def outside(df: DataFrame, directories: list[str]) -> DataFrame:
    """Without rows that have one of these names among their directories."""
    parents = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return df.where(~F.arrays_overlap(parents, F.array(*map(F.lit, directories)))) if directories else df


def visible(df: DataFrame) -> DataFrame:
    return df.where(~F.col("hidden"))


def not_deeper(df: DataFrame, max_depth: int | None) -> DataFrame:
    return df if max_depth is None else df.where(F.col("depth") <= max_depth)


def at_least(df: DataFrame, min_size: int) -> DataFrame:
    return df.where(F.col("size") >= min_size)


def same_metadata(df: DataFrame) -> DataFrame:
    """Groups by size and time of modification, without reading content."""
    return groups_by(df, "size", "modified")
