"""Reports: groups, members, statistics, and their text, JSON and CSV forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftfold.functions import exprs
from siftfold.operators.grouping import with_primary
from siftfold.storage import written


def _groups(members: DataFrame) -> DataFrame:
    return members.groupBy("size", "checksum").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def report_groups(members: DataFrame) -> DataFrame:
    """A row per group of two or more: id, identifier, similarity, total_size, potential_savings, n. Ids have no gaps.

    Groups are sorted by ranges, each range numbered in its own task; the sizes of the ranges before give where it starts.
    """
    ranged = _groups(members).repartitionByRange("size", "checksum").sortWithinPartitions("size", "checksum")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "report-groups")
    part = F.call_function("shiftright", F.col("at"), F.lit(33))  # fixed value: the low 33 bits count within a partition
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    g = ranged.withColumn("part", part).join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    id_ = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    return g.select(
        id_.alias("id"), F.concat(F.lit("group_"), id_.cast("string")).alias("identifier"), F.lit(100.0).alias("similarity"),
        (F.col("size") * F.col("n")).alias("total_size"), (F.col("size") * (F.col("n") - 1)).alias("potential_savings"), "n", "size", "checksum",
    )


def report_members(members: DataFrame) -> DataFrame:
    """A row per member: its group, newest first, the first being the primary; savings are 0 for it, else the size."""
    ranked = with_primary(members, "size", "checksum")
    groups = report_groups(members).select("size", "checksum", F.col("id").alias("group_id"), "similarity", "n", "total_size", F.col("potential_savings").alias("group_savings"))
    rows = ranked.join(groups, ["size", "checksum"])
    kind = F.coalesce("file_type", F.lit("unknown")) if "file_type" in members.columns else F.lit("unknown")
    savings = F.when(F.col("is_primary"), F.lit(0)).otherwise(F.col("size")).cast("long")
    return rows.select("group_id", "similarity", "path", "size", "modified", kind.alias("file_type"), "is_primary", "rank", savings.alias("potential_savings"), "n", "total_size", "group_savings")


def report_stats(members: DataFrame, total_files: int | DataFrame, seconds: float = 0.0) -> DataFrame:
    """One row: total_files, total_size (of duplicates), duplicate_groups, duplicate_files, potential_savings, savings_percent, throughput."""
    sums = _groups(members).agg(
        F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_files"),
        F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).cast("long").alias("total_size"),
        F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).cast("long").alias("potential_savings"),
    )
    scanned = F.broadcast(total_files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("scanned_bytes"))) if isinstance(total_files, DataFrame) else None
    rows = sums.join(scanned) if scanned is not None else sums.withColumn("total_files", F.lit(total_files).cast("long"))  # one row each
    percent = F.try_divide(F.col("potential_savings") * 100.0, F.col("total_size"))
    rate = F.lit(0.0) if seconds <= 0 else F.col("total_files") / F.lit(seconds)
    return rows.withColumns({"savings_percent": percent, "scan_duration": F.lit(float(seconds)), "throughput": rate})


CSV_HEADER = "group_id,similarity,file_path,file_size,modified_date,file_type,is_primary,potential_savings"


def _number(x):
    """Without a fraction where it is whole: 100, 87.5."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def csv_lines(report: DataFrame) -> DataFrame:
    """group_id, rank, line. Date and type are always quoted."""
    line = F.concat_ws(
        ",", F.col("group_id").cast("string"), _number(F.col("similarity")), exprs.csv_field(F.col("path")), F.col("size").cast("string"),
        F.concat(F.lit('"'), exprs.timestamp_text(F.col("modified")), F.lit('"')), F.concat(F.lit('"'), F.col("file_type"), F.lit('"')),
        F.col("is_primary").cast("string"), F.col("potential_savings").cast("string"),
    )
    return report.select("group_id", "rank", line.alias("line"))


def json_groups(report: DataFrame) -> DataFrame:
    """A JSON document per group, with its members in order: what the group and each of its files are."""
    stamp = exprs.timestamp_text(F.col("modified"))
    entry = F.struct("rank", "path", "size", stamp.alias("modified"), "file_type", "is_primary")
    fields = ("path", "size", "modified", "file_type", "is_primary")
    files = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*(e[f].alias(f) for f in fields)))
    whole = [F.max(c).alias(c) for c in ("similarity", "total_size", "group_savings")]
    groups = report.groupBy("group_id").agg(files.alias("files"), *whole)
    head = [F.col("group_id").alias("id"), F.concat(F.lit("group_"), F.col("group_id").cast("string")).alias("identifier"), "similarity", "total_size", F.col("group_savings").alias("potential_savings")]
    return groups.select("group_id", F.to_json(F.struct(*head, "files")).alias("json"))


def text_headers(report: DataFrame) -> DataFrame:
    """group_id, line: number of files, their size and what could be saved."""
    g = report.where("is_primary")
    return g.select("group_id", F.concat(F.lit("Group "), F.col("group_id").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" files, "), exprs.human_size(F.col("total_size")), F.lit(", "), exprs.human_size(F.col("group_savings")), F.lit(" could be saved")).alias("line"))


def text_lines(report: DataFrame) -> DataFrame:
    mark = F.when(F.col("is_primary"), F.lit("keep  ")).otherwise(F.lit("remove"))
    line = F.concat(F.lit("  ["), mark, F.lit("] "), F.col("path"), F.lit(" ("), exprs.human_size(F.col("size")), F.lit(", "), exprs.timestamp_text(F.col("modified")), F.lit(")"))
    return report.select("group_id", "rank", line.alias("line"))


def render(members: DataFrame, total_files: int, seconds: float, config: dict, form: str = "text", pretty: bool = False) -> str:
    """The whole report as one string, for a command line; large reports are written from the DataFrames instead."""
    import json

    rows = report_members(members)
    if form == "csv":
        return "\n".join([CSV_HEADER, *(r.line for r in csv_lines(rows).orderBy("group_id", "rank").collect())]) + "\n"
    stats = report_stats(members, total_files, seconds).first().asDict()
    if form == "json":
        groups = [json.loads(r.json) for r in json_groups(rows).orderBy("group_id").collect()]
        return json.dumps({"stats": stats, "duplicate_groups": groups, "scan_config": config}, indent=2 if pretty else None, default=str)
    if form != "text":
        raise ValueError(f"unknown format {form!r}")
    out = ["=" * 60, "Duplicate report", "=" * 60, f"Files scanned: {stats['total_files']}", f"Scan time: {seconds:.2f} s", f"Throughput: {stats['throughput']:.1f} files/s"]
    out += [f"Groups: {stats['duplicate_groups']}", f"Files in groups: {stats['duplicate_files']}", f"Possible savings: {stats['potential_savings']} bytes"]
    if stats["total_size"]:
        out.append(f"Savings: {stats['savings_percent']:.1f} %")
    out += [f"{k}: {v}" for k, v in config.items()]
    heads = {r.group_id: r.line for r in text_headers(rows).collect()}
    lines = text_lines(rows).orderBy("group_id", "rank").collect()
    if not lines:
        return "\n".join([*out, "No duplicates found."]) + "\n"
    last = None
    for r in lines:
        if r.group_id != last:
            out.append(heads[r.group_id])
            last = r.group_id
        out.append(r.line)
    return "\n".join([*out, "keep: newest of its group; remove: a copy of it"]) + "\n"


def action_plan(report: DataFrame) -> DataFrame:
    """What a removal would do, as rows; nothing is ever deleted."""
    return report.select("group_id", "path", F.when(F.col("is_primary"), "keep").otherwise("remove").alias("action"))
