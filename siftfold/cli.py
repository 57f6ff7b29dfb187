"""Command line: ``python -m siftfold.cli DIR [--depth N] [--min-size N] [--format text|json|json-pretty|csv] [--output FILE]``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from siftfold import metrics
from siftfold.config import PRESETS, Config
from siftfold.operators import grouping
from siftfold.plans import report
from siftfold.sources import filetree


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftfold")
    p.add_argument("dir", nargs="?", default=".")
    p.add_argument("--depth", type=int)
    p.add_argument("--min-size", type=int)
    p.add_argument("--performance", choices=sorted(PRESETS), default="high")
    p.add_argument("--threads", type=int, default=0)
    p.add_argument("--config")
    p.add_argument("--format", choices=["text", "json", "json-pretty", "csv"], default="text")
    p.add_argument("--output")
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(argv)
    config, preset = Config.load(a.config), PRESETS[a.performance]
    threads = a.threads or (config.threads_per_stage if config.parallel_scan else 0)
    spark = SparkSession.builder.master(f"local[{threads or '*'}]").appName("siftfold").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxRecordsPerBatch", preset.arrow_batch).getOrCreate()
    began = time.time()
    depth = a.depth if a.depth is not None else config.max_depth
    least = a.min_size if a.min_size is not None else config.min_file_size
    found = filetree.scan(spark, a.dir, maxDepth=depth, minSize=least, extensions=",".join(config.extensions), partitions=preset.partitions_per_core * spark.sparkContext.defaultParallelism)
    counters = metrics.ScanCounters(found)
    good = grouping.outside(grouping.by_type(counters.df.where("error is null"), config.include_types, config.exclude_types), config.exclude_directories)
    good = good.drop("content").cache()  # the tree is listed once
    n = good.count()
    if not n:
        print("No files found.", file=sys.stderr)
        return 0
    members = filetree.duplicate_files(good, min(config.quick_check_sample_size, preset.sample_size), config.hash_algorithm).cache()
    members.count()
    seconds = time.time() - began
    if a.verbose:
        print("\n".join(counters.lines(seconds)), file=sys.stderr)
    shown = {"directory": a.dir, "max_depth": depth, "min_file_size": least, "similarity_threshold": config.similarity_threshold, "hash_algorithm": config.hash_algorithm}
    text = report.render(members, n, seconds, shown, a.format.split("-")[0], a.format.endswith("pretty"))
    if config.mode != "report" and a.format == "text":  # what a removal would do; nothing is ever deleted
        plan = report.action_plan(report.report_members(members)).orderBy("group_id", "path").collect()
        text += "\n".join(f"{r.action} {r.path}" for r in plan) + "\n" if plan else ""
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
