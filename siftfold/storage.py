"""Tables written to cut lineage: in the folder that all executors share, deleted when the session's JVM ends or before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from siftfold.model import ConfigurationError

_folders: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one of this machine, if the master is
    local, as in tests; a cluster's executors could not read that, so there it is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = context.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="siftfold-")
    return _folders[app]


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/siftfold-{app}"
    if app not in _made:
        p, fs = _file_system(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _made[app] = []
    path = f"{root}/{what}-{uuid.uuid4().hex}"
    _made[app].append(path)
    return path


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch(spark, what)
    writer = df.write.option("compression", "zstd")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def mark(spark: SparkSession) -> int:
    """How many paths there are; for release()."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Deletes what scratch() gave out from one mark to another: nothing may still read it."""
    made = _made.get(spark.sparkContext.applicationId, [])
    for i, path in enumerate(made[since:until], since):
        if path:
            remove(spark, path)
            made[i] = ""
