"""Schemas of the records, and the error classes."""

from pyspark.sql import types as T

QUICK_CHECK = T.StructType([T.StructField("sample_checksum", T.DecimalType(20, 0)), T.StructField("sample_size", T.LongType()), T.StructField("samples_taken", T.IntegerType())])
STATISTICAL = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("simhash", T.LongType()), T.StructField("fingerprint", T.BinaryType())])
FILE = T.StructType(
    [
        T.StructField("path", T.StringType(), False), T.StructField("size", T.LongType()), T.StructField("file_type", T.StringType()),
        T.StructField("modified", T.TimestampType()), T.StructField("created", T.TimestampType()), T.StructField("readonly", T.BooleanType()),
        T.StructField("hidden", T.BooleanType()), T.StructField("depth", T.IntegerType()), T.StructField("error", T.StringType()),
    ]
)


class SiftError(Exception):
    """Base of all errors of this engine."""


class ConfigurationError(SiftError, ValueError):
    pass


class InvalidPathError(SiftError, OSError):
    pass


class PipelineError(SiftError, ValueError):
    """A pipeline that can't be run as it is put together."""


class RunError(SiftError, RuntimeError):
    """A run that ended without its whole result."""
