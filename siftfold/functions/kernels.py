"""Byte-level functions as numpy kernels, and as Arrow functions over binary columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASE = np.uint64(31)
_INVERSE = np.uint64(pow(31, -1, 1 << 64))
PREFIX = 65_536


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def entropy(data: bytes) -> float:
    """Shannon entropy in bits a byte; 0 for no bytes."""
    c = byte_counts(data)
    p = c[c > 0] / max(1, len(data))
    return float(-(p * np.log2(p)).sum()) + 0.0


def rolling_checksum(data: bytes) -> int:
    """Sum of all states of h = 31 h + byte, modulo 2**64: byte j from the end counts 1 + 31 + ... + 31**j times."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    times = np.cumsum(_powers(_BASE, len(b)), dtype=np.uint64)[: len(b)]
    return int((b[::-1] * times).sum(dtype=np.uint64))


def shingle_simhash(data: bytes) -> int:
    """Votes of the bits of a polynomial hash of each four neighbouring bytes; a bit is set by more ones than zeros."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(b) < 4:
        return 0
    h = ((b[:-3] * 31 + b[1:-2]) * 31 + b[2:-1]) * 31 + b[3:]
    return sum(1 << k for k in range(23) if 2 * int(((h >> k) & 1).sum()) > len(h))


def running_simhash(data: bytes) -> int:
    """Votes of all 64 bits of the running state s = 31 s + byte (modulo 2**64); the value as a signed number."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if not len(b):
        return 0
    i = _powers(_BASE, len(b))
    s = i * np.cumsum(b * _powers(_INVERSE, len(b)), dtype=np.uint64)
    out = sum(1 << k for k in range(64) if 2 * int(((s >> np.uint64(k)) & np.uint64(1)).sum()) > len(b))
    return out - (1 << 64) if out >= 1 << 63 else out


def three_samples(data: bytes, sample: int) -> tuple[bytes, int]:
    """First, middle and last ``sample`` bytes; the first alone where they would overlap."""
    n, s = len(data), min(sample, len(data))
    if n <= 3 * s:
        return data[:s], 1
    return data[:s] + data[n // 2 - s // 2 : n // 2 - s // 2 + s] + data[n - s :], 3


def blocks(data: bytes, block: int = 4096, least: int = 10, most: int = 1000) -> list[bytes]:
    n = min(most, max(least, len(data) // block))
    found = [data[i * len(data) // n : i * len(data) // n + block] for i in range(n)]
    return [x for x in found if x]


def _each(f, kind: T.DataType):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(bytes(x)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


entropy_udf = _each(entropy, T.DoubleType())
#: As text: the value is unsigned.
rolling_checksum_udf = _each(lambda d: str(rolling_checksum(d)), T.StringType())
shingle_simhash_udf = _each(shingle_simhash, T.LongType())
running_simhash_udf = _each(running_simhash, T.LongType())
byte_counts_udf = _each(lambda d: byte_counts(d).tolist(), T.ArrayType(T.LongType()))


def quick_check_udf(sample: int):
    def run(s: pd.Series) -> pd.DataFrame:
        got = [three_samples(bytes(x or b""), sample) for x in s]
        return pd.DataFrame({"sample_checksum": [str(rolling_checksum(d)) for d, _ in got], "sample_size": [len(d) for d, _ in got], "samples_taken": [k for _, k in got]})

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "sample_checksum string, sample_size long, samples_taken int")


def fingerprint_udf(block: int = 4096, least: int = 10, most: int = 1000):
    """Entropy, byte frequencies and running simhash of sampled blocks."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            parts = blocks(bytes(x or b""), block, least, most)
            data = b"".join(parts)
            rows.append((entropy(data), (byte_counts(data) / max(1, len(data))).tolist(), running_simhash(data), len(x or b""), len(parts)))
        return pd.DataFrame(rows, columns=["entropy", "frequency_distribution", "simhash", "file_size", "blocks_analyzed"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "entropy double, frequency_distribution array<double>, simhash long, file_size long, blocks_analyzed int")


def register(spark: SparkSession) -> None:
    """Makes the functions usable from SQL."""
    for name, f in (("byte_entropy", entropy_udf), ("rolling_checksum", rolling_checksum_udf), ("shingle_simhash", shingle_simhash_udf), ("running_simhash", running_simhash_udf), ("byte_counts", byte_counts_udf)):
        spark.udf.register(name, f)
