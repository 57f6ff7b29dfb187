"""Scalar functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File type by the first bytes (hexadecimal), in order; the first that fits counts.
MAGIC = [
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("47494638", "image/gif"),
    ("504B0304", "application/zip"),
    ("504B0506", "application/zip"),
    ("52617221", "application/x-rar-compressed"),
    ("1F8B", "application/gzip"),
    ("25504446", "application/pdf"),
    ("D0CF11E0", "application/msword"),
    ("4D5A", "application/x-executable"),
    ("7F454C46", "application/x-executable"),
    ("0000001866747970", "video/mp4"),
    ("0000001C66747970", "video/mp4"),
]
COMPRESSED = ["1F8B", "504B0304", "52617221"]
EXECUTABLE = ["4D5A", "7F454C46", "FEEDFACE", "FEEDFACF"]
#: ASCII graphic or white space, as hexadecimal pairs.
_PRINTABLE = "(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0C|0D)"
PROBE = 512


def first_bytes(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def last_bytes(content: Column, n: int) -> Column:
    return F.substring(content, -n, n)


def _starts(header: Column, hexes: list[str]) -> Column:
    out = F.lit(False)
    for h in hexes:
        out = out | F.startswith(header, F.unhex(F.lit(h)))
    return out


def printable_count(data: Column) -> Column:
    """Bytes that are ASCII graphic or white space."""
    # two hexadecimal digits and a blank a byte, so that no match crosses bytes
    pairs = F.regexp_replace(F.hex(data), "(..)", "$1 ")
    return F.regexp_count(pairs, F.lit(_PRINTABLE + " "))


def mime_type(header: Column) -> Column:
    """By magic number, else text/plain if the first bytes all are printable; null for under four bytes and other data."""
    out = None
    for h, name in MAGIC:
        hit = F.startswith(header, F.unhex(F.lit(h)))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    probe = first_bytes(header, PROBE)
    out = out.when(printable_count(probe) == F.octet_length(probe), F.lit("text/plain"))
    return F.when(F.octet_length(header) >= 4, out)


def structure_flags(header: Column) -> Column:
    probe = first_bytes(header, PROBE)
    n, printable = F.octet_length(probe), printable_count(probe)
    return F.struct(
        (n - printable > F.floor(n / 4)).alias("is_binary"), (printable > F.floor(n * 3 / 4)).alias("is_text"),
        _starts(header, COMPRESSED).alias("is_compressed"), _starts(header, EXECUTABLE).alias("is_executable"),
    )


def hamming_similarity(a: Column, b: Column) -> Column:
    """Of two 64-bit hashes, 0 to 1."""
    return (F.lit(64) - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def entropy_similarity(a: Column, b: Column) -> Column:
    return (F.lit(8.0) - F.abs(a - b)) / F.lit(8.0) * F.lit(100.0)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of two arrays, times 100; 0 if either has norm 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)) * 100)


def combined_similarity(hash_a: Column, hash_b: Column, freq_a: Column, freq_b: Column, entropy_a: Column, entropy_b: Column) -> Column:
    return F.lit(40.0) * hamming_similarity(hash_a, hash_b) + F.lit(0.4) * cosine_similarity(freq_a, freq_b) + F.lit(0.2) * entropy_similarity(entropy_a, entropy_b)


def entropy_of(probabilities: Column) -> Column:
    return F.aggregate(F.filter(probabilities, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_hidden(path: Column) -> Column:
    """A segment begins with a dot."""
    return F.rlike(path, F.lit(r"(^|/)\.[^/]"))


def depth(path: Column) -> Column:
    """Names below the root; children of the root have depth 1."""
    return F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("int")


def extension(path: Column) -> Column:
    """Lower-case, without the dot; null if there is none."""
    found = F.regexp_extract(file_name(path), r"[^/]\.([^./]+)$", 1)
    return F.when(found != "", F.lower(found))


def timestamp_text(ts: Column) -> Column:
    """Seconds, UTC session; before the epoch unknown."""
    return F.when(F.unix_micros(ts) < 0, F.lit("unknown")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(text, F.lit('[,"\\n]')), quoted).otherwise(text)


def human_size(n: Column) -> Column:
    """Binary units, one decimal."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(["KiB", "MiB", "GiB", "TiB", "PiB"], 1):
        out = F.when(n >= F.lit(float(1024**k)), F.format_string(f"%.1f {unit}", n / F.lit(float(1024**k)))).otherwise(out)
    return out
