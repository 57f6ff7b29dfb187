"""Directory trees as a DataFrame source, for batch and for streams: ``spark.read.format("filetree").load(root)``.

Options: maxDepth, minSize, includeHidden (false), extensions (comma-separated), withContent (false), sniff (true), partitions
(8), settle (0.05 seconds, of streams). Roots are separated by commas. Hidden and too deep directories are never entered;
symbolic links are neither followed nor listed; entries that can't be read have an ``error`` and no size, or are left out by
onError=skip; onError=fail stops.

The driver lists directories only until there are enough subtrees to deal out; tasks walk these. Contents in rows are for files
that fit one; with_file_samples() and with_file_checksum() read files of any size in pieces, dealt out by path.
"""

from __future__ import annotations

import hashlib
import os
import stat
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from siftfold.functions import kernels
from siftfold.model import FILE, ConfigurationError, InvalidPathError

SCHEMA = T.StructType([*FILE.fields, T.StructField("content", T.BinaryType())])


class _Options:
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        self.roots = [p for p in (get("path") or ".").split(",") if p]
        self.max_depth = int(get("maxdepth")) if get("maxdepth") else None
        self.min_size = int(get("minsize") or 0)
        self.hidden = str(get("includehidden")).lower() == "true"
        self.extensions = {e.strip().lower().lstrip(".") for e in (get("extensions") or "").split(",") if e.strip()}
        self.content = str(get("withcontent")).lower() == "true"
        self.sniff = str(get("sniff", "true")).lower() == "true"
        self.partitions = int(get("partitions") or 8)
        self.on_error = get("onerror") or "report"
        self.settle = float(get("settle") or 0.05)


def _shown(name: str, o: _Options) -> bool:
    return o.hidden or not name.startswith(".")


#: Subtrees a partition to deal out, so that large ones meet small ones; threads that list directories on the driver.
SUBTREES, LISTERS = 16, 16
#: Bytes of a file in memory at once.
PIECE = 1 << 20


def _below(at: tuple[str, int], o: _Options) -> list[tuple[str, int]]:
    """Directories in a directory that are to be entered, with the depth of their entries."""
    path, depth = at
    if o.max_depth is not None and depth >= o.max_depth:
        return []
    try:
        with os.scandir(path) as entries:
            return [(e.path, depth + 1) for e in entries if e.is_dir(follow_symlinks=False) and _shown(e.name, o)]
    except OSError:
        if o.on_error == "fail":
            raise
        return []  # files() tells of it


def directories(at: tuple[str, int], o: _Options) -> Iterator[tuple[str, int]]:
    """(directory, depth of its entries) of a subtree; not below max_depth."""
    stack = [at]
    while stack:
        found = stack.pop()
        yield found
        stack += _below(found, o)


def roots(o: _Options) -> list[tuple[str, int]]:
    for r in o.roots:
        if not os.path.isdir(r):
            raise InvalidPathError(f"no such directory: {r}")
    return [(r, 1) for r in o.roots]


def units(o: _Options, wanted: int) -> list[tuple[str, int, bool]]:
    """(directory, depth of its entries, whether with all below it): the upper levels one by one, then ``wanted`` subtrees or
    more, of which the driver has seen the names alone. A tree of fewer directories is dealt out by directory."""
    single, open_ = [], roots(o)
    with ThreadPoolExecutor(LISTERS) as pool:
        while open_ and len(open_) < wanted:
            single += [(p, d, False) for p, d in open_]
            open_ = [x for found in pool.map(lambda at: _below(at, o), open_) for x in found]
    return single + [(p, d, True) for p, d in open_]


def files(path: str, depth: int, o: _Options, wanted: Callable[[os.stat_result], bool] = lambda s: True) -> Iterator[tuple]:
    """Rows of a directory's files; files that are not ``wanted`` are not opened."""
    from siftfold.sources.sniff import sniffed

    try:
        with os.scandir(path) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as e:
        if o.on_error == "fail":
            raise
        if o.on_error == "report":
            yield (path, None, None, None, None, None, None, depth, str(e), None)
        return
    for e in entries:
        if not _shown(e.name, o) or not e.is_file(follow_symlinks=False):
            continue
        end = os.path.splitext(e.name)[1].lower().lstrip(".")
        if o.extensions and end not in o.extensions:
            continue
        try:
            s = e.stat(follow_symlinks=False)
            if s.st_size < o.min_size or not wanted(s):
                continue
            content = None
            if o.content:
                with open(e.path, "rb") as f:
                    content = f.read()
            kind = None
            if o.sniff:
                if content is None:
                    with open(e.path, "rb") as f:
                        head = f.read(512)
                else:
                    head = content[:512]
                kind = sniffed(head)
            at = lambda t: datetime.fromtimestamp(t, UTC)
            born = getattr(s, "st_birthtime", None)
            yield (e.path, s.st_size, kind, at(s.st_mtime), at(born) if born else None, not s.st_mode & stat.S_IWUSR, e.name.startswith("."), depth, None, content)
        except OSError as x:
            if o.on_error == "fail":
                raise
            if o.on_error == "report":
                yield (e.path, None, None, None, None, None, e.name.startswith("."), depth, str(x), None)


class _Units(InputPartition):
    def __init__(self, held: list[tuple[str, int, bool]], since: int | None = None, until: int | None = None):
        self.held = held
        self.since, self.until = since, until

    def directories(self, o: _Options) -> Iterator[tuple[str, int]]:
        for path, depth, whole in self.held:
            yield from directories((path, depth), o) if whole else [(path, depth)]


def _dealt(o: _Options, since: int | None = None, until: int | None = None) -> list[InputPartition]:
    found = units(o, SUBTREES * o.partitions)
    n = max(1, min(o.partitions, len(found)))
    return [_Units(found[i::n], since, until) for i in range(n)]


class _Reader(DataSourceReader):
    def __init__(self, o: _Options):
        self.o = o

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Least size and greatest depth are tested while listing, before contents are read."""
        for f in filters:
            yield f  # Spark tests it again: entries that can't be read have no size
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("size",):
                self.o.min_size = max(self.o.min_size, f.value)
            elif isinstance(f, GreaterThan) and f.attribute == ("size",):
                self.o.min_size = max(self.o.min_size, f.value + 1)
            elif isinstance(f, EqualTo) and f.attribute == ("hidden",) and f.value is False:
                self.o.hidden = False

    def partitions(self) -> list[InputPartition]:
        return _dealt(self.o)

    def read(self, partition: _Units) -> Iterator[tuple]:
        for path, depth in partition.directories(self.o):
            yield from files(path, depth, self.o)


class _StreamReader(DataSourceStreamReader):
    """Each micro-batch has the files that are new or changed since the one before, by the file system's time of change.

    The driver looks for the latest such time alone, of files and directories (what is deleted changes its directory, so the
    time never goes back); tasks list their subtrees and read files. What changed within the last ``settle`` seconds waits for
    the next batch, as more files may get the same time: where the file system's clock is another machine's, set it above
    their difference. A file that changes between two batches comes again.
    """

    def __init__(self, o: _Options):
        self.o = o

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        def latest(unit: tuple[str, int, bool]) -> int:
            most = -1
            for path, _ in _Units([unit]).directories(self.o):
                try:
                    most = max(most, os.stat(path).st_ctime_ns)
                    with os.scandir(path) as entries:
                        most = max([most, *(e.stat(follow_symlinks=False).st_ctime_ns for e in entries if _shown(e.name, self.o))])
                except OSError:
                    if self.o.on_error == "fail":
                        raise
            return most

        with ThreadPoolExecutor(LISTERS) as pool:
            found = max(pool.map(latest, units(self.o, SUBTREES * LISTERS)), default=-1)
        return {"until": min(found, time.time_ns() - int(self.o.settle * 1e9))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(self.o, start["until"], end["until"]) if start["until"] < end["until"] else []

    def read(self, partition: _Units) -> Iterator[tuple]:
        wanted = lambda s: partition.since < s.st_ctime_ns <= partition.until
        for path, depth in partition.directories(self.o):
            yield from (row for row in files(path, depth, self.o, wanted) if row[8] is None)


class FileTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTreeSource)


def scan(spark: SparkSession, *roots: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("filetree").options(**{k: str(v) for k, v in options.items() if v is not None}).load(",".join(roots))


def _hasher(algorithm: str) -> Callable:
    """For grouping.HASHES, fed piece by piece."""
    if algorithm in ("sha256", "sha512", "sha1", "md5"):

        def digest(pieces: Iterator[bytes]) -> str:
            h = hashlib.new(algorithm)
            for piece in pieces:
                h.update(piece)
            return h.hexdigest()
    elif algorithm == "crc32":

        def digest(pieces: Iterator[bytes]) -> str:
            value = 0
            for piece in pieces:
                value = zlib.crc32(piece, value)
            return f"{value:X}"
    elif algorithm == "xxhash64":
        import xxhash

        def digest(pieces: Iterator[bytes]) -> str:
            h = xxhash.xxh64(seed=42)  # fixed value: that of Spark's function
            for piece in pieces:
                h.update(piece)
            return f"{h.intdigest():X}"
    else:
        raise ConfigurationError(f"no hash of files named {algorithm}")
    return digest


def _pieces(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            yield piece


def _sampled(path: str, size: int, sample: int) -> str:
    """The checksum of kernels.three_samples(), of which only these bytes are read."""
    with open(path, "rb") as f:
        s = min(sample, size)
        if size <= 3 * s:
            return str(kernels.rolling_checksum(f.read(s)))
        parts = []
        for at in (0, size // 2 - s // 2, size - s):
            f.seek(at)
            parts.append(f.read(s))
        return str(kernels.rolling_checksum(b"".join(parts)))


def _with_read(df: DataFrame, name: str, read: Callable[[str, int], str | None]) -> DataFrame:
    """One more column, read from the file of each row. Rows are dealt out by path, as one directory may hold most files. A
    file that can't be read any more has an error and no value."""
    schema = T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, T.StringType())])
    if "error" not in df.columns:
        raise ValueError("rows of a scan have an error column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], batch.column("error").to_pylist()
            for i, (path, size) in enumerate(zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                value = None
                if errors[i] is None:
                    try:
                        value = read(path, size)
                    except OSError as e:
                        errors[i] = str(e)
                values.append(value)
            new = {"error": pa.array(errors, pa.string()), name: pa.array(values, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(f.name) if f.name in batch.schema.names else None) for f in schema], names=schema.names)

    return df.repartition("path").mapInArrow(run, schema)


def with_file_checksum(df: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """checksum: as grouping.with_checksum() has it, of files of any size, a piece in memory at once."""
    digest = _hasher(algorithm)
    return _with_read(df, "checksum", lambda path, size: digest(_pieces(path)))


def with_file_samples(df: DataFrame, sample_size: int = 8192) -> DataFrame:
    """quick: checksum of the first, middle and last bytes of files of 64 bytes on; only these are read."""
    return _with_read(df, "quick", lambda path, size: _sampled(path, size, sample_size) if size >= 64 else None)


def duplicate_files(found: DataFrame, sample_size: int = 8192, algorithm: str = "sha256") -> DataFrame:
    """Rows of a scan whose content occurs more than once, with checksum: by size, then samples, then the whole content.

    Files are opened only while a cheaper key repeats, and read whole only where samples agree. Each step is written, so
    no file is read twice; files that can't be read any more are left out.
    """
    from siftfold.operators import grouping
    from siftfold.storage import written

    rows = written(found.where("error is null").drop("content"), "files")
    sampled = written(with_file_samples(grouping.members_of_groups(rows, "size"), sample_size).where("error is null").fillna({"quick": ""}), "file-samples")
    left = grouping.members_of_groups(sampled, "size", "quick").drop("quick")
    checked = written(with_file_checksum(left, algorithm).where("error is null"), "file-checksums")
    return grouping.members_of_groups(checked, "size", "checksum")
