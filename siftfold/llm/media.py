"""Media columns: texts stored as WAV, read by the wave module, fingerprinted by pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftfold.llm.common import arrow_map, slices, table, text_of

#: Samples of a hop; a window is two hops, and a payload is a whole number of hops.
HOP = 192
RATE = 8000
#: Pairs join the strongest peak of a frame with those of so many frames that follow.
REACH = 3
_FRAMES = 8192
_WINDOW = np.hanning(2 * HOP + 1)[:-1].astype(np.float32)


def to_wav(data: bytes) -> bytes:
    """The WAV file (mono, 8-bit samples) that holds ``data`` padded by bytes 32 to a positive multiple of HOP."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + b" " * ((-len(data) % HOP) if data else HOP))
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """The bin of the strongest peak of each frame of the short-time Fourier transform; the mean is taken out first, and bins 0 to 2 don't count."""
    signal = np.frombuffer(payload, np.uint8).astype(np.float32)
    signal -= np.float32(signal.mean(dtype=np.float64))
    signal = np.concatenate([signal, np.zeros(HOP, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(signal, 2 * HOP)[::HOP]
    out = []
    for at in range(0, len(frames), _FRAMES):
        spectrum = np.fft.rfft(frames[at : at + _FRAMES] * _WINDOW, axis=1)[:, 3:]
        power = spectrum.real**2 + spectrum.imag**2
        out.append(power.argmax(axis=1).astype(np.int32) + 3)
    return np.concatenate(out)


def landmarks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame of the first peak) and codes (first bin, second bin, distance) of all pairs, by time."""
    top = peaks(payload)
    times, codes = [], []
    for d in range(1, REACH + 1):
        if len(top) > d:
            times.append(np.arange(len(top) - d, dtype=np.int32))
            codes.append(top[:-d] << 16 | top[d:] << 4 | d)
    if not times:
        times, codes = [np.zeros(1, np.int32)], [top[:1] << 16]  # one frame: its peak alone
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(t, kind="stable")
    return t[order], c[order].astype(np.int32)


def _row(text: str) -> tuple:
    data = text.encode()
    stored = to_wav(data)
    payload = from_wav(stored)
    times, codes = landmarks(payload)
    digest = hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
    return (
        len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored),
        hashlib.sha256(stored).hexdigest(), f"{len(payload) // HOP}:{len(codes)}:{digest[:40]}", times, codes,
    )


_NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "peak_times", "pair_codes"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: sizes, hashes of the payload read back and of the stored WAV, and its fingerprint.

    ``peak_times`` and ``pair_codes`` are the time-coded arrays; ``feature`` names them: frames, pairs and a hash of
    both. Null and empty texts are stored as one hop of bytes 32; rows of equal texts have equal values; other columns
    are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            columns = zip(*map(_row, text_of(part)), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(list(c), k) for c, k in zip(columns, _KINDS, strict=True))], names=[id_col, *_NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_times array<int>, pair_codes array<int>"
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
