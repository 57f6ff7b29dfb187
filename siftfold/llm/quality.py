"""Quality: votes of the nearest labelled documents in a latent-semantic space, by exact blocked cosine products."""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftfold.llm.common import arrow_map, bucket_of, give_back, labelled, numbered, slices, table, text_of

#: Bound of the labelled rows that are broadcast as vectors.
SAMPLE = 4000
#: Hashed terms; and terms of repetition: same word again, repeated pairs, repeated words, repeated lines, words in capitals.
TERMS, REPEATS = 2048, 5
RANK, NEIGHBOURS, SHARPNESS = 32, 25, 8.0
CUT = 0.5
_BLOCK = 512
_MARKS = re.compile(r"[\W_]+")


class Terms:
    """Counts of terms: hashed words without their marks, hashed marks, and repetitions. Remembers the terms of words."""

    def __init__(self, remember: int = 200_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.remember = remember

    @staticmethod
    def of(word: str) -> tuple[int, ...]:
        word = word.lower()
        bare = _MARKS.sub("", word)
        hashed = ([bare] if bare else []) + ["\x01" + m for m in _MARKS.findall(word)]
        return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % TERMS for x in hashed)

    def counts(self, texts: list[str]) -> np.ndarray:
        """log(1 + n a thousand words) of each term."""
        out = np.zeros((len(texts), TERMS + REPEATS), np.float32)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for i, text in enumerate(texts):
            words = text.split()
            new = set(words)
            n_distinct = len(new)
            for w in new.difference(known):
                known[w] = self.of(w)
            ids = [t for w in words for t in known[w]]
            out[i, :TERMS] = np.bincount(ids, minlength=TERMS) if ids else 0
            pairs = set(zip(words, words[1:], strict=False))
            lines = [x for x in text.split("\n") if x.strip()]
            repeated = (1 - len(set(lines)) / len(lines)) * len(words) if lines else 0.0
            again = sum(map(operator.eq, words, words[1:]))
            out[i, TERMS:] = again, max(0, len(words) - 1) - len(pairs), len(words) - n_distinct, repeated, sum(map(str.isupper, words))
            out[i] *= 1000 / max(1, len(words))
        return np.log1p(out)


@dataclass
class Neighbours:
    weight: np.ndarray  # of each term, learnt
    axes: np.ndarray  # (TERMS + REPEATS, rank)
    vectors: np.ndarray  # (rows, rank), of length 1
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = (counts * self.weight) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """The labels of the nearest rows, weighed by a power of their cosines. Ties at the last place count all alike."""
        out = np.full(len(counts), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(counts) if k else 0, _BLOCK):
            cosine = self.embed(counts[a : a + _BLOCK]) @ self.vectors.T
            last = np.partition(cosine, -k, axis=1)[:, [-k]]
            weight = np.where(cosine >= last, np.maximum(cosine, 0) ** SHARPNESS, 0).astype(np.float64)
            n = weight.sum(axis=1)
            out[a : a + _BLOCK] = np.where(n > 0, weight @ self.labels / np.maximum(n, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def term_weights(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many standard deviations a term's mean differs between the labels; idf where there is one label alone."""
    if len(y) and 0 < y.sum() < len(y):
        good, bad = counts[y == 1], counts[y != 1]
        return (np.abs(good.mean(axis=0) - bad.mean(axis=0)) / np.sqrt(good.var(axis=0) + bad.var(axis=0) + 1e-2)).astype(np.float32)
    return (np.log((len(y) + 1) / ((counts > 0).sum(axis=0) + 1)) + 0.3).astype(np.float32)


def train(counts: np.ndarray, labels: np.ndarray) -> Neighbours:
    """Learns the weights of terms, the latent axes and the vectors from rows of Terms.counts() and their labels."""
    y = np.asarray(labels, np.float64)
    weight = term_weights(counts, y)
    x = (counts * weight).astype(np.float64)
    # Latent axes: leading right singular vectors, by the Gram matrix of the terms, or of the rows where these are fewer.
    if not len(x):
        axes = np.eye(TERMS + REPEATS, RANK)
    elif len(x) < x.shape[1]:
        values, left = np.linalg.eigh(x @ x.T)
        order = [i for i in np.argsort(values)[::-1][:RANK] if values[i] > 1e-9]
        axes = x.T @ left[:, order] / np.sqrt(values[order])
    else:
        values, right = np.linalg.eigh(x.T @ x)
        axes = right[:, np.argsort(values)[::-1][:RANK]]
    axes = axes.astype(np.float32)
    model = Neighbours(weight, axes, np.zeros((0, axes.shape[1]), np.float32), y, float(y.mean()) if len(y) else 0.5)
    if len(x):
        model.vectors = model.embed(counts)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, held_out: int = 1, of: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Neighbours:
    """Vectors and ``labels.quality`` of at most ``sample`` labelled rows, by order of a hash of the id, from their whole texts.

    Rows whose crc32 of the id mod ``of`` is ``held_out`` are not seen. Null texts count as empty; of rows with equal ids the
    least text is learnt from, of several labels the largest. Without labels the vote is 0.5. Terms are counted by the
    executors: the driver gets one row of numbers a text, at most sample x 2053.
    """
    found = labelled(docs, labels, "quality", held_out, of, sample, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for part in (part for batch in batches for part in slices(batch)):
            rows = pa.array([c.tobytes() for c in terms.counts(text_of(part))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), rows], names=["id", "y", "counts"])

    schema = T.StructType([found.schema["id"], found.schema["y"], T.StructField("counts", T.BinaryType())])
    got = arrow_map(found.select("id", "y", "text"), run, schema).toPandas().sort_values("id", kind="stable")
    counts = np.frombuffer(b"".join(map(bytes, got.counts)), np.float32).reshape(len(got), TERMS + REPEATS)
    model = train(counts, got.y.to_numpy())
    del got, counts
    give_back()
    return model


def score_quality(docs: DataFrame, model: Neighbours, text_col: str = "text") -> DataFrame:
    """``docs`` with column ``quality_score`` (0 to 1, higher: label 1 likelier), by the whole text alone.

    Null and empty texts get the prior, the share of label 1. Repeated rows are scored each, equal texts alike, an empty
    table gives an empty result, other columns pass through, and a column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE x RANK floats and the axes: under 1 MB
    docs = docs.drop("quality_score")
    text = f"c{docs.columns.index(text_col)}"
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in (part for whole in batches for part in slices(whole, name=text)):
            votes = sent.value.vote(terms.counts(text_of(batch, text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, pa.float64())], names=schema.names)

    return arrow_map(numbered(docs), run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of documents: null and empty texts get the prior, texts count whole
    however long, repeated rows are scored each, equal texts alike, ties among neighbours count all; a null id is not held
    out. An empty table gives an empty result; without labels all scores are 0.5. Other columns are not read."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    held = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
