"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftfold.llm.common import arrow_map, bucket_of, give_back, labelled, numbered, slices, table, text_of

#: Bounds of the training sample, which the driver holds: labelled rows, and bytes of all their texts together.
SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
CUT = 0.3
_PAD = max(WIDTHS) - 1
#: Words of a text that are pooled at once; longer texts are pooled piece by piece, with an overlap.
_PIECE = 40_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def features(token: str) -> tuple[int, int, int]:
    """Buckets of the word, of its first four letters and of its last four, after all but letters are left out."""
    w = _NOT_LETTERS.sub("", token.lower())
    if not w:
        return 0, 0, 0  # bucket 0 stays at zero
    at = lambda s: 1 + zlib.crc32(s.encode()) % (BUCKETS - 1)
    return at(w), at("^" + w[:4]), at("$" + w[-4:])


@dataclass
class TextCNN:
    """score = sigmoid(scale * (w . max over words of relu(conv(text)) + bias) + shift)."""

    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    conv: np.ndarray = field(default_factory=lambda: np.zeros((sum(WIDTHS), DIM, FILTERS), np.float32))
    conv_bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    trained: bool = False  # on rows of both labels

    def embedded(self, f: np.ndarray) -> np.ndarray:
        return self.table[f[:, 0]] + self.table[f[:, 1]] + self.table[f[:, 2]]

    def convolved(self, x: np.ndarray) -> np.ndarray:
        """Filter values at each row of x that starts a window; x has _PAD more rows."""
        n = len(x) - _PAD
        y = x @ self.conv.transpose(1, 0, 2).reshape(DIM, -1)
        parts, k = [], 0
        for w in WIDTHS:
            part = y[:n, k * FILTERS : (k + 1) * FILTERS].copy()
            for j in range(1, w):
                part += y[j : j + n, (k + j) * FILTERS : (k + j + 1) * FILTERS]
            parts.append(part)
            k += w
        return np.concatenate(parts, axis=1) + self.conv_bias

    def strongest(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter in a text of feature rows, of which _PAD are empty at its end, and the window that
        has it, the first of equal ones; _PIECE windows at once."""
        columns = np.arange(len(self.conv_bias))
        best, place = np.full(len(columns), -np.inf, np.float32), np.zeros(len(columns), np.int64)
        for a in range(0, len(f) - _PAD, _PIECE):
            c = self.convolved(self.embedded(f[a : a + _PIECE + _PAD]))
            at = c.argmax(axis=0)
            value = c[at, columns]
            place = np.where(value > best, a + at, place)
            best = np.maximum(best, value)
        return best, place

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.bias

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        z = self.scale * self.logits(pooled).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class _Words:
    """Remembers tokens' rows of an embedding table; a worker has one for each model."""

    def __init__(self, model: TextCNN, remember: int = 150_000):
        self.model, self.remember = model, remember
        self._clear()

    def _clear(self) -> None:
        self.at = {"": 0}
        self.rows, self.used = np.zeros((1024, DIM), np.float32), 1

    def embedded(self, pieces: list[list[str]]) -> np.ndarray:
        """Rows of all pieces, each followed by _PAD empty ones."""
        if self.used > self.remember:
            self._clear()
        new = [t for t in set().union(*pieces) if t not in self.at]
        if new:
            f = np.array([features(t) for t in new])
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = self.model.embedded(f)
            self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        get, pad = self.at.__getitem__, [0] * _PAD
        ids: list[int] = []
        for p in pieces:
            ids.extend(map(get, p))
            ids.extend(pad)
        return self.rows[np.array(ids, np.int64)]


def _pieces(text: str) -> list[tuple[list[str], int]]:
    """Words, and how many of them begin windows: the last of a piece are there for the windows of those before."""
    tokens = text.split() or [""]
    starts = range(0, max(1, len(tokens) - _PAD), _PIECE)
    return [(tokens[i : i + _PIECE + _PAD], len(tokens) - i if i == starts[-1] else _PIECE) for i in starts]


def pooled(model: TextCNN, words: _Words, texts: list[str], most: int = 150_000) -> np.ndarray:
    """The largest value of each filter in each text; ``most`` words are convolved at once."""
    out = np.full((len(texts), len(model.out)), -np.inf, np.float32)
    group: list[list[str]] = []
    owner: list[int] = []
    begin: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, owner, begin, held
        if group:
            y = model.convolved(words.embedded([*group, []]))
            starts = np.cumsum([0] + [len(p) + _PAD for p in group])[:-1]
            bounds = np.stack([starts, starts + begin], 1).ravel()
            best = np.maximum.reduceat(y, bounds, axis=0)[::2]
            np.maximum.at(out, owner, best)
        group, owner, begin, held = [], [], [], 0

    for i, t in enumerate(texts):
        for p, n in _pieces(t):
            group.append(p)
            begin.append(n)
            owner.append(i)
            held += len(p)
            if held > most:
                flush()
    flush()
    return out


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], epochs: int = 5, seed: int = 7) -> TextCNN:
    """Adagrad on the logistic loss, over the texts but each fifth, on which scale, shift and thresholds are set.

    The first embedding dimension starts at the log-odds of the bucket's presence in labelled texts, the others at random.
    """
    rng = np.random.default_rng(seed)
    model = TextCNN()
    y = np.asarray(labels, np.float32)
    if not len(texts) or y.min() == y.max():
        # nothing to tell texts apart by: all get the share of label 1, smoothed by ten rows of which half a one has it
        model.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 9.5)))
        return model
    model.trained = True
    known: dict[str, tuple[int, int, int]] = {"": (0, 0, 0)}
    docs = []
    for t in texts:
        tokens = t.split() or [""]
        for w in set(tokens):
            if w not in known:
                known[w] = features(w)
        f = np.array([known[w] for w in tokens], np.int32)
        docs.append(np.concatenate([f, np.zeros((_PAD, 3), np.int32)]))
    held = np.arange(len(docs)) % 5 == 4
    fit = np.flatnonzero(~held)
    seen = np.zeros((2, BUCKETS), np.float32)
    for i in fit:
        seen[int(y[i]), np.unique(docs[i])] += 1
    odds = np.log((seen[1] + 0.1) / (y[fit].sum() + 0.2)) - np.log((seen[0] + 0.1) / (len(fit) - y[fit].sum() + 0.2))
    odds[seen.sum(0) < 5] = 0
    model.table = (0.02 * rng.standard_normal((BUCKETS, DIM))).astype(np.float32)
    model.table[:, 0] = np.clip(odds / 4, -1, 1)
    model.table[0] = 0
    model.conv = (0.2 * rng.standard_normal(model.conv.shape)).astype(np.float32)
    model.conv[:, 0, 0::2] += 0.5
    model.out = (0.3 * np.where(np.arange(len(model.out)) % 2 == 0, 1, -1)).astype(np.float32)
    model.bias = -1.0
    sums = {k: np.full_like(getattr(model, k), 1e-6) for k in ("table", "conv", "conv_bias", "out")}
    bias_sum, lr = 1e-6, 0.05
    firsts = [(k, sum(WIDTHS[:k]), w) for k, w in enumerate(WIDTHS)]
    heavy = float(min(1.5, (len(fit) - y[fit].sum()) / max(1.0, y[fit].sum())))

    def step(name: str, at, grad: np.ndarray) -> None:
        sums[name][at] += grad**2
        getattr(model, name)[at] -= lr * grad / np.sqrt(sums[name][at])

    for epoch in range(epochs):
        lr = 0.05 / (1 + 0.3 * epoch)
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            g_conv, g_cb, g_out = np.zeros_like(model.conv), np.zeros_like(model.conv_bias), np.zeros_like(model.out)
            g_bias, rows, grads = 0.0, [], []
            for i in batch:
                f = docs[i]
                best, at = model.strongest(f)
                h = np.maximum(best, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.bias, -30, 30)))
                d = (p - y[i]) * (heavy if y[i] else 1.0) / len(batch)
                g_out += d * h
                g_bias += d
                dh = d * model.out * (h > 0)
                g_cb += dh
                for k, first, w in firsts:
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(w):
                        place = at[cols] + j
                        g_conv[first + j] += (model.embedded(f[place]) * dh[cols, None]).T
                        gx = dh[cols, None] * model.conv[first + j].T
                        rows.append(f[place].ravel())
                        grads.append(np.repeat(gx, 3, axis=0))
            r, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            g = np.zeros((len(r), DIM), np.float32)
            np.add.at(g, inverse, np.concatenate(grads))
            g[r == 0] = 0
            step("table", r, g)
            step("conv", slice(None), g_conv)
            step("conv_bias", slice(None), g_cb)
            step("out", slice(None), g_out)
            bias_sum += g_bias**2
            model.bias -= lr * g_bias / np.sqrt(bias_sum)
    _calibrate(model, docs, y, held, langs)
    return model


def _calibrate(model: TextCNN, docs: list[np.ndarray], y: np.ndarray, held: np.ndarray, langs: list[str | None]) -> None:
    at = np.flatnonzero(held)
    best = np.array([model.strongest(docs[i])[0] for i in at]) if len(at) else np.zeros((0, len(model.out)))
    if len(at) < 20 or len(set(y[at])) < 2:
        return
    z, t = model.logits(best).astype(np.float64), y[at]
    a, b = 1.0, 0.0
    for _ in range(300):  # logistic regression on the logit, with a weak pull to scale 1
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.05 * (np.mean((p - t) * z) + 0.01 * (a - 1))
        b -= 0.3 * np.mean(p - t)
    model.scale, model.shift = float(max(a, 0.1)), float(b)
    s = model.scores(best)
    for lang in {None, *(langs[i] for i in at)}:
        mine = np.array([lang is None or langs[i] == lang for i in at])
        if lang is not None and (t[mine].sum() < 5 or (1 - t[mine]).sum() < 5):
            continue  # too few to tell: the threshold of all languages holds
        model.thresholds[lang] = _best_cut(s[mine], t[mine])


def _best_cut(s: np.ndarray, t: np.ndarray) -> float:
    """The cut of best F1; of equal ones the nearest to CUT."""
    cuts = np.unique(np.concatenate([np.linspace(0.05, 0.95, 91), [CUT]]))
    f1 = [2 * ((s >= c) & (t == 1)).sum() / max(1, (s >= c).sum() + t.sum()) for c in cuts]
    good = cuts[np.array(f1) >= max(f1) - 1e-9]
    return float(good[np.abs(good - CUT).argmin()])


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2, of: int = 4, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TextCNN:
    """Learns ``labels.toxic`` from at most ``sample`` labelled rows, by order of a hash of the id, with whole texts.

    Their texts hold ``sample_bytes`` at most: only beyond that a row that would go over it is passed over. Rows whose
    crc32 of the id mod ``of`` is ``held_out`` are not seen. Null texts count as empty; of rows with equal ids the least
    text is learnt from, of several labels the largest; languages only set thresholds, and a table without them gets one
    threshold. Without rows of both labels the model is not trained: it gives every text the same score, the smoothed
    share of toxic rows (0.05 without any), and rejects none.
    """
    found = labelled(docs, labels, "toxic", held_out, of, sample, id_col, text_col, lang_col)
    sizes = found.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id").collect()  # sample rows at most
    ids, left = [], sample_bytes
    for r in sizes:
        if r.n <= left:
            ids.append(r.id)
            left -= r.n
    got = (found if len(ids) == len(sizes) else found.where(F.col("id").isin(ids))).toPandas().sort_values("id", kind="stable")
    model = train(got.text.tolist(), got.y.to_numpy(), [None if pd.isna(x) else x for x in got.lang])
    del got
    give_back()
    return model


_words: dict[str, _Words] = {}


def score_toxicity(docs: DataFrame, model: TextCNN, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1, higher: toxic likelier), by the whole text alone; other columns pass through.

    Null and empty texts are scored as a text without words. An empty table gives an empty result; repeated rows are
    scored each. A column of that name is replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 8 MB: BUCKETS x DIM floats
    docs = docs.drop(name)
    text = f"c{docs.columns.index(text_col)}"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        words = _Words(net)
        for batch in (part for whole in batches for part in slices(whole, name=text)):
            scores = net.scores(pooled(net, words, text_of(batch, text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return arrow_map(numbered(docs), run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of documents: null and empty texts are scored as texts without words,
    texts count whole however long, repeated rows are scored each, equal texts alike; a null id is not held out. An empty table
    gives an empty result; without labels all scores are 0.05. Other columns of documents and labels are not read."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: TextCNN, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the model does not reject, by the thresholds of their languages; the columns of ``docs``, whatever their names.

    A language without a threshold of its own, and null, has that of all languages. Null and empty texts are scored as texts
    without words; repeated rows and equal texts are decided alike; a score equal to the threshold is rejected. An untrained
    model rejects nothing; an empty table gives an empty result.
    """
    if not model.trained:
        return docs
    cut = F.lit(model.thresholds.get(None, CUT))
    for lang, c in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        cut = F.when(F.col(lang_col) == lang, F.lit(c)).otherwise(cut) if lang_col in docs.columns else cut
    name = "_toxicity"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return score_toxicity(docs, model, text_col, name).where(F.col(name) < cut).drop(name)
