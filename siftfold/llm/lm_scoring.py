"""LM scoring: a log-bilinear neural model trained in numpy by noise-contrastive estimation.

A token is predicted from the embeddings of the tokens before it in two levels: its cell among CELLS, then its unit among
the UNITS of the cell, each level normalised. The most frequent words and the end are units of their own, other words
share units by their last three bytes; within a unit a word has its share of the unit's training tokens, so that
probabilities over all words, with one unknown word a shared unit, sum to 1. Counts come from all training tokens, and
every training token trains the network once.

Scores do not depend on partitioning or batches: rows are dealt to shards by a hash of id and text, a shard's rows are
learnt in the order of that hash, in steps of fixed size, and the networks of the shards are averaged by tokens. The
number of shards grows with the training tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftfold.llm.common import arrow_map, bucket_of, slices, table, text_of, written

#: Cells; units of a cell; units of single words (the first is the end), and units that other words share.
CELLS, UNITS, OWN = 32, 64, 1536
ALL = CELLS * UNITS
SHARED = ALL - OWN
#: Embedding size, tokens of context, and the id that stands before a text.
DIM, CONTEXT, BEFORE = 16, 6, ALL
#: Counts of so many words, none over LONGEST bytes, are broadcast; the others are joined.
FREQUENT, LONGEST = 1 << 18, 64
#: Noise a token; tokens of a step; tokens of a shard, until there are MOST_SHARDS.
NOISE, STEP, SHARD, MOST_SHARDS = 25, 4096, 1_000_000, 4096
END = b"\n"  # no word holds white space
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NEVER = np.float32(-1e4)


def tokens_of(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").translate(_LOWER).split(), END]


def shared_unit(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % SHARED


@dataclass
class LogBilinear:
    """Scores: (sum over context of weight[j] * context[id]) . cell[c] + cell_bias[c], and the same of units within a cell."""

    context: np.ndarray
    weight: np.ndarray
    cell: np.ndarray
    cell_bias: np.ndarray
    unit: np.ndarray
    unit_bias: np.ndarray

    SHAPES = ((ALL + 1, DIM), (CONTEXT, DIM), (CELLS, DIM), (CELLS,), (ALL, DIM), (ALL,))

    @classmethod
    def start(cls, unit_counts: np.ndarray, seed: int = 11) -> LogBilinear:
        """Biases give the distribution of the counts; units of single words that do not exist can't be predicted."""
        rng = np.random.default_rng(seed)
        r = lambda scale, *s: (scale * rng.standard_normal(s)).astype(np.float32)
        live = (unit_counts > 0) | (np.arange(ALL) >= OWN)
        c = np.where(live, unit_counts + 0.5, 0.0)
        by_cell = c.reshape(CELLS, UNITS).sum(axis=1)
        log = lambda p: np.where(p > 0, np.log(np.maximum(p, 1e-30)), _NEVER).astype(np.float32)
        unit_bias = log(c / np.repeat(np.maximum(by_cell, 1e-30), UNITS))
        return cls(r(0.3, ALL + 1, DIM), np.full((CONTEXT, DIM), 0.5, np.float32), r(0.03, CELLS, DIM), log(by_cell / by_cell.sum()), r(0.03, ALL, DIM), unit_bias)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.context, self.weight, self.cell, self.cell_bias, self.unit, self.unit_bias

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @classmethod
    def of(cls, v: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for shape in cls.SHAPES:
            size = int(np.prod(shape))
            out.append(v[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return cls(*out)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """x: rows of ``context``, CONTEXT of them before the first token that is predicted."""
        n = len(x) - CONTEXT
        q = np.zeros((n, DIM), np.float32)
        for j in range(CONTEXT):
            q += x[CONTEXT - 1 - j : CONTEXT - 1 - j + n] * self.weight[j]
        return q

    def log_probabilities(self, ids: np.ndarray, block: int = 16_384) -> np.ndarray:
        """Natural, of the unit of each token after the first CONTEXT; those before a text have none (0)."""
        n = len(ids) - CONTEXT
        out = np.zeros(max(n, 0), np.float64)
        for a in range(0, n, block):
            b = min(n, a + block)
            want = ids[a + CONTEXT : b + CONTEXT]
            real = np.flatnonzero(want != BEFORE)
            if not len(real):
                continue
            q, want = self.queries(self.context[ids[a : b + CONTEXT]])[real], want[real]
            cell = want // UNITS
            got = _chosen(q @ self.cell.T + self.cell_bias, cell)
            for c, mine in _groups(cell):
                at = slice(c * UNITS, (c + 1) * UNITS)
                got[mine] += _chosen(q[mine] @ self.unit[at].T + self.unit_bias[at], want[mine] - c * UNITS)
            out[a + real] = got
        return out


def _chosen(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probabilities of one entry of each row of scores."""
    own = z[np.arange(len(z)), at].astype(np.float64)
    if not (z.max() < 80 and own.min() > -80):  # else exp() can do without the largest score
        top = z.max(axis=1, keepdims=True)
        z, own = z - top, own - top[:, 0]
    return own - np.log((np.exp(z, out=z) @ np.ones(z.shape[1], np.float32)).astype(np.float64))


def _groups(cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(cell, kind="stable")
    ends = np.cumsum(np.bincount(cell, minlength=CELLS))
    for c in range(CELLS):
        first = ends[c - 1] if c else 0
        if ends[c] > first:
            yield c, order[first : ends[c]]


class Trainer:
    """Adagrad on the noise-contrastive objective of both levels.

    Noise follows the unigram distribution of cells, and of units within the target's cell. NOISE samples a token are not
    drawn: the few cells and units all count, by how often they would be drawn, so training has no randomness.
    """

    def __init__(self, model: LogBilinear, unit_counts: np.ndarray):
        self.m = model
        start = LogBilinear.start(unit_counts)
        self.cell_noise, self.unit_noise = (NOISE * np.exp(x.astype(np.float64)) for x in (start.cell_bias, start.unit_bias))
        log = lambda x: np.log(np.maximum(x, 1e-30)).astype(np.float32)
        self.log_cell, self.log_unit = log(self.cell_noise), log(self.unit_noise)
        self.cell_noise, self.unit_noise = self.cell_noise.astype(np.float32), self.unit_noise.astype(np.float32)
        self.sums = [np.full_like(x, 1e-2) for x in model.arrays()]

    @staticmethod
    def _slopes(z: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the objective by the scores: of each entry as noise, and of the target as data."""
        np.subtract(log_noise, z, out=z)
        with np.errstate(over="ignore"):  # 1 / infinity is 0
            s = np.exp(z, out=z)
        s += 1
        np.reciprocal(s, out=s)
        rows = np.arange(len(z))
        data = s[rows, target] - 1
        s *= noise
        s[rows, target] += data
        return s

    def step(self, ids: np.ndarray, lr: float = 0.1) -> None:
        """ids: CONTEXT tokens, then those to learn; those before a text are context only."""
        m, n = self.m, len(ids) - CONTEXT
        real = np.flatnonzero(ids[CONTEXT:] != BEFORE)
        if not len(real):
            return
        x = m.context[ids]
        q, target = m.queries(x)[real], ids[CONTEXT:][real]
        cell = target // UNITS
        d = self._slopes(q @ m.cell.T + m.cell_bias, self.cell_noise, self.log_cell, cell)
        g_cell, g_cell_bias, g = d.T @ q, d.sum(axis=0), d @ m.cell
        g_unit, g_unit_bias = np.zeros_like(m.unit), np.zeros_like(m.unit_bias)
        for c, mine in _groups(cell):
            at, mine_q = slice(c * UNITS, (c + 1) * UNITS), q[mine]
            d = self._slopes(mine_q @ m.unit[at].T + m.unit_bias[at], self.unit_noise[at], self.log_unit[at], target[mine] - c * UNITS)
            g_unit[at], g_unit_bias[at] = d.T @ mine_q, d.sum(axis=0)
            g[mine] += d @ m.unit[at]
        g_q = np.zeros((n, DIM), np.float32)
        g_q[real] = g
        g_x, g_weight = np.zeros_like(x), np.zeros((CONTEXT, DIM), np.float32)
        for j in range(CONTEXT):
            at = slice(CONTEXT - 1 - j, CONTEXT - 1 - j + n)
            g_weight[j] = np.einsum("ij,ij->j", g_q, x[at])
            g_x[at] += g_q * m.weight[j]
        flat = (ids[:, None] * DIM + np.arange(DIM)).ravel()
        g_context = np.bincount(flat, weights=g_x.ravel(), minlength=(ALL + 1) * DIM).reshape(ALL + 1, DIM)
        for x, s, g in zip(m.arrays(), self.sums, (g_context, g_weight, g_cell, g_cell_bias, g_unit, g_unit_bias), strict=True):
            g = (g * np.float32(100 / len(real))).astype(np.float32)
            s += g * g
            x -= lr * g / np.sqrt(s)


class Shard:
    """Learns a stream of texts in steps of STEP tokens, wherever batches end."""

    def __init__(self, start: LogBilinear, unit_counts: np.ndarray):
        self.model = LogBilinear.of(start.vector())
        self.trainer, self.seen = Trainer(self.model, unit_counts), 0
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, units: np.ndarray, times: int) -> None:
        text = np.concatenate([np.full(CONTEXT, BEFORE, np.int64), units.astype(np.int64)])
        for _ in range(times):
            self.held.append(text)
            self.n += len(text)
            self.seen += len(units)
            if self.n >= STEP + CONTEXT:
                self._learn(False)

    def _learn(self, rest: bool) -> None:
        ids = np.concatenate(self.held)
        a = 0
        while len(ids) - a >= STEP + CONTEXT or (rest and len(ids) - a > CONTEXT):
            self.trainer.step(ids[a : a + STEP + CONTEXT])
            a += STEP
        self.held, self.n = [ids[a:]], max(0, len(ids) - a)

    def end(self) -> np.ndarray:
        """The parameters times the number of tokens, and that number."""
        if self.held:
            self._learn(True)
        return np.append(self.model.vector().astype(np.float64) * self.seen, float(self.seen))


def _counted(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """word binary, c: counts of the tokens of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for part in (part for batch in batches for part in slices(batch)):
            for t in text_of(part):
                seen.update(tokens_of(t))
                if len(seen) > most:
                    yield flush()
        yield flush()

    return arrow_map(docs.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Frequent:
    """Of the most frequent words and the end: row in the arrays; units, log10 of base and share, whether seen in training.
    Row len(row) + k stands for other words of unit k."""

    row: dict[bytes, int]
    ids: np.ndarray
    base: np.ndarray
    within: np.ndarray
    seen: np.ndarray


@dataclass
class Statistics:
    frequent: Frequent
    n: int
    v: int
    unit_counts: np.ndarray
    unit_words: np.ndarray


def _statistics(counts: DataFrame) -> Statistics:
    """Gathers unit totals over all words, and the frequent words. ``counts`` has word, c and the shared unit k."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    n, v, ends = int(total.n or 0), int(total.v), int(total.ends or 0)
    short = counts.where((F.octet_length("word") <= LONGEST) & (F.col("word") != F.lit(END)))
    own = [(bytes(r.word), r.c) for r in short.orderBy(F.desc("c"), "word").select("word", "c").limit(OWN - 1).collect()]
    # The least count such that no more than FREQUENT words have it: by a table of counts, with 64 steps a power of two.
    steps = short.groupBy(F.floor(F.log2("c") * 64).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("s", ascending=False)
    fits = steps.s[steps.n.cumsum() <= FREQUENT]
    count = dict(own)
    if len(fits):
        top = short.where(F.floor(F.log2("c") * 64) >= int(fits.min())).select("word", "c").toPandas()
        count |= {bytes(w): int(c) for w, c in zip(top.word, top.c, strict=True)}
    words = [END, *sorted(count, key=lambda w: (-count[w], w))]
    c = np.array([ends, *(count[w] for w in words[1:])], np.int64)
    per_unit = counts.groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
    uc, uv = np.zeros(ALL, np.int64), np.zeros(ALL, np.int64)
    uc[per_unit.k], uv[per_unit.k] = per_unit.c, per_unit.v
    row = {w: i for i, w in enumerate(words)}
    ids = np.array([shared_unit(w) for w in words], np.int64)
    for i, w in enumerate([END, *(w for w, _ in own)]):
        r = row[w]
        if c[r]:
            uc[ids[r]] -= c[r]
            uv[ids[r]] -= 1
        uc[i], uv[i], ids[r] = c[r], 1, i
    base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    within = np.where(ids < OWN, 0.0, np.log10((c + 0.5) / (uc[ids] + 0.5 * (uv[ids] + 1))))
    uc[0] = max(uc[0], 1)  # each text has an end
    return Statistics(Frequent(row, np.concatenate([ids, np.arange(ALL)]), base, within, c > 0), n, v, uc, uv)


def _rows(tokens: list[list[bytes]], row: dict[bytes, int]) -> np.ndarray:
    n, get = len(row), row.get
    return np.fromiter((n + shared_unit(w) if (r := get(w)) is None else r for t in tokens for w in t), np.int64, sum(map(len, tokens)))


def train(learnt: DataFrame, stats: Statistics) -> LogBilinear:
    """The average, by tokens, of networks that each learn a shard of ``learnt`` (id, text).

    Rows equal in id and text are aggregated before they are dealt, and spread over all shards with the number of times
    each has to learn them, so a row that is repeated without bound is no hot shard.
    """
    start = LogBilinear.start(stats.unit_counts)
    sent = learnt.sparkSession.sparkContext.broadcast((start, stats.frequent.row, stats.frequent.ids, stats.unit_counts))
    shards = min(max(1, -(-stats.n // SHARD)), MOST_SHARDS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, row, ids, _ = sent.value
        for part in (part for batch in batches for part in slices(batch)):
            tokens = [tokens_of(t) for t in text_of(part)]
            units = ids[_rows(tokens, row)].astype("<u2")
            ends = np.cumsum([len(t) for t in tokens])
            found = [units[e - len(t) : e].tobytes() for e, t in zip(ends.tolist(), tokens, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("g"), pa.array(found, pa.binary())], names=["h", "g", "units"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, _, _, unit_counts = sent.value
        now, shard, total = None, None, 0.0
        for batch in batches:
            for s, times, units in zip(batch.column("shard").to_pylist(), batch.column("times").to_pylist(), batch.column("units"), strict=True):
                if s != now:
                    total = total + shard.end() if shard else total
                    now, shard = s, Shard(start, unit_counts)
                shard.add(np.frombuffer(units.as_buffer(), "<u2"), times)
        if shard:
            yield _pieces(total + shard.end())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("piece").to_pylist(), batch.column("held").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(v, np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["piece", "held"])

    hashed = learnt.select(F.xxhash64("id", "text").alias("h"), F.hash("id", "text").alias("g"), "text")
    rows = arrow_map(hashed, encoded, "h long, g int, units binary").groupBy("h", "g").agg(F.first("units").alias("units"), F.count(F.lit(1)).alias("n"))
    spread = F.least("n", F.lit(shards))
    rows = rows.select("h", "g", "units", "n", spread.alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)).alias("j"))
    times = F.floor(F.col("n") / F.col("m")) + (F.col("j") < F.col("n") % F.col("m")).cast("long")
    dealt = rows.select(F.pmod(F.col("h") + F.col("j"), F.lit(shards)).alias("shard"), "h", "g", "units", times.alias("times"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "g")
    pieces = arrow_map(arrow_map(dealt, learn, "piece int, held binary").repartition("piece"), summed, "piece int, held binary")
    got = sorted(((r.piece, bytes(r.held)) for r in pieces.collect()))  # one network, under 1 MB
    sent.unpersist()
    if not got:
        return start
    v = np.concatenate([np.frombuffer(x, np.float64) for _, x in got])
    return LogBilinear.of(v[:-1] / v[-1])


def _pieces(v: np.ndarray, size: int = 8192) -> pa.RecordBatch:
    at = range(0, len(v), size)
    return pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array([v[a : a + size].tobytes() for a in at], pa.binary())], names=["piece", "held"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, of: int = 5) -> DataFrame:
    """A row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows whose crc32 of the id as text mod ``of`` is not ``held_out``; rows without an id are learnt from.
    Tokens are words (no ASCII white space) after lower-casing A-Z, then one end. ``score`` is the model's log10 probability of the
    text, ``base_score`` that of smoothed token counts. Null and empty texts have one token, the end; texts are scored whole,
    however long. Repeated rows are each learnt from and scored, equal texts score alike; of words with equal counts the
    lesser has the earlier unit; other columns are not read; an empty table gives an empty result. Without training rows
    no token is known.
    """
    apart = F.coalesce(bucket_of(docs[id_col], of), F.lit(-1)) == held_out
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), apart.alias("held_out"))
    learnt = rows.where(~F.col("held_out"))
    tail = F.substring(F.col("word"), -3, 3)
    counts = written(_counted(learnt).withColumn("k", (F.lit(OWN) + F.pmod(F.crc32(tail), F.lit(SHARED))).cast("int")), "lm-counts")
    stats = _statistics(counts)
    model = train(learnt.select("id", "text"), stats)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, stats.frequent))
    n, v, uc, uv = stats.n, stats.v, stats.unit_counts, stats.unit_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, f = sent.value
        names = ["uid", "word", "id", "held_out", "times", "n_tokens", "n_known", "base", "score"]
        known = len(f.row)
        for part in (part for batch in batches for part in slices(batch)):
            tokens = [tokens_of(t) for t in text_of(part)]
            rows, size = _rows(tokens, f.row), np.array([len(t) for t in tokens])
            starts = np.cumsum(size) - size
            units = np.full(len(rows) + CONTEXT * len(tokens), BEFORE, np.int64)
            at = np.arange(len(rows)) + np.repeat(CONTEXT * np.arange(1, len(tokens) + 1), size)
            units[at] = f.ids[rows]
            lp = model.log_probabilities(units)[at - CONTEXT] / np.log(10)
            common = rows < known
            within = np.where(common, f.within[np.where(common, rows, 0)], 0.0)
            base = np.where(common, f.base[np.where(common, rows, 0)], 0.0)
            uid, ids, held = (part.column(c) for c in ("uid", "id", "held_out"))
            sums = [np.add.reduceat(x, starts) for x in (base, lp + within)]
            ends = np.add.reduceat(f.seen[np.where(common, rows, 0)] & common, starts, dtype=np.int64)
            marks = [b"\n" + str(u).encode() for u in uid.to_pylist()]
            k = len(tokens)
            yield pa.RecordBatch.from_arrays([uid, pa.array(marks, pa.binary()), ids, held, pa.nulls(k, pa.int64()), pa.array(size, pa.int64()), pa.array(ends, pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=names)
            uids, words, times = [], [], []
            rare = np.flatnonzero(~common)
            cut = np.searchsorted(rare, np.append(starts, len(rows)))
            for i, (u, t) in enumerate(zip(uid.to_pylist(), tokens, strict=True)):
                if cut[i] < cut[i + 1]:
                    seen = Counter(t[r] for r in (rare[cut[i] : cut[i + 1]] - starts[i]).tolist())
                    uids += [u] * len(seen)
                    words += seen
                    times += seen.values()
            if words:
                m = len(words)
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(words, pa.binary()), pa.nulls(m, ids.type), pa.nulls(m, pa.bool_()), pa.array(times, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=names)

    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("word", T.BinaryType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("times", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])
    parts = arrow_map(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "text", "held_out"), run, schema)
    joined = parts.join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0)) + F.lit(0.5)
    k = (F.pmod(F.crc32(F.substring(F.col("word"), -3, 3)), F.lit(SHARED)) + 1).cast("int")
    logs = F.array(*[F.lit(float(np.log10(uc[i] + 0.5 * (uv[i] + 1)))) for i in range(OWN, ALL)])
    is_word = F.col("times").isNotNull()
    base = F.when(is_word, F.col("times") * (F.log10(c) - F.lit(float(np.log10(n + 0.5 * (v + 1)))))).otherwise(F.col("base"))
    score = F.when(is_word, F.col("times") * (F.log10(c) - F.element_at(logs, k))).otherwise(F.col("score"))
    n_known = F.when(is_word, F.when(F.col("c").isNotNull(), F.col("times")).otherwise(F.lit(0))).otherwise(F.col("n_known")).cast("long")
    summed = joined.select("uid", "id", "held_out", "n_tokens", n_known.alias("n_known"), base.alias("base"), score.alias("score")).groupBy("uid").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score")
    )
    return summed.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
