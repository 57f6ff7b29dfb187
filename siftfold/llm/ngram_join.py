"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, and checks of pairs on their full n-gram sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftfold.llm.common import arrow_map, components, join_groups, keep_one, row_key, slices, table, text_of, written, Bitmap

WORDS, SIMILARITY = 5, 0.8
#: The target for the share of pairs at the least similarity that meet in a band.
RECALL = 0.9999
ROWS = 5
#: Sets of a bucket that are compared with each other in one task; larger buckets are cut into pairs of such blocks.
BLOCK = 1024
_P = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bands_for(similarity: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands with 1 - (1 - similarity ** rows) ** bands >= recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_table = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of lower-cased UTF-8, words being runs of anything but ASCII white space."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _IS_SPACE[data[end]]:  # a piece ends where a word does
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        if len(_table[0]) <= len(b):
            _table[:] = _powers(len(b) + 1, _P), _powers(len(b) + 1, _INVERSE)
        inside = ~_IS_SPACE[b]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _table[0][: len(b)], dtype=np.uint64)])
        out.append(_mix((sums[last] - sums[first]) * _table[1][first]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def ngrams(text: str, n: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of n-grams of words; a shorter text with any word has one, of all its words."""
    w = word_hashes(text.encode().translate(_LOWER))
    if not len(w):
        return w
    k = min(n, len(w))
    g = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        g = g * _P + w[j : len(w) - k + 1 + j]
    return np.unique(_mix(g))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def bands_of(self, grams: np.ndarray, step: int = 2048) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), step):
            np.minimum(least, (grams[i : i + step, None] * self.a + self.b).min(axis=0), out=least)
        least = least.reshape(self.bands, self.rows)
        h = np.arange(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            h = _mix(h * _P + least[:, r])
        return h.view(np.int64)


def _sets(docs: DataFrame, n: int, signer: Signer | None) -> DataFrame:
    """id, key (of the n-gram set; null without words), grams: their number or, without a signer, the sets; bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            keys, grams, bands = [], [], []
            for t in text_of(batch):
                g = ngrams(t, n)
                keys.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                grams.append(len(g) if signer else g.view(np.int64))
                bands.append(signer.bands_of(g) if signer and len(g) else None)
            arrays = [batch.column("id"), batch.column("row_key"), pa.array(keys, pa.binary()), pa.array(grams, pa.int64() if signer else pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(bands, pa.list_(pa.int64()))] if signer else [])], names=names)

    names = ["id", "row_key", "key", "grams", *(["bands"] if signer else [])]
    fields = [docs.schema["id"], docs.schema["row_key"], T.StructField("key", T.BinaryType()), T.StructField("grams", T.LongType() if signer else T.ArrayType(T.LongType()))]
    if signer:
        fields.append(T.StructField("bands", T.ArrayType(T.LongType())))
    return arrow_map(docs, run, T.StructType(fields))


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first ``split`` sets with the others (with themselves, if there are no others)."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.flatnonzero(np.bincount(column, minlength=len(grams)) > 1)
    place = np.full(len(grams), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    rows, column = rows[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    n_b = len(sets) - split or split
    out = np.zeros((split, n_b), np.float32)
    for c in range(0, len(shared), 4096):
        a, b = np.searchsorted(column, [c, c + 4096])
        m = np.zeros((len(sets), min(4096, len(shared) - c)), np.float32)
        m[rows[a:b], column[a:b] - c] = 1
        out += m[:split] @ (m[split:] if len(sets) > split else m).T
    return out


def _compare(band: int, similarity: float, left: list, right: list) -> Iterator[tuple[bytes, int, bytes]]:
    """Of sets of one bucket (key, grams, bands): (key, links that no earlier band has, least key of what it is linked to)."""
    members = left + right
    inter = overlaps([m[1] for m in members], len(left)).astype(np.float64)
    others = right or left
    total = np.array([len(m[1]) for m in left])[:, None] + np.array([len(m[1]) for m in others])[None, :]
    linked = inter / (total - inter) >= similarity
    if not right:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return
    a, b = np.array([m[2] for m in left]), np.array([m[2] for m in others])
    first = linked.copy()
    for k in range(band):
        first &= a[:, k][:, None] != b[:, k][None, :]
    keys = [m[0] for m in members]
    n = np.concatenate([first.sum(axis=1), first.sum(axis=0) if right else []]).astype(int)
    root = _roots(linked, np.argsort(np.argsort(np.array(keys))), len(left) if right else 0)
    for i, k in enumerate(keys):
        if n[i] or root[i] != i:
            yield k, int(n[i]), keys[root[i]]


def _roots(linked: np.ndarray, rank: np.ndarray, offset: int) -> np.ndarray:
    """The member of least rank that each one is connected to: ranks spread over all links at once until none changes.
    Columns of ``linked`` are the members from ``offset`` on."""
    now, m = rank.copy(), len(linked)
    while True:
        before = now.copy()
        others = now[offset : offset + linked.shape[1]]
        least = np.where(linked, others[None, :], len(rank)).min(axis=1, initial=len(rank))
        now[:m] = np.minimum(now[:m], least)
        least = np.where(linked, now[:m, None], len(rank)).min(axis=0, initial=len(rank))
        now[offset : offset + linked.shape[1]] = np.minimum(now[offset : offset + linked.shape[1]], least)
        by_rank = np.empty_like(now)
        by_rank[rank] = now
        now = np.minimum(now, by_rank[now])  # the root of the root
        if (now == before).all():
            break
    member = np.empty_like(rank)
    member[rank] = np.arange(len(rank))
    return member[now]


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n: int = WORDS, rows: int = ROWS, bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """A row per row of ``docs``: id, class_id, copies, n_links, row_key (tells rows apart by id and text).

    ``copies`` is the number of rows with the same set of n-grams of words (after lower-casing A-Z), ``n_links`` the number
    of other sets with a Jaccard similarity of ``similarity`` or more, and ``class_id`` the least id of all rows that copies
    and links connect. Shorter texts have one n-gram, of all their words; texts without words (null, empty) have no copies
    or links. Rows with equal ids stay rows of their own. A null id is
    never the least: a class without any other has a null class_id. An empty table gives an empty result.

    A pair at the least similarity meets in a band with a probability of RECALL; pairs that meet are checked on their full
    sets, and no bucket is cut off: buckets of over ``block`` sets are compared as pairs of blocks, in tasks of their own.
    Links are counted where they are found, never listed; each is counted in the first band in which its sets meet.
    """
    bands = bands or bands_for(similarity, rows)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), row_key(docs[id_col], docs[text_col]).alias("row_key"))
    signed = written(_sets(texts, n, Signer(bands, rows)), "ngram-signatures")
    total = signed.count()
    classes = signed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.min("row_key").alias("rep_row"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes, "ngram-classes")

    held = classes.select("key", F.posexplode("bands").alias("band", "h"))
    mark = F.xxhash64("key")
    buckets = held.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark % 1_000_003).alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("n > 1")
    # Of buckets with the same members that of the first band is enough: their pairs meet there first.
    buckets = buckets.groupBy("n", "x", "s", "lo", "hi").agg(F.min(F.struct("band", "h")).alias("b")).select("b.band", "b.h", "n")
    members = held.join(buckets, ["band", "h"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = written(members.select("band", "h", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("mine")), "ngram-members")

    wanted = written(members.select("key").distinct().join(classes.select("key", "rep_row", "bands"), "key"), "ngram-wanted")
    maybe = Bitmap(wanted.select("rep_row"), wanted.count()).keep(texts, "row_key")
    sets = _sets(maybe, n, None).join(wanted.select("key", F.col("rep_row").alias("row_key"), "bands"), ["key", "row_key"]).drop("id", "row_key").dropDuplicates(["key"])
    tasks = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("band", "h", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    tasks = tasks.join(sets, "key").repartition("band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, right = None, [], []
        out: list[tuple[bytes, int, bytes]] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["key", "links", "root"])

        for b in batches:
            names = [b.column(c).to_pylist() for c in ("band", "h", "i", "j", "mine", "key")]
            grams, hashes = b.column("grams"), b.column("bands")
            for r, (band, h, i, j, mine, key) in enumerate(zip(*names, strict=True)):
                if (band, h, i, j) != at:
                    if at and len(left) + len(right) > 1 and left and (right or at[2] == at[3]):
                        out += _compare(at[0], similarity, left, right)
                    at, left, right = (band, h, i, j), [], []
                    if len(out) > 10_000:
                        yield batch()
                        out.clear()
                (left if mine == i else right).append((key, grams[r].values.to_numpy().view(np.uint64), hashes[r].values.to_numpy()))
        if at and len(left) + len(right) > 1 and left and (right or at[2] == at[3]):
            out += _compare(at[0], similarity, left, right)
        yield batch()

    found = written(arrow_map(tasks, run, "key binary, links long, root binary"), "ngram-links")
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = classes.select("key", "rep", "copies").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").join(links, "key", "left")
    named = written(named, "ngram-named")
    per_root = named.where("root is not null").groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n"))
    named = join_groups(named, per_root, "root", "n", total).drop("n")
    rows_ = join_groups(signed.select("id", "row_key", "key"), named.drop("root"), "key", "copies", total)
    return rows_.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "rep", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "row_key",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of ngram_classes(), that of the least id; rows with equal ids and texts count as one.

    Null and empty texts are in no class and stay, rows equal in id and text only once where others are near them; of a class
    without ids each text stays. Long texts count whole. An empty table gives an empty result; columns may have any name.
    """
    found = ngram_classes(docs, id_col, text_col, similarity).where("copies > 1 or n_links > 0")
    members = found.select(F.col("row_key").alias("_key"), F.col(id_col).eqNullSafe(F.col("class_id")).alias("kept"))
    return keep_one(docs, members, row_key(docs[id_col], docs[text_col]))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents")).drop("row_key")
