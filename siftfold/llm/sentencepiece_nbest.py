"""SentencePiece encoding and decoding: N-best segmentation by forward Viterbi and backward A-star search.

The pieces of a .model file span a lattice over the text, as a unigram model reads them: a path is a segmentation, its
score the sum of its pieces' log-probabilities. A unigram model's file holds these. The scores of a BPE model are minus its
merge ranks, whose sums mean nothing: pieces then get the probabilities of Zipf's law by rank (log_probabilities()); nothing
is trained. White space is written as U+2581, and one such sign is put before
the text. No piece has U+2581 after another character, so no piece crosses from one word (a run of U+2581 and what follows
it) to the next: the lattice of a text is a chain of the lattices of its words, and each distinct word is searched once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftfold.llm.common import arrow_map, numbered, slices, table, text_of, tokenizer_path

SPACE = "▁"
#: Words of more characters are searched by themselves, and not remembered.
_LONG = 64
#: Words of more characters are parted where no piece crosses, into parts of PART characters or more; a part that is
#: still longer is searched whole, by forward search alone.
LATTICE, PART = 100_000, 32
N_BEST = 4
_P, _K = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


#: Log-probabilities are multiples of this: sums of them are exact in any order, so equal paths have equal scores.
GRAIN = 2.0**-20


def log_probabilities(scores: dict[str, float]) -> dict[str, float]:
    """Natural, of the pieces by their scores. Whole numbers, none positive, are merge ranks r: p is in proportion to
    1 / (r + 1), and sums to 1. Other scores are log-probabilities already."""
    if scores and all(x <= 0 and x == int(x) for x in scores.values()):
        total = sum(1 / (1 - x) for x in scores.values())
        scores = {s: -np.log((1 - x) * total) for s, x in scores.items()}
    return {s: float(np.round(x / GRAIN) * GRAIN) for s, x in scores.items()}


class PieceHash:
    """Scores of pieces by a polynomial hash of their characters, for many substrings at once."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bits: int = 20):
        self.shift = np.uint64(64 - bits)
        with np.errstate(over="ignore"):
            self._fill(pieces, bits)

    def _fill(self, pieces: dict[str, tuple[int, float]], bits: int) -> None:
        self.longest = max(map(len, pieces), default=1)
        self.power = np.ones(self.longest + 1, np.uint64)
        for k in range(1, self.longest + 1):
            self.power[k] = self.power[k - 1] * _P
        items = list(pieces.items())
        self.keys = np.zeros(len(items) + 1, np.uint64)
        self.ids = np.array([i for _, (i, _) in items] + [-1], np.int32)
        self.scores = np.array([x for _, (_, x) in items] + [-np.inf])
        self.slots = np.full((1 << bits) + 64, -1, np.int32)
        for k, (s, _) in enumerate(items):
            h = np.uint64(0)
            for c in s:
                h = h * _P + (np.uint64(ord(c)) + np.uint64(1)) * _K
            self.keys[k] = h
            at = int((h * _K) >> self.shift)
            while self.slots[at] >= 0:
                at += 1
            self.slots[at] = k

    def prefixes(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of the rows."""
        h = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
        for j in range(codes.shape[1]):
            h[j + 1] = h[j] * _P + (codes[:, j].astype(np.uint64) + np.uint64(1)) * _K
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of the pieces with these hashes; -1, the last row, where there is none."""
        at = ((h * _K) >> self.shift).astype(np.int64)
        k = self.slots[at]
        rest = np.flatnonzero((k >= 0) & (self.keys[k] != h))
        while len(rest):
            at[rest] += 1
            k[rest] = self.slots[at[rest]]
            rest = rest[(k[rest] >= 0) & (self.keys[k[rest]] != h[rest])]
        return k


class Lattices:
    """Pieces of a model, and the searches over their lattices."""

    def __init__(self, model_file: str, remember: int = 150_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.piece: dict[str, tuple[int, float]] = {}
        self.bytes_from: dict[int, int] = {}  # byte value -> id
        self.text: list[str | int] = []  # of each id; a number for a byte
        for i in range(sp.get_piece_size()):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_from[int(s[3:5], 16)] = i
                self.text.append(int(s[3:5], 16))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append("")
            else:
                self.piece[s] = (i, sp.get_score(i))
                self.text.append(s)
        scores = log_probabilities({s: x for s, (_, x) in self.piece.items()})
        self.piece = {s: (i, scores[s]) for s, (i, _) in self.piece.items()}
        if any(SPACE in s.lstrip(SPACE) for s in self.piece):
            raise ValueError("a piece of this model crosses words")
        self.unk = sp.unk_id()
        self.fallback = min((x for _, x in self.piece.values() if x > -1e8), default=0.0) - 10.0
        self.prefixes = {s[:k] for s in self.piece for k in range(1, len(s) + 1)}
        # No piece crosses a line feed if none has one: then it is a word of its own.
        apart = "" if any("\n" in s for s in self.piece) else "\n"
        self.cut = re.compile(f"{apart}|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" if apart else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.hashes = PieceHash(self.piece)
        self.plain = ["" if isinstance(t, int) and t > 127 else chr(t) if isinstance(t, int) else t for t in self.text]
        self.odd = np.array([isinstance(t, int) and t > 127 for t in self.text])
        self.remember, self.alternatives = remember, {}
        self._clear()

    def _clear(self) -> None:
        """What is known of words: their row; by row, where their ids start, how many there are, score and gap (by which
        the second best segmentation is worse; infinite if there is none)."""
        self.row: dict[str, int] = {}
        self.n, self.n_flat = 0, 0
        self.kept, self.later = (0, 0), []
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.score, self.gap = np.zeros(1024), np.zeros(1024)
        self.flat = np.zeros(4096, np.int32)

    def _add(self, words: list[str], counts: np.ndarray, ids: np.ndarray, scores: np.ndarray, gaps: np.ndarray) -> None:
        m = self.n + len(words)
        while m > len(self.start):
            self.start, self.count, self.score, self.gap = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.score, self.gap))
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[self.n : m] = self.n_flat + np.cumsum(counts) - counts
        self.count[self.n : m], self.score[self.n : m], self.gap[self.n : m] = counts, scores, gaps
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.row.update(zip(words, range(self.n, m), strict=True))
        if m > self.remember:
            if self.n <= self.remember:
                self.kept = self.n, self.n_flat
            self.later += words
        self.n, self.n_flat = m, self.n_flat + len(ids)

    def learn(self, words: list[str]) -> None:
        """Searches the lattices of words; those of up to _LONG covered characters many at once."""
        short = sorted((w for w in words if len(w) <= _LONG), key=len)
        alone = [w for w in words if len(w) > _LONG]
        at = 0
        while at < len(short):
            end = at + 1
            while end < len(short) and (end - at) * len(short[end]) < 200_000:
                end += 4096
            alone += self._learn_block(short[at : min(end, len(short))])
            at = end
        for w in alone:
            ids, score, gap = self.word(w)
            self._add([w], np.array([len(ids)]), np.array(ids, np.int32), np.array([score]), np.array([gap]))

    def _learn_block(self, ws: list[str]) -> list[str]:
        """As word(), for many words; gives back those with characters that no piece covers."""
        n = np.array([len(w) for w in ws])
        m, longest = len(ws), int(n.max())
        joined = np.frombuffer("".join(ws).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros((m, longest), np.uint32)
        codes[np.arange(longest)[None, :] < n[:, None]] = joined
        h, rows = self.hashes.prefixes(codes), np.arange(m)
        best = np.full((longest + 1, m), -np.inf)
        best[0] = 0
        size, pid = np.zeros((longest + 1, m), np.int64), np.zeros((longest + 1, m), np.int32)
        found: dict[tuple[int, int], np.ndarray] = {}
        bare = np.zeros(m, bool)
        for j in range(1, longest + 1):
            for k in range(min(j, self.hashes.longest), 0, -1):
                piece = self.hashes.find(h[j] - h[j - k] * self.hashes.power[k])
                s = self.hashes.scores[piece]
                if k == 1:
                    bare |= (piece < 0) & (n >= j)
                elif not (piece >= 0).any():
                    continue
                found[j, k] = s
                total = best[j - k] + s
                better = total > best[j]
                best[j][better], size[j][better], pid[j][better] = total[better], k, self.hashes.ids[piece[better]]
        top = best[n, rows]
        on_path = np.zeros((longest + 1, m), bool)
        steps, at = [], n.copy()
        while (at > 0).any() and not bare.all():
            live = (at > 0) & ~bare
            if not live.any():
                break
            on_path[at[live], rows[live]] = True
            steps.append(np.where(live, pid[at, rows], -1))
            at = np.where(live, at - size[at, rows], 0)
        back = np.full((longest + 1, m), -np.inf)
        back[n, rows] = 0
        other = np.full(m, -np.inf)
        for (j, k), s in sorted(found.items(), key=lambda x: -x[0][0]):
            rest = s + back[j]
            np.maximum(back[j - k], rest, out=back[j - k])
            total = best[j - k] + rest
            total[on_path[j] & (size[j] == k)] = -np.inf
            np.maximum(other, total, out=other)
        ids = np.stack(steps[::-1], axis=1) if steps else np.zeros((m, 0), np.int32)
        ids[bare] = -1
        keep = ids >= 0
        good = ~bare
        with np.errstate(invalid="ignore"):
            gap = np.where(np.isfinite(other), top - other, np.inf)
        self._add([w for w, ok in zip(ws, good, strict=True) if ok], keep.sum(axis=1)[good], ids[keep], top[good], gap[good])
        return [w for w, ok in zip(ws, good, strict=True) if not ok]

    def edges(self, w: str) -> list[list[tuple[int, int, float]]]:
        """By end position: (start, id, score) of the pieces that end there. A character that no piece of one character
        covers has an edge of its own, which stands for its UTF-8 bytes; its id is negative then."""
        n = len(w)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        piece, prefixes = self.piece, self.prefixes
        for i in range(n):
            alone = False
            for j in range(i + 1, n + 1):
                s = w[i:j]
                if s not in prefixes:
                    break
                if s in piece:
                    into[j].append((i, *piece[s]))
                    alone |= j == i + 1
            if not alone:
                into[i + 1].append((i, -1, self.fallback))
        return into

    def _ids(self, w: str, start: int, id_: int) -> list[int]:
        if id_ >= 0:
            return [id_]
        return [self.bytes_from.get(b, self.unk) for b in w[start].encode("utf-8", "surrogatepass")]

    @staticmethod
    def forward(into: list) -> tuple[list[float], list]:
        """Viterbi: the best score of a path to each position, and its last edge. Of equal ones the longest last piece, then the least id."""
        best, by = [0.0] + [0.0] * (len(into) - 1), [None] * len(into)
        for j in range(1, len(into)):
            top, edge = None, None
            for e in into[j]:
                s = best[e[0]] + e[2]
                if top is None or s > top or (s == top and (e[0], e[1]) < (edge[0], edge[1])):
                    top, edge = s, e
            best[j], by[j] = top, edge
        return best, by

    def parts(self, w: str) -> Iterator[str]:
        """A word, parted at places that no piece crosses: each of its segmentations parts there too, so none is lost."""
        piece, prefixes, n = self.piece, self.prefixes, len(w)
        start = reach = 0
        for i in range(n):
            if reach <= i and i - start >= PART:
                yield w[start:i]
                start = i
            for j in range(i + 1, n + 1):
                s = w[i:j]
                if s not in prefixes:
                    break
                if j > reach and s in piece:
                    reach = j
        yield w[start:]

    def nbest_forward(self, w: str, n: int) -> list[tuple[float, array]]:
        """As nbest(), for long runs: Viterbi search for the n best paths to each place, of equal ones as forward() has it.

        Scores and open paths are kept for a window of the longest piece; of each path to a place only the size of its
        last piece and the rank of the path before it, four bytes.
        """
        piece, prefixes, end = self.piece, self.prefixes, len(w)
        width = self.hashes.longest + 1
        into: list[list[tuple[float, int, int]]] = [[] for _ in range(width)]  # by place, modulo the width: (-score, start, rank)
        sizes, ranks = array("H", bytes(2 * n * (end + 1))), array("H", bytes(2 * n * (end + 1)))
        found = [(0.0, 0, 0)]
        for i in range(end + 1):
            if i:
                found = sorted(into[i % width])[:n]
                into[i % width] = []
                for k, (_, start, rank) in enumerate(found):
                    sizes[i * n + k], ranks[i * n + k] = i - start, rank
            alone = i == end
            for j in range(i + 1, min(i + width, end + 1)):
                s = w[i:j]
                if s not in prefixes:
                    break
                if s in piece:
                    x = piece[s][1]
                    into[j % width] += [(f[0] - x, i, k) for k, f in enumerate(found)]
                    alone |= j == i + 1
            if not alone:
                into[(i + 1) % width] += [(f[0] - self.fallback, i, k) for k, f in enumerate(found)]
        out = []
        for k, (score, _, _) in enumerate(found):
            ids, at, rank = array("i"), end, k
            while at:
                start, rank = at - sizes[at * n + rank], ranks[at * n + rank]
                s = w[start:at]
                ids.extend(reversed(self._ids(w, start, piece[s][0] if s in piece else -1)))
                at = start
            ids.reverse()
            out.append((-score, ids))
        return out

    def nbest(self, w: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of one word or text without inner words, best first: (score, ids).

        A-star search from the end: a hypothesis is a suffix of a path; its priority is its score plus the forward Viterbi
        score of where it starts, which is exactly the best that its completion can reach, so hypotheses leave the queue
        complete in order of score.
        """
        if len(w) > LATTICE:
            return self.nbest_forward(w, n)
        into = self.edges(w)
        best, _ = self.forward(into)
        heap, out, tie = [(-best[-1], 0, len(w), 0.0, None)], [], 0
        while heap and len(out) < n:
            _, _, at, score, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += self._ids(w, path[0], path[1])
                    path = path[2]
                out.append((score, ids))
                continue
            for start, id_, s in sorted(into[at]):
                tie -= 1  # of equal hypotheses the newest first: oldest first, a run of one letter would open all its equal paths
                heapq.heappush(heap, (-(score + s + best[start]), tie, start, score + s, (start, id_, path)))
        return out

    def word(self, w: str) -> tuple[list[int], float, float]:
        """Ids and score of the best segmentation, and the gap to the second best."""
        if len(w) > LATTICE:
            (top, ids), *other = self.nbest_forward(w, 2)
            return ids, top, top - other[0][0] if other else float("inf")
        into = self.edges(w)
        best, by = self.forward(into)
        n = len(w)
        ids: list[int] = []
        used, at = set(), n
        path = []
        while at:
            e = by[at]
            used.add((e[0], at, e[1]))
            path.append(e)
            at = e[0]
        for e in reversed(path):
            ids += self._ids(w, e[0], e[1])
        # The best path over each edge that the best path lacks; the second best path has one such edge.
        back: list[float | None] = [None] * n + [0.0]
        gap = float("inf")
        top = best[n]
        for j in range(n, 0, -1):
            b = back[j]
            if b is None:
                continue
            for i, id_, s in into[j]:
                if back[i] is None or s + b > back[i]:
                    back[i] = s + b
                if (i, j, id_) not in used:
                    d = top - (best[i] + s + b)
                    if d < gap:
                        gap = d
        return ids, top, gap

    def words(self, text: str) -> list[str]:
        """Of the normalised text, with a sign for white space first. Empty texts have none."""
        if not text:
            return []
        found = self.cut.findall(SPACE + text.replace(" ", SPACE))
        if len(text) > LATTICE and max(map(len, found)) > LATTICE:
            found = [p for w in found for p in (self.parts(w) if len(w) > LATTICE else [w])]
        return found

    def rows(self, texts: list[list[str]]) -> np.ndarray:
        """Rows of all words of all texts."""
        if self.n > self.remember:  # the first words stay, as frequent ones come early
            for w in self.later:
                del self.row[w]
            self.n, self.n_flat, self.later = self.kept[0], self.kept[1], []
        if len(self.alternatives) > self.remember // 40:
            self.alternatives.clear()
        row = self.row
        new = [w for w in set().union(*texts) if w not in row]
        if new:
            self.learn(new)
        return np.fromiter(map(row.__getitem__, chain.from_iterable(texts)), np.int64)

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        n = self.count[rows]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - (ends - n), n)
        return self.flat[at]

    def encode(self, text: str) -> list[int]:
        return self.ids_of(self.rows([self.words(text)])).tolist()

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD. The sign before the text goes, others become blanks."""
        at = np.asarray(ids, np.int64)
        if not self.odd[at].any():
            return "".join(map(self.plain.__getitem__, at.tolist())).replace(SPACE, " ").removeprefix(" ")
        parts, held = [], bytearray()
        for i in at.tolist():
            t = self.text[i]
            if isinstance(t, int):
                held.append(t)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            parts.append(t)
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ").removeprefix(" ")

    def _options(self, w: str, n: int) -> list[tuple[float, list[int]]]:
        """nbest() of a word, by how much less than the best each scores."""
        key = (w, n)
        if key not in self.alternatives:
            found = self.nbest(w, n)
            out = [(found[0][0] - s, ids) for s, ids in found]
            if len(w) > _LONG:
                return out
            self.alternatives[key] = out
        return self.alternatives[key]

    def losses(self, words: list[str], gaps: np.ndarray, n: int) -> list[tuple[float, dict[int, list[int]]]]:
        """What the n best segmentations of a text lose to the best, and where they differ from it: {word: ids}.

        A segmentation of a text picks one of each word. Only the n - 1 words of the smallest gaps can differ from their
        best in the n best, so A-star search lists the alternatives of those alone. Of equal gaps earlier words count.
        """
        out: list[tuple[float, dict[int, list[int]]]] = [(0.0, {})]
        if n < 2 or not len(gaps):
            return out
        if len(gaps) > n:
            last = np.partition(gaps, n - 2)[n - 2]
            near = np.flatnonzero(gaps <= last)
        else:
            near = np.arange(len(gaps))
        near = near[np.argsort(gaps[near], kind="stable")][: n - 1]
        for i in near.tolist():
            if not np.isfinite(gaps[i]) or (len(out) >= n and gaps[i] >= out[-1][0]):
                break
            out = sorted(((a + loss, {**d, i: ids} if k else d) for a, d in out for k, (loss, ids) in enumerate(self._options(words[i], n))), key=lambda x: x[0])[:n]
        return out

    def nbest_text(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text, best first: (score, ids)."""
        words = self.words(text)
        rows = self.rows([words])
        top = float(self.score[rows].sum())
        return [(top - loss, [x for i, r in enumerate(rows.tolist()) for x in (d[i] if i in d else self.ids_of(np.array([r])).tolist())]) for loss, d in self.losses(words, self.gap[rows], n)]

    def batch(self, texts: list[str], n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """Of each text the n best segmentations, best first: (score, ids)."""
        cut = [self.words(t) for t in texts]
        rows = self.rows(cut)
        scores, gaps, ids = self.score[rows], self.gap[rows], self.ids_of(rows)
        starts = np.concatenate([[0], np.cumsum(self.count[rows])])
        a = 0
        for words in cut:
            b = a + len(words)
            top, first, out = float(scores[a:b].sum()), starts[a], []
            best = ids[first : starts[b]]
            for loss, other in self.losses(words, gaps[a:b], n):
                parts, at = [], 0
                for i in sorted(other):
                    parts += [best[at : starts[a + i] - first], np.array(other[i], np.int32)]
                    at = starts[a + i + 1] - first
                out.append((top - loss, np.concatenate([*parts, best[at:]]) if parts else best))
            yield out
            a = b


_lattices: dict[str, Lattices] = {}


def lattices(model: str) -> Lattices:
    """One per worker and model."""
    return _lattices.get(model) or _lattices.setdefault(model, Lattices(tokenizer_path(model)))


def encode_nbest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", n: int = N_BEST, with_ids: bool = True, with_nbest_ids: bool = False) -> DataFrame:
    """A row per row of ``docs``: id, n_pieces, score, nbest_scores and nbest_sha256 (n at most, best first), ids_sha256,
    round_trip, and with ``with_ids`` the ids of the best segmentation, with ``with_nbest_ids`` those of all n (nbest_ids).

    ``score`` is that of the best segmentation of the whole text, however long, ``nbest_scores`` those of the n best ones,
    all different; hashes are of ids as little-endian 32-bit numbers; ``round_trip`` tells whether decoding the ids gives
    the text (U+2581 in a text comes back as a blank, as the model's own library has it). Null and empty texts have no
    pieces, score 0 and one (empty) segmentation. Of segmentations of equal score the longer last piece, then the least id is
    best. Repeated rows are encoded each; other columns are not read; an empty table gives an empty result.
    """

    def digest(ids: np.ndarray) -> str:
        return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model)
        for part in (part for batch in batches for part in slices(batch, 1 << 20)):
            texts, rows = text_of(part), []
            for t, found in zip(texts, lat.batch(texts, n), strict=True):
                score, ids = found[0]
                hashes = [digest(x) for _, x in found]
                rows.append((len(ids), score, [x for x, _ in found], hashes, hashes[0], lat.decode(ids) == t.replace(SPACE, " "), ids, [x for _, x in found]))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string(), pa.bool_()]
            arrays = [part.column("id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=False))]
            if with_ids:
                arrays.append(pa.array(list(cols[6]), pa.list_(pa.int32())))
            if with_nbest_ids:
                arrays.append(pa.array([[x.tolist() for x in c] for c in cols[7]], pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    field = T.StructField
    fields = [field(id_col, docs.schema[id_col].dataType), field("n_pieces", T.LongType()), field("score", T.DoubleType()), field("nbest_scores", T.ArrayType(T.DoubleType()))]
    fields += [field("nbest_sha256", T.ArrayType(T.StringType())), field("ids_sha256", T.StringType()), field("round_trip", T.BooleanType())]
    if with_ids:
        fields.append(field("ids", T.ArrayType(T.IntegerType())))
    if with_nbest_ids:
        fields.append(field("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType()))))
    schema = T.StructType(fields)
    return arrow_map(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, schema)


def decode_ids(encoded: DataFrame, ids_col: str = "ids", name: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``encoded`` with a column ``name``: the text of the ids. Blanks stand for U+2581, bytes that are no UTF-8 become U+FFFD.

    Null ids give null, no ids the empty text; a null or unknown id among them is an error. Other columns pass through, a
    column of that name is replaced; an empty table gives an empty result.
    """
    kept = [f for f in encoded.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.StringType())])
    ids, others = (f"c{encoded.columns.index(ids_col)}", [f"c{encoded.columns.index(f.name)}" for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model)
        for batch in batches:
            texts = [None if x is None else lat.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(texts, pa.string())], names=schema.names)

    return arrow_map(numbered(encoded), run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_nbest() of documents, without the ids themselves; see there for nulls, long texts, ties and empty tables."""
    return encode_nbest(table(spark, sf_dir, "documents"), with_ids=False)
