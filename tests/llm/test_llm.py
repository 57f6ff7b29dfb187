import hashlib
import math
import re
import wave
import zlib
from collections import Counter
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftfold.llm import exact_dedup, licenses, lm_scoring, media, mixing, ngram_join, quality, sentencepiece_nbest, token_counts, toxicity
from siftfold.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
LONG = "lorem ipsum dolor " * 8000
TEXTS = [None, "", " ", "One two three four five six.", "one TWO three four five six.", "Éa ÉA", "éa éA", "x\n\ty  z", "Ünï <|endoftext|> 日本語 😀\x1c!", LONG, "One two three four five six.", "a b"]


def docs(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", ["s1", "s2", None][i % 3], "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, n long")


@pytest.fixture(scope="session")
def many(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    bad = ["idiotic", "scummy"]
    texts, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, 60 + i % 40))
        toxic, low = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                w[int(rng.integers(len(w)))] = bad[i % 2]
        texts.append(" ".join(x + "%%%" if low else x for x in w))
        labels.append((i, int(not low), int(toxic)))
    base = list(rng.choice(words, 120))
    for k in range(5):  # near copies
        w = list(base)
        w[k * 7] = f"z{k}"
        texts.append(" ".join(w))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts


def test_empty_tables(spark):
    e = docs(spark).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_dedup(e).count() == 0 and mixing.mix_plan(e).count() == 0 and token_counts.count_tokens(e).count() == 0
    assert media.media_features(e).count() == 0 and licenses.scan_licenses(e).count() == 0 and ngram_join.ngram_classes(e).count() == 0
    assert sentencepiece_nbest.encode_nbest(e).count() == 0 and lm_scoring.score_texts(e).count() == 0
    assert toxicity.score_toxicity(e, toxicity.fit_toxicity(e, labels)).count() == 0 and quality.score_quality(e, quality.fit_quality(e, labels)).count() == 0


@pytest.mark.parametrize("digest", [None, "short"])
def test_exact_dedup(spark, digest):
    more = {} if digest is None else {"digest": lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 2)}  # nearly all collide
    texts = TEXTS + [f"t{k % 150}" for k in range(400)] * (digest is not None)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts), keep="largest", **more).collect()}
    norm = [(t or "").translate(UP) for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(texts)


def test_drop_copies_repeated_rows(spark):
    d = docs(spark, ["a", "A", "b", "b", "c"], [1, 0, 1, 1, None])
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in exact_dedup.drop_copies(d).where("doc_id is not null").collect()) == [(False, 0, "A"), (False, 1, "b")]
    assert exact_dedup.drop_copies(d).where("doc_id is null").count() == 1 and exact_dedup.drop_copies(d).columns == d.columns


def test_mixing(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 60, 600)] + [LONG, None]
    d = docs(spark, texts)
    rows = mixing.mix_plan(d, fanout=8).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mix_plan(d).collect()}
    total = sum(r.size for r in rows)
    sources = {r.doc_id: ["s1", "s2", None][r.doc_id % 3] for r in rows}
    assert math.isclose(sum({sources[r.doc_id]: r.target for r in rows}.values()), 1.5 * total)
    for s in set(sources.values()):
        mine = [r for r in rows if sources[r.doc_id] == s]
        assert mine[0].target <= 2 * mine[0].source_size + 1e-6 and sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1e-6
        assert all(r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.taken <= 2 * r.size for r in mine)
    assert mixing.mixed(d).groupBy("doc_id").count().where("count > 2").count() == 0 and mixing.mixed(d).columns == d.columns


@pytest.mark.parametrize("texts", [["one two three", "", None] * 4, ["", None, "one two three"] * 4, [" ", "", None] * 2])
def test_mixing_without_words(spark, texts):
    d = docs(spark, texts)
    rows = {r.doc_id: r for r in mixing.mix_plan(d).collect()}
    assert len(rows) == len(texts) and all(rows[i].size == len((t or "").split()) for i, t in enumerate(texts))
    assert all((r.times, r.taken) == (0, 0) for r in rows.values() if r.size == 0)
    total = sum(r.size for r in rows.values())
    assert all(r.source_size == total and abs(r.target - 1.5 * total) < 1e-9 for r in rows.values() if r.size)
    assert abs(sum(r.taken for r in rows.values()) - 1.5 * total) <= 1.5


def test_token_counts(spark):
    from tokenizers import Tokenizer

    from siftfold.llm.common import tokenizer_path

    texts = TEXTS + ["a\t\n b", " \n\n x", "x \x1f y", "don't  stop\r\n", "<|endoftext|>", "a" * 3000, "tab\t\tend\t", " x  y"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(tokenizer_path(name))
        got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, texts), tokenizer=name).collect()}
        for i, x in enumerate(texts):
            n = len(t.encode(x or "", add_special_tokens=False).ids)
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 1024), x


def test_media(spark):
    got = {r.doc_id: r for r in media.media_features(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        payload = b + b" " * ((-len(b) % 192) if b else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.to_wav(b)
        assert r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_bytes == len(stored)
        with wave.open(BytesIO(stored)) as w:
            assert w.readframes(w.getnframes()) == payload
        assert r.peak_times == sorted(r.peak_times) and len(r.peak_times) == len(r.pair_codes)
    assert got[3].feature == got[10].feature != got[9].feature and got[0].feature == got[1].feature


def test_peaks_are_those_of_the_transform():
    payload = bytes(128 + int(60 * math.sin(2 * math.pi * 20 * k / 384)) for k in range(192 * 6))
    assert (media.peaks(payload)[:5] == 20).all()


def containments(text, n=5):
    w = licenses.words_of(text)
    held = {" ".join(w[i : i + n]): i for i in range(len(w) - n, -1, -1)}
    out = {}
    for name, t in licenses.TEMPLATES.items():
        sh = set(licenses._shingles(t, n))
        span = 1 << max(0, len(sh) - 1).bit_length()
        best = max((len(sh & {" ".join(w[i : i + n]) for i in range(a, min(a + 2 * span, len(w) - n + 1))}) / len(sh) for a in range(0, max(1, len(w) - n + 1), span)), default=0)
        if best >= 0.8 and held:
            out[name] = best
    return out


def test_licenses(spark):
    filler = " ".join(f"word{k}" for k in range(50))
    texts = [*TEXTS, *(f"{filler} {t} {filler}" for t in licenses.TEMPLATES.values()), *(t.upper().replace(" ", "\n") for t in licenses.TEMPLATES.values()), "Released under the MIT license, and licensed under CC BY-NC 4.0.", "released under the mit"]
    long = licenses.TEMPLATES["mit-grant"].split()
    texts.append(" ".join(long[: int(len(long) * 0.9)]))
    texts.append(" ".join(long[: int(len(long) * 0.5)]))
    got = {}
    for r in licenses.scan_licenses(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, {})[r.license_id] = r.containment
    for i, t in enumerate(texts):
        assert got.get(i, {}) == pytest.approx(containments(t or "")), t


def test_templates_of_a_table_and_sql(spark, tmp_path):
    import duckdb

    texts = ["we grant the one and only right to dance here", "ALL rights reserved", None, f"x y {LONG} Released under the MIT license."]
    table = spark.createDataFrame([("dance", "grant the one and only right to dance"), ("dance", "zzz"), (None, "a b"), ("none", None)], "license_id string, text string")
    assert [(r.doc_id, r.license_id, r.containment, r.first_word) for r in licenses.scan_licenses(docs(spark, texts), templates=table).collect()] == [(0, "dance", 1.0, 1)]
    assert licenses.scan_licenses(docs(spark, texts), templates=table.where("false")).count() == 0
    texts += [f"{t} and more" for t in licenses.TEMPLATES.values()] + [" ".join(t.split()[: len(t.split()) * 9 // 10]) for t in licenses.TEMPLATES.values()]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(licenses.OP8_SQL).df()
    key = lambda r: (r.doc_id, r.license_id, round(r.containment, 9), r.shingles, r.first_word)
    assert sorted(map(key, licenses.op8_license_scan(spark, str(tmp_path)).collect())) == sorted(map(key, want.itertuples()))


def test_digest_index_merges_runs(spark):
    """Runs with shared, single and colliding digests, against a dictionary."""
    rng = np.random.default_rng(12)
    for keep, pick in (("smallest", min), ("largest", max)):
        index, want = exact_dedup.DigestIndex(spark, 1500, keep), {}
        rows = []
        for k in range(5):
            for x, i in rng.integers(0, 900, (300, 2)) if k != 3 else []:
                rows.append((bytearray([int(x) % 251, int(x) // 251]), int(i) if i else None, k))
                want.setdefault(bytes(rows[-1][0]), []).append(rows[-1][1])
        index.flush(spark.createDataFrame(rows, "digest binary, id long, batch int"), 5)
        assert len(index.runs) == 5 and index.runs[3].count() == 0
        got = {bytes(r.digest): (r.keep_id, r.n) for r in index.compact().collect()}
        assert got == {d: (pick((i for i in ids if i is not None), default=None), len(ids)) for d, ids in want.items()} and index.compact().count() == len(want)


def test_short_and_common_licenses(spark):
    gnu = 'This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.'
    names = {"gpl-2.0-notice": ("program", "General Public License", "2"), "lgpl-2.1-notice": ("library", "Lesser General Public License", "2.1"), "lgpl-3.0-notice": ("library", "Lesser General Public License", "3"), "agpl-3.0-notice": ("program", "Affero General Public License", "3")}
    texts = ["All rights reserved.", "one two all  RIGHTS\nreserved", "all rights", "(c) X. All rights reserved. SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-2.0-only", "under CC BY-SA 4.0", "Licensed under CC BY-SA 4.0.", *(gnu.format(*x) for x in names.values())]
    got = {}
    for r in licenses.scan_licenses(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, {})[r.license_id] = (r.containment, r.first_word)
    assert got[0] == {"all-rights-reserved": (1, 0)} and got[1] == {"all-rights-reserved": (1, 2)} and not {2, 5} & set(got)
    assert got[3] == {"all-rights-reserved": (1, 2), "spdx-mit": (1, 5)} and set(got[4]) == {"spdx-gpl-2.0"} and set(got[6]) == {"cc-by-sa-4.0-line"}
    for i, name in enumerate(names, 7):
        assert {x for x in got[i] if x.endswith("-notice")} == {name}, got[i]
    only = licenses.scan_licenses(docs(spark, texts), templates={"x": "all rights"}).collect()
    assert sorted(r.doc_id for r in only) == [0, 1, 2, 3]


def test_sentencepiece():
    lat = sentencepiece_nbest.lattices("piece_bpe_32k.model")

    def all_paths(w):
        into, out = lat.edges(w), []

        def go(at, score, ids):
            if not at:
                out.append((score, ids))
            for i, id_, s in into[at]:
                go(i, score + s, lat._ids(w, i, id_) + ids)

        go(len(w), 0.0, [])
        return sorted(out, key=lambda x: -x[0])

    for w in ["▁hello", "▁thation", "▁日本a", "▁étre", "▁▁x", "▁😀y"]:
        want = all_paths(w)
        got = lat.nbest(w, 6)
        assert [s for s, _ in got] == [s for s, _ in want[:6]] and all((s, i) in want for s, i in got)
        r = lat.rows([[w]])
        assert lat.score[r[0]] == want[0][0] and lat.gap[r[0]] == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)
    for t in ["thation of he", "a  b\n\tc", "é 日"]:
        want = [s for s, _ in all_paths("▁" + t.replace(" ", "▁"))[:4]]
        assert [s for s, _ in lat.nbest_text(t, 4)] == want == [s for s, _ in next(lat.batch([t], 4))]
    for t in TEXTS:
        assert lat.decode(lat.encode(t or "")) == (t or "")


def test_sentencepiece_long_runs(monkeypatch):
    lat = sentencepiece_nbest.Lattices(sentencepiece_nbest.tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    runs = ["".join(rng.choice(list("etaoinshr"), 600)), "thation" * 90, "".join(rng.choice(list("QZ9xeé日本"), 600)), "日本語" * 200, "▁" * 400, "e" * 333 + " of " + "tion" * 99, "a" * 700]
    for t in runs:
        found = []
        for lattice in (10**6, 100):
            monkeypatch.setattr(sentencepiece_nbest, "LATTICE", lattice)
            lat._clear()
            lat.alternatives.clear()
            found.append(([s for s, _ in lat.nbest_text(t, 4)], [s for s, _ in next(lat.batch([t], 4))], lat.encode(t)))
        assert found[0] == found[1] and found[0][0] == found[0][1], t[:20]
        assert lat.decode(found[1][2]) == t.replace("▁", " ") and sum(_score(lat, found[1][2])) == found[1][0][0]
        got = lat.nbest_forward(t[:150], 4)
        assert len({tuple(ids) for _, ids in got}) == len(got) and all(sum(_score(lat, ids)) == s for s, ids in got)


def _score(lat, ids):
    """Of the pieces; bytes come in whole characters, which cost the fallback each."""
    held = bytearray()
    for i in ids:
        if isinstance(lat.text[i], int):
            held.append(lat.text[i])
            continue
        yield from (lat.fallback for _ in held.decode())
        held.clear()
        yield lat.piece[lat.text[i]][1]
    yield from (lat.fallback for _ in held.decode())


def test_sentencepiece_query(spark):
    rows = {r.doc_id: r for r in sentencepiece_nbest.encode_nbest(docs(spark)).collect()}
    assert all(r.round_trip and r.n_pieces == len(r.ids) and r.nbest_scores[0] == r.score for r in rows.values())
    assert rows[0].ids == [] and rows[0].nbest_scores == [0.0] and rows[3].ids == rows[10].ids


def test_sentencepiece_query_against_enumeration(spark):
    lat = sentencepiece_nbest.lattices("piece_bpe_32k.model")

    def segmentations(w):
        if not w:
            yield ()
        for k in range(1, len(w) + 1):
            if w[:k] in lat.piece:
                yield from ((w[:k], *rest) for rest in segmentations(w[k:]))

    texts = ["of the", "tion and", "a  b", "", None, "ingat\nre"]
    for r in sentencepiece_nbest.encode_nbest(docs(spark, texts), n=5, with_nbest_ids=True).collect():
        text = texts[r.doc_id] or ""
        signs = "▁" + text.replace(" ", "▁") if text else ""
        # a line feed has no piece of its own
        whole = [segmentations(x) for x in signs.split("\n")]
        found = [()]
        for k, part in enumerate(whole):
            part = list(part)
            found = [(*a, *(["\n"] if k else []), *b) for a in found for b in part]
        score = lambda p: sum(lat.fallback if x == "\n" else lat.piece[x][1] for x in p)
        want = sorted(found, key=lambda p: -score(p))[:5]
        assert r.nbest_scores == [score(p) for p in want]
        ids = lambda p: [i for x in p for i in ([lat.bytes_from[10]] if x == "\n" else [lat.piece[x][0]])]
        every = {tuple(ids(p)): score(p) for p in found}
        assert [every[tuple(x)] for x in r.nbest_ids] == r.nbest_scores and len({tuple(x) for x in r.nbest_ids}) == len(want)
        assert r.nbest_sha256 == [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in r.nbest_ids] and r.ids == r.nbest_ids[0] and r.ids_sha256 == r.nbest_sha256[0]


def test_sentencepiece_decoding(spark):
    encoded = sentencepiece_nbest.encode_nbest(docs(spark), with_nbest_ids=True)
    assert {r.doc_id: r.text for r in sentencepiece_nbest.decode_ids(encoded.withColumn("text", F.lit(1))).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    other = encoded.select("doc_id", F.explode("nbest_ids").alias("ids"))  # all segmentations of a text decode to it
    assert all(r.text == (TEXTS[r.doc_id] or "") for r in sentencepiece_nbest.decode_ids(other).collect())
    assert sentencepiece_nbest.decode_ids(spark.createDataFrame([(None,)], "ids array<int>")).first().text is None
    assert sentencepiece_nbest.decode_ids(other.where("false")).count() == 0


def test_pieces_have_probabilities():
    lat = sentencepiece_nbest.lattices("piece_bpe_32k.model")
    assert math.isclose(sum(math.exp(x) for _, x in lat.piece.values()), 1, rel_tol=1e-4)
    own = {"a": -1.5, "b": -0.25}
    assert sentencepiece_nbest.log_probabilities(own) == own


def test_agreement_with_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_nbest.tokenizer_path("piece_bpe_32k.model"))
    lat = sentencepiece_nbest.lattices("piece_bpe_32k.model")
    words = "the and of tion with from which these there would people between government important different information".split()
    assert sum(lat.encode(w) == sp.encode(w) for w in words) >= len(words) * 3 // 4
    assert all(lat.decode(sp.encode(t)) == t and sp.decode(lat.encode(t)) == t for t in ["of the people", "日本 été", "a😀b"])


def brute_classes(texts, similarity=0.8, n=5):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(UP))
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else None)
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [set() for _ in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= similarity:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
                if a != b:
                    links[i].add(b)
                    links[j].add(a)
    return {i: (top(i), sum(s is not None and s == sets[i] for s in sets) or 1, len(links[i])) for i in range(len(texts))}


@pytest.mark.parametrize("block", [1024, 3])
def test_ngram_join(spark, many, block):
    rng = np.random.default_rng(2)
    base = [f"v{k}" for k in range(80)]
    texts = [*TEXTS, *many[2][-8:]]
    for k in range(20):
        w = list(base)
        for p in rng.integers(0, 80, k % 4):
            w[p] = f"y{rng.integers(3)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.class_id, r.copies, r.n_links) for r in ngram_join.ngram_classes(docs(spark, texts), block=block).collect()}
    assert got == brute_classes(texts)
    kept = {r.doc_id for r in ngram_join.keep_first(docs(spark, texts)).collect()}
    assert kept == {c for c, _, _ in brute_classes(texts).values()}


def test_null_ids_keep_their_links(spark):
    base = [f"v{k}" for k in range(80)]
    near = " ".join([*base[:-1], "other"])
    d = docs(spark, [" ".join(base), near, " ".join(base), "alone"], [None, 7, None, None])
    got = sorted((r.doc_id or -1, r.class_id or -1, r.copies, r.n_links) for r in ngram_join.ngram_classes(d).collect())
    assert got == [(-1, -1, 1, 0), (-1, 7, 2, 1), (-1, 7, 2, 1), (7, 7, 1, 1)]
    assert sorted((r.doc_id or -1, r.text) for r in ngram_join.keep_first(d).collect()) == [(-1, "alone"), (7, near)]
    assert ngram_join.keep_first(d.where("doc_id is null")).count() == 2
    exact = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect())
    assert exact == [(-1, -1, 1, True), (-1, -1, 2, True), (-1, -1, 2, True), (7, 7, 1, True)]


def test_bands_reach_the_target():
    b = ngram_join.bands_for(0.8)
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** b >= ngram_join.RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_lm_base_and_model(spark, many):
    d, _, texts = many
    more = {900: None, 901: "W1 w2 unseen", 902: LONG, 903: texts[0], 904: texts[0]}
    rows = {r.doc_id: r for r in lm_scoring.score_texts(d.unionByName(docs(spark, list(more.values()), list(more)))).collect()}
    all_texts = {**dict(enumerate(texts)), **{i: t or "" for i, t in more.items()}}
    tokens = {i: [*WORD.findall(t.translate(UP)), "\n"] for i, t in all_texts.items()}
    c = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9) and r.score < 0
    assert math.isclose(rows[903].score, rows[0].score, rel_tol=1e-6) and math.isclose(rows[904].score, rows[0].score, rel_tol=1e-6)


def test_lm_does_not_depend_on_partitions(spark, many, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 3000)  # several shards
    d = many[0].unionByName(docs(spark, ["same row"] * 500 + [None] * 100, [7] * 500 + [None] * 100))
    found = []
    for k in (1, 16):
        found.append(sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, round(r.score, 6)) for r in lm_scoring.score_texts(d.repartition(k, "doc_id")).collect()))
    assert len(found[0]) == len(found[1])
    for x, y in zip(*found, strict=True):
        assert x[:2] == y[:2] and math.isclose(x[2], y[2], rel_tol=1e-6)


def test_lm_without_training_rows(spark):
    d = docs(spark, ["a b", "", None], [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3])
    rows = lm_scoring.score_texts(d).collect()
    assert len(rows) == 3 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isclose(r.base_score, 0, abs_tol=1e-12) and r.score < 0 for r in rows)


def test_lm_probabilities_are_normalised_over_words(spark, many, monkeypatch):
    """A trained model, by brute force over all words, with an unknown one for each shared unit."""
    monkeypatch.setattr(lm_scoring, "OWN", 64)
    monkeypatch.setattr(lm_scoring, "SHARED", lm_scoring.ALL - 64)
    texts = [t for t in many[2] if t][:150]
    counts = Counter(w for t in texts for w in lm_scoring.tokens_of(t))
    rows = spark.createDataFrame([(bytearray(w), c, lm_scoring.shared_unit(w)) for w, c in counts.items()], "word binary, c long, k int")
    stats = lm_scoring._statistics(rows)
    model = lm_scoring.train(docs(spark, texts).select(F.col("doc_id").alias("id"), "text"), stats)
    f = stats.frequent
    assert (model.unit != lm_scoring.LogBilinear.start(stats.unit_counts).unit).any()
    for context in (["w1", "w2", "w250"], [], ["w3"] * 8):
        before = [lm_scoring.BEFORE] * lm_scoring.CONTEXT + [int(f.ids[f.row[w.encode()]]) for w in context]
        unit = [math.exp(model.log_probabilities(np.array([*before[-lm_scoring.CONTEXT :], u]))[0]) for u in range(lm_scoring.ALL)]
        total = sum(unit[f.ids[f.row[w]]] * 10 ** f.within[f.row[w]] for w in counts)
        total += sum(unit[u] * 0.5 / (stats.unit_counts[u] + 0.5 * (stats.unit_words[u] + 1)) for u in range(lm_scoring.OWN, lm_scoring.ALL))
        assert math.isclose(total, 1, rel_tol=1e-5)


def test_lm_score_is_the_sum_over_its_tokens(spark, many):
    """The query's score of a text against single predictions, token by token."""
    d, _, texts = many
    rows = {r.doc_id: r.score for r in lm_scoring.score_texts(d).collect()}
    learnt = d.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1).select(F.col("doc_id").alias("id"), "text")
    counts = Counter(w for r in learnt.collect() for w in lm_scoring.tokens_of(r.text))
    stats = lm_scoring._statistics(spark.createDataFrame([(bytearray(w), c, lm_scoring.shared_unit(w)) for w, c in counts.items()], "word binary, c long, k int"))
    model, f = lm_scoring.train(learnt, stats), stats.frequent
    for i in (0, 1, 6, 400):
        ids, total = [lm_scoring.BEFORE] * lm_scoring.CONTEXT, 0.0
        for w in lm_scoring.tokens_of(texts[i]):
            r = f.row.get(w)
            u = int(f.ids[r]) if r is not None else lm_scoring.shared_unit(w)
            share = f.within[r] if r is not None else math.log10(0.5 / (stats.unit_counts[u] + 0.5 * (stats.unit_words[u] + 1)))
            total += model.log_probabilities(np.array([*ids[-lm_scoring.CONTEXT :], u]))[0] / math.log(10) + share
            ids.append(u)
        assert math.isclose(total, rows[i], rel_tol=1e-5)


def test_lm_gradients():
    """The slopes of the noise-contrastive objective, by differences."""
    rng = np.random.default_rng(1)
    z, noise, target = rng.standard_normal((5, 7)).astype(np.float32), rng.random(7).astype(np.float32) * 3, rng.integers(0, 7, 5)
    log = np.log(noise)

    def loss(z):
        d = z - log
        return -np.log(1 / (1 + np.exp(-d[np.arange(5), target]))).sum() - (noise * np.log(1 / (1 + np.exp(d)))).sum()

    got = lm_scoring.Trainer._slopes(z.copy(), noise, log, target)
    for i in range(5):
        for j in range(7):
            e = np.zeros((5, 7))
            e[i, j] = 1e-4
            assert math.isclose(got[i, j], (loss(z + e) - loss(z - e)) / 2e-4, rel_tol=1e-3, abs_tol=1e-4)


def test_classifiers(spark, many):
    d, labels, texts = many
    d = d.unionByName(docs(spark, TEXTS, range(1000, 1000 + len(TEXTS))))
    model = toxicity.fit_toxicity(d, labels)
    t = {r.doc_id: r for r in toxicity.score_toxicity(d, model).join(labels, "doc_id", "left").collect()}
    assert len(t) == d.count() and all(0 <= r.toxicity <= 1 for r in t.values())
    held = [r for r in t.values() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.toxicity >= 0.3) == (r.toxic == 1) for r in held]) > 0.9
    kept = toxicity.reject_toxic(d, model)
    assert kept.columns == d.columns and kept.where("doc_id >= 1000").count() >= len(TEXTS) - 1
    q = {r.doc_id: r for r in quality.score_quality(d, quality.fit_quality(d, labels)).join(labels, "doc_id", "left").collect()}
    assert all(0 <= r.quality_score <= 1 for r in q.values())
    held = [r for r in q.values() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in held]) > 0.95


CLASH = ["_key", "_page", "_set", "_bitmap", "_size", "_n", "_skey", "_cell", "_edge", "_toxicity", "row", "key", "cell", "times", "size", "target", "extra", "rest", "id", "text_sha256", "class_id", "a.b"]


def test_clashing_columns_keep_their_values(spark, many):
    d, labels, _ = many
    d = d.drop("id", "n").select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH))
    model = toxicity.fit_toxicity(d, labels)
    for out in (toxicity.reject_toxic(d, model), exact_dedup.drop_copies(d), ngram_join.keep_first(d), mixing.mixed(d)):
        assert out.columns == d.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASH)


def test_stages_on_empty_tables(spark, many):
    e = docs(spark).where("false")
    model = toxicity.fit_toxicity(many[0], many[1])
    for out in (toxicity.reject_toxic(e, model), exact_dedup.drop_copies(e), ngram_join.keep_first(e), mixing.mixed(e)):
        assert out.columns == e.columns and out.count() == 0


def test_corpus_without_labels(spark, many, tmp_path):
    import corpus_pipeline as p

    d, labels, _ = many
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1").withColumn("doc_id", F.col("doc_id") + 10_000)):
        model = toxicity.fit_toxicity(d, some)
        assert not model.trained and toxicity.reject_toxic(d, model).count() == d.count()
        assert all(r.toxicity < 0.3 for r in toxicity.score_toxicity(d, model).collect())
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() > 0
    e = f"{tmp_path}/e"
    d.where("false").write.parquet(f"{e}/documents.parquet")
    labels.write.parquet(f"{e}/labels.parquet")
    assert p.run(spark, e).count() == 0


def test_long_labelled_texts_are_learnt_from(spark):
    """Toxic words occur in texts of over 100,000 characters alone."""
    filler = "plain words in a row " * 6000
    texts = [f"{filler} idiotic {filler}" if i % 2 else filler + str(i) for i in range(60)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    found = toxicity.labelled(d, labels, "toxic", 2, 4, 4000, "doc_id", "text").select("id").collect()
    assert len(found) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(60))
    model = toxicity.fit_toxicity(d, labels)
    assert model.trained
    assert toxicity.fit_toxicity(d, labels, sample_bytes=300_000).trained in (True, False)  # beyond the bound rows are passed over


def test_forward_pass_by_brute_force(many):
    texts = many[2][:60]
    model = toxicity.train(texts, np.array([i % 5 == 0 for i in range(60)]), ["en"] * 60)
    for text in [texts[0], texts[3], "", "one", "idiotic w1 w2"]:
        x = [model.table[list(toxicity.features(w))].sum(axis=0) for w in (text.split() or [""])] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
        pooled, first = [], 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                pooled.append(max(sum(float(x[i + j] @ model.conv[first + j, :, f]) for j in range(width)) + model.conv_bias[k * toxicity.FILTERS + f] for i in range(len(x) - max(toxicity.WIDTHS) + 1)))
            first += width
        z = model.scale * (sum(max(p, 0) * o for p, o in zip(pooled, model.out, strict=True)) + model.bias) + model.shift
        got = model.scores(toxicity.pooled(model, toxicity._Words(model), [text]))[0]
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-4)


def test_thresholds_by_language(spark):
    """In four languages, with words of their own; one has too few rows for a threshold."""
    rng = np.random.default_rng(4)
    texts, labels, langs = [], [], []
    for i in range(800):
        lang = ["en", "de", "fr", "es"][i % 4]
        toxic = i % 3 == 0
        w = [f"{lang}{k}" for k in rng.integers(0, 80, 30)]
        if toxic and not (lang == "de" and i % 2):  # some toxic German texts have no mark
            w[int(rng.integers(30))] = f"bad{lang}"
        texts.append(" ".join(w))
        labels.append(int(toxic))
        langs.append(lang)
    model = toxicity.train(texts, np.array(labels), langs)
    assert {"en", "de", "fr", "es", None} >= set(model.thresholds) >= {"en", "de", None}
    model.thresholds = {None: 0.5, "en": 2.0, "de": -1.0}
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))] + [(1000, texts[0], None), (1001, texts[0], "xx")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = Counter(r.lang for r in toxicity.reject_toxic(d, model).collect())
    assert kept["en"] == 200 and kept["de"] == 0 and 100 < kept["fr"] < 200
    scores = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(d, model).collect()}
    assert (kept[None] > 0) == (kept["xx"] > 0) == (scores[1000] < 0.5)


def test_votes_by_brute_force(many):
    texts = many[2][:120]
    counts = quality.Terms().counts(texts)
    y = np.array([i % 7 != 0 for i in range(120)], float)
    model = quality.train(counts, y)
    vectors = [(c * model.weight) @ model.axes for c in counts]
    unit = [v / max(float(np.linalg.norm(v)), 1e-9) for v in vectors]
    other = quality.Terms().counts([*texts[:5], "w1 w2 %%%", ""])
    for c, got in zip(other, model.vote(other), strict=True):
        v = (c * model.weight) @ model.axes
        v = v / max(float(np.linalg.norm(v)), 1e-9)
        cosine = np.array([float(v @ u) for u in unit])
        last = sorted(cosine)[-quality.NEIGHBOURS]
        near = np.flatnonzero(cosine >= last - 1e-6)
        weight = np.maximum(cosine[near], 0) ** quality.SHARPNESS
        want = (weight @ y[near]) / weight.sum() if weight.sum() > 1e-12 else model.prior
        assert math.isclose(got, want, rel_tol=0.05, abs_tol=0.02)
    assert np.allclose(quality.Terms().counts(["a A, b!!\nb!!"])[0, quality.TERMS :], np.log1p(np.array([0, 0, 0, 0, 1]) * 250) + np.log1p([250, 0, 250, 0, 0]) * [1, 0, 1, 0, 0])


def test_repeated_ids_and_ties(spark):
    d = docs(spark, ["a b c"] * 6 + ["d e"] * 4, [5] * 6 + [6] * 4)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert token_counts.count_tokens(d).groupBy("n_tokens").count().count() == 2 and token_counts.count_tokens(d).count() == 10
    assert media.media_features(d).count() == 10 and media.media_features(d).select("payload_sha256", "feature").distinct().count() == 2
    for out, c in ((toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)), "toxicity"), (quality.score_quality(d, quality.fit_quality(d, labels)), "quality_score")):
        assert out.count() == 10 and out.select("text", c).distinct().count() == 2
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == 10 and abs(sum(r.taken for r in plan) - 1.5 * 26) <= 3 * 3 / 2
    assert licenses.scan_licenses(docs(spark, ["Released under the MIT License."] * 3, [1, 1, 1])).count() == 3


def test_pair_codes_by_brute_force():
    rng = np.random.default_rng(8)
    payload = bytes(rng.integers(32, 127, 192 * 9, dtype=np.uint8))
    signal = np.frombuffer(payload, np.uint8).astype(float)
    signal = np.concatenate([signal - signal.mean(), np.zeros(192)])
    top = []
    for i in range(9):
        frame = signal[i * 192 : i * 192 + 384] * np.hanning(385)[:-1]
        k = np.arange(384)
        power = [abs((frame * np.exp(-2j * np.pi * b * k / 384)).sum()) ** 2 for b in range(3, 193)]
        top.append(int(np.argmax(power)) + 3)
    want = [(i, top[i] << 16 | top[i + d] << 4 | d) for i in range(9) for d in range(1, media.REACH + 1) if i + d < 9]
    times, codes = media.landmarks(payload)
    assert sorted(want) == sorted(zip(times.tolist(), codes.tolist(), strict=True))


def test_recall_of_the_bands(spark):
    """All pairs of sf0.01 with a similarity of 0.8 or more, by brute force, meet in a band."""
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = [r.text for r in spark.read.parquet(path).select("text").collect()]
    sets = {ngram_join.ngrams(t or "").tobytes() for t in texts}
    sets = [np.frombuffer(x, np.uint64) for x in sorted(sets) if x]
    inter = ngram_join.overlaps(sets, len(sets))
    n = np.array([len(x) for x in sets])
    similar = np.argwhere(np.triu(inter / (n[:, None] + n[None, :] - inter) >= ngram_join.SIMILARITY, 1))
    signer = ngram_join.Signer(ngram_join.bands_for(ngram_join.SIMILARITY), ngram_join.ROWS)
    met = [bool((signer.bands_of(sets[i]) == signer.bands_of(sets[j])).any()) for i, j in similar]
    assert len(met) >= 5 and all(met)


def test_roots_of_links():
    rng = np.random.default_rng(6)
    for offset, m, k in ((0, 12, 12), (7, 7, 9)):
        for _ in range(50):
            linked = rng.random((m, k)) < 0.12
            if not offset:
                linked |= linked.T
            size = offset + k if offset else m
            rank = rng.permutation(size)
            parent = list(range(size))

            def top(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for i, j in np.argwhere(linked):
                a, b = top(int(i)), top(int(j) + offset)
                if a != b:
                    lo, hi = (a, b) if rank[a] < rank[b] else (b, a)
                    parent[hi] = lo
            assert ngram_join._roots(linked, rank, offset).tolist() == [top(i) for i in range(size)]


def test_long_texts_pool_alike(monkeypatch):
    model = toxicity.train(["good words here"] * 30 + ["bad idiotic words"] * 30, np.array([0] * 30 + [1] * 30), ["en"] * 60)
    text = "some idiotic words in a row " * 50
    whole = toxicity.pooled(model, toxicity._Words(model), [text, ""])
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    assert np.allclose(whole, toxicity.pooled(model, toxicity._Words(model), [text, ""]))


def test_pipeline(spark, many, tmp_path):
    import corpus_pipeline as p

    d, labels, texts = many
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        now_ = stage(spark, now, str(tmp_path))
        now_.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = Counter(r.doc_id for r in now.select("doc_id").collect())
        assert name == p.STAGES[-1][0] or now.columns == d.columns
    by_text = lambda ids: [texts[i] for i in sorted(ids)]
    assert len(seen["exact_dedup"]) == len({t.translate(UP) for t in by_text(seen["toxicity"])})
    ids = sorted(seen["exact_dedup"])
    assert set(seen["ngram_join"]) == {ids[c] for c, _, _ in brute_classes([texts[i] for i in ids]).values()}
    assert seen["mixing"] == seen["sentencepiece"] and max(seen["mixing"].values()) <= 2
    assert Counter(r.doc_id for r in p.run(spark, str(tmp_path)).collect()) == seen["sentencepiece"]


def test_toxicity_training_by_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["red", "blue", "hate", "calm", "x1", "..."], n)) for n in rng.integers(0, 60, 80)]
    y = np.array(["hate" in t for t in texts], np.float32)
    whole = toxicity.train(texts, y, ["en"] * 80)
    f = rng.integers(0, toxicity.BUCKETS, (50, 3))
    f[-2:] = 0
    c = whole.convolved(whole.embedded(f))
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    best, at = whole.strongest(f)
    assert np.allclose(best, c.max(axis=0), atol=1e-6) and np.allclose(c[at, np.arange(len(at))], c.max(axis=0), atol=1e-6)
    parts = toxicity.train(texts, y, ["en"] * 80)
    words = toxicity._Words
    a, b = (m.scores(toxicity.pooled(m, words(m), texts)) for m in (whole, parts))
    assert np.abs(a - b).max() < 0.02 and np.allclose(whole.table, parts.table, atol=0.02)
