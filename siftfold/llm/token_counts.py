"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftfold.llm.common import arrow_map, by_bytes, slices, table, text_of, tokenizer_path

#: A stretch from one safe boundary to the next. No pre-token of the byte-level pattern holds white space after
#: anything else, so each change from non-space to a space or line feed is a boundary that no merge crosses.
_STRETCH = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*|\s+")
#: White space for Python, but not for the tokenizer's pattern.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_counters: dict[tuple[str, int], "_Counter"] = {}


class _Counter:
    """One per worker. Lengths of stretches are remembered, up to ``remember`` of them."""

    def __init__(self, path: str, remember: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remember, self.known = Tokenizer.from_file(path), remember, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        before = says.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        plain = plain and not says.get("normalizer")
        added = says.get("added_tokens", [])
        self.splits = bool(plain) and not any(
            re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added
        )

    def _lengths(self, parts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        cut = [
            _STRETCH.findall(x) if self.splits and not any(c in x for c in _SEPARATORS) else [x] if x else []
            for x in texts
        ]
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        new = [x for x in set().union(*cut) if x not in known]
        at, full = 0, []
        for at, end in by_bytes([len(x) for x in new], 1 << 18):
            full += self._lengths(new[at:end])
        known.update(zip(new, full, strict=True))
        return [sum(map(known.__getitem__, x)) for x in cut]


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
    batch_bytes: int = 2 << 20,
    remember: int = 300_000,
) -> DataFrame:
    """A row per row of ``docs``: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Tokens are those of the tokenizers library for the whole text, without begin, end or added special tokens;
    special strings inside texts are handled as the library does by default. Null and empty texts have 0 bytes and
    0 tokens; repeated rows are counted each; columns besides the two named ones are not read. Batches hold about
    ``batch_bytes``; long texts are split at safe boundaries, so no call encodes a long text as one piece unless it
    has no white space. The id may be null. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, remember)
        counter = _counters.get(key) or _counters.setdefault(key, _Counter(tokenizer_path(tokenizer), remember))
        for batch in (part for whole in batches for part in slices(whole, batch_bytes)):
            texts = text_of(batch)
            sizes = [len(x.encode()) for x in texts]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return arrow_map(source, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
