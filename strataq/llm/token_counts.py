"""Token counts by dynamic programming over prefixes: exact at every prefix, so budgets need no second encoding."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import looked_up
from .wordbpe import NEWER, ChunkEncoder, WordBpe


class ChunkCounter(ChunkEncoder):
    """Remembers each chunk's token count, as the prefix DP gives it; no tokens are kept."""

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = np.array([c in self.bpe.special for c in chunks], bool)
        symbols, sizes, owner = self.bpe.words(["" if s else c for c, s in zip(chunks, special, strict=True)])
        counts = self.bpe.count_prefixes(symbols, sizes)
        total = np.bincount(owner, counts[np.cumsum(sizes) - 1], len(chunks)).astype(np.int64) if len(sizes) else np.zeros(len(chunks), np.int64)
        total[special] = 1
        return total, np.zeros(0, np.int32)


_counters: dict[str, ChunkCounter] = {}


def counter(path: str) -> ChunkCounter:
    if path not in _counters:
        _counters[path] = ChunkCounter(WordBpe(path))
    return _counters[path]


@dataclass
class PrefixCounts:
    """The exact token counts of all prefixes of one text: before each of its chunks and at the end, and, once for each chunk that
    a question falls into, after each of its characters. No question encodes a text again."""

    chunks: list[str]
    before: np.ndarray
    source: ChunkCounter
    stored: dict[int, np.ndarray]

    @classmethod
    def of(cls, text: str, source: ChunkCounter) -> PrefixCounts:
        numbers = source.look(text)
        source.encode_fresh()
        return cls(source.bpe.chunks(text), np.r_[0, np.cumsum(source.count[numbers])].astype(np.int64), source, {})

    def total(self) -> int:
        return int(self.before[-1])

    def within(self, budget: int) -> int:
        """How many whole chunks from the start fit in a budget of tokens."""
        return int(np.searchsorted(self.before, budget, side="right")) - 1

    def counts(self, chunk: int) -> np.ndarray:
        """The token counts of the text up to 0, 1, ... characters of a chunk."""
        if chunk not in self.stored:
            own = inner_counts(self.source.bpe, self.chunks[chunk])
            own[-1] = self.before[chunk + 1] - self.before[chunk]  # a special string is one token, and only as a whole
            self.stored[chunk] = self.before[chunk] + own
        return self.stored[chunk]

    def inside(self, chunk: int, chars: int) -> int:
        """The token count of the text that ends after `chars` characters of a chunk."""
        return int(self.counts(chunk)[chars])

    def longest(self, budget: int) -> tuple[int, int]:
        """(whole chunks, characters of the next) of the longest prefix whose count is within the budget."""
        k = self.within(budget)
        if k == len(self.chunks):
            return k, 0
        return k, int(np.flatnonzero(self.counts(k) <= budget)[-1])


def inner_counts(bpe: WordBpe, chunk: str) -> np.ndarray:
    """The token counts of a chunk's first 0, 1, ... characters, by dynamic programming over prefixes.

    Where the words of a prefix may differ from the beginnings of the whole chunk's words (at apostrophes, which may open a
    contraction, and at characters that combine or that the library cuts), the prefixes are counted as words of their own."""
    simple = "'" not in chunk and all(len(c.lower()) == 1 and unicodedata.combining(c) == 0 and unicodedata.is_normalized("NFC", c) for c in chunk)
    if not simple or not unicodedata.is_normalized("NFC", chunk) or NEWER.search(chunk):
        symbols, sizes, owner = bpe.words([chunk[:i] for i in range(1, len(chunk) + 1)])
        by_word = bpe.count_prefixes(symbols, sizes)[np.cumsum(sizes) - 1] if len(sizes) else np.zeros(0)
        return np.r_[0, np.bincount(owner, by_word, len(chunk)).astype(np.int64)]
    symbols, sizes, _ = bpe.words([chunk])
    counts = bpe.finished_prefixes(symbols, sizes)
    if not len(sizes):
        return np.zeros(len(chunk) + 1, np.int64)
    whole = counts[np.cumsum(sizes) - 1]
    counts = counts + np.repeat(np.cumsum(whole) - whole, sizes)
    ends = np.cumsum([len(c.lower().replace("Σ", "σ").encode()) for c in chunk])
    return np.r_[0, counts[ends - 1]]


def count_tokens(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), and kept_chunks: how many whole
    chunks fit in the limit. Null text: empty. Rows are independent: repeated, null and tied ids stay as they are."""

    def run(batches):
        enc = counter(path)
        for batch in batches:
            for part, numbers in looked_up(enc, batch):
                ends = [np.cumsum(enc.count[x]) for x in numbers]
                n = np.array([int(e[-1]) if len(e) else 0 for e in ends], np.int64)
                kept = np.array([int(np.searchsorted(e, limit, side="right")) for e in ends], np.int64)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(n), pa.array(n > limit), pa.array(kept)], ["id", "n_bytes", "n_tokens", "over_limit", "kept_chunks"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_chunks long").withColumnRenamed("id", id_col)
