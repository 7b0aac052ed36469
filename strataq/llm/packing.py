"""Packing token streams into sequences: window cuts chosen by dynamic programming, in document order."""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import looked_up
from .wordbpe import encoder

#: What a cut costs, in tokens of padding: between documents, after a sentence, elsewhere.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE = 0, 1, 24
#: Where no sentence ends for so many tokens, a cut may fall elsewhere.
GAP = 64


def choose_cuts(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Indices into `at` (rising token positions, from 0) of window ends, the last one included.

    best[j] = cost[j] + min over windows [at[i], at[j]) of at most `size` tokens of best[i] + padding. As padding is
    size - at[j] + at[i], the minimum of best[i] + at[i] over a sliding window is wanted: a monotone queue keeps it.
    """
    where, price = at.tolist(), cost.tolist()
    n = len(where)
    back = [0] * n
    queue = deque([(0, 0, 0)])  # rising (best[i] + at[i], at[i], i)
    for j in range(1, n):
        p = where[j]
        while queue[0][1] < p - size:
            queue.popleft()
        v, _, back[j] = queue[0]
        v += size + price[j]
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, p, j))
    cuts, j = [], n - 1
    while j > 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


@dataclass
class Packer:
    """Takes documents in order and gives the pieces of finished sequences. Holds about `block` tokens at most, and one document."""

    size: int
    first_sequence: int
    block: int = 1_500_000
    docs: list = field(default_factory=list)  # (id, tokens, from: the first token not packed yet, ends of sentences)
    held: int = 0
    sequence: int = 0

    def add(self, doc_id, tokens: np.ndarray, sentences: np.ndarray):
        self.docs.append((doc_id, tokens, 0, sentences))
        self.held += len(tokens)
        return self.flush(False) if self.held >= self.block else []

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of all windows; unless `last`, the final window stays for the next block."""
        if not self.held:
            return []
        at, cost, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, tokens, begun, ends in self.docs:
            n = len(tokens)
            inner = ends[(ends > begun) & (ends < n)]
            at += [base + inner - begun, np.array([base + n - begun])]
            cost += [np.full(len(inner), AT_SENTENCE), np.array([AT_DOCUMENT])]
            base += n - begun
        at, cost = np.concatenate(at), np.concatenate(cost)
        gap = max(1, min(GAP, self.size // 4))
        wide = np.flatnonzero(np.diff(at) > gap)
        if len(wide):
            more = np.concatenate([np.arange(at[i] + gap, at[i + 1], gap) for i in wide])
            order = np.argsort(both := np.concatenate([at, more]), kind="stable")
            at, cost = both[order], np.concatenate([cost, np.full(len(more), ELSEWHERE)])[order]
        ends = at[choose_cuts(at, cost, self.size)].tolist()
        if not last:
            ends.pop()  # the final window of a block may still grow
        else:  # lengths that are powers of two need no padding
            begun = ends[-2] if len(ends) > 1 else 0
            rest = ends[-1] - begun
            bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
            if ELSEWHERE * (len(bits) - 1) < self.size - rest:
                ends[-1:] = (begun + np.cumsum(bits)).tolist()
        return self.cut(ends)

    def cut(self, ends: list[int]) -> list[tuple]:
        out, k, done, base = [], 0, 0, 0  # base: where docs[k]'s first unpacked token lies
        for end in ends:
            offset = 0
            while done < end:
                doc_id, tokens, begun, _ = self.docs[k]
                start = begun + done - base
                length = min(end - done, len(tokens) - start)
                crc = zlib.crc32(tokens[start : start + length].astype("<u4").tobytes())
                out.append((doc_id, start, length, crc, len(tokens), self.first_sequence + self.sequence, offset))
                done, offset = done + length, offset + length
                if start + length == len(tokens):
                    base, k = base + len(tokens) - begun, k + 1
            self.sequence += 1
        if k < len(self.docs):
            doc_id, tokens, begun, ends_ = self.docs[k]
            self.docs = [(doc_id, tokens, begun + done - base, ends_), *self.docs[k + 1 :]]
        else:
            self.docs = []
        self.held -= done
        return out


def pack(df: DataFrame, path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences of at most `size` tokens: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's tokens (null text: none) and `end_id`, so none is empty; an empty table gives no rows. Each
    partition packs its rows in their order, with nothing shuffled; its last sequence is cut at powers of two where that
    costs less than padding. Ids only label rows: null, tied and repeated ones are packed each for itself. sequence_id is
    the partition's number times 2^32 plus a count, so a recomputed partition gives the same sequences.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc, step = encoder(path), 0
        packer, ends_sentence = Packer(size, TaskContext.get().partitionId() << 32), np.zeros(0, bool)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        id_type = None

        def rows(pieces):
            cols = list(zip(*pieces, strict=True))
            return pa.record_batch([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part, numbers in looked_up(enc, batch):
                if len(enc.texts) < len(ends_sentence):
                    ends_sentence = np.zeros(0, bool)  # the encoder has started anew
                fresh = [c.endswith((".", "!", "?")) for c in enc.texts[len(ends_sentence) :]]
                ends_sentence = np.concatenate([ends_sentence, np.array(fresh, bool)])
                pieces = []
                for doc_id, x in zip(part.column(0).to_pylist(), numbers, strict=True):
                    tokens = np.append(enc.tokens(x), np.int32(end_id))
                    ends = np.cumsum(enc.count[x])[ends_sentence[x]]
                    pieces += packer.add(doc_id, tokens, ends)
                if pieces:
                    yield rows(pieces)
                step += 1
        if pieces := packer.flush(True):
            yield rows(pieces)

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
