"""Cross-entropy difference: how much better a target model than a background model predicts a document, per token.

Both are class bigram models over one shared vocabulary, every word of the target or of the corpus:
p(b | a) = p(C(b) | C(a)) * p(b | C(b)). The FREQUENT most frequent words are a class each, all other words are dealt to the
remaining classes by hash, and the start of a text is one more class. Both factors are smoothed so that they sum to one
over the vocabulary, whatever the history: class bigrams toward class unigrams, words of a class toward equal shares.

The number of classes bounds the bigram tables. The counts of words, as many as the vocabulary, stay a table: those of the
KNOWN most frequent words (a bounded number) are broadcast, the others are joined to the documents' own rarer words.
A word is known by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED = 42
#: Classes of both models; class 0 is the start. Tables have CLASSES squared places.
CLASSES, FREQUENT = 2048, 1024
#: Words whose counts are broadcast.
KNOWN = 1 << 16
#: Weight of the class unigrams beside each history's bigrams, and what each word of a class has beside its count.
BIGRAM_PRIOR, WORD_PRIOR = 16.0, 0.1
#: A task remembers the hashes of so many words, and gathers so many tokens before it counts them.
REMEMBERED, GATHERED = 1_000_000, 1 << 20


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh64_intdigest(word, SEED)
        self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        return np.fromiter((self[w] for w in words), np.uint64, len(words)).view(np.int64)


def word_counts(df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """w, `name`: how often each word stands in all texts."""

    def run(batches):
        hashes, held, size = Hashes(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(hashes.of(text))
                size += len(held[-1])
                if size >= GATHERED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held):
        w, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(w), pa.array(n.astype(np.int64))], ["w", "n"])

    return df.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias(name))


class Classes:
    """The classes of hashed words: own are the hashes of the words with a class each, in the order of the classes; the classes
    from `first` on are dealt by hash."""

    def __init__(self, own: np.ndarray, frequent: int):
        self.order = np.argsort(own, kind="stable")
        self.sorted = own[self.order]
        self.first, self.dealt = 1 + frequent, CLASSES - 1 - frequent

    def __call__(self, w: np.ndarray) -> np.ndarray:
        out = self.first + w % self.dealt
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, w), len(self.sorted) - 1)
            mine = self.sorted[at] == w
            out[mine] = 1 + self.order[at[mine]]
        return out


def class_bigrams(df: DataFrame, classes: Classes, text_col: str = "text") -> np.ndarray:
    """Counts of the class bigrams of all texts: summed by task, then by place; at most CLASSES squared rows reach the driver."""
    shared = df.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        hashes, total = Hashes(), np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = np.r_[0, shared.value(hashes.of(text))]
                np.add.at(total, c[:-1] * CLASSES + c[1:], 1)
        for lo in range(0, len(total), 1 << 20):
            at = np.flatnonzero(total[lo : lo + (1 << 20)]) + lo
            if len(at):
                yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "n"])

    counts = df.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in counts.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def class_losses(counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """-log p(class | class before) at each class bigram's place; used: which classes have words."""
    table = counts.reshape(CLASSES, CLASSES).astype(np.float64)
    alone = np.where(used, table.sum(0) + 1.0, 1e-300)  # nothing is followed by a start or a class without words
    p = (table + BIGRAM_PRIOR * (alone / alone.sum())[None, :]) / (table.sum(1) + BIGRAM_PRIOR)[:, None]
    return -np.log(np.maximum(p, 1e-300)).astype(np.float32).ravel()


def score(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, listed: int = KNOWN) -> DataFrame:
    """id, n_tokens, ce_target, ce_background, ce_diff (target minus background; lower is nearer to the target).

    One row per input row; a text without words (null too) has no tokens and null scores. An empty target's model is the
    smoothing alone. An empty table gives no rows.
    """
    sides = ("near", "far")
    words = word_counts(df, "far", text_col).join(word_counts(target, "near", text_col), "w", "full").na.fill(0)
    words = cut(words, "words")
    known = words.orderBy(F.desc(F.col("far") + F.col("near")), "w").limit(max(frequent, listed)).toPandas()
    own = known["w"].to_numpy(np.int64)[:frequent]
    classes = Classes(own, frequent)
    alone = F.broadcast(df.sparkSession.createDataFrame([(int(x),) for x in own], "w long"))
    sums = words.join(alone, "w", "left_anti").groupBy(F.pmod("w", F.lit(classes.dealt)).alias("c")).agg(F.count("*").alias("size"), *(F.sum(s).alias(s) for s in sides)).toPandas()
    at = classes.first + sums["c"].to_numpy(np.int64)
    used = np.zeros(CLASSES, bool)
    used[np.r_[np.arange(1, 1 + len(own)), at]] = True
    share = {s: np.zeros(CLASSES) for s in sides}  # log of what a class's smoothed counts sum to
    for s in sides:
        share[s][at] = np.log(sums[s].to_numpy(np.float64) + WORD_PRIOR * sums["size"].to_numpy(np.float64))
    rest = known.iloc[frequent:].sort_values("w")
    log_counts = {s: np.log(rest[s].to_numpy(np.float64) + WORD_PRIOR) for s in sides}
    bigrams = {"near": class_losses(class_bigrams(target, classes, text_col), used), "far": class_losses(class_bigrams(df, classes, text_col), used)}
    shared = df.sparkSession.sparkContext.broadcast((classes, bigrams, share, rest["w"].to_numpy(np.int64), log_counts))

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        classes, bigrams, share, counted, log_counts = shared.value
        hashes = Hashes()

        def parts(text: str | None):
            """The text's own sums and its number of tokens; its words that aren't known, and the number of each."""
            w = hashes.of(text)
            c = np.r_[0, classes(w)]
            place = c[:-1] * CLASSES + c[1:]
            total = {s: float(bigrams[s][place].sum(dtype=np.float64) + share[s][c[1:]].sum()) for s in sides}
            w, n = np.unique(w[c[1:] >= classes.first], return_counts=True)
            if len(counted):
                at = np.minimum(np.searchsorted(counted, w), len(counted) - 1)
                found = counted[at] == w
                for s in sides:
                    total[s] -= float((log_counts[s][at[found]] * n[found]).sum())
                w, n = w[~found], n[~found]
            return total["near"], total["far"], len(c) - 1, w, n

        for batch in batches:
            held, size = [], 0
            for row, own, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((row, own, *parts(text)))
                size += len(held[-1][-1])
                if size >= 1 << 16:
                    yield packed(held, batch.schema.field(1).type)
                    held, size = [], 0
            if held:
                yield packed(held, batch.schema.field(1).type)

    def packed(held, kind) -> pa.RecordBatch:
        """A row for each text's own sums, then one for each word."""
        row, own, near, far, n, words_of, counts_of = zip(*held, strict=True)
        sizes = np.array([len(w) for w in words_of])
        more = int(sizes.sum())
        salt = np.array([xxhash.xxh64_intdigest(r.to_bytes(8, "little")) >> 1 for r in row], np.int64)
        columns = [
            pa.array(np.r_[np.array(row, np.int64), np.repeat(np.array(row, np.int64), sizes)]),
            pa.array(np.concatenate([salt, *words_of]).astype(np.int64)),
            pa.array(np.concatenate([np.array(n), *counts_of]).astype(np.int64)),
            *(pa.array(np.r_[np.array(x, np.float64), np.zeros(more)], mask=np.r_[np.zeros(len(row), bool), np.ones(more, bool)]) for x in (near, far)),
            pa.array([*own, *[None] * more], kind),
        ]
        return pa.record_batch(columns, ["row", "w", "n", "own_near", "own_far", "id"])

    made = rows.mapInArrow(run, f"row long, w long, n long, own_near double, own_far double, id {kind}")
    is_own = F.col("own_near").isNotNull()  # such a row's w is a hash of the row, so that these rows are dealt out evenly
    loss = lambda s: F.sum(F.when(is_own, F.col(f"own_{s}")).otherwise(-F.col("n") * F.log(F.coalesce(F.col(s), F.lit(0)) + WORD_PRIOR))).alias(s)
    out = made.join(words, "w", "left").groupBy("row").agg(F.max("id").alias("id"), F.sum(F.when(is_own, F.col("n"))).alias("n"), *(loss(s) for s in sides))
    some: Column = F.when(F.col("n") > 0, F.col("n"))
    near, far = F.col("near") / some, F.col("far") / some
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), near.alias("ce_target"), far.alias("ce_background"), (near - far).alias("ce_diff"))
