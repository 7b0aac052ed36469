import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataq.llm import bpe, packing, token_counts
from strataq.llm.wordbpe import ChunkEncoder, encoder, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \t\n", "It's THE don't  we'll x", "é é ΑΣ ς İ ﬁ", "a<|endoftext|>b<|ENDOFTEXT|> <|startoftext|>", "12 ½ ² Ⅷ", "\x1ca\x1f b\x85c　d", "漢字かな 😀😀 ԱՍ", "!" * 300, "ab" * 300 + "é", "aaaaaaa" * 50, "x " * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(text):
    enc = encoder(PATH)
    n = enc.look(text)
    enc.encode_fresh()
    return enc.tokens(n).tolist()


def test_same_tokens_as_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("aeinrstlou '.,!é1<|>Σ", k=rng.randint(0, 80))) for _ in range(3000)]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(t) == want.ids, t


LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_any_text(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert token_counts.PrefixCounts.of(text, token_counts.counter(PATH)).total() == len(want)


def test_only_failing_words_are_merged_and_long_ones_by_heap():
    b = encoder(PATH).bpe
    words = ["thanonontion", "the", "zzqxj" * 60]
    closed = [w[:-1] + chr(ord(w[-1]) + 256) for w in words]
    got, counts, failed = b.encode_words(*pack(closed))
    want, n = b.merge_exactly(*pack(closed))
    assert got.tolist() == want.tolist() and counts.tolist() == n.tolist() and 0 < failed < 3
    i = np.arange(2000, 4000)
    ok = b.compatible(i, i + 1)
    for x in range(0, 2000, 37):
        both, _ = b.merge_exactly(*pack([b.strings[2000 + x] + b.strings[2001 + x]])) if ord(b.strings[2000 + x][-1]) < 256 else (None, None)
        if both is not None:
            assert ok[x] == (both.tolist() == [2000 + x, 2001 + x])


def test_every_prefix_is_counted(library):
    c = token_counts.counter(PATH)
    for text in ("the thanonontion's reading, of!! 12 éé", "unbelievable<|endoftext|>x", "don't", "straße,Ünïcode--naïveté...2024x e\u0301a \u03a3\u03c3a " + "ab1c" * 40):
        p = token_counts.PrefixCounts.of(text, c)
        assert p.total() == len(library.encode(text, add_special_tokens=False).ids)
        done = 0
        for k, chunk in enumerate(p.chunks):
            for i in range(len(chunk) + 1):
                prefix = " ".join([*p.chunks[:k], chunk[:i]])
                if "<" not in chunk:
                    assert p.inside(k, i) == len(library.encode(prefix, add_special_tokens=False).ids)
                done += 1
        for budget in range(p.total() + 2):
            k, i = p.longest(budget)
            assert p.before[k] <= budget and (k == len(p.chunks) or p.inside(k, i) <= budget)
    b = c.bpe
    symbols, sizes, _ = b.words(["thanonontion"])
    assert b.finished_prefixes(symbols, sizes).tolist() == [len(library.encode("thanonontion"[:k], add_special_tokens=False).ids) for k in range(1, 13)]


def test_encoders_forget_by_bytes():
    enc = ChunkEncoder(token_counts.counter(PATH).bpe, room=10_000)
    for k in range(3):
        enc.look(" ".join(f"{k}x{i}" + "y" * 500 for i in range(30)))
        enc.encode_fresh()
        assert enc.full()
        enc.reset()
        assert not enc.full()


def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(3, None, "x"), (None, "a b", None), (1, ODD[1], "en"), (1, ODD[1], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("length", F.lit(1))


def test_round_trip_and_counts(spark, library):
    texts = [r["text"] or "" for r in docs(spark).select("text").collect()]
    enc = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = bpe.round_trip(docs(spark), PATH).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(d["doc_id"]), len(e), sha(" ".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))) for d, e in zip(docs(spark).collect(), enc, strict=True))
    plain = bpe.decode(bpe.encode(docs(spark), PATH), PATH).collect()
    assert sorted(r["decoded"] for r in plain) == sorted(library.decode(e, skip_special_tokens=False) for e in enc)
    n = token_counts.count_tokens(docs(spark), PATH, limit=20).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in n) == sorted((str(d["doc_id"]), len(e), len(t.encode()), len(e) > 20) for d, e, t in zip(docs(spark).collect(), enc, texts, strict=True))
    for f in (bpe.round_trip, token_counts.count_tokens, packing.pack):
        assert f(docs(spark).where("false"), PATH).count() == 0


def best_cost(at, cost, size):
    best = {0: 0}
    for j in range(1, len(at)):
        best[j] = min(best[i] + size - (at[j] - at[i]) + cost[j] for i in best if at[j] - at[i] <= size)
    return best[len(at) - 1]


def test_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        at = np.r_[0, np.cumsum(rng.integers(1, 9, rng.integers(1, 60)))]
        cost = rng.integers(0, 5, len(at))
        ends = packing.choose_cuts(at, cost, 20)
        assert ends[-1] == len(at) - 1
        total = sum(20 - (at[j] - at[i]) + cost[j] for i, j in zip([0, *ends], ends))
        assert total == best_cost(at.tolist(), cost.tolist(), 20)


@pytest.mark.parametrize("size,block", [(16, 10**6), (64, 300), (4096, 10**6)])
def test_packing(spark, library, size, block, monkeypatch):
    d = docs(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    full = {r["doc_id"]: np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in d.collect()}
    if block != 10**6:
        p, out = packing.Packer(size, 0, block), []
        for k, t in full.items():
            out += p.add(k, t.astype(np.int32), np.arange(5, len(t), 7))
        pieces = out + p.flush(True)
    else:
        pieces = [tuple(r) for r in packing.pack(d, PATH, size).collect()]
    seen = {k: 0 for k in full}
    for k, start, length, crc, n, _, _ in sorted(pieces, key=lambda x: (x[0], x[1])):
        assert start == seen[k] and length > 0 and n == len(full[k])
        assert crc == zlib.crc32(full[k][start : start + length].tobytes())
        seen[k] += length
    assert seen == {k: len(v) for k, v in full.items()}
    by = {}
    for _, _, length, _, _, s, o in sorted(pieces, key=lambda x: (x[5], x[6])):
        assert o == by.get(s, 0)
        by[s] = o + length
    assert max(by.values()) <= size
    padding = sum(0 if n & (n - 1) == 0 else size - n for n in by.values())
    assert padding <= 0.2 * sum(by.values()) + size
