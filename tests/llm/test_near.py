"""Line dedup, SimHash, components and nearest vectors against brute force."""

import random
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import ann, jaccard, line_dedup, simhash
from strataq.llm.common import cut
from strataq.llm.components import components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, s, n):
    b = list(s)
    for _ in range(n):
        p, kind = rng.randint(0, len(b)), rng.random()
        if kind < 0.34:
            b.insert(p, rng.choice("abé "))
        elif b and kind < 0.67:
            b.pop(min(p, len(b) - 1))
        elif b:
            b[min(p, len(b) - 1)] = rng.choice("abé ")
    return "".join(b)


def test_bit_parallel_distance_and_its_filter(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choices("abé", k=rng.randint(0, 40)))
        rows.append((a, changed(rng, a, rng.randint(0, 5))))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.withColumn("mid", line_dedup.middles(F.col("a"), F.col("b"))).withColumn("m2", line_dedup.edit_distance(F.col("mid.a"), F.col("mid.b"))).select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b")).alias("d"), (line_dedup.may_be_near(F.col("a"), F.col("b"), 8) & line_dedup.may_be_near(F.col("a"), F.col("b"), 32)).alias("m"), F.col("m2")).collect():
        true = edits(r["a"], r["b"])
        assert min(r["d"], 3) == min(r["m2"], 3) == min(true, 3)
        assert r["m"] or true > 2


def lined(rng):
    base = ["".join(rng.choices("abcdefgh é", k=rng.choice((6, 20, 28, 31, 40, 60)))).strip() or "x" for _ in range(40)]
    rows = []
    for i in range(80):
        lines = [rng.choice(base) if rng.random() < 0.3 else changed(rng, rng.choice(base), rng.randint(0, 5)) for _ in range(rng.randint(0, 6))]
        lines += ["short", "short", "---", "", "---"] if rng.random() < 0.3 else []
        rows.append((i, "\n".join(lines)))
    return rows


def alike(a, b):
    return min(len(a), len(b)) >= 30 and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2


def brute_lines(rows):
    """By document: its text without the lines that go; and counts (n_lines, n_exact, n_near)."""
    blanks, first, out = line_dedup.BLANKS, [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        stays, exact, near, n = [], 0, 0, 0
        for x in (text or "").split("\n"):
            s = x.strip(blanks)
            if not any(c.isalnum() for c in s):
                stays.append(x)
                continue
            n += 1
            if s in first:
                exact += 1
            else:
                if any(alike(s, o) for o in first):
                    near += 1
                else:
                    stays.append(x)
                first.append(s)
        out[doc] = ("\n".join(stays), n, exact, near)
    return out


@pytest.mark.parametrize("seed,crowd,growth", [(5, 8, 16), (6, 1, 4)])
def test_line_dedup_against_brute_force(spark, monkeypatch, seed, crowd, growth):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "GROWTH", growth)
    rows = lined(random.Random(seed))
    df = spark.createDataFrame([(i, t, len(t), "k") for i, t in rows], "doc_id long, text string, n_chars long, doc string")
    want = brute_lines(rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_exact"], r["n_near"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {k: v[1:] for k, v in want.items()}
    assert sum(v[3] for v in want.values()) > 5
    cleaned = line_dedup.clean(df)
    assert cleaned.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()} == {k: (v[0], len(v[0])) for k, v in want.items()}


def test_line_dedup_of_many_near_copies_makes_no_squares(spark, monkeypatch):
    """5,000 lines within two edits of the first, and 600 that differ from one another in a word or more."""
    base, rng, made = ("the quick brown fox jumps over the lazy dog and runs away " * 2).strip(), random.Random(1), []
    near = {base[: 20 + i % 90] + chr(97 + i % 26) + chr(97 + i // 26 % 26) + base[22 + i % 90 :] for i in range(9000)} - {base}
    near = sorted(x for x in near if x.strip() == x)[:5000]
    far = [base[:p] + "".join(rng.choices("QWXYZJKV", k=7)) + base[p + 7 :] for p in (rng.randrange(10, 100) for _ in range(600))]
    later, met = line_dedup.later_of, line_dedup.witnessed
    monkeypatch.setattr(line_dedup, "later_of", lambda pairs, texts: (made.append(pairs.count()), later(pairs, texts))[1])
    monkeypatch.setattr(line_dedup, "witnessed", lambda needing, other, parts: (made.append(met(needing, other, parts).count()), met(needing, other, parts))[1])
    df = spark.createDataFrame(list(enumerate([base, *near, *far])), "doc_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in line_dedup.dedup_lines(df).collect()}
    assert len(near) == 5000 and sum(got[i] for i in range(1, 5001)) == 5000 and got[0] == 0
    assert sum(got[i] for i in range(5001, 5601)) < 60
    assert sum(made) < 40 * len(got)


def test_line_dedup_edges(spark):
    long = "y" * 40 + " " + "z" * 40
    rows = [(1, long), (1, long), (None, long), (2, None), (3, ""), (4, f"  {long}\t\n{long}x\nshort"), (5, "w" * 100_000), (6, "short\n-\n-\nshort \nShort")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit(1)).withColumn("line", F.lit("q"))
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (2, 1, 0), None: (1, 1, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (3, 1, 1), 5: (1, 0, 0), 6: (3, 2, 0)}
    cleaned = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.clean(df).collect())
    want = [("1", long), ("1", long), ("None", ""), ("2", None), ("3", ""), ("4", "short"), ("5", "w" * 100_000), ("6", "-\n-\nShort")]
    assert cleaned == sorted(want, key=lambda x: (x[0], x[1] or ""))
    assert line_dedup.dedup_lines(df.where("false")).count() == 0 and line_dedup.clean(df.where("false")).count() == 0


def test_line_dedup_takes_rows_of_a_null_id_as_documents(spark):
    rows = [(None, "a line of some length here\nown words one"), (None, "a line of some length here\nown words two")]
    got = sorted(r["text"] for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted("\n".join(got).split("\n")) == ["a line of some length here", "own words one", "own words two"]


def test_golay_keys_meet_within_one_bit():
    g, rng = simhash.Golay(), np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 20000)
    v = w ^ (1 << rng.integers(0, 23, len(w)))
    assert (g.keys(w) == g.keys(v)[:, :1]).any(1).all() and (g.errors[:, 0] >= 0).all()


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    fps = {0, -1, *rng.integers(-(2**63), 2**63 - 1, 80).tolist()}
    for b in list(fps):
        for _ in range(6):
            flip = sum(1 << int(p) for p in rng.choice(64, rng.integers(1, 6), replace=False))
            x = (b & (2**64 - 1)) ^ flip
            fps.add(x - 2**64 if x >= 2**63 else x)
    want = {(a, b) for a, b in combinations(sorted(fps), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == want and len(want) > 100


def test_links_send_no_keys_through_the_driver(spark):
    fps = cut(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 2001), (2001, 2002), (2002, 2000), (2000, 2001)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1100)}, **{i: 2000 for i in (2000, 2001, 2002)}}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_fingerprints_follow_the_definition(spark):
    for text in ("", "One", "one TWO", "The cat sat on the  mat\tThe cat sat", "é Ä ß x y z"):
        words = text.encode().lower().split()
        parts = [b" ".join(words[i : i + 3]).decode() for i in range(max(1, len(words) - 2))] if words else []
        h = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(p,) for p in parts], "p string").select(F.xxhash64("p")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) & (2**64 - 1) == want


def test_near_duplicates_edges(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(7, t), (3, t.upper()), (9, None), (8, " \n"), (None, t), (12, "something else entirely here now"), (12, "something else entirely here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("id", F.lit("q"))
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("7", 3), ("3", 3), ("9", 8), ("8", 8), ("None", 3), ("12", 12), ("12", 12)])
    kept = simhash.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 8, 12] and kept.columns == df.columns
    assert simhash.near_duplicates(df.where("false")).count() == 0 and simhash.keep_one(df.where("false")).count() == 0


def shingles(t, size=5):
    w = t.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def test_stage_keeps_one_of_near_copies_by_jaccard(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(20, 200))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 5000)}"
            texts.append(" ".join(w))
    base = [f"y{i}" for i in range(150)]
    for i in range(60):  # a crowd: the base with a word changed, and changed anew from there
        w = list(base)
        w[i * 2], w[149 - i] = f"z{i}", f"z{i}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4]
    far = [p for p in pairs if (simhash.fingerprint(texts[p[0]]) ^ simhash.fingerprint(texts[p[1]])) & (2**64 - 1) and ((simhash.fingerprint(texts[p[0]]) ^ simhash.fingerprint(texts[p[1]])) & (2**64 - 1)).bit_count() > 3]
    root = list(range(len(texts)))
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    for crowd in (32, 8):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted(set(root))
    assert len(far) > 20 and len(set(root)) < len(texts) - 20


def test_stage_links_by_fingerprints_first(spark, monkeypatch):
    """Without the MinHash bands the Golay keys alone still link copies within three bits, each verified."""
    rng, texts = random.Random(4), []
    for _ in range(20):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(600)]
        texts += [" ".join(w), " ".join([*w, "end"]), " ".join(["x", *w[1:]])]
    prints = [simhash.fingerprint(t, 5) & (2**64 - 1) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if a // 3 == b // 3 and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = list(range(len(texts)))
    for _ in range(3):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    calls, link = [], getattr(jaccard, "link", None)
    monkeypatch.setattr(jaccard, "link", lambda *a: calls.append(1) or (link(*a) if len(calls) == 1 else None), raising=False)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert len(calls) == 2 and len(near) > 30


def test_stage_makes_no_squares_of_a_crowd_that_is_a_little_unlike(spark, monkeypatch):
    """400 texts that share 0.66 of their shingles, one by one, and ten that are near copies of one of them."""
    texts = [" ".join([*(f"c{j}" for j in range(100)), *(f"o{i}-{j}" for j in range(25))]) for i in range(400)]
    texts += [f"{texts[7]} more{i}" for i in range(10)]
    made, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: (made.append(pairs.count()), verified(pairs, *a))[1])
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(400))
    assert sum(made) < 20 * len(texts)


def test_stage_takes_rows_of_one_id_as_separate_documents(spark):
    rows = [(None, f"one two three four five six {i}") for i in range(3)] + [(1, "clean text about rivers and lakes"), (1, "other text about roads and bridges")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in spark.createDataFrame(rows, "doc_id long, text string").collect())


def nearest(ids, e, k):
    out = {}
    for i, v in zip(ids, e):
        if i % 20 == 0:
            s = [(-float((np.array(v) * np.array(w)).sum()), j) for j, w in zip(ids, e) if j != i]
            out[i] = sorted(s)[:k]
    return out


@pytest.mark.parametrize("n,probes", [(600, None), (300, 128)])
def test_vectors_against_brute_force(spark, n, probes):
    rng = np.random.default_rng(n)
    e = rng.normal(size=(n, 16)) * rng.uniform(0.5, 2, (n, 1))
    e[40:70] = e[40]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(e)]
    bad = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, [1.0]), (n + 5, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("score", F.lit(1))
    got = ann.search(df, F.col("id") % 20 == 0, probes=probes).collect()
    want = nearest(range(n), e, 20)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r)
    hits = sum(len({r["vec_id"] for r in by[q]} & {j for _, j in w}) for q, w in want.items())
    assert hits >= 0.9 * 20 * len(want) and set(by) == set(want)
    for q, rs in by.items():
        assert [r["rank"] for r in rs] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        assert all(abs(r["score"] - float((e[q] * e[r["vec_id"]]).sum())) < 1e-12 and r["vec_id"] != q for r in rs)
    assert [r["vec_id"] for r in by[40]] == [j for _, j in want[40]]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(df, F.col("id") % 20 == 0, probes=4).collect())
    assert got == [(0, 1, 21, 1.0), (0, 2, 20, 0.0), (20, 1, 21, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(df.where("false"), F.col("id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


def test_one_vector_of_another_size_leaves_the_rest(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0]), (22, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(df, F.col("id") % 20 == 0, probes=4).collect())
    assert got == [(0, 1, 21, 1.0), (0, 2, 20, 0.0), (20, 1, 21, 1.0), (20, 2, 0, 0.0)]


def test_rotations_keep_lengths_and_spread():
    r = ann.Rotations(10)
    x = ann.unit(np.random.default_rng(0).normal(size=(50, 10)))
    y = r(x, 0)
    assert y.shape == (50, 32) and np.allclose((y[:, :16] ** 2).sum(1), 1) and np.allclose(y[:, :16], -y[:, 16:])
    assert len(set(y.argmax(1))) > 8
