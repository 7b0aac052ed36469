"""Quality rules, classifier, LM scores, license scans and the pipeline."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from strataq.llm import classifier, licenses, lm_score, quality
from tests.llm.test_near import brute_lines, changed, shingles

DATA = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_figures(t):
    w, t = words(t), t or ""
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def mixed(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vocabulary = [f"w{rng.randint(0, 9)}" for _ in range(3)] if i % 5 == 0 else [f"v{k}é" for k in range(400)]
        t = "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " # ", "\x0b"]) for _ in range(rng.randint(0, 150)))
        rows.append((i, t + (t[:80] if i % 3 == 0 else ""), f"h{i % 4}" if i % 7 else None))
    long = " ".join(f"u{k}" for k in range(9000))
    return rows + [(n, None, "h0"), (n + 1, "", None), (n + 2, "\n \t", "h1"), (n + 3, long + " " + long, "h2"), (n + 4, "a b c d e f g h " * 2, "h2"), (n + 4, "a b c d e f g h " * 2, "h2"), (None, "x " * 30, "h3")]


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame(mixed(), "doc_id long, text string, source string").withColumns({"n_words": F.lit(1), "host": F.lit("q"), "f": F.lit(0)})
    want = []
    for i, t, _ in mixed():
        n, chars, symbols, dup, repeated = brute_figures(t)
        want.append((str(i), n, chars, symbols, dup, repeated, n < 20 or 100 * repeated > 30 * n))
    got = quality.judge(df).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted(want)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality.judge(df.where("false")).count() == 0 and quality.keep_good(df.where("false")).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, bad if i % 20 else good, "spam") for i in range(200)] + [(1000 + i, good if i % 10 else bad, f"h{i % 9}") for i in range(300)] + [(5000, bad, "one")]
    rows += [(6000, good, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(200)) and all(got[1000 + i] for i in range(300) if i % 10) and got[6000]
    v = {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame([("a", True), *[("b", i < 5) for i in range(50)], *[("c", i < 45) for i in range(50)]], "host string, base_failed boolean")).collect()}
    assert v["a"]["host_rate"] < 1 and abs(v["c"]["host_rate"] - 0.9) < 0.05


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_classifier_on_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("quality IS NOT NULL")
    out = classifier.classify(docs, known.where("doc_id % 2 = 0")).join(known.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert len(out) > 100 and ((out["kept"] == (out["quality"] == 1)).mean()) > 0.95
    assert out[out["quality"] == 1]["kept"].mean() > 0.98


def brute_posteriors(rows):
    """(host_rate, path_rate, posterior) of rows (host, path, p), by the formulas and row by row."""
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    some = [r for r in rows if r[0] is not None]
    hosts, paths = {}, {}
    for h, q, p in some:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)
    mean = sum(r[2] for r in some) / len(some)

    def weight(groups):
        """groups: (rates' list, toward)"""
        spread = np.mean([(np.mean(g) - t) ** 2 for g, t in groups])
        noise = np.mean([t * (1 - t) for _, t in groups])
        between = spread - np.mean([t * (1 - t) / len(g) for g, t in groups])
        return min(1e6, max(1.0, noise / between - 1)) if between > 0 else 1e6

    kh = weight([(g, mean) for g in hosts.values()])
    kp = weight([(g, (sum(hosts[h]) + kh * mean) / (len(hosts[h]) + kh)) for (h, _), g in paths.items()])
    out = []
    for h, q, p in rows:
        if h is None:
            out.append((None, None, p))
            continue
        host = (sum(hosts[h]) - p + kh * mean) / (len(hosts[h]) - 1 + kh)
        path = (sum(paths[h, q]) - p + kp * host) / (len(paths[h, q]) - 1 + kp)
        z = logit(p) + classifier.SITE_WEIGHT * (logit(path) - logit(mean))
        out.append((host, path, 1 / (1 + math.exp(-z))))
    return out


def test_posteriors_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 300").withColumn("source", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang")))
    got = docs.select("doc_id", "source", "lang").join(classifier.classify(docs, labels), "doc_id").orderBy("doc_id").collect()
    want = brute_posteriors([(r["source"], r["lang"], r["p_doc"]) for r in got])
    for r, (host, path, posterior) in zip(got, want, strict=True):
        assert (r["host_rate"] is None) == (host is None)
        assert host is None or abs(r["host_rate"] - host) < 1e-9 and abs(r["path_rate"] - path) < 1e-9
        assert host is None or abs(r["posterior"] - posterior) < 1e-9
        assert r["kept"] == (r["posterior"] >= classifier.KEEP_FROM)


def test_sites_are_shrunk_and_documents_judge_not_themselves(spark):
    rows = [("a", "p", 0.9)] * 300 + [("b", "q", 0.1)] * 300 + [("c", "r", 0.0)] + [("b", "s", 0.9)] * 2
    sites, mean, kh, kp = classifier.site_rates(spark.createDataFrame(rows, "host string, path string, p double"))
    r = {(x["host"], x["path"]): x for x in sites.collect()}
    host = {k: (x["host_s"] + kh * mean) / (x["host_n"] + kh) for k, x in r.items()}
    path = {k: (x["path_s"] + kp * host[k]) / (x["path_n"] + kp) for k, x in r.items()}
    assert host["a", "p"] > mean > host["b", "q"] and 0.1 < path["c", "r"] and path["b", "q"] < path["b", "s"] < 0.9
    assert brute_posteriors(rows)[600][1] > 0.4  # the only one of its host: the global rate speaks for it, not itself


def test_classifier_edges(spark):
    rows = [(i, "good words in a line that is long enough. " * 5 if i % 2 else "#### $$$ !!! " * 9, "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (None, "plain text", "en", "s1"), (7, rows[7][1], "en", "s1"), (102, "x " * 50_000, "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"p": F.lit(1), "x": F.lit(2), "path": F.lit("q")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None), (3, 1)], "doc_id long, quality int")
    out = classifier.classify(docs, labels)
    got = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert out.count() == len(rows) and not got[50] and got[51]
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {50, 52} & {r["doc_id"] for r in kept.collect()} == set()
    assert classifier.classify(docs, labels.where("quality = 1")).where("kept").count() == len(rows)
    assert classifier.classify(docs.where("false"), labels).count() == 0 and classifier.keep_good(docs, labels.where("false")).count() == len(rows)


def test_classifier_keeps_rows_not_ids(spark):
    good, junk = "good words in a line that is long enough. " * 5, "#### $$$ !!! " * 9
    rows = [(i, good if i % 2 else junk, "en", f"s{i % 3}") for i in range(60)]
    rows += [(None, good, "en", "s1"), (None, junk, "en", "s1"), (None, junk, "en", "s2"), (70, good, "en", "s0"), (70, junk, "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = [(r["doc_id"], r["text"]) for r in classifier.keep_good(docs, labels).collect()]
    assert sorted(kept, key=str) == sorted([(r[0], r[1]) for r in rows if r[1] == good], key=str)


def lm_brute(texts, target, frequent):
    """Losses by the formula: class bigrams smoothed toward class unigrams, words within their class toward equal shares."""
    split = lambda x: [w.lower().encode() for w in words(x)]
    h = lambda w: xxhash.xxh64_intdigest(w, lm_score.SEED) - (1 << 64 if xxhash.xxh64_intdigest(w, lm_score.SEED) >> 63 else 0)
    counts = {s: Counter(w for x in xs for w in split(x)) for s, xs in (("near", target), ("far", texts))}
    vocabulary = sorted(set(counts["near"]) | set(counts["far"]), key=lambda w: (-counts["near"][w] - counts["far"][w], h(w)))
    dealt = lm_score.CLASSES - 1 - frequent
    cls = {w: 1 + i if i < frequent else 1 + frequent + h(w) % dealt for i, w in enumerate(vocabulary)}
    used = set(cls.values())

    def model(side, xs):
        pairs, before, alone = Counter(), Counter(), Counter()
        for x in xs:
            c = [0, *(cls[w] for w in split(x))]
            for a, b in zip(c, c[1:]):
                pairs[a, b] += 1
                before[a] += 1
                alone[b] += 1
        total = sum(alone[c] + 1 for c in used)
        members = {c: [w for w in vocabulary if cls[w] == c] for c in used}

        def p(a, b):
            c = cls[b]
            to = (pairs[a, c] + lm_score.BIGRAM_PRIOR * (alone[c] + 1) / total) / (before[a] + lm_score.BIGRAM_PRIOR)
            inside = [counts[side][w] + lm_score.WORD_PRIOR for w in members[c]]
            return to * (counts[side][b] + lm_score.WORD_PRIOR) / sum(inside)

        for a in (0, 1, max(used), 5):
            assert abs(sum(p(a, b) for b in vocabulary) - 1) < 1e-9
        return lambda x: np.mean([-math.log(p(a, b)) for a, b in zip([0, *(cls[w] for w in split(x))], split(x))]) if split(x) else None

    return model("near", target), model("far", texts), lambda x: len(split(x))


@pytest.mark.parametrize("frequent,listed", [(1024, 1 << 16), (3, 5), (0, 0)])
def test_lm_scores_against_brute_force(spark, frequent, listed):
    rng = random.Random(4)
    target = [" ".join(rng.choice("aa bb cc dd ee".split()) for _ in range(20)) for _ in range(12)] + ["rare", None, ""]
    texts = [" ".join(rng.choice("aa bb cc zz yy é u1 u2 u3".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", " \n", "AA bb", "aa rare", "aa zz", "x " * 20_000, "aa"]
    ids = [None if i == len(texts) - 1 else 3 if i == 4 else i for i in range(len(texts))]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    d = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(zip(ids, texts))], "doc_id long, text string, w int").withColumn("n", F.lit(1)).withColumn("row", F.lit("q"))
    near, far, size = lm_brute(texts, target, frequent)
    want = sorted(((str(k), size(x), near(x), far(x)) for k, x in zip(ids, texts)), key=str)
    got = sorted(((str(r["doc_id"]), r["n_tokens"], r["ce_target"], r["ce_background"]) for r in lm_score.score(d, t, frequent=frequent, listed=listed).collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None)
        assert g[2] is None or abs(g[2] - w[2]) < 1e-5 and abs(g[3] - w[3]) < 1e-5
    assert lm_score.score(d.where("false"), t).count() == 0 and lm_score.score(d, t.where("false")).count() == d.count()


def test_lm_background_knows_what_occurs_twice(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id long, text string")
    by = {r["doc_id"]: r["ce_background"] for r in lm_score.score(d, d.where("doc_id = 30")).collect()}
    assert max(by[i] for i in (*range(5), *range(40, 45))) < min(by[i] for i in range(5, 40))


def brute_coverage(words, template, reach):
    """The most template words, in order, within any stretch of 1.5 template lengths: no alignment can match more."""
    best = 0
    for lo in range(len(words)):
        part, row = words[lo : lo + reach], [0] * (len(template) + 1)
        for w in part:
            last = 0
            for j, t in enumerate(template, 1):
                last, row[j] = row[j], max(row[j], row[j - 1], last + (w == t))
        best = max(best, row[-1])
    return best


def test_scan_against_brute_force():
    """What is found is covered as far as any alignment in order can cover it, or nearly; what isn't found can't be covered."""
    rng = random.Random(3)
    names = ["MIT-grant", "ISC", "GPL-notice", "BSD", "Unlicense", "CC-BY-named", "MPL-2.0"]
    for trial in range(60):
        name = rng.choice(names)
        t = list(licenses.PARSED[name])
        for _ in range(rng.choice((0, 0, 1, 3, len(t) // 8, len(t) // 4))):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = [f"word{rng.randint(0, 99)}"] * rng.randint(0, 2)
        filler = lambda: [f"f{rng.randint(0, 300)}" for _ in range(rng.randint(0, 80))]
        words = filler() + t + filler()
        found = dict(licenses.scan(" ".join(words)))
        size = len(licenses.PARSED[name])
        most = brute_coverage(words, licenses.PARSED[name], int(1.5 * size) + 1) / size
        if name in found:
            assert licenses.COVERAGE <= found[name] <= most + 1e-9
        else:
            assert most < licenses.COVERAGE + 0.05 or any(k.startswith(name.split("-")[0]) for k in found)


def test_licenses_with_words_put_in_and_whole_bodies():
    t = licenses.TEMPLATES["MIT-grant"].split()
    half = len(t) // 2
    assert [n for n, _ in licenses.scan(" ".join([*t[:half], *(f"added{i}" for i in range(8)), *t[half:]]))] == ["MIT-grant"]
    for name in ("MIT-text", "BSD-3-Clause-text", "BSD-2-Clause-text", "ISC-text", "Unlicense-text", "Zlib-text", "BSL-1.0-text"):
        text = "some code\n" + licenses.TEMPLATES[name].replace("  ", " ") + "\nmore code"
        assert [n for n, c in licenses.scan(text) if c >= 0.99] == [name], name


def test_alignment():
    a, b = "x the a b c the y q z".split(), "the a c b the z".split()
    got = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert len(got) >= 5 and licenses.align([], b) == [] and licenses.align(b, b) == [(i, i) for i in range(6)]
    rng = random.Random(0)
    for _ in range(200):
        p = [(i, rng.randint(0, 20)) for i in range(rng.randint(0, 9))]
        best = max((len(s) for m in range(1 << len(p)) if (s := [q for i, q in enumerate(p) if m >> i & 1]) and all(x[1] < y[1] for x, y in zip(s, s[1:]))), default=0)
        assert len(licenses.rising(p)) == best


def test_licenses_are_found_in_any_place(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choice("the of a license to and is version".split()) for _ in range(n))
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((i, f"{noise(40)}\n{text.upper() if i % 2 else text}\n{noise(3000)}"))
        want[i] = name
    rows += [(900, noise(200)), (901, None), (902, ""), (None, "Released under the MIT License."), (903, "licensed under\n\nthe apache-license,  version 2.0"), (903, "x"), (904, "permission " * 3000)]
    rows += [(905, "Released under the MIT License.\n" + noise(50) + "\nLicensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(1))
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r["doc_id"], []).append(r["licenses"])
    assert {k: got[k] for k in want} == {k: [v] for k, v in want.items()}
    assert got[900] == [None] and got[901] == [None] and got[902] == [None] and got[None] == ["MIT"] and set(got[903]) == {"Apache-2.0", None}
    assert got[905] == ["CC-BY-NC-4.0,MIT"] and got[904] == [None]
    assert licenses.scan_licenses(df.where("false")).count() == 0


def test_pipeline_stages_on_a_fixture(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice([f"word{k}" for k in range(300)]) for _ in range(n))
    shared = prose(60)
    texts = [f"{prose(80)}\n{shared if i % 4 == 0 else prose(20)}\n{prose(30)}" for i in range(60)]
    texts += [texts[1], texts[2]] + ["#### $$$$ %%%% " * 20 for _ in range(12)] + ["too short", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 50, 2)] + [(i, 0) for i in range(62, 70)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == names
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["quality_rules"]) == set(range(62)) | ({i for i in range(62, 74)} & set(seen["quality_rules"]))
    assert set(seen["quality_classifier"]) == set(range(62))
    lines = seen["line_dedup"]
    assert [i for i, t in lines.items() if shared in t] == [0] and lines[60] == "" and lines[61] == ""
    assert set(seen["simhash_near_dedup"]) == set(range(61))
    assert sum(r["length"] for r in docs.collect() if r["start"] == 0 or True) == sum(r["doc_tokens"] for r in docs.collect() if r["start"] == 0)
    whole = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").groupBy("doc_id").agg(F.sum("length")).collect()}
    assert whole == {tuple(r) for r in docs.groupBy("doc_id").agg(F.sum("length")).collect()}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows from its predecessor's by plain loops; the classifier's verdicts come from posteriors that a test of their
    own holds against brute force."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice([f"word{k}" for k in range(900)]) for _ in range(n))
    common = [prose(12) for _ in range(6)]
    texts = []
    for _ in range(50):
        lines = [prose(rng.randint(6, 30)) for _ in range(rng.randint(2, 5))]
        lines.insert(rng.randint(0, 2), changed(rng, rng.choice(common), rng.randint(0, 3)))
        texts.append("\n".join(lines))
    for i in range(0, 20, 2):  # near copies: a few words changed in one long line
        words_ = (prose(90) + " " + str(i)).split()
        texts.append(" ".join(words_))
        words_[40 + i] = "other"
        texts.append(" ".join(words_))
    texts += ["#### $$$$ %%%% " * 20 for _ in range(10)] + ["a b c d e f g h " * 9, "too short", None, ""]
    rows = [(i, t, "en", "bad" if 70 <= i < 80 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 70)) for i in range(80)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = []
    failed = {}
    for i, t, _, host, _ in rows:
        n, _, _, _, repeated = brute_figures(t)
        failed[i] = n < 20 or 100 * repeated > 30 * n
    hosts = {h: [failed[r[0]] for r in rows if r[3] == h] for h in {r[3] for r in rows}}
    rates = [np.mean(v) for v in hosts.values()]
    between = np.var(rates) - np.mean(rates) * (1 - np.mean(rates)) * np.mean([1 / len(v) for v in hosts.values()])
    weight = max(0.0, np.mean(rates) * (1 - np.mean(rates)) / between - 1) if between > 0 else 1e9
    bad = {h for h, v in hosts.items() if (sum(v) + weight * np.mean(rates)) / (len(v) + weight) > quality.HOST_LIMIT}
    kept = [r for r in rows if not failed[r[0]] and r[3] not in bad]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    good = {r["doc_id"] for r in classifier.classify(spark.createDataFrame(kept, schema), labels).where("kept").collect()}
    kept = [r for r in kept if r[0] in good]
    lines = brute_lines([(r[0], r[1]) for r in kept])
    sets = {r[0]: shingles(lines[r[0]][0]) if lines[r[0]][0].split() else set() for r in kept}
    root = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and (len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4)]
    for _ in root:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    last = {i: lines[i][0] for i in sorted(set(root.values()))}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in last.items()}

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in pieces:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want and all(r["doc_tokens"] == want[r["doc_id"]] for r in pieces)
    assert len(want) < len(kept) < len(rows) and any(v[3] for v in lines.values())


def test_license_bodies_without_a_notice():
    t = licenses.TEMPLATES
    noise = "some prose about rivers and lakes " * 30
    for name in ("ISC", "ISC-warranty", "MIT-warranty", "BSD-warranty", "Unlicense"):
        assert [n for n, _ in licenses.scan(f"{noise}\n{t[name]}\n{noise}")] == [name]
    assert [n for n, _ in licenses.scan(f"{t['MIT-grant']}\n{t['MIT-warranty']}")] == ["MIT-grant", "MIT-warranty"]
