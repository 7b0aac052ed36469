"""Quality rules of documents and of hosts; built-in functions only.

Each document gets its own figures in one pass over its text, without a shuffle. Failures are then summed by host, each
host's rate is shrunk with a beta prior fitted to all hosts, and hosts whose shrunk rate is too high take their documents
with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: The contract's white space, symbols and limits.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A host goes if its shrunk failure rate is above this: then what passes the rules there is more likely missed than clean.
HOST_LIMIT = 0.8
#: So many rejected hosts are broadcast at most; beyond, the verdicts are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text holds twice or more, the first included."""

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.sort_array(F.transform(F.filter(s, twin_of(s)), lambda x: x["p"]))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(twice, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step)["n"]

        placed = F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(F.sort_array(placed), of_sorted))

    def twin_of(s: Column):
        return lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        return F.when(F.size(h) <= WINDOW, 0).otherwise(let(windows, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def figures(text: Column) -> Column:
    """A struct of the text's n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; null text: of an empty one."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return F.struct(
        let(split_words(text), of_words).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def base_figures(df: DataFrame, *keep: Column, text_col: str = "text") -> DataFrame:
    """`keep` and the five figures and base_failed, one row per input row."""
    f = df.select(*keep, figures(F.col(text_col)).alias("f"))
    out = f.select(*(c for c in f.columns if c != "f"), "f.w.n_words", "f.w.word_chars", "f.n_symbols", "f.n_dup_lines", "f.w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(figures: DataFrame, host: str = "host", failed: str = "base_failed") -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_rejected for each host that isn't null.

    The prior's mean is the mean of the hosts' rates; its weight comes from their variance beyond what sampling explains
    (method of moments). Hosts that do not differ beyond sampling get the mean itself; an empty table gives no hosts.
    """
    by_host = figures.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m = by_host.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    mean, noise = m["mean"] or 0.0, (m["mean"] or 0.0) * (1 - (m["mean"] or 0.0))
    between = (m["var"] or 0.0) - noise * (m["inv"] or 0.0)
    weight = min(1e9, max(0.0, noise / between - 1)) if between > 0 else 1e9
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return by_host.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > HOST_LIMIT)


def rejected_hosts(rows: DataFrame) -> DataFrame:
    """host, bad of the hosts that go; broadcast while they are few."""
    bad = cut(host_verdicts(rows).where("host_rejected").select("host", F.lit(True).alias("bad")), "hosts")
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, the figures, base_failed and kept, one row per input row; repeated and tied ids stay as they are.

    kept: the row passes the rules and its host isn't rejected. Rows of a null host are judged by the rules alone. Null and
    empty texts fail for want of words. An empty table gives no rows.
    """
    rows = cut(base_figures(df, F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text_col=text_col), "quality")
    judged = rows.join(rejected_hosts(rows), "host", "left").withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull())
    return judged.drop("host", "bad").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns only. Figures are worked out twice, once for the hosts and
    once to filter, so that no text is stored or shuffled."""
    host = F.col(host_col).cast("string")
    bad = rejected_hosts(base_figures(docs, host.alias("host"), text_col=text_col)).select(F.col("host").alias("__host"))
    passed = docs.join(bad, host == bad["__host"], "left_anti")
    f = figures(F.col(text_col))
    enough = lambda x: (x["w"]["n_words"] >= LEAST_WORDS) & (100 * x["w"]["n_repeat_words"] <= MOST_REPEATED * x["w"]["n_words"])
    return passed.where(let(f, enough))


#: DuckDB; HOST_LIMIT and the prior as above. No rate is returned, so that sums of doubles can't differ in their last digits.
SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(8)) AS u(k) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT avg(k / n) AS mean, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n) AS between FROM h),
p AS (SELECT mean, CASE WHEN between > 0 THEN least(1e9, greatest(0, mean * (1 - mean) / between - 1)) ELSE 1e9 END AS weight FROM m),
bad AS (SELECT host FROM h, p WHERE (k + mean * weight) / (n + weight) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (host IS NULL OR host NOT IN (SELECT host FROM bad)) AS kept
FROM b
"""
