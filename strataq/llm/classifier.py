"""Quality classifier with hierarchical empirical Bayes: document evidence, host and path posteriors.

A logistic model on figures of the text is fitted to a bounded sample of labelled rows (MAX_LABELLED). Its probabilities are
summed by host and by path; host rates are shrunk toward the global rate and path rates toward their host's, each with a
beta prior whose weight is fitted to all groups. A document's posterior replaces the global rate in its log odds by its
path's rate, worked out without the document itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, without

#: At most so many labelled rows fit the document model, those of the least hashes of their ids.
MAX_LABELLED = 20_000
#: Documents whose posterior is below go.
KEEP_FROM = 0.5
#: How strongly the site's log odds count beside the document's own.
SITE_WEIGHT = 0.5
FIGURES = ("upper", "lower", "digit", "blank", "line", "symbol", "mark", "stop", "other", "log_words", "word_length", "distinct_words", "distinct_lines", "loud_words", "odd_words", "letter_entropy")

_CLASS = np.full(256, 8)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n", b"#*$%&|<>@^~_=+\\{}[]", b"!?", b".,;:")):
    _CLASS[list(_chars)] = _k


def text_figures(text: str) -> np.ndarray:
    """The FIGURES of a text, all finite; an empty text has zeros."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(_CLASS, counts, 9) / n
    letters = counts[97:123] / max(1, counts[97:123].sum())
    entropy = -(letters[letters > 0] * np.log(letters[letters > 0])).sum()
    unique = set(words)
    loud = sum(map(str.isupper, words)) / w
    odd = sum(1 for x in words if not x[-1].isalnum() and x[-1] not in ".,;:") / w
    return np.array([*kinds, np.log1p(len(words)), np.log1p(n / w), len(unique) / w, len(set(lines)) / len(lines), loud, odd, entropy], np.float32)


def with_figures(df: DataFrame, *cols: Column, text_col: str = "text") -> DataFrame:
    """`cols` and x (array<float>), one row per input row."""
    names = [f"c{i}" for i in range(len(cols))]
    rows = df.select(*(c.alias(n) for c, n in zip(cols, names, strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            x = [text_figures(t) for t in batch.column(len(names)).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.float32), *x])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FIGURES)), pa.array(flat))
            yield pa.record_batch([*batch.columns[: len(names)], lists], [*names, "x"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{kinds}, x array<float>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float] | None:
    """Weights on raw figures and the intercept of a ridge logistic regression (Newton steps); None unless y has both classes."""
    if not len(y) or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    inner = w[:-1] / scale
    return inner, float(w[-1] - inner @ mean)


def train(figures: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED):
    """The model from figures (id, x) and labels (doc_id, quality); only `limit` rows reach the driver."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # so the broadcast is bounded
    some = figures.join(F.broadcast(known), figures.id == known.doc_id).select("id", "x", "quality")
    some = some.orderBy(F.xxhash64("id"), "id", F.xxhash64("x")).limit(limit).toPandas().sort_values("id")  # ids may repeat
    return fit(np.array(some["x"].tolist(), np.float64).reshape(len(some), len(FIGURES)), some["quality"].to_numpy(np.float64))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def weight_of(groups: DataFrame, rate: Column, toward: Column) -> float:
    """The weight of the beta prior around `toward`: from the groups' spread beyond what sampling explains."""
    m = groups.agg(F.avg((rate - toward) ** 2).alias("spread"), F.avg(toward * (1 - toward)).alias("noise"), F.avg(toward * (1 - toward) / F.col("n")).alias("sampling")).first()
    between = (m["spread"] or 0.0) - (m["sampling"] or 0.0)
    return min(1e6, max(1.0, (m["noise"] or 0.0) / between - 1)) if between > 0 else 1e6


def site_rates(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """host, path, host_n, host_s, path_n, path_s (rows and sums of p) for each path of scored (host, path, p); the global rate; the
    weights of the hosts' prior and of the paths'."""
    paths = cut(scored.where("host IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 1.0
    k_host = weight_of(hosts, F.col("s") / F.col("n"), F.lit(mean))
    sites = paths.join(hosts.withColumnsRenamed({"n": "host_n", "s": "host_s"}), "host")
    k_path = weight_of(sites, F.col("s") / F.col("n"), (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host))
    return cut(sites.withColumnsRenamed({"n": "path_n", "s": "path_s"}), "sites"), mean, k_host, k_path


def scored(docs: DataFrame, labels: DataFrame, *keep: Column, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: `keep` as c3, c4, ...; id, p_doc, host_rate, path_rate, posterior, kept."""
    rows = with_figures(docs, F.col(id_col), host.cast("string"), path.cast("string"), *keep, text_col=text_col)
    rows = cut(rows.withColumnsRenamed({"c0": "id", "c1": "host", "c2": "path"}), "figures")
    model = train(rows.select("id", "x"), labels)
    if model is None:  # nothing to learn from: every document is kept
        none = F.lit(None).cast("double")
        return rows.drop("x", "host", "path").select("*", F.lit(1.0).alias("p_doc"), none.alias("host_rate"), none.alias("path_rate"), F.lit(1.0).alias("posterior"), F.lit(True).alias("kept"))
    score = F.lit(model[1])
    for i, w in enumerate(model[0]):
        score = score + F.lit(float(w)) * F.get("x", F.lit(i)).cast("double")
    rows = rows.select("*", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))).alias("p")).drop("x")
    sites, mean, k_host, k_path = site_rates(rows)
    same = (rows.host == sites.host) & rows.path.eqNullSafe(sites.path)
    out = rows.join(sites, same, "left").drop(sites.host, sites.path).drop("host", "path")
    # a row's own evidence isn't among its site's, as it counts by itself
    out = out.withColumn("host_rate", (F.greatest(F.lit(0.0), F.col("host_s") - F.col("p")) + k_host * mean) / (F.col("host_n") - 1 + k_host))
    out = out.withColumn("path_rate", (F.greatest(F.lit(0.0), F.col("path_s") - F.col("p")) + k_path * F.col("host_rate")) / (F.col("path_n") - 1 + k_path))
    out = out.drop("host_n", "host_s", "path_n", "path_s")
    shift = F.coalesce(logit(F.col("path_rate")) - logit(F.lit(mean)), F.lit(0.0))
    out = out.withColumnRenamed("p", "p_doc").withColumn("posterior", 1 / (1 + F.exp(-(logit(F.col("p_doc")) + SITE_WEIGHT * shift))))
    return out.withColumn("kept", F.col("posterior") >= KEEP_FROM)


def path_of(docs: DataFrame) -> Column:
    """The part of a host that a document belongs to: here its language, as the table has no paths below hosts."""
    return F.col("lang")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, p_doc, host_rate, path_rate, posterior, kept; one row per row of docs, repeated and null ids included.

    Null text counts as empty. A row of a null host has no site rates and is judged by its text. With no labels of both
    classes every row is kept. An empty table gives no rows.
    """
    out = scored(docs, labels, host=F.col(host_col), path=path_of(docs), id_col=id_col, text_col=text_col)
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their own columns. Each row is judged by itself, whatever id it has."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    judged = scored(rows, labels, F.col("__row"), host=F.col(host_col), path=path_of(rows), id_col=id_col, text_col=text_col)
    return without(rows, judged.where("NOT kept").select("c3"), "__row").drop("__row")
