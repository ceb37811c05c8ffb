"""Quality by hierarchical empirical Bayes: a document's own evidence on top of what its site and path are like.

A logistic classifier on surface statistics of the whole text, trained in numpy on a bounded sample of labels, gives every document
a log likelihood ratio for good against bad. Grouped sums of its probabilities over all documents estimate a global prior, then
a Beta posterior for each host around the global mean and for each path of the host around the host's mean;
the strength of either prior comes from the spread between groups (method of moments), so sparse sites are shrunk hard and
large ones keep their own rate. A document's posterior joins its ratio with its path's rate; it is kept from 0.5 on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common
from gapweave.plans.storage import materialize

#: Labelled documents of a class that training reads at most; bounds of a prior's strength, in documents.
SAMPLE, STRENGTH = 3000, (2.0, 1000.0)
#: Limits of a group's rate, so that no site decides against a document's own evidence.
RATE = (0.05, 0.95)
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True


def features(text: str | None) -> list[float]:
    """Surface statistics of a whole text: shares of kinds of bytes, marks per word, repetition of words and lines."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * N_FEATURES
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n, high = h.sum(), h[128:].sum()
    upper, lower, digit = h[_UPPER].sum(), h[_LOWER].sum(), h[_DIGIT].sum()
    space = h[[9, 10, 11, 12, 13, 32]].sum()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    w = max(len(words), 1)
    symbol = n - upper - lower - digit - space - high
    soft = h[[44, 46, 39, 45, 58, 59, 63]].sum()
    letters = max(upper + lower + high, 1)
    return [
        1.0, np.log1p(w) / 10, upper / letters, digit / n, (symbol - soft) / n, soft / w, h[33] / w, h[124] / w, h[[35, 36, 37, 38, 42, 64]].sum() / w, high / n,
        (n - space) / w / 10, 1 - len(set(words)) / w, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)) / 5, len(lines) / w,
        float(min(upper / letters, 0.5) > 0.3), min((symbol - soft) / w, 2.0),
    ]


N_FEATURES = 17


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression with balanced classes on standardised features: weights for the raw features."""
    if not len(y) or y.all() or not y.any():
        w = np.zeros(N_FEATURES)
        w[0] = 0.0 if not len(y) else 3.0 if y.all() else -3.0
        return w
    mean, sd = x.mean(axis=0), x.std(axis=0)
    live = sd > 1e-9
    z = np.where(live, (x - mean) / np.where(live, sd, 1), 0)
    z = np.concatenate([np.ones((len(z), 1)), z], axis=1)
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):  # Newton steps on a convex objective
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (cost * (p - y)) + l2 * w
        hess = (z * (cost * p * (1 - p))[:, None]).T @ z + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    raw = np.where(live, w[1:] / np.where(live, sd, 1), 0)
    raw[0] = w[0] - raw[1:] @ mean[1:]  # the first feature is the constant
    return raw


def _feature_rows(docs: DataFrame) -> pa.Table:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["y", "key", "x"])

    return docs.mapInArrow(run, "y int, key long, x array<double>").toArrow()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the log likelihood ratio, from the first ``sample`` labelled documents of each class in hash order."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("y"))
    chosen = common.first_of_each(known, "y", sample, 31)
    rows = _feature_rows(common.one_row_each(docs.join(chosen, "doc_id"), ["doc_id", "y"]).select("text", "y", "key"))
    order = np.lexsort((rows["y"].to_numpy(), rows["key"].to_numpy()))  # the same whatever task came first
    x = np.array(common.list_views(rows["x"]), dtype=np.float64).reshape(-1, N_FEATURES)
    return fit(x[order], rows["y"].to_numpy().astype(np.float64)[order])


def with_evidence(docs: DataFrame, weights: np.ndarray, name: str) -> DataFrame:
    """``docs`` with the classifier's log likelihood ratio for good against bad in a new column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)], dtype=np.float64).reshape(-1, N_FEATURES)
            llr = np.where(x[:, 0] > 0, np.clip(x @ weights, -20, 20), -20.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(llr)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _clip(rate: Column) -> Column:
    return F.greatest(F.least(rate, F.lit(RATE[1])), F.lit(RATE[0]))


def site_rates(groups: DataFrame) -> DataFrame:
    """``groups(host, path, n, s, q)`` (documents, sum and sum of squares of probabilities) to the rate of every path.

    One row per path of a host. The strength of a prior is m (1 - m) / v - 1 for the weighted variance v between groups, less what
    sampling alone gives; the windows run over hosts or over the paths of one host, never over documents.
    """
    one = Window.partitionBy("_all")
    hosts = groups.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    hosts = hosts.withColumn("_all", F.lit(0)).withColumns({"m": F.sum("hs").over(one) / F.sum("hn").over(one)})
    noise = (F.sum("hq").over(one) / F.sum("hn").over(one) - F.col("m") * F.col("m")) * F.count(F.lit(1)).over(one) / F.sum("hn").over(one)
    spread = F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - F.col("m"), 2)).over(one) / F.sum("hn").over(one)

    def strength(mean: Column, var: Column) -> Column:
        free = F.greatest(var, F.lit(1e-6))
        return F.greatest(F.least(mean * (1 - mean) / free - 1, F.lit(STRENGTH[1])), F.lit(STRENGTH[0]))

    hosts = hosts.withColumn("k", strength(F.col("m"), spread - noise))
    hosts = hosts.withColumn("hrate", (F.col("hs") + F.col("k") * F.col("m")) / (F.col("hn") + F.col("k"))).select("host", "hn", "hrate", "k")
    paths = groups.join(hosts, "host")
    per_host = Window.partitionBy("host")
    wide = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hrate"), 2)).over(per_host) / F.col("hn")
    paths = paths.withColumn("pk", strength(F.col("hrate"), wide))
    return paths.select("host", "path", _clip((F.col("s") + F.col("pk") * F.col("hrate")) / (F.col("n") + F.col("pk"))).alias("rate"))


def assess(docs: DataFrame, weights: np.ndarray, host: Column, path: Column) -> DataFrame:
    """All rows and columns of ``docs`` plus ``evidence``, ``site_rate``, ``posterior`` and ``good``.

    NULL hosts and paths are groups of their own. A NULL or empty text carries the strongest evidence against it and is rejected. Repeated rows count
    as often as they appear; an empty table gives an empty result; columns named like a new one are replaced.
    """
    made = {"evidence", "site_rate", "posterior", "good"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    h, p, e = (common.unique_name(docs, n) for n in ("_host", "_path", "_evidence"))
    tagged = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("null"))
    rows = with_evidence(docs.withColumns({h: tagged(host), p: tagged(path)}), weights, e)
    prob = 1 / (1 + F.exp(-F.col(e)))
    groups = rows.select(F.col(h).alias("host"), F.col(p).alias("path"), prob.alias("prob")).groupBy("host", "path")
    groups = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("prob").alias("s"), F.sum(F.col("prob") * F.col("prob")).alias("q"))
    rates = materialize(site_rates(materialize(groups, "quality-groups")), "quality-rates").withColumnsRenamed({"host": h, "path": p, "rate": "site_rate"})
    logit = F.col(e) + F.log(F.col("site_rate") / (1 - F.col("site_rate")))
    posterior = 1 / (1 + F.exp(-logit))
    return rows.join(rates, [h, p]).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(e).alias("evidence"), "site_rate", posterior.alias("posterior"), (posterior >= 0.5).alias("good"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document; the source is its host, the language its path."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    weights = train(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    found = assess(docs, weights, F.col("source"), F.col("lang"))
    return found.select("doc_id", "evidence", "site_rate", F.col("posterior").alias("score"), F.col("good").cast("int").alias("predicted"))
