"""Quality by hierarchical empirical Bayes: a document's own evidence, and what is known of its host and its path there.

1. A logistic regression on a bounded sample of labelled documents gives each document the probability that it is good. Less the
   sample's own odds, its logit is the document's evidence.
2. Over all documents, grouped sums of the probabilities give each host and each path of a host a mean. Hosts are shrunk toward the
   global mean and paths toward their host, by prior strengths that come from the spread of the means (method of moments): a site of few
   documents is near what it belongs to, one of many near its own mean. From the sums of its host and of its path a document's own part is
   taken out, so that its evidence counts once; the only document of a path has its host's posterior, the only one of a host the global mean.
3. The document's score joins its evidence to the log odds of its path.

`host` and `path` are any two columns; for `documents` they are source and lang. Sums are of whole millionths, so reruns agree.

Defined results: a text without words scores 0 and isn't kept; without labels of both kinds the evidence is 0 and all other texts are
kept. Null hosts and paths are groups of their own. Labels that are null, or of unknown documents, are passed over. The verdict of a score
of exactly `least` is to keep; scores are not ranked, so ties need no rule. Repeated rows count each time and get equal results; texts are
measured whole, however long; extra columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .common import stored, text_of

#: Labelled rows that the classifier is fitted on at most, and the strength of its ridge.
SAMPLE, RIDGE = 20_000, 1.0
#: Bounds of the prior strengths, in documents.
WEAKEST, STRONGEST = 1.0, 1000.0
MILLION = 1_000_000
FEATURES = ["words", "word_length", "symbols", "stop_words", "repeated_lines", "repeated_words", "capitals"]


def features(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, host, path, n_words and the features, one row for each document."""
    id_ = F.struct(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("v"), F.col(host).cast("string")), F.lit("n")).alias("host"),
        F.coalesce(F.concat(F.lit("v"), F.col(path).cast("string")), F.lit("n")).alias("path"),
        F.length(F.regexp_replace(text_of(), "[^A-Z]+", "")).alias("capitals"),
    )
    m = quality_rules.measured(docs.select(id_.alias("doc_id"), "text"))

    def share(part: Column | str, of: str) -> Column:
        return F.col(part) / F.greatest(F.col(of), F.lit(1)) if isinstance(part, str) else part / F.greatest(F.col(of), F.lit(1))

    return m.select(
        "doc_id.doc_id",
        "doc_id.host",
        "doc_id.path",
        "n_words",
        F.log1p("n_words").alias("words"),
        share("word_chars", "n_words").alias("word_length"),
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_stop_words", "n_words").alias("stop_words"),
        share("n_dup_lines", "n_lines").alias("repeated_lines"),
        share("n_repeat_words", "n_words").alias("repeated_words"),
        share(F.col("doc_id.capitals"), "word_chars").alias("capitals"),
    )


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights for plain features, the constant, and the log odds of the labels. Newton steps on standardized features."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    good = y.mean()
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mean / spread).sum()), float(np.log(good / (1 - good)))


def strength(between: float, within: float, groups: int, n: int) -> float:
    """Documents that the prior weighs: the variance of a single document over what the means vary beyond what it explains."""
    extra = between - within * max(0, groups - 1) / max(1, n)
    return float(np.clip(within / extra - 1, WEAKEST, STRONGEST)) if extra > 0 else STRONGEST


def _odds(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5) -> DataFrame:
    """doc_id, classifier (the document's own probability), host_quality, path_quality, score and kept of every document."""
    rows = stored(features(docs, host, path), "site-features")
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).where("y IN (0, 1)")
    # of many labels, a share by hash comes near the sample before anything is sorted
    share = min(1.0, 1.2 * SAMPLE / max(1, known.count()))
    near = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = near.join(rows, F.col("_id") == F.col("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "y", *FEATURES).limit(SAMPLE).select("y", *FEATURES).toPandas()
    trained = sample["y"].nunique() == 2
    weights, constant, prior = fit(sample[FEATURES].to_numpy(float), sample["y"].to_numpy(float)) if trained else (np.zeros(len(FEATURES)), 0.0, 0.0)
    logit = F.lit(constant)
    for name, w in zip(FEATURES, weights.tolist(), strict=True):
        logit = logit + F.lit(w) * F.col(name)
    logit = F.when(F.col("n_words") > 0, F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))).otherwise(F.lit(-30.0))
    own = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
    scored = rows.select("doc_id", "host", "path", "n_words", logit.alias("logit")).withColumn("classifier", own).withColumn("part", F.round(F.col("classifier") * MILLION).cast("long"))
    paths = stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("s")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count(F.lit(1)).alias("groups")).first()
    n, mean = total["n"] or 0, (total["s"] or 0) / MILLION / max(1, total["n"] or 0)

    def millionths(x: Column) -> Column:
        return F.sum(F.round(x * MILLION).cast("long"))

    spread = hosts.agg(millionths(F.col("hn") * (F.col("hs") / MILLION / F.col("hn") - mean) ** 2)).first()[0] or 0
    k_host = strength(spread / MILLION / max(1, n), mean * (1 - mean), total["groups"], n)
    sites = stored(paths.join(hosts, "host"), "site-sums")
    host_mean, path_mean = F.col("hs") / MILLION / F.col("hn"), F.col("s") / MILLION / F.col("n")
    inner = sites.agg(millionths(F.col("n") * (path_mean - host_mean) ** 2), millionths(F.col("n") * host_mean * (1 - host_mean)), F.count(F.lit(1))).first()
    # paths vary about their hosts, so it is their hosts' variance that says what chance explains
    k_path = strength((inner[0] or 0) / MILLION / max(1, n), (inner[1] or 0) / MILLION / max(1, n), inner[2] - total["groups"] + 1, n)
    host_quality = ((F.col("hs") - F.col("part")) / MILLION + k_host * mean) / (F.col("hn") - 1 + k_host)
    path_quality = ((F.col("s") - F.col("part")) / MILLION + k_path * F.col("host_quality")) / (F.col("n") - 1 + k_path)
    joined = scored.join(sites, ["host", "path"]).withColumn("host_quality", host_quality).withColumn("path_quality", path_quality)
    evidence = F.col("logit") - F.lit(prior) + _odds(F.col("path_quality"))
    score = F.when(F.col("n_words") > 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-evidence)) if trained else F.lit(0.5)).otherwise(F.lit(0.0))
    return joined.select("doc_id", "classifier", "host_quality", "path_quality", score.alias("score")).withColumn("kept", F.col("score") >= least)
