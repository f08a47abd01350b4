"""Quality classifier with hierarchical empirical Bayes over sites.

Document evidence: content and shape, learnt from a bounded sample of labelled
documents: those whose hash is under the share that gives ``SAMPLE``, each once if it
repeats. Content: words and pairs of neighbouring words are hashed into ``BUCKETS``
places; over each half of the sample, dealt by a hash, each place gets the log-odds of
its documents being good. A document's content is the mean over its distinct places: of
the other half's log-odds for one of the sample, so that no label speaks for itself, of
both halves' mean for any other. Shape: symbols, capitals, repeated words, cell marks and
their like. Both go into a logistic regression, fitted by Newton steps on the sample.

Site evidence: for each host and for each path of a host, the share of good
documents, where a labelled document counts as 1 by its label and any other as
``SOFT`` by the classifier's probability. Shares are Beta posteriors. A host's prior
is the global share with the strength that the spread between hosts gives (by
moments); a path's prior is its host's posterior, with the strength from the spread
between paths of a host. A sparse site is thereby shrunk towards its parent.

A document's probability is, in log-odds, the classifier's plus ``WEIGHT`` times
the shift of its path's posterior against the global share. It is rejected
under ``THRESHOLD``.

Sites are summed before the shuffle and met by a join on the site; the sample, a number
for each place and three sums per level come to the driver. Features are written once
and read again. Tables without URLs have no better site than ``source`` as host and
``lang`` under it as path; both are arguments.

Edge cases: null and empty texts have a feature of their own and are judged like
the rest; a very long text has ``BUCKETS`` places at most; null hosts and paths are
sites; repeated rows are judged alike; a tie at the threshold is kept; labels
with nulls, or for unknown documents, are not used; with fewer than
two kinds of labels every document gets the labelled share (0.5 without labels)
from the classifier; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, Scratch

SAMPLE = 20_000
BUCKETS = 1 << 14
SOFT = 0.1
WEIGHT = 0.5
THRESHOLD = 0.5
_SYMBOLS = "#$%&*<>[]{}^~=+\\_"

FEATURES = (
    "content", "size", "capitals", "symbols", "cells", "bangs", "digits", "distinct", "word", "stops", "lines", "empty"
)


def words_of(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACE_PATTERN)


def features(t: Column, hashed: Column) -> dict[str, Column]:
    """Numbers between 0 and about 1 that describe a text, of which ``hashed`` are the words' hashes (one if it has none)."""
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    count = F.size(hashed).cast("double")

    def share(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / n

    return {
        "size": F.log1p(count) / 10,
        "capitals": (F.length(t) - F.length(F.regexp_replace(t, "[\\p{Lu}]", ""))) / n,
        "symbols": share(_SYMBOLS),
        "cells": share("|"),
        "bangs": share("!"),
        "digits": share("0123456789"),
        "distinct": F.size(F.array_distinct(hashed)) / count / F.greatest(F.lit(0.1), 1 - F.log1p(count) / 20),
        "word": F.least(n / count / 20, F.lit(2.0)),
        "stops": share(".,"),
        "lines": share("\n") * 10,
        "empty": (hashed[0] == F.xxhash64(F.lit(""))).cast("double"),
    }


def places(hashed: Column) -> Column:
    """The distinct places of a text's words and pairs of words, by the words' hashes."""
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    more = F.greatest(F.size(hashed) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(hashed, F.lit(1), more), F.slice(hashed, F.lit(2), more), lambda x, y: place(x, y))
    return F.array_distinct(F.concat(F.transform(hashed, lambda h: place(h)), pairs))


def place_weights(labelled: DataFrame) -> np.ndarray:
    """For each place the log-odds that a document (label, places) which has it is good, against all documents."""
    good, total = labelled.agg(F.sum("label"), F.count("*")).first()
    good, bad = float(good or 0.0), float(total) - float(good or 0.0)
    sums = labelled.select("label", F.explode("places").alias("place")).groupBy("place")
    counted = sums.agg(F.sum("label").alias("g"), F.count("*").alias("n")).toPandas()  # a row per place at most
    g, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    g[counted["place"]], n[counted["place"]] = counted["g"], counted["n"]
    if not good or not bad:
        return np.zeros(BUCKETS)
    return np.log((g + 1) / (good + 2)) - np.log((n - g + 1) / (bad + 2))


def content(weights: np.ndarray) -> Column:
    """The mean weight of a document's places, 0 without any."""
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate("places", F.lit(0.0), lambda s, p: s + F.get(table, p))
    return F.when(F.size("places") > 0, total / F.size("places")).otherwise(0.0)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge logistic regression."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return float(np.log(share / (1 - share))), np.zeros(x.shape[1])
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(
            (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w
        )
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / spread
    return float(w[0] - weights @ mean), weights


def _strength(sums: DataFrame, share: Column) -> float:
    """The Beta prior's strength from the spread of site shares around ``share``, by moments.

    For n observations and strength m, E (s/n - p)^2 = p (1 - p) (1 + (n - 1) / (m + 1)) / n.
    """
    v = share * (1 - share)
    row = (
        sums.filter((F.col("n") > 0) & (v > 0))
        .agg(
            F.sum(F.pow(F.col("s") - F.col("n") * share, F.lit(2.0)) / v).alias("x"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * (F.col("n") - 1)).alias("nn"),
        )
        .first()
    )
    if not row["n"] or not row["nn"] or row["nn"] <= 0:
        return 1e4
    rho = (row["x"] - row["n"]) / row["nn"]  # 1 / (m + 1)
    return float(min(max(1 / rho - 1, 1.0), 1e4)) if rho > 0 else 1e4


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def classify(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, p_document, p_site, p_good, kept, row_hash.

    row_hash names the text, so that rows can be met again even if ids repeat.
    """
    scratch = Scratch(spark, "quality")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"),
        F.xxhash64(text).alias("row_hash"), text.alias("text"),
    )
    read = read.withColumn("hashed", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
    shaped = read.select(
        "doc_id", "host", "path", "row_hash",
        places(F.col("hashed")).alias("places"),
        *[f.cast("double").alias(f"f_{name}") for name, f in features(F.col("text"), F.col("hashed")).items()],
    )
    shaped = scratch.save(shaped, "features")
    judged = labels.filter("doc_id is not null and quality is not null")
    judged = judged.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.min("quality").cast("double").alias("label")
    )
    # labels grow with the documents, so they are never broadcast; what meets them here is narrow
    known = shaped.select("doc_id", "row_hash").join(judged.hint("merge"), F.col("doc_id") == F.col("_id"))
    known = scratch.save(known.select("doc_id", "row_hash", "label").distinct(), "labelled")
    # about SAMPLE rows by a hash, whatever their number; a limit by order would send as many from every task
    share_of = min(1.0, SAMPLE / max(known.count(), 1))
    drawn = F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(1 << 30)) < int(share_of * (1 << 30))
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id", "row_hash"), F.lit(2))
    bounded = F.broadcast(known.filter(drawn).withColumn("half", half))
    sample = shaped.join(bounded, ["doc_id", "row_hash"]).dropDuplicates(["doc_id", "row_hash"])
    sample = scratch.save(sample.drop("host", "path"), "sample")
    first, second = (place_weights(sample.filter(F.col("half") == h).select("label", "places")) for h in (0, 1))
    # of each document what either half says of it; which of them counts depends on the label, which comes next
    said = [c for c in shaped.columns if c != "places"]
    rated = shaped.select(*said, content(first).alias("f_0"), content(second).alias("f_1"))
    known = rated.join(judged.hint("merge"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    taught = F.col("label").isNotNull() & drawn
    means = F.when(taught, F.when(half == 0, F.col("f_1")).otherwise(F.col("f_0"))).otherwise((F.col("f_0") + F.col("f_1")) / 2)
    known = scratch.save(known.withColumn("f_content", means).drop("f_0", "f_1"), "known")
    scratch.drop("features", "labelled")
    names = [f"f_{name}" for name in FEATURES]
    own = F.when(F.col("half") == 0, content(second)).otherwise(content(first))
    sample = sample.withColumn("f_content", own).orderBy("doc_id", "row_hash").select("label", *names).toPandas()
    intercept, weights = fit(sample[names].to_numpy(float), sample["label"].to_numpy(float))
    score = F.lit(intercept)
    for name, w in zip(names, weights, strict=True):
        score = score + F.col(name) * F.lit(float(w))
    rated = known.withColumn("p_document", 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-30.0)), F.lit(30.0)))))
    # evidence by path, then by host, then over all
    mass = F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT)
    good = mass * F.coalesce("label", "p_document")
    paths = scratch.save(rated.groupBy("host", "path").agg(F.sum(mass).alias("n"), F.sum(good).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n"), F.sum("s")).first()
    share = float(whole[1] / whole[0]) if whole[0] else 0.5
    host_strength = _strength(hosts, F.lit(share))
    hosts = hosts.select(
        F.col("host").alias("_host"),
        ((F.col("s") + host_strength * share) / (F.col("n") + host_strength)).alias("host_share"),
    )
    nested = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    path_strength = _strength(nested, F.col("host_share"))
    sites = nested.select(
        F.col("host").alias("_host"),
        F.col("path").alias("_path"),
        ((F.col("s") + path_strength * F.col("host_share")) / (F.col("n") + path_strength)).alias("p_site"),
    )
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    shift = _logit(F.col("p_site")) - _logit(F.lit(share))
    odds = _logit(F.col("p_document")) + WEIGHT * shift
    return (
        rated.join(sites, same)
        .withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .select(
            "doc_id", "p_document", "p_site", "p_good", (F.col("p_good") >= THRESHOLD).alias("kept"), "row_hash"
        )
    )


def drop_rejected(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    verdicts = classify(spark, docs, labels)
    rejected = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("__wn_id"), F.col("row_hash").alias("__wn_h"))
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__wn_id")) & (own == F.col("__wn_h"))
    return docs.join(rejected.distinct(), same, "left_anti")
