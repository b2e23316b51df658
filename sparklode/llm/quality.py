"""Quality by hierarchical empirical Bayes: a document classifier's evidence and host and path posteriors.

The classifier is a logistic regression over shape measures of the whole text, fitted on a bounded, documented sample of
labelled documents. Sites come in by grouped aggregation over all labelled documents: counts by path are summed to hosts and
to the whole. Beta-binomial moments say how much hosts differ from the global rate and paths from their host; each
posterior mean is shrunk towards its parent by that much, so a site with few labels says nearly what its parent says.
A document's log odds are the classifier's plus what its path's posterior adds to the global prior.

Defined results: null and empty texts are scored like any other; a null host or path is a site of its own; documents
without labels take part in scoring only; without labels of both classes the classifier says nothing and the prior decides
(0.5 without any label); repeated rows score alike; columns beside the named ones are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import prepare, sample_texts

PER_CLASS = 1500  # most labelled documents of each class that the classifier is fitted on
MEASURES = 12


def measures(text: str | None) -> np.ndarray:
    """Shape of a text: sizes, repetition, letter kinds, symbols."""
    text = text or ""
    tokens = text.split()
    found, lines = Counter(tokens), text.split("\n")
    n, size = max(1, len(tokens)), max(1, len(text))
    letters = len(text) - len(text.translate(NOT_SYMBOLS))
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:]))
    top = found.most_common(1)[0][1] if found else 0
    return np.array([
        np.log1p(len(tokens)), np.log1p(n) ** 2 / 10, len(found) / n, np.log(max(len(found), 1)) / np.log(n + 1), top / n, repeats / n,
        len(set(lines)) / len(lines), size / n / 10, letters / size, sum(map(str.isupper, found)) / max(1, len(found)),
        sum(1 for t in found if not t[-1:].isalnum() and t[-2:-1] == t[-1:]) / max(1, len(found)), len(text) == 0,
    ], float)


NOT_SYMBOLS = {ord(c): None for c in "0123456789#$%&*+=<>[]{}|\\/^~_@!?©�"}


def fit(sample: list[tuple[str, str]]) -> dict | None:
    """Model of (label, text) pairs, label "1" for good."""
    from .toxicity import logistic

    y = np.array([label == "1" for label, _ in sample], float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array([measures(t) for _, t in sample])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = spread((x - centre) / scale)
    w = logistic(z, y)
    return {"centre": centre, "scale": scale, "weights": w, "prior": float(np.log(y.mean() / (1 - y.mean())))}


def spread(z: np.ndarray) -> np.ndarray:
    """Bounded measures with their squares, so that both too little and too much can count."""
    z = np.clip(z, -4, 4)
    return np.c_[z, z * z]


def evidence(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` (doc_id, text, host, path) without text, with evidence: the classifier's log odds without its prior."""
    prepare(docs.sparkSession)

    def weighed(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if model and batch.num_rows:
                x = np.array([measures(t.as_py()) for t in batch.column(1)])
                z = spread((x - model["centre"]) / model["scale"])
                out = np.c_[z, np.ones(len(z))] @ model["weights"] - model["prior"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out)], ["doc_id", "host", "path", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("host").cast("string"), F.col("path").cast("string")).mapInArrow(weighed, "doc_id long, host string, path string, evidence double")


def strength(counts: DataFrame, n: str, mean: str, parent: str):
    """Pseudo-count of the parent's rate in the posterior of each child, by the moments of the beta-binomial.

    With child rates q around the parent's p: var(q) = p (1 - p) (1 / (s + 1) + s / (s + 1) / n), solved for s over all children.
    """
    inside = F.col(parent) * (1 - F.col(parent))
    r = counts.agg(
        F.sum(F.col(n) * (F.col(mean) - F.col(parent)) ** 2).alias("between"), F.sum(inside * F.col(n)).alias("scale"),
        F.sum(inside).alias("noise"),
    ).first()
    if not r["scale"]:
        return 1e6
    rho = (r["between"] - r["noise"]) / max(r["scale"] - r["noise"], 1e-9)
    return min(1e6, max(1.0, 1 / max(rho, 1e-6) - 1))


def sites(labelled: DataFrame) -> tuple[DataFrame, float]:
    """host, path, posterior of every labelled path, and the global rate; ``labelled`` has host, path, quality."""
    one = F.when(F.col("quality") == 1, 1).otherwise(0)
    paths = labelled.where("quality is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(one).alias("k"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hk").alias("k")).first()
    rate = (total["k"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    hosts = hosts.withColumn("mean", F.col("hk") / F.col("hn")).withColumn("rate", F.lit(rate))
    s = strength(hosts, "hn", "mean", "rate")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("hk") + s * rate) / (F.col("hn") + s)).alias("host_posterior"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn("mean", F.col("k") / F.col("n"))
    s = strength(paths, "n", "mean", "host_posterior")
    return paths.select("host", "path", "host_posterior", ((F.col("k") + s * F.col("host_posterior")) / (F.col("n") + s)).alias("posterior")), rate


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score, predicted, evidence, prior for every row of ``docs`` (doc_id, text, host, path); ``labels`` has doc_id, quality."""
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").dropDuplicates(["doc_id"])
    model = fit(sample_texts(docs, labels.select("doc_id", F.col("quality").cast("string").alias("label")), per_class))
    labelled = docs.select("doc_id", F.col("host").cast("string"), F.col("path").cast("string")).join(labels, "doc_id")
    known, rate = sites(labelled)
    hosts = known.groupBy(F.col("host").alias("h1")).agg(F.first("host_posterior").alias("host_posterior"))
    paths = known.select(F.col("host").alias("h2"), F.col("path").alias("p2"), "posterior")
    here = docs.select(F.col("host").cast("string").alias("h"), F.col("path").cast("string").alias("p")).distinct()
    here = here.join(hosts, F.col("h").eqNullSafe(F.col("h1")), "left").join(paths, F.col("h").eqNullSafe(F.col("h2")) & F.col("p").eqNullSafe(F.col("p2")), "left")
    prior = F.least(F.greatest(F.coalesce("posterior", "host_posterior", F.lit(rate)), F.lit(1e-4)), F.lit(1 - 1e-4))
    # A row per site that occurs: small tables are broadcast once their size is known, hot sites of large ones split, both at run time.
    found = evidence(docs, model).join(here.select("h", "p", prior.alias("prior")), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    found = found.withColumn("score", 1 / (1 + F.exp(-F.col("evidence") - F.log(F.col("prior") / (1 - F.col("prior"))))))
    return found.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "prior")
