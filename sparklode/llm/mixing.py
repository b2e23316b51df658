"""Soft-membership mixing of a corpus to target domain weights, in DataFrame operations only.

A naive Bayes classifier learns domains from a labelled table by grouped counts and gives every document a posterior over domains. Its
measures are the evidence of the words (by their first STEM letters) for each domain, the sum of their log odds over the whole text, and five measures of the text's
shape, each in BINS bins. Words that tell domains apart are chosen from counts of a bounded sample of one half of the labels; the bins are
counted over all documents of the other half, so the evidence of words is never judged by the documents that it came from. What is collected
is WORDS words and a table of measures x BINS x domains, whatever the corpus.

A document of n tokens and posterior p, taken at rate x, is expected to add x n p[k] tokens to domain k. Rates between ``lo`` and ``hi`` are
the bounded least squares solution for these totals against the targets: with G = sum(n p p') they make residual' G^-1 residual least, and
of all rates that do, up to a RIDGE, those nearest to 1. Such rates are clip(1 - p . s) for one vector s, a number for each domain: the
projection to the bounds of a point that s moves. Newton steps on the dual find s; each sums totals, curvature and objective over all
documents (one small row). So a rate is an expression over the row: none is ever stored or shuffled.

Defined results: null and empty texts have one token; documents without a label are scored like all others; without a label
that has a target every rate is 1; targets for domains that no label has are left out and the rest scaled up; domains with
labels but no target are one domain, ``OTHER``, that aims at weight 0; repeated rows are documents of their own; other columns are carried
along by ``mix``, but for those named as its own.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._common import ROW, cut, opened, sealed

BINS = 32
STEPS, CLOSE = 200, 1e-6  # most Newton steps; relative gradient of the dual at which they end
RIDGES = (1e-3, 1e-5)  # weights of the distance from 1, each solution the start of the next
HALVINGS = 12  # shorter steps that are tried where a whole one does not lower the dual
WORDS, SLOTS = 1024, 4096  # words that the evidence comes from, and places in the table that they are looked up in
STEM, BREAKS = 5, "\n\t\r.,!?"  # characters of a word that count, and what ends a word besides a space
LEAST_DOCUMENTS, SURPRISE = 4, 5.0  # of a word that is chosen: documents with it, and standard deviations from what a domain's size lets expect
LEARNED = 5000  # most labelled documents of each domain that words are learned from
PRIOR = 2.0  # documents that a word's share of the whole table counts for in its share of a domain
OTHER = "other"
SPACES, SYMBOLS = " \n\t", "#$%&*"


def without(text: Column, *pieces: str) -> Column:
    """Number of characters that the given pieces take up in the text; replacing is a search over bytes, unlike translating."""
    left = text
    for piece in pieces:
        left = F.replace(left, F.lit(piece), F.lit(""))
    return F.length(text) - F.length(left)


def binned(share: Column) -> Column:
    """Eight bins for each tenfold from 1/10,000 to 1; 0 below."""
    return F.when(share <= 1e-4, 0).otherwise(F.least(F.lit(BINS - 1), F.floor(8 * (F.log10(share) + 4)) + 1)).cast("int")


def measures(text: Column) -> dict[str, Column]:
    """tokens and the bin of each measure of a text: its symbols, shouting, punctuation, length and length of words."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    spaces = without(text, *SPACES)
    return {
        "tokens": (spaces + 1).cast("double"),
        "_m0": binned(without(text, *SYMBOLS) / size),
        "_m1": binned(without(text, "!!") / size),
        "_m2": binned(without(text, ". ", ", ", ".\n") / size),
        "_m3": F.least(F.lit(BINS - 1), F.floor(2 * F.log2(size))).cast("int"),
        "_m4": F.least(F.lit(BINS - 1), F.floor(2 * size / (spaces + 1))).cast("int"),
    }


SHAPES = [f"_m{i}" for i in range(5)]


def stems(text: Column) -> Column:
    """Hash of the first STEM characters of each lower-case word of a text, and of the empty string where spaces or punctuation meet."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for mark in BREAKS:
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(F.substring(w, 1, STEM)))


def learn_words(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """The table of the words that tell domains apart: hash in each slot (0 if free) and log odds [slot, domain]; None without any.

    ``docs`` has doc_id and text, ``labelled`` doc_id and domain. A word counts once for a document. About LEARNED documents of each
    domain are learned from, chosen by a hash of the id, so that texts needn't be shuffled to meet their labels.
    """
    hashes = F.explode(F.array_distinct(stems(F.col("text"))))
    counts = labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()  # domains with a target, and OTHER
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("domain") == r["domain"], F.lit(LEARNED / r["n"])).otherwise(share)
    some = labelled.where(F.xxhash64("doc_id", F.lit(7)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52) < share)
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # about LEARNED ids for each domain
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # domains with a target, and OTHER
    sizes = np.array([sizes.get(d, 0) for d in domains], float)
    if np.count_nonzero(sizes) < 2:
        return None
    total = sizes.sum()
    each = [F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    counts = known.select("domain", hashes.alias("word")).groupBy("word").agg(F.count("*").alias("n"), *each).where(F.col("n") >= LEAST_DOCUMENTS)
    surprise = [F.abs(F.col(f"n{k}") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1) for k, share in enumerate((sizes / total).tolist())]
    best = counts.withColumn("surprise", F.greatest(*surprise)).where(F.col("surprise") >= SURPRISE).orderBy(F.desc("surprise"), "word").limit(WORDS).collect()
    table, odds = np.zeros(SLOTS, np.int64), np.zeros((SLOTS, len(domains)))
    for r in best:
        if not table[slot := r["word"] % SLOTS]:  # of words with the same slot the most surprising one stays
            share = r["n"] / total
            table[slot] = r["word"]
            odds[slot] = [np.log((r[f"n{k}"] + PRIOR * share) / (size + PRIOR) / share) for k, size in enumerate(sizes)]
    return table, odds.round(3)


def constants(values: np.ndarray, kind: str) -> Column:
    """An array that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def with_bins(rows: DataFrame, learned: tuple[np.ndarray, np.ndarray] | None) -> tuple[DataFrame, list[str]]:
    """``rows`` (text, ...) with tokens and the bins of all measures, the text only beside ROW; and the names of the bins. Words are looked up once for all domains."""
    kept = [c for c in rows.columns if c != "text" or ROW in rows.columns]
    bins = measures(F.col("text"))
    if learned is not None:
        table, odds = learned
        slot = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
        rows = rows.withColumn("_hits", F.filter(stems(F.col("text")), lambda h: F.get(constants(table, "bigint"), slot(h)) == h))
        total = lambda k: F.aggregate("_hits", F.lit(0.0), lambda t, h: t + F.get(constants(odds[:, k], "double"), slot(h)))
        bins |= {f"_w{k}": F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(total(k)) + BINS // 2)).cast("int") for k in range(odds.shape[1])}
    return rows.select(*kept, *(c.alias(k) for k, c in bins.items())), [c for c in bins if c != "tokens"]


def learn(measured: DataFrame, labelled: DataFrame, domains: list[str], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log priors and log likelihoods [measure, bin, domain]; ``measured`` has doc_id and the bins ``names``, ``labelled`` doc_id, domain and half.

    Priors and shapes are counted over all labelled documents, the evidence of words over those of half 1.
    """
    known = measured.join(labelled, "doc_id")
    rows = known.select("domain", "half", F.posexplode(F.array(*names)).alias("measure", "bin")).groupBy("domain", "half", "measure", "bin").agg(F.count("*").alias("n")).collect()  # at most domains x measures x 64 rows
    counts, sizes = np.full((len(names), BINS, len(domains)), 0.5), np.zeros(len(domains))
    for r in rows:
        if r["measure"] == 0:
            sizes[domains.index(r["domain"])] += r["n"]
        if r["measure"] < len(SHAPES) or r["half"] == 1:
            counts[r["measure"], r["bin"], domains.index(r["domain"])] += r["n"]
    return np.log(np.maximum(sizes, 0.5)), np.log(counts / counts.sum(axis=1, keepdims=True))


def posterior(priors: np.ndarray, likelihoods: np.ndarray, names: list[str]) -> list[Column]:
    """Posterior of each domain, from the bins of a row."""
    logs = []
    for k in range(len(priors)):
        total = F.lit(float(priors[k]))
        for m, name in enumerate(names):
            total = total + F.get(constants(likelihoods[m, :, k].round(6), "double"), F.col(name))
        logs.append(total)
    return logs


def clipped(d: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.lit(1.0) - d))


def rate(posteriors: list[Column], shift: np.ndarray, lo: float, hi: float) -> Column:
    """clip(1 - p . shift)."""
    return clipped(dot(posteriors, shift), lo, hi)


def dot(posteriors: list[Column], shift: np.ndarray) -> Column:
    return sum((p * float(s) for p, s in zip(posteriors, shift, strict=True)), F.lit(0.0))


def fit_rates(state: DataFrame, names: list[str], aims: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The shift of all rates; ``state`` has tokens and a posterior column of each name.

    For weight e of the distance, the shift s solves totals(s) - aims - e G s = 0. The left side is the negative gradient of the convex
    dual, a sum over documents of -n (x - 1)^2 / 2 - n x p . s, plus aims . s + e s' G s / 2.
    """
    p, n, k = [F.col(c) for c in names], F.col("tokens"), len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def square(row, prefix: str) -> np.ndarray:
        out = np.zeros((k, k))
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"{prefix}{i}_{j}"] or 0.0
        return out

    size = max(float(state.agg(F.sum("tokens")).first()[0] or 0.0), 1e-9)
    n, aims = n / size, aims / size
    gram = square(state.agg(*(F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)).first(), "g")

    def dual(d: Column) -> Column:
        """Of the documents' part of the dual at a shift, from p . shift."""
        x = clipped(d, lo, hi)
        return F.sum(-n * ((x - 1.0) * (x - 1.0) / 2 + x * d))

    def value(total: float | None, shift: np.ndarray, ridge: float) -> float:
        return (total or 0.0) + aims @ shift + ridge / 2 * shift @ gram @ shift

    def at(shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, the sum of n p p' over documents whose rate is within its bounds, and the documents' part of the dual."""
        d = F.col("_d")
        x, free = clipped(d, lo, hi), (1.0 - d > lo) & (1.0 - d < hi)
        rows = state.withColumn("_d", dot(p, shift)).withColumns({"_x": x, "_free": free})
        row = rows.agg(*(F.sum(n * p[i] * F.col("_x")).alias(f"t{i}") for i in range(k)), *(F.sum(F.when(F.col("_free"), n * p[i] * p[j])).alias(f"g{i}_{j}") for i, j in pairs), dual(d).alias("d")).first()
        return np.array([row[f"t{i}"] or 0.0 for i in range(k)]), square(row, "g"), row["d"]

    shift, left = np.zeros(k), STEPS
    totals, curvature, sums = at(shift)
    for ridge in RIDGES:
        while abs(gradient := totals - aims - ridge * gram @ shift).sum() > CLOSE * max(aims.sum(), 1e-9):
            if not left:
                raise RuntimeError(f"mixing: rates did not converge in {STEPS} steps")
            left -= 1
            step = np.linalg.pinv(curvature + ridge * gram, rcond=1e-12, hermitian=True) @ gradient
            before = value(sums, shift, ridge)
            further = shift + step
            now = at(further)
            if value(now[2], further, ridge) >= before:
                shorter = [shift + step / 2**h for h in range(1, HALVINGS)]
                row = state.agg(*(dual(dot(p, x)).alias(f"d{m}") for m, x in enumerate(shorter))).first()
                values = [value(row[f"d{m}"], x, ridge) for m, x in enumerate(shorter)]
                if min(values) >= before - 1e-14 * max(1.0, abs(before)):
                    break  # as near as double precision goes
                further = shorter[int(np.argmin(values))]
                now = at(further)
            shift, (totals, curvature, sums) = further, now
    missed = totals - aims
    if abs(missed).sum() > 1e-3 * max(aims.sum(), 1e-9):
        logging.getLogger(__name__).warning("mixing: targets are out of reach of rates from %g to %g: missed by %s of all tokens", lo, hi, dict(zip(names, missed.round(4).tolist(), strict=True)))
    return shift


def folded(labelled: DataFrame, targets: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """doc_id, domain, half of each labelled document, domains without a target as one; and the domains that there are."""
    other = OTHER
    while other in targets:
        other += "_"
    domain = F.when(F.col("domain").isin(list(targets)), F.col("domain")).otherwise(other)
    known = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    known = known.select("doc_id", domain.alias("domain"), (F.xxhash64("doc_id", F.lit(3)).bitwiseAND(F.lit(1))).cast("int").alias("half"))
    there = {r["domain"] for r in known.select("domain").distinct().collect()}  # domains with a target, and OTHER
    return known, [d for d in [*sorted(targets), other] if d in there]


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], lo: float = 0.0, hi: float = 4.0, budget: float = 1.0) -> DataFrame:
    """doc_id, tokens, domain, posterior, rate, copies of every row of ``docs`` (doc_id, text), as ``mix``, from one pass over the texts."""
    return _mixed(docs.select("doc_id", "text"), labelled, targets, lo, hi, budget).select("doc_id", *OWN)


OWN = ["tokens", "domain", "posterior", "rate", "copies"]


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], lo: float = 0.0, hi: float = 4.0, budget: float = 1.0) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) but those named as the new ones: tokens, domain, posterior (of that domain), rate, copies.

    ``targets``: weight of each domain in the expected tokens; their sum is ``budget`` times all tokens. copies is the rate rounded up or down
    by a hash of the id, so that its mean is the rate.
    """
    kept = [c for c in docs.columns if c.lower() not in OWN]
    rows = _mixed(sealed(docs), labelled, targets, lo, hi, budget)
    return rows.select(*(F.col("text") if c == "text" else F.col(f"{ROW}.`{c}`").alias(c) for c in kept), *OWN)


def repeated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], lo: float = 0.0, hi: float = 4.0, budget: float = 1.0) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), all columns, each as often as its copies say."""
    rows = _mixed(sealed(docs), labelled, targets, lo, hi, budget)
    # A condition on copies would be pushed to the scan, with all that copies are made of written out for each use.
    rows = rows.select("text", ROW, F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).where("one is not null")
    return opened(rows, docs.columns)


def _mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], lo: float, hi: float, budget: float) -> DataFrame:
    """``docs`` (doc_id, text, and ROW or not) with the columns OWN, without ROW in one pass over the texts after learning."""
    known, domains = folded(labelled, targets)
    weight = sum(targets.get(d, 0.0) for d in domains)
    if not weight:
        flat = docs.withColumn("tokens", measures(F.col("text"))["tokens"])
        return flat.withColumns({"domain": F.lit(None).cast("string"), "posterior": F.lit(0.0), "rate": F.lit(1.0), "copies": F.lit(1).cast("long")})
    known = cut(known)
    learned = learn_words(docs, known.where("half = 0").select("doc_id", "domain"), domains)
    measured, bin_names = with_bins(docs.select("doc_id", "text"), learned)
    measured = cut(measured)
    priors, likelihoods = learn(measured, known, domains, bin_names)
    names = [f"_p{k}" for k in range(len(domains))]

    def with_posteriors(rows: DataFrame) -> DataFrame:
        logs = [f"_l{k}" for k in range(len(domains))]
        rows = rows.withColumns(dict(zip(logs, posterior(priors, likelihoods, bin_names), strict=True)))
        top = F.greatest(*logs) if len(logs) > 1 else F.col(logs[0])
        rows = rows.withColumns({c: F.exp(F.col(g) - top) for c, g in zip(names, logs, strict=True)})
        total = sum((F.col(c) for c in names), F.lit(0.0))
        return rows.withColumns({c: F.col(c) / total for c in names}).drop(*logs)

    # Rows of equal bins have equal posteriors and so equal rates: the steps work on their sums.
    state = cut(with_posteriors(measured.groupBy(*bin_names).agg(F.sum("tokens").alias("tokens"))).select("tokens", *names))
    tokens = state.agg(F.sum("tokens").alias("n")).first()["n"] or 0.0
    aims = np.array([targets.get(d, 0.0) / weight for d in domains]) * tokens * budget
    shift = fit_rates(state, names, aims, lo, hi)
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    domain = F.coalesce(*(F.when(F.col(c) == top, F.lit(d)) for c, d in zip(names, domains, strict=True)))
    rows = with_bins(docs, learned)[0] if ROW in docs.columns else measured
    rows = with_posteriors(rows).withColumns({"domain": domain, "posterior": top, "rate": rate([F.col(c) for c in names], shift, lo, hi)})
    even = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    return rows.withColumn("copies", (F.floor("rate") + F.when(even < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: toxic, or else good or poor."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))
