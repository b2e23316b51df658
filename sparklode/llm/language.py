"""Language identification: averaged hashed subword embeddings under a linear softmax.

A document is the mean over its words of the mean embedding of each word's character n-grams, hashed into a fixed table. Table and
softmax are trained by stochastic gradient descent in numpy on a bounded, documented sample of labelled documents.
A temperature and a rejection threshold are calibrated on documents of the sample that the descent has not seen.
As both layers are linear, a word adds fixed amounts to the logits; a worker works them out once for each distinct word.

Defined results: null texts and texts without a letter are ``und`` with score 0.0; so is everything where nothing can
be learned; rows without a label are not learned from; any text length is read whole; columns beside the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import fold, prepare, sample_texts

PER_CLASS = 300  # most labelled documents of each language that the model is fitted on
BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (2, 3, 4)
EPOCHS, RATE, BATCH = 6, 20.0, 32
ACCEPTED = 0.99  # share of accepted calibration documents that must be right
UNDETERMINED = "und"
CACHE = 300_000


def letters(token: str) -> list[str]:
    """Runs of letters of a token that has no white space."""
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram of the words, bounded by < and >, and the number of its word."""
    bounded = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(bounded.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    found, of = [], []
    for n in GRAMS:
        inside = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :]) if len(word) >= n else np.zeros(0, np.int64)
        h = np.full(len(inside), n, np.uint32)
        for i in range(n):
            h = (h ^ codes[inside + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        found.append(h % np.uint32(BUCKETS))
        of.append(word[inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


def document(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, which add up to 1; empty without letters."""
    words: Counter = Counter()
    for token, n in Counter(text.lower().split()).items():
        for word in letters(token):
            words[word] += n
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    found, of = buckets(list(words))
    share = np.fromiter(words.values(), float, len(words)) / sum(words.values()) / np.bincount(of)
    total = np.bincount(found, share[of], BUCKETS)
    own = np.flatnonzero(total)
    return own, total[own]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: list[tuple[str, str]], seed: int = 11) -> dict | None:
    """Model of (label, text) pairs: folded bucket table, bias, temperature, threshold."""
    found = [(label, *document(text)) for label, text in sample]
    found = [x for x in found if len(x[1])]
    classes = sorted({label for label, *_ in found})
    if not classes:
        return None
    random = np.random.default_rng(seed)
    order = random.permutation(len(found))
    held, learned = order[: len(found) // 4], order[len(found) // 4 :]
    target = np.array([classes.index(label) for label, *_ in found])
    table, layer, bias = random.normal(0, 0.1, (BUCKETS, WIDTH)), random.normal(0, 0.1, (WIDTH, len(classes))), np.zeros(len(classes))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(random.permutation(learned), max(1, len(learned) // BATCH)):
            means = np.array([found[i][2] @ table[found[i][1]] for i in part])
            error = softmax(means @ layer + bias)
            error[np.arange(len(part)), target[part]] -= 1
            back = error @ layer.T
            layer -= rate / len(part) * means.T @ error
            bias -= 0.01 * rate / len(part) * error.sum(axis=0)
            for i, step in zip(part, back, strict=True):
                table[found[i][1]] -= rate / len(part) * found[i][2][:, None] * step
    folded = table @ layer
    check = held if len(held) else learned
    logits = np.array([found[i][2] @ folded[found[i][1]] + bias for i in check])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(check)), target[check]] + 1e-12).mean()
    temperature = min(2.0 ** np.arange(-5, 6.5, 0.5), key=loss)
    score = softmax(logits / temperature)
    right, best = score.argmax(axis=1) == target[check], score.max(axis=1)
    threshold = 1.0
    for t in sorted(best, reverse=True):
        if right[best >= t].mean() >= ACCEPTED:
            threshold = t
    return {"classes": classes, "folded": folded, "bias": bias, "temperature": float(temperature), "threshold": float(threshold)}


class Scorer:
    """Logits of texts, with what each distinct token adds to them kept."""

    def __init__(self, model: dict):
        self.model, self.rows, self.kept = model, {}, np.zeros((1024, len(model["classes"]) + 1))

    def add(self, tokens: list[str]) -> None:
        """Work out rows for tokens that have none."""
        if len(self.rows) + len(tokens) > CACHE:
            self.rows.clear()
        words, owner = [], []
        for at, token in enumerate(tokens, len(self.rows)):
            self.rows[token] = at
            for word in letters(token):
                words.append(word)
                owner.append(at)
        while len(self.kept) < len(self.rows):
            self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
        fresh = self.kept[len(self.rows) - len(tokens) : len(self.rows)]
        fresh[:] = 0
        if words:
            found, of = buckets(words)
            size, first = np.bincount(of), len(self.rows) - len(tokens)
            owner = np.array(owner) - first
            for c in range(fresh.shape[1] - 1):
                fresh[:, c] = np.bincount(owner, np.bincount(of, self.model["folded"][found, c]) / size, len(tokens))
            fresh[:, -1] = np.bincount(owner, minlength=len(tokens))

    def logits(self, text: str | None) -> np.ndarray | None:
        """None without letters."""
        found = Counter((text or "").lower().split())
        total = np.zeros(self.kept.shape[1])
        tokens = list(found)
        for start in range(0, len(tokens), CACHE // 2):  # any text fits, part by part
            part = tokens[start : start + CACHE // 2]
            if new := [t for t in part if t not in self.rows]:
                self.add(new)
                if len(self.rows) == len(new):  # the table was begun anew
                    self.add([t for t in part if t not in self.rows])
            rows = [self.rows[t] for t in part]
            total += np.array([found[t] for t in part], float) @ self.kept[rows]
        return (total[:-1] / total[-1] + self.model["bias"]) / self.model["temperature"] if total[-1] else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)

    def predicted(batches):
        scorer = model and Scorer(model)
        for batch in batches:
            names, scores, rejected = [], [], []
            for text in batch.column(1):
                logits = scorer.logits(text.as_py()) if scorer else None
                p = None if logits is None else softmax(logits)
                names.append(UNDETERMINED if p is None else model["classes"][int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
                rejected.append(p is None or bool(p.max() < model["threshold"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; rows of fold 2 of 4 are never learned from."""
    rows = docs.where(fold("doc_id", 4) != 2).select("doc_id", F.col("lang").alias("label"))
    model = fit(sample_texts(docs, rows, per_class))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
