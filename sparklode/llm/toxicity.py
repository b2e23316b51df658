"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window is WORDS words of running text in lower case. Every window of a text is compressed with both dictionaries; its distance is how many
bytes longer it gets with the ordinary one. Both are trained on a bounded, documented sample of labelled documents, of which near copies are
left out. Toxic documents are mostly ordinary text, so what the two classes share must cost the same with either: the ordinary dictionary is
what zstandard's trainer makes of ordinary windows; the toxic one begins with the same, entropy tables included, and ends in what is trained
on toxic windows, where the other has as many zeros. That comes from a contrastive cover: pieces of MER bytes count by the documents of the class that have them beyond what the other class lets
expect; the segments of running text that cover most of that count are taken one by one, and what is covered counts no more.
(Trained by the library alone, on windows of toxic text, the toxic dictionary fills with prose: see the README for figures.)

A document's measures are how many of its windows, and how large a share of them, are at least 1, 2, ..., STEPS bytes apart. A logistic
calibration weighs these thresholds and turns them into a score. It is fitted on each half of the sample with dictionaries of the other half, so
on documents that these haven't seen; the dictionaries that are used then come from the whole sample. The intercept is such that at 0.5 one clean document is lost for COST toxic ones caught, if both are as frequent.

Defined results: null and empty texts score what a text without windows scores; without labels of both classes all
scores are 0.0; with a single document of a class it serves for training and for calibration; any text length is read whole; repeated rows
score alike; rows with a null id are scored; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ._common import fold, prepare, sample_texts

PER_CLASS = 2000  # most labelled documents of each class that the model is fitted on
WORDS, LEVEL = 12, 3
SHARED_BYTES, OWN_BYTES = 16 << 10, 2 << 10  # of a dictionary: what both begin with, and what the toxic one has besides
TRAINED_ON = 40_000  # windows of ordinary text that the library's trainer sees
MER, JOINED = 6, 2  # bytes of a piece; how far apart pieces of one segment may begin
LIFT, LEAST, ONE_IN = 8, 3, 80  # a piece counts beyond LIFT times what the other class lets expect, and LEAST documents, and one in ONE_IN
COST = 3.0  # toxic documents kept that weigh as much as a clean one lost
STEPS = 8  # distances from 1 to this many bytes are told apart
AT_ONCE = 1 << 14  # windows compressed in one call


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().split()
    return [f" {' '.join(words[i : i + WORDS])} ".encode("utf-8", "replace") for i in range(0, len(words), WORDS)]


def _pieces(data: bytes) -> np.ndarray:
    """Each run of MER bytes as a number, by position."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(b) - MER + 1
    return sum((b[i : n + i] << (8 * i) for i in range(MER)), np.zeros(n, np.int64)) if n > 0 else np.zeros(0, np.int64)


def _documents_with(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces, and the number of documents that have each."""
    found = [np.unique(_pieces(d)) for d in documents]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def contrastive_cover(own: list[list[bytes]], other: list[list[bytes]], size: int) -> bytes:
    """Segments of the windows of ``own`` documents that cover most of what these have beyond ``other`` ones, ``size`` bytes at most; the best one last."""
    own, other = ([b"\n".join(d) for d in side] for side in (own, other))
    piece, n = _documents_with(own)
    known, m = _documents_with(other)
    there = np.zeros(len(piece))
    same = np.isin(piece, known)
    there[same] = m[np.searchsorted(known, piece[same])]
    beyond = n - LIFT * there * len(own) / max(1, len(other)) - LEAST - len(own) / ONE_IN
    told = piece[beyond > 0]
    worth = dict(zip(told.tolist(), beyond[beyond > 0].tolist(), strict=True))
    segments = set()
    for text in own:
        hit = np.flatnonzero(np.isin(_pieces(text), told))
        segments.update(s for run in np.split(hit, np.flatnonzero(np.diff(hit) > JOINED) + 1) if len(run) for s in text[run[0] : run[-1] + MER].split(b"\n") if len(s) >= MER)
    value = lambda s: sum(worth.get(p, 0.0) for p in np.unique(_pieces(s)).tolist())
    heap, out, room = [(-value(s), s) for s in segments], [], size
    heapq.heapify(heap)
    while heap:
        before, segment = heapq.heappop(heap)
        if (now := value(segment)) <= 0 or len(segment) > room:
            continue
        if now < -before - 1e-9:
            heapq.heappush(heap, (-now, segment))
            continue
        out.append(segment)
        room -= len(segment)
        for p in _pieces(segment).tolist():
            worth.pop(p, None)
    return b"".join(reversed(out))


def shared_dictionary(documents: list[list[bytes]]) -> bytes:
    """The library's dictionary of ordinary windows; of too few for its trainer, their text as it is."""
    every = [w for d in documents for w in d]
    some = [every[i] for i in np.random.default_rng(5).permutation(len(every))[:TRAINED_ON]]
    try:
        return zstandard.train_dictionary(SHARED_BYTES, some, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(some)[-SHARED_BYTES:].rjust(64, b" ")


class Distance:
    """Distances of windows by the two dictionaries."""

    def __init__(self, model: dict):
        self.compressors = [self._compressor(model["shared"], model[k]) for k in ("ordinary", "toxic")]

    @staticmethod
    def _compressor(shared: bytes, own: bytes):
        content = shared + own.rjust(OWN_BYTES, b"\0")  # as long as each other: what both hold costs the same
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=8 * WORDS, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def __call__(self, some: list[bytes]) -> np.ndarray:
        out = []
        for start in range(0, len(some), AT_ONCE):
            part = some[start : start + AT_ONCE]
            ordinary, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(part)), np.int64, len(part)) for c in self.compressors)
            out.append(ordinary - toxic)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """A row for each list of windows: log(1 + windows at least k bytes apart) for k of 1 to STEPS, the same for their share, and for all windows."""
        ends = np.cumsum([len(t) for t in texts])
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        far = np.clip(self([w for t in texts for w in t]), 0, STEPS)
        table = np.bincount(row * (STEPS + 1) + far, minlength=len(texts) * (STEPS + 1)).reshape(-1, STEPS + 1) if len(ends) else np.zeros((0, STEPS + 1))
        over = table[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
        size = table.sum(axis=1, keepdims=True)
        return np.log1p(np.c_[over, 20 * over / np.maximum(size, 1), size])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the intercept."""
    x1, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * len(x) / 100 * np.eye(len(w))
        step = np.linalg.solve(hessian, x1.T @ (y - p) - ridge * len(x) / 100 * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def _distinct(texts: list[str]) -> list[list[bytes]]:
    """Windows of the texts without near copies of texts before them, whose ordinary words would look like those of their class."""
    seen, out = set(), []
    for text in texts:
        long = {w for w in text.lower().split() if len(w) > 7}
        if len(long) < 8 or len(long & seen) <= 0.5 * len(long):
            out.append(windows(text))
        seen |= long
    return out


def fit(sample: list[tuple[str, str]]) -> dict | None:
    """Model of (label, text) pairs, label "1" for toxic: what both dictionaries begin with, what each has of its own, the calibration."""
    sides = {k: [t for label, t in sample if label == k] for k in ("0", "1")}
    if not all(sides.values()):
        return None
    halves = [{k: v[i::2] for k, v in sides.items()} for i in range(2)]
    x, y = [], []
    for trained, held in (halves, halves[::-1]):
        distance = Distance(_dictionaries({k: trained[k] or held[k] for k in sides}))
        for k, texts in held.items():
            x.append(distance.features([windows(t) for t in texts]))
            y += [k == "1"] * len(texts)
    weights = logistic(np.concatenate(x), np.array(y, float))
    weights[-1] -= np.log(COST)
    return _dictionaries(sides) | {"weights": weights}


def _dictionaries(sides: dict[str, list[str]]) -> dict[str, bytes]:
    """What both dictionaries begin with, and what each has besides, from the texts of each class."""
    toxic, ordinary = _distinct(sides["1"]), _distinct(sides["0"])
    return {"shared": shared_dictionary(ordinary), "ordinary": b"", "toxic": contrastive_cover(toxic, ordinary, OWN_BYTES)}


def _scores(distance: Distance, weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    x = distance.features([windows(t.as_py()) for t in texts])
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ weights, -30, 30)))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)

    def scored(batches):
        distance = model and Distance(model)
        for batch in batches:
            scores = _scores(distance, model["weights"], batch.column(1)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")


def learn(docs: DataFrame, labels: DataFrame, learnable=None, per_class: int = PER_CLASS) -> dict | None:
    rows = labels.where(learnable) if learnable is not None else labels
    return fit(sample_texts(docs, rows.select("doc_id", F.col("toxic").cast("string").alias("label")), per_class))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of fold 0 of 5 are never learned from."""
    model = learn(docs, labels, fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text, ...) that score under ``limit``, all columns; rows are judged where they are, nothing is shuffled."""
    prepare(docs.sparkSession)
    place = docs.columns.index("text")

    def judged(batches):
        distance = model and Distance(model)
        for batch in batches:
            yield batch.filter(pa.array(_scores(distance, model["weights"], batch.column(place)) < limit)) if model and batch.num_rows else batch

    return docs.mapInArrow(judged, docs.schema)
