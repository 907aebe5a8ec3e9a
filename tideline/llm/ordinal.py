"""Ordinal cumulative-link regression on hashed text: one weight vector shared by all thresholds.

P(grade > k) = s(w x - t_k), with s the logistic function and thresholds t_0 <= t_1 <= ...; a text gets its expected
grade (the sum of grade values by their probabilities) and the tail probability P(grade >= cut). Weights are fitted on
the driver on a bounded sample of labelled rows (``most_labels``, those whose ids hash lowest, so reruns agree; of each at
most ``most_features``, those that hash lowest), with an L1 penalty that falls with the root of their number; a fifth of
the sample is held out to choose the decision threshold, then the model is fitted on all of it. Scoring covers every row
and whole texts.

Defined results: null and empty texts have no features and get the grade of the bare thresholds (the quality stage
rejects them, the toxicity stage passes them); rows with null ids or null grades do not train; of rows with one id the
one whose text hashes lowest does, once for each of its grades; if fewer than two grades
are labelled, every text gets that grade (0 if none) and is accepted; equal rows are scored alike. An empty table gives
an empty result. Other columns are not read; ids pass through as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import mix, span_hashes

MOST_LABELS = 6_000
MOST_FEATURES = 20_000
Features = Callable[[list[str | None], "np.ndarray | None"], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Model:
    grades: np.ndarray  # ascending values
    thresholds: np.ndarray  # one fewer
    at: np.ndarray  # indices of weights that are not zero, ascending
    weights: np.ndarray
    decide: float = 0.5  # on the tail probability
    cut: float = 0.0  # grades from here on are the tail

    def score(self, rows: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        if not len(self.at):
            return np.zeros(n)
        place = np.minimum(np.searchsorted(self.at, index), len(self.at) - 1)
        return np.bincount(rows, np.where(self.at[place] == index, self.weights[place], 0) * value, n)

    def grade(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and tail probability."""
        if len(self.grades) < 2:
            only = self.grades[0] if len(self.grades) else 0.0
            return np.full(len(score), float(only)), np.full(len(score), float(only >= self.cut))
        over = _logistic(score[:, None] - self.thresholds[None, :])
        expected = self.grades[0] + (over * np.diff(self.grades)).sum(axis=1)
        k = int(np.searchsorted(self.grades, self.cut))
        return expected, over[:, min(max(k - 1, 0), over.shape[1] - 1)] if k else np.ones(len(score))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, dims: int, l1: float, cut: float, least_rows: int = 2, steps: int = 120, rate: float = 0.1) -> Model:
    """Full-batch proximal Adam on the mean negative log-likelihood; rows numbers the samples of ``grade``. Features of
    fewer than least_rows samples get no weight."""
    n = len(grade)
    grades, y = np.unique(grade, return_inverse=True)
    if len(grades) < 2:
        return Model(grades, np.empty(0), np.empty(0, np.int64), np.empty(0), cut=cut)
    common = np.bincount(index, minlength=dims)[index] >= least_rows
    rows, value, index = rows[common], value[common], index[common]
    del common
    used = np.flatnonzero(np.bincount(index, minlength=dims))
    place = np.zeros(dims, np.int64)
    place[used] = np.arange(len(used))
    index = place[index]
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    share = np.cumsum(np.bincount(y))[:-1] / n
    first = np.log(share / (1 - share))
    # thresholds as a first one and the logs of the gaps, so that they stay ordered
    t = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    tm, tv = np.zeros_like(t), np.zeros_like(t)
    for step in range(1, steps + 1):
        theta = t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:]))))
        s = np.bincount(rows, w[index] * value, n)
        ends = np.concatenate(([-np.inf], theta, [np.inf]))
        up, low = _logistic(ends[y + 1] - s), _logistic(ends[y] - s)
        p = np.maximum(up - low, 1e-12)
        g = np.bincount(index, (1 - up - low)[rows] * value, len(used)) / n
        d_up, d_low = -up * (1 - up) / p, low * (1 - low) / p
        d_theta = (np.bincount(y, d_up, len(grades))[:-1] + np.bincount(y, d_low, len(grades))[1:]) / n
        dt = np.concatenate(([d_theta.sum()], [d_theta[k:].sum() * np.exp(t[k]) for k in range(1, len(t))]))
        b1, b2 = 1 - 0.9**step, 1 - 0.999**step
        for x, grad, mm, vv in ((w, g, m, v), (t, dt, tm, tv)):
            mm += 0.1 * (grad - mm)
            vv += 0.001 * (grad * grad - vv)
            move = rate / (np.sqrt(vv / b2) + 1e-8)
            x -= move * mm / b1
            if x is w and l1:
                x[:] = np.sign(x) * np.maximum(np.abs(x) - np.minimum(move * l1, rate), 0)
    theta = t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:]))))
    own = np.flatnonzero(w)
    return Model(grades.astype(float), theta, used[own].astype(np.int64), w[own], cut=cut)


def train(docs: DataFrame, labels: DataFrame, grade_col: str, features: Features, dims: int, l1: float, cut: float, keep_good: float, most_labels: int = MOST_LABELS, most_features: int = MOST_FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """keep_good: the share of held-out rows on the accepted side (tail for quality, body for toxicity, by its sign)
    that the decision threshold must keep there; none goes for which the tail tells otherwise. l1: the penalty of a
    single row."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(grade_col).cast("double").alias("grade"))
    known = known.orderBy(F.xxhash64(F.lit(17), "id"), "id", "grade").limit(most_labels)  # the bound; so it may be broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), F.col("_id") == F.col("id"))
    rows = rows.groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            row, index, value = features(batch.column(2).to_pylist(), None)
            edges = np.searchsorted(row, np.arange(len(batch) + 1))
            kept = [a + _lowest(index[a:b], most_features) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            sparse = [pa.array([of[k].astype(kind).tobytes() for k in kept], pa.binary()) for of, kind in ((index, "<u4"), (value, "<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *sparse], ["id", "grade", "index", "value"])

    sample = rows.mapInArrow(run, "id long, grade double, index binary, value binary").toArrow()
    ids = sample.column("id").to_numpy()
    order = np.lexsort((sample.column("grade").to_numpy(), ids))
    grade = sample.column("grade").to_numpy()[order]
    index, value = ([np.frombuffer(sample.column(c)[i].as_py(), kind) for i in order.tolist()] for c, kind in (("index", "<u4"), ("value", "<f4")))
    held = mix(ids[order].astype(np.uint64)) % np.uint64(5) == 0
    del sample

    def matrix(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(own).tolist()
        rows_ = np.repeat(np.arange(len(at)), [len(index[i]) for i in at])
        join = lambda parts, kind: np.concatenate([parts[i] for i in at]).astype(kind) if at else np.empty(0, kind)
        return rows_, join(index, np.int64), join(value, np.float64), grade[own]

    penalty = lambda n: l1 / max(1, n) ** 0.5
    model = fit(*matrix(~held), dims, penalty((~held).sum()), cut)
    decide = model.decide
    r, i, v, y = matrix(held)
    if len(y) and len(model.grades) > 1:
        tail = model.grade(model.score(r, i, v, len(y)))[1]
        good, bad = (tail[y >= cut], tail[y < cut]) if keep_good > 0 else (tail[y < cut], tail[y >= cut])
        if len(good) and len(bad):
            # between the two sides where they part cleanly, else where the accepted side keeps its share
            edge = np.quantile(good, 1 - keep_good if keep_good > 0 else -keep_good)
            other = np.quantile(bad, 0.99 if keep_good > 0 else 0.005)
            apart = other < edge if keep_good > 0 else other > edge
            decide = float(np.clip((edge + other) / 2 if apart else edge, 1e-6, 1 - 1e-6))
            decide = min(decide, 0.5) if keep_good > 0 else max(decide, 0.5)  # few held-out rows tell little
    model = fit(*matrix(np.ones(len(held), bool)), dims, penalty(len(held)), cut)
    model.decide = decide
    return model


def _lowest(index: np.ndarray, most: int) -> np.ndarray:
    """The places of the features that a row may train with, in order."""
    if len(index) <= most:
        return np.arange(len(index))
    return np.sort(np.argsort(mix(index.astype(np.uint64)), kind="stable")[:most])


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of few rows: the features of a batch of the session's size would take much memory."""
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def score(docs: DataFrame, model: Model, features: Features, dims: int, id_col: str = "doc_id", text_col: str = "text", above: bool = True) -> DataFrame:
    """(id_col, expected, tail, decided): decided tells whether the tail probability reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(max(dims, 1), bool)
        wanted[model.at] = True
        for batch in _small(batches):
            row, index, value = features(batch.column(1).to_pylist(), wanted)
            expected, tail = model.grade(model.score(row, index, value, len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= model.decide if len(model.grades) > 1 else np.full(len(batch), above))], [id_col, "expected", "tail", "decided"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, expected double, tail double, decided boolean")


def select(docs: DataFrame, model: Model, features: Features, dims: int, text_col: str = "text") -> DataFrame:
    """The rows of docs whose tail probability reaches the threshold, in one pass and without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(max(dims, 1), bool)
        wanted[model.at] = True
        for batch in _small(batches):
            row, index, value = features(batch.column(text_col).to_pylist(), wanted)
            yield batch.filter(pa.array(model.grade(model.score(row, index, value, len(batch)))[1] >= model.decide))

    return docs.mapInArrow(run, docs.schema) if len(model.grades) > 1 else docs


QUALITY_DIMS = 1 << 14


def quality_features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed triples of bytes (logs of counts, of length 1), and the shares of repeated words and of capitals."""
    rows, index, value = [], [], []
    for i, t in enumerate(texts):
        b = np.frombuffer(t.encode("utf-8", "replace"), np.uint8) if t else np.empty(0, np.uint8)
        if len(b) < 3:
            continue
        total = np.zeros(QUALITY_DIMS, np.int64)
        for low in range(0, len(b) - 2, 1 << 18):
            x = b[low : low + (1 << 18) + 2].astype(np.uint32)
            total += np.bincount(((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(18)).astype(np.int64), minlength=QUALITY_DIMS)
        at = np.flatnonzero(total)
        v = np.log1p(total[at])
        w = t.split()
        same = sum(map(str.__eq__, w, w[1:])) / max(1, len(w) - 1)
        capitals = ((b >= 65) & (b <= 90)).mean()
        letters = (((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128) | (b == 32)).mean()
        index += [at, np.arange(QUALITY_DIMS, QUALITY_DIMS + 4)]
        value += [v / np.sqrt((v * v).sum()), np.array([same, capitals, 1 - letters, len(set(w)) / max(1, len(w))])]
        rows.append(np.full(len(at) + 4, i))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(index), np.concatenate(value)


TOXIC_BITS = 20
#: Letters in lower case; every other byte below 128 parts words.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def toxic_features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence of hashed words and of hashed word beginnings of 4 and 5 bytes; wanted marks those that carry weight."""
    parts, size, low = [], 0, 0
    for high in range(1, len(texts) + 1):
        size += len(texts[high - 1] or "")
        if size < 1 << 21 and high < len(texts):
            continue
        lines = [(t or "").encode("utf-8", "replace") for t in texts[low:high]]
        data = _FOLD[np.frombuffer(b"\0".join(lines) + b"\0", np.uint8)]
        edge = np.diff(np.concatenate(([0], data != 0)).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(np.cumsum([len(x) + 1 for x in lines]), starts, "right") + low
        keys = []
        for kind, length in enumerate((1 << 30, 4, 5)):
            own = np.arange(len(starts)) if not kind else np.flatnonzero(ends - starts > length)
            h = mix(span_hashes(data, starts[own], np.minimum(ends[own], starts[own] + length)) + np.uint64(kind))
            at = (h >> np.uint64(64 - TOXIC_BITS)).astype(np.int64)
            if wanted is not None:
                own, at = own[wanted[at]], at[wanted[at]]
            keys.append(doc[own].astype(np.int64) << TOXIC_BITS | at)
        parts.append(np.unique(np.concatenate(keys)))
        size, low = 0, high
    keys = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return keys >> TOXIC_BITS, keys & ((1 << TOXIC_BITS) - 1), np.ones(len(keys))


def quality(docs: DataFrame, labels: DataFrame, cut: float = 1.0, keep_good: float = 0.999, **bound: int) -> DataFrame:
    """(doc_id, expected, tail, decided): decided is True for the documents to keep."""
    model = train(docs, labels, "quality", quality_features, QUALITY_DIMS + 4, 1.5e-4, cut, keep_good, **bound)
    return score(docs, model, quality_features, QUALITY_DIMS + 4)


def good_documents(docs: DataFrame, labels: DataFrame, labelled: DataFrame, cut: float = 1.0, keep_good: float = 0.999, **bound: int) -> DataFrame:
    """The rows of docs to keep, by a model fitted on the labelled documents."""
    model = train(labelled, labels, "quality", quality_features, QUALITY_DIMS + 4, 1.5e-4, cut, keep_good, **bound)
    return select(docs, model, quality_features, QUALITY_DIMS + 4)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 1.0, pass_clean: float = 0.999, **bound: int) -> DataFrame:
    """(doc_id, expected, tail, decided): decided is True for toxic documents."""
    model = train(docs, labels, "toxic", toxic_features, 1 << TOXIC_BITS, 0.01, cut, -pass_clean, **bound)
    return score(docs, model, toxic_features, 1 << TOXIC_BITS, above=False)
