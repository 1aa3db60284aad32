"""Text quality from positive and unlabelled examples.

A small network over character statistics minimises the non-negative unbiased
risk: trusted positives, unlabelled web text, and a class prior estimated from
the two.  Its output is turned into a probability on labelled rows.

The unlabelled text is every document: means, scales, the prior and the risk are
taken over all of them.  Statistics are computed once and written down.  Training
goes in synchronised rounds: each task takes gradient steps over its rows from the
common network, against the positives that all tasks have, and the tasks' networks
are averaged by their rows.

Whole texts count.  A null or empty text has all statistics zero; equal texts
get equal scores.  Ids may be null or repeated.  An empty table gives no rows.
Without trusted positives every score is the share of positives among labelled
rows, or 0.5.  Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import chosen_labels, fold
from .storage import Scratch, keep_columns
from .toxicity import logistic

_PUNCTUATION = bytes(b for b in range(33, 127) if not bytes([b]).isalnum())


def _classes() -> np.ndarray:
    """Lower case, upper case, digit, space, line end, common mark, other mark, beyond ASCII."""
    table = np.full(256, 7, np.uint8)
    for k, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:'\"?!-()")):
        table[list(members)] = k
    rest = [b for b in range(128) if table[b] == 7]
    table[rest] = 6
    return table


_CLASSES: list[np.ndarray] = []
FEATURES = len(_PUNCTUATION) + 64 + 8 + 9


def features(text: bytes) -> np.ndarray:
    """Shares of marks, of character classes and of their successions; word and line statistics."""
    if not _CLASSES:
        _CLASSES.append(_classes())
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return np.zeros(FEATURES)
    kinds = _CLASSES[0][data]
    marks = np.bincount(data, minlength=256)[list(_PUNCTUATION)] / n
    steps = np.bincount(kinds[:-1].astype(np.int64) * 8 + kinds[1:], minlength=64) / n
    shares = np.bincount(kinds, minlength=8) / n
    parts = text.lower().split()
    words, kinds_of_word = max(1, len(parts)), len(set(parts))
    again = sum(map(bytes.__eq__, parts, parts[1:]))
    lines = text.split(b"\n")
    distinct = len(set(lines))
    return np.r_[np.sqrt(marks), np.sqrt(steps), np.sqrt(shares), np.log1p(n) / 10, np.log1p(words) / 10, n / words / 10, kinds_of_word / words, np.sqrt(again / words), kinds_of_word / words**0.8, 1 - distinct / len(lines), np.log1p(n / len(lines)) / 10, len(lines) > 1]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    slope: float = 1.0
    intercept: float = 0.0
    prior: float = 0.5

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(self.standard(x) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.intercept, -30, 30)))


def _loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sigmoid loss of margin z and its derivative."""
    s = 1 / (1 + np.exp(np.clip(z, -30, 30)))
    return s, -s * (1 - s)


def start_layers(hidden: int = 16, seed: int = 7) -> list[np.ndarray]:
    random = np.random.default_rng(seed)
    return [random.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]


class Trainer:
    """Steps of Adam against the non-negative risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the
    second part is negative, a step is taken against it."""

    def __init__(self, layers: list[np.ndarray], positive: np.ndarray, prior: float, rate: float, seed: int):
        self.layers, self.positive, self.prior, self.rate = [w.copy() for w in layers], positive, prior, rate
        self.first, self.second, self.steps = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
        self.random = np.random.default_rng(seed)

    def epoch(self, unlabelled: np.ndarray, batch: int = 512) -> None:
        order = self.random.permutation(len(unlabelled))
        for start in range(0, len(order), batch):
            self.step(unlabelled[order[start : start + batch]], self.positive[self.random.integers(0, len(self.positive), min(batch, len(self.positive)))])

    def step(self, u: np.ndarray, p: np.ndarray) -> None:
        w, prior = self.layers, self.prior
        hp, hu = np.tanh(p @ w[0] + w[1]), np.tanh(u @ w[0] + w[1])
        zp, zu = hp @ w[2] + w[3], hu @ w[2] + w[3]
        (_, dpp), (ln, dpn), (lu, dun) = _loss(zp), _loss(-zp), _loss(-zu)
        if lu.mean() - prior * ln.mean() >= 0:
            gp, gu = (prior * dpp + prior * dpn) / len(zp), -dun / len(zu)
        else:
            gp, gu = -prior * dpn / len(zp), dun / len(zu)
        grads = [np.zeros_like(x) for x in w]
        for x, h, g in ((p, hp, gp), (u, hu, gu)):
            back = np.outer(g, w[2]) * (1 - h * h)
            for k, part in enumerate((x.T @ back, back.sum(0), h.T @ g, g.sum())):
                grads[k] = grads[k] + part
        self.steps += 1
        for k, g in enumerate(grads):
            g = g + 1e-4 * w[k]
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            w[k] = w[k] - self.rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)


_ROWS_DDL = "doc_id long, held_out boolean, half int, features binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("half", pa.int32()), ("features", pa.binary())])
#: Rows that a task holds at a time.
_HELD = 1 << 15


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statistics of each text, as single floats; a text's hash tells which half it is in."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            raw = [(t.as_py() or "").encode() for t in part.column(2)]
            found = [features(t).astype("<f4").tobytes() for t in raw]
            half = [zlib.crc32(t) & 1 for t in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(half, pa.int32()), pa.array(found, pa.binary())], schema=_ROWS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, FEATURES).astype(np.float64)


_SUMS, _SUMS_DDL = pa.schema([("sums", pa.binary())]), "sums binary"


def _sums(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in parts:
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], schema=_SUMS)


def _summed(rows: DataFrame, per_batch) -> np.ndarray | None:
    """The sum over all tasks of what per_batch yields for their batches, in two steps; None where there are no rows."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sums(per_batch(batches))

    def of_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sums(np.frombuffer(x, "<f8") for batch in batches for x in batch.column(0).to_pylist())

    found = rows.select("features").mapInArrow(of_task, _SUMS_DDL).repartition(8).mapInArrow(of_sums, _SUMS_DDL).collect()
    return sum((np.frombuffer(r["sums"], "<f8") for r in found), np.zeros(1)) if found else None


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            yield np.r_[len(x), x.sum(0), (x * x).sum(0)]


def train(rows: DataFrame, count: int, model: QualityModel, positive: np.ndarray, prior: float, rounds: int = 6, steps: int = 500, batch: int = 512, rate: float = 5e-3) -> list[np.ndarray]:
    """Layers after the rounds, from the start.  Few rows are passed often: all rounds have some ``steps`` in sum."""
    layers = start_layers()
    epochs = max(1, -(-steps * batch // (rounds * max(1, count))))
    sp = model.standard(positive)
    for k in range(rounds):
        shared, its_rate = (layers, sp, prior), rate / (1 + k)

        def steps_of_task(batches: Iterator[pa.RecordBatch], shared=shared, its_rate=its_rate) -> Iterator[np.ndarray]:
            trainer, seen, held = Trainer(*shared, its_rate, 7), 0, []
            for batch_ in itertools.chain(batches, [None]):
                if batch_ is not None and batch_.num_rows:
                    held.append(_matrix(batch_.column(0)))
                if held and (batch_ is None or sum(map(len, held)) >= _HELD):
                    x = model.standard(np.concatenate(held))
                    for _ in range(epochs):
                        trainer.epoch(x, batch)
                    seen += len(x)
                    held.clear()
            if seen:
                yield seen * np.r_[1.0, *(w.ravel() for w in trainer.layers)]

        total = _summed(rows, steps_of_task)
        if total is None:
            break
        mean, at, layers = total[1:] / total[0], 0, []
        for w in shared[0]:
            layers.append(mean[at : at + w.size].reshape(w.shape))
            at += w.size
    return layers


def estimate_prior(rows: DataFrame, count: int, model: QualityModel, positive: np.ndarray) -> float:
    """Share of positives among all rows.  For every set A, P_u(A) >= prior * P_p(A): the least ratio over upper sets
    of a positive-against-unlabelled classifier, with margins for the sample sizes.  One half of the positives
    and of the rows trains the classifier, the other half is counted."""
    half = len(positive) // 2
    if half < 10 or count < 20:
        return 0.5
    layers = train(rows.filter("half = 0"), count // 2, model, positive[:half], 0.5, rounds=2, steps=200)
    judge = QualityModel(model.mean, model.scale, layers)
    p = np.sort(judge.margin(positive[half:]))
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                z = np.sort(judge.margin(_matrix(batch.column(0))))
                yield np.r_[len(z), len(z) - np.searchsorted(z, cuts)].astype(float)

    total = _summed(rows.filter("half = 1"), above)
    if total is None:
        return 0.5
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), total[1:] / total[0]
    spread = np.sqrt(np.log(20) / 2)
    upper = (above_u + spread / np.sqrt(total[0])) / np.maximum(above_p - spread / np.sqrt(len(p)), 1e-6)
    best = int(np.argmin(np.where(above_p > 0.1, upper, np.inf)))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def calibrate(model: QualityModel, positive: np.ndarray, negative: np.ndarray, totals: dict[int, int]) -> None:
    """Slope and intercept by labelled rows; sampled classes are weighed back to their shares among all of them."""
    if not len(negative):
        return
    z = np.r_[model.margin(positive), model.margin(negative)]
    y = np.repeat([1.0, 0.0], [len(positive), len(negative)])
    share = totals[1] / (totals[0] + totals[1])
    weight = np.where(y == 1, share / len(positive), (1 - share) / len(negative)) * len(z)
    model.slope, model.intercept = map(float, logistic(z[:, None], y, weight))


def fit(rows: DataFrame, chosen: DataFrame, totals: dict[int, int]) -> QualityModel | None:
    """From the rows of all documents and the chosen labels (1 are the trusted positives); None without positives."""
    labelled = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("features").alias("features")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    xp, xn = (np.array([np.frombuffer(r["features"], "<f4") for r in labelled if r["label"] == label], np.float64).reshape(-1, FEATURES) for label in (1, 0))
    moments = _summed(rows, _moments)
    if not len(xp) or moments is None:
        return None
    count, sums, squares = moments[0], moments[1 : FEATURES + 1], moments[FEATURES + 1 :]
    mean = sums / count
    model = QualityModel(mean, np.maximum(np.sqrt(np.maximum(squares / count - mean * mean, 0)), 1e-3), [])
    model.prior = estimate_prior(rows, int(count), model, xp)
    model.layers = train(rows, int(count), model, xp, model.prior)
    calibrate(model, xp, xn, totals)
    return model


def scorer(model: QualityModel | None, otherwise: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch.column(2))) if model and batch.num_rows else np.full(batch.num_rows, otherwise)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = 3000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.  Fitted on all texts and at most rows_per_class labels
    of a class, chosen by a hash of the id."""
    chosen, totals = chosen_labels(labels, label_col, rows_per_class)
    rows = keep_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string"))
    rows = Scratch(docs.sparkSession, "quality").save(rows.mapInArrow(_described, _ROWS_DDL), "rows")
    model = fit(rows, chosen, totals)
    seen = sum(totals.values())
    scored = rows.select("doc_id", "held_out", "features").mapInArrow(scorer(model, totals.get(1, 0) / seen if seen else 0.5), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
