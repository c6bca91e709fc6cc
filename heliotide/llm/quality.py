"""Quality by a regularised quadratic discriminant over document statistics.

Each document becomes a short vector of transformed statistics (shares of kinds
of signs, lengths, repetition). Per class the labelled vectors are reduced to
counts, sums and products, so nothing but a few hundred numbers leaves the
executors. Each class covariance is shrunk towards the pooled one and towards
its own mean variance; its Cholesky factor is computed once. A score is the
difference of the two Gaussian log-densities, put on the probability scale by a
one-dimensional logistic fit over a histogram of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide.llm.arrow import ids_and_texts
from heliotide.llm.words import slices, span_hashes, split

NEAR_POOLED = 0.15
NEAR_ROUND = 0.02
FLOOR = 1e-4
THRESHOLD = 0.3
#: A pipeline fits on about so many labelled rows at most.
FIT_ROWS = 200_000
_BINS = 200

#: Kinds of bytes whose share of a text is a statistic.
KINDS = ("lower", "upper", "digit", "blank", "line", "stop", "comma", "loud", "bar", "mark", "bracket", "beyond")
STATISTICS = (*KINDS, "words", "word_length", "word_spread", "distinct", "again", "pairs", "top", "odd_end", "shouted", "lines")


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("bracket"), dtype=np.uint8)
    for name, signs in (
        ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
        ("blank", " \t"), ("line", "\n\r\x0b\x0c"), ("stop", ".:;"), ("comma", ",'\"-"), ("loud", "!?"),
        ("bar", "|\\/_=+~^<>"), ("mark", "#$%&*@"),
    ):
        kind[[ord(c) for c in signs]] = KINDS.index(name)
    kind[0x80:] = KINDS.index("beyond")
    return kind


_KIND = _kinds()


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive entries of ``first``; empty stretches give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def statistics(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; finite for every text, empty ones included."""
    n = len(texts) - 1
    kind = _KIND[data]
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(texts))
    counts = np.bincount(owner * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, len(KINDS)).astype(np.float64)
    size = np.maximum(np.diff(texts), 1).astype(np.float64)
    shares = np.arcsin(np.sqrt(counts / size[:, None]))

    words = split(data, texts)
    first, hashes = words.first, words.hashes
    n_words = np.diff(first).astype(np.float64)
    some = np.maximum(n_words, 1.0)
    lengths = (words.ends - words.starts).astype(np.float64)
    mean = _sum_by(lengths, first) / some
    spread = np.sqrt(np.maximum(_sum_by(lengths**2, first) / some - mean**2, 0.0))
    of = words.text_of()
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    distinct, top = _distinct(of, hashes, n)
    pair = span_hashes(hashes, np.arange(max(len(hashes) - 1, 0)), np.arange(1, len(hashes)) + 1) if len(hashes) > 1 else hashes[:0]
    inside = of[1:] == of[:-1]
    pairs, _ = _distinct(of[1:][inside], pair[inside], n)
    last = _KIND[data[words.ends - 1]] if len(hashes) else np.empty(0, np.uint8)
    head = _KIND[data[words.starts]] if len(hashes) else np.empty(0, np.uint8)
    odd = np.isin(last, [KINDS.index(k) for k in ("loud", "bar", "mark", "bracket")])
    second = _KIND[data[np.minimum(words.starts + 1, words.ends - 1)]] if len(hashes) else head
    shouted = (head == KINDS.index("upper")) & (second == KINDS.index("upper")) & (lengths > 1)
    more = np.column_stack([
        np.log1p(n_words) / 4, np.log1p(mean), np.log1p(spread), np.arcsin(np.sqrt(distinct / some)),
        np.arcsin(np.sqrt(_sum_by(again, first) / some)), np.arcsin(np.sqrt(np.minimum(pairs / np.maximum(n_words - 1, 1), 1))),
        np.arcsin(np.sqrt(top / some)), np.arcsin(np.sqrt(_sum_by(odd, first) / some)),
        np.arcsin(np.sqrt(_sum_by(shouted, first) / some)), np.log1p(counts[:, KINDS.index("line")]) / 4,
    ])
    return np.hstack([shares, more])


def _distinct(of: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of distinct hashes and the count of the commonest."""
    count, top = np.zeros(n), np.zeros(n)
    if len(hashes):
        order = np.lexsort((hashes, of))
        of, hashes = of[order], hashes[order]
        edge = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])])
        run = np.diff(np.r_[edge, len(of)])
        np.add.at(count, of[edge], 1)
        np.maximum.at(top, of[edge], run)
    return count, top


@dataclass(frozen=True)
class Model:
    """Two class densities (mean, inverse Cholesky factor, log-determinant) and the logistic line over their difference.

    Without both classes among the labels there is no density; every score is then ``base``.
    """

    base: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    log_dets: tuple[float, float] = (0.0, 0.0)
    line: tuple[float, float] = (1.0, 0.0)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 minus that of class 0."""
        distance = [((x - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors)]
        return 0.5 * (distance[0].sum(1) - distance[1].sum(1) + self.log_dets[0] - self.log_dets[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.base)
        slope, level = self.line
        return 1 / (1 + np.exp(-np.clip(slope * _squash(self.difference(x)) + level, -30, 30)))


def _squash(difference: np.ndarray) -> np.ndarray:
    """Signed logarithm: Gaussian log-densities far from the data say more than is known."""
    return np.sign(difference) * np.log1p(np.abs(difference))


def statistics_of(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, last, data, texts in slices(batch.column("text")):
                x = statistics(data, texts)
                column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, last - row), column], names=["doc_id", "x"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id bigint, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def fit(labelled: DataFrame) -> Model:
    """Model from rows ``x, label`` (0 or 1; others are left out). Every row counts."""
    p = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, p + 1, p + 1))
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.hstack([np.ones((len(y), 1)), _matrix(batch.column("x"))])
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        c, i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (c, i, j, total)], names=["c", "i", "j", "v"])

    rows = labelled.where(F.col("label").isin(0, 1)).select("x", F.col("label").cast("int").alias("label"))
    sums = np.zeros((2, p + 1, p + 1))
    for r in rows.mapInArrow(moments, "c bigint, i bigint, j bigint, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["c"], r["i"], r["j"]] = r["v"]
    n = sums[:, 0, 0]
    base = (n[1] + 1) / (n.sum() + 2)
    if n.min() < 2:
        return Model(base)
    means = [sums[c, 0, 1:] / n[c] for c in (0, 1)]
    own = [sums[c, 1:, 1:] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, log_dets = [], []
    for c in (0, 1):
        shrunk = (1 - NEAR_POOLED - NEAR_ROUND) * own[c] + NEAR_POOLED * pooled
        shrunk += (NEAR_ROUND * np.trace(own[c]) / p + FLOOR) * np.eye(p)
        root = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(root))
        log_dets.append(2 * float(np.log(np.diag(root)).sum()))
    model = Model(base, tuple(means), tuple(factors), tuple(log_dets))
    return Model(base, model.means, model.factors, model.log_dets, _line(rows, model))


def _line(rows: DataFrame, model: Model) -> tuple[float, float]:
    """Logistic line over the squashed difference, from a histogram of the labelled rows."""
    width = 20.0 / _BINS

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _BINS))
        for batch in batches:
            y = batch.column("label").to_numpy(zero_copy_only=False)
            z = np.clip((_squash(model.difference(_matrix(batch.column("x")))) + 10) / width, 0, _BINS - 1).astype(int)
            np.add.at(total, (y, z), 1)
        c, b = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (c, b, total)], names=["c", "b", "n"])

    count = np.zeros((2, _BINS))
    for r in rows.mapInArrow(bins, "c bigint, b bigint, n double").groupBy("c", "b").agg(F.sum("n").alias("n")).collect():
        count[r["c"], r["b"]] = r["n"]
    return logistic((np.arange(_BINS) + 0.5) * width - 10, count[0], count[1])


def logistic(z: np.ndarray, negatives: np.ndarray, positives: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and level of a logistic fit to counts at ``z``, by damped Newton steps; a small ridge bounds the slope."""
    a, b = 1.0, 0.0
    n = negatives + positives

    def loss(a: float, b: float) -> float:
        t = a * z + b
        return float((np.logaddexp(0, t) * n - positives * t).sum() + ridge * (a * a + b * b) / 2)

    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([((n * q - positives) * z).sum() + ridge * a, (n * q - positives).sum() + ridge * b])
        w = n * q * (1 - q)
        h = np.array([[(w * z * z).sum() + ridge, (w * z).sum()], [(w * z).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        scale = 1.0
        while scale > 1e-6 and loss(a - scale * step[0], b - scale * step[1]) > loss(a, b):
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() * scale < 1e-9:
            break
    return float(a), float(b)


def scored(vectors: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for rows of ``statistics_of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return vectors.mapInArrow(run, "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(statistics(data, texts)) >= threshold for _, _, data, texts in slices(batch.column("text"))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
