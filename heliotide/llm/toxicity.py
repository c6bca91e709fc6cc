"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Tokens are the words of a text and their first characters (a stem with another
ending is still known). From labelled rows each token gets the log-odds of
occurring in a toxic rather than a clean text under a Dirichlet prior, lowered by
its own standard error. A word scores its best token, any other word a small
negative drift. One linear scan per text finds every maximal segment of positive
total. Segment scores follow an extreme-value law, whose two constants come from
clean labelled texts; the passages of a text are put together by their
significance, and a logistic fit turns that into a probability.

The fit uses at most about ``FIT_ROWS`` labelled rows, taken by the hash of their
id, so all that is broadcast is bounded: those ids, the tokens they hold in
toxic texts, and the lexicon.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliotide.llm.arrow import ids_and_texts
from heliotide.llm.quality import logistic
from heliotide.llm.words import NOT_LOWER_ALNUM, Words, mix, slices, span_hashes, split
from heliotide.session import cut_lineage

FIT_ROWS = 200_000
SUPPORT = 3
PRIOR = 2.0
ERRORS = 1.5
LEAST_SCORE = 0.5
SIGNIFICANT = 0.5
STEMS = (4, 5, 7)
_BINS = 120


def tokens_of(words: Words) -> np.ndarray:
    """Token hashes, one row per word: the word itself, then its first bytes; a word too short repeats its own hash."""
    out = np.empty((len(words.starts), 1 + len(STEMS)), dtype=np.uint64)
    out[:, 0] = words.hashes
    for k, n in enumerate(STEMS):
        longer = words.ends - words.starts > n
        stem = span_hashes(words.data, words.starts, np.minimum(words.ends, words.starts + n))
        out[:, k + 1] = np.where(longer, mix(stem + np.uint64(n)), words.hashes)
    return out


def _words(data: np.ndarray, texts: np.ndarray) -> Words:
    return split(data, texts, NOT_LOWER_ALNUM, lower=True)


@dataclass(frozen=True)
class Model:
    """Lexicon (sorted token hashes and their scores), drift, extreme-value constants and logistic line."""

    tokens: np.ndarray
    scores: np.ndarray
    base: float
    drift: float = 0.5
    decay: float = 1.0
    level: float = 1.0
    line: tuple[float, float] | None = None

    def word_scores(self, words: Words) -> np.ndarray:
        """The best token score of each word; 0 where none of its tokens is in the lexicon."""
        best = np.zeros(len(words.starts))
        if len(self.tokens) == 0 or len(best) == 0:
            return best
        low = np.zeros(1 << 16, dtype=bool)
        low[(self.tokens & np.uint64(0xFFFF)).astype(np.int64)] = True
        hashes = tokens_of(words)
        for k in range(hashes.shape[1]):
            maybe = np.flatnonzero(low[(hashes[:, k] & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.tokens, hashes[maybe, k]), len(self.tokens) - 1)
            hit = self.tokens[place] == hashes[maybe, k]
            np.maximum.at(best, maybe[hit], self.scores[place[hit]])
        return best

    def segments(self, best: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first word, end word, score) of one text, in order."""
        at = np.flatnonzero(best > 0)
        return maximal_segments(at.tolist(), best[at].tolist(), self.drift)

    def evidence(self, segments: list[tuple[int, int, float]], n_words: int) -> float:
        """Sum over significant segments of -ln of the chance of such a score in a clean text of this length."""
        total = 0.0
        for _, _, score in segments:
            expected = self.level * n_words * math.exp(-self.decay * score)
            chance = -math.expm1(-expected)
            if chance < SIGNIFICANT:
                total -= math.log(max(chance, 1e-300))
        return total

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.line is None:
            return np.full(len(evidence), self.base)
        slope, level = self.line
        return 1 / (1 + np.exp(-np.clip(slope * np.log1p(evidence) + level, -30, 30)))


def maximal_segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments when word ``at[i]`` scores ``scores[i] > 0`` and any other word ``-drift``.

    The linear-time algorithm of Ruzzo and Tompa: candidates are kept with the
    running total to their left and right; a new one merges with the nearest
    earlier candidate of smaller left total if that raises the right total.
    """
    kept: list[list] = []  # first word, end word, total to the left, total to the right, place of that earlier candidate
    total, last = 0.0, -1
    for place, score in zip(at, scores):
        total -= drift * (place - last - 1)
        new = [place, place + 1, total, total + score, -1]
        total, last = total + score, place
        j = len(kept) - 1
        while True:
            # What lies between a candidate and its own earlier one has no smaller left total: hop over it.
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            first, _, left, _, earlier = kept[j]
            new = [first, new[1], left, new[3], -1]
            del kept[j:]
            j = earlier
    return [(a, b, right - left) for a, b, left, right, _ in kept]


def _per_text(words: Words, values: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        yield values[a:b]


def sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """About ``rows`` labelled rows at most (``doc_id, label``), by the hash of the id; one label per id, the toxic one if they differ."""
    clean = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = min(1.0, rows / max(1, clean.count()))
    return clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label``: 1 toxic, 0 clean)."""
    # The sample has a bounded number of rows, so this side can be broadcast.
    # Written once, as five steps read it; the documents themselves are read for this only.
    known = cut_lineage(ids_and_texts(docs).join(F.broadcast(sample(labels, rows)), "doc_id").select("text", "label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    base = (n1 + 1) / (n1 + n0 + 2)
    empty = Model(np.empty(0, np.uint64), np.empty(0), base)
    if not n1 or not n0:
        return empty
    toxic = _counts(known.where("label = 1"), None).where(F.col("n") >= SUPPORT).toPandas()
    candidates = np.sort(toxic["token"].to_numpy().astype(np.int64).view(np.uint64))
    in_toxic = dict(zip(toxic["token"], toxic["n"]))
    in_clean = {r["token"]: r["n"] for r in _counts(known.where("label = 0"), candidates).collect()}
    token = np.fromiter(in_toxic, dtype=np.int64, count=len(in_toxic))
    y1 = np.array([in_toxic[t] for t in token.tolist()], dtype=float)
    y0 = np.array([in_clean.get(t, 0) for t in token.tolist()], dtype=float)
    share = (y1 + y0) / (n1 + n0)
    a1, a0 = PRIOR * share + 0.05, PRIOR * share + 0.05
    log_odds = np.log((y1 + a1) / (n1 + PRIOR - y1)) - np.log((y0 + a0) / (n0 + PRIOR - y0))
    safe = log_odds - ERRORS * np.sqrt(1 / (y1 + a1) + 1 / (y0 + a0))
    # Unseen in clean texts, the second term alone would outweigh any count: bound it by the rule of three.
    unseen = np.log((y1 + a1) / n1) - np.log(3.0 / n0) - ERRORS / np.sqrt(y1 + a1)
    score = np.where(y0 == 0, np.maximum(safe, unseen), safe)
    # So many tokens are looked at that some are one-sided by chance: ask for a likelihood ratio beyond their number.
    fair = n1 / (n1 + n0)
    ratio = y1 * np.log(y1 / ((y1 + y0) * fair)) + np.where(y0 > 0, y0 * np.log(np.maximum(y0, 1) / ((y1 + y0) * (1 - fair))), 0.0)
    keep = (score >= LEAST_SCORE) & (ratio >= math.log(len(token)) - 1)
    order = np.argsort(token[keep].view(np.uint64))
    model = Model(token[keep].view(np.uint64)[order], score[keep][order], base)
    return _calibrated(known, model, n1, n0) if keep.any() else empty


def _counts(rows: DataFrame, candidates: np.ndarray | None) -> DataFrame:
    """``token, n``: in how many texts each token occurs (only candidates, if given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, texts in slices(batch.column("text")):
                words = _words(data, texts)
                hashes = tokens_of(words)
                of = np.repeat(words.text_of(), hashes.shape[1])
                hashes = hashes.ravel()
                if candidates is not None:
                    place = np.minimum(np.searchsorted(candidates, hashes), len(candidates) - 1)
                    inside = candidates[place] == hashes if len(candidates) else np.zeros(len(hashes), bool)
                    of, hashes = of[inside], hashes[inside]
                order = np.lexsort((of, hashes))
                of, hashes = of[order], hashes[order]
                new = np.ones(len(of), dtype=bool)
                new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
                token, n = np.unique(hashes[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return rows.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _calibrated(known: DataFrame, model: Model, n1: int, n0: int) -> Model:
    """Extreme-value constants from clean texts, then the logistic line over the evidence of all fitted texts."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_seen, found = 0, []
        for batch in batches:
            for _, _, data, texts in slices(batch.column("text")):
                words = _words(data, texts)
                best = model.word_scores(words)
                words_seen += len(best)
                found.append(np.round(best[best > 0], 2))
        score, n = np.unique(np.concatenate(found) if found else np.empty(0), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[0.0, score]), pa.array(np.r_[words_seen, n].astype(np.int64))], names=["score", "n"])

    seen = known.where("label = 0").select("text").mapInArrow(totals, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()
    words_seen = max(1, sum(r["n"] for r in seen if r["score"] == 0.0))
    score = np.array([r["score"] for r in seen if r["score"] > 0] + [float(model.scores.mean())])
    share = np.array([r["n"] for r in seen if r["score"] > 0] + [1.0]) / (words_seen + 1)
    rest = max(1e-9, 1 - share.sum())
    drift = max(model.drift, 2 * float((share * score).sum()) / rest)
    decay = _decay(score, share, rest, drift)
    level = float((share * np.exp(np.minimum(decay * score, 50))).sum())
    model = Model(model.tokens, model.scores, model.base, drift, decay, max(level, 1e-6))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, _BINS))
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for row, _, data, texts in slices(batch.column("text")):
                words = _words(data, texts)
                for k, best in enumerate(_per_text(words, model.word_scores(words))):
                    z = math.log1p(model.evidence(model.segments(best), len(best))) if best.any() else 0.0
                    count[label[row + k], min(_BINS - 1, math.ceil(z * 10))] += 1
        c, b = np.indices(count.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (c, b, count)], names=["c", "b", "n"])

    count = np.zeros((2, _BINS))
    for r in known.mapInArrow(evidence, "c bigint, b bigint, n double").groupBy("c", "b").agg(F.sum("n").alias("n")).collect():
        count[r["c"], r["b"]] = r["n"]
    line = logistic(np.arange(_BINS) / 10, count[0], count[1])
    return Model(model.tokens, model.scores, model.base, model.drift, model.decay, model.level, line)


def _decay(score: np.ndarray, share: np.ndarray, rest: float, drift: float) -> float:
    """The positive root of E[exp(decay * word score)] = 1 over clean words."""
    low, high = 1e-6, 20.0

    def excess(x: float) -> float:
        return float((share * np.exp(np.minimum(x * score, 500))).sum() + rest * math.exp(-x * drift)) - 1

    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, passages`` for every row: the probability and the significant passages.

    ``passages`` holds structs of first word, end word (exclusive), text from the
    first to the last word (lower-cased) and score. Null or empty texts have no
    passage and the score of no evidence; rows with a null or repeated doc_id
    are scored one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for row, last, data, texts in slices(batch.column("text")):
                words = _words(data, texts)
                scores = model.word_scores(words)
                evidence, passages = np.zeros(last - row), [[] for _ in range(last - row)]
                positive = np.unique(words.text_of()[scores > 0])
                for t in positive.tolist():
                    a, b = words.first[t], words.first[t + 1]
                    best = scores[a:b]
                    segments = model.segments(best)
                    evidence[t] = model.evidence(segments, len(best))
                    for first, end, score in segments:
                        if model.level * len(best) * math.exp(-model.decay * score) < SIGNIFICANT:
                            text = words.data[words.starts[a + first] : words.ends[a + end - 1]].tobytes().decode("utf-8", "replace")
                            passages[t].append({"first": first, "end": end, "text": text, "score": score})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, last - row), pa.array(model.probability(evidence)), pa.array(passages, kind)],
                    names=["doc_id", "score", "passages"],
                )

    return ids_and_texts(docs).mapInArrow(run, "doc_id bigint, score double, passages array<struct<first:int,end:int,text:string,score:double>>")
