"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, linear support vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminode.llm.common import fold, replaced
from luminode.llm.words import hashed, pieces, raw, split
from luminode.operators.similar import mix

DIMENSIONS = 1 << 18
FOLDS, HELD_OUT = 3, 1
#: Bound on the labelled rows that the linear model is fitted on, of each class; the log-count
#: ratios are counted over all labelled rows of the learning folds.
FIT_ROWS = 3000
#: Labels up to this many rows are sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
SMOOTHING = 1.0

_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


#: Shape of each byte: upper-case letter, other letter, digit, or the sign itself.
_SHAPE = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def shapes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Keys of the words' shapes: letter case, digits and other signs, runs shortened (of signs to three)."""
    kind, at = _SHAPE[data], np.arange(len(data))
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[start] = True
    run = at - np.maximum.accumulate(np.where(fresh, at, 0))
    kept = (run == 0) | ((run < 3) & (kind != 65) & (kind != 97) & (kind != 48))
    place = np.concatenate([[0], np.cumsum(kept)])
    return mix(hashed(kind[kept], place[start], place[stop]) + np.uint64(7))


def features(texts: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, owner, feature): the distinct hashed indicators of some texts at a time, ascending by owner.

    Indicators are words, word pairs, and 1- to 3-grams of word shapes; a word that repeats the one
    before has a shape of its own.
    """
    mask, width = np.uint64(dimensions - 1), np.uint64(dimensions.bit_length() - 1)
    for part in pieces(texts):
        words = split(part)
        n_words = np.diff(words.first)
        word, owner = words.keys(), np.repeat(np.arange(len(part), dtype=np.uint64), n_words)
        left = np.repeat(words.first[1:], n_words) - np.arange(len(word))  # words from here to the text's end
        run = shapes(raw(part)[0], words.start, words.stop)
        repeats = np.zeros(len(word), bool)
        repeats[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        run[repeats] = _STEP
        shape = run
        grams = [(word, 1), (mix(word[:-1] * _ODD + word[1:]), 2)]
        for n in (1, 2, 3):
            grams.append((mix(run + np.uint64(n)), n))
            run = mix(run[:-1] * _ODD + shape[n:])
        marks = [((owner[: len(g)] << width) | (g & mask))[left[: len(g)] >= n] for g, n in grams]
        marks = np.unique(np.concatenate(marks))
        yield len(part), (marks >> width).astype(np.int64), (marks & mask).astype(np.int64)


@dataclass
class Model:
    """Weights already multiplied by the ratios; the ratios scale a text's vector to length 1."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    constant: float | None = None
    steepness: float = 3.0

    def score(self, n: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Scores of n texts from their features."""
        if self.constant is not None:
            return np.full(n, self.constant)
        norm = np.sqrt(np.bincount(owner, np.square(self.ratios[feature].astype(np.float64)), n))
        margin = np.bincount(owner, self.weights[feature], n) / np.where(norm > 0, norm, 1.0) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.steepness * margin, -30.0, 30.0)))


def log_count_ratios(labelled: DataFrame, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, int, int]:
    """Ratio of each feature's share in class 1 and class 0, over all rows (text, label).

    Tasks add up dense counts; one number per feature and class reaches the driver, whatever the
    number of rows. A feature that was never seen has ratio 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((2, dimensions), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            labels, at = batch.column(1).to_numpy(), 0
            rows += np.bincount(labels, minlength=2)
            for n, owner, feature in features(batch.column(0), dimensions):
                own = labels[at + owner]
                at += n
                for k in (0, 1):
                    total[k] += np.bincount(feature[own == k], minlength=dimensions)
        (used,) = np.nonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, dimensions), pa.int32()), pa.array(np.append(total[0][used], rows[0])), pa.array(np.append(total[1][used], rows[1]))], ["feature", "n0", "n1"])

    rows = labelled.select("text", "label").mapInArrow(count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    counts = np.zeros((2, dimensions + 1))
    at = rows.column("feature").to_numpy()
    for k in (0, 1):
        counts[k, at] = rows.column(f"n{k}").to_numpy()
    n0, n1 = counts[0, -1], counts[1, -1]
    if not (n0 and n1):
        return np.zeros(dimensions), int(n0), int(n1)
    share = n1 / (n0 + n1)
    positive = (counts[1, :-1] + SMOOTHING * share) / (n1 + SMOOTHING)
    negative = (counts[0, :-1] + SMOOTHING * (1 - share)) / (n0 + SMOOTHING)
    unseen = math.log(share / (n1 + SMOOTHING)) - math.log((1 - share) / (n0 + SMOOTHING))
    return np.log(positive / negative) - unseen, int(n0), int(n1)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, dimensions: int, cost: float = 1.0, epochs: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """L1-loss linear support vectors with balanced class costs; the bias is a constant feature."""
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    upper, alpha = cost * share, np.zeros(len(y))
    weights, bias, draw = np.zeros(dimensions), 0.0, np.random.default_rng(17)
    diagonal = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in draw.permutation(len(y)):
            gradient = y[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == upper[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / diagonal[i], 0.0), upper[i])
                step = (new - alpha[i]) * y[i]
                weights[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if worst < tolerance:
            break
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, dimensions: int = DIMENSIONS) -> Model:
    """Learns from the labelled documents of the learning folds (crc32(id) mod 3 is not 1).

    Rows with a null id or label are not used; of several labels of a document the lowest counts.
    Log-count ratios cover all of these rows. The linear model takes at most fit_rows of each
    class, chosen by a hash of the id among the labels whose document is there. Without any label every score is 0.5; with labels of one
    class only, that class.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("__id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    known = known.where(fold(F.col("__id"), FOLDS) != HELD_OUT)
    small = labels.count() <= BROADCAST_LABELS
    body = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text"))
    labelled = body.join(F.broadcast(known) if small else known, "__id")
    ratios, n0, n1 = log_count_ratios(labelled, dimensions)
    if not (n0 and n1):
        return Model(ratios, ratios, 0.0, constant=0.5 if n0 == n1 else float(n1 > 0))
    order = F.xxhash64("__id")
    present = known.join(body.select("__id").distinct(), "__id", "left_semi")  # reads the ids only
    chosen = present.where("label = 0").orderBy(order, "__id").limit(fit_rows).union(present.where("label = 1").orderBy(order, "__id").limit(fit_rows))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, owner, feature in features(batch.column(0), dimensions):
                found += np.split(feature.astype(np.int32), np.searchsorted(owner, np.arange(1, n)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["id", "label", "features"])

    # one row per chosen id: the smallest text where rows repeat it
    sample = body.join(F.broadcast(chosen), "__id").groupBy("__id", "label").agg(F.min("text").alias("text")).select("text", "__id", "label")
    picked = sample.mapInArrow(featured, "id long, label int, features array<int>").toArrow().sort_by("id")
    rows = [x.values.to_numpy() for x in picked.column("features").combine_chunks()]
    scaled = [ratios[r] for r in rows]
    values = [v / (math.sqrt(float(v @ v)) or 1.0) for v in scaled]
    weights, bias = dual_coordinate_descent(rows, values, picked.column("label").to_numpy(), dimensions)
    return Model((weights * ratios).astype(np.float32), ratios.astype(np.float32), bias)


def score_quality(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score", dimensions: int = DIMENSIONS) -> DataFrame:
    """Adds `into`, 0 to 1, higher where the text looks like label 1; a null text counts as empty.

    The model is a fixed number of weights, whatever the input. Only the text is read. An input
    column named as `into` is replaced; repeated rows have equal scores.
    """

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = [model.score(*found) for found in features(texts, dimensions)]
            yield pa.array(np.concatenate(scores) if scores else np.empty(0))

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return replaced(docs, **{into: F.arrow_udf(score, "double")(F.col(text))})
