"""Text quality by Bradley-Terry ranking of documents.

Every text becomes a vector of surface measures, each spread over bins whose edges
are quantiles of the training texts, so that a linear score can bend. Pairs of a
better and a worse text are drawn from labelled rows; logistic loss on the
difference of their vectors gives the weights (Bradley-Terry with features). The
cut between good and bad is the score quantile at the share of bad texts.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietband.llm.common import slices, store
from quietband.llm.labelled import MAX_LABELLED, held_out, training_texts

BINS = 12
# Preference pairs the weights are learned from.
MAX_PAIRS = 100_000


def measures(text: str) -> list[float]:
    """Surface measures of one whole text; an empty text gives zeros."""
    words, size = text.split(), len(text)
    count = len(words)
    if not count:
        return [0.0] * 20
    raw = text.encode("utf-8", "replace")
    lines = text.split("\n")
    folded = text.lower()
    letters = sum(map(str.isalpha, words))
    return [
        math.log1p(count),
        size / count,
        len(set(words)) / count,
        Counter(words).most_common(1)[0][1] / count if count > 1 else 0.0,
        sum(map(operator.eq, words, words[1:])) / count,
        sum(map(str.isupper, words)) / count,
        sum(map(str.istitle, words)) / count,
        letters / count,
        1 - len(set(lines)) / len(lines),
        count / len(lines),
        len(zlib.compress(raw, 1)) / len(raw),
        sum(map(text.count, "#$%&*@=_~^<>")) / count,
        text.count("!") / count,
        text.count("|") / count,
        text.count(".") / count,
        text.count(",") / count,
        sum(map(text.count, "0123456789")) / size,
        sum(map(folded.count, "aeiouáéíóúàèêäöü")) / size,
        max(map(len, words)),
        size - len(raw.decode("ascii", "ignore")),
    ]


def spread(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Indicator of the bin of each measure, one row per text."""
    place = (values[:, :, None] > edges[None, :, :]).sum(axis=2)
    out = np.zeros((len(values), values.shape[1], edges.shape[1] + 1))
    np.put_along_axis(out, place[:, :, None], 1.0, axis=2)
    return out.reshape(len(values), -1)


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int = 5, ridge: float = 1.0) -> np.ndarray:
    """Weights that rank each good text of a pair above the bad one, by Newton's method."""
    rng = np.random.default_rng(seed)
    count = min(pairs, 8 * max(len(good), len(bad)))
    w = np.zeros(good.shape[1])
    first, second = rng.integers(len(good), size=count), rng.integers(len(bad), size=count)
    scale = max(len(good), len(bad)) / count  # pairs repeat texts: weigh them as texts
    for _ in range(25):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for at in range(0, count, 10_000):
            d = good[first[at : at + 10_000]] - bad[second[at : at + 10_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient = gradient - scale * (d.T @ p)
            hessian = hessian + scale * ((d * (p * (1 - p))[:, None]).T @ d)
        change = np.linalg.solve(hessian, gradient)
        w = w - change
        if np.abs(change).max() < 1e-6:
            break
    return w


def _measured(df: DataFrame, keep: list[str], score=None) -> DataFrame:
    """``keep`` columns with the measures ``x`` of the text, or with ``score`` of them."""
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    name, kind, typed = ("x", "array<double>", pa.list_(pa.float64())) if score is None else ("_score", "double", pa.float64())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep)):
                rows = [measures(t or "") for t in part.column(len(keep)).to_pylist()]
                values = rows if score is None else score(np.array(rows))
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(values, typed)], names=keep + [name])

    return df.select(*keep, "text").mapInArrow(emit, f"{fields}, {name} {kind}")


class QualityModel:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, cut: float):
        self.edges, self.weights, self.cut = edges, weights, cut

    @staticmethod
    def fit(docs, labels, label="quality", folds=3, fold=1, id_col="doc_id", text_col="text", limit=MAX_LABELLED):
        """Learn from labelled rows outside the held-out fold, at most ``limit`` of them.

        Without labels of both kinds no pair exists: the score is then 1 if only label 1
        was seen, else 0.
        """
        texts = store(training_texts(docs, labels, label, folds, fold, id_col, text_col, limit), "labelled")
        rows = _measured(texts, ["label"]).collect()
        y = np.array([r["label"] for r in rows], int)
        if not len(y) or y.min() == y.max():
            sure = -math.inf if len(y) and y.max() == 1 else math.inf
            return QualityModel(np.zeros((20, 1)), np.zeros(40), sure)
        x = np.array([r["x"] for r in rows], float)
        edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        wide = spread(x, edges)
        weights = bradley_terry(wide[y == 1], wide[y == 0], MAX_PAIRS)
        return QualityModel(edges, weights, float(np.quantile(wide @ weights, (y == 0).mean())))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, _score)`` for every row; at least 0.5 where the rank lies above the cut.

        NULL texts are scored as empty ones. No other column is an input.
        """
        edges, weights, cut = self.edges, self.weights, self.cut

        def score(x: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(spread(x, edges) @ weights - cut, -30, 30)))

        named = docs.select(F.col(id_col).alias("k0"), F.col(text_col).alias("text"))
        return _measured(named, ["k0"], score).withColumnRenamed("k0", id_col)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    scored = QualityModel.fit(docs, labels).score(docs)
    return scored.select(
        "doc_id",
        held_out("doc_id", 3, 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
