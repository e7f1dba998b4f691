"""Toxicity by a weighted finite-state grammar over the clauses of a text.

Five small transducers read the words of a clause: insult and threat mark words, each
kind with sums of its own; target remembers that somebody is addressed, negation covers
the next words, and reported speech covers the rest of a clause after a verb of saying
or a quotation mark. Their product is one transition table; running it over a clause
tells how each mark is meant: plain, aimed, negated or reported. Marks that are plain
where they stand wait for the end of the clause, whose state says whether anybody was
addressed in it at all: a threat counts as one only then. A logistic model over the
matched clauses gives the score. Insult weights are log-odds of word stems, learned
together with the model from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietband.llm.common import slices, store
from quietband.llm.labelled import MAX_LABELLED, held_out, training_texts

# The closed word classes of the grammar, in English, German, French and Spanish.
NEGATION = set("not no never nor don't isn't aren't nicht kein keine nie pas jamais ni nunca jamás".split())
REPORT = set("said says told wrote claimed quoted sagte sagt schrieb dit disait écrit dijo dice escribió".split())
TARGET = set("you your you're they them he she du dich dir ihr euch tu te toi vous tú usted ustedes".split())
THREAT = set("kill hurt destroy beat shoot töten schlagen tuer frapper matar golpear".split())

STEM_LENGTHS = range(3, 11)
# A stem needs so many toxic occurrences and must be so many times likelier in toxic texts.
STEM_COUNT = 6
STEM_RATIO = 12.0
MAX_STEMS = 20_000
NEGATION_SCOPE = 3
# Ways a mark can be meant, for insults and for threats, and five numbers of the whole text.
PLAIN, AIMED, NEGATED, REPORTED = range(4)
FEATURES = 13

OTHER, INSULT, THREATENS, AIMS, NEGATES, REPORTS = range(6)
_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;\n\"“”«»]").findall
_ENDS = set(".!?;\n")
_QUOTES = set("\"“”«»")
_WORD = r"\p{L}+(?:'\p{L}+)*"


def composed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Product of the insult, threat, target, negation and reported-speech transducers.

    ``step[state, class]`` is the next state and ``meant[state, class]`` what reading a
    word of that class puts out: -1 nothing, else the way an insult (0 to 3) or a threat
    (4 to 7) is meant. ``last[state]`` is the way plain marks turn out to be meant where
    a clause ends.
    """
    states = list(product(range(NEGATION_SCOPE + 1), (0, 1), (0, 1)))
    index = {s: i for i, s in enumerate(states)}
    step = np.zeros((len(states), 6), np.int64)
    meant = np.full((len(states), 6), -1)
    last = np.array([AIMED if aimed else PLAIN for _, aimed, _ in states])
    for (scope, aimed, reported), kind in product(states, range(6)):
        now = (
            NEGATION_SCOPE if kind == NEGATES else max(scope - 1, 0),
            1 if kind == AIMS else aimed,
            1 if kind == REPORTS else reported,
        )
        at = index[scope, aimed, reported]
        step[at, kind] = index[now]
        if kind in (INSULT, THREATENS):
            way = REPORTED if reported else NEGATED if scope else AIMED if aimed else PLAIN
            meant[at, kind] = way + 4 * (kind == THREATENS)
    return step, meant, last


STEP, MEANT, LAST = (t.tolist() for t in composed())


class Grammar:
    """Marks words with classes and weights, remembering words it has met."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.seen = stems, {}

    def mark(self, word: str) -> tuple[int, float]:
        if word in NEGATION:
            return NEGATES, 0.0
        if word in REPORT or word in _QUOTES:
            return REPORTS, 0.0
        if word in TARGET:
            return AIMS, 0.0
        if word in THREAT:
            return THREATENS, 1.0
        for length in range(min(len(word), STEM_LENGTHS[-1]), STEM_LENGTHS[0] - 1, -1):
            weight = self.stems.get(word[:length])
            if weight is not None:
                return INSULT, weight
        return (OTHER, 0.0) if word not in _ENDS else (OTHER, -1.0)

    def features(self, text: str) -> list[float]:
        """Numbers of one text; all 0 where no clause matches."""
        words = _TOKENS(text.lower())
        seen = self.seen
        if len(seen) > 300_000:
            seen.clear()
        for word in set(words):
            if word not in seen:
                seen[word] = self.mark(word)
        marks = list(map(seen.__getitem__, words))
        if not any(kind in (INSULT, THREATENS) for kind, _ in set(marks)):
            return [0.0] * FEATURES
        sums, best, clauses, hits, top = [0.0] * 8, 0.0, 0, 0, 0.0
        state, clause, waits = 0, 0.0, [0.0, 0.0]
        for kind, weight in marks + [(OTHER, -1.0)]:
            if weight < 0:
                way = LAST[state]
                sums[way] += waits[0]
                sums[way + 4] += waits[1]
                if way == AIMED:
                    clause += waits[1]
                clauses += clause > 0
                best, state, clause, waits = max(best, clause), 0, 0.0, [0.0, 0.0]
                continue
            way = MEANT[state][kind]
            if way >= 0:
                if way % 4 == PLAIN:
                    waits[way // 4] += weight
                else:
                    sums[way] += weight
                if kind == INSULT:
                    top = max(top, weight)
                if kind == INSULT or way % 4 != PLAIN:
                    clause += weight
                    hits += 1
            state = STEP[state][kind]
        return [math.log1p(s) for s in sums] + [best, top, math.log1p(clauses), math.log1p(hits), clauses / len(words)]


def learn_stems(texts: DataFrame) -> dict[str, float]:
    """Weights of stems that are far likelier in texts labelled 1; of bounded number."""
    totals = texts.groupBy("label").count().collect()
    count = {r["label"]: r["count"] for r in totals}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    if not toxic or not clean:
        return {}
    words = texts.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("word"))
    words = words.groupBy("word").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    lengths = F.explode(F.sequence(F.lit(STEM_LENGTHS[0]), F.least(F.length("word"), F.lit(STEM_LENGTHS[-1]))))
    stems = (
        words.where(F.length("word") >= STEM_LENGTHS[0])
        .withColumn("length", lengths)
        .groupBy(F.expr("substring(word, 1, length)").alias("stem"))
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    ratio = (F.col("pos") + 0.5) / (F.col("neg") + 0.5) * (clean / toxic)
    found = (
        stems.where((F.col("pos") >= STEM_COUNT) & (ratio >= STEM_RATIO))
        .select("stem", F.log(ratio).alias("weight"), "pos")
        .orderBy(F.desc("pos"), "stem")
        .limit(MAX_STEMS)
        .collect()
    )
    return {r["stem"]: r["weight"] for r in found}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last column is free."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(hessian, gradient)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w


def _featured(df: DataFrame, stems: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` columns (the text last among those read) with an array ``x`` of features."""
    shipped = df.sparkSession.sparkContext.broadcast(stems)
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(shipped.value)
        for batch in batches:
            for part in slices(batch, len(keep)):
                rows = [grammar.features(t or "") for t in part.column(len(keep)).to_pylist()]
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(rows, pa.list_(pa.float64()))], names=keep + ["x"]
                )

    return df.select(*keep, "text").mapInArrow(emit, f"{fields}, x array<double>")


class ToxicityModel:
    """Stems and weights; ``score`` needs no more than broadcasts of bounded size."""

    def __init__(self, stems: dict[str, float], weights: list[float]):
        self.stems, self.weights = stems, weights

    @staticmethod
    def fit(docs, labels, label="toxic", folds=4, fold=2, id_col="doc_id", text_col="text", limit=MAX_LABELLED):
        """Learn from labelled rows outside the held-out fold, at most ``limit`` of them.

        Stems come from two thirds of the rows and the weights of the ways they are
        meant from the rest, so that the weights see stems as new texts do. Without
        labels of both kinds the score is the share of label 1 (0 without labels).
        """
        texts = store(training_texts(docs, labels, label, folds, fold, id_col, text_col, limit), "labelled")
        third = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0
        stems = learn_stems(texts.where(~third))
        rows = _featured(texts.where(third), stems, ["label"]).collect()
        y = np.array([r["label"] for r in rows], float)
        if not stems or not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            logit = math.log((share + 1e-6) / (1 - share + 1e-6))
            return ToxicityModel({}, [0.0] * FEATURES + [logit])
        x = np.hstack([np.array([r["x"] for r in rows]), np.ones((len(rows), 1))])
        return ToxicityModel(learn_stems(texts), logistic(x, y).tolist())

    def _scored(self, docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
        """Columns ``keep`` as ``k0``, ``k1``, .. with ``score``."""
        names = [f"k{i}" for i in range(len(keep))]
        named = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, names)], F.col(text_col).alias("text"))
        logit = sum((F.get("x", F.lit(i)) * w for i, w in enumerate(self.weights[:-1])), F.lit(self.weights[-1]))
        found = _featured(named, self.stems, names)
        return found.select(*names, (1 / (1 + F.exp(-logit))).alias("score"))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, score)`` for every row, the score between 0 and 1.

        NULL and empty texts are scored as texts without matched clauses. Ids and all
        other columns are no inputs.
        """
        return self._scored(docs, [id_col], text_col).withColumnRenamed("k0", id_col)

    def keep_below(self, docs: DataFrame, threshold: float, text_col: str = "text") -> DataFrame:
        """Rows of ``docs`` that score less than ``threshold``; columns as they came."""
        kept = self._scored(docs, docs.columns, text_col).where(F.col("score") < threshold)
        return kept.drop("score").toDF(*docs.columns)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    scored = ToxicityModel.fit(docs, labels).score(docs)
    return scored.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
