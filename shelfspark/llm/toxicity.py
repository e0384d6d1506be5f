"""Toxic passages of listing texts: maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import listing_texts

SAMPLE_ROWS = 20_000
PRIOR_WORDS = 1000.0
FLOOR = 0.25
DRIFT = 2.0
FOLDS = 4
SIGNIFICANT = 0.01
_MARKS = ".,;:!?\"'()[]{}<>*#%$&|/\\-_~`+=@^"
_STEMS = (5, 4)
_CACHE_WORDS = 1 << 19
_FLUSH_WORDS = 1 << 18
RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("passages", T.ArrayType(T.StructType([
        T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()),
        T.StructField("weight", T.DoubleType())])))])


def word_units(word: str) -> list[str]:
    """What is counted of a word: the bare word and its stems (a stem ends with a star)."""
    bare = word.strip(_MARKS)
    return [bare, *(bare[:n] + "*" for n in _STEMS if len(bare) > n)] if bare else []


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, sum), left to right, in linear time."""
    up = scores > 0
    edges = np.flatnonzero(np.diff(np.r_[False, up, False]))
    if not len(edges):
        return []
    total = np.r_[0.0, np.cumsum(scores)]
    stack: list[list] = []  # start, end, sum before, sum after, nearest entry below with a smaller sum before
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        before, after = total[start], total[end]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append([start, end, before, after, j])
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(r - b)) for s, e, b, r, _ in stack]


@dataclass
class ToxicityModel:
    """Word weights, the extreme-value fit of clean texts, and the final calibration."""

    weights: dict[str, float]
    rate: float = 1.0
    location: float = 0.0
    scale: float = 1.0
    bias: float = 0.0
    slopes: tuple[float, float] = (1.0, 0.0)

    def word_score(self, word: str) -> float:
        known = [self.weights[u] for u in word_units(word) if u in self.weights]
        return (max(known, key=abs) if known else 0.0) - DRIFT

    def segments(self, text: str, cache: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
        words = text.lower().split()
        get = cache.get
        scores = [get(w) for w in words]
        if None in scores:
            for i, w in enumerate(words):
                if scores[i] is None:
                    scores[i] = cache[w] = self.word_score(w)
            if len(cache) > _CACHE_WORDS:
                cache.clear()
        return len(words), maximal_segments(np.array(scores))

    def expected(self, weight: float, words: int) -> float:
        """Passages of this weight or more expected by chance in a clean text of so many words."""
        standard = (self.rate * weight - math.log(max(words, 1)) - self.location) / self.scale
        return math.exp(min(-standard, 50.0))

    def evidence(self, words: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Surprise of the best passage (-log of its extreme-value probability, at most 50), significant passages."""
        if not found:
            return 0.0, 0.0
        chance = [self.expected(w, words) for _, _, w in found]
        best = -math.expm1(-min(chance))
        return -math.log(max(best, 1e-22)), math.log1p(sum(c < SIGNIFICANT for c in chance))

    def score(self, evidence: tuple[float, float]) -> float:
        x = self.bias + self.slopes[0] * evidence[0] + self.slopes[1] * evidence[1]
        return 1 / (1 + math.exp(-max(min(x, 500.0), -500.0)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _count_classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that hold a unit, by unit, class and fold; unit '' counts all (text, unit) pairs."""
    counts: dict[tuple[int, int], Counter] = {}

    def flush():
        rows = [(u, label, part, n) for (label, part), units in counts.items() for u, n in units.items()]
        counts.clear()
        return pd.DataFrame({"unit": pd.Series([r[0] for r in rows], dtype=object), "label": [r[1] for r in rows],
                             "part": [r[2] for r in rows], "n": [r[3] for r in rows]})

    for batch in batches:
        for text, label, part in zip(batch["body"], batch["label"], batch["part"]):
            units = {u for w in set(text.lower().split()) for u in word_units(w)}
            own = counts.setdefault((int(label), int(part)), Counter())
            own.update(units)
            own[""] += len(units)
        if sum(map(len, counts.values())) > _FLUSH_WORDS:
            yield flush()
    yield flush()


def _weights(units: list[str], c: np.ndarray, t: np.ndarray, share: np.ndarray, clean: int, toxic: int) -> dict[str, float]:
    """Log-odds per unit under the Dirichlet prior, pulled towards 0 by one standard error.

    ``c`` and ``t`` count clean and toxic texts with the unit, ``share`` is its part of the corpus.
    """
    prior = PRIOR_WORDS * share + FLOOR
    delta = np.log((t + prior) / (toxic + PRIOR_WORDS - t)) - np.log((c + prior) / (clean + PRIOR_WORDS - c))
    error = np.sqrt(1 / (t + prior) + 1 / (c + prior))
    sure = np.flatnonzero(np.abs(delta) > error)
    pulled = np.copysign(np.abs(delta) - error, delta)
    return {units[i]: float(pulled[i]) for i in sure}


def fit_toxicity(
    observations: DataFrame,
    labels: DataFrame,
    key: str = "observation_id",
    text: str = "description",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled observations (by hash order) and all texts' word counts.

    A word's weight is its log-odds between the classes, counted once per text, under a
    Dirichlet prior (``PRIOR_WORDS`` words spread like the texts of the whole corpus, plus
    ``FLOOR`` for each word), pulled towards 0 by one standard error.  ``DRIFT`` is taken off
    every word, so chance sums fall.  The extreme-value law and the calibration are fitted on
    sample texts scored by the weights of the other ``FOLDS`` - 1 folds, on all their passages.
    Every unit in at least two sample texts is weighed, so ``sample_rows`` alone bounds the model.  Labels of an id seen twice count as toxic if one is;
    null ids or labels are left out.
    """
    known = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    # Bounded by sample_rows, so it may be broadcast whatever the size of the corpus.
    sample = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    texts = listing_texts(observations, key, text).select(F.col(key).alias("id"), F.col(text).alias("body"))
    labelled = texts.join(sample, "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int"))

    in_class = [F.sum(F.when((F.col("label") == y) & (F.col("part") == p), F.col("n")).otherwise(0)).alias(f"n{y}{p}")
                for y in (0, 1) for p in range(FOLDS)]
    counts = (labelled.select("body", "label", "part").mapInPandas(_count_classes, "unit string, label int, part int, n long")
              .groupBy("unit").agg(*in_class, F.sum("n").alias("n")))
    units, flat, totals = [], array("q"), np.zeros(2 * FOLDS, np.int64)
    for r in counts.filter("n >= 2").drop("n").toLocalIterator():
        if r.unit:
            units.append(r.unit)
            flat.extend(r[1:])
        else:
            totals = np.array(r[1:], np.int64)  # the row of all pairs
    by = np.array(flat, np.int64).reshape(-1, 2 * FOLDS)
    clean_by, toxic_by = totals[:FOLDS], totals[FOLDS:]
    clean, toxic = int(clean_by.sum()), int(toxic_by.sum())
    if not clean or not toxic:
        return ToxicityModel({}, bias=5.0 if toxic else -5.0)
    shared = observations.sparkSession.sparkContext.broadcast(frozenset(units))

    def count_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, words, units = shared.value, Counter(), Counter()

        def fold():
            for word, n in words.items():
                for u in word_units(word):
                    units[""] += n
                    if u in wanted:
                        units[u] += n
            words.clear()

        for batch in batches:
            for body in batch["body"]:
                words.update(set(body.lower().split()))
            if len(words) > _FLUSH_WORDS:
                fold()
        fold()
        yield pd.DataFrame({"unit": pd.Series(list(units), dtype=object), "n": list(units.values())})

    corpus = texts.select("body").mapInPandas(count_all, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    place, share, every = {u: i for i, u in enumerate(units)}, np.zeros(len(units)), 1
    for r in corpus.toLocalIterator():
        if r.unit:
            share[place[r.unit]] = r.n
        else:
            every = r.n
    share /= every

    def weights(parts) -> dict[str, float]:
        return _weights(units, by[:, parts].sum(axis=1), by[:, [FOLDS + p for p in parts]].sum(axis=1), share,
                        int(clean_by[parts].sum()), int(toxic_by[parts].sum()))

    model = ToxicityModel(weights(list(range(FOLDS))))
    # Rate of the extreme-value law: the clean words' scores s satisfy E[exp(rate s)] = 1.
    words = [(w, by[place[u], :FOLDS].sum() + FLOOR) for u, w in model.weights.items() if not u.endswith("*")]
    weight = np.array([w - DRIFT for w, _ in words] + [-DRIFT])
    seen = np.array([n for _, n in words] + [max(clean - sum(n for _, n in words), 1)])
    seen = seen / seen.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.log(seen @ np.exp(np.minimum(mid * weight, 600))) < 0 else (low, mid)
    model.rate = low

    others = observations.sparkSession.sparkContext.broadcast(
        [ToxicityModel(weights([q for q in range(FOLDS) if q != p])) for p in range(FOLDS)])

    def held(law: ToxicityModel | None):
        """Words and best passage of every sample text, or by a fitted law its evidence."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            caches: list[dict[str, float]] = [{} for _ in range(FOLDS)]
            for batch in batches:
                rows = []
                for body, y, part in zip(batch["body"], batch["label"], batch["part"]):
                    n, found = others.value[part].segments(body, caches[part])
                    rows.append((int(y), *(law.evidence(n, found) if law else (float(n), max((w for _, _, w in found), default=0.0)))))
                yield pd.DataFrame(rows, columns=["label", "first", "second"])

        return labelled.select("body", "label", "part").mapInPandas(run, "label int, first double, second double").collect()

    # Gumbel fit by moments over the best passages of clean texts.
    best = np.array([model.rate * r.second - math.log(max(r.first, 1)) for r in held(None) if r.label == 0 and r.second > 0])
    if len(best) >= 10:
        model.scale = max(float(best.std()) * math.sqrt(6) / math.pi, 0.1)
        model.location = float(best.mean()) - 0.5772156649 * model.scale
    rest = held(ToxicityModel({}, model.rate, model.location, model.scale))
    seen = np.array([(1.0, r.first, r.second) for r in rest]).reshape(-1, 3)
    y = np.array([r.label for r in rest], float)
    if len(y) and 0 < y.sum() < len(y):
        fitted = _fit_logistic(seen, y, ridge=0.01)
        model.bias, model.slopes = float(fitted[0]), (float(fitted[1]), float(fitted[2]))
    return model


def toxicity(observations: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """Struct column (score, passages): chance of a toxic label, and every significant toxic passage."""
    shared = observations.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, cache = shared.value, {}
        for batch in batches:
            scores, passages = [], []
            for body in batch:
                n, found = model.segments(body, cache)
                scores.append(model.score(model.evidence(n, found)))
                passages.append([{"first_word": a, "last_word": b - 1, "weight": w} for a, b, w in found
                                 if model.expected(w, n) < SIGNIFICANT])
            yield pd.DataFrame({"score": scores, "passages": pd.Series(passages, dtype=object)})

    return judge(F.coalesce(text, F.lit("")))


def score_toxicity(
    observations: DataFrame,
    labels: DataFrame,
    key: str = "observation_id",
    text: str = "description",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Score every observation's whole text for toxicity, learning from ``labels`` (``key``, ``label``).

    Every maximal scoring passage of words is found by one linear scan.  The best one is
    judged by the extreme-value law that clean texts follow, and this surprise together with
    the number of significant passages gives the calibrated ``score`` from 0 to 1.

    Result, one row per observation, repeated rows included: ``key``, ``score``, ``passages``
    (first and last word, weight; significant ones).  A null text is empty; an empty text has
    the score of a text without evidence.  Without labels of both classes no passage is found
    and all scores are equal.  A very long text is scanned whole, in memory in proportion to it;
    passages that tie in weight are all listed, in text order; an id labelled several times is
    toxic if any label says so.  Other columns are ignored; an empty table gives no rows.
    """
    model = fit_toxicity(observations, labels, key, text, label, sample_rows)
    out = observations.select(F.col(key), toxicity(observations, model, F.col(text)).alias("r"))
    return out.select(key, "r.score", "r.passages")
