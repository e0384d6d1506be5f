"""Quality of listing texts: gated-attention multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import listing_texts

SAMPLE_ROWS = 8_000
SAMPLE_PASSAGES = 64
PASSAGE_WORDS = 64
HASHED = 32
HIDDEN = 16
ATTENTION = 8
STEPS = 400
BAGS = 512
_CACHE_WORDS = 1 << 18
_WORD_FACTS = 8
FEATURES = _WORD_FACTS + 4 + HASHED


def _word_facts(word: str) -> list[float]:
    """Surface facts of a word, its hash bucket and sign."""
    n = len(word)
    alnum = sum(c.isalnum() for c in word)
    digest = xxhash.xxh64_intdigest(word.lower().encode())
    return [n, n * n, sum(c.isupper() for c in word) / n, 1 - alnum / n, sum(c.isdigit() for c in word) / n,
             float(not word[-1].isalnum()), float(alnum == 0), float(word[0].isupper()),
            digest % HASHED, 1.0 if digest >> 32 & 1 else -1.0]


class PassageEncoder:
    """Encodes every passage of ``PASSAGE_WORDS`` words of a text as ``FEATURES`` numbers.

    A passage is described by means of its words' surface facts, the shares of distinct words
    and of words equal to the word before, its size, and a signed hashed bag of words.
    """

    def __init__(self):
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, _WORD_FACTS + 2), np.float32)  # facts, bucket, sign by word number

    def _ids(self, words: list[str]) -> list[int]:
        get = self.known.get
        ids = [get(w) for w in words]
        if None in ids:
            for i, w in enumerate(words):
                if ids[i] is None:
                    at = self.known.get(w)
                    if at is None:
                        at = self.known[w] = len(self.known)
                        if at == len(self.table):
                            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                        self.table[at] = _word_facts(w)
                    ids[i] = at
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(passages x FEATURES, first passage of each text); an empty text is one passage of zeros."""
        if len(self.known) > _CACHE_WORDS:
            self._clear()
        ids, passage, first, lines, count = [], [], [], [], 0
        for text in texts:
            words = text.split()
            first.append(count)
            here = max(1, -(-len(words) // PASSAGE_WORDS))
            ids.append(np.array(self._ids(words), np.int64))
            passage.append(count + np.arange(len(words)) // PASSAGE_WORDS)
            lines += [text.count("\n") / max(len(words), 1)] * here
            count += here
        ids, passage = np.concatenate(ids), np.concatenate(passage)
        out = np.zeros((count, FEATURES), np.float32)
        if len(ids):
            size = np.bincount(passage, minlength=count)
            scale = 1 / np.maximum(size, 1)
            table = self.table[ids]
            for k in range(_WORD_FACTS):
                out[:, k] = np.bincount(passage, table[:, k], count) * scale
            out[:, 1] = np.sqrt(np.maximum(out[:, 1] - out[:, 0] ** 2, 0))
            pairs = np.unique(passage << 32 | ids)
            out[:, 8] = np.bincount(pairs >> 32, minlength=count) * scale
            same = (ids[1:] == ids[:-1]) & (passage[1:] == passage[:-1])
            out[:, 9] = np.bincount(passage[1:], same, count) * scale
            out[:, 10] = size / PASSAGE_WORDS
            out[:, 11] = lines
            bag = np.bincount(passage * HASHED + table[:, -2].astype(np.int64), table[:, -1], count * HASHED)
            out[:, 12:] = bag.reshape(count, HASHED) * np.sqrt(scale)[:, None]
        return out, np.array(first)


@dataclass
class AttentionModel:
    """h = tanh(Wx + b); attention softmax(a . tanh(Vh) * sigmoid(Uh)) in a text; logit w . (sum of weighted h) + c."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.weights
        n = np.diff(np.r_[first, len(x)])
        bag = np.repeat(np.arange(len(first)), n)
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["a"]
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        att = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(att[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "att": att, "z": z, "bag": bag, "logit": z @ p["w"] + p["c"]}

    def gradients(self, f: dict, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.weights, f["bag"]
        d = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        dz = d[:, None] * p["w"]
        dh = f["att"][:, None] * dz[bag]
        da = (f["h"] * dz[bag]).sum(axis=1)
        ds = f["att"] * (da - np.add.reduceat(f["att"] * da, first)[bag])
        dt = (ds[:, None] * p["a"] * f["g"]) * (1 - f["t"] ** 2)
        dg = (ds[:, None] * p["a"] * f["t"]) * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds,
                "w": f["z"].T @ d, "c": d.sum(keepdims=True)}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, first)["logit"], -500, 500)))


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 42) -> AttentionModel:
    """Adam on mini-batches of texts; the same data and seed give the same model."""
    rng = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,),
              "w": (HIDDEN,), "c": (1,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "aw" else np.zeros(s) for k, s in shapes.items()}
    model = AttentionModel(x.mean(axis=0), x.std(axis=0) + 1e-3, weights)
    last = np.r_[first[1:], len(x)]
    moment, square = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    rate = max(y.mean(), 1e-3)
    weights["c"][:] = np.log(rate / max(1 - rate, 1e-3))
    for step in range(1, steps + 1):
        pick = rng.permutation(len(first))[:BAGS]
        rows = np.concatenate([np.arange(first[i], last[i]) for i in pick])
        starts = np.r_[0, np.cumsum(last[pick] - first[pick])[:-1]]
        grads = model.gradients(model.forward(x[rows], starts), starts, y[pick])
        for k, g in grads.items():
            g = g + 1e-4 * weights[k]
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            weights[k] -= 0.01 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_quality(observations: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                sample_rows: int = SAMPLE_ROWS) -> AttentionModel | float:
    """Fit on at most ``sample_rows`` labelled texts, each by at most ``SAMPLE_PASSAGES`` evenly spread passages.

    Without labels of both classes there is nothing to learn: the share of label 1 (or 0.5).
    """
    known = (labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
             .groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    # Bounded by sample_rows, so it may be broadcast whatever the size of the corpus.
    sample = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    texts = listing_texts(observations, key, text).select(F.col(key).alias("id"), F.col(text).alias("body")).join(sample, "id")

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PassageEncoder()
        for batch in batches:
            rows = []
            for i, body, y in zip(batch["id"], batch["body"], batch["label"]):
                x, _ = encoder.encode([body])
                x = x[np.unique(np.linspace(0, len(x) - 1, min(len(x), SAMPLE_PASSAGES)).astype(int))]
                rows.append((xxhash.xxh64_intdigest(f"{i} {body}") >> 1, int(y), x.astype("<f4").tobytes()))
            yield pd.DataFrame({"lot": [r[0] for r in rows], "y": [r[1] for r in rows],
                                "x": pd.Series([r[2] for r in rows], dtype=object)})

    rows = texts.select("id", "body", "label").mapInPandas(encoded, "lot long, y int, x binary").orderBy("lot").limit(2 * sample_rows).collect()
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in rows]
    first = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
    return train(np.concatenate(bags).astype(float), first, y)


def score_quality(observations: DataFrame, labels: DataFrame, key: str = "observation_id", text: str = "description",
                  label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Score every observation's whole text for quality, learning from ``labels`` (``key``, ``label``).

    A text is a bag of passages; only the bag is labelled.  The model learns which passages to
    attend to and scores the attention-weighted passage representation.

    Result, one row per observation, repeated rows included: ``key``, ``score`` (0 to 1) and
    ``passages`` (how many were weighed).  A null text is empty; an empty text is one empty
    passage.  Without labels of both classes all scores are equal.  All passages of a very long
    text are scored; the fit sees ``SAMPLE_PASSAGES`` of a labelled one.  Equal texts have equal
    scores.  Other columns are ignored; an empty table gives no rows.
    """
    shared = observations.sparkSession.sparkContext.broadcast(fit_quality(observations, labels, key, text, label, sample_rows))
    result = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.IntegerType())])

    @F.pandas_udf(result)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, encoder = shared.value, PassageEncoder()
        for batch in batches:
            scores, passages, texts = [], [], batch.tolist()
            at = 0
            while at < len(texts):
                # A few MB of text at a time keep the word tables small.
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1 << 21):
                    size += len(texts[end])
                    end += 1
                x, first = encoder.encode(texts[at:end])
                scores.append(np.full(end - at, model) if isinstance(model, float) else model.score(x, first))
                passages.append(np.diff(np.r_[first, len(x)]))
                at = end
            yield pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0),
                                "passages": np.concatenate(passages).astype("int32") if passages else np.zeros(0, "int32")})

    out = observations.select(F.col(key), judge(F.coalesce(F.col(text), F.lit(""))).alias("r"))
    return out.select(key, "r.score", "r.passages")
