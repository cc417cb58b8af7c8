"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted online by FTRL-proximal."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import drawn, map_texts
from tracklake.llm.features import Hasher

BITS = 20            # 2 ** BITS slots: the proven bound of the weights that are broadcast
MAX_ROWS = 20_000    # labelled rows a model is fitted on at most (a sample by hash of the id)
SHARD_ROWS = 20_000  # rows that one task fits on; the weights of several shards are averaged by slot
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1e-3
EPOCHS = 4
FOLDS, HELD_OUT = 5, 0


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))


class Ftrl:
    """Per-coordinate FTRL-proximal on distinct binary features; slot ``2 ** bits`` is the intercept."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        root = np.sqrt(self.n[at])
        self.z[at] += g - (np.sqrt(root * root + g * g) - root) / self.alpha * w
        self.n[at] += g * g


def fit_shard(texts: list[str], labels: list[int], bits: int, epochs: int) -> pd.DataFrame:
    """Weights of one shard with their squared-gradient sums, slots without weight left out."""
    hasher, model = Hasher(bits), Ftrl(bits)
    rows = [np.append(hasher.slots(t), 1 << bits).astype(np.int32) for t in texts]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(rows[i], labels[i])
    touched = np.flatnonzero(model.n)
    w = model.weights(touched)
    seen = model.n[touched]
    return pd.DataFrame({"slot": touched, "weight": w, "seen": seen})[w != 0]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, max_rows: int) -> tuple[DataFrame, int]:
    """(doc_id, text, y) of at most about ``max_rows`` labelled rows, chosen by hash, and about how many they are; the
    label side is bounded and broadcast."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    known = known.filter(drawn(max_rows / max(1, n), "doc_id", F.lit(label)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "doc_id"), min(n, max_rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS,
          shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """The weights, intercept last. Shards fit in parallel; a slot's weight is the mean of the shards' weighted by their
    squared-gradient sums, so a rare feature keeps what the shards that saw it learned."""
    sample, n = labelled_sample(docs, labels, label, fold() != HELD_OUT, max_rows)
    shards = max(1, -(-n // shard_rows))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        return fit_shard(frame["text"].tolist(), frame["y"].tolist(), bits, epochs)

    found = (sample.withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards))).groupBy("_shard")
             .applyInPandas(fit, "slot long, weight double, seen double")
             .groupBy("slot").agg((F.sum(F.col("weight") * F.col("seen")) / F.sum("seen")).alias("weight")).toPandas())
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[found["slot"].to_numpy(np.int64)] = found["weight"].to_numpy(np.float32)
    return weights


def score_texts(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row: the probability of the label."""
    used = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((len(weights), used, weights[used]))
    state: dict = {}

    def score(text: str) -> tuple:
        if not state:
            size, at, values = sent.value
            dense = np.zeros(size, np.float32)
            dense[at] = values
            state.update(weights=dense, hasher=Hasher((size - 1).bit_length() - 1))
        margin = float(state["weights"][state["hasher"].slots(text)].sum(dtype=np.float64)) + float(state["weights"][-1])
        return (1 / (1 + math.exp(-max(-35.0, min(35.0, margin)))),)

    return map_texts(docs, score, "score double", id_col, text_col)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score and predicted (score of 0.5 or more).

    Labels of the held-out fold are never read; label, language, source and id are no inputs of a score. Null texts count as
    empty and score the intercept alone. Labels without id or value are left out, of repeated ones the greater is
    taken; repeated rows are scored each, a null id is passed on (held_out null counts as false), an empty table gives
    an empty result; without any usable label every score is 0.5. Other columns are not read."""
    scored = score_texts(docs, train(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
