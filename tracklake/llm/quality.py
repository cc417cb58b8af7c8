"""Quality classifier: positive-unlabelled learning by the non-negative unbiased risk."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import drawn, filter_rows, map_texts

MAX_POSITIVES = MAX_UNLABELLED = 20_000  # rows a model is fitted on at most (samples by hash of the id)
FOLDS, HELD_OUT = 4, 2
KEEP = 0.7
BINS = 12
STEPS, RATE, DECAY = 400, 0.05, 1e-4
DEFAULT_PRIOR = 0.5  # share of good text where no label tells anything

FEATURES = ("words", "bytes_per_word", "symbols", "upper", "digits", "marks", "adjacent", "distinct", "lines", "ratio", "ends",
            "bare", "tripled", "line_words", "long_words")
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and not chr(c).isspace() or 28 <= c <= 31)
_TRIPLED = re.compile(rb"([^A-Za-z0-9\x80-\xff\s])\1\1")


def measures() -> Callable[[str], tuple]:
    """text -> one number per feature; all are shares or logarithms, so that length alone does not decide."""
    state: dict = {}

    def measure(text: str) -> tuple:
        if not state:
            state["z"] = zstandard.ZstdCompressor(level=1, write_content_size=False)
        raw = text.encode("utf-8", "surrogatepass")
        words, size = raw.split(), max(1, len(raw))
        n = max(1, len(words))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        letters = max(1, size - len(raw.translate(None, bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))))
        capital = size - len(raw.translate(None, bytes(range(65, 91))))
        share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
        ends = sum(w[-1:] in b"!?#*$%&|<>" for w in words)
        bare = len(words) - len(raw.translate(None, _NO_LETTERS).split())
        distinct = len(set(words))
        return (math.log1p(len(words)), sum(map(len, words)) / n, share(b"#*$%&|<>~^=_{}[]\\"), capital / letters, share(b"0123456789"),
                share(b"!?.,;:"), sum(a == b for a, b in zip(words, words[1:])) / n, math.log1p(distinct) / math.log1p(n),
                1 - len(set(lines)) / max(1, len(lines)), min(2.0, len(state["z"].compress(raw)) / size), ends / n, bare / n,
                len(_TRIPLED.findall(raw)) / n, math.log1p(n / max(1, len(lines))), sum(len(w) > 20 for w in words) / n)

    return measure


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))


class Model:
    """An additive model: every feature is cut at quantiles of the sample and each cut interval has a weight."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray):
        self.cuts, self.weights = cuts, weights
        self.starts = np.cumsum([0] + [len(c) + 1 for c in cuts])

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") + self.starts[i] for i, c in enumerate(self.cuts)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.columns(x)].sum(axis=1) + self.weights[-1]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = BINS, steps: int = STEPS) -> Model:
    """Minimise prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss.

    Where the estimated risk of the negatives falls below zero, which only overfitting can do, the step goes up
    that part alone instead of down the whole."""
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((0, len(FEATURES)))
    cuts = [np.unique(np.quantile(both[:, i], np.linspace(0, 1, bins + 1)[1:-1])) if len(both) else np.zeros(0) for i in range(len(FEATURES))]
    model = Model(cuts, np.zeros(sum(len(c) + 1 for c in cuts) + 1))
    if not len(positive) or not len(unlabelled):
        model.weights[-1] = math.log(prior / (1 - prior))
        return model
    p, u = model.columns(positive), model.columns(unlabelled)
    size = len(model.weights)
    spread = lambda cols, g: np.append(np.bincount(cols.ravel(), np.repeat(g, cols.shape[1]), minlength=size)[:-1], g.sum())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    first, second = np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        gp, gu = model.margin(positive), model.margin(unlabelled)
        risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        down = spread(u, sigmoid(gu) / len(u)) - prior * spread(p, sigmoid(gp) / len(p))
        gradient = -down if risk < 0 else down + prior * spread(p, (sigmoid(gp) - 1) / len(p))
        gradient = gradient + DECAY * np.append(model.weights[:-1], 0.0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        model.weights -= RATE * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_positives: int = MAX_POSITIVES,
          max_unlabelled: int = MAX_UNLABELLED) -> tuple[Model, float]:
    """The model and the class prior, from trusted positives outside the held-out fold and documents without a label used.

    The prior is the share of positives among the labelled rows outside the held-out fold (0.5 when there are none). The two samples are
    bounded by parameters; only their feature rows come to the driver."""
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != HELD_OUT))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    counts = known.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    positives = counts["p"] or 0
    prior = min(0.99, max(0.01, positives / counts["n"])) if counts["n"] else DEFAULT_PRIOR
    draw = lambda seed, most, n: drawn(most / max(1, n), "doc_id", F.lit(seed))
    trusted = known.filter((F.col("y") == 1) & draw("p", max_positives, positives)).select("doc_id", F.lit(1).alias("trusted"))
    chosen = (docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")
              .withColumn("free", draw("u", max_unlabelled, docs.select("doc_id").count()))
              .filter("free or trusted = 1"))
    ddl = ", ".join(f"f_{n} double" for n in FEATURES)
    rows = map_texts(chosen, measures(), ddl, extra=("free", "trusted")).orderBy("doc_id").toPandas()
    x = rows[[f"f_{n}" for n in FEATURES]].to_numpy(float)
    return fit(x[(rows["trusted"] == 1).to_numpy()], x[rows["free"].fillna(False).to_numpy(bool)], prior), prior


def scorer(model: Model) -> Callable[[str], float]:
    """text -> the probability of good text."""
    measure = measures()

    def score(text: str) -> float:
        margin = float(model.margin(np.array([measure(text)]))[0])
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, margin))))

    return score


def good_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that score ``keep`` or more."""
    score = scorer(train(docs, labels, **options)[0])
    return filter_rows(docs, lambda text: score(text) >= keep)


def quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score and predicted (score of ``keep`` or more).

    Labels of the held-out fold are never read; label, language, source and id are no inputs of a score. Null texts count as
    empty and are scored as such. Labels without id or value are left out, of repeated ones the greater is taken;
    repeated rows are scored each, a null id is passed on (held_out false), an empty table gives an empty result. Without
    any label every score is the default prior. Other columns are not read."""
    model, _ = train(docs, labels, **options)
    score = scorer(model)
    return map_texts(docs, lambda text: (score(text),), "score double").select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= keep).cast("int").alias("predicted"))
