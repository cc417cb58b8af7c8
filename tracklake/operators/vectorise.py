"""Feature rows to unit vectors: defaults, sixteen components, population scaling, length one."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tracklake.constants import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from tracklake.functions import music
from tracklake.operators.quantiles import medians

DIMENSION = len(NUMERIC_FEATURES) + 6


@dataclass(frozen=True)
class VectorStats:
    """What a fitted index needs to place a further row: one small record, like a fitted ML model."""

    numeric_defaults: list[float]
    key_default: str | None
    pitch_class_default: int
    mode_default: float
    camelot_number_default: int
    camelot_letter_default: float
    means: list[float]
    stds: list[float]
    missing: str = "defaults"

    def as_row(self) -> Row:
        return Row(**asdict(self))

    @staticmethod
    def from_row(row: Row) -> "VectorStats":
        values = row.asDict()
        return VectorStats(**{k: values[k] for k in VectorStats.__dataclass_fields__})


STATS_SCHEMA = (
    "numeric_defaults array<double>, key_default string, pitch_class_default int, mode_default double, "
    "camelot_number_default int, camelot_letter_default double, means array<double>, stds array<double>, missing string"
)


def feature_defaults(features: DataFrame, exact: bool = True) -> DataFrame:
    """One row: median of every numeric feature and most frequent category, the smallest on ties.

    Medians are exact by refinement; ``exact=False`` takes one pass and approximate ones."""
    modes = [F.mode(c, deterministic=True).alias(f"{c}_default") for c in CATEGORICAL_FEATURES]
    if exact:
        row = features.agg(*modes).select(
            *[F.lit(m).cast("double").alias(c) for c, m in zip(NUMERIC_FEATURES, medians(features, NUMERIC_FEATURES))], "*")
    else:
        row = features.agg(*[F.percentile_approx(c, 0.5, 10000).cast("double").alias(c) for c in NUMERIC_FEATURES], *modes)
    return row.select(
        *NUMERIC_FEATURES, "key_default",
        F.coalesce(music.pitch_class(F.col("key_default")), F.lit(0)).alias("pitch_class_default"),
        F.coalesce(music.parse_mode(F.col("mode_default")), F.lit(0.0)).alias("mode_default"),
        F.coalesce(music.camelot_number(F.col("camelot_default")), F.lit(0)).alias("camelot_number_default"),
        F.coalesce(music.camelot_letter(F.col("camelot_default")), F.lit(0.0)).alias("camelot_letter_default"))


def _components(d: VectorStats) -> list[Column]:
    """The sixteen raw components; what is missing or unreadable takes its default."""
    numeric = [F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in zip(NUMERIC_FEATURES, d.numeric_defaults)]
    pitch = F.coalesce(music.pitch_class(F.col("key")), F.lit(d.pitch_class_default))
    mode = F.coalesce(music.parse_mode(F.col("mode")), F.lit(d.mode_default))
    if d.missing == "zero":
        # Browser variant: no blanks inside the code, wheel position clamped instead of checked.
        code = music.strip(F.col("camelot"))
        shape = r"^(\d{1,2})([ABab])$"  # fixed value: the format the browser variant takes
        n = F.regexp_extract(code, shape, 1).try_cast("int")
        number = F.when(n.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(11), n - 1)))
        letter = F.when(F.upper(F.regexp_extract(code, shape, 2)) == "B", 1.0).otherwise(0.0)
    else:
        number = F.coalesce(music.camelot_number(F.col("camelot")), F.lit(d.camelot_number_default))
        letter = F.coalesce(music.camelot_letter(F.col("camelot")), F.lit(d.camelot_letter_default))
    return [*numeric, *music.circular(pitch), mode, *music.circular(number), letter]


def _raw(features: DataFrame, d: VectorStats) -> DataFrame:
    return features.withColumns({f"_r{i}": c for i, c in enumerate(_components(d))})


def fit_vectors(features: DataFrame, missing: str = "defaults", exact: bool = True) -> VectorStats:
    """Two aggregations, each of one row: defaults, then mean and population deviation per component."""
    if missing == "zero":
        base = VectorStats([0.0] * len(NUMERIC_FEATURES), None, 0, 0.0, 0, 0.0, [], [], missing)
    else:
        row = feature_defaults(features, exact).first()
        if row["key_default"] is None and row[NUMERIC_FEATURES[0]] is None:
            raise ValueError("There are no track features to index.")
        base = VectorStats([row[c] for c in NUMERIC_FEATURES], row["key_default"], row["pitch_class_default"],
                           row["mode_default"], row["camelot_number_default"], row["camelot_letter_default"], [], [], missing)
    names = [f"_r{i}" for i in range(DIMENSION)]
    moments = _raw(features, base).agg(*[F.avg(n).alias(f"m{n}") for n in names],
                                       *[F.stddev_pop(n).alias(f"s{n}") for n in names]).first()
    if moments[f"m{names[0]}"] is None:
        raise ValueError("There are no track features to index.")
    # A component without any spread divides by one; its deviation may come out as rounding noise.
    stds = [moments[f"s{n}"] for n in names]
    means = [moments[f"m{n}"] for n in names]
    stds = [s if s > 1e-9 * max(1.0, abs(m)) else 1.0 for s, m in zip(stds, means)]
    return VectorStats(**{**asdict(base), "means": means, "stds": stds})


def vectorise(features: DataFrame, stats: VectorStats) -> DataFrame:
    """Adds the unit ``vector``; narrow, so it costs one pass and no shuffle."""
    raw = _raw(features, stats)
    z = {f"_r{i}": (F.col(f"_r{i}") - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(zip(stats.means, stats.stds))}
    names = list(z)
    squares = sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0]))
    scaled = raw.withColumns(z).withColumn("_len", F.sqrt(squares))
    safe = F.when(F.col("_len") == 0, 1.0).otherwise(F.col("_len"))
    return scaled.withColumn("vector", F.array(*[F.col(n) / safe for n in names])).drop(*names, "_len")
