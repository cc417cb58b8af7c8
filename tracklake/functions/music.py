"""Column functions for musical keys, modes, camelot codes, moods and composite scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklake.constants import (CAMELOT_MAJOR, CAMELOT_MINOR, FLAT_TO_SHARP, MOODS, PITCH_CLASS,
                                 PLAYLIST_MAX, PLAYLIST_MIN, SEARCH_PITCH)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def parse_mode(col: Column) -> Column:
    """major -> 1, minor -> 0, anything else null."""
    word = F.lower(strip(col))
    return F.when(word == "major", 1.0).when(word == "minor", 0.0)


# Fixed value: the format of a camelot code.
CAMELOT_CODE = r"^\s*(\d{1,2})\s*([ABab])\s*$"


def camelot_number(col: Column) -> Column:
    """Zero-based wheel position, null unless the code reads 1..12 followed by A or B."""
    n = F.regexp_extract(col, CAMELOT_CODE, 1).try_cast("int")
    return F.when(n.between(1, 12), n - 1)


def camelot_letter(col: Column) -> Column:
    """B -> 1, A -> 0, null when the code is invalid."""
    letter = F.upper(F.regexp_extract(col, CAMELOT_CODE, 2))
    return F.when(camelot_number(col).isNotNull(), F.when(letter == "B", 1.0).otherwise(0.0))


def pitch_class(col: Column) -> Column:
    """Pitch class of a note name, exact match after trimming; null when unknown."""
    return F.try_element_at(literal_map(SEARCH_PITCH), strip(col))


def circular(position: Column) -> list[Column]:
    """Sine and cosine of a position on a twelve-step circle."""
    angle = position * F.lit(2 * math.pi) / F.lit(12.0)
    return [F.sin(angle), F.cos(angle)]


def clean_key(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("♭"), F.lit("b")), F.lit("♯"), F.lit("#"))


def key_features(key: Column, scale: Column, strength: Column) -> list[Column]:
    """Pitch number, sharp note name, mode, camelot code and rounded score of a detected key."""
    note = F.coalesce(F.try_element_at(literal_map(FLAT_TO_SHARP), key), key)
    wheel = F.when(scale == "minor", F.try_element_at(literal_map(CAMELOT_MINOR), note)).otherwise(
        F.try_element_at(literal_map(CAMELOT_MAJOR), note))
    return [
        F.try_element_at(literal_map(PITCH_CLASS), note).alias("key"),
        note.alias("note"),
        scale.alias("mode"),
        wheel.alias("camelot"),
        F.round(strength.cast("double"), 4).alias("score"),
    ]


def range_score(value: Column, low: float, high: float) -> Column:
    """1 inside [low, high]; outside, falls off linearly from the midpoint and stops at 0."""
    middle, half = (low + high) / 2, max((high - low) / 2, 1)
    return F.when(value.between(low, high), 1.0).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(value - F.lit(middle)) / F.lit(float(half))))


def mood_score(mood: str) -> Column:
    """Mean of the mood's five range scores; an unknown mood scores 0."""
    if mood not in MOODS:
        return F.lit(0.0)
    parts = [range_score(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), low, high)
             for name, low, high in MOODS[mood]]
    return reduce(lambda a, b: a + b, parts) / F.lit(5.0)


def unit_scale(col: Column) -> Column:
    """[1, 9] -> [0, 1], clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col.cast("double") - 1.0) / 8.0))


def clamp_length(length: int) -> int:
    """Playlist lengths are kept within 5..100."""
    return max(PLAYLIST_MIN, min(PLAYLIST_MAX, int(length)))
