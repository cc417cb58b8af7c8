"""Places of a pattern's matches in texts, by built-in functions and without copying growing arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(steps: Column) -> Column:
    """Running sums of an array of whole numbers, by blocks of about the root of its length: n * sqrt(n) additions, every result written once."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda total, x: total + x)

    def within(blocks: Column, sums: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda block, i: let(add(F.slice(sums, F.lit(1), i)), lambda before: F.transform(
            block, lambda _, j: before + add(F.slice(block, F.lit(1), j + 1))))))

    def cut(values: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(values))).cast("int"), lambda width: F.transform(
            F.sequence(F.lit(0), F.size(values) - 1, width), lambda at: F.slice(values, at + 1, width)))

    return let(steps, lambda values: let(cut(values), lambda blocks: let(F.transform(blocks, add), lambda sums: within(blocks, sums))))


def places(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """(start, end, value) of every match, leftmost and non-overlapping, in code points from 0, end exclusive; ``value`` is the group's text.

    Ends are running sums over the pieces between the matches, so a text with very many matches costs little more than their number."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def placed(m: Column) -> Column:
        steps = F.transform(m["found"], lambda f, i: F.length(F.get(m["between"], i)) + F.length(f))
        return F.transform(running(steps), lambda end, i: F.struct(
            (end - F.length(F.get(m["found"], i))).alias("start"), end.alias("end"), F.get(m["value"], i).alias("value")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.struct(
        found.alias("found"), F.split(text, pattern, -1).alias("between"),
        (F.regexp_extract_all(text, pattern, F.lit(group)) if group else found).alias("value")), placed)).otherwise(none))


def overlaps(spans: Column, span: Column) -> Column:
    """Whether ``span`` overlaps one of ``spans``, which are sorted and do not overlap one another: the last of them that starts before the
    span ends is found by halving."""
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")),
        lambda acc, _: F.when(acc["low"] >= acc["high"], acc).otherwise(let(
            F.floor((acc["low"] + acc["high"]) / 2).cast("int"), lambda mid: F.when(
                F.get(spans, mid)["start"] < span["end"], F.struct((mid + 1).alias("low"), acc["high"].alias("high")))
            .otherwise(F.struct(acc["low"].alias("low"), mid.alias("high"))))),
        lambda acc: acc["low"])
    return F.when(F.size(spans) == 0, False).otherwise(let(halved, lambda n: F.when(n == 0, False).otherwise(
        F.get(spans, n - 1)["end"] > span["start"])))
