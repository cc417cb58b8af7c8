"""Secrets: candidate tokens are tested for randomness, and the false discoveries among all of them are controlled.

Built-in functions only: matches, positions, the battery and the thresholds are DataFrame expressions."""

from __future__ import annotations

import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.spans import let, overlaps, places
from tracklake.session import settle

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_WORDS = ("passw", "secret", "token", "api")  # one of them is in every assignment
ACCESS = r"AKIA[A-Z0-9]+"
LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

# How often letters occur in ordinary English text, in percent.
ORDINARY = {"a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.8,
            "l": 4.0, "m": 2.4, "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.1, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 1.0,
            "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.07}
# An encoding's alphabet is the beginning of this one; base64url writes - and _ for the last two.
SYMBOLS = string.digits + string.ascii_lowercase + string.ascii_uppercase + "+/"
SIZES = {"hex": 16, "base36": 36, "base62": 62, "base64": 64, "base64url": 64}
SHAPES = {"hex": r"^([0-9a-f]+|[0-9A-F]+)$", "base36": r"^([0-9a-z]+|[0-9A-Z]+)$", "base62": r"^[0-9A-Za-z]+$",
          "base64": r"^[0-9A-Za-z+/]+$", "base64url": r"^[0-9A-Za-z_-]+$"}
RANDOM_LEVEL = 1e-3   # a battery below this says that the token is not random
RATE = 0.01           # accepted share of false discoveries
GRID = 20             # p-values are counted in steps of 10 ** (-1 / GRID)
DEEPEST = 60          # decades kept apart

# Coefficients of a published Chebyshev fit of the complementary error function, relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def departure(encoding: str) -> float:
    """How far ordinary text departs from uniform symbols: the chi-squared statistic it adds for every symbol of a token.

    Letters come by their usual frequency, capitals at a tenth of it, digits are a tenth of the lower-case letters."""
    k = SIZES[encoding]
    weights = [1.0 if c in string.digits else ORDINARY.get(c.lower(), 0.2) * (1 if c == c.lower() else 0.1) for c in SYMBOLS[:k]]
    return sum((w / sum(weights) - 1 / k) ** 2 * k for w in weights)


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution."""

    def tail(x: Column) -> Column:
        fit = lambda t: t * F.exp(-x * x + sum_powers(t))
        return let(1 / (1 + x / 2), fit)

    def sum_powers(t: Column) -> Column:
        total = F.lit(ERFC[-1])
        for c in reversed(ERFC[:-1]):
            total = total * t + F.lit(c)
        return total

    return let(z / F.lit(2.0 ** 0.5), lambda x: let(tail(F.abs(x)), lambda p: F.when(x >= 0, p / 2).otherwise(1 - p / 2)))


def encoding_of(plain: Column) -> Column:
    """The smallest alphabet that holds the whole token (one case only for hex and base36); base64 for mixtures."""
    return F.coalesce(*[F.when(plain.rlike(shape), F.lit(name)) for name, shape in SHAPES.items()], F.lit("base64"))


def _by_encoding(encoding: Column, values: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(encoding == name, F.lit(float(v))) for name, v in values.items()])


def battery(token: Column) -> Column:
    """(encoding, p_random, step) of a token.

    p_random: the smallest of the p-values of uniformity (chi-squared), of runs above and below the middle of the
    alphabet and of serial correlation, times their number; small when the token is not random.
    step: the p-value under ordinary text, in grid steps below 1, rounded down. Ordinary text must look as uniform as the token
    (lower tail of its chi-squared statistic) or, where digits are not rare, change as often between letters and digits; a p-value is
    twice the smaller of the two tails, which holds its level however they depend on one another. Both shrink with the length."""
    plain = F.regexp_replace(token, "=+$", "")
    coded = let(plain, lambda p: let(encoding_of(p), lambda e: F.struct(
        e.alias("e"), _by_encoding(e, SIZES).alias("k"), _by_encoding(e, {n: departure(n) for n in SIZES}).alias("far"),
        F.transform(F.regexp_extract_all(F.translate(F.when(e.isin("hex", "base36"), F.lower(p)).otherwise(p), "-_", "+/"), F.lit("."), F.lit(0)),
                    lambda c: (F.instr(F.lit(SYMBOLS), c) - 1).cast("double")).alias("codes"))))
    return let(coded, lambda s: let(_moments(s["codes"], s["k"]), lambda m: let(_tails(s, m), lambda p: F.struct(
        s["e"].alias("encoding"), F.least(F.lit(1.0), 3 * F.least(p["uniform"], p["runs"], p["serial"])).alias("p_random"),
        F.least(F.lit(DEEPEST * GRID), F.floor(-F.log10(F.greatest(F.lit(1e-300), F.least(
            F.lit(1.0), 2 * F.least(p["ordinary"], p["borders"])))) * GRID)).cast("int").alias("step")))))


def _moments(codes: Column, k: Column) -> Column:
    """Sums over a token's codes, in one walk: neighbours compared by half of the alphabet and by letter or digit."""
    names = ("last", "n", "total", "square", "product", "ups", "flips", "digits", "borders")
    high, digit = (lambda c: c >= k / 2), (lambda c: c < 10)
    one = lambda test: F.when(test, 1.0).otherwise(0.0)

    def add(acc: Column, c: Column) -> Column:
        inner = acc["n"] > 0
        values = (c, acc["n"] + 1, acc["total"] + c, acc["square"] + c * c, acc["product"] + F.when(inner, acc["last"] * c).otherwise(0.0),
                  acc["ups"] + one(high(c)), acc["flips"] + one(inner & (high(acc["last"]) != high(c))),
                  acc["digits"] + one(digit(c)), acc["borders"] + one(inner & (digit(acc["last"]) != digit(c))))
        return F.struct(*[v.alias(n) for v, n in zip(values, names)])

    walked = F.aggregate(codes, F.struct(*[F.lit(0.0).alias(n) for n in names]), add)
    squares = F.aggregate(F.array_distinct(codes), F.lit(0.0),
                          lambda total, d: total + F.pow(F.size(F.filter(codes, lambda c: c == d)).cast("double"), F.lit(2.0)))
    return let(walked, lambda w: F.struct(*[w[n].alias(n) for n in names], F.get(codes, 0).alias("first"), (squares * k / w["n"] - w["n"]).alias("chi")))


def _tails(s: Column, m: Column) -> Column:
    n, k, chi = m["n"], s["k"], m["chi"]
    free = k - 1
    uniform = normal_tail((F.pow(F.greatest(F.lit(0.0), chi) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    runs = F.when((m["ups"] > 0) & (m["ups"] < n), let(1 + 2 * m["ups"] * (n - m["ups"]) / n, lambda mean: 2 * normal_tail(
        F.abs(1 + m["flips"] - mean) / F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))))).otherwise(F.pow(F.lit(2.0), 1 - n))
    mid = m["total"] / n
    around = m["square"] - n * mid * mid
    beside = m["product"] - mid * (2 * m["total"] - m["first"] - m["last"]) + (n - 1) * mid * mid
    lag = F.when(around > 1e-6, beside / around).otherwise(1.0)
    ordinary = normal_tail((free + n * s["far"] - chi) / F.sqrt(2 * (free + 2 * n * s["far"])))
    # Where words end in numbers the digits come together: ordinary text has one or two borders between the classes.
    mixed = (m["digits"] > 0) & (m["digits"] < n) & (m["digits"] >= n * 10 / k / 4)
    borders = F.when(mixed, F.exp(-F.greatest(F.lit(0.0), m["borders"] - 2))).otherwise(1.0)
    return F.struct(uniform.alias("uniform"), runs.alias("runs"), (2 * normal_tail(F.abs(lag + 1 / n) * F.sqrt(n))).alias("serial"),
                    ordinary.alias("ordinary"), borders.alias("borders"))


def thresholds(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(encoding, limit) by Benjamini-Hochberg on the counted p-values of ``tested`` (encoding, step); none where nothing passes.

    At step s the p-value is at most 10 ** (-s / GRID); with m tests of an encoding and r of them at or below it, the expected
    false share is m * p / r. The windows see at most 1,201 counts per encoding, whatever the size of the table."""
    counted = tested.groupBy("encoding", "step").count()
    deeper = Window.partitionBy("encoding").orderBy(F.desc("step"))
    reached = counted.select("encoding", "step", F.sum("count").over(deeper).alias("reached"),
                             F.sum("count").over(Window.partitionBy("encoding")).alias("total"))
    return (reached.filter(F.col("total") * F.pow(F.lit(10.0), -F.col("step") / GRID) <= rate * F.col("reached"))
            .groupBy("encoding").agg(F.min("step").alias("limit")))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, the spans of every base kind and every candidate with its battery."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    folded = F.lower(text)
    gate = (text.contains("=") | text.contains(":")) & reduce(or_, [folded.contains(w) for w in ASSIGN_WORDS])
    span = lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))
    return docs.select(
        F.col(id_col),
        F.transform(F.filter(places(F.when(gate, text).otherwise(""), ASSIGN, 2), lambda p: F.length(p["value"]) >= 6), span).alias("assign"),
        F.transform(F.filter(places(F.when(text.contains("AKIA"), text).otherwise(""), ACCESS), lambda p: F.length(p["value"]) >= 20), span).alias("access"),
        F.transform(places(text, LONG_HEX), span).alias("hex"),
        F.transform(places(text, CANDIDATE), lambda p: let(battery(p["value"]), lambda b: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), b["encoding"].alias("encoding"), b["p_random"].alias("p_random"),
            b["step"].alias("step")))).alias("tested"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: counts and digest of the base kinds, all spans, and every tested token.

    A token is added when the battery does not contradict randomness and its p-value under ordinary text passes the
    false-discovery threshold of its encoding, taken over the tokens of all documents; a token that overlaps a base span is not
    added again. The examined rows are settled once; five thresholds come back. Null texts count as
    empty. Repeated rows are searched each, a null id is passed on, an empty table gives an empty result, other
    columns are not read. Spans are in code points, end exclusive."""
    seen = settle(_found(docs, id_col, text_col))
    tested = seen.select(F.explode("tested").alias("t")).filter(F.col("t.p_random") >= RANDOM_LEVEL).select("t.encoding", "t.step")
    limits = {r["encoding"]: r["limit"] for r in thresholds(tested, rate).collect()}  # a row per encoding at most
    limit = F.create_map(*[x for e in SIZES for x in (F.lit(e), F.lit(limits.get(e, DEEPEST * GRID + 1)))])
    added = F.filter("tested", lambda t: (t["p_random"] >= RANDOM_LEVEL) & (t["step"] >= limit[t["encoding"]])
                     & ~overlaps(F.col("assign"), t) & ~overlaps(F.col("access"), t) & ~overlaps(F.col("hex"), t))
    ranked = lambda spans, rank, kind: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.array_sort(F.concat(*[ranked(F.col(kind), i, kind) for i, kind in enumerate(BASE_KINDS)]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return seen.select(
        F.col(id_col), *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"), "tested",
        listed(F.array_sort(F.concat(base, ranked(added, len(BASE_KINDS), "random")))).alias("spans"))
