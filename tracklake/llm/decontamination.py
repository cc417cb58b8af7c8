"""Benchmark decontamination by templates: numbers, units and names become typed slots, windows of templates are joined by
hash, and the slots of an alignment must be filled consistently. Only built-in functions are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.session import settle

WINDOW = 8              # tokens of a template window
MIN_LITERALS = 5        # of them not slots, else the window says too little
MIN_WINDOWS = 6         # consistent windows that make a leak (13 tokens in a row); half of the windows of a short item
BROADCAST_WINDOWS = 100_000  # up to so many benchmark windows (below 100 MB) are broadcast; the answers are the same beyond
# Tokens: sentence marks, numbers, and runs of letters (all characters beyond ASCII count as letters).
TOKEN = r"[.!?\n]|[0-9]+(?:[.,][0-9]+)*|[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
# Units that follow a number.
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "foot", "yd", "yards", "mi", "mile", "miles", "mg", "g", "kg", "lb", "lbs",
         "pounds", "oz", "ounces", "ml", "l", "liters", "litres", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months",
         "years", "percent", "dollars", "euros", "cents", "degrees", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb", "w", "kw", "v", "km/h", "mph")
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


def _marked(t: Column) -> Column:
    return t.isin(".", "!", "?", "\n")


def tokenised(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    """``keep``, ``_raw`` (the tokens without sentence marks) and ``_canon`` (their template forms).

    Columns that lambdas look into are made one projection earlier: an expression inside a lambda runs for every element."""
    df = df.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0)).alias("_found"))

    def form(raw: Column, i: Column) -> Column:
        before = F.get("_found", i - 1)
        number = lambda c: F.substring(c, 1, 1).between("0", "9")
        name = (raw != F.lower(raw)) & (raw == F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(raw.substr(F.lit(2), F.length(raw)))))
        return (F.when(_marked(raw), F.lit(None)).when(number(raw), NUMBER)
                .when(before.isNotNull() & number(before) & F.lower(raw).isin(*UNITS), UNIT)
                .when(before.isNotNull() & ~_marked(before) & name, NAME)
                .otherwise(F.lower(raw)))

    names = [c for c in df.columns if c != "_found"]
    return df.select(*names, F.filter("_found", lambda t: ~_marked(t)).alias("_raw"),
                     F.filter(F.transform("_found", form), lambda c: c.isNotNull()).alias("_canon"))


def _literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda c: ~c.isin(NUMBER, UNIT, NAME)))


def _hashes(canon: Column, width: int) -> Column:
    return F.when(F.size(canon) >= width, F.transform(
        F.sequence(F.lit(1), F.size(canon) - (width - 1)), lambda i: F.xxhash64(F.slice(canon, i, width))))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, at, key, item_canon, item_raw, n_item_windows) for every window with enough literals."""
    items = tokenised(benchmark, text_col, F.col(item_col).alias("item_id")).filter(F.size("_canon") >= width)
    windows = items.select("item_id", F.expr(f"""transform(sequence(1, size(_canon) - {width - 1}), i -> struct(
        i AS at, slice(_canon, i, {width}) AS item_canon, slice(_raw, i, {width}) AS item_raw))""").alias("_w"))
    windows = windows.withColumn("_w", F.filter("_w", lambda w: _literals(w["item_canon"]) >= MIN_LITERALS))
    return (windows.withColumn("n_item_windows", F.size("_w")).select("item_id", "n_item_windows", F.explode_outer("_w").alias("_w"))
            .filter("_w IS NOT NULL").select("item_id", "n_item_windows", "_w.*", F.xxhash64("_w.item_canon").alias("key")))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_windows: int = MIN_WINDOWS, id_col: str = "doc_id",
          text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document and benchmark item that leaks into it: doc_id, item_id, n_windows, n_item_windows, coverage,
    n_changed (slots filled otherwise than in the item) and exact.

    Windows that agree as templates are grouped by alignment (the distance of their places). An alignment counts when every
    value that fills a slot of the item always answers to the same value in the document, so a question with other
    numbers or names is found while chance agreements are not. The best alignment decides. The windows of the
    documents are joined where they arise and only those that agree are shuffled, keyed by document, item and alignment.
    Items with fewer tokens than a window, null or empty texts match nothing. Rows that repeat an id are taken
    together; a null id is an id of its own. Repeated items count as one. An empty table on either side gives an empty result; other columns are
    not read."""
    windows = benchmark_windows(benchmark, width)
    # The outer explode keeps the optimizer from deriving a filter on the keys, which would move into the tokenising lambdas.
    made = tokenised(docs, text_col, F.col(id_col).alias("doc_id"))
    made = made.withColumn("_keys", _hashes(F.col("_canon"), width))
    agreed = (F.slice("_canon", F.col("pos") + 1, width) == F.col("item_canon"))
    if windows.limit(broadcast_windows + 1).count() <= broadcast_windows:
        hits = made.select("doc_id", "_raw", "_canon", F.posexplode_outer("_keys").alias("pos", "key")).join(F.broadcast(windows), "key").filter(agreed)
    else:
        places = made.select("doc_id", F.posexplode_outer("_keys").alias("pos", "key"))
        found = places.join(windows, "key")
        hits = made.select(F.col("doc_id").alias("_doc"), "_raw", "_canon").join(found, F.col("_doc").eqNullSafe(F.col("doc_id"))).filter(agreed)
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.struct(
        F.get("item_canon", k).alias("kind"), F.get("item_raw", k).alias("asked"),
        F.get("_raw", F.col("pos") + k).alias("given"))), lambda s: s["kind"].isin(NUMBER, UNIT, NAME))
    aligned = (hits.select("doc_id", "item_id", "at", "n_item_windows", (F.col("pos") + 1 - F.col("at")).alias("shift"), slots.alias("_slots"))
               .groupBy("doc_id", "item_id", "shift")
               .agg(F.size(F.collect_set("at")).cast("long").alias("n_windows"), F.max("n_item_windows").alias("n_item_windows"),
                    F.array_distinct(F.flatten(F.collect_list("_slots"))).alias("_slots")))
    asked = F.transform("_slots", lambda s: F.struct(s["kind"], s["asked"]))
    aligned = (aligned.filter(F.size(F.array_distinct(asked)) == F.size("_slots"))
               .withColumn("n_changed", F.size(F.filter("_slots", lambda s: s["asked"] != s["given"]))))
    best = aligned.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_windows", (-F.col("n_changed")).alias("same"))).alias("_best"), F.max("n_item_windows").alias("n_item_windows"))
    return (best.select("doc_id", "item_id", F.col("_best.n_windows").alias("n_windows"), F.col("n_item_windows").cast("long").alias("n_item_windows"),
                        (-F.col("_best.same")).cast("long").alias("n_changed"))
            .filter(F.col("n_windows") >= F.least(F.lit(min_windows), F.ceil(F.col("n_item_windows") / 2)))
            .select("doc_id", "item_id", "n_windows", "n_item_windows", (F.col("n_windows") / F.col("n_item_windows")).alias("coverage"),
                    "n_changed", (F.col("n_changed") == 0).alias("exact")))


def _lowered(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def _folded(canon: Column, raw: Column) -> Column:
    """Templates whose names are the case-folded tokens again."""
    return F.zip_with(canon, raw, lambda c, t: F.when(c == NAME, F.lower(t)).otherwise(c))


def _rolled(df: DataFrame, tokens: str, widths: list[int], name: str) -> DataFrame:
    """``name`` + width: hashes of all windows of these widths, from the token hashes in ``tokens``.

    Windows of 2, 4, 8 ... tokens are hashed from the two halves before them and the other widths from such parts, so a window
    costs a few hashes of two numbers, whatever its tokens. Each step is a projection of its own."""
    parts, size = {1: tokens}, 1
    while size * 2 <= max(widths, default=1):
        before, size = parts[size], size * 2
        parts[size] = f"{name}_part{size}"
        df = df.withColumn(parts[size], F.transform(before, lambda h, i: F.xxhash64(h, F.get(before, i + size // 2))))
    for width in widths:
        pieces = [p for p in sorted(parts, reverse=True) if width & p]
        starts = [sum(pieces[:k]) for k in range(len(pieces))]
        rolled = F.transform(parts[pieces[0]], lambda h, i: F.xxhash64(h, *(F.get(parts[p], i + s) for p, s in zip(pieces[1:], starts[1:]))))
        count = F.size(tokens) - (width - 1)
        df = df.withColumn(f"{name}{width}", F.when(count > 0, F.slice(rolled, F.lit(1), F.greatest(count, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    return df.drop(*(p for p in parts.values() if p != tokens))


def _exact_key(at: Column, width: int) -> Column:
    return F.xxhash64(F.lit("exact"), _lowered(F.slice("_raw", at, width)))


def _near_places(df: DataFrame, text_col: str, keep: Column, width: int, short: list[int]) -> DataFrame:
    """Tokens and, for every text, the hashes of its windows as templates (``_t`` + width) and folded (``_f`` + width), the starts of the
    windows that are compared as they are because they hold few literals (``_poor``, from 1), and the hashes of ``short`` whole items (``_w`` + n)."""
    df = tokenised(df, text_col, keep)
    df = df.withColumn("_th", F.transform("_canon", lambda c: F.xxhash64(c)))
    df = df.withColumn("_fh", F.zip_with("_canon", F.arrays_zip(F.col("_th").alias("h"), F.col("_raw").alias("t")),
                                         lambda c, x: F.when(c == NAME, F.xxhash64(F.lower(x["t"]))).otherwise(x["h"])))
    df = df.withColumn("_slot", F.filter(F.transform("_canon", lambda c, i: F.when(c.isin(NUMBER, UNIT), i)), lambda i: i.isNotNull()))
    many = width - MIN_LITERALS  # slots more than these make a window poor
    last = F.size("_canon") - width
    df = df.withColumn("_poor", F.when((last >= 0) & (F.size("_slot") > many), F.array_distinct(F.flatten(F.transform("_slot", lambda p, j: F.when(
        F.get("_slot", j + many) - p < width, F.sequence(F.greatest(F.get("_slot", j + many) - width + 2, F.lit(1)), F.least(p, last) + 1))
        .otherwise(F.array().cast("array<int>")))))).otherwise(F.array().cast("array<int>")))
    df = _rolled(_rolled(df, "_th", [width], "_t"), "_fh", [width], "_f")
    if short:
        df = _rolled(df.withColumn("_lh", F.transform("_raw", lambda t: F.xxhash64(F.lower(t)))), "_lh", short, "_w")
    return df


def _near_windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """(item_id, n_tokens, form, n, at, key, item_tokens, item_values) of all windows, and the lengths of items below a window, whose whole is one."""
    items = tokenised(benchmark, "text", F.col("item_id")).filter(F.size("_canon") >= MIN_LITERALS)
    short = sorted(r[0] for r in items.filter(F.size("_canon") < width).select(F.size("_canon")).distinct().collect())
    items = (_near_places(benchmark, "text", F.col("item_id"), width, short).filter(F.size("_canon") >= MIN_LITERALS))
    entry = lambda form, n, at, key: F.struct(F.lit(form).alias("form"), F.lit(n).alias("n"), at.cast("int").alias("at"), key.alias("key"))
    entries = F.concat(
        F.transform(f"_t{width}", lambda h, i: entry("t", width, i + 1, h)),
        F.transform(f"_f{width}", lambda h, i: entry("f", width, i + 1, F.when(F.array_contains("_poor", i + 1), _exact_key(i + 1, width)).otherwise(h))),
        *(F.transform(f"_w{n}", lambda h, i: entry("w", n, i + 1, F.xxhash64(F.lit(n), h))) for n in short))
    at, n = F.col("_k.at"), F.col("_k.n")
    canon, raw = F.slice("_canon", at, n), F.slice("_raw", at, n)
    exact = (F.col("_k.form") == "w") | ((F.col("_k.form") == "f") & F.array_contains("_poor", at))
    windows = items.withColumn("_k", F.explode_outer(entries)).filter("_k IS NOT NULL").select(
        "item_id", F.size("_canon").alias("n_tokens"), "_k.*",
        F.when(exact, _lowered(raw)).when(F.col("_k.form") == "f", _folded(canon, raw)).otherwise(canon).alias("item_tokens"),
        F.when(F.col("_k.form") == "t", raw).otherwise(_lowered(raw)).alias("item_values"))
    return (windows.filter((F.col("form") != "w") | (F.col("n") == F.col("n_tokens")))
            .filter((F.col("form") != "t") | (_literals(F.col("item_tokens")) >= MIN_LITERALS)).distinct(), short)


NEAR = 8         # places by which inserted and deleted words may move the windows of one copy
COVERED = 0.75   # or this share of the item's tokens lies in consistent windows


def near_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_windows: int = MIN_WINDOWS, id_col: str = "doc_id",
               text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage) of all that ``leaks`` finds and of near copies beyond it; ``coverage`` is the largest share of the
    item's tokens in consistent windows.

    Of the windows of an alignment only those are dropped that contradict the most frequent filling of a slot; windows count once over
    all alignments up to ``NEAR`` places apart; a second key ignores case (and takes numbers as they are where a window has few
    literals); an item below a window and of ``MIN_LITERALS`` tokens or more is searched as a whole. An item leaks when
    ``min_windows`` or half of its windows agree, or those that agree hold ``COVERED`` of its tokens. Single alignments
    are judged as well, so a wider view never loses what a narrow one shows. Rows that repeat an id are taken together, a null id is an
    id of its own, repeated items count as one; null and empty texts match nothing and an empty table on either side gives an empty result."""
    windows, short = _near_windows(benchmark, width)
    windows = settle(windows)
    totals = windows.groupBy("item_id", "form").agg(F.count_distinct("at").alias("n_item_windows"), F.max("n_tokens").alias("n_item_tokens"))
    windows = windows.drop("n_tokens")
    few = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    made = _near_places(docs, text_col, F.col(id_col).alias("doc_id"), width, short)
    place = lambda at, key: F.struct(at.cast("int").alias("at"), key.alias("key"))
    # Where template and folded window are the same, one key finds the items' windows of both forms.
    folded = F.filter(F.transform(f"_f{width}", lambda h, i: F.when(h != F.get(f"_t{width}", i), place(i + 1, h))), lambda p: p.isNotNull())
    keys = F.concat(F.transform(f"_t{width}", lambda h, i: place(i + 1, h)), folded, F.transform("_poor", lambda at: place(at, _exact_key(at, width))),
                    *(F.transform(f"_w{n}", lambda h, i: place(i + 1, F.xxhash64(F.lit(n), h))) for n in short))
    made = made.select("doc_id", "_raw", "_canon", keys.alias("_keys"))
    if few:
        hits = (made.select("doc_id", "_raw", "_canon", F.explode_outer("_keys").alias("_p"))
                .select("doc_id", "_raw", "_canon", F.col("_p.at").alias("pos"), F.col("_p.key").alias("key")).join(F.broadcast(windows), "key"))
    else:
        found = (made.select("doc_id", F.explode_outer("_keys").alias("_p")).select("doc_id", F.col("_p.at").alias("pos"), F.col("_p.key").alias("key"))
                 .join(windows, "key"))
        hits = made.select(F.col("doc_id").alias("_doc"), "_raw", "_canon").join(found, F.col("_doc").eqNullSafe(F.col("doc_id")))
    # Only what the key finds is cut out and compared in full.
    hits = hits.select("doc_id", "item_id", "form", "n", "at", "pos", "item_tokens", "item_values",
                       F.slice("_canon", F.col("pos"), F.col("n")).alias("_c"), F.slice("_raw", F.col("pos"), F.col("n")).alias("_r"))
    hits = hits.withColumn("_low", _lowered(F.col("_r"))).withColumn("_fold", _folded(F.col("_c"), F.col("_r")))
    rich = F.size(F.filter("_fold", lambda t: ~t.isin(NUMBER, UNIT))) >= MIN_LITERALS
    tokens = F.when(F.col("form") == "t", F.col("_c")).when((F.col("form") == "f") & rich, F.col("_fold")).otherwise(F.col("_low"))
    given = F.when(F.col("form") == "t", F.col("_r")).otherwise(F.col("_low"))
    slots = F.filter(F.transform("item_tokens", lambda kind, k: F.struct(kind.alias("kind"), F.get("item_values", k).alias("asked"), F.get(given, k).alias("given"))),
                     lambda s: s["kind"].isin(NUMBER, UNIT, NAME))
    hits = hits.select("doc_id", "item_id", "form", "n", "at", (F.col("pos") - F.col("at")).alias("shift"), slots.alias("slots"),
                       (tokens == F.col("item_tokens")).alias("_same"))
    view = lambda kind, where: F.struct(F.lit(kind).alias("view"), where.cast("long").alias("place"))
    shift = F.col("shift")
    views = F.array(view(0, shift), view(1, F.floor(shift / (2 * NEAR))), view(2, F.floor((shift + NEAR) / (2 * NEAR))))
    # The comparison is part of the outer explode: as a filter it would move into the join, which then could not run compiled and
    # would copy the tokens of a text for every one of its windows.
    grouped = (hits.withColumn("_view", F.explode_outer(F.when(F.col("_same"), views))).filter("_view IS NOT NULL")
               .groupBy("doc_id", "item_id", "form", "n", "_view").agg(F.collect_set(F.struct("at", "shift", "slots")).alias("_found")))
    grouped = grouped.withColumn("_all", F.flatten(F.transform("_found", lambda w: w["slots"]))).withColumn("_fillings", F.array_distinct("_all"))
    grouped = grouped.withColumn("_tally", F.transform("_fillings", lambda s: F.struct(
        s.alias("slot"), F.struct(F.size(F.filter("_all", lambda x: x == s)).alias("n"), (s["asked"] == s["given"]).alias("same"), s["given"].alias("given")).alias("rank"))))
    grouped = grouped.withColumn("_chosen", F.transform(F.filter("_tally", lambda s: ~F.exists("_tally", lambda o: (
        (o["slot"]["kind"] == s["slot"]["kind"]) & (o["slot"]["asked"] == s["slot"]["asked"]) & (o["rank"] > s["rank"])))), lambda s: s["slot"]))
    grouped = grouped.withColumn("_at", F.array_distinct(F.transform(
        F.filter("_found", lambda w: F.forall(w["slots"], lambda s: F.array_contains("_chosen", s))), lambda w: w["at"])))
    grouped = grouped.withColumn("n_windows", F.size("_at")).withColumn("n_covered", F.size(F.array_distinct(F.flatten(
        F.transform("_at", lambda at: F.sequence(at, at + F.col("n") - 1))))))
    return (grouped.join(F.broadcast(totals) if few else totals, ["item_id", "form"])
            .filter((F.col("n_windows") >= F.least(F.lit(min_windows), F.ceil(F.col("n_item_windows") / 2)))
                    | (F.col("n_covered") >= COVERED * F.col("n_item_tokens")))
            .groupBy("doc_id", "item_id").agg(F.max("n_windows").cast("long").alias("n_windows"),
                                              F.max(F.col("n_covered") / F.col("n_item_tokens")).alias("coverage")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) whose document holds no benchmark item and no near copy of one.

    Rows that repeat an id are one document and go together. A row without an id stands for its text: it goes when that text leaks. Null and
    empty texts hold nothing and stay; without benchmark items, or documents, nothing is taken away. Further columns are passed on."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = near_leaks(docs.select(key.alias("_key"), "text"), benchmark, id_col="_key", **options).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, key == F.col("_leaked"), "left_anti")


_IN = "(" + ", ".join(f"'{u}'" for u in UNITS) + ")"
_SLOT = "('<number>', '<unit>', '<name>')"


def _tokens_sql(table: str, key: str) -> str:
    marks = "('.', '!', '?', chr(10))"
    return f"""SELECT id, list(canon ORDER BY i) AS canon, list(x ORDER BY i) AS raw, list(lower(x) ORDER BY i) AS low,
    list(CASE WHEN canon = '{NAME}' THEN lower(x) ELSE canon END ORDER BY i) AS fold
  FROM (SELECT id, r, i, x, CASE WHEN x[1] BETWEEN '0' AND '9' THEN '{NUMBER}'
      WHEN before[1] BETWEEN '0' AND '9' AND lower(x) IN {_IN} THEN '{UNIT}'
      WHEN before NOT IN {marks} AND x = upper(x[1]) || lower(x[2:]) AND x <> lower(x) THEN '{NAME}' ELSE lower(x) END AS canon
    FROM (SELECT id, r, i, x, lag(x) OVER (PARTITION BY r ORDER BY i) AS before
      FROM (SELECT id, r, unnest(tok) AS x, generate_subscripts(tok, 1) AS i
        FROM (SELECT {key} AS id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tok FROM {table}))))
  WHERE x NOT IN {marks} GROUP BY id, r"""


def _forms_sql(source: str) -> str:
    """(id, form, n, spot, tokens, vals) of all windows of a token table."""
    spot = f"SELECT *, unnest(range(1, len(canon) - {WINDOW} + 2)) AS spot FROM {source}"
    last = f"spot + {WINDOW - 1}"
    poor = f"len(list_filter(fold[spot:{last}], lambda c: c NOT IN ('{NUMBER}', '{UNIT}'))) < {MIN_LITERALS}"
    return f"""SELECT id, len(canon) AS n_tokens, 't' AS form, {WINDOW} AS n, spot, canon[spot:{last}] AS tokens, raw[spot:{last}] AS vals FROM ({spot})
  UNION ALL SELECT id, len(canon), 'f', {WINDOW}, spot, CASE WHEN {poor} THEN low[spot:{last}] ELSE fold[spot:{last}] END, low[spot:{last}] FROM ({spot})
  UNION ALL SELECT id, len(canon), 'w', n, spot, low[spot:spot + n - 1], low[spot:spot + n - 1]
    FROM (SELECT *, unnest(range(1, len(canon) - n + 2)) AS spot
          FROM {source}, (SELECT DISTINCT len(canon) AS n FROM item_tok WHERE len(canon) BETWEEN {MIN_LITERALS} AND {WINDOW - 1}))"""


ORACLE_SQL = f"""
WITH item_tok AS ({_tokens_sql('benchmark', 'item_id')}), doc_tok AS ({_tokens_sql('documents', 'doc_id')}),
item AS (SELECT DISTINCT * FROM ({_forms_sql('item_tok')}) q WHERE n_tokens >= {MIN_LITERALS} AND (form <> 'w' OR n = n_tokens)
         AND (form <> 't' OR len(list_filter(tokens, lambda c: c NOT IN {_SLOT})) >= {MIN_LITERALS})),
total AS (SELECT id, form, count(DISTINCT spot) AS n_windows, max(n_tokens) AS n_tokens FROM item GROUP BY ALL),
hit AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, i.form, i.n, i.spot, d.spot - i.spot AS shift, i.tokens, i.vals AS asked, d.vals AS given
        FROM ({_forms_sql('doc_tok')}) d JOIN item i ON d.form = i.form AND d.n = i.n AND d.tokens = i.tokens),
seen AS (SELECT *, 0 AS seen, shift AS place FROM hit UNION ALL SELECT *, 1, floor(shift / {2 * NEAR}) FROM hit
         UNION ALL SELECT *, 2, floor((shift + {NEAR}) / {2 * NEAR}) FROM hit),
slot AS (SELECT doc_id, item_id, form, n, seen, place, spot, shift, tokens[k] AS kind, asked[k] AS asked, given[k] AS given
         FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM seen) WHERE tokens[k] IN {_SLOT}),
filled AS (SELECT doc_id, item_id, form, n, seen, place, kind, asked, given, row_number() OVER (
             PARTITION BY doc_id, item_id, form, n, seen, place, kind, asked ORDER BY count(*) DESC, asked = given DESC, given DESC) AS nth
           FROM slot GROUP BY doc_id, item_id, form, n, seen, place, kind, asked, given),
bad AS (SELECT DISTINCT doc_id, item_id, form, n, seen, place, spot, shift FROM slot
        JOIN filled USING (doc_id, item_id, form, n, seen, place, kind, asked, given) WHERE nth > 1),
agreed AS (SELECT doc_id, item_id, form, n, seen, place, count(DISTINCT spot) AS n_windows,
           len(list_distinct(flatten(list(range(spot, spot + n))))) AS n_covered
           FROM seen ANTI JOIN bad USING (doc_id, item_id, form, n, seen, place, spot, shift) GROUP BY ALL)
SELECT doc_id, item_id, max(a.n_windows) AS n_windows, max(n_covered / n_tokens) AS coverage
FROM agreed a JOIN total t ON t.id = item_id AND t.form = a.form
WHERE a.n_windows >= least({MIN_WINDOWS}, ceil(t.n_windows / 2)) OR n_covered >= {COVERED} * n_tokens
GROUP BY doc_id, item_id
"""
