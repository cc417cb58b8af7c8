"""Quality rules by compression bands: how well a text and its chunks compress tells repetition and noise from prose.

The bands come from the table itself: middle and spread of the ratios of all its different texts, by length."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracklake.llm.common import map_texts, slices
from tracklake.session import settle

# Outermost limits (fixed values) of the ratio compressed / raw bytes, by raw length from which they hold: (length, low, high).
# Short frames carry headers and no history, so their ratios are higher and their bands wider. They also serve lengths of
# which a table has few texts.
WHOLE_BANDS = ((0, 0.0, 9.0), (200, 0.50, 1.0), (500, 0.45, 0.85), (1_000, 0.40, 0.75), (3_000, 0.33, 0.70),
               (10_000, 0.28, 0.66), (30_000, 0.25, 0.62))
CHUNK = 2_048              # bytes of a chunk
CHUNK_BAND = (0.35, 0.74)  # the band of a full chunk
BAD_CHUNKS = 0.5           # a document fails when more than this share of its chunks leaves the band
LEVEL = 3
MIN_WORDS = 50
MAX_REPEATED = 50          # percent of the words
STEPS = 4                  # length classes to a doubling of the length
SPREADS = 2.5              # a band reaches so many spreads (1.4826 median deviations) to either side of the median
LEAST_SPREAD = 0.01        # of near copies that fill a length class
OUTER_WEIGHT = 50          # the outermost limits count like so many texts of a length class, the table's own band like the texts it has
GRAIN = 2_000              # ratios are counted in steps of 1 / GRAIN

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, n_chunks int, n_low_chunks int, n_high_chunks int")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words covered by windows of ``width`` words that occur at least twice."""
    windows = list(zip(*(words[i:] for i in range(width))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = end = 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            total += start + width - max(start, end)
            end = start + width
    return total


def band(length: int, bands=WHOLE_BANDS) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(bands) if length >= least)


def length_class(length: int) -> int:
    return int(STEPS * math.log2(length)) if length > 0 else 0


MEASURED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "_key long, _length long, _size long, _step int, "
            "_chunks array<struct<length:int,size:int,step:int>>")


def measures(chunk: int = CHUNK, level: int = LEVEL):
    """text -> the tuple of MEASURED: counts, a key of the text, raw and compressed bytes of the text and of all its chunks."""
    state: dict[str, zstandard.ZstdCompressor] = {}

    def measure(text: str) -> tuple:
        if not state:  # made inside the task, as compressors cannot be sent
            state["z"] = zstandard.ZstdCompressor(level=level, write_content_size=False)
        compress = state["z"].compress
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # splits at 0x20 and 0x09-0x0D alone
        spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
        symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        repeated = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
        size = len(compress(raw)) if raw else 0
        chunks = [raw[i:i + chunk] for i in range(0, len(raw), chunk)]
        sizes = [(len(c), size if len(chunks) == 1 else len(compress(c)), length_class(len(c))) for c in chunks]
        return (len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, failed,
                int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True),
                len(raw), size, length_class(len(raw)), sizes)

    return measure


def verdict(chunk: int = CHUNK, bands=WHOLE_BANDS, chunk_band=CHUNK_BAND, bad_chunks: float = BAD_CHUNKS, learned=None):
    """(base_failed, length, size, chunks) -> (kept, ratio, n_chunks, n_low_chunks, n_high_chunks).

    ``learned`` has (low, high, texts) by (whole text or chunk, length class). A limit lies between the outermost and the learned one,
    nearer to the learned one the more texts stand behind it; it never leaves the outermost limits."""
    learned = learned or {}

    def limits(whole: bool, length: int) -> tuple[float, float]:
        low, high = chunk_band if not whole and length == chunk else band(length, bands)
        least, most, n = learned.get((whole, length_class(length)), (low, high, 0))
        share = n / (n + OUTER_WEIGHT)
        return low + share * max(0.0, least - low), high - share * max(0.0, high - most)

    def decide(failed: bool, length: int, size: int, chunks) -> tuple:
        ratio = size / length if length else None
        low, high = limits(True, length)
        inside = ratio is not None and low <= ratio <= high
        n_low = n_high = 0
        for n, packed, _ in chunks:
            low, high = limits(False, n)
            n_low += packed / n < low
            n_high += packed / n > high
        inside = inside and n_low + n_high <= bad_chunks * len(chunks)
        return inside and not failed, ratio, len(chunks), n_low, n_high

    return decide


def rules(chunk: int = CHUNK, bands=WHOLE_BANDS, chunk_band=CHUNK_BAND, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL, learned=None):
    """text -> the tuple of RESULT, by the fixed bands and those ``learned`` from a table."""
    measure, decide = measures(chunk, level), verdict(chunk, bands, chunk_band, bad_chunks, learned)

    def judge(text: str) -> tuple:
        *counts, _, length, size, _, chunks = measure(text)
        return (*counts, *decide(counts[5], length, size, chunks))

    return judge


def _middle(counts: dict[int, int]) -> int:
    """The lower median of counted values."""
    half, seen = (sum(counts.values()) + 1) // 2, 0
    for value in sorted(counts):
        seen += counts[value]
        if seen >= half:
            return value
    return 0


def learned_bands(measured: DataFrame) -> dict[tuple[bool, int], tuple[float, float, int]]:
    """(low, high, texts) by (whole text or chunk, length class), from the ratios of all different texts: copies count once.

    Ratios are counted on a grid in Spark, so only a few thousand counts reach the driver and no order of rows matters."""
    texts = measured.filter("_length > 0").select("_key", "_length", "_size", "_step", "_chunks").dropDuplicates(["_key", "_length"])
    wholes = texts.select(F.lit(True).alias("whole"), F.col("_step").alias("step"), F.col("_length").alias("length"), F.col("_size").alias("size"))
    chunks = texts.select(F.explode("_chunks").alias("_c")).select(F.lit(False).alias("whole"), "_c.step", "_c.length", "_c.size")
    seen = wholes.union(chunks).groupBy("whole", "step", F.round(F.col("size") * GRAIN / F.col("length")).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    counted: dict[tuple[bool, int], dict[int, int]] = defaultdict(dict)
    for r in seen.collect():
        counted[r["whole"], r["step"]][r["bin"]] = r["n"]
    bands = {}
    for key, pool in counted.items():
        middle = _middle(pool)
        away: Counter = Counter()
        for value, n in pool.items():
            away[abs(value - middle)] += n
        spread = max(LEAST_SPREAD, 1.4826 * _middle(away) / GRAIN)
        bands[key] = (middle / GRAIN - SPREADS * spread, middle / GRAIN + SPREADS * spread, sum(pool.values()))
    return bands


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, level: int = LEVEL, **limits) -> DataFrame:
    """One row per row of ``docs``: word, symbol and repetition counts, the compression ratios and ``kept``.

    A document is kept when the base rules pass, the zstandard ratio of the whole text lies in the band of its
    length and at most half of its chunks, the last and shorter one included, leave the band of theirs. The bands are median and
    spread of the ratios of all different texts of the table of that length class, weighed against the fixed limits by their number. Null and empty texts have no ratio and fail.
    Repeated rows are judged each; a null id is passed on; an empty table gives an empty result; other columns are
    not read. Texts are read and compressed once; their sizes are settled, counted by length class and then judged."""
    measured = settle(map_texts(docs, measures(chunk, level), MEASURED, id_col, text_col))
    decide = verdict(chunk, learned=learned_bands(measured), **limits)
    judged = StructType.fromDDL(RESULT).fields
    carried = [f for f in measured.schema if not f.name.startswith("_") or f.name == id_col]
    schema = StructType(carried + judged[len(judged) - 5:])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            rows = zip(*(part.column(n).to_pylist() for n in ("base_failed", "_length", "_size", "_chunks")))
            made = zip(*(decide(failed, length, size, [tuple(c.values()) for c in chunks]) for failed, length, size, chunks in rows))
            yield pa.RecordBatch.from_arrays([part.column(f.name).cast(arrow.field(f.name).type) for f in carried]
                                             + [pa.array(list(c), t) for c, t in zip(made, arrow.types[len(carried):])], schema=arrow)

    return measured.mapInArrow(run, schema)
