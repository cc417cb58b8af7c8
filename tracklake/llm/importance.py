"""Target-distribution importance resampling: documents drawn by how much more likely their features are in the target.

The words of a slice of texts form an Aho-Corasick dictionary. Every entry is bounded by a delimiter on both sides and carries the CRC
and the byte length of its word; a scan of the text emits these payloads in order. The CRC of a run of several words follows from the
payloads of its words alone, by moving the CRC of what comes first over the length of what comes next, so runs are never built as text.
Dictionaries live for one slice of rows inside a task: nothing grows with the vocabulary and nothing is broadcast but one gain per bucket."""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracklake.llm.common import slices
from tracklake.operators.skew import global_index
from tracklake.session import settle

BUCKETS, LONGEST_RUN, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, 2024
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DELIMITERS = re.compile("[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
POLYNOMIAL = 0xEDB88320  # fixed value: the reflected polynomial of CRC-32
SPACE = (zlib.crc32(b" "), 1)


def _apply(images: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by its images of the 32 single bits, applied to every CRC."""
    out = np.zeros_like(crcs)
    for bit in range(32):
        out ^= np.where(crcs >> np.uint32(bit) & np.uint32(1), images[bit], np.uint32(0))
    return out


def _over_one_byte() -> np.ndarray:
    images = [1 << bit for bit in range(32)]
    for _ in range(8):
        images = [(v >> 1) ^ (POLYNOMIAL if v & 1 else 0) for v in images]
    return np.array(images, np.uint32)


@lru_cache(maxsize=4096)
def _over(length: int) -> np.ndarray:
    """The map that moves a CRC over ``length`` bytes, by repeated squaring."""
    images, power = np.array([1 << bit for bit in range(32)], np.uint32), _over_one_byte()
    while length:
        if length & 1:
            images = _apply(power, images)
        power, length = _apply(power, power), length >> 1
    return images


def joined(first: np.ndarray, then: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of concatenations from the CRCs of both parts and the byte lengths of the second."""
    out = np.empty_like(first)
    for length in np.unique(lengths):
        at = lengths == length
        out[at] = _apply(_over(int(length)), first[at]) ^ then[at]
    return out


def payloads(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of every word of every text, in order, and the number of words of each text."""
    plain = [" " + DELIMITERS.sub(" ", t.translate(LOWER)).strip(" ") + " " if t else " " for t in texts]
    words = set()
    for t in plain:
        words.update(t.split(" "))
    words.discard("")
    automaton, crcs, lengths = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], []
    for number, word in enumerate(words):
        spelt = word.encode("utf-8", "surrogatepass")
        crcs.append(zlib.crc32(spelt))
        lengths.append(len(spelt))
        automaton.add_word(f" {word} ", number)
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    automaton.make_automaton()
    found = [np.array([number for _, number in automaton.iter(t)], np.int32) for t in plain]
    flat = np.concatenate(found)
    return np.array(crcs, np.uint32)[flat], np.array(lengths, np.int64)[flat], np.array([len(f) for f in found], np.int64)


def features(texts: list[str | None], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all runs of 1 to ``longest`` words, text after text, with the numbers of words and of runs of each text."""
    crcs, lengths, n_words = payloads(texts)
    owner = np.repeat(np.arange(len(texts)), n_words)
    owners, made = [owner], [crcs % np.uint32(buckets)]
    runs, step = crcs, joined(np.full_like(crcs, SPACE[0]), crcs, lengths) if longest > 1 else None
    for width in range(2, longest + 1):
        runs = joined(runs[:-1], step[width - 1:], lengths[width - 1:] + 1) if len(runs) > 1 else runs[:0]
        inside = owner[:len(runs)] == owner[width - 1:][:len(runs)]
        owners.append(owner[:len(runs)][inside])
        made.append(runs[inside] % np.uint32(buckets))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(made)[order].astype(np.int32), n_words, np.bincount(owners, minlength=len(texts))


def bucketed(texts: DataFrame, buckets: int, longest: int, id_col: str | None, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets) per row; null texts have no words."""
    ident = F.col(id_col).alias("doc_id") if id_col else F.lit(None).cast("long").alias("doc_id")
    kept = texts.select(ident, F.col(text_col).alias("_text"))
    schema = StructType([kept.schema["doc_id"], *StructType.fromDDL("n_words long, buckets array<int>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            flat, n_words, n_runs = features(part.column("_text").to_pylist(), buckets, longest)
            offsets = np.concatenate([[0], np.cumsum(n_runs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(arrow.types[0]), pa.array(n_words, pa.int64()),
                                              lists.cast(arrow.types[2])], schema=arrow)

    return kept.mapInArrow(run, schema)


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket from the bucket lists of all documents and of all target texts: one number per bucket on the driver."""
    def counts(lists):
        out = np.zeros(buckets)
        for bucket, n in lists.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():  # at most one row per bucket
            out[bucket] = n
        return out

    s, t = counts(source), counts(target)
    top, bottom = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(top.tolist(), bottom.tolist())], np.int64)


def weighed(lists: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row of bucket lists."""
    schema = StructType([lists.schema["doc_id"], *StructType.fromDDL("n_words long, n_features long, weight long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            column = part.column("buckets")
            sums = np.concatenate([[0], np.cumsum(gains[column.flatten().to_numpy(zero_copy_only=False)])])
            n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(arrow.types[0]), part.column("n_words"), pa.array(n, pa.int64()),
                                              pa.array(sums[ends] - sums[ends - n], pa.int64())], schema=arrow)

    return lists.select("doc_id", "n_words", "buckets").mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN, percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): one row per row of ``docs``; ``rank`` is null for rows that are not drawn.

    Words are what lies between ASCII characters other than letters and digits; only A-Z is lower-cased. Null, empty and wordless texts have
    no features and weight 0, and are never drawn. Rows that repeat an id share its noise and are ranked apart; a null id counts as the empty
    text in the noise and comes last among equal scores. Without target texts, or without documents, counts are zero and nothing fails.
    Further columns are not read. Every text is scanned once: the bucket lists are written out and read for counting and for scoring."""
    lists = settle(bucketed(docs, buckets, longest, id_col, text_col))
    gains = bucket_gains(lists, bucketed(target, buckets, longest, None, target_text_col), buckets)
    drawn_from = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000.0 * F.log(-F.log((drawn_from.cast("double") + 0.5) / 4294967296.0)))
    scored = settle(weighed(lists, gains)
                    .select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")))
    able = F.col("n_words") >= least_words
    n_drawn = scored.filter(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = global_index(scored.filter(able), order, "pos")
    rank = F.when(F.col("pos") < n_drawn, F.col("pos") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return (ranked.select(*columns, rank.cast("long").alias("rank"))
            .unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank"))))


#: CRC-32 by its rule, for lists of bytes; shared with other SQL of the subpackage.
CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT unnest(range(256)) AS i)
)"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of ``text``; needs ``crc_table`` in scope."""
    spelt = f"hex(encode({text}))"
    digit = "strpos('123456789ABCDEF', substr({0}, {1}, 1))"
    byte = f"16 * {digit.format(spelt, '2 * k + 1')} + {digit.format(spelt, '2 * k + 2')}"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length({spelt}) // 2), lambda k: ({byte})::BIGINT)), "
            f"lambda c, b: xor(steps[1 + (xor(c, b) & 255)], c >> 8)))")


ORACLE_SQL = f"""
WITH {CRC_SQL},
source AS (SELECT doc_id, row_number() OVER () AS row_no, text FROM documents),
spoken AS (
  SELECT row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM (SELECT row_no, text FROM source UNION ALL SELECT -1, text FROM benchmark)
),
per_word AS (SELECT row_no, word, count(*) AS n FROM spoken GROUP BY ALL),
dictionary AS (SELECT word, {crc_sql('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM per_word), crc_table),
counts AS (
  SELECT bucket, sum(CASE WHEN row_no >= 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN row_no < 0 THEN n ELSE 0 END) AS t
  FROM per_word JOIN dictionary USING (word) GROUP BY bucket
),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM counts, (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts)
),
weights AS (SELECT row_no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM per_word JOIN dictionary USING (word) JOIN gains USING (bucket) GROUP BY row_no),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda k:
      strpos('123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), k, 1))::BIGINT)), lambda a, b: 16 * a + b) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM source LEFT JOIN weights USING (row_no)
),
drawn AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
  count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM drawn
"""
