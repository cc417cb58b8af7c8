"""Substring dedup by recompression: runs and pairs of symbols are named again and again, and because names depend on what they
stand for alone, equal passages share their interior symbols wherever they occur.

Every round names the runs of equal symbols and then the pairs of a left and a right symbol, the side of a symbol being a
bit of its name. A name is a hash of what it replaces, which makes it the same in all documents without a dictionary; so
the rounds run inside one pass over the texts and only the symbols that come out are exchanged. For every symbol the
stretch of words that decides its existence is tracked. A window of words takes as its anchor the highest symbol whose
stretch lies inside the window: equal windows take equal anchors. Consecutive windows with one anchor make a span; spans with
equal anchors meet in one shuffle. Spans that are equal as a whole repeat the first of them, and only the first ones of
anchors with several different spans are compared window by window."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracklake.llm.common import map_texts, only, slices, unique_documents
from tracklake.llm.shingles import mixed
from tracklake.session import settle

WINDOW = 20
ROUNDS = 3
FAR = 1 << 40
_BASE, _RUN, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FORGET = 1_000_000  # words remembered at most
_known: dict[bytes, int] = {}  # word -> its row in the hash table
_hashes = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def two_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every word; a task looks up the words that it has met before."""
    if len(_known) > _FORGET:
        _known.clear()
    new = list(set(words).difference(_known))
    if new:
        first = len(_known)
        _known.update(zip(new, range(first, first + len(new))))
        digest = xxhash.xxh3_64_intdigest
        for k, seed in enumerate((0, 7)):
            if len(_hashes[k]) < len(_known):  # grows by doubling
                _hashes[k] = np.concatenate([_hashes[k][:first], np.zeros(2 * len(_known) - first, np.uint64)])
            _hashes[k][first:len(_known)] = np.fromiter((digest(w, seed) for w in new), np.uint64, len(new))
    rows = np.fromiter(map(_known.__getitem__, words), np.int64, len(words))
    return _hashes[0][rows], _hashes[1][rows]


class Stretches:
    """Hashes of any stretches of a row of numbers, from running sums of a polynomial."""

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _neighbours(values: np.ndarray, first: np.ndarray, outside_left: int, outside_right: int) -> tuple[np.ndarray, np.ndarray]:
    """The values before and after each place, or the outside values at the ends of documents."""
    left = np.where(first, outside_left, np.roll(values, 1))
    right = np.where(np.roll(first, -1), outside_right, np.roll(values, -1))
    return left, right


def rounds(names: np.ndarray, first: np.ndarray, count: int = ROUNDS, width: int = WINDOW) -> list[tuple[np.ndarray, ...]]:
    """(from, to, name) of the pair symbols made in each round whose deciding stretch has at most ``width`` words.

    ``names`` are the words of documents laid end to end, ``first`` marks the first word of each. [from, to) is the stretch of words that decides that the symbol
    exists: whatever stands outside of it, the symbol is made."""
    low = np.arange(len(names))
    high = low + 1
    made = []
    for r in range(count):
        if not len(names):
            break
        # Runs: a run ends where its neighbours differ, so these belong to what decides.
        begin = np.flatnonzero(first | (names != np.roll(names, 1)))
        length = np.diff(np.append(begin, len(names)))
        before, _ = _neighbours(low, first, -FAR, FAR)
        _, after = _neighbours(high, first, -FAR, FAR)
        low = np.minimum(np.minimum.reduceat(low, begin), before[begin])
        high = np.maximum(np.maximum.reduceat(high, begin), after[begin + length - 1])
        run = mixed(names[begin] * _RUN + length.astype(np.uint64))
        names, first = np.where(length > 1, run, names[begin]), first[begin]
        # Pairs: a left symbol and the right symbol after it.
        right = (mixed(names + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        joined = np.append(~right[:-1] & right[1:] & ~first[1:], False)
        tail = np.roll(joined, 1)
        before, _ = _neighbours(low, first, -FAR, FAR)
        _, after = _neighbours(high, first, -FAR, FAR)
        low_alone = np.where(right, np.minimum(low, before), low)
        high_alone = np.where(right, high, np.maximum(high, after))
        following = np.roll(names, -1)
        names_next = np.where(joined, mixed(mixed(names * _PAIR) + following), names)
        low = np.where(joined, np.minimum(low, np.roll(low, -1)), low_alone)
        high = np.where(joined, np.maximum(high, np.roll(high, -1)), high_alone)
        keep = ~tail
        fresh = joined[keep]
        names, first, low, high = names_next[keep], first[keep], low[keep], high[keep]
        fit = np.flatnonzero(fresh & (high - low <= width))
        made.append((low[fit], high[fit], names[fit]))
    return made


def spans_of(words: list[list[bytes]], width: int = WINDOW, count: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(document, start, n, key, digest) of all spans: consecutive windows with one anchor."""
    lengths = np.array([len(w) for w in words])
    flat = [w for ws in words for w in ws]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    one, two = two_hashes(flat)
    first = np.zeros(len(flat), bool)
    first[starts[:-1][lengths > 0]] = True
    owner = np.repeat(np.arange(len(words)), lengths)
    valid = np.arange(len(flat)) + width <= starts[1:][owner] if len(flat) else np.zeros(0, bool)
    at = np.flatnonzero(valid)
    anchor, reach, level = np.full(len(at), -1), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for r, (low, high, names) in reversed(list(enumerate(rounds(one, first, count, width)))):
        order = np.lexsort((-high, low))  # of symbols decided from the same word on, the one decided soonest is written last
        size = np.full(len(flat) + width, width + 1, np.int32)
        rank = np.zeros(len(flat) + width, np.uint64)
        size[low[order]] = (high - low)[order]
        rank[low[order]] = mixed(names[order]) | np.uint64(1)
        best, place = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.int64)
        for d in range(width - int(size.min()) + 1):
            # What lies d words into the window and fits it; slices of all windows at once, the few invalid ones as well.
            value = np.where(size[d:d + len(flat)] <= width - d, rank[d:d + len(flat)], np.uint64(0))
            better = value > best
            np.copyto(best, value, where=better)
            np.copyto(place, d, where=better)
        won = np.flatnonzero((anchor < 0) & (best[at] > 0))
        anchor[won] = at[won] + place[at[won]]
        reach[won] = anchor[won] + size[anchor[won]]
        level[won] = r + 1
    alone = anchor < 0  # no symbol is decided inside: the window is its own anchor
    anchor[alone], reach[alone] = at[alone], at[alone] + width
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(anchor) != 0) | (np.diff(level) != 0) | (owner[at[1:]] != owner[at[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    begin, end = at[head], at[tail] + width
    key = mixed(Stretches(one).of(anchor[head], reach[head]) + level[head].astype(np.uint64))
    return owner[begin], begin - starts[owner[begin]], end - begin, key, Stretches(two).of(begin, end)


def spans(docs: DataFrame, width: int) -> DataFrame:
    """(key, digest, doc_id, start, n, sure): every span; ``sure`` ones repeat an earlier span of the same slice of rows, so they
    are settled, and get a key of their own to spread evenly."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            owner, start, n, key, digest = spans_of([split_words(t) for t in part.column("text").to_pylist()], width)
            ids = np.array(part.column("doc_id").to_pylist())[owner] if len(owner) else np.zeros(0, np.int64)
            order = np.lexsort((start, ids, digest, key))
            owner, start, n, key, digest, ids = (x[order] for x in (owner, start, n, key, digest, ids))
            sure = np.zeros(len(key), bool)
            sure[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
            key = np.where(sure, mixed(digest + mixed(start.astype(np.uint64) + mixed(np.arange(len(key)).astype(np.uint64)))), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), part.column("doc_id").take(pa.array(owner)),
                 pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(sure)],
                names=["key", "digest", "doc_id", "start", "n", "sure"])

    return docs.select("doc_id", "text").mapInArrow(run, f"key long, digest long, doc_id {kind}, start int, n int, sure boolean")


def windows(docs: DataFrame, pieces: DataFrame, width: int) -> DataFrame:
    """(h1, h2, doc_id, start): the windows inside the spans that ``pieces`` lists per document, with 128 bits of hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.join(pieces, "doc_id").select("doc_id", "text", "starts", "ns")

    def run(batches):
        for part in slices(batches, 64):
            out = []
            for i, (text, starts, ns) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "starts", "ns")))):
                one, two = (Stretches(h) for h in two_hashes(split_words(text)))
                at = np.unique(np.concatenate([np.arange(s, s + n - width + 1) for s, n in zip(starts, ns)]))
                out.append((one.of(at, at + width), two.of(at, at + width), np.full(len(at), i), at))
            h1, h2, owner, at = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column("doc_id").take(pa.array(owner)), pa.array(at.astype(np.int32))],
                names=["h1", "h2", "doc_id", "start"])

    return rows.mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, start int")


def covered(text: str | None, starts: list[int], ns: list[int]) -> tuple[list[bytes], int]:
    """The words that no stretch covers, and how many are covered."""
    words = split_words(text)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.array(starts, np.int64), 1)
    np.add.at(step, np.array(starts, np.int64) + np.array(ns, np.int64), -1)
    free = np.cumsum(step[:-1]) == 0
    return [w for w, f in zip(words, free.tolist()) if f], int(len(words) - free.sum())


def repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, starts, ns): per document the stretches of words covered by windows that also start earlier."""
    by_span, by_key = W.partitionBy("key", "digest").orderBy("doc_id", "start"), W.partitionBy("key")
    met = (spans(docs, width).withColumn("differ", F.min("digest").over(by_key) != F.max("digest").over(by_key))
           .withColumn("place", F.row_number().over(by_span)))
    met = settle(met.filter("sure OR place > 1 OR differ").select("doc_id", "start", "n", (F.col("sure") | (F.col("place") > 1)).alias("again")))
    lists = (F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    pieces = settle(met.filter("NOT again").groupBy("doc_id").agg(*lists))
    seen = settle(windows(only(docs, pieces.select("doc_id")), pieces, width))
    first = (seen.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times")).filter("times > 1"))
    later = seen.join(first, ["h1", "h2"]).filter(F.struct("doc_id", "start") != F.col("first"))
    return (met.filter("again").select("doc_id", "start", "n").unionByName(later.select("doc_id", "start", F.lit(width).alias("n")))
            .groupBy("doc_id").agg(*lists))


def dedup_substrings(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document, with ``texts`` also ``kept_text``: words covered by a window of
    ``width`` words that starts earlier too (in a smaller id, or earlier in the same document) are removed.

    Windows are judged on the input. Null or empty texts have no words and keep the empty text. Rows without an id are left out, of rows
    that repeat an id the greatest text counts, an empty table gives an empty result; other columns are not read. One
    row per span is shuffled once, of documents with repeats the text as well; copies inside a slice of rows are settled before the shuffle."""
    docs = unique_documents(docs, id_col, text_col)
    found = settle(repeats(docs, width))
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", kept_text string" if texts else ""

    def whole(text: str) -> tuple:
        words = split_words(text)
        kept = b" ".join(words)
        return (len(words), 0, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if texts else []))

    def cut(batches):
        for part in slices(batches, 64):
            rows = []
            for doc, text, starts, ns in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "starts", "ns"))):
                kept, removed = covered(text, starts, ns)
                kept_text = b" ".join(kept)
                rows.append((doc, len(kept) + removed, removed, hashlib.sha256(kept_text).hexdigest(), kept_text.decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")[:4 + texts], r)) for r in rows])

    ids = found.select("doc_id")
    shortened = (only(docs, ids).join(found, "doc_id").select("doc_id", "text", "starts", "ns")
                 .mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string{more}"))
    untouched = map_texts(docs, whole, f"n_words long, n_removed long, kept_sha256 string{more}").join(ids, "doc_id", "left_anti")
    return untouched.unionByName(shortened)


ORACLE_SQL = r"""
WITH word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
win AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS w FROM word),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w, ' ')) ORDER BY doc_id, i) AS place FROM win WHERE len(w) = 20),
marked AS (SELECT word.doc_id, word.i, x, max(CASE WHEN place > 1 THEN word.i END) OVER (PARTITION BY word.doc_id ORDER BY word.i) AS last
           FROM word LEFT JOIN ranked ON ranked.doc_id = word.doc_id AND ranked.i = word.i),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (last > i - 20) AS removed,
         string_agg(x, ' ' ORDER BY i) FILTER (last IS NULL OR last <= i - 20) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
