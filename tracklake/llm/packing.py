"""Best-fit packing of documents into training sequences whose members must not conflict."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.session import settle

CAPACITY = 4_096     # words of a bin
PER_SOURCE = 4       # pieces of one source that a bin may hold
SHARD_BINS = 2_000   # bins a shard is meant to fill; one task packs a shard
SHARD_PIECES = 50_000  # pieces a shard is meant to hold, however short they are
WORDS = r"[^\x20\x09-\x0D]+"
RESULT = "doc_id string, piece int, start long, n_words long, bin_id string, bin_offset long, bin_fill long"


class Bins:
    """Open bins ordered by residual. A bin carries one bitmap of duplicate clusters and ``per_source`` bitmaps of sources:
    the i-th has the bits of the sources that the bin holds at least i times, so the last one names the sources it is full for.

    Bins of one residual are kept by that last bitmap and then by number. Residuals at which every bin refused a piece are
    remembered for its source, its cluster or both until a bin that would take it arrives there, so that bins full for a hot
    source, or holding a copy of a large group, are not tried again for every piece."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.levels: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # residual -> full sources -> bins, ascending
        self.filled = 0                                                              # bit r: some bin has residual r
        self.closed: dict[tuple[int, int], int] = {}                                 # (source, cluster) -> residuals that refuse it
        self.closers: list[set[tuple[int, int]]] = [set() for _ in range(capacity + 1)]  # the same by residual
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.residual: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The tightest compatible bin, ties to the lowest number, searched upwards from the piece's own size; a new one if none will do."""
        rest = self.filled >> size << size
        for key in {(source, 0), (0, cluster), (source, cluster)}:
            rest &= ~self.closed.get(key, 0)
        while rest:
            low = rest & -rest
            level = low.bit_length() - 1
            b = self._first(level, source, cluster)
            if b is not None:
                self._take(b, level)
                return self._put(b, level - size, source, cluster)
            self._close(level, source, cluster)
            rest ^= low
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self.residual.append(self.capacity)
        return self._put(len(self.clusters) - 1, self.capacity - size, source, cluster)

    def _first(self, level: int, source: int, cluster: int) -> int | None:
        best = None
        for full, bins in self.levels[level].items():
            if not full & source:
                for b in bins:
                    if best is not None and b > best:
                        break
                    if not self.clusters[b] & cluster:
                        best = b
                        break
        return best

    def _take(self, b: int, level: int) -> None:
        groups, full = self.levels[level], self.sources[b][-1]
        group = groups[full]
        del group[bisect_left(group, b)]
        if not group:
            del groups[full]
            if not groups:
                self.filled ^= 1 << level

    def _close(self, level: int, source: int, cluster: int) -> None:
        """No bin of this residual takes the piece: note for how much of it that holds."""
        groups = self.levels[level]
        if all(full & source for full in groups):
            key = (source, 0)
        elif all(self.clusters[b] & cluster for bins in groups.values() for b in bins):
            key = (0, cluster)
        else:
            key = (source, cluster)
        self.closed[key] = self.closed.get(key, 0) | 1 << level
        self.closers[level].add(key)

    def _put(self, b: int, residual: int, source: int, cluster: int) -> int:
        self.clusters[b] |= cluster
        carry = source
        for i, held in enumerate(self.sources[b]):
            self.sources[b][i], carry = held | carry, held & carry
        self.residual[b] = residual
        if residual:
            full = self.sources[b][-1]
            insort(self.levels[residual].setdefault(full, []), b)
            self.filled |= 1 << residual
            for key in [k for k in self.closers[residual] if not (full & k[0] or self.clusters[b] & k[1])]:
                self.closers[residual].remove(key)
                self.closed[key] ^= 1 << residual
        return b


def bits(values: list) -> Iterator[int]:
    """A bit for every value that occurs more than once; values that occur once or are null conflict with nothing."""
    counts = Counter(v for v in values if v is not None)
    place = {v: i for i, v in enumerate(v for v, n in counts.items() if n > 1)}
    return (1 << place[v] if v in place else 0 for v in values)


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int, shard: str) -> pd.DataFrame:
    """Best-fit decreasing: longest pieces first, ties by id, piece and start."""
    pieces = pieces.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable")
    bins = Bins(capacity, per_source)
    sizes = pieces["n_words"].tolist()
    sources, clusters = ([None if pd.isna(v) else v for v in pieces[c]] for c in ("source", "cluster"))
    placed, offsets = [], []
    for size, source, cluster in zip(sizes, bits(sources), bits(clusters)):
        b = bins.place(size, source, cluster)
        placed.append(b)
        offsets.append(capacity - bins.residual[b] - size)
    return pieces[["doc_id", "piece", "start", "n_words"]].assign(
        bin_id=[f"{shard}-{b}" for b in placed], bin_offset=offsets, bin_fill=[capacity - bins.residual[b] for b in placed])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             cluster: Column | None = None) -> DataFrame:
    """(doc_id, n_words, source, cluster) per row; the cluster is by default the digest of the folded words, so copies share it."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS), F.lit(0))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                     (F.lit(None) if cluster is None else cluster).cast("string").alias("cluster"), words.alias("_words"))
    own = F.md5(F.lower(F.array_join("_words", " ")))
    return df.select("doc_id", F.size("_words").cast("long").alias("n_words"), "source",
                     (own if cluster is None else F.col("cluster")).alias("cluster"))


def pack(lengths: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_bins: int = SHARD_BINS,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack ``lengths`` (doc_id, n_words, source, cluster) into bins of ``capacity``: one row per piece, every word in one bin.

    Longer documents are cut into full pieces and a rest; a full piece fills a bin by itself. A bin holds no two pieces of a
    duplicate cluster and at most ``per_source`` of a source. Pieces are dealt by hash to as many shards as the total
    length or the number of pieces asks for and every shard is packed by itself, so hot sources and large clusters spread over
    all shards and a task holds a bounded number of small rows (about ``shard_bins`` full bins, ``shard_pieces`` pieces). Documents without words have one row of length 0
    without a bin. Null sources or clusters conflict with nothing; repeated rows are packed each (as copies they share a
    cluster and go to different bins); null ids are dealt like others. An empty table gives an empty result."""
    lengths = settle(lengths)  # small rows: the words are counted once
    words, pieces = lengths.agg(F.sum("n_words"), F.sum(F.ceil(F.col("n_words") / capacity))).first()
    shards = max(1, -(-(words or 0) // (capacity * shard_bins)), -(-(pieces or 0) // shard_pieces))
    tail = F.greatest(F.lit(0), F.ceil(F.col("n_words") / capacity) - 1)
    pieces = (lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), tail.cast("int"))))
              .withColumn("start", F.col("piece").cast("long") * capacity)
              .withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("n_words") - F.col("start"))))
    id_type = lengths.schema["doc_id"].dataType
    bare = pieces.filter("n_words = 0").select("doc_id", "piece", "start", "n_words", F.lit(None).cast("string").alias("bin_id"),
                                               F.lit(None).cast("long").alias("bin_offset"), F.lit(None).cast("long").alias("bin_fill"))
    # Rows without an id are told apart by their place in the input.
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    dealt = pieces.withColumn("_place", place).filter("n_words > 0").withColumn(
        "_shard", F.pmod(F.xxhash64("doc_id", "piece", "_place"), F.lit(shards)).cast("int")).withColumn(
        "doc_id", F.col("doc_id").cast("string")).drop("_place")  # pandas has no whole numbers with nulls

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(frame, capacity, per_source, str(key[0]))

    packed = dealt.groupBy("_shard").applyInPandas(run, RESULT)
    return packed.withColumn("doc_id", F.col("doc_id").cast(id_type)).unionByName(bare)
