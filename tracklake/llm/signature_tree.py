"""N-gram Jaccard join by signature trees: OR-combined bitmaps and size ranges bound the overlap of whole subtrees.

Routing. A forest is grown so that every pair at the threshold meets in one tree. Sets are dealt to size bands; the shingles of a
set are dealt by hash to more buckets than two linked sets of the band can differ in, so at least one bucket (with enough shingles in it)
is equal in both. Equal buckets connect sets to a cluster, and a cluster is one tree, or pairs of bounded trees when it is large.
Joining. Within a tree the nodes hold the OR of their sets' bitmaps, a size range and the most shingles that share a bit; a
dual traversal drops node pairs whose largest possible overlap is too small or that are linked already, and what is
left at the leaves is compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracklake.llm.common import components, map_texts, only, slices, unique_documents
from tracklake.llm.shingles import mixed, shingle_set
from tracklake.session import settle

WIDTH, PERCENT = 3, 90
BAND_RATIO = 1.35
LEAF, FANOUT = 16, 8
TREE_SETS, TREE_SHINGLES = 1_024, 2_000_000  # bounds of a tree; larger clusters are joined as pairs of trees
SIZE_STEP = 1.1
SEEN = 200_000  # digests a task remembers to route the copies of a set once
# Shingles of passages that very many documents share connect unrelated sets. Leaving them out of the routing changes no result,
# whichever they are (see routing_keys); these only bound the list and the memory that finds it.
HOT, HOT_CHUNK, HOT_IN_CHUNK, MAX_HOT = 24, 4_000_000, 3, 200_000


class Bands:
    """Size bands [low, high) and, for each, the number of buckets that makes equal buckets certain."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND_RATIO)))

    def differ(self, band: int) -> int:
        """The most shingles in which two linked sets can differ when the smaller is of this band."""
        top = self.edges[band + 1] - 1
        return (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, differ) of the bands in which a set of this size can be the smaller or the larger one of a pair."""
        self._grow(size)
        band = int(np.searchsorted(self.edges, size, side="right")) - 1
        out = []
        while band >= 0 and size * self.percent <= (self.edges[band + 1] - 1) * 100:
            out.append((band, self.differ(band)))
            band -= 1
        return out

    def buckets(self, band: int) -> tuple[int, int]:
        """(number of buckets, least shingles of a bucket that is used)."""
        count = self.differ(band) * 11 // 10 + 4
        mean = self.edges[band] / count
        return count, 3 if mean >= 6 else 2 if mean >= 4 else 1


def _bucket_keys(tokens: np.ndarray, band: int, count: int, least: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all buckets, numbers of those with at least ``least`` shingles)."""
    bucket = (tokens % np.uint64(count)).astype(np.int64)
    sums = np.zeros(count, np.uint64)
    np.add.at(sums, bucket, mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)))
    places = np.arange(count, dtype=np.uint64) + np.uint64((kind << 60) + (band << 32))
    return mixed(sums + mixed(places)), np.flatnonzero(np.bincount(bucket, minlength=count) >= least)


def routing_keys(tokens: np.ndarray, bands: Bands, hot: np.ndarray) -> np.ndarray:
    """One key per used bucket of the shingles that are not hot.

    Of ``count`` buckets at most ``differ`` are unequal between linked sets, with or without any fixed set of shingles taken
    out. So when more than ``differ`` buckets of a set hold enough shingles, one of these is equal in every set linked with
    it. A set with fewer adds keys of all its shingles, and one with too few even so those of all its buckets, the empty
    ones as well; two linked sets that both lack the first kind meet by these."""
    keys = [np.zeros(0, np.uint64)]
    cold = tokens[hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] != tokens] if len(hot) else tokens
    for band, differ in bands.of(len(tokens)) if len(tokens) else []:
        if differ == 0:
            continue  # only equal sets link
        count, least = bands.buckets(band)
        made, used = _bucket_keys(cold, band, count, least, 0)
        keys.append(made[used])
        if len(used) <= differ:
            made, used = _bucket_keys(tokens, band, count, least, 1)
            keys.append(made[used] if len(used) > differ else made)
    return np.concatenate(keys)


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _new_sets(batches, width: int):
    """(slice, [(place, shingles)]) with the copies of sets that this task has met left out."""
    seen: set = set()
    for part in slices(batches):
        found = []
        for i, text in enumerate(part.column("text").to_pylist()):
            tokens = shingle_set(text or "", width)
            digest = _digest(tokens)
            if digest not in seen:
                found.append((i, tokens))
                if len(seen) < SEEN:
                    seen.add(digest)
        yield part, found


def survey(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, h1, h2), size and 128-bit digest of every document's set, and (shingle, times), counts of chunks of all
    documents: both from one pass, which writes them side by side."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_shingles long, h1 long, h2 long, shingle long, times long").fields])
    arrow = to_arrow_schema(schema)

    def batch(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def counts(shingles: np.ndarray) -> pa.RecordBatch:
        """Shingles found often enough in the chunk, which is sorted in place for it."""
        shingles.sort()
        reach = HOT_IN_CHUNK - 1
        often = np.unique(shingles[:-reach][shingles[:-reach] == shingles[reach:]]) if len(shingles) > reach else shingles[:0]
        times = np.searchsorted(shingles, often, "right") - np.searchsorted(shingles, often, "left")
        return batch(len(often), {"shingle": often.view(np.int64), "times": times})

    def run(batches):
        seen: set = set()
        chunk, size = np.empty(HOT_CHUNK, np.uint64), 0
        for part in slices(batches):
            sets = [shingle_set(text or "", width) for text in part.column("text").to_pylist()]
            digests = [_digest(tokens) for tokens in sets]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield batch(len(sets), {"doc_id": part.column("doc_id").to_pylist(), "n_shingles": [len(t) for t in sets],
                                    "h1": halves[:, 0].copy(), "h2": halves[:, 1].copy()})
            for tokens, digest in zip(sets, digests):
                if digest in seen or len(tokens) > HOT_CHUNK:  # a set that fills a chunk alone repeats nothing in it
                    continue
                if size + len(tokens) > HOT_CHUNK:
                    yield counts(chunk[:size])
                    size = 0
                chunk[size:size + len(tokens)] = tokens
                size += len(tokens)
                if len(seen) < SEEN:
                    seen.add(digest)
        if size:
            yield counts(chunk[:size])

    both = settle(docs.select("doc_id", "text").mapInArrow(run, schema))
    return both.filter("n_shingles IS NOT NULL").drop("shingle", "times"), both.filter("times IS NOT NULL").select("shingle", "times")


def hot_shingles(docs: DataFrame, width: int, counts: DataFrame | None = None) -> np.ndarray:
    """Sorted shingles that many documents hold: the counts of chunks (those of a survey, if given) are summed in Spark, the most frequent come first."""
    counts = survey(docs, width)[1] if counts is None else counts
    sums = counts.groupBy("shingle").agg(F.sum("times").alias("times"))
    hot = sums.filter(F.col("times") >= HOT).orderBy(F.desc("times"), "shingle").limit(MAX_HOT).select("shingle").toArrow()
    return np.sort(hot.column(0).to_numpy().view(np.uint64))


def route(docs: DataFrame, width: int, percent: int, hot_list: np.ndarray) -> DataFrame:
    """(key, doc_id) rows; copies of a set that a task has met before are left to their first."""
    kind = docs.schema["doc_id"].dataType
    hot = docs.sparkSession.sparkContext.broadcast(hot_list)

    def run(batches):
        bands = Bands(percent)
        for part, found in _new_sets(batches, width):
            keys = [routing_keys(tokens, bands, hot.value) for _, tokens in found]
            owners = np.repeat(np.array([i for i, _ in found], np.int64), [len(k) for k in keys])
            keys = np.concatenate([np.zeros(0, np.uint64), *keys])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column("doc_id").take(pa.array(owners))], names=["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"key long, doc_id {kind.simpleString()}")


class Tree:
    """A signature tree over sets in the order of their sizes; level 0 are the leaves."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        places = [(s % np.uint64(bits)).astype(np.int64) for s in sets]
        grid = np.zeros((len(sets), bits), bool)
        for row, at in zip(grid, places):
            row[at] = True
        self.maps = np.packbits(grid, axis=1).view(np.uint64)
        self.extra = self.sizes - grid.sum(axis=1)  # shingles beyond the first on their bit
        bounds = np.arange(0, len(sets), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.maps, bounds), np.minimum.reduceat(self.sizes, bounds),
                        np.maximum.reduceat(self.sizes, bounds), np.maximum.reduceat(self.extra, bounds))]
        self.reach = [[(b, min(b + LEAF, len(sets))) for b in bounds.tolist()]]
        while len(self.reach[-1]) > 1:
            maps, low, high, extra = self.levels[-1]
            bounds = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, bounds), np.minimum.reduceat(low, bounds),
                                np.maximum.reduceat(high, bounds), np.maximum.reduceat(extra, bounds)))
            spans = self.reach[-1]
            self.reach.append([(spans[b][0], spans[min(b + FANOUT, len(spans)) - 1][1]) for b in bounds.tolist()])


class Links:
    """Union-find over the members of two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def dual_join(left: Tree, right: Tree | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two trees (or within one): pairs of places, the right ones after the left."""
    one = right is None
    right = left if one else right
    shift = 0 if one else len(left.sets)
    links, out = Links(shift + len(right.sets)), []

    def possible(a, i, b, j) -> bool:
        (am, al, ah, ae), (bm, bl, bh, be) = a, b
        if ah[i] * 100 < percent * bl[j] or bh[j] * 100 < percent * al[i]:
            return False
        most = int(np.bitwise_count(am[i] & bm[j]).sum()) + min(ae[i], be[j])
        return most * (100 + percent) >= percent * (al[i] + bl[j])

    def leaves(x: tuple[int, int], y: tuple[int, int], same: bool) -> None:
        common = np.bitwise_count(left.maps[x[0]:x[1], None] & right.maps[None, y[0]:y[1]]).sum(axis=2, dtype=np.int64)
        a, b = left.sizes[x[0]:x[1], None], right.sizes[None, y[0]:y[1]]
        most = common + np.minimum(left.extra[x[0]:x[1], None], right.extra[None, y[0]:y[1]])
        good = most * (100 + percent) >= percent * (a + b)
        good = np.triu(good, 1) if same else good
        if not good.any():
            return
        # Exact overlaps of all pairs of the two leaves at once, over the shingles that they hold.
        sets = left.sets[x[0]:x[1]] + right.sets[y[0]:y[1]]
        shingles, column = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros((len(sets), len(shingles)), np.float32)
        held[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column] = 1
        overlap = np.rint(held[:x[1] - x[0]] @ held[x[1] - x[0]:].T).astype(np.int64)
        for i, j in zip(*np.nonzero(good & (100 * overlap >= percent * (a + b - overlap)))):
            i, j = x[0] + int(i), y[0] + int(j)
            if links.join(i, shift + j):
                out.append((i, shift + j))

    def linked(x, y) -> bool:
        first = links.root(x[0])
        return (all(links.root(i) == first for i in range(*x)) and all(links.root(shift + j) == first for j in range(*y)))

    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        x, y = left.reach[la][i], right.reach[lb][j]
        if not possible(left.levels[la], i, right.levels[lb], j) or linked(x, y):
            continue
        if la == 0 and lb == 0:
            leaves(x, y, one and x == y)
        elif la >= lb:
            below = range(i * FANOUT, min((i + 1) * FANOUT, len(left.reach[la - 1])))
            if one and la == lb and i == j:
                stack += [(la - 1, p, lb - 1, q) for p in below for q in below if p <= q]
            else:
                stack += [(la - 1, p, lb, j) for p in below]
        else:
            stack += [(la, i, lb - 1, q) for q in range(j * FANOUT, min((j + 1) * FANOUT, len(right.reach[lb - 1])))]
    return out


def _grouped(batches):
    """(side, doc_id, tokens) lists of one (cluster, tree pair) after the other; rows come sorted by them."""
    key, rows = None, []
    for part in slices(batches, 64):
        for cluster, pair, side, doc, blob in zip(*(part.column(c).to_pylist() for c in ("cluster", "pair", "side", "doc_id", "tokens"))):
            if (cluster, pair) != key and rows:
                yield rows
                rows = []
            key = (cluster, pair)
            rows.append((side, doc, np.frombuffer(blob, np.uint64)))
    if rows:
        yield rows


def linked_sets(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): a forest of links between the members (doc_id, cluster, n_shingles) of the candidate clusters."""
    kind, ids = docs.schema["doc_id"].dataType.simpleString(), members.select("doc_id")
    q = F.floor(F.log("n_shingles") / F.log(F.lit(SIZE_STEP))).cast("int")
    members = members.withColumn("q", q)
    totals = members.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total"))
    members = members.join(totals, "cluster").withColumn("large", (F.col("sets") > TREE_SETS) | (F.col("total") > TREE_SHINGLES))
    small = members.filter("not large").select("doc_id", "cluster", F.lit("").alias("pair"), F.lit(0).alias("side"), "n_shingles")
    large = members.filter("large")
    split = large.groupBy("cluster", "q").agg(F.greatest(F.ceil(F.count("*") / TREE_SETS), F.ceil(F.sum("n_shingles") / TREE_SHINGLES)).cast("int").alias("trees"))
    placed = large.join(split, ["cluster", "q"]).withColumn("tree", F.pmod(F.xxhash64("doc_id"), F.col("trees")).cast("int"))
    trees = split.select("cluster", "q", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    one, two = trees.alias("one"), trees.alias("two")
    # Sets of classes q and q + k can only link while SIZE_STEP ** (k - 1) stays within the ratio of sizes.
    far = int(np.ceil(np.log(100 / percent) / np.log(SIZE_STEP))) + 1
    pairs = one.join(two, (F.col("one.cluster") == F.col("two.cluster")) & (F.col("two.q") - F.col("one.q") <= far)
                     & (F.struct("one.q", "one.tree") <= F.struct("two.q", "two.tree")))
    name = F.concat_ws(":", "one.q", "one.tree", "two.q", "two.tree")
    ends = pairs.select(F.col("one.cluster").alias("cluster"), name.alias("pair"), F.explode(F.array(
        F.struct(F.col("one.q").alias("q"), F.col("one.tree").alias("tree"), F.lit(0).alias("side")),
        F.struct(F.col("two.q").alias("q"), F.col("two.tree").alias("tree"), F.lit(1).alias("side")))).alias("e")).select("cluster", "pair", "e.*")
    ends = ends.groupBy("cluster", "pair", "q", "tree").agg(F.min("side").alias("side"))  # a tree with itself comes once
    spread = placed.join(ends, ["cluster", "q", "tree"]).select("doc_id", "cluster", "pair", "side", "n_shingles")
    tasks = small.unionByName(spread)

    def cut(text: str) -> tuple:
        return (shingle_set(text, width).tobytes(),)

    sets = map_texts(only(docs, ids), cut, "tokens binary")
    rows = sets.join(tasks, "doc_id").repartition("cluster", "pair").sortWithinPartitions("cluster", "pair", "side", "n_shingles", "doc_id")

    def run(batches):
        for group in _grouped(batches):
            if group[0][0] == 1:
                continue  # the first tree of the pair has no sets
            longest = max(len(t) for _, _, t in group)
            bits = 1 << min(14, max(9, (2 * longest - 1).bit_length()))
            sides = [[t for s, _, t in group if s == side] for side in (0, 1)]
            found = dual_join(Tree(sides[0], bits), Tree(sides[1], bits) if sides[1] else None, percent)
            ids = [d for _, d, _ in group]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found]), pa.array([ids[j] for _, j in found])], names=["a", "b"])

    return rows.select("cluster", "pair", "side", "doc_id", "tokens").mapInArrow(run, f"a {kind}, b {kind}")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document: the smallest id reachable over pairs of sets whose Jaccard similarity
    is at least ``percent``.

    Equal sets are found by their digests, so copies, however many, are one set and never paired. Every other link is
    found or implied: links inside a component that is connected already are not looked at again. Documents without words
    are linked with nothing. Rows without an id are left out, of rows that repeat an id the greatest text counts, an
    empty table gives an empty result; other columns are not read. Routing rows and candidate sets are shuffled once; a task
    holds two bounded trees."""
    docs = unique_documents(docs, id_col, text_col)
    table, counts = survey(docs, width)
    copied = settle(table.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"))
                    .filter("times > 1").select("h1", "h2", "first"))
    named = settle(table.join(copied, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("first")))

    meet = route(docs, width, percent, hot_shingles(docs, width, counts)).withColumn("a", F.first("doc_id").over(
        W.partitionBy("key").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)))
    edges = meet.filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    first_of = named.select(F.col("doc_id"), F.col("first"))
    edges = (settle(edges).join(first_of.withColumnRenamed("doc_id", "a").withColumnRenamed("first", "fa"), "a")
             .join(first_of.withColumnRenamed("doc_id", "b").withColumnRenamed("first", "fb"), "b")
             .select(F.col("fa").alias("a"), F.col("fb").alias("b")).filter("a <> b").distinct())
    clusters = components(edges)
    members = settle(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
                     .join(named.select("doc_id", "n_shingles"), "doc_id"))
    labels = components(linked_sets(members, docs, width, percent))
    return (named.join(labels.select(F.col("id").alias("first"), "component"), "first", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id")))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) without the documents that reach a smaller id; rows without an id stay."""
    found = jaccard_components(docs, width, percent)
    return only(docs, settle(found.filter("doc_id <> component_id").select("doc_id")), how="left_anti").select(docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
-- Linked sets share a shingle among the first tenth (and one) of each in any fixed order.
placed AS (SELECT doc_id, s, n FROM (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY hash(s), s) AS k
           FROM shingle JOIN size USING (doc_id)) WHERE k <= n - ceil(n * 0.9) + 1),
pair AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM placed a JOIN placed b
         ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
link AS (SELECT a, b FROM pair JOIN shingle x ON x.doc_id = a JOIN shingle y ON y.doc_id = b AND y.s = x.s
         GROUP BY a, b, na, nb HAVING 100 * count(*) >= 90 * (na + nb - count(*))),
sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN sides l ON l.a = r.b)
SELECT a AS doc_id, coalesce(max(n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN size ON size.doc_id = a GROUP BY a
"""
