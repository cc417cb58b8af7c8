"""Registered queries: preparation, clustering families, quality metrics, selection."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from tracklake.constants import BIRCH_THRESHOLD, CATEGORICAL_FEATURES, MODEL_FEATURES, NUMERIC_FEATURES
from tracklake.functions.vectors import squared_distance
from tracklake.operators import cf_tree, linkage, metrics, partitioning, prep, selection
from tracklake.operators import dbscan as density
from tracklake.operators.neighbours import collapse, tile_neighbours
from tracklake.operators.skew import delivered_index
from tracklake.operators.tiles import tile_points
from tracklake.operators.views import complete_tracks
from tracklake.plans import clustering
from tracklake.plans.library_queries import feature_view
from tracklake.plans.registry import query, shared
from tracklake.plans.search_queries import rounded
from tracklake.session import scratch_path, settle
from tracklake.sources.library import StarLibrary

shared("complete", f"SELECT * FROM feature_view WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MODEL_FEATURES)}")


def _points(lib: StarLibrary) -> DataFrame:
    return settle(lib.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label"))


def _dataset(lib: StarLibrary) -> DataFrame:
    return settle(complete_tracks(feature_view(lib)))


# ---------------------------------------------------------------- preparation

shared("encoded", " UNION ALL ".join(
    f"SELECT track_id, '{c}' AS feature, CASE WHEN sd = 0 THEN 0.0 ELSE ({c} - mu) / sd END AS value FROM complete, "
    f"(SELECT avg({c}) AS mu, stddev_pop({c}) AS sd FROM complete) m" for c in NUMERIC_FEATURES)
    + "".join(f" UNION ALL SELECT track_id, concat('{c}=', {c}), 1.0 FROM complete" for c in CATEGORICAL_FEATURES))


@query("SELECT track_id, feature, round(value, 6) + 0.0 AS value FROM encoded")
def preprocess_encoded(lib):
    data = _dataset(lib)
    return rounded(prep.encoded_long(data, prep.fit_preprocessor(data)), ["value"])


@query()
def preprocess_pca(lib):
    reduced, summary = prep.reduce_features(_dataset(lib))
    return reduced.select("track_id", "vector", *[F.lit(v).alias(k) for k, v in summary.items()])


@query("""WITH RECURSIVE few AS (SELECT track_id FROM complete ORDER BY track_id LIMIT 12),
            e AS (SELECT * FROM encoded WHERE track_id IN (SELECT track_id FROM few)),
            norm AS (SELECT track_id, sum(value * value) AS sq FROM e GROUP BY track_id)
          SELECT a.track_id AS one, b.track_id AS two, round(sqrt(greatest(a.sq + b.sq - 2 * coalesce(sum(x.value * y.value), 0), 0)), 4) + 0.0 AS distance
          FROM norm a JOIN norm b ON a.track_id < b.track_id LEFT JOIN e x ON x.track_id = a.track_id
          LEFT JOIN e y ON y.track_id = b.track_id AND y.feature = x.feature GROUP BY a.track_id, b.track_id, a.sq, b.sq""")
def pca_keeps_distances(lib):
    """With all components kept the reduced rows lie exactly as far apart as the encoded ones."""
    reduced, _ = prep.reduce_features(_dataset(lib), keep=1 - 1e-12)
    few = reduced.orderBy("track_id").limit(12).select("track_id", "vector")
    pairs = few.toDF("one", "a").join(few.toDF("two", "b"), F.col("one") < F.col("two"))
    gap = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return rounded(pairs.select("one", "two", gap.alias("distance")), ["distance"], 4)


@query("""WITH RECURSIVE n AS (SELECT count(DISTINCT track_id) AS n FROM encoded),
            mid AS (SELECT feature, sum(value) / max(n) AS mu FROM encoded, n GROUP BY feature),
            first AS (SELECT feature, value FROM encoded WHERE track_id = (SELECT min(track_id) FROM encoded))
          SELECT e.track_id, round(greatest(sum(e.value * e.value) - 2 * sum(e.value * mu) + (SELECT sum(mu * mu) FROM mid), 0), 4) + 0.0 AS from_mean,
            round(greatest(sum(e.value * e.value) - 2 * coalesce(sum(e.value * f.value), 0) + (SELECT sum(value * value) FROM first), 0), 4) + 0.0 AS from_first
          FROM encoded e JOIN mid ON mid.feature = e.feature LEFT JOIN first f ON f.feature = e.feature GROUP BY e.track_id""")
def pca_keeps_spread(lib):
    """Of every row the squared distances from the mean and from the first row, equal before and after a full reduction."""
    reduced = settle(prep.reduce_features(_dataset(lib), keep=1 - 1e-12)[0].select("track_id", "vector"))
    mid = (reduced.select(F.posexplode("vector").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mu"))
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mu"))), lambda p: p["mu"]).alias("_mid")))
    first = reduced.agg(F.min_by("vector", "track_id").alias("_first"))
    wide = reduced.crossJoin(F.broadcast(mid)).crossJoin(F.broadcast(first))
    return rounded(wide.select("track_id", squared_distance(F.col("vector"), F.col("_mid")).alias("from_mean"),
                               squared_distance(F.col("vector"), F.col("_first")).alias("from_first")), ["from_mean", "from_first"], 4)


# ---------------------------------------------------------------- families

def _stack(runs: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs.values())


@query()
def kmeans_sweep(lib):
    points = _points(lib)
    return _stack(partitioning.kmeans_sweep(points, partitioning.sweep_range(points.count())))


@query("SELECT CAST(k AS INT) AS k, CAST(k AS BIGINT) AS filled, (SELECT count(*) FROM embeddings) AS placed, TRUE AS own_nearest FROM range(2, 9) t(k)")
def kmeans_facts(lib):
    """What holds for any K-means result: k groups with rows, every row placed, and each nearest to the mean of its own group."""
    points = _points(lib)
    labels = _stack(partitioning.kmeans_sweep(points, range(2, 9)))
    members = settle(labels.join(points.select("id", "vector"), "id"))
    centers = metrics.centroids(members).select("run", F.col("cluster").alias("other"), "center")
    reach = (members.join(centers, "run").withColumn("d", squared_distance(F.col("vector"), F.col("center")))
             .groupBy("run", "id", "cluster").agg(F.min("d").alias("least"), F.min(F.when(F.col("cluster") == F.col("other"), F.col("d"))).alias("own")))
    return reach.groupBy(F.regexp_extract("run", "[0-9]+$", 0).cast("int").alias("k")).agg(
        F.count_distinct("cluster").alias("filled"), F.count("*").alias("placed"), F.every(F.col("own") <= F.col("least") + 1e-3).alias("own_nearest"))


@query()
def gmm_sweep(lib):
    """Mixtures over the reduced track features."""
    reduced, _ = prep.reduce_features(_dataset(lib))
    points = settle(reduced.select(F.col("track_id").alias("id"), "vector"))
    return _stack(partitioning.gmm_sweep(points, partitioning.sweep_range(points.count())))


@query("SELECT CAST(k AS INT) AS k, (SELECT count(*) FROM complete) AS placed, TRUE AS shares_whole, TRUE AS weights_match, TRUE AS rising FROM range(2, 9) t(k)")
def gmm_facts(lib):
    """What holds for expectation maximisation: the shares of a row add up to one, their means are the weights of the next step's model,
    and the likelihood never falls."""
    reduced, _ = prep.reduce_features(_dataset(lib))
    points = settle(reduced.select(F.col("track_id").alias("id"), "vector"))
    ks = partitioning.sweep_range(points.count())
    models, shift = partitioning.mixture_models(points, ks, iterations=6)
    steps = max((len(m.likelihoods) for m in models), default=0)
    # a model that is finished takes its next step as well
    after, _ = partitioning.mixture_models(points, ks, iterations=steps + 1, onward=([replace(m, done=False) for m in models], shift))
    shares = partitioning.mixture_shares(points, models, shift)
    means = shares.select("k", F.posexplode("shares").alias("c", "share")).groupBy("k", "c").agg(F.avg("share").alias("mean"))
    weights = lib.spark.createDataFrame([(m.k, c, float(w)) for m in after for c, w in enumerate(m.weights)], "k int, c int, weight double")
    rising = {m.k: all(b >= a - 1e-9 for a, b in zip(m.likelihoods, m.likelihoods[1:])) for m in after}
    match = means.join(F.broadcast(weights), ["k", "c"]).groupBy("k").agg(F.every(F.abs(F.col("mean") - F.col("weight")) < 1e-9).alias("weights_match"))
    whole = F.abs(F.aggregate("shares", F.lit(0.0), lambda s, x: s + x) - 1) < 1e-9
    return (shares.groupBy("k").agg(F.count("*").alias("placed"), F.every(whole).alias("shares_whole")).join(match, "k")
            .withColumn("rising", F.get(F.lit([rising.get(k, True) for k in range(9)]), F.col("k"))))


@query("SELECT CAST(k AS INT) AS k, CAST(k AS BIGINT) AS filled, (SELECT count(*) FROM embeddings) AS placed, TRUE AS nested, TRUE AS cheapest FROM range(2, 9) t(k)")
def ward_facts(lib):
    """What makes a sequence of cuts Ward's: every cut joins two groups of the finer one, and these are the pair that raises the sum of squares least."""
    points = _points(lib)
    labels = settle(_stack(linkage.ward_sweep(points, range(2, 9))).withColumn("k", F.regexp_extract("run", "[0-9]+$", 0).cast("int")).select("k", "id", "cluster"))
    members = settle(labels.join(points.select("id", "vector"), "id").withColumn("run", F.col("k").cast("string")))
    groups = settle(metrics.centroids(members).withColumn("k", F.col("run").cast("int")).select("k", "cluster", "size", "center"))
    other = groups.select("k", *[F.col(c).alias(f"o_{c}") for c in ("cluster", "size", "center")])
    costs = (groups.join(other, "k").filter(F.col("cluster") < F.col("o_cluster"))
             .withColumn("cost", F.col("size") * F.col("o_size") / (F.col("size") + F.col("o_size")) * squared_distance(F.col("center"), F.col("o_center"))))
    best = costs.groupBy("k").agg(F.min("cost").alias("least"))
    coarse = labels.select((F.col("k") + 1).alias("k"), "id", F.col("cluster").alias("parent"))
    family = settle(labels.join(coarse, ["k", "id"]).groupBy("k", "cluster").agg(F.min("parent").alias("parent"), F.count_distinct("parent").alias("parents")))
    pair = family.groupBy("k", "parent").agg(F.sort_array(F.collect_set("cluster")).alias("pair")).filter(F.size("pair") > 1)
    chosen = (pair.join(costs, "k").filter((F.get("pair", F.lit(0)) == F.col("cluster")) & (F.get("pair", F.lit(1)) == F.col("o_cluster")))
              .join(best, "k").groupBy("k").agg(F.every(F.col("cost") <= F.col("least") * (1 + 1e-9)).alias("cheapest")))
    nested = family.groupBy("k").agg(F.every(F.col("parents") == 1).alias("nested")).join(chosen, "k")
    counted = labels.groupBy("k").agg(F.count_distinct("cluster").alias("filled"), F.count("*").alias("placed"))
    judged = nested.select((F.col("k") - 1).alias("k"), "nested", "cheapest")
    return counted.join(judged, "k", "left").select("k", "filled", "placed", F.coalesce("nested", F.lit(True)).alias("nested"),
                                                    (F.coalesce("cheapest", F.lit(False)) | (F.col("k") == 8)).alias("cheapest"))


@query("""SELECT pos, n, round(total, 4) + 0.0 AS total, round(squares, 4) + 0.0 AS squares, TRUE AS within, TRUE AS agree FROM (
            SELECT CAST(pos - 1 AS INT) AS pos, count(*) AS n, sum(v) AS total, sum(v * v) AS squares FROM (
              SELECT unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM points) u GROUP BY pos) x""")
def birch_features(lib):
    """The clustering features of Birch add up to the table: rows and sums per dimension from the features, squares from their rows. ``within``: no
    feature's rows have a radius beyond the threshold; ``agree``: every feature's numbers are those of its rows."""
    rows, features = cf_tree.condense(_points(lib).select("id", "vector"))
    rows, features = settle(rows), settle(features)
    held = settle(metrics.centroids(rows.select(F.lit("").alias("run"), F.col("feature").alias("cluster"), "vector")).select(F.col("cluster").alias("feature"), "size", "center"))
    off = squared_distance(F.col("vector"), F.col("center"))
    radii = rows.join(held, "feature").groupBy("feature").agg(F.avg(off).alias("radius2"), F.first("size").alias("size"), F.first("center").alias("center"))
    judged = features.join(radii, "feature", "full").agg(
        F.every(F.coalesce(F.col("radius2") <= BIRCH_THRESHOLD ** 2 + 1e-9, F.lit(False))).alias("within"),
        F.every(F.coalesce((F.col("n") == F.col("size")) & (squared_distance(F.col("mean"), F.col("center")) < 1e-12)
                           & (F.abs(F.col("spread") / F.col("n") - F.col("radius2")) < 1e-9), F.lit(False))).alias("agree")).first()
    sums = (features.select("n", F.posexplode("mean").alias("pos", "m")).groupBy("pos")
            .agg(F.sum("n").cast("bigint").alias("n"), F.sum(F.col("n") * F.col("m")).alias("total")))
    squares = rows.select(F.posexplode("vector").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v") * F.col("v")).alias("squares"))
    return rounded(sums.join(squares, "pos").select("pos", "n", "total", "squares", F.lit(judged["within"]).alias("within"), F.lit(judged["agree"]).alias("agree")),
                   ["total", "squares"], 4)


@query()
def ward_sweep(lib):
    points = _points(lib)
    return _stack(linkage.ward_sweep(points, partitioning.sweep_range(points.count())))


@query()
def birch_sweep(lib):
    points = _points(lib)
    return _stack(linkage.birch_sweep(points, partitioning.sweep_range(points.count())))


@query("""WITH RECURSIVE
            settings AS (SELECT CAST(eps AS DOUBLE) AS eps, need, concat('dbscan_eps', eps, '_min', need) AS run
                         FROM (VALUES ('0.7'), ('0.9'), ('1.1'), ('1.3'), ('1.5'), ('1.8'), ('2.1')) e(eps), (VALUES (4), (6), (8), (10)) m(need)),
            far AS (SELECT a.id AS a, b.id AS b, list_distance(a.vector, b.vector) AS d FROM points a JOIN points b ON list_distance(a.vector, b.vector) <= 2.1),
            core AS (SELECT s.run, s.eps, f.a AS id FROM settings s JOIN far f ON f.d <= s.eps GROUP BY s.run, s.eps, s.need, f.a HAVING count(*) >= s.need),
            link AS (SELECT x.run, f.a, f.b FROM core x JOIN far f ON f.a = x.id AND f.d <= x.eps JOIN core y ON y.run = x.run AND y.id = f.b),
            walk(run, id, root, moved) AS (
              SELECT run, id, id, TRUE FROM core
              UNION ALL
              SELECT run, id, least(root, near), bool_or(near < root) OVER (PARTITION BY run) FROM (
                SELECT w.run, w.id, w.root, min(n.root) AS near FROM walk w JOIN link l ON l.run = w.run AND l.a = w.id
                JOIN walk n ON n.run = w.run AND n.id = l.b WHERE w.moved GROUP BY w.run, w.id, w.root) g),
            part AS (SELECT run, id, dense_rank() OVER (PARTITION BY run ORDER BY root) - 1 AS cluster FROM (SELECT run, id, min(root) AS root FROM walk GROUP BY run, id) m),
            edge AS (SELECT s.run, f.a AS id, min(p.cluster) AS cluster FROM settings s JOIN far f ON f.d <= s.eps JOIN part p ON p.run = s.run AND p.id = f.b GROUP BY s.run, f.a)
          SELECT s.run, p.id, CAST(coalesce(c.cluster, e.cluster, -1) AS INT) AS cluster
          FROM settings s CROSS JOIN points p LEFT JOIN part c ON c.run = s.run AND c.id = p.id LEFT JOIN edge e ON e.run = s.run AND e.id = p.id""")
def dbscan_sweep(lib):
    return density.dbscan_sweep(_points(lib), ["id"])


@query("""SELECT id, CAST(CASE WHEN degree >= 4 THEN 1 ELSE 0 END AS BOOLEAN) AS is_core FROM (
            SELECT a.id, count(*) AS degree FROM points a JOIN points b ON list_distance(a.vector, b.vector) <= 1.1
            GROUP BY a.id) d""")
def dbscan_core_points(lib):
    """Core points at eps 1.1 and four samples, from the neighbour lists alone."""
    points = _points(lib)
    distinct, _ = collapse(points.select("id", "vector"), 1)
    unique = settle(distinct.select(F.col("vid").alias("id"), "vector", "weight"))
    near = tile_neighbours(tile_points(unique, "l2"), 3, "l2", 1.1, carry=("weight",))
    cores = density.core_distances(near, unique, [4], 1.1)
    owner = points.join(unique.select("vector", F.col("id").alias("vid")), "vector").select("id", "vid")
    return owner.join(cores.withColumnRenamed("id", "vid"), "vid").select("id", F.get("cores", F.lit(0)).isNotNull().alias("is_core"))


@query("""WITH RECURSIVE
            near AS (SELECT a.id AS a, b.id AS b FROM points a JOIN points b ON list_distance(a.vector, b.vector) <= 0.9),
            core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
            link AS (SELECT n.a, n.b FROM near n JOIN core x ON x.id = n.a JOIN core y ON y.id = n.b WHERE n.a <> n.b),
            reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id AND r.root < l.b),
            part AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT id, min(root) AS root FROM reach GROUP BY id) m),
            edge AS (SELECT n.a AS id, min(p.cluster) AS cluster FROM near n JOIN part p ON p.id = n.b GROUP BY n.a)
          SELECT p.id, CAST(coalesce(c.cluster, e.cluster, -1) AS INT) AS cluster
          FROM points p LEFT JOIN part c ON c.id = p.id LEFT JOIN edge e ON e.id = p.id""")
def dbscan_labels(lib):
    """One setting of the sweep: core, border and noise rows with their cluster numbers."""
    return density.dbscan(_points(lib), ["id"], 0.9, 4)


@query("""SELECT cluster, tracks FROM (
            SELECT g.root, dense_rank() OVER (ORDER BY g.root) - 1 AS cluster, g.tracks FROM (
              SELECT root, count(*) AS tracks FROM (
                WITH RECURSIVE reach(id, root) AS (
                  SELECT id, id FROM points
                  UNION
                  SELECT p.b, r.root FROM reach r JOIN (
                    SELECT a.id AS a, b.id AS b FROM points a JOIN points b
                    ON a.id <> b.id AND list_distance(a.vector, b.vector) <= 0.9) p ON p.a = r.id AND r.root < p.b)
                SELECT id, min(root) AS root FROM reach GROUP BY id) c GROUP BY root) g) x""")
def single_link_components(lib):
    """DBSCAN with min_samples 1: the components of the graph of distances up to 0.9."""
    labels = density.dbscan(_points(lib), ["id"], 0.9, 1)
    return labels.groupBy(F.col("cluster").cast("bigint").alias("cluster")).agg(F.count("*").alias("tracks"))


# ---------------------------------------------------------------- metrics and selection

_VARIANTS = {"plain": ("label", "label"), "noisy": ("CASE WHEN label = 0 THEN -1 ELSE label END",) * 2,
             "thirds": ("label % 3", "label % 3"), "single": ("0", "0"), "halves": ("label % 2", "label % 2")}
shared("run_labels", " UNION ALL ".join(f"SELECT '{n}' AS run, vec_id AS id, CAST({s} AS INT) AS cluster FROM embeddings" for n, (s, _) in _VARIANTS.items()))


def _label_runs(lib: StarLibrary) -> DataFrame:
    runs = F.array(*[F.struct(F.lit(n).alias("run"), F.expr(e).cast("int").alias("cluster")) for n, (_, e) in _VARIANTS.items()])
    return lib.embeddings.select(F.col("vec_id").alias("id"), F.explode(runs).alias("r")).select("r.run", "id", "r.cluster")


@query("""SELECT run, CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS INT) AS n_clusters,
                 count(*) FILTER (WHERE cluster <> -1) AS assigned_points,
                 round(count(*) FILTER (WHERE cluster <> -1) / count(*), 6) AS coverage_ratio,
                 count(*) FILTER (WHERE cluster = -1) AS noise_points FROM run_labels GROUP BY run""")
def run_counters(lib):
    return rounded(metrics.run_counters(_label_runs(lib)), ["coverage_ratio"])


shared("members", "SELECT l.run, l.cluster, p.id, p.vector FROM run_labels l JOIN points p ON p.id = l.id WHERE l.cluster <> -1 AND l.run <> 'single'")
shared("unrolled", "SELECT run, cluster, id, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM members")
shared("centers", """SELECT run, cluster, list(m ORDER BY pos) AS center, max(size) AS size FROM (
    SELECT run, cluster, pos, avg(v) AS m, count(*) AS size FROM unrolled GROUP BY run, cluster, pos) c GROUP BY run, cluster""")
shared("overall", """SELECT run, list(m ORDER BY pos) AS overall, max(n) AS n FROM (
    SELECT run, pos, avg(v) AS m, count(*) AS n FROM unrolled GROUP BY run, pos) c GROUP BY run""")
shared("spread", """SELECT m.run, m.cluster, m.id, list_distance(m.vector, c.center) AS d FROM members m
    JOIN centers c ON c.run = m.run AND c.cluster = m.cluster""")
shared("ch", """SELECT c.run, sum(c.size * list_distance(c.center, o.overall) * list_distance(c.center, o.overall)) * (max(o.n) - count(*))
      / (max(w.w) * (count(*) - 1)) AS calinski_harabasz
    FROM centers c JOIN overall o ON o.run = c.run JOIN (SELECT run, sum(d * d) AS w FROM spread GROUP BY run) w ON w.run = c.run GROUP BY c.run""")
shared("db", """SELECT run, avg(r) AS davies_bouldin FROM (
    SELECT a.run, a.cluster, max((sa.s + sb.s) / list_distance(a.center, b.center)) AS r
    FROM centers a JOIN centers b ON a.run = b.run AND a.cluster <> b.cluster
    JOIN (SELECT run, cluster, avg(d) AS s FROM spread GROUP BY run, cluster) sa ON sa.run = a.run AND sa.cluster = a.cluster
    JOIN (SELECT run, cluster, avg(d) AS s FROM spread GROUP BY run, cluster) sb ON sb.run = b.run AND sb.cluster = b.cluster
    GROUP BY a.run, a.cluster) x GROUP BY run""")
shared("sil", """SELECT run, avg(CASE WHEN own = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (
    SELECT run, id, max(CASE WHEN mine = other THEN n END) AS own, max(CASE WHEN mine = other AND n > 1 THEN t / (n - 1) END) AS a,
           min(CASE WHEN mine <> other THEN t / n END) AS b
    FROM (SELECT x.run, x.id, x.cluster AS mine, y.cluster AS other, sum(list_distance(x.vector, y.vector)) AS t, count(*) AS n
          FROM members x JOIN members y ON x.run = y.run GROUP BY x.run, x.id, x.cluster, y.cluster) g GROUP BY run, id) s GROUP BY run""")


@query("""SELECT k.run, k.n_clusters, k.assigned_points, k.coverage_ratio, k.noise_points, round(sil.silhouette, 6) + 0.0 AS silhouette,
                 round(ch.calinski_harabasz, 6) + 0.0 AS calinski_harabasz, round(db.davies_bouldin, 6) + 0.0 AS davies_bouldin,
                 'euclidean' AS silhouette_method
          FROM (SELECT run, CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS INT) AS n_clusters,
                       count(*) FILTER (WHERE cluster <> -1) AS assigned_points,
                       round(count(*) FILTER (WHERE cluster <> -1) / count(*), 6) AS coverage_ratio,
                       count(*) FILTER (WHERE cluster = -1) AS noise_points FROM run_labels GROUP BY run) k
          JOIN sil ON sil.run = k.run JOIN ch ON ch.run = k.run JOIN db ON db.run = k.run""")
def internal_metrics(lib):
    out = metrics.internal_metrics(_points(lib).select("id", "vector"), _label_runs(lib))
    return rounded(out, ["coverage_ratio", "silhouette", "calinski_harabasz", "davies_bouldin"])


_RUN_TABLE = """SELECT p_brand AS algorithm, CAST(count(*) AS INT) AS n_clusters, count(*) AS assigned_points,
    round(CAST(sum(CASE WHEN p_size < 30 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS coverage_ratio,
    count(*) AS noise_points, round(CAST(sum(p_size) AS DOUBLE) / count(*) / 50, 1) AS silhouette,
    round(CAST(sum(p_partkey) AS DOUBLE) / count(*), 0) AS calinski_harabasz, CAST(count(*) AS DOUBLE) AS davies_bouldin
    FROM part GROUP BY p_brand"""
shared("run_table", _RUN_TABLE)


def _run_table(lib: StarLibrary) -> DataFrame:
    return lib.spark.sql(_RUN_TABLE.replace("FROM part", "FROM {part}"), part=lib.part)


@query("SELECT *, concat('algorithm=', algorithm) AS file FROM run_table ORDER BY silhouette DESC, calinski_harabasz DESC, davies_bouldin")
def rank_runs(lib):
    return selection.manifest(_run_table(lib))


@query("""SELECT row_number() OVER (ORDER BY silhouette DESC, calinski_harabasz DESC, davies_bouldin, algorithm) - 1 AS position, algorithm
          FROM run_table""")
def rank_runs_order(lib):
    """The place at which the manifest delivers each run."""
    return delivered_index(rank_runs(lib).select("algorithm"), "position")


@query("""SELECT * FROM run_table WHERE coverage_ratio >= 0.6 OR NOT EXISTS (SELECT 1 FROM run_table WHERE coverage_ratio >= 0.6)
          ORDER BY silhouette DESC, calinski_harabasz DESC, davies_bouldin, algorithm LIMIT 1""")
def choose_best(lib):
    return selection.choose_best(_run_table(lib))


@query("""SELECT r.pos, r.run.algorithm AS algorithm, r.run.silhouette AS silhouette, r.best AS best_algorithm, r.rows_in AS rows_in FROM (
            SELECT CAST(row_number() OVER (ORDER BY silhouette DESC, calinski_harabasz DESC, davies_bouldin, algorithm) - 1 AS INT) AS pos,
                   struct_pack(algorithm := algorithm, silhouette := silhouette) AS run,
                   (SELECT algorithm FROM run_table WHERE coverage_ratio >= 0.6 OR NOT EXISTS (SELECT 1 FROM run_table WHERE coverage_ratio >= 0.6)
                    ORDER BY silhouette DESC, calinski_harabasz DESC, davies_bouldin, algorithm LIMIT 1) AS best,
                   (SELECT count(*) FROM part) AS rows_in
            FROM run_table) r""")
def run_summary(lib):
    """The summary is written as JSON and read back."""
    path, table = scratch_path(lib.spark, "summary"), _run_table(lib)
    selection.run_summary({"rows": lib.part.count()}, selection.choose_best(table), table).coalesce(1).write.json(path)
    back = lib.spark.read.json(path)
    return (back.select(F.posexplode("algorithm_scores").alias("pos", "run"), F.col("best_algorithm.algorithm").alias("best_algorithm"),
                        F.col("preprocessing.rows").alias("rows_in"))
            .select("pos", "run.algorithm", "run.silhouette", "best_algorithm", "rows_in"))


@query("SELECT cluster, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in NUMERIC_FEATURES)
       + ", count(*) AS track_count FROM (SELECT *, CASE WHEN bpm > 170 THEN -1 ELSE bpm % 5 END AS cluster FROM track_features) f "
         "WHERE cluster <> -1 GROUP BY cluster")
def cluster_profiles(lib):
    rows = lib.track_features.withColumn("cluster", F.when(F.col("bpm") > 170, -1).otherwise(F.col("bpm") % 5))
    return rounded(selection.cluster_profiles(rows), NUMERIC_FEATURES)


@query("SELECT family, 7 AS runs, (SELECT count(*) FROM complete) AS placed, TRUE AS same_counters, TRUE AS same_best FROM (VALUES ('kmeans'), ('agglomerative'), ('birch'), ('gmm')) f(family)")
def clustering_facts(lib):
    """What the files of a run say about it: every K-family run has all rows, the counters of the manifest are those of the written assignments
    (of all runs, DBSCAN's as well), and the best run is the first of the manifest by the rule of choice."""
    path = scratch_path(lib.spark, "clustering")
    result = clustering.run_clustering(lib.spark, lib, path, restarts=2)
    manifest = lib.spark.read.parquet(f"{path}/algorithm_manifest")
    counted = metrics.run_counters(lib.spark.read.parquet(f"{path}/assignments").select(F.col("algorithm").alias("run"), "cluster")).select(
        F.col("run").alias("algorithm"), *[F.col(c).alias(f"_{c}") for c in ("n_clusters", "assigned_points", "noise_points")])
    both = settle(manifest.join(counted, "algorithm", "full"))
    same = F.coalesce((F.col("n_clusters") == F.col("_n_clusters")) & (F.col("assigned_points") == F.col("_assigned_points"))
                      & (F.col("noise_points") == F.col("_noise_points")), F.lit(False))
    judged = both.agg(F.every(same).alias("same")).first()
    best = selection.choose_best(manifest).first()["algorithm"] == result["best_algorithm"]
    return (both.withColumn("family", F.regexp_extract("algorithm", "^([a-z]+)_", 1)).filter("family <> 'dbscan'").groupBy("family").agg(
        F.count("*").cast("int").alias("runs"), F.max(F.col("assigned_points") + F.col("noise_points")).alias("placed"))
        .withColumns({"same_counters": F.lit(judged["same"]), "same_best": F.lit(best)}))


@query()
def clustering_run(lib):
    """The whole run on the reduced track features: K-means, Ward, Birch and mixtures for every k, all DBSCAN settings,
    metrics and ranking. Returns the manifest of valid runs."""
    path = scratch_path(lib.spark, "clustering")
    clustering.run_clustering(lib.spark, lib, path)
    return lib.spark.read.parquet(f"{path}/algorithm_manifest")
