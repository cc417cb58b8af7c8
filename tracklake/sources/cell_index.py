"""Stored similarity index laid out by place: a search opens the cells that can still hold a better row, and no others.

Rows lie in one folder per cell, the rows nearest to one of the pivots. A side table holds every cell's pivot, radius and number of rows; another one
finds the cell of a track. No row of a cell can have an inner product with the query above that of the pivot plus the radius (times the
query's length), so cells are read in the order of this bound until the k-th best score lies above the next one. The result is that of a full scan."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.functions.vectors import dot_literal
from tracklake.operators.search import RESULT
from tracklake.operators.tiles import block_cost, exact_cost, matrix

CELL_ROWS, MOST_CELLS, PLACES = 512, 4096, 64
PLACED_ROWS = 256  # rows that a task compares with all pivots at a time: 8 MB a matrix at MOST_CELLS


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The number of each row's nearest pivot; what is held of the distances does not grow with the rows."""
    return np.concatenate([block_cost(vectors[i:i + PLACED_ROWS], pivots, "l2").argmin(1) for i in range(0, len(vectors), PLACED_ROWS)])


def write_cells(index: DataFrame, path: str, cell_rows: int = CELL_ROWS) -> int:
    """Write ``index`` (track_id, vector and what results show; a stored table) by cells; returns their number."""
    wanted = min(MOST_CELLS, max(1, math.ceil(index.count() / cell_rows)))
    chosen = index.orderBy(F.xxhash64("track_id"), "track_id").limit(wanted).select("vector").collect()  # the pivots, at most MOST_CELLS
    pivots = np.array([r["vector"] for r in chosen], dtype=np.float64) if chosen else np.zeros((0, 1))

    def place(batches):
        for batch in batches:
            if len(batch):
                vectors = matrix(batch["vector"])
                cell = nearest_pivots(vectors, pivots)
                yield batch.assign(cell=cell.astype("int32"), off=exact_cost(vectors, pivots[cell], "l2"))

    schema = T.StructType([*index.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("off", T.DoubleType())])
    placed = index.mapInPandas(place, schema)
    # One writer per cell and slice: few files, and a cell with most of the rows does not go through one task.
    placed.repartition("cell", F.pmod(F.xxhash64("track_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    stored = index.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    named = index.sparkSession.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    sizes = stored.groupBy("cell").agg(F.max("off").alias("radius"), F.count("*").alias("n_rows"))
    sizes.join(F.broadcast(named), "cell").write.mode("overwrite").parquet(f"{path}/cells")
    (stored.select("track_id", "cell", F.pmod(F.xxhash64("track_id"), F.lit(PLACES)).cast("int").alias("part")).repartition("part")
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/places"))
    return len(pivots)


@dataclass
class Found:
    rows: DataFrame       # as a search of the whole index gives them
    cells_read: int
    cells: int


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        side = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows
        self.rows = spark.read.parquet(f"{path}/rows") if side else None
        self.cells = [r["cell"] for r in side]
        self.pivots = np.array([r["pivot"] for r in side])
        self.radii = np.array([r["radius"] for r in side])

    def vector_of(self, track_id: str) -> list[float] | None:
        """The vector of a track: one part of the places and one cell are opened."""
        if self.rows is None:
            return None
        part = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(track_id)), F.lit(PLACES)).cast("int")).scalar()
        places = self.spark.read.parquet(f"{self.path}/places")
        place = places.filter((F.col("part") == part) & (F.col("track_id") == track_id)).select("cell").head()
        if place is None:
            return None
        return self.rows.filter((F.col("cell") == place["cell"]) & (F.col("track_id") == track_id)).select("vector").head()["vector"]

    def search(self, vector: list[float], k: int = 5, exclude_ids: list | None = None) -> Found:
        """The k best rows by inner product, ties to the smaller id. Cells are opened in waves of 1, 2, 4, ..."""
        query = np.array(vector, dtype=np.float64)
        bounds = (self.pivots @ query + self.radii * np.linalg.norm(query) + 1e-9) if self.cells else np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        best, read, wave = [], 0, 1
        while read < len(order) and not (len(best) == k and best[-1]["score"] > bounds[order[read]]):
            opened = [self.cells[i] for i in order[read:read + wave]]
            scored = self.rows.filter(F.col("cell").isin(opened)).withColumn("score", dot_literal(F.col("vector"), vector))
            if exclude_ids:
                scored = scored.filter(~F.col("track_id").isin(list(exclude_ids)))
            found = scored.orderBy(F.desc("score"), "track_id").limit(k).select(*[c for c in RESULT if c != "rank"]).collect()
            best = sorted([*best, *found], key=lambda r: (-r["score"], r["track_id"]))[:k]
            read, wave = read + len(opened), 2 * wave
        shown = ", ".join(f"{c} {'double' if c == 'score' else 'string'}" for c in RESULT[1:])
        return Found(self.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(best)], f"rank int, {shown}"), read, len(self.cells))

    def search_by_track_id(self, track_id: str, k: int = 5) -> Found:
        vector = self.vector_of(track_id)
        if vector is None:
            raise ValueError(f"Track id not found: {track_id}")
        return self.search(vector, k, [track_id])
