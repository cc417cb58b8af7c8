"""Helpers shared by the text operators: Arrow row mapping, document identity, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracklake.session import settle

SLICE = 512  # rows handled at once inside a task, so that memory does not follow the batch size of the session


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(docs: DataFrame, fn: Callable[[str], tuple], result: str, id_col: str = "doc_id",
              text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One output row per row of ``docs``: the id, the ``extra`` columns and the tuple ``fn(text)`` (``result`` is its DDL).

    Null texts count as empty. Only the named columns are read, so further columns of any name do no harm."""
    kept = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *extra)
    carried_fields = [f for f in kept.schema if f.name != "_text"]
    schema = StructType(carried_fields + StructType.fromDDL(result).fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            made = zip(*(fn(t) for t in part.column("_text").to_pylist()))
            carried = [part.column(n) for n in part.schema.names if n != "_text"]
            types = arrow.types
            yield pa.RecordBatch.from_arrays(
                [c.cast(t) for c, t in zip(carried, types)]
                + [pa.array(list(c), t) for c, t in zip(made, types[len(carried):])], schema=arrow)

    return kept.mapInArrow(run, schema)


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with one row per id, as operators over pairs need it.

    Rows without an id have no identity and are left out. Of the rows that repeat an id the greatest text is taken;
    whether there are any is seen from the ids alone, so that tables without repeats are not moved."""
    plain = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    repeated = plain.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return plain.groupBy("doc_id").agg(F.max("text").alias("text")) if repeated else plain


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id reachable.

    Every round takes the smallest label among the neighbours and then the label of that label, so chains shorten
    to half and stars need one round. Labels are settled as files between the rounds."""
    both = edges.select(F.col("a"), F.col("b")).union(edges.select(F.col("b"), F.col("a")))
    both = settle(both.filter("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
                    .select("id", F.least("id", "near").alias("component")))
    while True:
        seen = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        near = labels.join(seen, "id").select("id", "component", F.least("component", "near").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        after = settle(near.join(jump, "near", "left").select(
            "id", F.least("near", F.coalesce("far", "near")).alias("component"),
            (F.least("near", F.coalesce("far", "near")) < F.col("component")).alias("moved")))
        if not after.filter("moved").limit(1).count():
            return after.drop("moved")
        labels = after.drop("moved")


def drawn(share: float, *keys) -> Column:
    """Whether a row belongs to the share of rows that the hash of ``keys`` draws; exact to 2**-53, so that a share of few rows of very
    many is not rounded to none."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*keys).bitwiseAND(F.lit(2**63 - 1)) < F.lit(int(share * 2**63))


BROADCAST_IDS = 1_000_000  # ids of eight bytes: a broadcast of at most some tens of megabytes


def only(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose doc_id is among the stored ``ids`` (``left_anti``: is not): by broadcast while these are few, so that
    no text is moved, else by a shuffled join with the same rows."""
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def filter_rows(docs: DataFrame, keep: Callable[[str], bool], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, for whose text (null: empty) ``keep`` holds."""

    def run(batches):
        for part in slices(batches):
            yield part.filter(pa.array([bool(keep(t or "")) for t in part.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def replace_text(docs: DataFrame, change: Callable[[str | None], str | None], text_col: str = "text") -> DataFrame:
    """``docs`` with ``change`` applied to every text; all other columns as they are."""

    def run(batches):
        for part in slices(batches):
            place = part.schema.get_field_index(text_col)
            column = pa.array([change(t) for t in part.column(place).to_pylist()], part.schema.field(place).type)
            yield part.set_column(place, part.schema.field(place), column)

    return docs.mapInArrow(run, docs.schema)
