"""Class labels held in model metadata JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: places where a metadata document may hold its label list, in order of preference ----
LABEL_PATHS = ["$.classes", "$.schema.classes", "$.classes.names", "$.model.classes", "$.annotations"]


def labels_from_metadata(body: Column) -> Column:
    """First path holding a non-empty list of strings, or of objects that all carry a name."""

    def at(path: str) -> Column:
        text = F.get_json_object(body, path)
        items = F.from_json(text, "array<string>")
        is_list = text.startswith("[") & (F.size(items) > 0)
        # get_json_object drops the quotes of scalars, from_json keeps nested objects as text.
        plain = F.from_json(text, "array<variant>")
        kinds = F.transform(plain, lambda v: F.schema_of_variant(v))
        named = F.transform(items, lambda x: F.get_json_object(x, "$.name"))
        return F.when(is_list & F.forall(kinds, lambda k: k == "STRING"), items).when(
            is_list & F.forall(kinds, lambda k: k.startswith("OBJECT")) & F.forall(named, lambda n: n.isNotNull()),
            named)

    return F.coalesce(*[at(p) for p in LABEL_PATHS])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, labels) for metadata files, one JSON document each."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file"), labels_from_metadata(F.col("value")).alias("labels"))
