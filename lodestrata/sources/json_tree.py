"""Leaves of JSON texts, by VARIANT values that are opened level by level, without a Python row.

Each level is one lateral explode of the containers of the level before; a level is written, so that no text is
parsed twice. Work on a level grows with what it holds, and the number of levels with the depth of the texts.

Edge cases: a null, blank or malformed text has no leaves, nor has one that repeats a key within an object. Null
leaves and empty containers are no leaves. Keys are taken as they are. Within an object, order is by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import written

_OPEN = """SELECT {keys}, l.path, e.pos AS pos, CASE WHEN e.key IS NULL THEN concat(l.path, '[', e.pos, ']') ELSE concat(l.path, '.', e.key) END AS next, e.value AS v
FROM {level} l, LATERAL variant_explode(l.v) e"""


def json_leaves(rows: DataFrame, column: str = "value") -> DataFrame:
    """(other columns, path, kind, leaf): a row a leaf; path as in ``$.a[0].b``, kind as Spark names its type, leaf as
    text. Other columns must not be named path, kind or leaf."""
    spark, keys = rows.sparkSession, [c for c in rows.columns if c != column]
    if {"path", "kind", "leaf"} & set(keys):
        raise ValueError("columns path, kind and leaf are made here")
    level = rows.select(*[F.col(f"`{c}`") for c in keys], F.lit("$").alias("path"), F.try_parse_json(F.col(f"`{column}`")).alias("v"))
    out = None
    while True:
        level = written(level.where("v is not null").withColumn("kind", F.schema_of_variant("v")), "json")
        plain = level.where("kind not like 'OBJECT<%' and kind not like 'ARRAY<%' and kind <> 'VOID'")
        leaves = plain.select(*[F.col(f"`{c}`") for c in keys], "path", "kind", F.expr("cast(v as string)").alias("leaf"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.where("kind like 'OBJECT<%' or kind like 'ARRAY<%'")
        if inner.isEmpty():
            return out
        opened = spark.sql(_OPEN.replace("{keys}, ", "".join(f"l.`{c}`, " for c in keys)), level=inner)
        level = opened.select(*[F.col(f"`{c}`") for c in keys], F.col("next").alias("path"), "v")
