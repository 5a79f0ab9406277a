"""Shared helpers: words, shared storage, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WS_CLASS = "[ \\t\\n\\x0B\\f\\r]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text as array<string>; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+"))


def count_matches(text: Column, char_class: str) -> Column:
    """How many characters of a text belong to a class; 0 for null."""
    return F.size(F.split(F.coalesce(text, F.lit("")), char_class, -1)) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir.

    Where the setting is unset, a session on one machine (a local master) uses a folder of our own; on a
    cluster that is an error, as no machine's temporary folder is shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "lodestrata-shared")
    return f"{root.rstrip('/')}/lodestrata/{spark.sparkContext.applicationId}"


_made: list[str] = []


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder. Results that still have to be read
    come from there, so call it when they have been."""
    _delete(spark, shared_dir(spark))
    _made.clear()


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write the table that make() describes, and delete the intermediate tables that it has written."""
    since = len(_made)
    out = materialize(make(), name)
    for uri in _made[since:-1]:
        _delete(spark, uri)
    del _made[since:-1]
    return out


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str = "__row") -> Column:
    """All columns as one struct, so that working columns cannot clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application: Python workers import it by name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="lodestrata-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
