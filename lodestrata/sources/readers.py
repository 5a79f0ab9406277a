"""Readers: text, JSON, JSONL, DOCX, PDF pages by an injected extractor, tables, question files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunking

EXTENSIONS = ("txt", "pdf", "docx", "json", "jsonl")
CHUNK_SCHEMA = "source string, seq int, content string, page_info string"


def source_name(path) -> object:
    """data/<file name> of a file's path."""
    return F.concat(F.lit("data/"), F.element_at(F.split(path, "/"), -1))


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(source, value): whole text files."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(source_name(F.col("_metadata.file_path")).alias("source"), "value")


def read_txt_chunks(spark: SparkSession, path: str, separator: str = "\n\n", minimum: int = chunking.MERGE_MIN_CHARS) -> DataFrame:
    return chunking.text_chunks(read_texts(spark, path), separator, minimum)


def flatten(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, text) of the leaves of a JSON value in order, without null and blank ones. A truth value reads
    True or False."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}.{k}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif v is not None and (leaf := str(v).strip()):
            yield at, leaf


def roots(data) -> list[tuple[str, object]]:
    """(path, value) of what becomes one record each: entries of a list; of an object with a list of at least
    two containers the entries of the longest one, its other sections, and its scalars as one root; any
    other value whole."""
    if isinstance(data, list):
        return [(f"$[{i}]", v) for i, v in enumerate(data)]
    lists = {k: v for k, v in data.items() if isinstance(v, list) and len(v) >= 2 and all(isinstance(x, (dict, list)) for x in v)} if isinstance(data, dict) else {}
    if not lists:
        return [("$", data)]
    main = max(lists, key=lambda k: len(lists[k]))
    plain = {k: v for k, v in data.items() if not isinstance(v, (dict, list))}
    out = [(f"$.{main}[{i}]", v) for i, v in enumerate(data[main])]
    out += [(f"$.{k}", v) for k, v in data.items() if k != main and k not in plain]
    return out + ([("$.metadata", plain)] if plain else [])


def record_chunks(path: str, value) -> list[tuple[str, str]]:
    """(text, locator) of one record; one chunk for each leaf if the record is too long."""
    leaves = list(flatten(value, path))
    fields = [(p[len(path) :].lstrip(".") or path, v) for p, v in leaves]
    bands = ([], [], [])
    for name, v in fields:
        if len(v) <= 60:
            bands[0].append(f"{name}: {v}")
        elif len(v) <= 400:
            bands[1].append(f"{name}: {v}")
        else:
            bands[2].append(f"{name}: {v[:350].rsplit(' ', 1)[0]}…")
    text = "\n".join(bands[0] * 2 + bands[1] + bands[2])
    if len(text) <= chunking.RECORD_MAX:
        return [(text, path)] if text else []
    return [(f"{name}: {v}", p) for (name, v), (p, _) in zip(fields, leaves)]


def _json_rows(lines: bool):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, value in zip(batch["source"], batch["value"]):
                if lines:
                    found = []
                    for n, line in enumerate(value.split("\n"), 1):
                        try:
                            found += [(t, f"satır {n}") for t, _ in record_chunks("$", json.loads(line))] if line.strip() else []
                        except ValueError:
                            continue  # a malformed line is passed over
                else:
                    try:
                        data = json.loads(value)
                    except ValueError as e:
                        raise ValueError(f"{source}: not JSON: {e}") from e
                    found = [c for path, v in roots(data) for c in record_chunks(path, v)]
                out += [(source, i, text, locator) for i, (text, locator) in enumerate(found)]
            yield pd.DataFrame(out, columns=["source", "seq", "content", "page_info"])

    return rows


def read_json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON files; a malformed file stops the job with its name."""
    return read_texts(spark, path, "*.json").mapInPandas(_json_rows(False), CHUNK_SCHEMA)


def read_jsonl_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSONL files, one record a line; blank and malformed lines are passed over."""
    return read_texts(spark, path, "*.jsonl").mapInPandas(_json_rows(True), CHUNK_SCHEMA)


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraph texts of a DOCX file, from its XML."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p")]


def _docx_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(s, n, t) for s, c in zip(batch["source"], batch["content"]) for n, t in enumerate(docx_paragraphs(bytes(c)), 1)]
        yield pd.DataFrame(out, columns=["source", "n", "text"])


def read_docx_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of DOCX files: blocks between blank paragraphs, located as ``bölüm N``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    rows = files.select(source_name(F.col("path")).alias("source"), "content").mapInPandas(_docx_rows, "source string, n int, text string")
    b = chunking.blocks(rows)
    return b.select("source", (F.col("block") - 1).cast("int").alias("seq"), "content", F.concat(F.lit("bölüm "), F.col("block").cast("string")).alias("page_info"))


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[tuple[str, bool]]]) -> DataFrame:
    """Chunks of PDF files; extract(bytes) gives (text, recognised by OCR) of each page."""
    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s, n, t, bool(o)) for s, c in zip(batch["source"], batch["content"]) for n, (t, o) in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(out, columns=["source", "page", "text", "recognised"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return chunking.continued_pages(files.select(source_name(F.col("path")).alias("source"), "content").mapInPandas(pages, "source string, page int, text string, recognised boolean"))


def dotted(df: DataFrame) -> DataFrame:
    """Nested struct fields as columns named a.b; arrays stay."""
    def walk(kind: T.StructType, prefix: list[str]) -> list:
        out = []
        for f in kind.fields:
            at = [*prefix, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(".".join(at)))
        return out

    return df.select(*walk(df.schema, []))


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(records, metadata) of a JSON file: a list, or an object's longest list of objects; the rest of the
    object is metadata. An object without such a list has metadata and no records."""
    raw = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in raw.columns:
        raise ValueError(f"{path}: not JSON")
    lists = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    start = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", "^\\s+", "")), 1, 1)).first()
    if start[0] == "[":
        return dotted(raw), {}
    sizes = raw.agg(*[F.max(F.size(c)).alias(c) for c in lists]).first().asDict() if lists else {}
    main = max(sizes, key=lambda c: sizes[c] or 0, default=None)
    rest = [F.col(f"`{c}`") for c in raw.columns if c != main]  # what is not the records comes to the driver
    meta = json.loads(raw.select(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).first()[0]) if rest else {}
    if main is None:
        return spark.createDataFrame([], "empty string").drop("empty"), meta
    return dotted(raw.select(F.inline(main))), meta


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files with a header, all columns as text; a byte order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
