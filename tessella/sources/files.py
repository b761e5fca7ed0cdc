"""CSV, TSV, JSON and line-delimited JSON files as DataFrames of dimension texts or of inferred types."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.coerce import dimension_string

SEPARATORS = {".csv": ",", ".tsv": "\t"}
JSON = (".json", ".ndjson")


def read_source(spark: SparkSession, path: str, typed: bool = False, multi_line: bool | None = None) -> DataFrame:
    """The rows of a file or folder of files, told apart by the suffix of ``path``.

    Without ``typed`` every column is text: booleans read ``True`` and ``False``, nulls and
    missing keys of JSON ``None``, empty and missing cells of CSV the empty text, nested
    values JSON text. A CSV file needs a header. Quoted cells may hold line breaks, which
    makes a file one task; large files are split where no line has an odd number of
    quotes, so that none can. ``multi_line`` says so beforehand and saves that look.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in SEPARATORS:
        if multi_line is None:
            odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2))
            multi_line = spark.read.text(path).where(odd == 1).first() is not None
        reader = spark.read.option("header", True).option("inferSchema", typed).option("multiLine", multi_line)
        frame = reader.option("sep", SEPARATORS[suffix]).option("quote", '"').option("escape", '"').csv(path)
        return frame if typed else frame.select(*(F.coalesce(F.col(_q(c)), F.lit("")).alias(c) for c in frame.columns))
    if suffix in JSON:
        frame = _read_json(spark, path)
        if not frame.columns:
            raise ValueError(f"no columns in {path}")
        return frame if typed else _as_text(spark, path, frame.schema)
    raise ValueError(f"unsupported file type {suffix or path!r}: expected .csv, .tsv, .json or .ndjson")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _by_line(spark: SparkSession, path: str) -> bool:
    """Is the first line that is not blank an object by itself?"""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    try:
        return first is not None and isinstance(json.loads(first["value"]), dict)
    except ValueError:
        return False


def _read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", not _by_line(spark, path))
    return (reader if schema is None else reader.schema(schema)).json(path)


def _as_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Numbers are read as the text they are written in, so 92 stays 92 beside 0.5."""
    raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NumericType) else f.dataType) for f in schema])
    frame = _read_json(spark, path, raw)
    return frame.select(*(dimension_string(F.col(_q(f.name)), f.dataType).alias(f.name) for f in raw))
