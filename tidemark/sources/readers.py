"""Readers of raw source batches by file type."""

from __future__ import annotations

from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import q

#: Texts that stand for a missing value in CSV sources.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class UnsupportedInput(ValueError):
    """The input is of no type that can be read."""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; missing-value texts are null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, inferSchema=False)
    return df.select(*[F.when(~q(c).isin(*MISSING_TEXTS), q(c)).alias(c) for c in df.columns])


#: The column that keeps what could not be parsed.
CORRUPT = "_corrupt_record"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line. A line that does not parse stays as a row whose text is in ``CORRUPT``."""
    schema = spark.read.option("columnNameOfCorruptRecord", CORRUPT).json(path).schema
    if CORRUPT not in schema.fieldNames():
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(row.alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Line JSON, or one document; what the first byte that is not blank and its line say decides.

    An array, or an object that goes on over its line, is one document, which is read whole; anything
    else is read by lines, split over tasks, whatever single lines look like.
    """
    head = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("v")).head(2)
    if not head:
        return read_lines(spark, path)
    first = head[0].v
    document = first.startswith("[") or (first.startswith("{") and len(head) > 1 and not first.endswith("}") and not head[1].v.startswith("{"))
    return spark.read.option("multiLine", True).json(path) if document else read_lines(spark, path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that parsed, without ``CORRUPT``, and the texts of those that did not (raw_json, reason)."""
    if CORRUPT not in df.columns:
        return df, df.select(F.lit("").alias("raw_json"), F.lit("unreadable").alias("reason")).limit(0)
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("raw_json"), F.lit("unreadable").alias("reason"))


def load_input(spark: SparkSession, source: Any) -> DataFrame:
    """A DataFrame, a list of records, or a path by suffix: csv, parquet, ndjson, jsonl, ndj, json."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spark.createDataFrame(source)
    suffix = PurePosixPath(str(source)).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, str(source))
    if suffix == ".parquet":
        return spark.read.parquet(str(source))
    if suffix in (".ndjson", ".jsonl", ".ndj"):
        return read_lines(spark, str(source))
    if suffix == ".json":
        return read_json(spark, str(source))
    raise UnsupportedInput(f"cannot read {source!r}")
