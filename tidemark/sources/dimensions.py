"""Dimension and history loaders, report and model files."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import present, q
from tidemark.sources.store import EventStore


def load_dimension(df: DataFrame, rename: Mapping[str, str], types: Mapping[str, str], constants: Mapping[str, Any] | None = None) -> DataFrame:
    """Renamed and cast to the store's types; values that do not cast are null; ``loaded_at`` stamped."""
    cols = [(q(src).try_cast(types.get(dst, "string"))).alias(dst) for src, dst in rename.items() if src in df.columns]
    cols += [F.lit(v).alias(k) for k, v in (constants or {}).items()]
    return df.select(*cols, F.current_timestamp().alias("loaded_at"))


def load_history(df: DataFrame, required: Sequence[str], key: str, day: str, numbers: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Kept and rejected rows: a blank key or an unreadable day rejects; the smallest row of a key stays."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    df = df.withColumn(day, q(day).try_cast("date"))
    for c in numbers:
        df = df.withColumn(c, q(c).try_cast("double"))
    good = present(q(key)) & q(day).isNotNull()
    kept = df.where(good).groupBy(q(key)).agg(F.min(F.struct(day, *[c for c in df.columns if c not in (key, day)])).alias("r")).select(key, "r.*").select(*df.columns)
    return kept, df.where(~F.coalesce(good, F.lit(False)))


def fill_lender(events: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with the lender of their account where they lack one, and the number left without.

    An account with several lenders or none raises at run time through the assertion column."""
    per = accounts.groupBy("account_id").agg(F.min("lender_id").alias("tm_lender"), F.count_distinct("lender_id").alias("tm_n"))
    checked = per.withColumn("tm_lender", F.when(F.col("tm_n") == 1, F.col("tm_lender")).otherwise(F.raise_error(F.lit("an account must have one lender"))))
    out = events.join(checked.drop("tm_n"), "account_id", "left").withColumn("lender_id", F.coalesce("lender_id", "tm_lender")).drop("tm_lender")
    return out, out.agg(F.count_if(F.col("lender_id").isNull()).alias("n_unmatched"))


def write_report(folder: str, name: str, tables: Mapping[str, DataFrame], most: int = 10_000) -> None:
    """Markdown and JSON of small result tables, and every table as Parquet beside them.

    Files are written through the cluster's file system, so ``folder`` may be any of its addresses. A
    table of more than ``most`` rows is no report: its text says so and names the Parquet folder, which
    always holds all rows.
    """
    out: dict[str, Any] = {}
    text = [f"# {name}", ""]
    spark = None
    for title, df in tables.items():
        spark = df.sparkSession
        stem = re.sub(r"[^0-9A-Za-z_-]+", "_", title)
        at = f"{folder.rstrip('/')}/{name}.tables/{stem}"
        df.write.mode("overwrite").parquet(at)
        whole = spark.read.schema(df.schema).parquet(at)
        text += [f"## {title}", ""]
        if (n := whole.count()) > most:
            out[title] = {"rows": n, "parquet": at}
            text += [f"{n} rows, in {at}", ""]
            continue
        rows = [r.asDict() for r in whole.collect()]
        out[title] = rows
        text += ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        text += ["| " + " | ".join(str(r[c]) for c in df.columns) + " |" for r in rows] + [""]
    if spark is not None:
        write_text(spark, f"{folder.rstrip('/')}/{name}.md", "\n".join(text))
        write_text(spark, f"{folder.rstrip('/')}/{name}.json", json.dumps(out, default=str, indent=1))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_output(df: DataFrame, path: str, order: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """The Parquet sink: rows sorted by ``order`` over all files and inside each, in the frame's column order."""
    out = df.repartitionByRange(*[q(c) for c in (*partition_by, *order)]).sortWithinPartitions(*[q(c) for c in (*partition_by, *order)])
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def run_ingest_plan(store: EventStore, steps: Sequence[tuple[str, DataFrame | None, dict[str, Any] | None]], only: Sequence[str] = ()) -> dict[str, dict[str, int]]:
    """The steps (name, frame, mapping) in order; a step without a frame is missing, one without a
    mapping is rejected as a whole into the dead letters. Nothing raises on data."""
    from tidemark.operators.mapping import raw_json
    from tidemark.streaming.intake import ingest_batch

    totals: dict[str, dict[str, int]] = {}
    for name, df, spec in steps:
        if only and name not in only:
            continue
        if df is None:
            totals[name] = {"missing": 1}
        elif spec is None:
            body = df.select(raw_json(df, None).alias("raw_json"), F.lit("missing_mapping").alias("reason"))
            dead = body.withColumn("row_hash", F.substring(F.sha2(F.concat(F.lit(f"{name}|"), "raw_json"), 256), 1, 32)).withColumn("source", F.lit(name))
            totals[name] = {"dead_lettered": store.insert_or_ignore("dead_letter", dead.select("row_hash", "raw_json", "reason", "source"), ["row_hash"])}
        else:
            totals[name] = ingest_batch(store, df, spec)
    return totals
