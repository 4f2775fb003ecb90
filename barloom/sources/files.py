"""Sources and sinks: bar files, discovery by symbol, fallback between sources, configuration, partitioned output."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import market_date, stem

# What stage outputs append to a symbol's file name.
SUFFIXES = ("_unseen_test_labeled", "_unseen_test", "_train_labeled", "_train")


def read_bars(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """All CSV files below path as one table, with symbol from the file name and an ordinal in file order.

    Without a schema every column is text; typed reading is P1 and P2 on the columns that are used. Only requested columns that
    exist are kept, and only these are parsed.
    """
    r = spark.read.option("header", True).option("recursiveFileLookup", True).option("encoding", "UTF-8")
    raw = (r.schema(schema) if schema else r).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    keep = [c for c in (columns or raw.columns) if c in raw.columns]
    return raw.select(*keep, stem(F.col("_metadata.file_path"), suffixes).alias("symbol"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("ingest_ordinal"))


def read_prepared(spark: SparkSession, path: str, d: str = "d", columns: list[str] | None = None) -> DataFrame:
    t = read_bars(spark, path, columns)
    return t.withColumn(d, market_date(d))


def file_map(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, path) of the files below path; two files of one symbol are an error."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(stem("path", suffixes).alias("symbol"), "path")
    twice = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(10).collect()
    if twice:
        raise ValueError(f"symbols with more than one file: {[r.symbol for r in twice]}")
    return t


def first_path(root: str | Path, candidates: list[str]) -> Path:
    for c in candidates:
        if (p := Path(root) / c).exists():
            return p
    raise FileNotFoundError(f"none of {candidates} below {root}")


def resolve_sources(sources: list[tuple[str, DataFrame]], valid: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per symbol, the rows of the first source whose rows are all valid: (rows, chosen source, wanted symbols without one)."""
    tagged = None
    for i, (name, df) in enumerate(sources):
        t = df.withColumn("source", F.lit(name)).withColumn("_priority", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    ok = tagged.groupBy("symbol", "_priority", "source").agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("ok")).filter("ok")
    w = Window.partitionBy("symbol").orderBy("_priority")
    chosen = ok.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("symbol", "source").join(wanted.select("symbol").distinct(), "symbol", "left_semi")
    rows = tagged.join(chosen, ["symbol", "source"], "left_semi").drop("_priority")
    return rows, chosen, wanted.select("symbol").distinct().join(chosen, "symbol", "left_anti")


def load_config(path: str | Path) -> dict:
    """Mapping from a YAML or JSON file; YAML needs the yaml package."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        out = yaml.safe_load(text)
    else:
        out = json.loads(text)
    if not isinstance(out, Mapping):
        raise TypeError(f"{path}: not a mapping")
    return dict(out)


def data_root(default: str | Path = "data", variable: str = "BARLOOM_DATA") -> Path:
    return Path(os.environ.get(variable) or default)


def write_stage(df: DataFrame, path: str, *, by: list[str] | None = None, csv: bool = False) -> None:
    """Replace a stage's table: Parquet, one folder for each key if asked for; or a CSV export with ISO dates."""
    w = df.write.mode("overwrite")
    if by:
        w = df.repartition(*by).write.mode("overwrite").partitionBy(*by)
    if csv:
        w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        w.parquet(path)


def append_trials(df: DataFrame, path: str) -> None:
    """Add finished trials to a study's table, so that a study can be resumed."""
    df.write.mode("append").parquet(path)


def stored_trials(spark: SparkSession, path: str) -> DataFrame:
    """Finished trials of a study's table; none if there is no table yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.parquet(path)
    return spark.createDataFrame([], "trial long, params string, mean_auc double, min_auc double, std_auc double")
