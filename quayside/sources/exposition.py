"""Metric exposition text: one sample per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns. STRICT is what the dashboard's browser script understands: lower-case names without
# labels, and digits with at most one dot, so exponents are cut off. FULL is the exposition grammar.
STRICT = r"^([a-z_]+)\s+(\d+\.?\d*)"
FULL = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{.*\})?\s+([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|Inf|NaN))(?:\s+-?\d+)?\s*$"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse(lines: DataFrame, line: str = "line", full: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(name, labels, value) per sample line; comments, blank and unreadable lines are skipped."""
    text = F.col(line)
    usable = lines.filter(~text.startswith("#") & (F.trim(text) != ""))
    if not full:
        return usable.filter(text.rlike(STRICT)).select(
            *keep,
            F.regexp_extract(text, STRICT, 1).alias("name"),
            F.regexp_extract(text, STRICT, 2).cast("double").alias("value"),
        )
    return usable.filter(text.rlike(FULL)).select(
        *keep,
        F.regexp_extract(text, FULL, 1).alias("name"),
        F.regexp_extract(text, FULL, 2).alias("labels"),
        _number(F.regexp_extract(text, FULL, 3)).alias("value"),
    )


def _number(raw: Column) -> Column:
    return F.regexp_replace(raw, r"Inf$", "Infinity").cast("double")


def parse_both(lines: DataFrame, line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Strict and full reading of each line in one pass: (grammar, name, labels, value) rows."""
    text = F.col(line)
    strict = F.when(text.rlike(STRICT), F.struct(
        F.lit("strict").alias("grammar"), F.regexp_extract(text, STRICT, 1).alias("name"), F.lit("").alias("labels"),
        F.regexp_extract(text, STRICT, 2).cast("double").alias("value")))
    full = F.when(text.rlike(FULL), F.struct(
        F.lit("full").alias("grammar"), F.regexp_extract(text, FULL, 1).alias("name"),
        F.regexp_extract(text, FULL, 2).alias("labels"), _number(F.regexp_extract(text, FULL, 3)).alias("value")))
    usable = lines.filter(~text.startswith("#") & (F.trim(text) != ""))
    return usable.select(*keep, F.explode(F.array_compact(F.array(strict, full))).alias("_s")).select(
        *keep, "_s.grammar", "_s.name", "_s.labels", "_s.value")
