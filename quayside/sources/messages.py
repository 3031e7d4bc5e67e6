"""Work messages on the consuming side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.schemas import CONSUMER_MESSAGE

CORRUPT = "_corrupt"


def decode(bodies: DataFrame, schema: T.StructType = CONSUMER_MESSAGE, value: str = "value",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON bodies to typed columns. Missing fields are NULL, extra ones are dropped.

    ``undecodable`` marks bodies that are no JSON object or hold a field of the wrong type.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(value), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return bodies.select(*keep, F.col(value), parsed.alias("_m")).select(
        *keep, value,
        (F.col("_m").isNull() | F.col(f"_m.{CORRUPT}").isNotNull()).alias("undecodable"),
        *[F.col(f"_m.{f.name}").alias(f.name) for f in schema.fields],
    )


def consume(bodies: DataFrame, handler: Callable[[DataFrame], DataFrame],
            schema: T.StructType = CONSUMER_MESSAGE) -> tuple[DataFrame, DataFrame]:
    """(handler's result over decodable messages, dead letters of the rest)."""
    decoded = decode(bodies, schema)
    good = decoded.filter(~F.col("undecodable")).drop("undecodable", "value")
    dead = decoded.filter("undecodable").select("value", F.lit("undecodable").alias("last_error"))
    return handler(good), dead


def schema_drift(bodies: DataFrame, expected: list[str], value: str = "value") -> DataFrame:
    """Per JSON field: how many messages carry it, and whether it is expected, missing or unexpected."""
    seen = bodies.select(F.explode(F.json_object_keys(F.col(value))).alias("field"), F.lit(1).alias("n"))
    # The expected fields join in as rows that count nothing, so one aggregate answers it all.
    wanted = bodies.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(f) for f in expected])).alias("field"), F.lit(0).alias("n"))
    per_field = seen.unionByName(wanted).groupBy("field").agg(
        F.sum("n").alias("messages"), F.bool_or(F.col("n") == 0).alias("_wanted"))
    return per_field.select(
        "field", "messages",
        F.when(F.col("messages") == 0, "missing").when(F.col("_wanted"), "expected").otherwise("unexpected")
        .alias("status"))
