"""Rule checks over any table and named health checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds ``violations`` (messages of all broken rules, in rule order) and ``first_violation``."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules]))
    return df.withColumn("violations", broken).withColumn("first_violation", F.get("violations", F.lit(0)))


def violation_counts(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    return (
        violations(df, rules).select(F.explode("violations").alias("rule"), (F.col("first_violation")).alias("first"))
        .groupBy("rule").agg(F.count("*").alias("rows"),
                             F.count_if(F.col("rule") == F.col("first")).alias("reported_first"))
    )


class HealthChecks:
    """Named predicates over one table, all evaluated in one aggregate pass.

    A check is an aggregate Column that is true when all is well; NULL (no rows) counts as well.
    """

    def __init__(self) -> None:
        self.checks: dict[str, tuple[Column, str]] = {}

    def register(self, name: str, healthy: Column, error: str) -> None:
        self.checks[name] = (healthy, error)

    def report(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """(group columns, status, checks map): degraded as soon as one check fails."""
        names = list(self.checks)
        verdicts = [F.coalesce(ok, F.lit(True)).alias(f"_ok{i}") for i, (ok, _) in enumerate(self.checks.values())]
        grouped = df.groupBy(*by).agg(F.count("*").alias("_n"), *verdicts)
        every = F.lit(True)
        entries: list[Column] = []
        for i, name in enumerate(names):
            every = every & F.col(f"_ok{i}")
            entries += [F.lit(name), F.when(F.col(f"_ok{i}"), "ok").otherwise(self.checks[name][1])]
        checks = F.create_map(*entries) if entries else F.expr("map()").cast("map<string,string>")
        return grouped.select(*by, F.when(every, "healthy").otherwise("degraded").alias("status"),
                              checks.alias("checks"))


def health_rows(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return report.select(*by, "status", F.explode("checks").alias("check", "result"))

