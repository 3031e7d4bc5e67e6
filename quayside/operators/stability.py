"""When did a file stop changing?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators import ordered


def verdict(samples: DataFrame, attempts: int, deadline_us: int, tie: str = "sample_id") -> DataFrame:
    """One row per path from its (sample_us, size, mtime) samples; a NULL size means the file was gone.

    The first sample only primes. A path is stable at the first later sample that equals the one right
    before it, within ``attempts`` samples, before any missing one and before the deadline.
    Only the first ``attempts`` samples of a path ever leave a map task.
    """
    head = ordered.first_rows(samples, ["path"], ["sample_us", tie], attempts)
    by_path = Window.partitionBy("path").orderBy("sample_us", tie)
    same = (F.col("size") == F.lag("size").over(by_path)) & (F.col("mtime") == F.lag("mtime").over(by_path))
    marked = head.withColumn("_same", F.coalesce(same, F.lit(False)))
    per_path = marked.groupBy("path").agg(
        F.min(F.when(F.col("size").isNull(), F.col("rank"))).alias("_gone"),
        F.min(F.when(F.col("_same"), F.struct("rank", "sample_us"))).alias("_same"),
        F.min("sample_us").alias("detected_us"),
        F.count("*").alias("samples"),
    )
    settled = F.col("_same").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") > F.col("_same.rank")))
    took = F.col("_same.sample_us") - F.col("detected_us")
    stable = settled & (took < deadline_us)
    return per_path.select(
        "path", "samples", stable.alias("stable"),
        F.when(stable, F.col("_same.rank")).alias("stable_at_sample"),
        F.when(stable, took).alias("duration_us"),
        F.when(~stable, "file_not_stable").alias("reason"),
    )
