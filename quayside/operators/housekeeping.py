"""Retention, directory clean-up, census and layout audits. All of it plans; nothing is deleted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.config import DAY_US
from quayside.functions import paths, scalars
from quayside.operators import ordered
from quayside.session import written

CLEANED_LANES = ("processed", "failed", "ignored")


def retention_candidates(files: DataFrame, policy_days: Mapping[str, int], as_of_us: int) -> DataFrame:
    """Files due for removal, with their age in whole days.

    The tmp lane is always emptied, whatever the policy says. Elsewhere 0 days keeps for ever, and a
    file goes when it was last changed strictly before the cut-off. The policy is a parameter of a few
    lanes, so it becomes an expression instead of a join.
    """
    due: Column = F.col("lane") == "tmp"
    for lane in CLEANED_LANES:
        days = policy_days.get(lane, 0)
        if days > 0:
            due = due | ((F.col("lane") == lane) & (F.col("mtime_us") < as_of_us - days * DAY_US))
    return files.filter(due).withColumn("age_days", scalars.age_days("mtime_us", F.lit(as_of_us)))


def cleanup_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("lane").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def lane_census(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("lane").agg(F.count_if(~F.col("is_dir")).alias("files"))


def directories_of(files: DataFrame, path: str = "path") -> DataFrame:
    """Every directory that lies above some file."""
    return files.select(F.explode(paths.ancestors(path)).alias("path")).distinct()


def empty_directories(dirs: DataFrame, entries: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Directories without a direct child, protected ones left out (one clean-up pass)."""
    parents = entries.select(paths.parent("path").alias("path")).distinct()
    empty = dirs.select("path").join(parents, "path", "left_anti")
    return empty.join(protected.select("path"), "path", "left_anti") if protected is not None else empty


def empty_closure(dirs: DataFrame, files: DataFrame, protected: DataFrame | None = None,
                  passes: int | None = None) -> DataFrame:
    """Directories that vanish when clean-up repeats, with the pass that removes each.

    A directory survives when it is above or equal to a protected one, or above a file. One pass
    removes one level, because a parent is visited before its children; ``passes`` stops early.
    """
    kept = directories_of(files)
    if protected is not None:
        kept = kept.unionByName(protected.select("path")).unionByName(directories_of(protected)).distinct()
    gone = written(dirs.select("path").join(kept, "path", "left_anti"), "gone")
    depth = F.size(F.split("path", "/"))
    below = gone.withColumn("_depth", depth).select(
        F.explode(F.array_append(paths.ancestors("path"), F.col("path"))).alias("path"), "_depth")
    height = below.groupBy("path").agg(F.max("_depth").alias("_deepest"))
    out = gone.join(height, "path").select(
        "path", (F.col("_deepest") - depth + 1).cast("long").alias("removed_in_pass"))
    return out.filter(F.col("removed_in_pass") <= passes) if passes is not None else out


def protected_dirs(roots: DataFrame, lanes: Sequence[str]) -> DataFrame:
    """Roots and their lane directories, each once."""
    base = roots.select("path").distinct()
    below = base.select(F.explode(F.array(*[F.concat("path", F.lit(f"/{lane}")) for lane in lanes])).alias("path"))
    return base.unionByName(below).distinct()


def missing_lanes(inventory: DataFrame, lanes: Sequence[str]) -> DataFrame:
    """(root, lane) folders that should exist and do not; ``inventory`` has (root, lane) per entry."""
    present = inventory.select("root", "lane").distinct()
    wanted = present.select("root").distinct().withColumn("lane", F.explode(F.array(*[F.lit(x) for x in lanes])))
    return wanted.join(present, ["root", "lane"], "left_anti")


def lane_survivors(moves: DataFrame) -> DataFrame:
    """Lanes are flat, so a later file replaces an earlier one of the same name.

    Per (lane, filename): the surviving path and how many files it overwrote.
    Input (lane, filename, path, moved_us, file_id).
    """
    return moves.groupBy("lane", "filename").agg(
        F.max_by("path", F.struct("moved_us", "file_id")).alias("survivor"),
        (F.count("*") - 1).alias("overwritten"))


def fixed_window_cap(events: DataFrame, keys: Sequence[str], us: str, tie: str, window_us: int, limit: int) -> DataFrame:
    """The first ``limit`` rows per key and fixed window: the fully parallel cousin of a token bucket."""
    rows = events.withColumn("window", ordered.time_segment(us, window_us))
    return ordered.first_rows(rows, [*keys, "window"], [us, tie], limit)
