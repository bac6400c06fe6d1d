"""Side effects as tables: what would be copied, moved or deleted, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

COLUMNS = ("action", "source", "target", "checksum", "size", "reason")


def _plan(df: DataFrame, action: str, source: str, target, reason: str) -> DataFrame:
    return df.select(F.lit(action).alias("action"), F.col(source).alias("source"), target.cast("string").alias("target"), "checksum", F.col("size").cast("long").alias("size"), F.lit(reason).alias("reason"))


def copies(files: DataFrame) -> DataFrame:
    """Files with their target."""
    return _plan(files, "copy", "path", F.col("target"), "not on the volume")


def deletions(files: DataFrame, kept: DataFrame, orphans: DataFrame | None = None) -> DataFrame:
    """Empty files, duplicates other than those of ``kept`` (checksum, size, path), and orphans."""
    empty = _plan(files.filter("size = 0"), "delete", "path", F.lit(None), "empty")
    k = kept.select("checksum", "size", F.col("path").alias("_keep"))
    again = files.filter("size > 0").join(k, ["checksum", "size"]).filter("path <> _keep")
    out = empty.unionByName(_plan(again, "delete", "path", F.col("_keep"), "duplicate"))
    return out if orphans is None else out.unionByName(_plan(orphans, "delete", "path", F.lit(None), "orphan"))


def concentrate(files: DataFrame, base: str) -> DataFrame:
    """Moves every file right under ``base``; clash marks names that several files want."""
    target = paths.join(F.lit(base), F.col("fname"))
    moving = files.filter(F.col("dir") != base).withColumn("target", target)
    wanted = files.withColumn("target", target).groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    return moving.join(wanted, "target").select(F.col("path").alias("source"), "target", (F.col("_n") > 1).alias("clash"))


def renames(plan: DataFrame) -> DataFrame:
    return plan.select(F.lit("move").alias("action"), F.concat_ws("/", "dir", "fname").alias("source"), F.concat_ws("/", "dir", "new_name").alias("target"), F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("long").alias("size"), F.lit("rename").alias("reason"))
