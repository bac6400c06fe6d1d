"""Which root a path belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def source_root(files: DataFrame, roots: DataFrame, nearest: bool = False) -> DataFrame:
    """``files`` with root: the first listed (smallest seq) of ``roots`` (root, seq) that the path lies under, or the longest; null where none.

    A prefix join would compare every file with every root.  Instead each
    distinct directory is joined by equality on the directories above it.
    """
    known = roots.select(F.rtrim("root", F.lit("/")).alias("_a"), F.col("root").alias("_root"), "seq")
    at = paths.parent(F.col("path"))
    dirs = files.select(at.alias("_dir")).distinct()
    above = dirs.select("_dir", F.explode(F.array_union(paths.ancestors(F.col("_dir")), F.array("_dir"))).alias("_a"))
    rank = F.struct(-F.length("_root"), "seq") if nearest else F.struct("seq", "_root")
    found = above.join(known, "_a").groupBy("_dir").agg(F.min_by("_root", rank).alias("root"))
    return files.withColumn("_dir", at).join(found, "_dir", "left").drop("_dir")


def destination_path(files: DataFrame, destination: str, with_source_name: bool = False) -> DataFrame:
    """target: destination, (the root's last part,) and the path below ``root``."""
    inner = paths.relative(F.col("path"), F.col("root"))
    parts = [F.lit(destination), *([paths.base(F.rtrim("root", F.lit("/")))] if with_source_name else []), inner]
    return files.withColumn("target", F.when(inner.isNotNull(), paths.join(*parts)))
