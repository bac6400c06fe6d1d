"""Filters over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, tags

# Fixed values, but for the first: the names of the catalog's own files.  The first holds a directory's entries;
# catalogs that call it otherwise pass their own names.
METADATA_NAMES = (".directory.xml", ".mdcfg.xml", ".mdjournal.xml", ".mdbackup.xml", ".mdSkipDir")


def drop_metadata(files: DataFrame, names: Sequence[str] = METADATA_NAMES) -> DataFrame:
    return files.filter(~F.col("fname").isin(*names))


def drop_hidden(files: DataFrame) -> DataFrame:
    return files.filter(~paths.is_hidden(F.col("dir")))


def drop_skipped(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Without the directories of ``markers`` (dir) and all below them: an equi anti join over each file's own ancestors, not a prefix join."""
    marked = markers.select(F.col("dir").alias("_m")).distinct()
    dirs = files.select("dir").distinct()
    above = dirs.select("dir", F.explode(F.array_union(paths.ancestors(F.col("dir")), F.array("dir"))).alias("_m"))
    hit = above.join(marked, "_m", "left_semi").select("dir").distinct()
    return files.join(hit, "dir", "left_anti")


def valid_patterns(spark: SparkSession, patterns: Sequence[str], strict: bool = False) -> list[str]:
    """The patterns that Spark's own expressions accept, as it is Spark that runs them; with ``strict`` the first that isn't valid raises."""
    good = []
    for p in patterns:
        try:
            spark.range(1).select(F.lit("").rlike(p)).collect()
            good.append(p)
        except PySparkException:
            if strict:
                raise
    return good


def drop_ignored(files: DataFrame, patterns: Sequence[str], strict: bool = False) -> DataFrame:
    """Without paths that match a pattern (of Java's kind) somewhere.  A pattern that isn't valid is left out, or raises with ``strict``."""
    good = valid_patterns(files.sparkSession, patterns, strict)
    for p in good:  # each by itself: flags and group names of one mean nothing to the others
        files = files.filter(~F.col("path").rlike(p))
    return files


def on_volume(files: DataFrame, volume: str) -> DataFrame:
    return files.filter(tags.has(F.col("backup_dest"), volume))


def not_on_volume(files: DataFrame, volume: str) -> DataFrame:
    return files.filter(~tags.has(F.col("backup_dest"), volume))


def for_backup(files: DataFrame, volume: str) -> DataFrame:
    """What the volume lacks, largest first, then by path."""
    return not_on_volume(files, volume).orderBy(F.col("size").desc(), F.col("path"))


def missing_checksum(files: DataFrame) -> DataFrame:
    return files.filter(F.coalesce(F.col("checksum"), F.lit("")) == "")


def zero_length(files: DataFrame) -> DataFrame:
    return files.filter(F.col("size") == 0)


def coverage_cap(files: DataFrame, most: int, strict: bool = False) -> DataFrame:
    """On at most ``most`` volumes; ``strict``: on fewer, where ``most`` is positive."""
    n = F.size("backup_dest")
    return files.filter(n < most if strict and most > 0 else n <= most) if most > 0 or not strict else files


def lookup_many(keys: DataFrame, files: DataFrame, on: str, value: str, default) -> DataFrame:
    """``value`` for every key, with a default for those that are not there."""
    found = files.groupBy(on).agg(F.min(value).alias(value))
    return keys.join(found, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def rule_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Without blank lines and those that begin with # or //."""
    text = F.trim(F.col(column))
    return lines.filter((text != "") & ~text.startswith("#") & ~text.startswith("//"))
