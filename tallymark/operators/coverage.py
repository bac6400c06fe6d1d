"""How many volumes hold what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bytes_by_coverage(files: DataFrame, dense: bool = True) -> DataFrame:
    """n_dest, n_files and bytes; ``dense``: also the empty buckets from 0 to 2 or to the largest there is."""
    found = files.groupBy(F.size("backup_dest").cast("long").alias("n_dest")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))
    if not dense:
        return found
    top = found.agg(F.greatest(F.lit(2), F.coalesce(F.max("n_dest"), F.lit(0))).alias("top"))
    buckets = top.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("n_dest")).select(F.col("n_dest").cast("long"))
    return buckets.join(found, "n_dest", "left").na.fill(0, ["n_files", "bytes"])


def by_alias_and_directory(files: DataFrame) -> DataFrame:
    """Extension: files and bytes with subtotals by (alias, dir), by alias and in all."""
    return files.rollup("alias", "dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def by_volume(files: DataFrame) -> DataFrame:
    """Files on each volume; one on several volumes counts on each."""
    return files.select(F.explode("backup_dest").alias("volume")).groupBy("volume").agg(F.count(F.lit(1)).alias("n_files"))


def directories(files: DataFrame) -> DataFrame:
    return files.agg(F.countDistinct("dir").alias("n_dirs"), F.count(F.lit(1)).alias("n_files"))


def tree(files: DataFrame) -> DataFrame:
    """Every directory and all above it, with the files and bytes below."""
    from ..functions import paths

    own = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    above = own.select(F.explode(F.array_union(paths.ancestors(F.col("dir")), F.array("dir"))).alias("dir"), "n", "b")
    return above.groupBy("dir").agg(F.sum("n").alias("n_files"), F.sum("b").alias("bytes"))


def bridge(files: DataFrame) -> DataFrame:
    """One row for each file and volume; files without one stay, with null."""
    return files.select("path", F.explode_outer("backup_dest").alias("volume"))
