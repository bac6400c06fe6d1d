"""Files of the sources that a volume turns out to hold already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags


def discover(source: DataFrame, destination: DataFrame, volume: str, keys: tuple[str, ...] = ("checksum", "size")) -> DataFrame:
    """``source`` with the volume added to what the destination holds, and whether that is a change."""
    there = destination.select(*keys).distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    joined = source.join(there, list(keys), "left")
    return joined.withColumn("updated", hit & ~tags.has(F.col("backup_dest"), volume)).withColumn("backup_dest", F.when(hit, tags.added(F.col("backup_dest"), volume)).otherwise(F.col("backup_dest"))).drop("_hit")


def statistics(source: DataFrame, destination: DataFrame, volume: str) -> DataFrame:
    """Distinct contents that match, and files that the volume is new to."""
    matched = source.join(destination, ["checksum", "size"], "left_semi")
    return matched.agg(F.countDistinct("checksum", "size").alias("matches"), F.coalesce(F.sum((~tags.has(F.col("backup_dest"), volume)).cast("long")), F.lit(0)).alias("updates"))
