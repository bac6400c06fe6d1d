"""Extensions: the catalog's periodic checks as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import shared_dir


def read_stream(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A Parquet table as a stream; event times without a zone are taken as UTC."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if path.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    files = spark.read.parquet(path).inputFiles()
    return bool(files) and not files[0].rstrip("/").endswith(path.rstrip("/").split("/")[-1])


def tumbling(events: DataFrame, size: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events and their value in each window and of each type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; later ones within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys)


def drain(stream: DataFrame, mode: str = "complete", place: str | None = None) -> DataFrame:
    """Runs the stream over what there is now, and returns what this run wrote, from a table in the shared folder.

    A batch that runs again writes the same folder again, that of its number, so
    no row counts twice.  In mode "complete" the last batch has everything.  With
    a ``place`` of one's own (a folder) the next run goes on where this one ended.
    """
    spark = stream.sparkSession
    place = place or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")
        numbers.append(number)

    started: Callable = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start
    started().awaitTermination()
    if not numbers:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(numbers)] if mode == "complete" else sorted(set(numbers))
    return spark.read.schema(stream.schema).parquet(*(f"{place}/rows/batch={n}" for n in wanted))
