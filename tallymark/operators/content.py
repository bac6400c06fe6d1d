"""Content: files with the same checksum, at the sources and at a destination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksums
from .durable import checkpointed


def _volumes(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vols: each content's volumes with the first path that has each, in that order.  As many entries as there are volumes."""
    each = files.select(*keys, "path", F.posexplode("backup_dest").alias("pos", "vol"))
    first = each.groupBy(*keys, "vol").agg(F.min(F.struct("path", "pos")).alias("at"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("at.path").alias("p"), F.col("at.pos").alias("q"), F.col("vol").alias("v")))).alias("vols"))


def merge_sources(files: DataFrame) -> DataFrame:
    """One row for each checksum: its volumes united, and the path of the last file, in path order, that had fewer volumes than all before it together (else the first).

    The running union before a path has as many members as volumes whose first
    path is smaller, so no group is ever collected: both steps are aggregations
    with partial sums.
    """
    vols = _volumes(files, ["checksum"])
    rows = files.join(vols, "checksum", "left").withColumn("vols", F.coalesce("vols", F.array().cast(vols.schema["vols"].dataType)))
    before = F.size(F.filter("vols", lambda v: v["p"] < F.col("path")))
    best = rows.groupBy("checksum").agg(F.max(F.when(F.size("backup_dest") < before, F.struct("path", "size"))).alias("late"), F.min(F.struct("path", "size")).alias("early"))
    chosen = best.select("checksum", F.coalesce("late", "early").alias("c")).join(vols, "checksum", "left")
    none = F.array().cast("array<string>")
    return chosen.select("checksum", F.col("c.size").alias("size"), F.col("c.path").alias("path"), F.coalesce(F.transform("vols", lambda v: v["v"]), none).alias("backup_dest"))


def merge_destination(files: DataFrame) -> DataFrame:
    """One row for each checksum: its volumes united, and its first path."""
    first = files.groupBy("checksum").agg(F.min(F.struct("path", "size")).alias("c"))
    chosen = first.join(_volumes(files, ["checksum"]), "checksum", "left")
    return chosen.select("checksum", F.col("c.size").alias("size"), F.col("c.path").alias("path"), F.coalesce(F.transform("vols", lambda v: v["v"]), F.array().cast("array<string>")).alias("backup_dest"))


def compare(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Full outer merge of merged contents: status to_copy, both or orphan, with both paths."""
    s = source.select("checksum", F.col("path").alias("src_path"), F.col("size").alias("src_size"))
    d = destination.select("checksum", F.col("path").alias("dst_path"), F.col("size").alias("dst_size"))
    status = F.when(F.col("dst_path").isNull(), "to_copy").when(F.col("src_path").isNull(), "orphan").otherwise("both")
    return s.join(d, "checksum", "full_outer").select("checksum", "src_path", "dst_path", F.coalesce("src_size", "dst_size").alias("size"), status.alias("status"))


def present(source: DataFrame, destination: DataFrame) -> DataFrame:
    return source.join(destination, "checksum", "left_semi")


def absent(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Rows of the first whose checksum the second lacks: what to copy or, the other way round, orphans."""
    return source.join(destination, "checksum", "left_anti")


def duplicates(files: DataFrame) -> DataFrame:
    """(checksum, size) of more than one file: how many, the first path, and the bytes that one copy would save."""
    groups = files.groupBy("checksum", "size").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path")).filter("n_files > 1")
    return groups.withColumn("wasted", F.col("size") * (F.col("n_files") - 1))


def collisions(files: DataFrame) -> DataFrame:
    """(checksum, size) whose files don't all have one name."""
    return files.groupBy("checksum", "size").agg(F.countDistinct("fname").alias("n_names"), F.count(F.lit(1)).alias("n_files")).filter("n_names > 1")


def by_name(files: DataFrame) -> DataFrame:
    """In the byte order of names, then of paths."""
    return files.orderBy("fname", "path")


def by_content() -> list[Column]:
    """The order of content keys: bytes of the checksum, however it is spelt, then size, then path."""
    return [checksums.key_bytes(F.col("checksum")).asc_nulls_first(), F.col("size").asc(), F.col("path").asc()]


def priority_order() -> list[Column]:
    """Fewest volumes, then largest, then path."""
    return [F.size("backup_dest").asc(), F.col("size").desc(), F.col("path").asc()]


def prioritise(files: DataFrame, label: str | None = None, most: int | None = None) -> DataFrame:
    """Sorted in priority order, without what is on ``label``, and only what is on at most ``most`` volumes.  The sort is by ranges, over all partitions."""
    if label is not None:
        files = files.filter(~F.array_contains("backup_dest", label))
    if most is not None:
        files = files.filter(F.size("backup_dest") <= most)
    return files.orderBy(*priority_order())


def ranked(files: DataFrame, name: str = "rank", order: list[Column] | None = None) -> DataFrame:
    """Files with their number in the priority order, or another one, from 1.

    No window over one partition: rows are sorted by ranges, the sizes of the
    ranges are summed, and a row's number is its range's offset and its place in it.
    """
    columns, order = files.columns, order or priority_order()
    placed = files.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    placed = checkpointed(placed)  # the numbers below hold for one sort only
    sums = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_id") - F.shiftleft("_part", 33) + 1
    return placed.join(F.broadcast(offsets), "_part").select(*columns, number.cast("long").alias(name))  # offsets: a row for each partition
