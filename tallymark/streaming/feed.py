"""The catalog's change feed: what appears, changes and goes in trees, from scan to scan.

A scan is one listing of the trees.  The stream's source makes a new one for
each batch; the state holds what the last scan saw, so every difference comes
out once, and a restart goes on from the last scan whose batch was finished.
Paths are dealt to a fixed number of buckets by their hash: the state of one
bucket is a few sorted arrays, and no directory, however large, is one key.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState

from ..sources.walk import Subtree, WalkReader

#: Rows of a scan.  A row without fname says that bucket ``size`` has been scanned, since it may have no file left.
SCHEMA = "scan bigint, dir string, fname string, size bigint, mtime bigint"
CHANGES = "scan bigint, change string, dir string, fname string, size bigint, mtime bigint"
BUCKETS = 64


class Part(InputPartition):
    """A subtree to list for a scan, or, without one, the marks of the buckets."""

    def __init__(self, scan: int, subtree: Subtree | None):
        self.scan, self.subtree = scan, subtree


class ScanReader(DataSourceStreamReader):
    """Offsets are the times of scans, in milliseconds: always later than the one before."""

    def __init__(self, options: dict):
        self.walk, self.buckets, self.last = WalkReader(options), int(options.get("buckets", BUCKETS)), 0

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        self.last = max(int(time.time() * 1000), self.last + 1)
        return {"scan": self.last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if end["scan"] <= start["scan"]:
            return []
        for root in self.walk.roots:
            if not os.path.isdir(root):  # else a volume that is not there would look like one whose files were all deleted
                raise FileNotFoundError(root)
        return [Part(end["scan"], None), *(Part(end["scan"], s) for s in self.walk.partitions())]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.subtree is None:
            yield from ((partition.scan, None, None, n, None) for n in range(self.buckets))
            return
        for _, at, name, size, mtime in self.walk.read(partition.subtree):
            yield partition.scan, at, name, size, mtime


class ScanSource(DataSource):
    """Options: those of the tree source, and buckets, which must be that of :func:`changes`."""

    @classmethod
    def name(cls) -> str:
        return "tree_scans"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ScanReader:
        return ScanReader(dict(self.options))


def scans(spark: SparkSession, roots: list[str], buckets: int = BUCKETS, **options: str) -> DataFrame:
    """A stream of scans of trees: one for each batch."""
    spark.dataSource.register(ScanSource)
    return spark.readStream.format("tree_scans").option("paths", os.pathsep.join(map(os.path.abspath, roots))).option("buckets", buckets).options(**options).load()


def as_scan(files: DataFrame, scan: int, buckets: int = BUCKETS) -> DataFrame:
    """A catalog's state (dir, fname, size, mtime) as the rows of a scan; a scan must reach the stream within one batch."""
    marks = files.sparkSession.range(buckets).selectExpr(f"{scan}L AS scan", "CAST(NULL AS string) AS dir", "CAST(NULL AS string) AS fname", "id AS size", "CAST(NULL AS bigint) AS mtime")
    return files.select(F.lit(scan).cast("long").alias("scan"), "dir", "fname", F.col("size").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime")).unionByName(marks)


def between(known: pd.DataFrame, now: pd.DataFrame, scan: int) -> pd.DataFrame:
    """The changes from one state to the next; both have size and mtime by path."""
    both = known.join(now, how="outer", lsuffix="_old")
    new, gone = both["size_old"].isna(), both["size"].isna()
    differs = ~new & ~gone & ((both["size"] != both["size_old"]) | (both["mtime"] != both["mtime_old"]))
    both["change"] = None
    both.loc[new, "change"], both.loc[gone, "change"], both.loc[differs, "change"] = "created", "deleted", "changed"
    both = both[both["change"].notna()]
    split = [p.rpartition("/") for p in both.index]
    last = lambda c: both[c].where(both[c].notna(), both[f"{c}_old"]).to_numpy("int64")
    return pd.DataFrame({"scan": scan, "change": both["change"].to_numpy(object), "dir": [d for d, _, _ in split], "fname": [f for _, _, f in split], "size": last("size"), "mtime": last("mtime")})


def changes(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(scan, change, dir, fname, size, mtime) of a stream of scans: created, changed or deleted, with the values of the later state, for what is gone with those it had.

    Several scans in one batch are taken in their order; a scan that was seen
    before is passed over.  A null size or mtime counts as 0; of rows alike in
    path the one with the latest time, then the largest, counts.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last, paths, sizes, mtimes = kept.get if kept.exists else (0, [], [], [])
        known = pd.DataFrame({"size": pd.array(list(sizes), "Int64"), "mtime": pd.array(list(mtimes), "Int64")}, index=pd.Index(list(paths), dtype="object"))
        out = []
        for scan, rows in pd.concat(list(frames)).groupby("scan", sort=True):
            if scan <= last:
                continue
            rows = rows[rows["fname"].notna()].sort_values(["mtime", "size"])
            now = pd.DataFrame({"size": pd.array(rows["size"], "Int64"), "mtime": pd.array(rows["mtime"], "Int64")}, index=pd.Index(rows["dir"] + "/" + rows["fname"], dtype="object"))
            now = now[~now.index.duplicated(keep="last")].sort_index()
            out.append(between(known, now, int(scan)))
            known, last = now, int(scan)
        kept.update((last, known.index.tolist(), [int(x) for x in known["size"]], [int(x) for x in known["mtime"]]))
        yield pd.concat(out) if out else pd.DataFrame(columns=["scan", "change", "dir", "fname", "size", "mtime"])

    bucket = F.when(F.col("fname").isNull(), F.col("size")).otherwise(F.pmod(F.xxhash64("dir", "fname"), F.lit(buckets)))
    rows = stream.withColumn("bucket", bucket).withColumns({c: F.when(F.col("fname").isNotNull(), F.coalesce(c, F.lit(0))) for c in ("size", "mtime")}).withColumn("dir", F.coalesce("dir", F.lit("")))
    return rows.groupBy("bucket").applyInPandasWithState(run, CHANGES, "scan bigint, paths array<string>, sizes array<bigint>, mtimes array<bigint>", "append", "NoTimeout")
