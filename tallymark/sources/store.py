"""A catalog that outlives a session: tables in buckets by the hash of their key, of which a change rewrites only those that it touches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

#: What a new catalog holds, and the columns that name a row of each table.
TABLES = {"files": schema.FILES, "targets": schema.TARGETS, "volumes": "label string, seq int", "outcomes": f"{schema.PLAN}, rank bigint, result string, run string"}
KEYS = {"files": ("alias", "path"), "targets": ("task_id",), "volumes": ("label",), "outcomes": ("run", "target")}
#: Buckets of a new table.
BUCKETS = 64


class Catalog:
    """Tables below ``root``, a folder that driver and executors share.

    A version of a table is a manifest that names, for each bucket, the folder
    with its rows; a folder is written once.  A version counts once its manifest
    is there, under its own name, so readers see the last whole one, a run that
    fails leaves the table as it was, and a version can be read while the next
    one is computed from it.  A table has one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ------------------------------------------------------------ manifests

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        """Complete versions, oldest first."""
        path, fs = self._fs()
        at = path(f"{self.root}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n[:1] == "m" and n.endswith(".json") and n[1:-5].isdigit())

    def manifest(self, table: str, version: int | None = None) -> dict:
        """{buckets: their number, places: {bucket: version that wrote it}} of the last version or the one asked for."""
        known = self.versions(table)
        if not known:
            return {"buckets": self.buckets, "places": {}}
        number = known[-1] if version is None else version
        found = json.loads(self.spark.read.text(f"{self.root}/{table}/m{number}.json", wholetext=True).first()["value"])
        return {"buckets": found["buckets"], "places": {int(b): v for b, v in found["places"].items()}}

    def _publish(self, table: str, number: int, manifest: dict, keep: int) -> None:
        path, fs = self._fs()
        staged = path(f"{self.root}/{table}/.m{number}.json")
        out = fs.create(staged, True)
        out.writeBytes(json.dumps(manifest))
        out.close()
        if not fs.rename(staged, path(f"{self.root}/{table}/m{number}.json")):
            raise RuntimeError(f"version {number} of {table} is there already: it has another writer")
        known = self.versions(table)
        kept, old = known[-keep:], known[:-keep]
        used = {v for n in kept for v in self.manifest(table, n)["places"].values()}
        for n in old:
            fs.delete(path(f"{self.root}/{table}/m{n}.json"), False)
        for status in fs.listStatus(path(f"{self.root}/{table}")):
            name = status.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) < number and int(name[1:]) not in used:
                fs.delete(status.getPath(), True)

    # ------------------------------------------------------------ rows

    def _bucket(self, table: str, buckets: int):
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(buckets)).cast("int")

    def _rows(self, table: str, manifest: dict, only: list[int] | None = None) -> DataFrame:
        places = [f"{self.root}/{table}/v{v}/b={b}" for b, v in sorted(manifest["places"].items()) if only is None or b in set(only)]
        if not places:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*places)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The last version, or the one asked for; an empty table where there is none."""
        return self._rows(table, self.manifest(table, version))

    def _put(self, table: str, number: int, rows: DataFrame, buckets: int, touched: int) -> list[int]:
        """Writes the rows' buckets and returns their numbers."""
        columns = self.spark.createDataFrame([], TABLES[table]).columns
        dealt = rows.select(*columns).withColumn("b", self._bucket(table, buckets)).repartition(max(1, touched), "b")
        place = f"{self.root}/{table}/v{number}"
        dealt.write.mode("overwrite").partitionBy("b").option("maxRecordsPerFile", 5_000_000).parquet(place)
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(place))]
        return [int(n[2:]) for n in names if n.startswith("b=")]

    def write(self, table: str, rows: DataFrame, keep: int = 2) -> int:
        """Writes a whole next version and returns its number; of the older ones the last ``keep`` - 1 stay."""
        number, buckets = self.versions(table)[-1:] or [0], self.manifest(table)["buckets"]
        number = number[0] + 1
        found = self._put(table, number, rows, buckets, buckets)
        self._publish(table, number, {"buckets": buckets, "places": {b: number for b in found}}, keep)
        return number

    def change(self, table: str, put: DataFrame | None = None, drop: DataFrame | None = None, keep: int = 2) -> tuple[int, list[int]]:
        """(the next version, the buckets that were rewritten): rows of ``put`` replace those of equal keys, rows with the keys of ``drop`` go.

        Only buckets that hold one of the keys are read and written.  Of several
        rows of ``put`` with one key, one is kept, the largest; keys are never null.
        """
        keys = list(KEYS[table])
        number, manifest = (self.versions(table)[-1:] or [0])[0] + 1, self.manifest(table)
        b = self._bucket(table, manifest["buckets"])
        changes = [d.select(*keys) for d in (put, drop) if d is not None]
        gone = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
        touched = sorted(r["b"] for r in gone.select(b.alias("b")).distinct().collect())  # numbers of buckets
        if not touched:
            return number - 1, []
        left = self._rows(table, manifest, touched).join(gone.distinct(), keys, "left_anti")
        if put is not None:
            columns = left.columns
            rest = [c for c in columns if c not in keys]
            one = put.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*columns)
            left = left.unionByName(one)
        found = self._put(table, number, left, manifest["buckets"], len(touched))
        places = {k: v for k, v in manifest["places"].items() if k not in set(touched)} | {k: number for k in found}
        self._publish(table, number, {"buckets": manifest["buckets"], "places": places}, keep)
        return number, touched

    def clear_files(self) -> int:
        """Empties the files and keeps everything else."""
        return self.write("files", self.spark.createDataFrame([], TABLES["files"]))
