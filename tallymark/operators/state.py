"""Changes of the catalog as transforms: nothing is written here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checksums, paths, tags


def _none():
    return F.array().cast("array<string>")


def overlay(files: DataFrame, stat: DataFrame) -> DataFrame:
    """Catalog against disk: action new, delete, changed or keep for every (dir, fname); what changed loses its checksum and volumes."""
    m = files.select("dir", "fname", "checksum", F.col("size").alias("_ms"), F.col("mtime").alias("_mt"), "backup_dest", F.lit(True).alias("_m"))
    d = stat.select("dir", "fname", F.col("size").alias("_ds"), F.col("mtime").alias("_dt"), F.lit(True).alias("_d"))
    both = m.join(d, ["dir", "fname"], "full_outer")
    differs = ~(F.col("_ms").eqNullSafe(F.col("_ds")) & F.col("_mt").eqNullSafe(F.col("_dt")))
    action = F.when(F.col("_m").isNull(), "new").when(F.col("_d").isNull(), "delete").when(differs, "changed").otherwise("keep")
    both = both.withColumn("action", action)
    keep = F.col("action").isin("keep", "delete")
    return both.select("dir", "fname", "action", F.coalesce("_ds", "_ms").alias("size"), F.coalesce("_dt", "_mt").alias("mtime"), F.when(keep, F.col("checksum")).otherwise(F.lit("")).alias("checksum"), F.when(keep, F.col("backup_dest")).otherwise(_none()).alias("backup_dest"))


def changed(files: DataFrame, stat: DataFrame) -> DataFrame:
    return overlay(files, stat).filter(F.col("action") == "changed").select("dir", "fname", "size", "mtime")


def missing_on_disk(files: DataFrame, stat: DataFrame) -> DataFrame:
    return files.join(stat, ["dir", "fname"], "left_anti")


def prune(files: DataFrame, stat: DataFrame) -> DataFrame:
    return files.join(stat, ["dir", "fname"], "left_semi")


def recalculate(files: DataFrame, computed: DataFrame) -> DataFrame:
    """With the checksums of ``computed`` (path, new_checksum): a different one empties the volumes."""
    j = files.join(computed, "path", "left")
    same = F.col("new_checksum").isNull() | F.col("new_checksum").eqNullSafe(F.col("checksum"))
    return j.withColumn("backup_dest", F.when(same, F.col("backup_dest")).otherwise(_none())).withColumn("checksum", F.when(same, F.col("checksum")).otherwise(F.col("new_checksum"))).drop("new_checksum")


def mismatches(files: DataFrame, computed: DataFrame) -> DataFrame:
    """Validation: files whose content no longer has the recorded checksum."""
    return files.join(computed, "path").filter(~F.col("new_checksum").eqNullSafe(F.col("checksum")))


def scrub(files: DataFrame) -> DataFrame:
    return files.withColumn("backup_dest", _none())


def fill_checksums(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Missing checksums from ``contents`` (path, content); only those contents are read and hashed."""
    lacking = files.filter(F.coalesce(F.col("checksum"), F.lit("")) == "").select("path")
    computed = contents.join(lacking, "path", "left_semi").select("path", checksums.md5_base64(F.col("content")).alias("_new"))
    return files.join(computed, "path", "left").withColumn("checksum", F.coalesce("_new", "checksum")).drop("_new")


def refresh(files: DataFrame, stat: DataFrame, contents: DataFrame) -> DataFrame:
    """The whole of a rescan: overlay, prune, and checksums for what is new or changed."""
    now = overlay(files, stat).filter("action <> 'delete'").withColumn("path", F.concat_ws("/", "dir", "fname"))
    return fill_checksums(now, contents)


def apply_copies(files: DataFrame, done: DataFrame, volume: str) -> DataFrame:
    """After copying: the sources in ``done`` (path) get the volume."""
    hit = done.select("path", F.lit(True).alias("_done")).distinct()
    j = files.join(hit, "path", "left")
    return j.withColumn("backup_dest", F.when(F.col("_done").isNotNull(), tags.added(F.col("backup_dest"), volume)).otherwise(F.col("backup_dest"))).drop("_done")


def copied_rows(files: DataFrame, done: DataFrame, volume: str) -> DataFrame:
    """The rows that copies add at the destination: for each of ``done`` (path, target, mtime) the source's row, with the volume, under the target's directory and the copy's time of change."""
    hit = done.groupBy("path", "target").agg(F.max("mtime").alias("_t"))
    j = files.drop("mtime").join(hit, "path")
    placed = {"path": F.col("target"), "dir": paths.parent(F.col("target")), "fname": paths.base(F.col("target")), "mtime": F.col("_t"), "backup_dest": tags.added(F.col("backup_dest"), volume)}
    return j.withColumns(placed).select(*files.columns)


def record_copies(files: DataFrame, done: DataFrame, volume: str) -> DataFrame:
    """The catalog after copying: sources tagged, and a row for each copy, which replaces one of the same path."""
    tagged, new = apply_copies(files, done, volume), copied_rows(files, done, volume)
    return tagged.join(new.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def check(files: DataFrame, stat: DataFrame, computed: DataFrame, *, scrub_labels: bool = False, recompute: bool = False, only_validate: bool = False) -> DataFrame:
    """One run over a scanned tree: action, and the rows as they are to be written.

    ``computed`` (path, new_checksum) has the checksums of contents; it is asked
    only for what needs one: every file with ``recompute`` or ``only_validate``,
    else those without checksum.  action: new, changed, delete, keep, or
    mismatch, where the content no longer has the recorded checksum: validation
    leaves such a row as it is, a recomputation takes the new checksum and empties
    the volumes.  ``scrub_labels`` empties all volumes first.
    """
    now = overlay(files, stat).withColumn("path", F.concat_ws("/", "dir", "fname"))
    if scrub_labels:
        now = scrub(now)
    lacking = F.coalesce(F.col("checksum"), F.lit("")) == ""
    asked = now.filter((F.col("action") != "delete") & (F.lit(recompute or only_validate) | lacking)).select("path")
    fresh = computed.join(asked, "path", "left_semi").select("path", F.col("new_checksum").alias("_new"))
    j = now.join(fresh, "path", "left")
    differs = F.col("_new").isNotNull() & ~lacking & (F.col("_new") != F.col("checksum"))
    action = F.when(differs, "mismatch").otherwise(F.col("action"))
    taken = F.col("_new").isNotNull() & (lacking if only_validate else F.lit(True))
    emptied = differs & F.lit(not only_validate)
    return j.select("dir", "fname", "path", action.alias("action"), "size", "mtime", F.when(taken, F.col("_new")).otherwise(F.col("checksum")).alias("checksum"), F.when(emptied, _none()).otherwise(F.col("backup_dest")).alias("backup_dest"))


def upsert(files: DataFrame, scanned: DataFrame, keys: tuple[str, ...] = ("alias", "path")) -> DataFrame:
    """Scanned rows replace those of equal keys."""
    return files.join(scanned, list(keys), "left_anti").unionByName(scanned)


def sweep(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Without files of the scanned aliases that the scan did not see; other aliases stay whole."""
    aliases = scanned.select("alias").distinct().withColumn("_in", F.lit(True))
    seen = scanned.select("alias", "path").distinct().withColumn("_seen", F.lit(True))
    j = files.join(aliases, "alias", "left").join(seen, ["alias", "path"], "left")
    return j.filter(F.col("_in").isNull() | F.col("_seen").isNotNull()).drop("_in", "_seen")


def moved(deleted: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs a deleted file with a new one of equal size and name; each is used once, in path order.

    The pairing is by number within a key.  A key that very many files share is
    numbered within parts of its paths first, so that no window holds them all.
    """
    def numbered(files: DataFrame, name: str) -> DataFrame:
        part = F.substring("path", 1, 64)
        sums = files.groupBy("size", "fname", part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("size", "fname").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        nth = F.row_number().over(Window.partitionBy("size", "fname", "_p").orderBy("path"))
        return files.withColumn("_p", part).join(sums.withColumn("_b", before).drop("_n"), ["size", "fname", "_p"]).select("size", "fname", (F.col("_b") + nth).alias("nth"), F.col("path").alias(name))

    return numbered(deleted, "old_path").join(numbered(new, "new_path"), ["size", "fname", "nth"])


def follow_moves(files: DataFrame, stat: DataFrame) -> DataFrame:
    """``files`` with what was moved under its new path (and the new time): a file that is gone and a new one of equal size and name; see :func:`moved`."""
    known = files.select("dir", "fname", "path", "size")
    there = stat.select("dir", "fname", "path", "size", "mtime")
    pairs = moved(known.join(there, "path", "left_anti"), there.join(known, "path", "left_anti"))
    now = pairs.select(F.col("old_path").alias("path"), F.col("new_path")).join(there.select(F.col("path").alias("new_path"), F.col("dir").alias("_d"), F.col("mtime").alias("_t")), "new_path")
    j = files.join(now, "path", "left")
    return j.withColumns({"path": F.coalesce("new_path", "path"), "dir": F.coalesce("_d", "dir"), "mtime": F.coalesce("_t", "mtime")}).select(*files.columns)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many entries of two directories are only left, only right, different or equal."""
    one = left.select("fname", F.col("checksum").alias("_a"), F.lit(1).alias("_l"))
    two = right.select("fname", F.col("checksum").alias("_b"), F.lit(1).alias("_r"))
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("different")
    return one.join(two, "fname", "full_outer").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
