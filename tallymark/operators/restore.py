"""From journals to what is still to be copied back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def resolve_aliases(files: DataFrame, restore_dests: DataFrame, sources: DataFrame) -> DataFrame:
    """Files with root: where their alias is restored to, else where its source lies, else null."""
    r = restore_dests.groupBy("alias").agg(F.min("path").alias("_r"))
    s = sources.groupBy("alias").agg(F.min("path").alias("_s"))
    return files.join(r, "alias", "left").join(s, "alias", "left").withColumn("root", F.coalesce("_r", "_s")).drop("_r", "_s")


def ingest(files: DataFrame, restore_dests: DataFrame, sources: DataFrame, whole_path: bool = False) -> DataFrame:
    """Targets of journal entries: path, task id and state; state is failed where no root is known.

    Only the last directory level is kept below the root, unless ``whole_path``.
    """
    placed = resolve_aliases(files, restore_dests, sources)
    inner = F.ltrim(F.col("dir"), F.lit("/")) if whole_path else paths.base(F.col("dir"))
    target = F.when(F.col("root").isNotNull(), paths.join(F.col("root"), inner, F.col("fname")))
    placed = placed.withColumn("target_path", target)
    task = F.concat_ws(":", "checksum", F.col("size").cast("string"), "target_path")
    return placed.select("checksum", "size", F.when(target.isNotNull(), task).alias("task_id"), "alias", "target_path", "backup_dest", F.when(F.col("root").isNull(), "failed").otherwise("pending").alias("state"))


def target_clashes(targets: DataFrame) -> DataFrame:
    """Target paths that several different contents would be written to."""
    return targets.filter("target_path IS NOT NULL").groupBy("target_path").agg(F.countDistinct("checksum", "size").alias("n_contents")).filter("n_contents > 1")


def nodes(targets: DataFrame) -> DataFrame:
    """One row for each content: how many targets, the first of them, and the volumes.  The targets themselves stay rows."""
    counts = targets.groupBy("checksum", "size").agg(F.count(F.lit(1)).alias("n_targets"), F.min("target_path").alias("first_target"))
    vols = targets.select("checksum", "size", F.explode("backup_dest").alias("v")).groupBy("checksum", "size").agg(F.array_sort(F.collect_set("v")).alias("backup_dest"))
    return counts.join(vols, ["checksum", "size"], "left").withColumn("backup_dest", F.coalesce("backup_dest", F.array().cast("array<string>")))


def add_context(files: DataFrame, context: DataFrame) -> DataFrame:
    """The catalog with the files of a restore context; an error if it already has files of one of its source paths.

    A context's files have the path that their directories make below src_path.
    """
    known = files.select("src_path").join(context.select("src_path").distinct(), "src_path", "left_semi").select("src_path").limit(1).collect()
    if known:
        raise ValueError(f"the catalog already has files of {known[0]['src_path']}")
    filename = F.when(F.coalesce("dir", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    return files.unionByName(context.select("src_path", filename.alias("filename"), "size", "mtime", "md5", "backup_dest"))


def copy_plan(volume_files: DataFrame, targets: DataFrame) -> DataFrame:
    """A copy for each file of the volume and each pending target of its content, as a scan meets them; :func:`copy_once` has one for each target."""
    pending = targets.filter("state = 'pending'").select("checksum", "size", "target_path", "task_id")
    return volume_files.select("checksum", "size", F.col("path").alias("source")).join(pending, ["checksum", "size"])


def copy_once(volume_files: DataFrame, targets: DataFrame) -> DataFrame:
    """One copy for each pending target: from the first path of its content.  However many files and targets share a content, rows are as many as targets."""
    first = volume_files.groupBy("checksum", "size").agg(F.min("path").alias("source"))
    return targets.filter("state = 'pending'").select("checksum", "size", "target_path", "task_id").join(first, ["checksum", "size"])


def scan_statistics(volume_files: DataFrame, targets: DataFrame) -> DataFrame:
    """Files of the volume with and without a pending target, and the copies that they make."""
    per = targets.filter("state = 'pending'").groupBy("checksum", "size").agg(F.count(F.lit(1)).alias("_n"))
    j = volume_files.select("checksum", "size").join(per, ["checksum", "size"], "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return j.agg(count(F.col("_n").isNotNull()).alias("matched"), count(F.col("_n").isNull()).alias("unmatched"), F.coalesce(F.sum("_n"), F.lit(0)).alias("operations"))


def pending_by_volume(targets: DataFrame) -> DataFrame:
    """Pending targets on each volume; one on several counts on each."""
    return targets.filter("state = 'pending'").select(F.explode("backup_dest").alias("volume")).groupBy("volume").agg(F.count(F.lit(1)).alias("n_pending"))


def contents(targets: DataFrame) -> DataFrame:
    """Distinct contents and targets in each state."""
    return targets.groupBy("state").agg(F.countDistinct("checksum", "size").alias("n_contents"), F.count(F.lit(1)).alias("n_targets"))


def move_to_copied(targets: DataFrame, done: DataFrame) -> DataFrame:
    """Targets whose task is in ``done`` (task_id) become copied."""
    hit = done.select("task_id", F.lit(True).alias("_done")).distinct()
    return targets.join(hit, "task_id", "left").withColumn("state", F.when(F.col("_done").isNotNull(), "copied").otherwise(F.col("state"))).drop("_done")


def actions(journal: DataFrame, on_disk: DataFrame, volumes: list[str]) -> DataFrame:
    """For each journal entry: skip (it is there), copy (a mounted volume has it) or missing_volume."""
    there = on_disk.select("alias", "dir", "fname", F.col("checksum").alias("_c"))
    j = journal.join(there, ["alias", "dir", "fname"], "left")
    mounted = F.arrays_overlap("backup_dest", F.array(*map(F.lit, volumes))) if volumes else F.lit(False)
    action = F.when(F.col("_c").eqNullSafe(F.col("checksum")) & F.col("_c").isNotNull(), "skip").when(mounted, "copy").otherwise("missing_volume")
    return j.withColumn("action", action).drop("_c")


def missing_volumes(planned: DataFrame) -> DataFrame:
    """Volumes that would be needed: those of files that no mounted volume has."""
    return planned.filter("action = 'missing_volume'").select(F.explode("backup_dest").alias("volume")).distinct()


def populate(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files whose content is here under another path, and whose own path is not: which file to copy to it."""
    here = local.groupBy("checksum", "size").agg(F.min("path").alias("local_path"))
    found = remote.select("checksum", "size", F.col("path").alias("wanted")).join(here, ["checksum", "size"])
    return found.join(local.select(F.col("path").alias("wanted")), "wanted", "left_anti").select("wanted", "local_path", "checksum", "size")
