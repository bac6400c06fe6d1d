"""Commands over a stored catalog: python -m tallymark --catalog FOLDER COMMAND ...

Nothing is copied, moved or deleted without --go.
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs
from .operators import content, coverage, discovery, durable, filters, restore, sequential, state, tuning
from .plans import execute, rounds, tables
from .sources import config, documents, journals, sink, store, walk

CONFIG = ".tallymark.xml"


def whole_copy(source: str, target: str) -> str:
    """A copy with content of its own: a hard link would change with its source."""
    return execute.copy_file(source, target, link=False)


def session() -> SparkSession:
    return SparkSession.builder.appName("tallymark").config("spark.ui.showConsoleProgress", "false").getOrCreate()


class Commands:
    """Each public method is a command; it returns the exit code."""

    def __init__(self, spark: SparkSession, catalog: str, settings: str = CONFIG):
        self.spark, self.store, self.settings = spark, store.Catalog(spark, catalog), settings
        self.config = config.Config.parse(open(settings, encoding="utf-8").read()) if os.path.exists(settings) else config.Config()

    # ------------------------------------------------------------ helpers

    def _listed(self, *roots: str) -> DataFrame:
        """What lies below the roots and is no file of the catalog's own; ignored directories are not even read."""
        found = filters.drop_metadata(walk.listed(self.spark, list(roots), self.config.ignores))
        return found.filter(~F.col("fname").rlike(f"^{sink.NAME.replace('.', '[.]')}[.][0-9a-f]+[.]part$"))

    def _held(self, volume: str) -> DataFrame:
        """(path, checksum, size) of a volume's files."""
        listed = self._listed(volume)
        return walk.checksums(listed).join(listed.select(F.concat_ws("/", "dir", "fname").alias("path"), "size"), "path").withColumnRenamed("new_checksum", "checksum")

    def _pairs(self, d: dict[str, str], names: str) -> DataFrame:
        return self.spark.createDataFrame(list(d.items()), names)

    def _own(self) -> DataFrame:
        """The catalog's files below the sources; copies on volumes are under the volumes' labels."""
        return self.store.read("files").join(F.broadcast(self._pairs(self.config.sources, "alias string, _root string")), "alias", "left_semi")

    def _show(self, df: DataFrame, *order: str) -> None:
        for r in df.orderBy(*order).toLocalIterator():
            print(*r, sep="\t")

    def _place(self, tag: str) -> str:
        return f"{durable.shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"

    def _carry_out(self, plan: DataFrame, size: int = 0, adaptive: bool = False, most: int = 0) -> tuple[rounds.Run, DataFrame]:
        """The run, and its outcomes, which are read where the tasks wrote them."""
        tuner = tuning.Tuner(2, most or self.spark.sparkContext.defaultParallelism * 2) if adaptive else None
        run = rounds.carry_out(plan, self._place("run"), size=size or rounds.ROUND, tuner=tuner, copier=whole_copy, listener=lambda told: print(told, file=sys.stderr, flush=True))
        return run, rounds.outcomes(self.spark, run, plan.schema)

    # ------------------------------------------------------------ configuration

    def source(self, alias: str = "", path: str = "", remove: bool = False) -> int:
        """Names a tree that is backed up, or forgets it; without an alias, lists them."""
        if not alias:
            for a, p in sorted(self.config.sources.items()):
                print(a, p, sep="\t")
            return 0
        ok = self.config.remove_source(alias) if remove else bool(path) and self.config.add_source(alias, os.path.abspath(path))
        self.config.save(self.settings)
        return 0 if ok else 1

    def ignore(self, pattern: str = "") -> int:
        """Adds a pattern of paths that are passed over; without one, lists them.  1 if it is known, 2 if Spark can't read it."""
        if not pattern:
            print(*self.config.ignores, sep="\n")
            return 0
        if not filters.valid_patterns(self.spark, [pattern]):
            return 2
        ok = self.config.add_ignore(pattern)
        self.config.save(self.settings)
        return 0 if ok else 1

    def ignore_test(self, path: str) -> int:
        """Says which patterns a path matches; 1 if there is none."""
        hit = [p for p in filters.valid_patterns(self.spark, self.config.ignores) if self.spark.range(1).select(F.lit(path).rlike(p)).first()[0]]
        print(*hit, sep="\n")
        return 0 if hit else 1

    def restore_to(self, alias: str, path: str = "", remove: bool = False) -> int:
        """Says where the files of an alias are restored to; without a path, to their source."""
        if remove:
            ok = self.config.remove_restore(alias)
        else:
            try:
                ok = self.config.set_restore(alias, path) is None
            except KeyError:
                ok = False
        self.config.save(self.settings)
        return 0 if ok else 1

    def label(self, volume: str, show: bool = False, recreate: bool = False) -> int:
        """Prints the label of a volume, which is made where there is none; with --show it isn't (1), with --recreate it is made anew."""
        if show:
            found = config.volume_label(volume)
            print(found or "no label")
            return 0 if found else 1
        if recreate:
            old = os.path.join(volume, filters.METADATA_NAMES[3])
            if os.path.exists(old):
                os.unlink(old)
        print(config.ensure_volume_label(volume, self.config))
        self.config.save(self.settings)
        return 0

    # ------------------------------------------------------------ the catalog

    def check(self, scrub: bool = False, recompute: bool = False, validate: bool = False, moves: bool = False, rename: bool = False, write: bool = False) -> int:
        """Scans the sources, fills in checksums and stores what changed; 2 if a content no longer has its checksum.

        --rename gives files the names that the rules propose, first; --moves
        takes a new file for a deleted one of equal size and name, which keeps its
        checksum and volumes; --write brings the directories' documents in line.
        """
        if rename:
            found = self._listed(*self.config.sources.values()).withColumn("path", F.concat_ws("/", "dir", "fname"))
            steps = tables.renames(sequential.rename_plan(found, self.config.rules)).withColumn("rank", F.monotonically_increasing_id())
            self._carry_out(steps)
        roots = self._pairs({os.path.abspath(p): a for a, p in self.config.sources.items()}, "root string, alias string")
        found = self._listed(*self.config.sources.values()).join(F.broadcast(roots), "root").withColumn("path", F.concat_ws("/", "dir", "fname"))
        known = self.store.read("files")
        scanned = known.join(roots.select("alias"), "alias", "left_semi")
        before = state.follow_moves(scanned, found) if moves else scanned
        new = state.overlay(before, found).filter("action IN ('new', 'changed')")
        asked = found if recompute or validate else found.join(new, ["dir", "fname"], "left_semi").unionByName(found.join(filters.missing_checksum(before), ["dir", "fname"], "left_semi")).distinct()
        done = state.check(before, found, walk.checksums(asked), scrub_labels=scrub, recompute=recompute, only_validate=validate)
        done = done.join(found.select("path", "alias"), "path", "left").join(before.select("path", F.col("alias").alias("_a"), "tags"), "path", "left")
        done = done.withColumns({"alias": F.coalesce("alias", "_a"), "tags": F.coalesce("tags", F.array().cast("array<string>"))}).drop("_a")
        done = durable.checkpointed(done)
        counts = {r["action"]: r["count"] for r in done.groupBy("action").count().collect()}
        rows = done.filter("action <> 'delete'").select(*known.columns)
        # Only what differs is stored; what was known and isn't there any more goes.
        self.store.change("files", put=rows.exceptAll(scanned), drop=scanned.select("alias", "path").join(rows.select("alias", "path"), ["alias", "path"], "left_anti"))
        if write:
            sink.persist(rows, list(self.config.sources.values()))
        print(*(f"{n} {a}" for a, n in sorted(counts.items())), sep=", ")
        return 2 if counts.get("mismatch") else 0

    def discover(self, volume: str, dry: bool = False) -> int:
        """Tags what a volume already holds; with --dry only says how much that is."""
        label = config.volume_label(volume) or "" if dry else config.ensure_volume_label(volume, self.config)
        held, files = durable.checkpointed(self._held(volume)), self._own()
        print(*discovery.statistics(files, held, label).first(), sep="\t")
        if not dry:
            self.config.save(self.settings)
            self.store.change("files", put=discovery.discover(files, held, label).filter("updated").select(*files.columns))
        return 0

    def journal(self, out: str) -> int:
        """Writes the catalog as journals, below a folder."""
        parts = documents.write_journal(self._own())
        parts.select("xml").write.mode("overwrite").text(out)
        return 0

    # ------------------------------------------------------------ copies

    def backup(self, volume: str, most: int = 0, capacity: int = 0, adaptive: bool = False, go: bool = False) -> int:
        """Copies to a volume what it lacks, least covered and largest first; 3 if something could not be copied.

        What doesn't fit (into --capacity bytes, or what is free) is left out by
        the rules for a volume that fills up, so the volume gets the beginning of
        the order.  --adaptive lets the measured throughput say how many copies
        run at a time.
        """
        label = config.ensure_volume_label(volume, self.config)
        self.config.save(self.settings)
        files = durable.checkpointed(self._own())
        ranked = content.ranked(filters.not_on_volume(content.merge_sources(files), label))
        ranked = ranked.filter(F.col("rank") <= most) if most else ranked
        roots = self._pairs({a: os.path.abspath(p) for a, p in self.config.sources.items()}, "alias string, root string")
        todo = ranked.select("checksum", "size", "path", "rank").join(files.select("path", "alias"), "path").join(F.broadcast(roots), "alias")
        todo = todo.withColumn("target", F.concat_ws("/", F.lit(os.path.abspath(volume)), "alias", F.substring("path", F.length("root") + 2, F.length("path"))))
        plan = durable.checkpointed(tables.copies(todo).join(todo.select(F.col("path").alias("source"), "rank"), "source").select(*tables.COLUMNS, "rank"))
        fits = sequential.fill_volume(plan.select("rank", "size"), capacity or shutil.disk_usage(volume).free)
        plan = durable.checkpointed(plan.join(fits.withColumnRenamed("action", "fit"), "rank"))
        if not go:
            self._show(plan.select(F.when(F.col("fit") == "copy", "planned").otherwise(F.col("fit")), "source", "target", "size", "rank"), "rank")
            return 0
        run, outcome = self._carry_out(plan.filter("fit = 'copy'").select(*tables.COLUMNS, "rank"), adaptive=adaptive)
        left = plan.filter("fit <> 'copy'").select(*tables.COLUMNS, "rank", F.col("fit").alias("result"))
        outcome = durable.checkpointed(outcome.unionByName(left))
        self.store.change("outcomes", put=outcome.withColumn("run", F.lit(f"{label}-{int(time.time() * 1000)}")))
        done = outcome.filter("result = 'done'")
        same = files.join(done.select("checksum").distinct(), "checksum", "left_semi")  # every file of a content that has been copied
        copies = state.copied_rows(files, done.select(F.col("source").alias("path"), "target", F.unix_timestamp().alias("mtime")), label).withColumn("alias", F.lit(label))
        self.store.change("files", put=state.apply_copies(same, same.select("path"), label).select(*files.columns).unionByName(copies.select(*files.columns)))
        bad = outcome.filter("result <> 'done'")
        self._show(bad.select("result", "source", "target", "rank"), "rank")
        n, missed = done.count(), bad.count()
        print(n, "copied,", missed, "not,", len(run.rounds), "rounds of", ",".join(str(r[0]) for r in run.rounds), "tasks")
        return 3 if missed else 0

    def prune(self, volume: str, go: bool = False) -> int:
        """Deletes from a volume what no source has any more, empty files, and copies of a content beyond the first."""
        listed = self._listed(volume)
        held = durable.checkpointed(self._held(volume).join(listed.select(F.concat_ws("/", "dir", "fname").alias("path"), "fname"), "path"))
        orphans = content.absent(held, self._own()).filter("size > 0")
        kept = held.groupBy("checksum", "size").agg(F.min("path").alias("path"))
        plan = durable.checkpointed(tables.deletions(content.present(held, self._own()).unionByName(held.filter("size = 0")).distinct(), kept, orphans)).withColumn("rank", F.monotonically_increasing_id())
        if not go:
            self._show(plan.select("reason", "source", "size"), "source")
            return 0
        _, outcome = self._carry_out(durable.checkpointed(plan))
        self.store.change("files", drop=outcome.filter("result = 'done'").select(F.lit(config.volume_label(volume) or "").alias("alias"), F.col("source").alias("path")))
        print(outcome.filter("result = 'done'").count(), "deleted")
        return 0

    def restore(self, volume: str, journal: str = "", go: bool = False) -> int:
        """Takes in a journal, if one is given, and copies back what a volume has; 4 if other volumes are needed still."""
        if journal:
            read = journals.read_journals(self.spark, [journal])
            taken = durable.checkpointed(restore.ingest(read, self._pairs(self.config.restore, "alias string, path string"), self._pairs(self.config.sources, "alias string, path string")))
            self.store.write("targets", taken)
            counts = {r["state"]: r["count"] for r in taken.groupBy("state").count().collect()}
            print(counts.get("pending", 0), "inserted,", counts.get("failed", 0), "failed")
        targets = self.store.read("targets")
        steps = restore.copy_once(self._held(volume), targets).select(F.lit("copy").alias("action"), "source", F.col("target_path").alias("target"), "checksum", "size", F.col("task_id").alias("reason"))
        steps = content.ranked(steps, order=[F.col("target").asc()])
        if not go:
            self._show(steps.select(F.lit("planned"), "source", "target"), "target")
            return 0
        _, outcome = self._carry_out(steps)
        done = outcome.filter("result = 'done'").select(F.col("reason").alias("task_id")).distinct()
        self.store.change("targets", put=restore.move_to_copied(targets.join(done, "task_id", "left_semi"), done).select(*targets.columns))
        left = restore.pending_by_volume(self.store.read("targets"))
        self._show(left, "volume")
        return 4 if left.count() else 0

    # ------------------------------------------------------------ reports

    def report(self) -> int:
        """Files and bytes by the number of volumes that hold them."""
        self._show(coverage.bytes_by_coverage(self._own()), "n_dest")
        return 0

    def missing(self) -> int:
        """Files that no volume holds, and how many each volume holds."""
        files = self._own()
        self._show(filters.coverage_cap(files, 0).select("path", "size"), "path")
        self._show(coverage.by_volume(files), "volume")
        return 0

    def dump(self, path: str, kind: str = "hex", limit: int = 0) -> int:
        """Prints a stored file's payload as hex, base64 or raw; 1 if the catalog has no such file."""
        row = self.store.read("files").filter(F.col("path") == path).select(codecs.dump(codecs.encode_payload(F.col("size"), F.col("path"), F.col("backup_dest")), kind or "hex", limit or None).alias("d")).first()
        if row is not None:
            print(row["d"].decode(errors="replace") if isinstance(row["d"], (bytes, bytearray)) else row["d"])
        return 0 if row is not None else 1


#: Arguments of each command; a ? ends one that may be left out, = one with a value.
ARGUMENTS = {
    "source": ("alias?", "path?", "--remove"), "ignore": ("pattern?",), "ignore_test": ("path",), "restore_to": ("alias", "path?", "--remove"), "label": ("volume", "--show", "--recreate"),
    "check": ("--scrub", "--recompute", "--validate", "--moves", "--rename", "--write"), "discover": ("volume", "--dry"), "journal": ("out",),
    "backup": ("volume", "--most=", "--capacity=", "--adaptive", "--go"), "prune": ("volume", "--go"), "restore": ("volume", "--journal=", "--go"),
    "report": (), "missing": (), "dump": ("path", "--kind=", "--limit="),
}
NUMBERS = ("--most=", "--capacity=", "--limit=")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallymark", description=__doc__)
    p.add_argument("--catalog", required=True, help="folder of the catalog")
    p.add_argument("--config", default=CONFIG, help="configuration file")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in ARGUMENTS.items():
        one = sub.add_parser(name, help=getattr(Commands, name).__doc__)
        for a in arguments:
            if a.endswith("="):
                one.add_argument(a[:-1], default=0 if a in NUMBERS else "", type=int if a in NUMBERS else str)
            elif a.startswith("--"):
                one.add_argument(a, action="store_true")
            else:
                one.add_argument(a.rstrip("?"), **({"nargs": "?", "default": ""} if a.endswith("?") else {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(argv))
    commands = Commands(spark or session(), given.pop("catalog"), given.pop("config"))
    return getattr(commands, given.pop("command"))(**given)


if __name__ == "__main__":
    sys.exit(main())
