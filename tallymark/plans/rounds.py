"""A plan carried out in rounds: in order, with progress while it runs, and with as many copies at a time as pay.

A round is a stretch of the plan's order that holds about a given number of bytes.
Within it each task takes a stretch of its own and goes through it in order, so
what is done when a run ends early is the plan's beginning, but for one round.
The tuner hears each round's throughput and says how many tasks the next one has.
Outcomes are written where the tasks run; the driver holds a few numbers a round.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tuning import Tuner
from . import execute

#: Bytes of a round, about; seconds between reports.
ROUND, EVERY = 4 << 30, 5.0
#: Rows whose sizes are added up at a time.
_RANGE = 1 << 16


class _Latest(AccumulatorParam):
    """For each part of a run the most that an attempt at it has reported: one that runs again doesn't count twice."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for part, (n, size) in b.items():
            n0, size0 = a.get(part, (0, 0))
            a[part] = (max(n, n0), max(size, size0))
        return a


@dataclass
class Told:
    """How far a run is; ``files`` and ``bytes`` are those planned."""

    files: int
    bytes: int
    done_files: int = 0
    done_bytes: int = 0

    def __str__(self) -> str:
        share = self.done_bytes / self.bytes if self.bytes else self.done_files / self.files if self.files else 1.0
        return f"{self.done_files} of {self.files} files, {self.done_bytes} of {self.bytes} bytes, {share:.0%}"


class Reporter:
    """Adds up what tasks report as they end, and tells ``listener`` of it every ``every`` seconds, and at the end, from a thread of its own."""

    def __init__(self, spark, files: int, size: int, listener: Callable[[Told], None] | None, every: float = EVERY):
        self.parts = spark.sparkContext.accumulator({}, _Latest())
        self.total, self.listener, self.every = (files, size), listener, every
        self.stop, self.thread = threading.Event(), None

    def now(self) -> Told:
        parts = list(dict(self.parts.value).values())
        return Told(*self.total, sum(n for n, _ in parts), sum(b for _, b in parts))

    def _tell(self) -> None:
        told = None
        while not self.stop.wait(self.every):
            if str(now := self.now()) != told:
                told = str(now)
                self.listener(now)

    def __enter__(self) -> Reporter:
        if self.listener:
            self.thread = threading.Thread(target=self._tell, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *error) -> None:
        self.stop.set()
        if self.thread:
            self.thread.join()
            self.listener(self.now())


def cut(plan: DataFrame, size: int = ROUND) -> DataFrame:
    """``plan`` with ``round`` (from 0) and ``part`` (the place within it, in bytes), by ``rank``: a round ends where ``size`` more bytes are full; what has no size counts one.

    Sums of ranges come first, so no window holds more than a range.
    """
    w = plan.withColumn("_s", F.greatest(F.coalesce("size", F.lit(0)), F.lit(1))).withColumn("_r", F.floor(F.col("rank") / _RANGE))
    sums = w.groupBy("_r").agg(F.sum("_s").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    inside = F.sum("_s").over(Window.partitionBy("_r").orderBy("rank"))
    used = w.join(sums.select("_r", before.alias("_b")), "_r").withColumn("_u", F.col("_b") + inside - F.col("_s"))
    return used.withColumns({"round": F.floor(F.col("_u") / size), "part": F.col("_u") % size}).drop("_r", "_s", "_b", "_u")


@dataclass
class Run:
    """What a run did: its outcomes are at ``path``; for each round (tasks, files, bytes, seconds, action of the tuner)."""

    path: str
    rounds: list[tuple[int, int, int, float, str]] = field(default_factory=list)


def carry_out(
    plan: DataFrame, path: str, *, size: int = ROUND, tuner: Tuner | None = None, copier: execute.Copier = execute.copy_file, listener: Callable[[Told], None] | None = None, every: float = EVERY,
    clock: Callable[[], float] = time.monotonic,
) -> Run:
    """Carries out a plan with ``rank``, round by round, and writes it with a column result below ``path``, a folder that driver and executors share.

    Without a tuner two tasks run at a time.  Rows of a plan may be carried out
    again: see :mod:`tallymark.plans.execute`.  A plan without rows has no round.
    """
    spark, schema = plan.sparkSession, T.StructType([*plan.schema.fields, T.StructField("result", T.StringType())])
    cut(plan, size).write.mode("overwrite").partitionBy("round").parquet(f"{path}/plan")
    staged = spark.read.parquet(f"{path}/plan") if plan.take(1) else None
    known = sorted(staged.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("b")).collect()) if staged else []  # a row for each round
    run = Run(path)
    with Reporter(spark, sum(r["n"] for r in known), sum(r["b"] for r in known), listener, every) as reporter:
        parts = reporter.parts
        for r in known:
            tasks, number = tuner.tokens if tuner else 2, r["round"]

            def go(batches: Iterator[pd.DataFrame], number: int = number) -> Iterator[pd.DataFrame]:
                n = done = 0
                for batch in batches:
                    results = [execute.carry_out(a, s, t, copier) for a, s, t in batch[["action", "source", "target"]].itertuples(index=False)]
                    n += len(results)
                    done += int(batch["size"].fillna(0)[[x == "done" for x in results]].sum())
                    yield batch.assign(result=results)
                parts.add({(number, TaskContext.get().partitionId()): (n, done)})

            start = clock()
            rows = staged.filter(F.col("round") == number).select(*plan.columns, "part")
            # A stretch of the round's bytes for each task, in the plan's order.
            task = F.least(F.floor(F.col("part") * tasks / F.lit(size)), F.lit(tasks - 1)).cast("int")
            dealt = rows.withColumn("_t", task).repartitionByRange(tasks, "_t").sortWithinPartitions("rank").select(*plan.columns)
            dealt.mapInPandas(go, schema).write.mode("overwrite").parquet(f"{path}/outcomes/round={number}")
            seconds = clock() - start
            moved = spark.read.schema(schema).parquet(f"{path}/outcomes/round={number}").filter("result = 'done'").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            action = tuner.hear(moved, seconds) if tuner else "hold"
            run.rounds.append((tasks, r["n"], moved, seconds, action))
    return run


def outcomes(spark, run: Run, schema: T.StructType) -> DataFrame:
    """The plan's rows with their results."""
    full = T.StructType([*schema.fields, T.StructField("result", T.StringType())])
    return spark.read.schema(full).parquet(f"{run.path}/outcomes").select(*full.names) if run.rounds else spark.createDataFrame([], full)
