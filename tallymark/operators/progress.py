"""Progress of runs: how much there is to do, and how much of it a finished step has seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def amount(files: DataFrame) -> tuple[int, int]:
    """Files and bytes: the counting pass."""
    r = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    return r["n"], r["b"]


@dataclass
class Progress:
    """What a step has seen, against the counting pass; known once the step's action is done."""

    seen: Observation
    files: int
    bytes: int

    @property
    def done(self) -> tuple[int, int]:
        got = self.seen.get
        return got["n"], got["b"]

    @property
    def share(self) -> float:
        """Of the bytes, or of the files where all are empty."""
        n, b = self.done
        return b / self.bytes if self.bytes else n / self.files if self.files else 1.0


def observed(files: DataFrame, total: tuple[int, int] | None = None, name: str = "progress") -> tuple[DataFrame, Progress]:
    """``files``, counted as they pass by, and the progress; counting costs no pass of its own."""
    n, b = total or amount(files)
    seen = Observation(name)
    counted = files.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
    return counted, Progress(seen, n, b)
