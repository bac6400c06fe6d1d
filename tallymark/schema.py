"""Schemas of the catalog's tables; arrays are never null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "alias string, dir string, fname string, path string, checksum string, size bigint, mtime bigint, tags array<string>, backup_dest array<string>"
STAT = "dir string, fname string, size bigint, mtime bigint"
TARGETS = "checksum string, size bigint, task_id string, alias string, target_path string, backup_dest array<string>, state string"
PLAN = "action string, source string, target string, checksum string, size bigint, reason string"


def normalise(files: DataFrame) -> DataFrame:
    """Null tag and volume lists become empty ones."""
    empty = F.array().cast("array<string>")
    return files.withColumns({c: F.coalesce(F.col(c), empty) for c in ("tags", "backup_dest") if c in files.columns})
