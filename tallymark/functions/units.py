"""Sizes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units by powers of 1024.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB")


def human_bytes(size: Column) -> Column:
    """Two decimals, ties to even."""
    out = F.format_string("%.2f B", size.cast("double"))
    for k, unit in enumerate(UNITS[1:], 1):
        out = F.when(size >= F.lit(1024.0**k), F.format_string(f"%.2f {unit}", F.bround(size / F.lit(1024.0**k), 2))).otherwise(out)
    return out


def kib_clamped(size: Column) -> Column:
    """Whole KiB, at most the largest 32-bit number."""
    return F.least(F.floor(size / 1024), F.lit(2147483647)).cast("int")


def seconds_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
