"""Label lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(labels: Column, label: str) -> Column:
    return F.coalesce(F.array_contains(labels, label), F.lit(False))


def added(labels: Column, label: str | Column) -> Column:
    """With the label at the end, unless it is there."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.array_union(labels, F.array(label))


def removed(labels: Column, label: str) -> Column:
    return F.array_remove(labels, label)


def joined(labels: Column) -> Column:
    """One text of the sorted labels."""
    return F.array_join(F.array_sort(labels), ",")


def union(first: Column, second: Column) -> Column:
    """In the order of first appearance."""
    return F.array_union(first, second)
