"""Paths as text: byte-wise, with / between the parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """All before the last slash; "/" for what lies at the top, "." without a slash."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(~path.contains("/"), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def join(*parts: Column) -> Column:
    """Parts with single slashes between them."""
    return F.regexp_replace(F.concat_ws("/", *parts), "/+", "/")


def is_under(path: Column, root: Column) -> Column:
    """True prefix test: the path lies below the root (not the root itself)."""
    return path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def relative(path: Column, root: Column) -> Column:
    """What follows the root and its slash; null outside it."""
    trimmed = F.rtrim(root, F.lit("/"))
    return F.when(is_under(path, root), F.substring(path, F.length(trimmed) + 2, F.length(path)))


def ancestors(path: Column) -> Column:
    """Every directory above, the nearest last; without the empty root."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: p != "")


def is_hidden(directory: Column) -> Column:
    """Some part starts with a dot; "." and ".." themselves don't count."""
    return F.exists(F.split(directory, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def has_segment(directory: Column, name: str) -> Column:
    """The directory is, or lies in, one called ``name`` (not at the very beginning of the text)."""
    return F.rtrim(directory, F.lit("/")).endswith(f"/{name}") | directory.contains(f"/{name}/")
