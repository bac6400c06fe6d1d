"""A function of one's own over the rows of directories: it may change a row, delete it or leave it as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a visitor returns for a row that is to go, and for one that is to stay as it is.
DELETE, IGNORE = "delete", "ignore"
#: Gets a row as a dict; returns the fields that change, DELETE or IGNORE (or None).
Visitor = Callable[[dict], dict | str | None]


def mutate(files: DataFrame, visitor: Visitor) -> DataFrame:
    """``files`` with action keep, changed or delete, after the visitor has seen each row.

    A row counts as changed only if a field is another value than before.  Rows
    of a directory are visited one after the other, in the order of their names,
    and flow through: none is held.  A field that the table lacks, or a result of
    another kind, is an error.  Null directories are visited too.
    """
    names, schema = files.columns, T.StructType([*files.schema.fields, T.StructField("action", T.StringType())])

    class Visit:
        def eval(self, row):
            old = {n: row[n] for n in names}
            told = visitor(dict(old))
            if told is None or told == IGNORE:
                action, new = "keep", old
            elif told == DELETE:
                action, new = "delete", old
            elif isinstance(told, dict):
                if unknown := set(told) - set(names):
                    raise KeyError(f"no such fields: {sorted(unknown)}")
                new = old | told
                action = "keep" if new == old else "changed"
            else:
                raise TypeError(f"a visitor returns fields, {DELETE!r} or {IGNORE!r}, not {told!r}")
            yield (*new.values(), action)

    visited = F.udtf(Visit, returnType=schema)
    return visited(files.asTable().partitionBy("dir").orderBy("fname"))


def stale(visited: DataFrame) -> DataFrame:
    """(dir, empty): directories in which something really changed, whose documents are to be written, or deleted where no row is left."""
    per = visited.groupBy("dir").agg(F.bool_or(F.col("action") != "keep").alias("touched"), F.bool_and(F.col("action") == "delete").alias("empty"))
    return per.filter("touched").select("dir", "empty")
