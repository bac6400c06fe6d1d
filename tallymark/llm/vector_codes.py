"""Compression of vectors to codes: one small codebook for each part of the components.

Components become integers, so that sums, distances and ties are exact and the
same however the rows are spread.  In each round every codebook goes to the
tasks as a kd-tree; branch and bound finds a part's nearest entry, visiting nodes
whose bound *equals* the best distance too, since an entry there may win the tie
by its lower index.  Tasks send home only the sums and counts of the entries
they used: the codebooks are all that ever reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, materialise, unused

#: Entries that a leaf of a tree holds at most.
LEAF = 2
#: Tasks that share the rows of one label when its sum comes back to them.
SALT = 32


# --------------------------------------------------------------------------- kd-tree


@dataclass
class Node:
    """Entries ``at`` (ascending) within the box ``low``..``high``; a leaf has no ``sides``."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sides: tuple[Node, ...] = field(default=())

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each point from the box: no entry in it is nearer."""
        return ((x - np.clip(x, self.low, self.high)) ** 2).sum(axis=1)


def build(entries: np.ndarray, at: np.ndarray | None = None) -> Node:
    """Splits at the median of the widest axis."""
    at = np.arange(len(entries)) if at is None else at
    here = entries[at]
    node = Node(at, here.min(axis=0), here.max(axis=0))
    wide = int((node.high - node.low).argmax())
    if len(at) > LEAF and node.high[wide] > node.low[wide]:
        order = at[np.argsort(here[:, wide], kind="stable")]
        node.sides = tuple(build(entries, np.sort(half)) for half in (order[: len(at) // 2], order[len(at) // 2 :]))
    return node


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of ``x``; ties go to the lower index."""
    index = np.full(len(x), len(entries))
    best = np.full(len(x), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not node.sides:
            far = ((x[rows, None, :] - entries[node.at]) ** 2).sum(axis=2)
            first = far.argmin(axis=1)
            far, found = far[np.arange(len(rows)), first], node.at[first]
            won = (far < best[rows]) | (far == best[rows]) & (found < index[rows])
            best[rows[won]], index[rows[won]] = far[won], found[won]
            return
        bounds = [side.bound(x[rows]) for side in node.sides]
        left_first = bounds[0] <= bounds[1]
        for first, second, mine in ((0, 1, left_first), (1, 0, ~left_first)):
            visit(node.sides[first], rows[mine])
            later = bounds[second][mine] <= best[rows[mine]]
            visit(node.sides[second], rows[mine][later])

    visit(tree, np.arange(len(x)))
    return index, best


# --------------------------------------------------------------------------- codebooks


@dataclass
class Codebooks:
    """``entries``: (parts, entries, width) integers; of an empty table there are no entries."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        """SHA-256 of all components as decimals, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _cut(column: pa.Array, parts: int) -> np.ndarray:
    """(parts, rows, width) of a column of lists."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, -1).transpose(1, 0, 2))


def _assign(books: np.ndarray, trees: list[Node], x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for entries, tree, part in zip(books, trees, x):
        yield nearest(tree, entries, part)


def _next(books: np.ndarray, ints: DataFrame) -> np.ndarray:
    """One round: every part to its nearest entry, then every entry to the floor of its parts' mean."""
    parts, size, width = books.shape
    shared = ints.sparkSession.sparkContext.broadcast((books, [build(b) for b in books]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            x = _cut(batch.column(0), parts)
            for p, (index, _) in enumerate(_assign(*shared.value, x)):
                np.add.at(total[p], index, x[p])
                count[p] += np.bincount(index, minlength=size)
        p, e = np.nonzero(count)
        if len(p):
            slot = np.repeat(p * size + e, width).astype(np.int32)
            place = np.tile(np.arange(width, dtype=np.int32), len(p))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(place), pa.array(total[p, e].ravel()), pa.array(np.repeat(count[p, e], width))], ["slot", "place", "total", "n"])

    found = ints.select("x").mapInArrow(lean(sums), "slot int, place int, total long, n long").groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = books.copy()
    for r in found.collect():  # a number for each component of the codebooks
        new[r["slot"] // size, r["slot"] % size, r["place"]] = r["total"] // r["n"]
    shared.unpersist()
    return new


def integers(vectors: DataFrame, *, vec_id: str, vector: str, keep: tuple[str, ...], parts: int, scale: int) -> tuple[DataFrame, int]:
    """(rows of id, x (floor of ``scale`` times each component) and ``keep``, number of components); see :func:`compress` for what is left out."""
    raw = F.col(vector)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), raw.cast("array<double>").alias("v"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).withColumn("n", F.size("v"))
    rows = rows.filter((F.col("n") > 0) & (F.col("n") % parts == 0) & ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    common = rows.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else parts
    # Below this, no squared distance of whole vectors leaves 64 bits.
    room = int((2**61 / dim) ** 0.5 / 2)
    whole = F.transform("v", lambda v: F.when(F.abs(v) * scale < room, F.floor(v * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {room / scale:.0f}, where distances no longer fit 64 bits")).cast("long")))
    return rows.filter(F.col("n") == dim).select("id", whole.alias("x"), *[f"k{i}" for i in range(len(keep))]), dim


def fit(ints: DataFrame, dim: int, *, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks that start as the parts of the rows with the smallest ids (null last; rows alike in id by their components)."""
    first = ints.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()  # as many rows as a codebook has entries
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        books = _next(books, ints)
    return Codebooks(books, scale)


def encode(ints: DataFrame, books: Codebooks, keep: tuple[str, ...]) -> DataFrame:
    """id, ``keep``, code (two hex digits for each part) and error of each row of :func:`integers`."""
    parts, width = len(books.entries), len(keep)
    shared = ints.sparkSession.sparkContext.broadcast((books.entries, [build(b) for b in books.entries] if books.entries.size else []))
    names = ["id", *[f"k{i}" for i in range(width)]]
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error, code = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, "", f"<U{2 * parts}")
            for index, far in _assign(*shared.value, _cut(batch.column(width + 1), parts)):
                error += far
                code = np.char.add(code, digits[index])
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], pa.array(code.tolist(), pa.string()), pa.array(error)], [*names, "code", "error"])

    schema = T.StructType([ints.schema[n] for n in names]).add("code", "string").add("error", "long")
    return ints.select(*names, "x").mapInArrow(lean(run), schema)


def compress(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ("label",), parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(vec_id, ``keep``, code and error of every vector; the codebooks).

    Vectors that are null or hold null or non-finite components are left out, and
    so are those that have another length than most or can't be cut into
    ``parts``, empty ones among them.  A null id counts as the largest; repeated
    rows count each; with fewer than ``entries`` rows the codebooks have as many
    entries as there are rows; an empty table gives an empty result.  Components
    so large that a squared distance leaves 64 bits are an error.  Other columns
    of the table play no part.
    """
    if entries > 256:
        raise ValueError("an index has two hex digits: 256 entries at most")
    ints, dim = integers(vectors, vec_id=vec_id, vector=vector, keep=keep, parts=parts, scale=scale)
    ints = materialise(ints, "integers")
    books = fit(ints, dim, parts=parts, entries=entries, rounds=rounds, scale=scale)
    return encode(ints, books, keep).toDF(vec_id, *keep, "code", "error"), books


def expand(codes: DataFrame, books: Codebooks, *, name: str = "vector") -> DataFrame:
    """``codes`` with the vectors that their codes stand for, in a column ``name``; the middle of an integer's range stands for it."""
    table = F.array(*[F.array(*[F.lit(((e + 0.5) / books.scale).tolist()) for e in part]) for part in books.entries])
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(name, F.concat(*[F.element_at(F.element_at(table, p + 1), index(p) + 1) for p in range(len(books.entries))]))


def with_group_error(codes: DataFrame, *, by: str = "label", error: str = "error", name: str = "label_error") -> DataFrame:
    """``codes`` with the sum of ``error`` over all rows alike in ``by`` (nulls together).

    Sums are taken before anything is shuffled, and come back by value and salt, so a value of any share of the rows is many tasks' work.
    """
    salt, key, flag = (unused(c, codes.columns) for c in ("salt", "key", "is_null"))
    sums = codes.groupBy(F.col(by).alias(key), F.col(by).isNull().alias(flag)).agg(F.sum(error).alias(name)).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = codes.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    joined = salted.join(sums, salted[by].eqNullSafe(sums[key]) & (salted[salt] == sums[salt]))
    return joined.select(*[salted[c] for c in codes.columns], sums[name])


def compress_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    codes, books = compress(vectors)
    return with_group_error(materialise(codes, "codes")).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL for the rows of :func:`compress_vectors`: one step after the other, each entry compared with each part."""
    steps = [
        f"""k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS (SELECT r, vec_id, label, t.p AS p, list_slice(v, t.p * len(v) // {parts} + 1, (t.p + 1) * len(v) // {parts}) AS v FROM k, range({parts}) AS t(p))",
        f"b0 AS (SELECT p, r - 1 AS e, v FROM p WHERE r <= {entries})",
    ]
    far = "CAST(list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT p.r, p.p, min({{'d': {far}, 'e': b.e}}) AS m FROM p JOIN b{i} AS b ON b.p = p.p GROUP BY p.r, p.p)")
        if i < rounds:
            steps.append(
                f"""u{i} AS (SELECT p, e, list(w ORDER BY j) AS v FROM (SELECT p.p AS p, a.m.e AS e, j, CAST((sum(p.v[j]) - ((sum(p.v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS w
    FROM p JOIN a{i} AS a ON a.r = p.r AND a.p = p.p, range(1, (SELECT max(len(v)) FROM p) + 1) AS t(j) GROUP BY ALL) GROUP BY p, e)"""
            )
            steps.append(f"b{i + 1} AS (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM b{i} AS b LEFT JOIN u{i} AS u ON u.p = b.p AND u.e = b.e)")
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b" + str(rounds) + ")")
    steps.append("c AS (SELECT r, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a" + str(rounds) + " GROUP BY r)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"


ORACLE = oracle()
