"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is served in a shuffled order, and the source's
documents are served again in the same order once all are through.  A document
finishes at the virtual time  (words its source has served) / (the source's
target).  Sorting all sources' documents by that time gives a stream in which
each source has, at any moment, its share; the stream ends at the total budget,
and that is the only cut: sources meet their targets because at time 1, where the
targets' sum is reached, each has served its own.

The running totals that this needs are never taken over one partition: the
shuffled order and the virtual time are cut into ``2 ** bits`` equal ranges, the
totals of the ranges are summed first, and only rows of one range meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Side, lean, materialise, unused, write_side

#: Weights that the sources get in turn, in the order of their names.
WEIGHTS = (3, 1, 2)
EPOCHS = 2


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5) -> DataFrame:
    """(key, source, source_size) to which weight, target and the total budget are added; one row for each source.

    Water filling: sources in the order in which they reach their cap of
    EPOCHS times their size; the level is the first that the next one bears, which is the highest of those that some next one bears.
    """
    every = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("cap", EPOCHS * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = budget * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / heavy)
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    return s.withColumn("target", F.least("cap", F.col("weight") * level)).withColumn("total", F.floor(budget * F.sum("source_size").over(every))).drop("level", "cap")


def schedule(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", uid: str | None = None, bits: int = 16, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5) -> DataFrame:
    """The packets of all documents in the order of the stream: doc_id, size, source_size, target, epoch, finish (virtual time), place (words before it) and words (what the stream takes of it).

    A document is a packet in each epoch; that in which its source reaches its
    target is two, of which the first ends there, at time 1.  Nothing is cut but
    the stream, at the total budget.  The shuffle is by md5 of doc_id and of the
    text, so reruns agree; rows alike in these are told apart by ``nth``.  A null
    text has size 0 and is never taken; a null source is a source of its own, the
    last.
    """
    h = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source).alias("source"),
        (F.col(uid) if uid else F.lit(None).cast("long")).alias("uid"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("key"),
        h.alias("h"),
    ).withColumn("b", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits))
    ranges = rows.groupBy("key", "source", "b").agg(F.sum("size").alias("n"))
    known = targets(ranges.groupBy("key", "source").agg(F.sum("n").alias("source_size")), weights, budget)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = ranges.drop("source", "n").join(known.drop("source", "weight"), "key")
    order = Window.partitionBy("key", "b").orderBy("h", "doc_id", "size", "uid")
    served = rows.drop("source").join(ranges, ["key", "b"]).withColumn("nth", F.row_number().over(order)).withColumn("start", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    units = served.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS))))).withColumn("start", F.col("start") + F.col("epoch") * F.col("source_size"))
    # Packets: the words up to the source's target, if it lies within the document, and the words behind it.
    head = F.floor("target") - F.col("start")
    inside = (head > 0) & (head < F.col("size"))
    packet = lambda n, finish: F.struct(n.cast("long").alias("length"), finish.cast("double").alias("finish"))
    finish = F.when(F.col("size") > 0, (F.col("start") + F.col("size")) / F.col("target"))
    packets = F.when(inside, F.array(packet(head, F.lit(1.0)), packet(F.col("size") - head, finish))).otherwise(F.array(packet(F.col("size"), finish)))
    units = units.select("*", F.posexplode(packets).alias("packet", "p")).select("*", "p.*").drop("p")
    units = units.withColumn("f", F.coalesce(F.floor(F.col("finish") * 2**bits), F.pmod(F.col("b"), F.lit(2**bits))))
    # The globally sorted stream, range by range; what lies beyond the total budget is cut off.
    sums = units.groupBy("f").agg(F.sum("length").alias("n"))
    sums = sums.select("f", F.coalesce(F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each range of time
    stream = Window.partitionBy("f").orderBy(F.col("finish").asc_nulls_last(), "key", "h", "doc_id", "size", "nth", "epoch", "packet").rowsBetween(Window.unboundedPreceding, 0)
    units = units.join(sums, "f").withColumn("place", F.col("base") + F.sum("length").over(stream) - F.col("length"))
    return units.withColumn("words", F.greatest(F.lit(0), F.least("length", F.col("total") - F.col("place")))).select("key", "b", "nth", "uid", "doc_id", "size", "source_size", "target", "epoch", "finish", "place", "words")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``; see :func:`schedule`.  An empty table gives an empty one."""
    taken = schedule(docs, **options).groupBy("key", "b", "nth", "doc_id", "size").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, *, name: str = "taken", **options) -> DataFrame:
    """The documents that the mix takes, each once, with a column ``name``: how many of its words are taken, repeats counted.

    Texts are written once and not shuffled: what is taken comes back to them in
    side files.  A column ``name`` of ``docs`` is replaced.
    """
    docs = docs.drop(name)
    columns = docs.columns
    uid = unused("uid", columns)
    texts = materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "mixed")
    taken = schedule(texts, uid=uid, **options).groupBy("uid").agg(F.sum("words").alias("taken")).filter("taken > 0")
    side = write_side(taken, "taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Side(side)
        for batch in batches:
            found = [beside.of(uid) for uid in batch.column(len(columns)).to_pylist()]
            at = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
            n = pa.array([x[0] for x in found if x is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(columns)]), n], [*columns, name])

    return texts.mapInArrow(lean(run), T.StructType(list(texts.schema)[: len(columns)]).add(name, "long"))


#: DuckDB SQL for the rows of :func:`mix_sources` over {docs}.
ORACLE = """
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h,
    CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][turn % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
    FROM w WINDOW o AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()) AS target FROM l),
c AS (SELECT d.*, source_size, target, row_number() OVER o AS nth, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS first
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size)),
u AS (SELECT *, first + epoch * source_size AS start FROM c, range(2) AS e(epoch)),
q AS (SELECT *, floor(target) > start AND floor(target) < start + size AS crosses FROM u),
k AS (SELECT *, CASE WHEN crosses AND packet = 0 THEN 1.0::DOUBLE WHEN size > 0 THEN CAST(start + size AS DOUBLE) / target END AS finish,
    CAST(CASE WHEN NOT crosses THEN size WHEN packet = 0 THEN floor(target) - start ELSE start + size - floor(target) END AS BIGINT) AS length FROM q, range(2) AS p(packet) WHERE packet = 0 OR crosses),
z AS (SELECT *, sum(length) OVER (ORDER BY finish NULLS LAST, CASE WHEN source IS NULL THEN '' ELSE '=' || source END, h, doc_id NULLS FIRST, size, nth, epoch, packet ROWS UNBOUNDED PRECEDING) - length AS place FROM k),
g AS (SELECT *, greatest(0, least(length, (SELECT floor(1.5::DOUBLE * sum(size)) FROM d) - place)) AS words FROM z)
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken FROM g GROUP BY source, nth, doc_id, size, source_size, target
"""
