"""Near duplicates by a chosen-path similarity join over word shingles.

A document is the set of its shingles.  The join works on a sample of each set:
the shingles whose hash is below  SAMPLE / (size of the set), so that sets choose
alike.  In each run, a set goes down the path of every sampled shingle whose hash
for that run is low enough for BRANCH paths or so; a path that too many sets
share is split again by further sampled shingles, chosen anew on every path; a
path that few share is compared by brute force, sample against sample.  Two sets
at the threshold share a path with probability 1 - exp(-threshold * BRANCH), and
one on each of several levels as a branching process does; runs repeat until
such a pair is missed with probability 1 - RECALL at most, even if its paths are
split on all levels.

What shares a path and looks alike by its samples (CUT), or still crowds a path
on the last level, is a candidate, and candidates form groups.  Each set is then
compared exactly, once, with the sets of its group: no pair of documents is ever
emitted, a comparison adds up each set's number of links and keeps a spanning
star of them.  Groups are cut into blocks, whose texts go out once; whoever
compares two blocks reads them where they were written, so rows and texts that are
sent grow with a group and not with its square.  Each block is compared with
each.  Who needs classes only may have each block of a group of more than ALL
compared with itself and with the first, which finds the class of whatever has
links to a fair part of the group; sets that this leaves outside the group's main
class are sent, and compared with all others, once more.

Sets are collapsed first: equal sets travel, and are compared, once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Side, discard, file_system, hash_words, lean, materialise, mix, new_path, runs, unused, utf8, words, write_side
from .components import connected_components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Chosen shingles for each set, run and level; levels; sets that a path may hold before it is split.
BRANCH, LEVELS, BUCKET = 2.0, 3, 200
#: Sampled shingles of a set, about; similarity of samples that makes a candidate: 4 standard deviations below the threshold.
SAMPLE, CUT = 64, 0.6
#: Sets and shingles of a block, about; blocks of a group that are all compared with each other.
BLOCK, SHINGLES, ALL = 1000, 1 << 20, 16
CHUNK = 1 << 19


def n_runs(threshold: float, recall: float, branch: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall at most, though its paths be crowded on every level."""
    meets = 1.0
    for _ in range(levels):
        meets = 1 - math.exp(-threshold * branch * meets)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, one after the other, and the len+1 offsets.

    Words end at white space, A-Z count as a-z.  A text of fewer than k words
    is one shingle; one without words is the empty set.
    """
    start, end, first = words(raw, offsets)
    h = hash_words(LOWER[raw], start, end, 5)
    n = len(h)
    count = np.diff(first)
    total = np.zeros(n, np.uint64)
    for j in range(k):  # shorter texts: what there is
        at = np.arange(n) + j
        limit = np.repeat(first[1:], count)
        ok = at < limit
        total = total * np.uint64(0xD1342543DE82EF95 + 2 * j) + np.where(ok, h[np.minimum(at, max(n - 1, 0))], np.uint64(77 + j)) if n else total
    total = mix(total, 6)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(n) - np.repeat(first[:-1], count)
    keep = (place + k <= np.repeat(count, count)) | (place == 0)
    text, total = text[keep], total[keep]
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    text, total = text[new], total[new]
    return total, np.searchsorted(text, np.arange(len(count) + 1))


def _sets(docs: DataFrame, text: str, n_run: int, branch: float, names: dict[str, str]) -> DataFrame:
    """``docs`` with uid, key (of the set), n (its size), sample (low hashes) and nodes: the paths of the first level; under the ``names`` given."""
    columns = docs.columns
    source = docs.select(*columns, F.monotonically_increasing_id().alias(names["uid"]))
    at_text = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(at_text))
            for a, b in runs(offsets, CHUNK):
                token, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.diff(at)
                sums = [np.concatenate(([0], np.cumsum(mix(token, salt), dtype=np.uint64))) for salt in (1, 2)]
                key = np.stack([x[at[1:]] - x[at[:-1]] for x in sums], axis=1).view(np.uint8).reshape(b - a, 16)
                owner = np.repeat(np.arange(b - a), size)
                low = mix(token, 50)
                kept = np.flatnonzero(low < share(size)[owner])
                low, owner = low[kept], owner[kept]
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=b - a)))).astype(np.int32)
                chance = np.minimum(branch / np.clip(size, 1, SAMPLE), 1.0)[owner] * 2.0**64
                flat = []
                for k in range(n_run):
                    chosen = np.flatnonzero(mix(low, 100 + k).astype(np.float64) < chance)
                    flat.append((owner[chosen], mix(low[chosen], 10_000 + k)))
                own, node = (np.concatenate(x) for x in zip(*flat))
                node = node[np.argsort(own, kind="stable")]
                paths = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=b - a)))).astype(np.int32)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), b - a, [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                lists = [pa.ListArray.from_arrays(pa.array(x), pa.array(y.view(np.int64))) for x, y in ((ends, low), (paths, node))]
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns), keys, pa.array(size.astype(np.int32)), *lists], schema.names)

    schema = T.StructType(list(source.schema)).add(names["key"], T.BinaryType()).add(names["n"], T.IntegerType()).add(names["sample"], T.ArrayType(T.LongType())).add(names["nodes"], T.ArrayType(T.LongType()))
    return materialise(source.mapInArrow(lean(run), schema), "sets")


def share(size: np.ndarray) -> np.ndarray:
    """Below what hash a set of ``size`` shingles samples them."""
    return np.where(size <= SAMPLE, ~np.uint64(0), (2.0**64 * np.minimum(SAMPLE / np.maximum(size, 1), 0.999)).astype(np.uint64))


def _leaves(classes: DataFrame, branch: float) -> tuple[DataFrame, DataFrame]:
    """(node, key): the paths at which samples are compared, each set of members once; and (key, root): what crowds a path to the last."""
    rows = classes.select("key", F.explode("nodes").alias("node"))
    done, written = [], []
    for level in range(LEVELS):
        if level:
            big = rows.filter(F.col("members") > BUCKET).select("key", "node")
            more = big.join(classes.select("key", "n", "sample"), "key")
            # xxhash64 is uniform over the longs: below this bound lies the share of them that a path keeps.
            bound = (F.least(F.lit(branch) / F.least("n", F.lit(SAMPLE)), F.lit(1.0)) - 0.5) * 2.0**64
            more = more.withColumn("bound", bound)
            kept = F.filter("sample", lambda x: F.xxhash64(x, "node").cast("double") <= F.col("bound"))
            rows = more.select("key", "node", F.explode(kept).alias("token")).select("key", F.xxhash64("node", "token").alias("node"))
            rows = materialise(rows, "paths")
            written.append(rows)
        counts = materialise(rows.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("least")).filter("members > 1"), "counts")
        rows = materialise(rows.join(counts, "node"), "members")
        written += [counts, rows]
        done.append(rows.filter(F.col("members") <= BUCKET).select("node", "key"))
    crowds = materialise(rows.filter(F.col("members") > BUCKET).select("key", F.col("least").alias("root")), "crowds")
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.union(more)
    # Paths with the same members say the same: the first of them stays.  The sums tell member sets apart.
    h, g = F.xxhash64("key"), F.xxhash64("key", F.lit(1))
    marks = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(h).alias("x"), F.bit_xor(g).alias("y"))
    first = materialise(marks.groupBy("c", "x", "y").agg(F.min("node").alias("node")).select("node"), "first")
    out = materialise(leaves.join(first, "node"), "leaves")
    discard(first, *written)
    return out, crowds


def similar(sizes: np.ndarray, samples: list[np.ndarray]) -> np.ndarray:
    """Square matrix: estimated similarity, by what is left of both samples at the larger set's bound."""
    m, bound = len(samples), share(sizes)
    flat, owner = np.concatenate(samples), np.repeat(np.arange(m), [len(x) for x in samples])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate(([0], (flat[1:] != flat[:-1]).astype(np.int64)))) if len(flat) else flat
    has = np.zeros((m, int(column[-1]) + 1 if len(flat) else 1), np.float32)
    has[owner, column] = 1
    common = has @ has.T
    least = np.minimum(bound[:, None], bound[None, :])
    kept = np.empty((m, m))
    for x, own in enumerate(samples):
        kept[x] = np.searchsorted(own, least[x], "left") if sizes[x] > SAMPLE or (sizes > SAMPLE).any() else len(own)
    return common / np.maximum(kept + kept.T - common, 1)


def _candidates(leaves: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, root): stars of sets that share a path and look alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, group, out = None, [], ([], [])

        def close() -> None:
            if len(group) > 1:
                alike = similar(np.array([g[1] for g in group]), [g[2] for g in group]) >= CUT
                root = spread(alike)
                for x in np.flatnonzero(root != np.arange(len(group))):
                    out[0].append(group[x][0])
                    out[1].append(group[root[x]][0])
            group.clear()

        for batch in batches:
            nodes, keys, sizes = (batch.column(k).to_pylist() for k in range(3))
            lists = batch.column(3)
            flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for r, own in enumerate(nodes):
                if own != node:
                    close()
                    node = own
                group.append((keys[r], sizes[r], np.sort(flat[ends[r] : ends[r + 1]])))
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["key", "root"])
                out = ([], [])
        close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["key", "root"])

    where = leaves.groupBy("key").agg(F.collect_list("node").alias("at"))  # of one set: runs * branch ** levels or so
    rows = where.join(classes.select("key", "n", "sample"), "key").select(F.explode("at").alias("node"), "key", "n", "sample")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(lean(run), "key binary, root binary")


def spread(alike: np.ndarray) -> np.ndarray:
    """Components of a few: the first place that each reaches."""
    root = np.arange(len(alike))
    while True:  # smallest neighbour until nothing changes
        now = np.minimum(root, np.where(alike, root[None, :], len(root)).min(axis=1))
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _deal(texts: DataFrame, side: str) -> DataFrame:
    """(clan, block, key, home, docs, text) of each text that ``side`` knows: each goes out once."""
    names = ("clan", "block", "key", "home", "docs", "text")
    types = (pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Side(side)
        out, held = [], 0
        for batch in batches:
            for r, uid in enumerate(batch.column(1).to_pylist()):
                if (told := beside.of(uid)) is None:
                    continue
                told, text = dict(zip(beside.names, told)), batch.column(0)[r].as_py()
                out.append((told["clan"], told["block"], told["key"], told["home"], told["docs"], text))
                held += len(text) + 200
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return texts.mapInArrow(lean(run), "clan binary, block int, key binary, home int, docs long, text string")


def compare(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Square matrix: which sets are at least ``threshold`` alike (never a set and itself)."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    token, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
    width = np.diff(edge)
    column = np.repeat(np.cumsum(width > 1) - 1, width)
    shared = np.repeat(width > 1, width)
    owner, column = owner[shared], column[shared]
    common = np.zeros((m, m), np.float32)
    total, step = int((width > 1).sum()), max(256, (1 << 21) // m)
    for c in range(0, total, step):  # bounded memory, whatever the number of shingles
        a, b = np.searchsorted(column, (c, c + step))
        dense = np.zeros((m, min(step, total - c)), np.float32)
        dense[owner[a:b], column[a:b] - c] = 1
        common += dense @ dense.T
    alike = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(alike, False)
    return alike


def _links(group: list[tuple], threshold: float, across: bool = False, again: bool = False) -> tuple[list, list, list]:
    """(key, links, root) of each set of ``group`` (key, block, home, docs, shingles) that has links in it.

    ``across``: only between the two blocks; each within itself is another
    comparison.  ``again``: sets of one home block, or of the first, have been
    compared before; their links are not counted twice.
    """
    group.sort(key=lambda g: g[0])
    if len(group) < 2:
        return [], [], []
    alike = compare([g[4] for g in group], threshold)
    if across:
        block = np.array([g[1] for g in group])
        alike &= block[:, None] != block[None, :]
    if not alike.any():
        return [], [], []
    counted, home = alike, np.array([g[2] for g in group])
    if again:
        counted = alike & (home[:, None] != home[None, :]) & (home[:, None] > 0) & (home[None, :] > 0)
    root, at = spread(alike), np.flatnonzero(alike.any(axis=1))
    return [group[x][0] for x in at], (counted @ np.array([g[3] for g in group]))[at].tolist(), [group[root[x]][0] for x in at]


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(key, block, home, docs, shingles) of the rows of a batch of :func:`_deal`."""
    columns = {n: batch.column(n) for n in ("key", "block", "home", "docs")}
    raw, offsets = utf8(batch.column("text"))
    keys, blocks, homes, docs = (c.to_pylist() for c in columns.values())
    for a, b in runs(offsets, CHUNK):
        token, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for r in range(a, b):
            yield keys[r], blocks[r], homes[r], docs[r], token[at[r - a] : at[r - a + 1]].copy()


class _Out:
    """Gathers what :func:`_links` finds."""

    def __init__(self):
        self.columns = ([], [], [])

    def add(self, found: tuple[list, list, list]) -> None:
        for to, values in zip(self.columns, found):
            to.extend(values)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, (pa.binary(), pa.int64(), pa.binary()))], ["key", "links", "root"])
            self.columns = ([], [], [])


_LINKS = "key binary, links long, root binary"


def _verify_whole(rows: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root) of groups of one block, whose rows come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clan, group, out = None, [], _Out()
        for batch in batches:
            clans = batch.column("clan").to_pylist()
            for own, row in zip(clans, _sets_of(batch)):
                if own != clan:
                    out.add(_links(group, threshold))
                    clan, group = own, []
                group.append(row)
            yield from out.batches(10_000)
        out.add(_links(group, threshold))
        yield from out.batches()

    return rows.repartition("clan").sortWithinPartitions("clan").mapInArrow(lean(run), _LINKS)


def _verify_blocks(rows: DataFrame, pairs: DataFrame, threshold: float, again: bool = False) -> DataFrame:
    """(key, links, root) of the comparisons ``pairs`` (clan, i, j) between blocks of ``rows``.

    The blocks' texts are written once, a folder for each; whoever compares two
    blocks reads them there.
    """
    name = F.concat(F.hex("clan"), F.lit("-"), F.col("block"))
    path = new_path(rows.sparkSession, "blocks")
    rows.withColumn("name", name).repartition("name").write.option("compression", "zstd").partitionBy("name").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, folder), out, held = file_system(path), _Out(), {}

        def block(clan: bytes, number: int) -> list[tuple]:
            files = [f.path for f in fs.get_file_info(FileSelector(f"{folder}/name={clan.hex().upper()}-{number}", allow_not_found=True)) if f.path.endswith(".parquet")]
            return [row for batch in dataset(files, filesystem=fs, format="parquet").to_batches() for row in _sets_of(batch)] if files else []

        for batch in batches:
            for clan, i, j in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held = {n: held.get(n) or block(*n) for n in {(clan, i), (clan, j)}}  # two blocks at most
                out.add(_links([row for rows in held.values() for row in rows], threshold, across=i != j, again=again))
                yield from out.batches(10_000)
        yield from out.batches()

    pairs = materialise(pairs, "pairs")
    tasks = max(1, min(pairs.count(), 1 << 14))
    found = materialise(pairs.repartition(tasks, "clan", "i", "j").mapInArrow(lean(run), _LINKS), "links")
    discard(path)
    return found


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, branch: float = BRANCH, exact_links: bool = True) -> DataFrame:
    """``docs`` with class_id, n_links and is_first.

    class_id: the smallest doc_id that a chain of links (Jaccard similarity of
    five-word shingle sets of at least ``threshold``) leads to.  n_links: how
    many other documents the document itself is linked to, copies included.
    For that all blocks of a group are compared; without ``exact_links``, in a
    group of candidates of more than ALL * BLOCK different sets, it counts only the
    links that were looked at to find the classes, which stay the same.
    is_first: true for one document of each class, that with the smallest
    doc_id.  Texts without words (null, empty, blank) are linked to nothing and
    are a class each; texts of one to four words only to texts of the same
    words; null doc_ids come last; repeated rows are copies; an empty table gives
    an empty one.  Columns of ``docs`` that clash with the three new ones are
    replaced.
    """
    docs = docs.drop("class_id", "n_links", "is_first")
    names = {x: unused(x, docs.columns) for x in ("uid", "key", "n", "sample", "nodes", "docs", "links", "head")}
    sets = _sets(docs, text, n_runs(threshold, recall, branch), branch, names)
    uid, key, n = (F.col(names[x]) for x in ("uid", "key", "n"))
    full = sets.filter(n > 0)
    me = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), uid.alias("uid"))
    classes = full.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("docs"), F.min(me).alias("first"), F.first(n).alias("n"), F.first(names["sample"]).alias("sample"), F.first(names["nodes"]).alias("nodes"))
    classes = materialise(classes, "classes")
    leaves, crowds = _leaves(classes, branch)
    candidates = materialise(_candidates(leaves, classes).union(crowds), "candidates")
    groups = connected_components(candidates.select(F.col("key").alias("u"), F.col("root").alias("v")))
    groups = materialise(groups.select(F.col("node").alias("key"), F.col("component").alias("clan")).join(classes.select("key", "docs", "n", F.col("first.uid").alias("uid")), "key"), "groups")
    discard(leaves, crowds, candidates)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    sizes = materialise(groups.groupBy("clan").agg(blocks.alias("blocks")), "sizes")
    home = F.pmod(F.xxhash64("key", F.lit(7)), F.col("blocks").cast("long")).cast("int")
    who = materialise(groups.join(sizes, "clan").withColumn("home", home).withColumn("block", F.col("home")), "who")
    texts = full.select(F.coalesce(F.col(text), F.lit("")).alias("text"), uid.alias("uid"))

    def dealt(rows: DataFrame) -> tuple[DataFrame, str]:
        side = write_side(rows.select("clan", "key", "home", "docs", "block", "uid"), "dealt")
        return _deal(texts, side), side

    rows, side = dealt(who.filter("blocks = 1"))
    links = materialise(_verify_whole(rows, threshold), "links")
    discard(side)
    if not sizes.filter("blocks > 1").isEmpty():  # links may lead from block to block
        rows, side = dealt(who.filter("blocks > 1"))
        large = sizes.filter("blocks > 1").withColumn("all", F.lit(exact_links) | (F.col("blocks") <= ALL))
        i = large.select("clan", "blocks", "all", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
        j = F.when(F.col("all") | (F.col("i") == 0), F.sequence("i", F.col("blocks") - 1)).otherwise(F.array("i"))
        found = _verify_blocks(rows, i.select("clan", "i", F.explode(j).alias("j")), threshold)
        discard(side)
        edges = found.select(F.col("key").alias("u"), F.col("root").alias("v"))
        chains = connected_components(edges)
        if not exact_links and not sizes.filter(F.col("blocks") > ALL).isEmpty():
            outer, pairs = _rest(who.filter(F.col("blocks") > ALL), chains)
            rows, side = dealt(outer)
            rest = _verify_blocks(rows, pairs, threshold, again=True)
            discard(side)
            found = found.union(rest)
            chains = connected_components(edges.union(rest.select(F.col("key").alias("u"), F.col("root").alias("v"))))
        links = links.union(found.join(chains.withColumnRenamed("node", "key"), "key", "left").select("key", "links", F.coalesce("component", "root").alias("root")))
    links = links.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("component"))
    known = classes.select("key", "docs", "first").join(links, "key", "left").select("key", "docs", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    known = materialise(known, "known")
    heads = known.groupBy("component").agg(F.min("first").alias("head"))
    known = known.join(heads, "component").select(F.col("key").alias(names["key"]), F.col("docs").alias(names["docs"]), F.col("links").alias(names["links"]), F.col("head").alias(names["head"]))
    out = sets.drop(names["sample"], names["nodes"]).join(known, names["key"], "left")
    own, head = n == 0, F.col(names["head"])
    return out.select(
        *docs.columns,
        F.when(own, F.col(doc_id)).otherwise(head["id"]).alias("class_id"),
        F.when(own, F.lit(0)).otherwise(F.col(names["docs"]) - 1 + F.col(names["links"])).cast("long").alias("n_links"),
        (own | (head["uid"] == uid)).alias("is_first"),
    )


def _rest(who: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is still to be compared in large groups: the sets that are not in their group's main class, with all others of the group.

    (the sets with their blocks, the pairs of blocks).  Blocks of the sets
    outside have the numbers from ``blocks`` on, and are compared with each other
    and with the blocks of the rest.
    """
    state = materialise(who.join(chains.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")), "state")
    main = state.groupBy("clan", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("clan").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    state = state.join(materialise(main, "main"), "clan").withColumn("out", F.col("component") != F.col("main"))
    outside = materialise(state.filter("out").groupBy("clan", "blocks").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("outer")), "outer")
    state = state.join(outside.drop("blocks"), "clan")
    own = F.col("blocks") + F.pmod(F.xxhash64("key", F.lit(8)), F.col("outer").cast("long")).cast("int")
    placed = materialise(state.withColumn("block", F.when(F.col("out"), own).otherwise(F.col("home"))), "placed")
    i = outside.select("clan", "blocks", "outer", F.explode(F.sequence("blocks", F.col("blocks") + F.col("outer") - 1)).alias("i"))
    j = F.concat(F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence("i", F.col("blocks") + F.col("outer") - 1))
    return placed, i.select("clan", "i", F.explode(j).alias("j"))
