"""Exact removal of byte strings that an earlier document has, by longest-previous-factor arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts in a
document with a smaller id.  A suffix array over everything is out of reach, so
the work is dealt out without losing a match:

1.  Anchors.  Of the K-byte strings inside every LENGTH-byte window the one with
    the smallest hash is its anchor (winnowing).  Equal windows have equal
    anchors.  Anchor hashes are dealt to buckets to find those of two documents
    or more.
2.  Contexts.  Around a repeated anchor, the windows that it is the anchor of are
    one piece of text, the anchor's context.  Different contexts of one anchor
    meet in one shard, each once, with the smallest document that has it.
3.  Suffix arrays.  In a shard the suffixes are sorted and their common prefixes
    taken; from the previous and next suffix of a smaller document in that order
    comes each suffix's longest previous factor.  Where it is LENGTH or more, the
    window has an earlier match.
4.  The findings return to the documents, whose bytes are cut.

The text itself is written once and never shuffled: what concerns a document is
written to a small side file for the partition of the text that holds it.
An anchor that very many documents share would make a crowded shard: its windows
are dealt out one by one, by their own hash.  Anchors and contexts are told apart
by hashes: those of anchors only send more to step 2 than need be; two different
contexts count as equal if they have the same 64-bit hash, of which one pair is to
be expected among some 6e9 different contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, Side, discard, lean, materialise, mix, runs, unused, utf8, write_side

LENGTH, K = 50, 16
CHUNK = 1 << 19
#: Bytes of text for each bucket of anchors, shards for each bucket; an anchor in more than a CROWD-th of all anchors (5000 at least) is crowded, so at most CROWD are, and their hashes can be broadcast.
SHARE, SHARDS, CROWD = 64 << 20, 8, 2_000_000
#: Partitions at most that buckets and shards are dealt to; each task takes its own one after the other.
PARTITIONS = 1 << 16
LOW = np.uint64((1 << 40) - 1)


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` neighbours."""
    n = 1
    out = x
    while 2 * n <= width:
        out, n = op(out[:-n], out[n:]), 2 * n
    return op(out[: len(out) - (width - n)], out[width - n :]) if width > n else out


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes) of all anchors, and (start, position of its anchor) of all windows; no window crosses texts."""
    width = length - k + 1
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, np.zeros(0, np.uint64), none, none
    h = mix(Rolling(raw).grams(k), 9) | np.uint64(1)
    low = slide(h, width, np.minimum)
    inside = np.zeros(len(low), bool)
    size = np.diff(offsets)
    for a, b in zip(offsets[:-1][size >= length], offsets[1:][size >= length]):
        inside[a : b - length + 1] = True
    low[~inside] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(slide(np.concatenate((edge, low, edge)), width, np.maximum) == h)
    start = np.flatnonzero(inside)
    pick = np.searchsorted(at, start)
    wrong = np.flatnonzero(h[at[pick]] != low[start])
    while len(wrong):  # the first anchor at or after the start that has the window's smallest hash
        pick[wrong] += 1
        wrong = wrong[h[at[pick[wrong]]] != low[start[wrong]]]
    return at, h[at], start, at[pick]


# --------------------------------------------------------------------------- suffix arrays


def nearest_smaller(doc: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the nearest earlier place with a smaller ``doc`` (-1: none), and the smallest ``gap`` on the way; gap[i] lies between i - 1 and i."""
    n = len(doc)
    to, least = np.arange(n) - 1, gap.copy()
    bad = np.flatnonzero((to >= 0) & (doc[np.maximum(to, 0)] >= doc))
    while len(bad):  # jumps: what lies between a place and its target is never smaller
        mid = to[bad]
        least[bad] = np.minimum(least[bad], least[mid])
        to[bad] = to[mid]
        bad = bad[(to[bad] >= 0) & (doc[np.maximum(to[bad], 0)] >= doc[bad])]
    return to, np.where(to >= 0, least, 0)


def longest_previous(raw: np.ndarray, starts: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of the suffix at each of ``starts``: the longest prefix, up to ``length``, that a suffix of a smaller ``doc`` shares."""
    if len(starts) < 2:
        return np.zeros(len(starts), np.int64)
    text = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(length, np.uint8))), length)[starts]
    order = np.argsort(np.ascontiguousarray(text).view(f"S{length}").ravel(), kind="stable")
    text, doc = text[order], doc[order]
    equal = text[1:] == text[:-1]
    lcp = np.concatenate(([0], np.where(equal.all(axis=1), length, equal.argmin(axis=1))))
    _, before = nearest_smaller(doc, lcp)
    _, after = nearest_smaller(doc[::-1], np.concatenate(([0], lcp[:0:-1])))
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def resolve(raw: np.ndarray, sizes: np.ndarray, first: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context (``sizes`` bytes of ``raw``, in document ``first``): the windows, by their start in it, that a smaller document has."""
    end = np.cumsum(sizes)
    begin = end - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    starts = np.arange(len(owner)) + np.repeat((length - 1) * np.arange(len(sizes)), sizes - length + 1)
    gram = mix(Rolling(raw).grams(length), 11)[starts]
    _, back, count = np.unique(gram, return_inverse=True, return_counts=True)
    more = np.flatnonzero(count[back] > 1)  # a window with no equal has no factor of its length
    hit = more[longest_previous(raw, starts[more], first[owner[more]], length) >= length]
    cut = np.searchsorted(owner[hit], np.arange(len(sizes) + 1))
    return [starts[hit[a:b]] - begin[i] for i, (a, b) in enumerate(zip(cut, cut[1:]))]


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[a, b) of the runs of consecutive numbers in sorted ``starts``."""
    if not len(starts):
        return starts, starts
    jump = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate(([0], jump + 1))], starts[np.concatenate((jump, [len(starts) - 1]))] + 1


# --------------------------------------------------------------------------- stages


def _pack40(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _by(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    if len(key):
        edge = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))):
            yield int(key[a]), slice(a, b)


def _entries(texts: DataFrame, buckets: int) -> DataFrame:
    """Anchors dealt to buckets: an anchor that several documents of a batch have goes once, and those documents are told at once (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            key = batch.column(1).to_numpy().view(np.uint64)
            _, one = np.unique(key, return_index=True)
            alone = np.zeros(len(key), bool)
            alone[one] = True  # of copies in a batch the first speaks
            row, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for a, b in runs(offsets, CHUNK):
                here = offsets[a : b + 1] - offsets[a]
                at, hashes, _, _ = anchors(raw[offsets[a] : offsets[b]], here)
                own = np.searchsorted(here, at, "right") - 1 + a
                use = alone[own]
                row.append(own[use])
                h.append(hashes[use])
            row, h = np.concatenate(row), np.concatenate(h)
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, h = row[new], h[new]
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            docs = np.diff(np.concatenate((head, [len(h)])))
            out = ([], [], [], [], [])

            def put(bucket, doc, each, payload, n):
                for to, value in zip(out, (bucket, doc.tobytes(), each.astype("<u4").tobytes(), payload, n)):
                    to.append(value)

            told = np.flatnonzero(np.repeat(docs > 1, docs))
            told = told[np.argsort(row[told], kind="stable")]
            if len(told):
                rows, each = np.unique(row[told], return_counts=True)
                put(-1, key[rows], each, _pack40(h[told] & LOW), b"")
            bucket = (h[head] >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((row[head], bucket))
            for b, part in _by(bucket[order]):
                sent = head[order[part]]
                rows, each = np.unique(row[sent], return_counts=True)
                put(b, key[rows], each, _pack40(h[sent] & LOW), np.minimum(docs[order[part]], 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["bucket", "docs", "each", "payload", "n"])

    return texts.mapInArrow(lean(run), "bucket int, docs binary, each binary, payload binary, n binary")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, rows) of input that is sorted by its first column."""
    held, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and row[0] != held:
                yield held, group
                group = []
            held = row[0]
            group.append(row[1:])
    if group:
        yield held, group


def _repeated(entries: DataFrame, crowd: int, buckets: int = 12) -> DataFrame:
    """(doc, payload) of anchors that documents share, doc null: of the crowded ones."""

    def rows(doc: np.ndarray, each: np.ndarray, payload: bytes) -> list[tuple]:
        end = np.cumsum(each) * 5
        return [(d, payload[e - 5 * n : e]) for d, e, n in zip(doc.view(np.int64).tolist(), end.tolist(), each.tolist())]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], ["doc", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches):
            docs = [np.frombuffer(g[0], "<u8") for g in group]
            each = [np.frombuffer(g[1], "<u4") for g in group]
            h = np.concatenate([_unpack40(g[2]) for g in group])
            n = np.concatenate([np.frombuffer(g[3], "<u2") for g in group]).astype(np.int64)
            doc = np.repeat(np.concatenate(docs), np.concatenate(each))
            order = np.argsort(h, kind="stable")
            h, doc, n = h[order], doc[order], n[order]
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate((head, [len(h)])))
            total = np.add.reduceat(n, head) if len(h) else n
            crowded = total > crowd
            if crowded.any():
                yield batch_of([(None, _pack40(h[head[crowded]]))])
            low, high = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
            keep = np.repeat((size > 1) & ((low != high) | (total > size)), size) & (n == 1)  # those of n > 1 know already
            h, doc = h[keep], doc[keep]
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
            who, each_of = np.unique(doc, return_counts=True)
            found = rows(who, each_of, _pack40(h))
            for k in range(0, len(found), 20_000):
                yield batch_of(found[k : k + 20_000])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, each, payload in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                yield batch_of(rows(np.frombuffer(doc, "<u8"), np.frombuffer(each, "<u4"), payload))

    schema = "doc long, payload binary"
    dealt = entries.filter("bucket >= 0").repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), schema)
    return dealt.union(entries.filter("bucket = -1").mapInArrow(lean(direct), schema))


def _contexts(texts: DataFrame, side: str, crowded, buckets: int) -> DataFrame:
    """Contexts packed for their shards (bucket >= 0), and which contexts each document has, where (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside, pack = Side(side), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            uid, doc_id = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            seen: dict[str, list] = {k: [] for k in ("row", "start", "n", "cid", "route")}
            for a, b in runs(offsets, CHUNK):
                told = [(r, x[0]) for r in range(a, b) if (x := beside.of(int(uid[r]))) is not None]
                if not told:
                    continue
                known = np.concatenate([_unpack40(x) | np.uint64(r - a) << np.uint64(40) for r, x in told])
                here, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
                at, h, start, to = anchors(part, here)
                own = np.searchsorted(here, at, "right") - 1
                hit = np.isin((h & LOW) | own.astype(np.uint64) << np.uint64(40), known)
                many = np.isin(h & LOW, crowded.value) & hit
                which = np.searchsorted(at, to)
                use = hit[which]
                start, which = start[use], which[use]
                new = np.ones(len(start), bool)
                new[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1) | many[which[1:]]
                head = np.flatnonzero(new)
                n = np.diff(np.concatenate((head, [len(start)])))
                begin, which = start[head], which[head]
                cid = mix(Rolling(part).spans(begin, begin + n + LENGTH - 1), 12)
                seen["row"].append(own[which] + a)
                seen["start"].append(begin + offsets[a])
                seen["n"].append(n)
                seen["cid"].append(cid)
                seen["route"].append(np.where(many[which], cid, h[which]))
            if not seen["row"]:
                continue
            row, start, n, cid, route = (np.concatenate(seen[k]) for k in seen)
            order = np.lexsort((doc_id[row], cid))  # of equal contexts that of the smallest document goes
            head = order[np.flatnonzero(np.concatenate(([True], np.diff(cid[order]) != 0)))]
            several = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], np.diff(cid[order]) != 0))), [len(order)]))) > 1
            bucket = mix(route[head], 13) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            out = ([], [], [], [], [], [])
            for k, part in _by(bucket[by]):
                sent = head[by[part]]
                size = n[sent] + LENGTH - 1
                index = np.repeat(start[sent] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
                data = doc_id[row[sent]].astype("<i8").tobytes() + n[sent].astype("<u4").tobytes() + several[by[part]].astype(np.uint8).tobytes() + raw[index].tobytes()
                for to, value in zip(out, (k, len(sent).to_bytes(4, "little") + pack.compress(data), None, None, None, None)):
                    to.append(value)
            order = np.argsort(row, kind="stable")
            for r, part in _by(row[order]):
                mine = order[part]
                for to, value in zip(out, (-1, None, int(uid[r]), int(doc_id[r]), cid[mine].view(np.int64), (start[mine] - offsets[r]).astype(np.int32))):
                    to.append(value)
            types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["bucket", "blob", "uid", "doc_id", "cids", "at"])

    return texts.mapInArrow(lean(run), "bucket int, blob binary, uid long, doc_id long, cids array<bigint>, at array<int>")


def _shards(contexts: DataFrame, shards: int) -> DataFrame:
    """(cid, first, n, a, b): a context of n windows, the smallest document that has it, and runs of windows that still smaller ones have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for _, group in _grouped(batches):
            first, n, several, text = [], [], [], []
            for (blob,) in group:
                count, data = int.from_bytes(blob[:4], "little"), unpack.decompress(blob[4:])
                first.append(np.frombuffer(data, "<i8", count))
                n.append(np.frombuffer(data, "<u4", count, 8 * count))
                several.append(np.frombuffer(data, np.uint8, count, 12 * count))
                text.append(np.frombuffer(data, np.uint8, -1, 13 * count))
            first, n, several, raw = np.concatenate(first), np.concatenate(n).astype(np.int64), np.concatenate(several), np.concatenate(text)
            size = n + LENGTH - 1
            begin = np.cumsum(size) - size
            cid = mix(Rolling(raw).spans(begin, begin + size), 12)
            order = np.lexsort((first, cid))
            head = np.flatnonzero(np.concatenate(([True], np.diff(cid[order]) != 0)))
            shared = np.add.reduceat(several[order].astype(np.int64) + 1, head) > 1
            one = order[head]
            by = np.argsort(first[one], kind="stable")  # documents in order: an earlier place is an earlier document
            one, shared = one[by], shared[by]
            length = size[one]
            index = np.repeat(begin[one] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            found = resolve(raw[index], length, first[one])
            keep = [k for k, x in enumerate(found) if shared[k] or len(x)]
            for k in range(0, len(keep), 20_000):
                some = keep[k : k + 20_000]
                runs_of = [spans(found[x]) for x in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[one[some]].view(np.int64)), pa.array(first[one[some]]), pa.array(n[one[some]].astype(np.int32)), pa.array([x[0].astype(np.int32) for x in runs_of], pa.list_(pa.int32())), pa.array([x[1].astype(np.int32) for x in runs_of], pa.list_(pa.int32()))],
                    ["cid", "first", "n", "a", "b"],
                )

    sorted_rows = contexts.select("bucket", "blob").repartition(min(shards, PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return sorted_rows.mapInArrow(lean(run), "cid long, first long, n int, a array<int>, b array<int>")


def covered(a: np.ndarray, b: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs under windows that start in the runs [a, b)."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(zip(a, b)):
        y += length - 1
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def _cut(texts: DataFrame, columns: list[str], side: str) -> DataFrame:
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Side(side)
        for batch in batches:
            raw, offsets = utf8(batch.column(width))
            uid, data = batch.column(width + 1).to_numpy(), raw.tobytes()
            kept, removed, count, digest = [], [], [], []
            for r, (s, e) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                gone, found = [], beside.of(int(uid[r]))
                if found is not None:
                    copy, a, b = found
                    gone = ([(0, e - s)] if e - s >= LENGTH else []) if copy else covered(a, b)
                left, parts = 0, []
                for x, y in gone:
                    parts.append(data[s + left : s + x])
                    left = y
                parts.append(data[s + left : e])
                parts = b"".join(parts)
                kept.append(parts)
                removed.append(e - s - len(parts))
                count.append(len(gone))
                digest.append(hashlib.sha256(parts).hexdigest())
            new = [pa.array(kept, pa.binary()), pa.array([x.decode(errors="ignore") for x in kept], pa.string()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], [*columns, *NEW])

    schema = T.StructType(list(texts.schema)[:width])
    for name, kind in zip(NEW, (T.BinaryType(), T.StringType(), T.LongType(), T.LongType(), T.LongType(), T.StringType())):
        schema = schema.add(name, kind)
    return texts.mapInArrow(lean(run), schema)


NEW = ("kept", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with kept (the remaining bytes), kept_text (the same without the halves of characters that were cut in two), n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.

    Null texts are empty; texts of fewer than 50 bytes and what repeats only
    inside one document stay whole.  Documents of equal id are not earlier than
    one another, so repeated rows keep what no smaller id has; a null doc_id
    comes after all others.  An empty table gives an empty one.  Columns of
    ``docs`` that clash with the new ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*NEW)
    columns = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))
    names = [unused(x, columns) for x in ("uid", "doc", "sha", "size")]
    own = (F.monotonically_increasing_id(), number, F.unhex(F.sha2(body, 256)), F.octet_length(body).cast("long"))
    stored = materialise(docs.select(*columns, *(c.alias(n) for c, n in zip(own, names))), "texts")
    texts = stored.select(body.alias("__text"), *(F.col(n).alias(x) for n, x in zip(names, ("__uid", "__doc", "__sha", "__size"))))
    total = texts.agg(F.sum("__size")).first()[0] or 0
    buckets = max(12, -(-total // SHARE))
    short = F.conv(F.substring(F.hex("__sha"), 1, 15), 16, 10).cast("long")
    entries = materialise(_entries(texts.select("__text", short.alias("doc")), buckets), "anchors")
    repeated = materialise(_repeated(entries, max(5_000, total // K // CROWD), buckets), "repeated")
    discard(entries)
    crowded = [_unpack40(bytes(r["payload"])) for r in repeated.filter("doc IS NULL").select("payload").collect()]  # at most CROWD of 5 bytes
    crowded = spark.sparkContext.broadcast(np.unique(np.concatenate(crowded)) if crowded else np.zeros(0, np.uint64))
    light = texts.select("__sha", short.alias("doc"), F.col("__uid").alias("uid"), F.col("__doc").alias("id"))
    firsts = materialise(light.groupBy("__sha", "doc").agg(F.min(F.struct("id", "uid")).alias("first")), "firsts")  # written, so that a join of many copies is plain and can be split
    told = repeated.filter("doc IS NOT NULL").groupBy("doc").agg(F.collect_list("payload").alias("p"))  # of one text: as long as it is
    told = told.select("doc", F.unhex(F.array_join(F.transform("p", F.hex), "")).alias("payload"))
    side = write_side(told.join(firsts, "doc").select("payload", F.col("first.uid").alias("uid")), "told")
    discard(repeated)
    contexts = materialise(_contexts(texts.select("__text", "__uid", "__doc"), side, crowded, SHARDS * buckets), "contexts")
    discard(side)
    found = materialise(_shards(contexts.filter("bucket >= 0"), SHARDS * buckets), "factors")
    has = contexts.filter("bucket = -1").select("uid", "doc_id", F.explode(F.arrays_zip("cids", "at")).alias("x")).select("uid", "doc_id", F.col("x.cids").alias("cid"), F.col("x.at").alias("at"))
    hit = has.join(found, "cid")
    whole = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")))
    some = F.transform(F.arrays_zip("a", "b"), lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["b"] + F.col("at")).alias("b")))
    hit = hit.select("uid", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(some).alias("r")).filter(F.size("r") > 0)
    hit = hit.groupBy("uid").agg(F.flatten(F.collect_list("r")).alias("r")).select("uid", F.lit(False).alias("copy"), F.col("r.a").alias("a"), F.col("r.b").alias("b"))
    hit = materialise(hit, "cuts")
    discard(contexts, found)
    copies = light.join(firsts, ["__sha", "doc"])
    none = F.array().cast("array<int>")
    later = copies.filter(F.col("id") > F.col("first.id")).select("uid", F.lit(True).alias("copy"), none.alias("a"), none.alias("b"))
    same = copies.filter((F.col("id") == F.col("first.id")) & (F.col("uid") != F.col("first.uid"))).select("uid", F.col("first.uid").alias("as"))
    same = same.join(hit.withColumnRenamed("uid", "as"), "as").select("uid", "copy", "a", "b")
    return _cut(stored.select(*columns, body.alias(unused("body", stored.columns)), names[0]), columns, write_side(hit.union(same).union(later), "cuts"))
