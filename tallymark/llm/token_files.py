"""Token ids on disk: canonical length-limited Huffman codes, in blocks that can be read on their own.

A store is a folder with a manifest and shards.  The manifest (JSON) holds the
length of every id's code, from which the canonical codes follow, and the shards
in the order of their documents with what each holds.  A shard is

    header       magic, number of documents, ids, blocks, and where the parts begin (little-endian 64-bit)
    bits         the codes, most significant bit first; nothing between blocks
    checkpoints  the bit at which each block of BLOCK ids begins, and the end
    documents    where each document's ids begin in the shard, and the end
    keys         the documents' ids, one nullable 64-bit column in an Arrow stream

so any block can be decoded from its checkpoint alone, and all blocks of a run
are decoded side by side: one table lookup gives the next id of each.

Writers put shards under names of their own and only the manifest, written last,
says which of them count, so a task that runs twice leaves nothing but a file
that nobody reads.
"""

from __future__ import annotations

import functools
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, lean, materialise, new_path, runs, utf8
from .token_counts import CACHED_CHARS, LONG, Counter, Rules

MAGIC, HEADER = b"TMTOKEN1", 8 + 8 * 6
#: Ids in a block; blocks that are decoded side by side; the longest code, in bits (longer if there are too many ids).
BLOCK, SIDE, LONGEST = 512, 8192, 18
#: Bytes of text, about, whose ids go out in one batch; remembered pre-tokens, at most.
BYTES, PIECES = 16 << 20, 800_000
#: Ids that a writer gathers before it appends their bits to its shard.
FLUSH = 1 << 16


# --------------------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The lengths of an optimal prefix code of no more than ``longest`` bits, 0 for what never occurs (package-merge).

    With one id in use its code has one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    weights, levels = coins, []  # a level: which of its items, by weight, are coins (the others are packages of two of the level before)
    is_coin = np.ones(len(coins), bool)
    for _ in range(longest - 1):
        levels.append(is_coin)
        half = len(weights) // 2
        packages = weights[: 2 * half].reshape(half, 2).sum(axis=1)
        both = np.concatenate((coins, packages))
        place = np.argsort(both, kind="stable")
        weights, is_coin = both[place], place < len(coins)
    levels.append(is_coin)
    take, depth = 2 * len(coins) - 2, np.zeros(len(coins), np.int64)
    for is_coin in reversed(levels):
        bought = int(is_coin[:take].sum())
        depth[:bought] += 1
        take = 2 * (take - bought)
    lengths[order] = depth
    return lengths


@dataclass
class Codes:
    """The canonical codes of lengths: shorter ones first, ids of one length in ascending order."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        used = np.flatnonzero(self.lengths)
        self.order = used[np.argsort(self.lengths[used], kind="stable")]
        self.longest = int(self.lengths.max(initial=1))
        width = self.lengths[self.order].astype(np.int64)
        room = np.int64(1) << (self.longest - width)  # of all codes of the longest length, those that begin with this one
        first = np.cumsum(room) - room
        self.codes = np.zeros(len(self.lengths), np.uint32)
        self.codes[self.order] = first >> (self.longest - width)

    @functools.cached_property
    def table(self) -> np.ndarray:
        """For each run of ``longest`` bits the id whose code it begins with, times 64, plus the length of that code."""
        width = self.lengths[self.order].astype(np.int64)
        entries = np.repeat(self.order.astype(np.uint32) * 64 + width.astype(np.uint32), np.int64(1) << (self.longest - width))
        return np.concatenate((entries, np.full((1 << self.longest) - len(entries), 1, np.uint32)))  # bits that no writer writes


def pack(ids: np.ndarray, codes: Codes, spare: int, used: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bytes, bit at which each code ends, bits used of the last byte); ``spare`` is the byte begun, with ``used`` bits."""
    width = codes.lengths[ids].astype(np.int64)
    end = np.cumsum(width) + used
    start = end - width
    total = int(end[-1])
    out = np.zeros(total // 64 + 2, np.uint64)
    word, code = start >> 6, codes.codes[ids].astype(np.uint64)
    over = (start & 63) + width - 64  # bits that belong to the next word
    shifted = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[first]] = np.bitwise_or.reduceat(shifted, first)
    out[0] |= np.uint64(spare) << np.uint64(56)
    cut = np.flatnonzero(over > 0)  # at most one at the end of each word
    out[word[cut] + 1] |= code[cut] << (64 - over[cut]).astype(np.uint64)
    return out.byteswap().view(np.uint8)[: total // 8 + 1], end, total & 7


def unpack(bits: np.ndarray, begin: np.ndarray, count: np.ndarray, codes: Codes) -> np.ndarray:
    """The ids of blocks, decoded side by side: block i begins at bit ``begin[i]`` of ``bits`` and holds ``count[i]`` ids (all but the last equally many)."""
    words = np.concatenate((bits, np.zeros(16 - len(bits) % 8, np.uint8))).view(">u8").astype(np.uint64)
    at, out = begin.astype(np.int64).copy(), np.zeros((int(count.max(initial=0)), len(begin)), np.uint32)
    table, shift, one = codes.table, np.uint64(64 - codes.longest), np.uint64(1)
    for k in range(len(out)):
        p = at if k < count[-1] else at[:-1]
        word, off = p >> 6, (p & 63).astype(np.uint64)
        found = table[((words[word] << off) | ((words[word + 1] >> one) >> (np.uint64(63) - off))) >> shift]
        out[k, : len(p)] = found >> 6
        p += found & 63  # a view of ``at``
    return out.T.ravel()[: int(count.sum())]


# --------------------------------------------------------------------------- ids


#: Where the pieces of a text can't be told from the parts between its spaces: white space before a space that doesn't end it.
_TANGLED = re.compile(r" (?<=\s )(?:\s|\Z)")


class Ids(Counter):
    """pre-token -> its ids as little-endian bytes; merges what it has not seen.

    A space always begins a pre-token if what follows is no white space, so most
    texts are cut at their spaces, and of all the parts in a batch of texts each
    different one is looked up once.
    """

    def __init__(self, rules: IdRules):
        super().__init__(rules)
        self.clear()  # the parent's entries are numbers of tokens
        self.width, self.room = rules.width, PIECES
        self.known = {t: i.to_bytes(self.width, "little") for t, i in rules.ids.items()}

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join([t.id.to_bytes(self.width, "little") for t in self.merge(piece.encode().decode("latin-1").translate(self.alphabet))])
        if self.room and len(piece) <= CACHED_CHARS:
            self[piece] = ids
            self.room -= 1
        return ids

    def plain(self, text: str) -> bytes:
        """Of a text in which no special string is marked, piece by piece."""
        pieces = self.cut.findall(text) if len(text) <= LONG else (m.group() for m in self.cut.finditer(text))
        return b"".join(map(self.__getitem__, pieces))

    def marked(self, text: str) -> bytes:
        out, at = [], 0
        for mark in self.special.finditer(text):
            out += [self.plain(text[at : mark.start()]), self.known[mark.group()]]
            at = mark.end()
        return b"".join([*out, self.plain(text[at:])])

    def of(self, texts: pa.Array, end: bytes) -> pa.Array:
        """The ids of each text, ``end`` appended, as one binary value each."""
        whole, heads = texts.to_pylist(), []
        for i, text in enumerate(whole):
            if self.special is not None and self.special.search(text):
                heads.append(self.marked(text))
            elif _TANGLED.search(text):
                heads.append(self.plain(text))
            else:
                heads.append(self.plain(text.partition(" ")[0]))
                continue
            whole[i] = ""
        cut = pc.split_pattern(pa.array(whole, pa.large_string()), " ")
        first = cut.offsets.to_numpy()
        coded = cut.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first = first - first[0]
        stock, length = self.after_spaces(coded.dictionary.to_pylist())
        n = len(length)
        stock = np.concatenate((stock, np.frombuffer(b"".join([*heads, end]), f"<u{self.width}")))
        length = np.concatenate((length, np.fromiter(map(len, [*heads, end]), np.int32, len(heads) + 1) // self.width))
        index = coded.indices.to_numpy().copy()
        index[first[:-1]] = n + np.arange(len(heads))  # what stands before the first space, or the whole text
        index = np.insert(index, first[1:], len(length) - 1)
        at = np.cumsum(length, dtype=np.int32) - length
        n = length[index]
        ends = np.cumsum(n, dtype=np.int32)
        ids = stock[np.repeat(at[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        offsets = np.concatenate(([0], ends[first[1:] + np.arange(len(heads))])).astype(np.int64) * self.width
        return pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())]).cast(pa.binary())

    def after_spaces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that stand behind a space, each with that space, and how many each has."""
        joined = " " + " ".join(parts) if parts else ""
        if _TANGLED.search(joined):  # parts that begin or end with other white space have met
            ids = [self.plain(f" {part}") for part in parts]
            return np.frombuffer(b"".join(ids), f"<u{self.width}"), np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        pieces = self.cut.findall(joined)
        ids = list(map(self.__getitem__, pieces))
        length = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        place = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        total = np.concatenate(([0], np.cumsum(length, dtype=np.int32)))
        return np.frombuffer(b"".join(ids), f"<u{self.width}"), np.diff(total[np.concatenate(([0], np.searchsorted(place, ends) + 1))]).astype(np.int32)


class IdRules(Rules):
    """What encoding needs of a tokenizer file, beside what counting needs; ``width``: bytes of an id."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.width = 2 if max([*spec["model"]["vocab"].values(), *self.ids.values()]) < 1 << 16 else 4

    @functools.cached_property
    def encoder(self) -> Ids:
        """One for each worker process."""
        return Ids(self)


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 2) -> tuple[DataFrame, int]:
    """(doc_id long, ids binary) of every text, ``end`` appended, and how many bytes an id has (little-endian).

    A null text counts as empty; special strings in a text are one id each, as
    the library has it by default; texts may be of any length.
    """
    own = IdRules(path or public_tokenizers.path("byte_bpe_50k.json"))
    rules, last = docs.sparkSession.sparkContext.broadcast(own), end.to_bytes(own.width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rules.value.encoder
        for batch in batches:
            _, at = utf8(batch.column(1))
            for a, b in runs(at, BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], encoder.of(batch.column(1)[a:b], last)], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(lean(run), "doc_id long, ids binary"), own.width


def count_ids(encoded: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs in the whole table: each task adds up its own, and a number for each id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(utf8(batch.column(0))[0].view(f"<u{width}"))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    found = encoded.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


# --------------------------------------------------------------------------- shards


class ShardWriter:
    """Appends documents to one shard; holds FLUSH ids and eight bytes for each block and document."""

    def __init__(self, out, codes: Codes):
        self.out, self.codes = out, codes
        self.spare, self.used, self.bits, self.ids = 0, 0, 0, 0
        self.checkpoints, self.starts, self.keys = [], [], []
        self.waiting, self.held = [], 0
        out.write(b"\0" * HEADER)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.starts.append(self.ids + self.held)
        for a in range(0, len(ids), FLUSH):
            self.waiting.append(ids[a : a + FLUSH])
            self.held += len(self.waiting[-1])
            if self.held >= FLUSH:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.waiting)
        data, end, used = pack(ids, self.codes, self.spare, self.used)
        base = self.bits - self.used  # bits before the byte begun
        first = -self.ids % BLOCK  # the first id here that begins a block
        starts = np.concatenate(([self.used], end[:-1]))
        self.checkpoints.append(base + starts[first::BLOCK])
        self.out.write(data[:-1].tobytes())
        self.spare, self.used, self.bits = int(data[-1]), used, base + int(end[-1])
        self.ids += len(ids)
        self.waiting, self.held = [], 0

    def close(self) -> tuple[bytes, int]:
        """(the header, to be put in front; number of ids)."""
        self.flush()
        self.out.write(bytes([self.spare]))
        checkpoints = np.concatenate([*self.checkpoints, [self.bits]]).astype("<u8")
        starts = np.array([*self.starts, self.ids], "<u8")
        at = HEADER + self.bits // 8 + 1
        self.out.write(checkpoints.tobytes())
        self.out.write(starts.tobytes())
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(self.keys, pa.int64())], ["key"])
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        self.out.write(sink.getvalue())
        header = MAGIC + np.array([len(self.keys), self.ids, len(checkpoints) - 1, at, at + checkpoints.nbytes, at + checkpoints.nbytes + starts.nbytes], "<u8").tobytes()
        return header, self.ids


def write(encoded: DataFrame, path: str, width: int = 4) -> None:
    """Writes a store of (doc_id, ids of ``width`` bytes) to the folder ``path``, in ascending order of doc_id.

    A null doc_id comes first; rows alike in doc_id go by a hash of their ids,
    and copies in all of that may lie in several shards.  An empty table gives a
    store without shards.  ``encoded`` is read twice, so it should be a written table.
    """
    spark = encoded.sparkSession
    lengths = code_lengths(count_ids(encoded, width))
    shared = spark.sparkContext.broadcast(lengths)
    order = ("doc_id", "h", "u")
    ranged = encoded.withColumn("h", F.xxhash64("ids")).withColumn("u", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        part, name, body = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids", None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if body is None:
                    fs.create_dir(folder, recursive=True)
                    body = fs.open_output_stream(f"{folder}/{name}.body")
                    writer = ShardWriter(body, Codes(shared.value))
                writer.add(key, np.frombuffer(ids.as_buffer(), f"<u{width}"))
        if body is not None:
            header, n = writer.close()
            body.close()
            with fs.open_output_stream(f"{folder}/{name}") as out, fs.open_input_stream(f"{folder}/{name}.body") as body:
                out.write(header)
                body.read(HEADER)
                while data := body.read(1 << 22):
                    out.write(data)
            fs.delete_file(f"{folder}/{name}.body")
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(writer.keys)], "ids": [n]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    shards = sorted(ranged.mapInArrow(lean(run), "part int, name string, docs long, ids long").collect())  # a row for each task
    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)
    manifest = {"block": BLOCK, "lengths": lengths.tolist(), "shards": [{"name": s["name"], "docs": s["docs"], "ids": s["ids"]} for s in shards]}
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())


class Shard:
    """Reads one shard: any run of its ids, from the checkpoint before it."""

    def __init__(self, fs, path: str, codes: Codes, block: int = BLOCK):
        self.file, self.codes, self.block = fs.open_input_file(path), codes, block
        head = self.file.read_at(HEADER, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        docs, self.ids, blocks, at, starts, keys = np.frombuffer(head[len(MAGIC) :], "<u8").astype(np.int64).tolist()
        self.checkpoints = np.frombuffer(self.file.read_at(8 * (blocks + 1), at), "<u8").astype(np.int64)
        self.starts = np.frombuffer(self.file.read_at(8 * (docs + 1), starts), "<u8").astype(np.int64)
        self.keys = pa.ipc.open_stream(io.BytesIO(self.file.read_at(self.file.size() - keys, keys))).read_all()["key"].to_pylist()

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first..last-1."""
        begin, end = int(self.checkpoints[first]), int(self.checkpoints[last])
        byte = begin >> 3
        bits = np.frombuffer(self.file.read_at((end >> 3) + 1 - byte, HEADER + byte), np.uint8)
        count = np.full(last - first, self.block)
        count[-1] = min(self.block, self.ids - (last - 1) * self.block)
        return unpack(bits, self.checkpoints[first:last] - 8 * byte, count, self.codes)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start..end-1 of the shard."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first = start // self.block
        return self.blocks(first, -(-end // self.block))[start - first * self.block : end - first * self.block]

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """All ids, SIDE blocks at a time, with the place of the first."""
        for a in range(0, len(self.checkpoints) - 1, SIDE):
            yield a * self.block, self.blocks(a, min(a + SIDE, len(self.checkpoints) - 1))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray, bool]]:
        """(number of the document, place of its first id here, ids, whether they are its last); long documents come in pieces."""
        d = 0
        for at, ids in self.runs():
            while d < len(self.keys):
                a, b = max(int(self.starts[d]), at), min(int(self.starts[d + 1]), at + len(ids))
                if a > b or a == at + len(ids) < self.starts[d + 1]:
                    break
                yield d, int(self.starts[d]), ids[a - at : b - at], b == self.starts[d + 1]
                if b < self.starts[d + 1]:
                    break
                d += 1


def load(path: str) -> tuple[dict, Codes]:
    fs, folder = file_system(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    return manifest, Codes(np.array(manifest["lengths"], np.uint8))


def _over_shards(spark: SparkSession, path: str, of_shard, schema: str) -> DataFrame:
    """``of_shard(shard, ids before it)`` gives record batches; a task for each shard."""
    manifest, codes = load(path)
    shared, block = spark.sparkContext.broadcast(codes.lengths), manifest["block"]
    base, rows = 0, []
    for n, s in enumerate(manifest["shards"]):
        rows.append((n, s["name"], base))
        base += s["ids"]
    listed = spark.createDataFrame(rows, "n int, name string, base long")
    if rows:
        listed = listed.repartitionByRange(len(rows), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, folder), codes = file_system(path), None
        for batch in batches:
            for row in batch.to_pylist():
                codes = codes or Codes(shared.value)
                yield from of_shard(Shard(fs, f"{folder}/{row['name']}", codes, block), row["base"])

    return listed.mapInArrow(lean(run), schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a store, in their order within shards; start: the ids of all documents before it."""

    def of_shard(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
        pieces = []
        for d, start, ids, last in shard.documents():
            pieces.append(ids)
            if last:
                whole = np.concatenate(pieces).astype("<u4").tobytes()
                pieces = []
                yield pa.RecordBatch.from_arrays([pa.array([shard.keys[d]], pa.int64()), pa.array([base + start], pa.int64()), pa.array([whole], pa.binary())], ["doc_id", "start", "ids"])

    return _over_shards(spark, path, of_shard, "doc_id long, start long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of every document of a store, decoded run by run."""

    def of_shard(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
        sums, running = np.zeros(len(shard.keys), np.int64), 0
        for d, _, ids, last in shard.documents():
            running = zlib.crc32(np.ascontiguousarray(ids, "<u4"), running)
            if last:
                sums[d], running = running, 0
        yield pa.RecordBatch.from_arrays([pa.array(shard.keys, pa.int64()), pa.array(shard.starts[:-1] + base), pa.array(np.diff(shard.starts)), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _over_shards(spark, path, of_shard, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Encodes all documents, writes a store of them (to a new folder in the shared one, or to ``path``) and reads it back; see :func:`digests`.

    Nulls, repeated rows and empty tables: see :func:`encode` and :func:`write`.  Other columns of the table play no part.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    encoded, width = encode(docs)
    write(materialise(encoded, "encoded"), path, width)
    return digests(spark, path)
