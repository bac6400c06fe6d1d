"""Log probabilities of texts under a small causal self-attention model on subword ids.

Texts are words in lower case and one end.  The subwords of each word (with the
space before it) come from a public byte-level vocabulary; the most frequent of
them have a slot of the model, the rest share one and are told apart by their
counts.  What the model looks up by the last token, the counts of neighbours, is
taken from every word of the training corpus.  Its attention and hidden layers
are trained by gradient on every piece of every training text, by averaging the
weights that partitions of the pieces reach from common ones, round by round.  Beside the model's, a base score
is given by add-one smoothed word counts.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as net
from .common import LOWER, Rolling, lean, long_hashes, materialise, mix, runs, tree_sum, utf8, words

#: So many of the most frequent words are broadcast at most; the others are joined.
HEAVY = 1_000_000
#: Words remembered by a worker; words counted before a task hands on what it has.
REMEMBERED, COUNTED = 500_000, 400_000
#: Words of a piece of training text, where some pieces are taken and where all are: long ones leave fewer windows part empty.
PIECE, WHOLE = 64, 1024
#: Windows of a task, in all rounds; rounds, which share the pieces out (each window is seen once in all, if they are many); least steps of a round, but for few windows, which are seen EPOCHS times at most.
LOCAL, ROUNDS, STEPS, EPOCHS, RATE = 65_536, 2, 800, 12, 0.02
CHUNK = 1 << 19
#: Random numbers of bytes, for a second hash.
SECOND = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OTHER = net.SLOTS - 1
#: Rows of the table of neighbours in a slab of its sum; SLOTS + 2 = 1026 is a multiple.
SLAB = 54
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text leaves 2 when divided by 7; a null doc_id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def subwords(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the subwords of " word" for each word, and their len+1 offsets: all in one call, with line ends between."""
    enc = encoder(path)
    joined = b"".join((b"\n ", b"\n ".join(words))).decode() if words else ""
    texts = joined.split()
    if len(texts) == len(words) and (not words or "\n ".join(texts) == joined[2:]):  # no word holds a blank
        plain = np.ones(len(words), bool)
    else:
        texts = [w.decode() for w in words]
        plain = np.array([w.isascii() or len(t.split()) == 1 and t == t.strip() for w, t in zip(words, texts)], bool)
        joined = "".join("\n " + t for t, p in zip(texts, plain.tolist()) if p)
    ids = np.array(enc.encode_ordinary(joined), np.int64)
    cut = np.flatnonzero(ids == enc.encode_ordinary("\n")[0])
    if len(cut) != plain.sum():
        plain[:], ids, cut = False, ids[:0], cut[:0]
    size = np.zeros(len(words), np.int64)
    size[plain] = np.diff(np.concatenate((cut, [len(ids)]))) - 1
    other = {k: enc.encode_ordinary(" " + texts[k]) for k in np.flatnonzero(~plain).tolist()}
    for k, own in other.items():
        size[k] = len(own)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(at[-1], np.int64)
    out[np.repeat(plain, size)] = np.delete(ids, cut)
    for k, own in other.items():
        out[at[k] : at[k + 1]] = own
    return out, at


class Numbers:
    """Numbers words as they come.

    The words of a chunk are found all at once, by two 64-bit hashes of their
    bytes; only new ones become Python objects.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = []
        self.one, self.two = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.uint64)
        self.table = np.full(1 << 20, -1, np.int32)

    def look(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of every word of the texts, its start and end, and the first word of each text (len+1 entries)."""
        low = LOWER[raw]
        start, end, first = words(low, offsets)
        one = mix(Rolling(low).spans(start, end), 31)
        two = mix(long_hashes(Rolling(SECOND[low]).spans(start, end), low, start, end), 32)
        out = self._find(one, two)
        new = np.flatnonzero(out < 0)
        if len(new):
            order = new[np.lexsort((two[new], one[new]))]
            head = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
            each = order[head]
            data = low.tobytes()
            fresh = [data[a:b] for a, b in zip(start[each].tolist(), end[each].tolist())]
            self._add(fresh, one[each], two[each])
            out[order] = len(self.words) - len(each) + np.cumsum(head) - 1
        return out, start, end, first

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        mask = len(self.table) - 1
        out, slot, at = np.full(len(one), -1, np.int64), (one & np.uint64(mask)).astype(np.int64), np.arange(len(one))
        while len(at):
            number = self.table[slot]
            some = number >= 0
            if not some.all():
                at, slot, number = at[some], slot[some], number[some]
            hit = (self.one[number] == one[at]) & (self.two[number] == two[at])
            out[at[hit]] = number[hit]
            at, slot = at[~hit], (slot[~hit] + 1) & mask
        return out

    def _add(self, fresh: list[bytes], one: np.ndarray, two: np.ndarray) -> None:
        n, m = len(self.words), len(self.words) + len(fresh)
        self.words += fresh
        if len(self.one) < m:
            self.one, self.two = (np.concatenate((x, np.zeros(m, np.uint64))) for x in (self.one, self.two))
        self.one[n:m], self.two[n:m] = one, two
        if 3 * m > len(self.table):
            self.table = np.full(4 * len(self.table), -1, np.int32)
            n = 0
        mask, numbers = len(self.table) - 1, np.arange(n, m)
        slot = (self.one[n:m] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.table[slot] < 0
            self.table[slot[free]] = numbers[free]  # of those that want one place, one gets it
            left = self.table[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & mask


def id_type(n: int) -> np.dtype:
    """Of the ids of a vocabulary of this size."""
    return np.dtype("<u2" if n <= 1 << 16 else "<i4")


class Coded(Numbers):
    """Numbers words as they come, and keeps their subwords."""

    def __init__(self, path: str):
        self.path, self.kind = path, id_type(encoder(path).n_vocab)
        super().__init__()

    def clear(self) -> None:
        super().clear()
        self.slots, self.at = np.zeros(1 << 20, self.kind), np.zeros(1 << 18, np.int64)

    def tokens(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is kept of the words with these numbers, and their len+1 offsets."""
        size = self.at[w + 1] - self.at[w]
        at = np.concatenate(([0], np.cumsum(size)))
        return self.slots[np.arange(at[-1]) + np.repeat(self.at[w] - at[:-1], size)], at

    def _keep(self, fresh: list[bytes], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What to keep of the subwords of new words."""
        return ids

    def _add(self, fresh: list[bytes], one: np.ndarray, two: np.ndarray) -> None:
        ids, at = subwords(fresh, self.path)
        n, m = len(self.words), len(self.words) + len(fresh)
        end = int(self.at[n])
        while len(self.slots) < end + len(ids):
            self.slots = np.concatenate((self.slots, np.zeros_like(self.slots)))
        if len(self.at) <= m:
            self.at = np.concatenate((self.at, np.zeros(m + 1, np.int64)))
        self.slots[end : end + len(ids)] = self._keep(fresh, ids, at)
        self.at[n : m + 1] = end + at
        super()._add(fresh, one, two)


class Vocabulary:
    """Slots of subword ids, and log10 shares of those without one; bounded by the public vocabulary."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")[: net.SLOTS - 2]
        order = order[counts[order] > 0]
        self.slot = np.full(len(counts), OTHER, np.int16)
        self.slot[order] = np.arange(1, len(order) + 1)
        rest = np.where(self.slot == OTHER, counts, 0.0)
        n = int((self.slot == OTHER).sum())
        self.share = np.where(self.slot == OTHER, np.log10((rest + 1) / (rest.sum() + max(1, n))), 0.0)


def count_words(docs: DataFrame, every: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(word, c, ids) over all training documents of ``docs`` (text, held_out), and one in ``every`` of the pieces of their texts.

    A text's own hash says with which of its pieces to begin, so that all places
    of texts count alike.  A piece is the subwords of its words, found once and
    kept as numbers; a piece but a text's first starts with the subword before
    it, for history.  Tasks add up before the shuffle, so words that all
    documents share cost no more than others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, piece = Coded(path), np.zeros(0, np.int64), PIECE if every > 1 else WHOLE
        types = (pa.binary(), pa.int64(), pa.binary(), pa.int32())
        names = ("word", "n", "piece", "edge")

        def flush() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(seen.words), 50_000):
                some = seen.words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, types[0]), pa.array(counts[k : k + 50_000]), pa.nulls(len(some), types[2]), pa.nulls(len(some), types[3])], names)
            seen.clear()

        for batch in batches:
            batch = batch.filter(pc.invert(batch.column(1)))
            raw, offsets = utf8(batch.column(0))
            for a, b in runs(offsets, CHUNK):
                own = raw[offsets[a] : offsets[b]]
                w, _, _, first = seen.look(own, offsets[a : b + 1] - offsets[a])
                counts = np.concatenate((counts, np.zeros(len(seen.words) - len(counts), np.int64))) + np.bincount(w, minlength=len(seen.words))
                ids, at = seen.tokens(w)
                size = np.diff(first)
                phase = np.array([xxhash.xxh64_intdigest(raw[offsets[r] : offsets[r + 1]]) % every if every > 1 else 0 for r in range(a, b)], np.int64) * piece
                many = np.maximum(-(-(np.maximum(size, 1) - phase) // (every * piece)), 0)
                of = np.repeat(np.arange(b - a), many)
                k = phase[of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * every * piece  # first words
                last = np.minimum(k + piece, size[of])
                begin, end = at[first[:-1][of] + k] - (k > 0), at[first[:-1][of] + last]
                cut = np.concatenate(([0], np.cumsum(end - begin)))
                data = ids[np.arange(cut[-1]) + np.repeat(begin - cut[:-1], end - begin)]
                pieces = pa.Array.from_buffers(types[2], len(of), [None, pa.py_buffer((cut * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
                edges = (k == 0) + 2 * (k + piece >= size[of])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(of), types[0]), pa.nulls(len(of), types[1]), pieces, pa.array(edges.astype(np.int32))], names)
                if len(seen.words) > COUNTED:
                    yield from flush()
                    counts = counts[:0]
        yield from flush()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = subwords(batch.column(0).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["word", "c", "ids"])

    both = materialise(docs.select("text", "held_out").mapInArrow(lean(run), "word binary, n long, piece binary, edge int"), "words")
    counts = both.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"))
    return materialise(counts.mapInArrow(lean(coded), "word binary, c long, ids array<int>"), "counts"), both.filter("piece IS NOT NULL").select("piece", "edge")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, subwords, and the len+1 offsets of the subwords of each word."""
    lists = batch.column(1)
    return batch.column(0).to_numpy(), lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))


def count_subwords(counts: DataFrame, path: str) -> np.ndarray:
    n = encoder(path).n_vocab

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            c, ids, at = _lists(batch)
            total += np.bincount(ids, np.repeat(c, np.diff(at)), n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], ["id", "n"])

    rows = counts.select("c", "ids").mapInArrow(lean(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each id of the vocabulary
    out = np.zeros(n)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def count_pairs(counts: DataFrame, slot: np.ndarray, ends: int) -> np.ndarray:
    """SLOTS x SLOTS: how often one slot follows another, over the whole training corpus.

    Within words that is counted; from word to word, where a text's end counts
    as a word, it is what follows if words were independent: the model's upper
    layers learn what they are not.
    """
    shared = counts.sparkSession.sparkContext.broadcast(slot)
    size = net.SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 2) * size)
        for batch in batches:
            c, ids, at = _lists(batch)
            z = shared.value[ids].astype(np.int64)
            head, tail = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0] - 1
            inner = np.ones(len(z), bool)
            inner[head] = False
            inner = np.flatnonzero(inner)
            weight = np.repeat(c, np.diff(at))
            for where, n in ((z[inner - 1] * size + z[inner], weight[inner]), (size * size + z[head], weight[head]), (size * size + size + z[tail], weight[tail])):
                total += np.bincount(where, n, len(total))
        slabs = total.astype(np.float32).reshape(-1, SLAB * size)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slabs)), pa.int32()), pa.array([x.tobytes() for x in slabs], pa.binary())], ["slab", "part"])

    out = np.zeros(((size + 2) // SLAB, SLAB * size))
    for row in tree_sum(counts.select("c", "ids").mapInArrow(lean(run), "slab int, part binary")).collect():
        out[row["slab"]] = np.frombuffer(row["part"], np.float32)
    out = out.reshape(size + 2, size)
    pairs, first, last = out[:size], out[size], out[size + 1]
    first[net.BEGIN] += ends
    last[net.BEGIN] += ends
    return pairs + last[:, None] * (first / max(1.0, first.sum()))


def windows_of(pieces: pa.Array, edges: list[int], lexicon: Lexicon | Trainer) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets (n x CONTEXT, -1: none) of consecutive windows: every token is a target once.  A text's beginning stands in the middle, as the scorer has it."""
    slot, edge = lexicon.vocabulary.slot, np.array(edges, np.int64)
    raw, offsets = utf8(pieces)
    kind = id_type(len(slot))
    ids, size = raw[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // kind.itemsize
    first, last = edge & 1, edge >> 1 & 1
    # All pieces' tokens in a row, with BEGIN at texts' beginnings and ends.
    length = first + size + last
    begin = np.cumsum(length) - length
    tokens = np.full(length.sum(), net.BEGIN, np.int16)
    tokens[_spread(begin + first, size)] = slot[ids]
    n, left = length - 1, net.HALF * first
    many = -(-(left + n) // net.CONTEXT) * net.CONTEXT
    x, y = (np.full(many.sum(), -1, np.int16) for _ in range(2))
    to, of = _spread(np.cumsum(many) - many + left, n), _spread(begin, n)
    x[to], y[to] = tokens[of], tokens[of + 1]
    return x.reshape(-1, net.CONTEXT), y.reshape(-1, net.CONTEXT)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. for each begin, as many as size says."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


class Trainer:
    """What training broadcasts; the table is made once in a worker process."""

    def __init__(self, vocabulary: Vocabulary, pairs: np.ndarray):
        self.vocabulary, self.pairs = vocabulary, pairs.astype(np.float32)

    @functools.cached_property
    def table(self) -> net.Table:
        return net.Table(self.pairs)


def train(pieces: DataFrame, trainer: Trainer, n: float) -> np.ndarray:
    """The model's weights from ``pieces`` that make ``n`` windows or so.  Each round, every partition trains on the windows of its own pieces that have their turn, slab by slab, and the partitions' weights are averaged."""
    flat = net.initial()
    if not n:
        return flat
    spark = pieces.sparkSession
    parts = max(1, round(n / LOCAL))
    dealt = pieces.coalesce(parts)
    shared = spark.sparkContext.broadcast(trainer)
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            out, seen, slabs, held, size = start.value, 0, 0, [], 0
            table = shared.value.table

            def learn() -> None:
                nonlocal out, seen, slabs, size
                x, y = (np.concatenate(p) for p in zip(*held))
                held.clear()
                share = -(-len(x) // 64)
                steps = max(share, min(STEPS // parts, EPOCHS * share))
                out = net.train(out, table, x, y, steps, RATE / (1 + k) / np.sqrt(1 + slabs), 1000 * k + TaskContext.get().partitionId())
                seen, slabs, size = seen + len(x), slabs + 1, 0

            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    some = batch.slice(a, 256)
                    held.append(windows_of(some.column(0), some.column(1).to_pylist(), shared.value))
                    size += len(held[-1][0])
                    if size * ROUNDS >= LOCAL:
                        learn()
            if held:
                learn()
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.append(out * seen, seen).astype(np.float32).tobytes()], pa.binary())], ["slab", "part"])

        turn = dealt.filter(F.pmod(F.xxhash64("piece"), F.lit(ROUNDS)) == k)
        found = tree_sum(turn.mapInArrow(lean(run), "slab int, part binary")).collect()  # one array of weights
        if found:
            total = np.frombuffer(found[0]["part"], np.float32)
            flat = total[:-1] / total[-1]
    return flat


class Heavy:
    """Frequent words and their gain over an unseen one: sorted digests, with the words themselves to confirm."""

    def __init__(self, words: pa.Array, gain: np.ndarray):
        digest = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
        order = np.argsort(digest, kind="stable")
        self.digest, self.gain = digest[order], gain[order]
        self.words = words.take(pa.array(order)) if len(order) else words

    def of(self, words: list[bytes]) -> np.ndarray:
        """Gain of each word; -1 for those that are not frequent."""
        out = np.full(len(words), -1.0)
        if not len(self.digest):
            return out
        digest = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        at = np.minimum(np.searchsorted(self.digest, digest), len(self.digest) - 1)
        some = np.flatnonzero(self.digest[at] == digest)
        place = at[some]
        same = pc.equal(self.words.take(pa.array(place)), pa.array([words[k] for k in some.tolist()], self.words.type)).to_numpy(zero_copy_only=False).astype(bool)
        for j in np.flatnonzero(~same).tolist():  # another word of the same digest may be the next
            p = place[j] + 1
            while p < len(self.digest) and self.digest[p] == digest[some[j]]:
                if self.words[int(p)].as_py() == words[some[j]]:
                    place[j], same[j] = p, True
                p += 1
        out[some[same]] = self.gain[place[same]]
        return out


class Lexicon(Coded):
    """What a worker remembers of words: slots, share of rare subwords, gain in the base score."""

    def __init__(self, vocabulary: Vocabulary, heavy: Heavy | None, path: str):
        self.vocabulary, self.heavy = vocabulary, heavy
        super().__init__(path)

    def clear(self) -> None:
        super().clear()
        self.slots = np.zeros(1 << 20, np.int16)
        self.share, self.gain = np.zeros(1 << 18, np.float32), np.zeros(1 << 18)

    def bound(self) -> None:
        """Forgets everything if that has become too much; between chunks only."""
        if len(self.words) > REMEMBERED:
            self.clear()

    def _keep(self, fresh: list[bytes], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        n, m = len(self.words), len(self.words) + len(fresh)
        if len(self.share) < m:
            self.share, self.gain = (np.concatenate((x, np.zeros(m, x.dtype))) for x in (self.share, self.gain))
        rare = np.concatenate(([0.0], np.cumsum(self.vocabulary.share[ids])))
        self.share[n:m] = rare[at[1:]] - rare[at[:-1]]
        self.gain[n:m] = self.heavy.of(fresh) if self.heavy else 0
        return self.vocabulary.slot[ids]


class Worker:
    """Everything that scoring broadcasts; its lexicon lives as long as the worker process."""

    def __init__(self, vocabulary: Vocabulary, pairs: np.ndarray, heavy: Heavy, flat: np.ndarray, path: str):
        self.vocabulary, self.pairs, self.heavy, self.flat, self.path = vocabulary, pairs.astype(np.float32), heavy, flat, path

    @functools.cached_property
    def tools(self) -> tuple[Lexicon, net.Scorer]:
        return Lexicon(self.vocabulary, self.heavy, self.path), net.Scorer(self.flat, net.Table(self.pairs))


def _score(docs: DataFrame, worker) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, scorer = worker.value.tools
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in runs(offsets, CHUNK):
                lexicon.bound()
                w, _, _, first = lexicon.look(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                count = np.diff(first)
                owner = np.repeat(np.arange(b - a), count)
                slots, at = lexicon.tokens(w)
                begin = at[first] + np.arange(b - a + 1)  # each text has its end besides
                tokens = np.full(begin[-1], net.BEGIN, np.int16)
                put = np.ones(begin[-1], bool)
                put[begin[1:] - 1] = False
                tokens[put] = slots
                score = np.add.reduceat(scorer.score(tokens, begin).astype(np.float64), begin[:-1]) / np.log(10) + np.bincount(owner, lexicon.share[w], b - a)
                gain = lexicon.gain[w]
                light = gain < 0
                rest = [lexicon.words[k] for k in w[light].tolist()]
                at = np.concatenate(([0], np.cumsum(np.bincount(owner[light], minlength=b - a)))).astype(np.int32)
                arrays = [pa.array(count + 1), pa.array(np.bincount(owner, np.where(light, 0, gain), b - a).astype(np.float64)), pa.array(count - np.diff(at)), pa.array(score), pa.ListArray.from_arrays(pa.array(at), pa.array(rest, pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in (1, 2, 3)] + arrays, ["uid", "doc_id", "held_out", "n_tokens", "gain", "n_known", "score", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text", "uid", "doc_id", "held_out").mapInArrow(lean(run), f"uid long, doc_id {kind}, held_out boolean, n_tokens long, gain double, n_known long, score double, words array<binary>")


def score_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null texts are empty: one token, the end.  Rows with a null doc_id are
    training rows; repeated rows count, and are scored, each; without training
    rows the scores are those of uniform counts; an empty table gives an empty
    result; a very long text is scored whole.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    context = docs.sparkSession.sparkContext
    id_ = F.col(doc_id)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"), id_.alias("doc_id"), held_out(id_).alias("held_out"))
    ends = rows.filter(~F.col("held_out")).count()
    counts, pieces = count_words(rows, 1, path)
    known = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = known["n"] + ends, known["v"] + (ends > 0)
    level = F.floor(F.log2("c") * 4)
    steps = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # 252 at most
    least = min((k for k, _ in steps if sum(m for j, m in steps if j >= k) <= HEAVY), default=256)
    frequent = counts.filter(level >= least).select("word", F.log10(F.col("c") + 1).alias("gain")).toArrow()  # HEAVY at most
    heavy = Heavy(frequent["word"].combine_chunks(), frequent["gain"].to_numpy())
    subword_counts = count_subwords(counts, path)
    vocabulary = Vocabulary(subword_counts)
    pairs = count_pairs(counts, vocabulary.slot, ends)
    flat = train(pieces, Trainer(vocabulary, pairs), (subword_counts.sum() + ends) / net.CONTEXT)
    worker = context.broadcast(Worker(vocabulary, pairs, heavy, flat, path))
    scored = materialise(_score(rows, worker), "scores")
    light = counts.filter(level < least).select("word", F.log10(F.col("c") + 1).alias("more"))
    found = scored.select("uid", F.explode("words").alias("word")).join(light, "word")
    sums = found.groupBy("uid").agg(F.sum("more").alias("more"), F.count(F.lit(1)).alias("found"))
    unseen = float(np.log10(1.0 / (n + v + 1)))
    base = F.col("n_tokens") * unseen + F.col("gain") + F.coalesce("more", F.lit(0.0)) + float(np.log10(ends + 1))
    total = scored.drop("words").join(sums, "uid", "left")
    return total.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
