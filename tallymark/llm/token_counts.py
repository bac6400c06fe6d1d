"""Token counts by a public byte-level BPE, without running the encoder on most of the text.

A text is cut into pre-tokens.  A vocabulary string that the merge rules turn
into exactly one token *when it stands alone* counts 1 wherever it is a whole
pre-token; which strings those are is proved once, offline, by running the
merges on every vocabulary string.  Only the pre-tokens outside that set are
merged, and short ones are remembered.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lean, unused

#: Remembered pre-tokens: at most this many, of at most this many characters.
CACHE, CACHED_CHARS = 400_000, 64
#: Texts with more characters than this are cut into pre-tokens lazily.
LONG = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Rules:
    """What of a tokenizer file counting needs; proved on the driver, bounded by the vocabulary, and broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without a normalizer is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        self.path = path
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        merge, back = Tokenizer.from_file(path).model.tokenize, {c: b for b, c in enumerate(byte_alphabet())}
        self.whole = set()
        for token in spec["model"]["vocab"]:
            if token not in self.special and len(merge(token)) == 1:
                try:
                    self.whole.add(bytes(back[c] for c in token).decode())
                except UnicodeDecodeError:  # part of a character: never a whole pre-token
                    pass

    @functools.cached_property
    def counter(self) -> Counter:
        """One for each worker process, so that what it remembers outlives a task."""
        return Counter(self)


class Counter(dict):
    """pre-token -> number of tokens; merges what it has not seen."""

    def __init__(self, rules: Rules):
        super().__init__(dict.fromkeys(rules.whole, 1))
        self.merge, self.alphabet, self.room = Tokenizer.from_file(rules.path).model.tokenize, dict(enumerate(byte_alphabet())), CACHE
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, rules.special))) if rules.special else None

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece.encode().decode("latin-1").translate(self.alphabet)))
        if self.room and len(piece) <= CACHED_CHARS:
            self[piece] = n
            self.room -= 1
        return n

    def tokens(self, text: str) -> int:
        parts, n = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        for part in parts:
            pieces = self.cut.findall(part) if len(part) <= LONG else (m.group() for m in self.cut.finditer(part))
            n += sum(map(self.__getitem__, pieces))
        return n


def count_tokens(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, limit: int = 512) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit of every row.

    No shuffle: one narrow pass.  A null text counts as empty (0 bytes, 0
    tokens); repeated rows are counted each; an empty table gives an empty one.
    Special strings inside a text are one token each, as the library has it by
    default.  Texts may be of any length.
    """
    rules = docs.sparkSession.sparkContext.broadcast(Rules(path or public_tokenizers.path("byte_bpe_50k.json")))
    slim = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(unused("__text", list(keep))))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = rules.value.counter
        for batch in batches:
            values = batch.column(width)
            n = pa.array([counter.tokens(v.as_py()) for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pc.cast(pc.binary_length(values), pa.int64()), n], [*keep, "n_bytes", "n_tokens"])

    schema = slim.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long")
    return slim.mapInArrow(lean(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
