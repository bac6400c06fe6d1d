"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of characters (code points, in lower case) of a whole
text, hashed; a feature is present or absent.  For each one, r = log of (share of
toxic training texts that have it / share of the others), smoothed.  All features
whose shares differ beyond chance are kept, and a logistic regression is fitted
over r-scaled presence.  Scoring is one narrow pass of vectorised look-ups.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, discard, lean, materialise, mix, runs, tree_sum, utf8

#: n-gram lengths in characters, and bits of the feature hash.
SIZES, BITS = (4, 5, 6), 20
#: A feature is kept if so many training texts have it, and its shares differ by so many standard errors (of the 2 ** BITS that there may be, some 60 would by chance) and by a factor of 2.
LEAST, BEYOND, EFFECT = 3, 4.0, float(np.log(2))
#: Features of the training texts, one for each text that has it, that the driver fits by itself; of more, Spark adds up the slopes.
ALONE = 1 << 23
#: Steps at most, pairs remembered, and relative slope that ends it, where Spark adds up the slopes.
STEPS, PAIRS, FLAT = 60, 8, 1e-4
CHUNK = 1 << 19
#: Bits of the hash by which documents without a label are left out before texts are shuffled: 8 MB of bitmaps are broadcast at most.
MARKS = 26


@dataclass
class Model:
    """slots: for each hashed feature its number among the kept ones, or -1; bounded by BITS."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of the characters below 65536: the one that stands for it (lower case where that is one character, a space for white space), and its random number."""
    low = [chr(c).lower() for c in range(1 << 16)]
    fold = np.array([32 if chr(c).isspace() else ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32)
    return fold, mix(fold.astype(np.uint64), 21) | np.uint64(1)


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random numbers of the characters of UTF-8 texts, and the offsets of the texts in them."""
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
    _, number = _tables()
    out = number[np.minimum(code, 0xFFFF)]
    far = code > 0xFFFF
    if far.any():
        out[far] = mix(code[far].astype(np.uint64), 21) | np.uint64(1)
    return out, at


def grams(code: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed features that start at each character, for one size after the other."""
    rolling = Rolling(code)
    for n in SIZES:
        yield (mix(rolling.grams(n), n) >> np.uint64(64 - BITS)).astype(np.int32)


def present(raw: np.ndarray, offsets: np.ndarray, slots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each feature that a text has, once; ``slots`` chooses and renumbers features.  No n-gram crosses texts."""
    found = []
    code, offsets = characters(raw, offsets)
    for n, feature in zip(SIZES, grams(code)):
        if slots is not None:
            kept = slots[feature]
            at = np.flatnonzero(kept >= 0)
            feature = kept[at]
        else:
            at = np.arange(len(feature))
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[text + 1]
        found.append(text[inside].astype(np.int64) << 32 | feature[inside])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(sample: DataFrame, slots) -> DataFrame:
    """label and features (array of numbers) of each training text; all of them, or those of the broadcast ``slots``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in runs(offsets, CHUNK):
                text, feature = present(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], None if slots is None else slots.value)
                at = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(feature))], ["label", "features"])

    return sample.mapInArrow(lean(run), "label int, features array<int>")


def _counts(sample: DataFrame) -> DataFrame:
    """feature, pos, neg: texts of each label that have it; summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            labels = batch.column(0).to_numpy().astype(np.int64)
            raw, offsets = utf8(batch.column(1))
            for a, b in runs(offsets, CHUNK):
                text, feature = present(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], None)
                for label in (0, 1):
                    totals[label] += np.bincount(feature[labels[a:b][text] == label], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(totals.any(axis=0))
        for k in range(0, len(some), 50_000):
            at = some[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[1, at].astype(np.int64)), pa.array(totals[0, at].astype(np.int64))], ["feature", "pos", "neg"])

    return sample.mapInArrow(lean(run), "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit_logistic(at: np.ndarray, feature: np.ndarray, labels: np.ndarray, ratios: np.ndarray, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights (ratios folded in) and bias, by accelerated gradient descent on the regularised log loss; text i has the features at[i] .. at[i + 1]."""
    n, m = len(labels), len(ratios)
    size = np.diff(at)
    full = np.flatnonzero(size)  # texts with features
    text = np.repeat(np.arange(n, dtype=np.int32), size)[np.argsort(feature, kind="stable")]
    count = np.bincount(feature, minlength=m)
    used = np.flatnonzero(count)
    heads, columns = at[:-1][full], (np.cumsum(count) - count)[used]

    def rows(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(full):
            out[full] = np.add.reduceat(x[feature], heads)
        return out

    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros(m)
        if len(used):
            out[used] = np.add.reduceat(x[text], columns)
        return out

    base = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(m), float(np.log(base / (1 - base)))
    v, vb, step = w.copy(), b, 4.0 / (rows(ratios**2).max(initial=0.0) + 1.0) * 4
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows(v * ratios) + vb, -40, 40)))
        off = p - labels
        g = (ratios * sums(off) + l2 * v) / n
        before, before_b = w, b
        w, b = v - step * g, vb - step * off.mean()
        v, vb = w + k / (k + 3) * (w - before), b + k / (k + 3) * (b - before_b)
    return w * ratios, b


def fit_on_spark(features: DataFrame, ratios: np.ndarray, n: int, share: float, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """As :func:`fit_logistic` over (label, features) of any size, ``n`` rows of which a ``share`` has label 1: quasi-Newton steps (L-BFGS), the loss and its slope summed by Spark."""
    context, m = features.sparkSession.sparkContext, len(ratios)

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and slope at weights and bias ``x``."""
        shared = context.broadcast((x[:-1] * ratios, float(x[-1])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (w, b), total = shared.value, np.zeros(m + 2)
            for batch in batches:
                label, lists = batch.column(0).to_numpy().astype(float), batch.column(1)
                feature, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                owner = np.repeat(np.arange(len(label)), size)
                z = np.bincount(owner, w[feature], len(label)) + b
                off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
                total[:m] += np.bincount(feature, off[owner], m)
                total[m:] += off.sum(), (np.logaddexp(0, z) - label * z).sum()
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["slab", "part"])

        total = np.frombuffer(tree_sum(features.mapInArrow(lean(run), "slab int, part binary")).first()["part"], np.float32).astype(float) / n
        shared.destroy()
        return float(total[-1] + l2 / 2 / n * (x[:-1] @ x[:-1])), np.append(ratios * total[:m] + l2 / n * x[:-1], total[m])

    x = np.zeros(m + 1)
    x[-1] = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    loss, g = slope(x)
    first, known = np.linalg.norm(g), []
    for _ in range(STEPS):
        if np.linalg.norm(g) <= FLAT * first:
            break
        d, back = -g, []
        for s, y in reversed(known):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        d = d * ((known[-1][0] @ known[-1][1]) / (known[-1][1] @ known[-1][1]) if known else 1 / max(first, 1e-12))
        for (s, y), a in zip(known, reversed(back)):
            d = d + s * (a - (y @ d) / (s @ y))
        size, least = 1.0, 1e-7 * abs(loss)  # sums are told in 32 bits
        while True:
            then = slope(x + size * d)
            if then[0] <= loss + 1e-4 * size * (g @ d) + least or size < 1e-3:
                break
            size /= 2
        if then[0] > loss + least:
            break
        s, y = size * d, then[1] - g
        x, (loss, g) = x + s, then
        if s @ y > 1e-12 * (y @ y):
            known = [*known, (s, y)][-PAIRS:]
    return x[:-1] * ratios, float(x[-1])


def _likely(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` but most of those whose _id is not in ``chosen``: bitmaps say which hashes occur there.  All rows, where ids may be equal and hash apart."""
    kind = docs.schema["_id"].dataType
    if kind != chosen.schema["_id"].dataType or not (isinstance(kind, T.IntegralType) or kind == T.StringType()):
        return docs
    at = F.pmod(F.xxhash64("_id"), F.lit(1 << MARKS))
    marks = chosen.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_marks"))
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring("_marks", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(marks), "_bucket")
    return found.filter(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1).select(*docs.columns)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int | None = None) -> Model:
    """Learns from all labelled rows that aren't held out; of ``train_rows``, if that is set, those whose ids hash lowest.

    Of several texts of one id the one that hashes lowest counts, so a repeated
    id does not make the sample larger; an id labelled both ways counts as either.
    """
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    if train_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(train_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    sample = _likely(rows, chosen).join(chosen, "_id")
    sample = sample.groupBy("_id", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    sample = materialise(sample.select("_label", "_text"), "labelled")
    context = docs.sparkSession.sparkContext
    counts = _counts(sample)
    totals = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    p, q = (F.col("pos") + 1) / (pos + 2), (F.col("neg") + 1) / (neg + 2)
    pooled = (F.col("pos") + F.col("neg") + 1) / (pos + neg + 2)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / (pos + 1) + 1 / (neg + 1)))
    best = counts.filter((F.col("pos") + F.col("neg") >= LEAST) & (F.abs(z) >= BEYOND) & (F.abs(F.log(p / q)) >= EFFECT)).select("feature", F.log(p / q).alias("r")).toArrow()  # 2 ** BITS at most
    feature, ratio = best["feature"].to_numpy(), best["r"].to_numpy()
    order = np.argsort(feature)
    slots = np.full(1 << BITS, -1, np.int32)
    slots[feature[order]] = np.arange(len(order))
    if not len(order):
        discard(sample)
        return Model(slots, np.zeros(len(order)), float(np.log((pos + 0.5) / (neg + 0.5))) if pos + neg else -3.0)
    found = materialise(_features(sample, context.broadcast(slots)), "features")
    discard(sample)
    if (found.agg(F.sum(F.size("features").cast("long"))).first()[0] or 0) > ALONE:
        weights, bias = fit_on_spark(found, ratio[order], pos + neg, pos / (pos + neg))
    else:
        rows = found.toArrow()
        features = rows["features"].combine_chunks()
        weights, bias = fit_logistic(features.offsets.to_numpy().astype(np.int64), features.values.to_numpy(), rows["label"].to_numpy().astype(float), ratio[order])
    discard(found)
    return Model(slots, weights, bias)


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1, higher for a likelier label 1; null and empty texts get the bias's score."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != name]
    kept = [docs.columns.index(c) for c in columns]
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for batch in batches:
            raw, offsets = utf8(batch.column(at_text))
            out = np.empty(len(offsets) - 1)
            for a, b in runs(offsets, CHUNK):
                owner, feature = present(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], m.slots)
                out[a:b] = np.bincount(owner, m.weights[feature], b - a) + m.bias
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(1 / (1 + np.exp(-np.clip(out, -40, 40))))], [*columns, name])

    return docs.mapInArrow(lean(run), T.StructType([docs.schema[c] for c in columns]).add(name, "double"))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Only text reaches a score.  With no usable label every score is low;
    a null doc_id is not held out and never a training row; repeated rows are
    scored each; empty tables give an empty result.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, **options)
    scored = score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
