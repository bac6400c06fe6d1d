"""Approximate nearest neighbours with randomly rotated one-bit codes.

Every vector is taken relative to its cluster's centroid, scaled to length 1
and rotated by one random rotation; its code is the signs.  From the code and
two numbers kept with it (its distance from the centroid, and the inner product
of the unit vector with its own code) the inner product with a query is
estimated without bias, with an error that is below ``SURE`` standard deviations
but for a vanishing part.  Codes are packed bits; the query is cut into bit
planes, so an estimate is a few popcounts.

A search probes the query's nearest clusters first, as many as hold k candidates
at least, so every query gets k neighbours where there are so many.  The k-th
distance found there bounds what can still matter: of the other clusters only
those are probed in which the triangle inequality leaves room, and that are among
the query's nearest ``quota``; in any cluster only vectors whose lower bound is
within the k-th distance so far are compared in full precision.  The quota is
measured, not set: in the sample that the clusters are fitted on, RECALL of the
neighbours of QUERIES vectors, half of them those farthest from their centroids,
lie in so many nearest clusters (in the whole table, which is denser, neighbours
are nearer).  With ``exact`` there is no quota, and nothing is missed but by an
estimate beyond its bound.  Distances are always exact.

Queries are written once for each cluster that they probe; the tasks that hold a
cluster's chunks of vectors read them there, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, lean, materialise, new_path

#: The centroids are fitted on at most this many vectors (those whose id hashes lowest).
SAMPLE, ROUNDS = 20_000, 8
#: Share of the neighbours that the quota of clusters must hold, and vectors of the sample that it is measured on.
RECALL, QUERIES = 0.999, 256
#: Clusters probed first; numbers of a cluster's vectors in one task, about; queries at a time.
FIRST, NUMBERS, BLOCK = 2, 1 << 21, 128
#: Standard deviations of an estimate that its bounds allow for; bits of a query's components.
SURE, PLANES = 4.0, 8


def rotation(dim: int) -> np.ndarray:
    """A random rotation of the space padded to whole 64-bit words; the same for every task."""
    d = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def k_means(sample: np.ndarray, k: int) -> np.ndarray:
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(1)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        near = nearest(sample, c)
        for j in range(sample.shape[1]):
            total = np.bincount(near, sample[:, j], len(c))
            count = np.bincount(near, minlength=len(c))
            c[:, j] = np.where(count, total / np.maximum(count, 1), c[:, j])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)


def quota(sample: np.ndarray, c: np.ndarray, k: int) -> int:
    """How many of a vector's nearest clusters hold RECALL of its k nearest, in the sample; the vectors that ask are its first and its outliers."""
    if len(sample) < 2:
        return len(c)
    near, worst = nearest(sample, c), []
    half = min(QUERIES, len(sample)) // 2 + 1
    out = np.argsort(-((sample - c[near]) ** 2).sum(axis=1), kind="stable")[:half]
    for i in np.union1d(np.arange(min(half, len(sample))), out):
        q = sample[i]
        far = ((sample - q) ** 2).sum(axis=1)
        far[i] = np.inf
        found = np.argpartition(far, min(k, len(far) - 1) - 1)[: min(k, len(far) - 1)]
        rank = np.empty(len(c), np.int64)
        rank[np.argsort(((c - q) ** 2).sum(axis=1), kind="stable")] = np.arange(len(c))
        worst.append(rank[near[found]])
    ranks = np.sort(np.concatenate(worst))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1


def encode(x: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (words of 64 bits), distances from the centroid, and inner products of unit vectors with their codes."""
    off = x - centroid
    norm = np.sqrt((off**2).sum(axis=1))
    unit = off / np.where(norm > 0, norm, 1)[:, None]
    turned = unit @ turn[: x.shape[1]]
    own = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])
    return np.packbits(turned > 0, axis=1, bitorder="little").view("<u8"), norm, np.where(norm > 0, own, 1.0)


def estimate(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, queries: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated, lowest credible) squared distance of each query (rows) and each coded vector."""
    d = turn.shape[0]
    off = queries - centroid
    q_norm = np.sqrt((off**2).sum(axis=1))
    turned = (off / np.where(q_norm > 0, q_norm, 1)[:, None]) @ turn[: queries.shape[1]]
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
    grid = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
    dot = np.zeros((len(queries), len(codes)))
    for b in range(PLANES):
        plane = np.packbits((grid >> b) & 1, axis=1, bitorder="little").view("<u8")
        for w in range(codes.shape[1]):
            dot += np.bitwise_count(plane[:, w, None] & codes[None, :, w]) * float(1 << b)
    rounded = low[:, None] * d + step[:, None] * grid.sum(axis=1, dtype=np.int64)[:, None]
    inner = (2 * (low[:, None] * ones + step[:, None] * dot) - rounded) / np.sqrt(d) / own
    error = SURE * np.sqrt(np.maximum(1 - own**2, 0) / (own**2 * (d - 1))) + step[:, None] * np.sqrt(d) / 2 / own
    cross = 2 * q_norm[:, None] * norm
    plain = q_norm[:, None] ** 2 + norm**2
    return plain - cross * inner, plain - cross * np.minimum(inner + error, 1.0)


def search(ids: np.ndarray, x: np.ndarray, coded: tuple, query_ids: np.ndarray, queries: np.ndarray, limit: np.ndarray, k: int, centroid: np.ndarray, turn: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the query, ids, distances) of up to k vectors within ``limit``; ties go to smaller ids."""
    guess, least = estimate(*coded, queries, centroid, turn)
    for i in range(len(queries)):
        other = np.flatnonzero((ids != query_ids[i]) & (least[i] <= limit[i] ** 2 * (1 + 1e-9)))
        if len(other) > 4 * k:  # the k-th of those that look best bounds the rest
            best = other[np.argpartition(guess[i, other], k)[: k + 1]]
            bound = np.sqrt(((x[best] - queries[i]) ** 2).sum(axis=1)).max()
            other = other[least[i, other] <= bound**2 * (1 + 1e-9)]
        far = np.sqrt(((x[other] - queries[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[other], far))[:k]
        yield i, ids[other][order], far[order]


def nearest_neighbours(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest of each vector whose id is divisible by ``every``.

    Vectors that are null, zero, of another length than most, or that hold null
    or non-finite components take no part, nor do those without an id.  Rows
    alike in id and vector count once; an id with several vectors asks by the
    smallest of them, component by component, and can be found by each; a query
    never finds its own id; with
    fewer than k candidates all are returned; an empty table gives an empty
    result.  Of equal vectors only the k + 1 smallest ids can be found, so a
    vector that very many rows hold is thinned to those in every batch.
    """
    spark = vectors.sparkSession
    raw = F.col(vector)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), raw.cast("array<double>").alias("x"), F.size(raw).alias("n")).filter("id IS NOT NULL AND n > 0")
    common = rows.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 1
    usable = rows.filter((F.col("n") == dim) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)).select("id", "x")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(-1, dim))
            _, same = np.unique(x.view(f"V{8 * dim}").ravel(), return_inverse=True)
            order = np.lexsort((ids, same))
            s, i = same[order], ids[order]
            fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])))
            order, s = order[fresh], s[fresh]
            head = np.concatenate(([True], s[1:] != s[:-1]))
            nth = np.arange(len(s)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            yield batch.take(pa.array(order[(nth <= k) | (ids[order] % every == 0)]))

    thinned = materialise(usable.mapInArrow(lean(thin), "id long, x array<double>").dropDuplicates(["id", "x"]), "vectors")
    sample = thinned.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
    sample = sample.flatten().to_numpy().reshape(-1, dim) if len(sample) else np.zeros((0, dim))
    count = thinned.count()
    centroids = k_means(sample, int(np.clip(round(np.sqrt(count) / 4), 1, 4096)))
    probes, chunk_rows = len(centroids) if exact else max(FIRST, quota(sample, centroids, k)), max(1024, NUMBERS // dim)
    turn = rotation(dim)
    shared = spark.sparkContext.broadcast((centroids, turn))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = shared.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            near = nearest(x, c)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns, pa.array(np.sqrt(((x - c[near]) ** 2).sum(axis=1)))], ["cluster", "id", "x", "off"])

    placed = materialise(thinned.mapInArrow(lean(assign), "cluster int, id long, x array<double>, off double"), "clusters")
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"), F.max("off").alias("radius"), F.min("off").alias("inner"))
    sizes = materialise(sizes, "sizes")  # a row for each centroid, of which there are 4096 at most
    known = {r["cluster"]: (r["rows"], r["radius"], r["inner"]) for r in sizes.collect()}
    index = placed.join(F.broadcast(sizes), "cluster").select("cluster", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int").alias("chunk"), "id", "x")
    # own: rows of the query's own id, which are no candidates.
    queries = placed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("own"))

    def probe(first: bool):
        """The clusters that each query (id, x, own, limit) asks: those that surely hold k candidates, or what else is near enough."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, _ = shared.value
            there = np.array(sorted(known), np.int64)
            rows, radius, inner = (np.array([known[j][n] for j in there.tolist()]) for n in range(3))
            for batch in batches:
                ids, own, limits = (batch.column(n).to_numpy() for n in (0, 2, 3))
                x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
                out = ([], [])
                for i in range(len(ids)):
                    far = np.sqrt(((c[there] - x[i]) ** 2).sum(axis=1))
                    order = np.lexsort((there, far))
                    sure = max(FIRST, int(np.searchsorted(np.cumsum(rows[order]), k + own[i])) + 1)
                    if first:
                        at = order[:sure]
                    else:
                        room = np.maximum(far - radius, inner - far) <= limits[i] * (1 + 1e-9)
                        at = order[sure : max(sure, probes)]
                        at = at[room[at]]
                    out[0].append(there[at])
                    out[1].append(np.full(len(at), i))
                    if sum(map(len, out[0])) >= 2_000 or i == len(ids) - 1:
                        row = np.concatenate(out[1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]).astype(np.int32)), pa.array(ids[row]), batch.column(1).take(pa.array(row)), pa.array(limits[row])], ["cluster", "id", "x", "limit"])
                        out = ([], [])

        return run

    def scan(asked: str):
        """Rows come by cluster and chunk; ``asked`` has the queries, a folder for each cluster."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, turn = shared.value
            place, held = None, []
            fs, folder = file_system(asked)

            def answer() -> Iterator[pa.RecordBatch]:
                files = [f.path for f in fs.get_file_info(FileSelector(f"{folder}/cluster={place[0]}", allow_not_found=True)) if f.path.endswith(".parquet")]
                if not files:
                    return
                ids, x = (np.concatenate([v[n] for v in held]) for n in range(2))
                coded = encode(x, c[place[0]], turn)
                for batch in dataset(files, filesystem=fs, format="parquet").to_batches(columns=["id", "x", "limit"], batch_size=16 * BLOCK):
                    q, qx, limit = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, dim), batch.column(2).to_numpy()
                    out = ([], [], [])
                    for a in range(0, len(q), BLOCK):
                        for i, found, far in search(ids, x, coded, q[a : a + BLOCK], qx[a : a + BLOCK], limit[a : a + BLOCK], k, c[place[0]], turn):
                            for to, value in zip(out, (np.full(len(found), q[a + i]), found, far)):
                                to.append(value)
                    if out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["query_id", "vec_id", "score"])

            for batch in batches:
                cluster, chunk, id_ = (batch.column(n).to_numpy() for n in range(3))
                values = batch.column(3).flatten().to_numpy().reshape(-1, dim)
                change = np.flatnonzero((np.diff(cluster) != 0) | (np.diff(chunk) != 0)) + 1
                for a, b in zip(np.concatenate(([0], change)), np.concatenate((change, [len(cluster)]))):
                    if a < b and (cluster[a], chunk[a]) != place:
                        if held:
                            yield from answer()
                        place, held = (int(cluster[a]), int(chunk[a])), []
                    held.append((id_[a:b], values[a:b]))
            if held:
                yield from answer()

        return run

    dealt = index.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk")

    def look(asked: DataFrame) -> DataFrame:
        path = new_path(spark, "asked")
        asked.repartition("cluster").write.partitionBy("cluster").parquet(path)
        return dealt.mapInArrow(lean(scan(path)), "query_id long, vec_id long, score double")

    schema = "cluster int, id long, x array<double>, limit double"
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    near = materialise(best(look(queries.withColumn("limit", F.lit(float("inf"))).mapInArrow(lean(probe(True)), schema))), "near")
    limits = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    bounded = queries.join(limits, "id", "left").select("id", "x", "own", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    rest = look(bounded.mapInArrow(lean(probe(False)), schema))
    return best(near.drop("rank").union(rest)).select("query_id", "rank", "vec_id", "score")
