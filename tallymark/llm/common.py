"""Plumbing that the llm operators share: durable intermediates and vectorised hashing of text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that separates words: space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a folder of our own in a local run, and an error on a cluster."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tallymark-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_own_dir}")
    return f"file://{_own_dir}"


_passing: list[list[str]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in _passing:
        made.append(path)
    return path


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """What is written to a :func:`new_path` inside is deleted at the end: only what has been written elsewhere by then stays."""
    made: list[str] = []
    _passing.append(made)
    try:
        yield
    finally:
        _passing.remove(made)
        for path in made:
            fs, place = file_system(path)
            if fs.get_file_info(place).type.name != "NotFound":
                fs.delete_dir(place)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it is computed once, its lineage is cut, and losing an executor loses nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Deletes what :func:`materialise` or :func:`write_side` wrote, once all that needs it has been written itself."""
    for table in tables:
        fs, path = file_system(table if isinstance(table, str) else table._written_to)
        fs.delete_dir(path)


def unused(name: str, columns: list[str]) -> str:
    """A name for a working column that clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder, wherever it is."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = uri[5:]
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


# --------------------------------------------------------------------------- memory


def lean(run: Callable) -> Callable:
    """``run``, after which the worker gives back what it no longer uses: it lives on, beside the tasks of other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


# --------------------------------------------------------------------------- side files


def write_side(df: DataFrame, tag: str) -> str:
    """Writes (uid, ...) beside a table whose uid came from monotonically_increasing_id: one folder for each partition of it, which uid tells.

    So each task over the table finds what concerns its rows, and the table is never shuffled.
    """
    from pyspark.sql import functions as F

    path = new_path(df.sparkSession, tag)
    df.withColumn("part", F.shiftright("uid", 33)).repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(path)
    return path


class Side:
    """Reads what :func:`write_side` wrote for the partition at hand; rows become Python objects as they are asked for."""

    def __init__(self, path: str):
        (self.fs, self.path), self.part, self.rows, self.names = file_system(path), None, {}, []

    def of(self, uid: int) -> tuple | None:
        if uid >> 33 != self.part:
            from pyarrow import dataset, fs

            self.part, self.rows = uid >> 33, {}
            files = [f.path for f in self.fs.get_file_info(fs.FileSelector(f"{self.path}/part={self.part}", allow_not_found=True)) if f.path.endswith(".parquet")]
            if files:
                table = dataset.dataset(files, filesystem=self.fs, format="parquet").to_table().combine_chunks()
                self.names = [n for n in table.column_names if n != "uid"]
                self.columns = [table[n] for n in self.names]
                self.rows = {u: k for k, u in enumerate(table["uid"].to_pylist())}
        k = self.rows.get(uid)
        return None if k is None else tuple(c[k].as_py() for c in self.columns)


# --------------------------------------------------------------------------- text as bytes


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len+1 offsets of its values; null is empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) that hold about ``limit`` bytes each; a longer text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


# --------------------------------------------------------------------------- hashing

_P = 0x9E3779B97F4A7C15 | 1
_T = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


class Rolling:
    """Polynomial hash of any substring of ``raw`` in O(1), for whole arrays of substrings at once."""

    def __init__(self, raw: np.ndarray):
        """``raw``: bytes, or random numbers that stand for other characters."""
        up, self.down = _tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_T[raw] if raw.dtype == np.uint8 else raw) * up[: len(raw)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        """Of the k bytes at each position."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; ``salt`` makes independent functions of it."""
    h = h ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Words from this length on are hashed by themselves: there are words of some 1000 bytes (Thue and Morse's) that every polynomial modulo 2**64 takes for one.
LONG_WORD = 64


def long_hashes(h: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``h``, hashes of the words ``low[start:end]``, with other ones for long words."""
    long = np.flatnonzero(end - start >= LONG_WORD)
    if len(long):
        data = low.tobytes()
        h[long] = np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())], np.uint64)
    return h


def hash_words(low: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    return mix(long_hashes(Rolling(low).spans(start, end), low, start, end), salt)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``raw``, and the first word of each text (len+1 entries)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~IS_SPACE[raw]
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] |= solid[1:-1][cut]
    cut = cut[cut > 0] - 1
    last[cut] |= solid[1:-1][cut]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)




# --------------------------------------------------------------------------- sums of arrays


def tree_sum(parts: DataFrame) -> DataFrame:
    """Adds up the float32 arrays ``part`` of each ``slab``, in two levels so that no task gets a row from every other one."""
    from pyspark.sql import functions as F

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[slab] = sums.get(slab, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["slab", "part"])

    for salt in (16, 1):
        parts = parts.withColumn("s", F.pmod(F.xxhash64("part"), F.lit(salt))).repartition("slab", "s").select("slab", "part").mapInArrow(lean(add), "slab int, part binary")
    return parts
