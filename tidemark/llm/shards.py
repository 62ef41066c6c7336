"""Blocks of packed arrays as shuffle rows, and sorted hash arrays in the shared folder.

Map tasks turn texts into arrays, pre-aggregate them and send one packed row per shard, so
that no key is repeated within a map task and hashed keys fill the shards evenly. Reduce
tasks write sorted ``.npy`` files into the folder that ``spark.checkpoint.dir`` names, under
a name of their own first and then by an atomic rename, so a task that runs again after a
lost executor leaves the same file. Workers map these files into memory and touch only the
pages that they search. That needs a folder which is mounted at the same path everywhere.
"""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import staging_root

BLOCK = "shard int, data binary"
_BLOCK = pa.schema([("shard", pa.int32()), ("data", pa.binary())])
#: Bytes of text that a task turns into arrays at once.
CHUNK = 1 << 21


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, as a path that workers can open."""
    root = staging_root(spark)
    if "://" in root and not root.startswith("file://") or root.startswith(("hdfs:", "s3", "viewfs:")):
        raise ValueError(f"Mapped arrays need a mounted spark.checkpoint.dir, not {root}")
    path = os.path.join(root.removeprefix("file://").removeprefix("file:"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Sends workers at most ``limit`` bytes of rows at once, unless the session set a limit of its own.

    By default a batch has ten thousand rows, however long their texts are.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name, None) is None:
        spark.conf.set(name, str(limit))


def trimmed(function):
    """``function`` over batches, after which the worker hands unused memory back.

    Workers live on between tasks, and what one task took at its height would stay with them.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def shard_bits(spark: SparkSession) -> int:
    """Bits of a key that number its shard: about two shards for each shuffle partition."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())


def crc_is(column, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def save(path: str, array: np.ndarray) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        np.save(out, array)
    os.replace(own, path)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; NULL is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: list[int], limit: int = CHUNK):
    """Runs of rows (start, end) of about ``limit`` bytes, one row at least."""
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(rows: list[bytes], *kinds: str) -> list[np.ndarray]:
    """The arrays of packed rows, each joined over all rows."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for row in rows:
        n, at = len(row) // width, 0
        for into, kind in zip(out, kinds, strict=True):
            into.append(np.frombuffer(row, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds, strict=True)]


def runs(values: np.ndarray):
    """(start, end) of each run of equal values."""
    if not len(values):
        return []
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True))


def cut(bits: int, by: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    """Packed rows by shard; ``by`` holds sorted keys whose top bits number the shard."""
    shard = (by >> np.uint64(64 - bits)).astype(np.int32)
    parts = runs(shard)
    rows = [pack(*(a[i:j] for a in arrays)) for i, j in parts]
    return pa.RecordBatch.from_arrays([pa.array([shard[i] for i, _ in parts], pa.int32()), pa.array(rows, pa.binary())], schema=_BLOCK)


def reduce_shards(blocks: DataFrame, function, schema: str) -> DataFrame:
    """``function(shard, packed rows) -> record batch`` for each shard."""

    def run(key, table):
        made = function(key[0].as_py(), table.column("data").to_pylist())
        return pa.Table.from_batches([made])

    return blocks.groupBy("shard").applyInArrow(run, schema)


def hash_words(words: list[bytes], known: dict[bytes, int], most: int = 1 << 17, longest: int = 64) -> np.ndarray:
    """A 64-bit hash for each word; ``known`` is the task's cache of words that are not long, emptied when it is full."""
    if len(known) > most:
        known.clear()
    digest = xxhash.xxh3_64_intdigest
    out = np.empty(len(words), np.uint64)
    get = known.get
    for i, word in enumerate(words):
        h = get(word)
        if h is None:
            h = digest(word)
            if len(word) <= longest:
                known[word] = h
        out[i] = h
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Mapped:
    """Sorted key files ``{folder}/{name}-{shard}.npy`` and arrays beside them, opened when used."""

    def __init__(self, folder: str, bits: int, key: str = "keys"):
        self.folder, self.bits, self.key, self.open = folder, bits, key, {}

    def array(self, name: str, shard: int) -> np.ndarray:
        at = name, shard
        if at not in self.open:
            path = f"{self.folder}/{name}-{shard}.npy"
            # A shard that got no key has no file.
            self.open[at] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.empty(0, np.uint64)
        return self.open[at]

    def find(self, keys: np.ndarray, *names: str) -> list[np.ndarray]:
        """Whether each key is there, and what the named arrays hold for it (0 if absent).

        ``keys`` must be sorted: each shard is then searched once, front to back.
        """
        found = np.zeros(len(keys), bool)
        out: list[np.ndarray | None] = [None] * len(names)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        for i, j in runs(shard):
            have = self.array(self.key, int(shard[i]))
            if not len(have):
                continue
            at = np.minimum(np.searchsorted(have, keys[i:j]), len(have) - 1)
            hit = have[at] == keys[i:j]
            found[i:j] = hit
            for k, name in enumerate(names):
                values = self.array(name, int(shard[i]))
                if out[k] is None:
                    out[k] = np.zeros(len(keys), values.dtype)
                out[k][i:j][hit] = values[at[hit]]
        return [found, *(np.zeros(len(keys), np.int64) if x is None else x for x in out)]
