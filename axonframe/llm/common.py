"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import stored


#: Bytes of a batch of rows that a Python worker gets at once, where the session leaves this at Spark's default of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; batches of whole texts to Python workers are kept small from now on, as each is held at both ends."""
    if spark.conf.get(_BATCH) in ("64MB", "67108864b", str(64 << 20)):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it as long as a column of that name is there."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


#: A table goes to all executors only if its rows take so many bytes at most; else it is joined by shuffling.
MOST_BROADCAST = 16 << 20


def sized(table: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for a broadcast if its rows, counted, stay under the bound."""
    return F.broadcast(table) if table.count() * row_bytes <= MOST_BROADCAST else table


#: Bits of the map that :func:`sieved` sends to all executors, in rows of 64.
SIEVE = 1 << 24


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key``, a hash, is none of ``wanted``: what a join that has to shuffle needn't move."""
    slot = F.pmod(F.col(key), F.lit(SIEVE))
    word, bit = F.shiftright(slot, 6).alias("_word"), F.pmod(slot, F.lit(64)).cast("int")
    words = wanted.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(stored(words, "sieve")), "_word")
    return found.where(F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(1) == 1).drop("_word", "_bits")


def slices_of(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``most_bytes``, at least a row each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end



try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


#: What workers keep between tasks, by operator: each has a method ``clear``.
CACHES: list = []


def tidy(own=None) -> None:
    """Give memory back to the system that is free, or kept for other operators than ``own``: workers live on after a task, beside others on the same executor."""
    for cache in CACHES:
        if cache is not own:
            cache.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Forest:
    """Union-find over 0..n-1 that takes whole arrays of pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if len(a):
                np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def all_roots(self) -> np.ndarray:
        self.parent = self.roots(np.arange(len(self.parent)))
        return self.parent
