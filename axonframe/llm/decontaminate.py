"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

An item is far smaller than a document, so that MinHash values of both hardly ever
agree. Containment is told by those of the item alone: its sketch is the few of its
shingles that come first in the order of a hash, a random choice, and a document that
holds most of the item holds one of them. Items are partitioned by size, and each size
has the length of sketch that makes a miss unlikely enough, or impossible.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of, stored, tidy
from .substring import _mix, rolling

SHINGLE = 5
THRESHOLD = 0.8
#: Chance at most that a document over the threshold holds nothing of an item's sketch.
MISS = 1e-9
#: Words of a block of items that a task holds at once.
BLOCK_SHINGLES = 200_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; case folds as in Unicode."""
    return (text or b"").decode("utf-8", "replace").lower().encode().split()


def shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Hashes of every n words; of fewer words than n, of the whole sequence; of none, none."""
    return grams(words, (min(n, len(words)),))[0] if words else np.zeros(0, np.uint64)


def grams(words: list[bytes], lengths: tuple[int, ...]) -> list[np.ndarray]:
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return [x ^ np.uint64(k) for x, k in zip(rolling(h, lengths), lengths)]


@cache
def sketch_size(size: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Shingles that a sketch of an item of ``size`` needs so that a document with ``threshold`` of the item holds one of them but for a chance of ``miss``.

    A document lacks ``size`` - ceil(threshold * size) shingles at most: of one more than these it holds one for sure.
    """
    lacking = size - math.ceil(threshold * size - 1e-9)
    chance, k = 1.0, 0
    while k <= lacking and chance > miss:
        chance *= (lacking - k) / (size - k)
        k += 1
    return k


@dataclass
class Index:
    """A block of benchmark items: their shingles, and their sketches by size."""

    ids: list
    sets: list[np.ndarray]
    threshold: float
    #: Word counts of items too short for a shingle: they count as one of their own length.
    short: frozenset

    def __post_init__(self):
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(self.sets)
        self.sets = []
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.lexsort([_mix(self.flat ^ _SEED), owner])
        length = np.zeros(len(self.sizes), dtype=np.int64)
        for size in np.unique(self.sizes):
            length[self.sizes == size] = sketch_size(int(size), self.threshold)
        order = order[np.arange(len(order)) - self.starts[owner] < length[owner]]
        order = order[np.argsort(self.flat[order], kind="stable")]
        self.keys, self.items = self.flat[order], owner[order]
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.keys >> np.uint64(44)] = True

    def search(self, words: list[bytes]) -> Iterator[tuple]:
        """(item id, containment) of the items of which ``words`` hold enough shingles."""
        lengths = tuple(k for k in {SHINGLE, *self.short} if k <= len(words))
        if not lengths:
            return
        held = grams(words, lengths)
        maybe = np.unique(np.concatenate([x[self.filter[x >> np.uint64(44)]] for x in held]))
        found = np.unique(self.items[_matches(self.keys, maybe)[1]])
        if not len(found):
            return
        every = np.unique(np.concatenate(held))
        for at in range(0, len(found), 4096):
            some = found[at : at + 4096]
            n = self.sizes[some]
            ends = np.cumsum(n)
            flat = self.flat[np.repeat(self.starts[some] - (ends - n), n) + np.arange(ends[-1])]
            place = np.minimum(np.searchsorted(every, flat), len(every) - 1)
            share = np.add.reduceat(every[place] == flat, ends - n, dtype=np.int64) / n
            for i in np.flatnonzero(share >= self.threshold - 1e-12):
                yield self.ids[some[i]], float(share[i])


def _matches(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``keys`` of each of ``wanted``: (index of wanted, place)."""
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    n = hi - lo
    which = np.repeat(np.arange(len(wanted)), n)
    return which, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _index(rows: list[tuple], threshold: float) -> Index | None:
    made = [(i, words_of(t)) for i, t in rows]
    made = [(i, w) for i, w in made if w]
    if not made:
        return None
    short = frozenset(len(w) for _, w in made if len(w) < SHINGLE)
    return Index([i for i, _ in made], [np.unique(shingles(w)) for _, w in made], threshold, short)


def find_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, text_hash, item_id, containment) of documents that hold at least ``threshold`` of an item's distinct shingles.

    ``benchmark`` (item_id, text) is read in blocks of bounded size, each sent to all
    executors for a pass over the documents; with several, the result of each is
    stored before the next is read. Texts are lower-cased and cut at white space; a
    shingle is five words; an item of fewer words counts as one shingle of its length,
    found anywhere in a document. Null or empty items and documents match nothing. Null
    ids stay null; items or documents that repeat give a row each; other columns are
    ignored; empty tables give an empty table.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_hash", F.xxhash64("text"))
    schema = "doc_id long, text_hash long, item_id long, containment double"

    def found_by(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in slices_of(batch, "text"):
                    rows, items, shares = [], [], []
                    for i, text in enumerate(part.column("text").cast(pa.large_binary())):
                        for item, share in index.search(words_of(text.as_py())):
                            rows.append(i), items.append(item), shares.append(share)
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(items, pa.int64()), pa.array(shares, pa.float64())],
                        ["doc_id", "text_hash", "item_id", "containment"],
                    )
            tidy()

        return named.mapInArrow(run, schema)

    out: list[DataFrame] = []
    for index in _blocks(benchmark, threshold):
        if len(out) == 1:
            out[0] = stored(out[0], "items")
        out.append(found_by(index))
        if len(out) > 1:
            out[-1] = stored(out[-1], "items")
    every = out[0] if out else spark.createDataFrame([], schema)
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def _blocks(benchmark: DataFrame, threshold: float) -> Iterator[Index]:
    block, held = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        block.append((item_id, text.encode()))
        held += text.count(" ") + 1
        if held >= BLOCK_SHINGLES:
            if index := _index(block, threshold):
                yield index
            block, held = [], 0
    if index := _index(block, threshold):
        yield index
