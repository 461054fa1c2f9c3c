"""SimHash fingerprints and near-duplicate groups by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, stored, tidy
from .components import connected_components

#: Bit positions (first, count) of the three segments of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the perfect binary Golay code of length 23.
GOLAY_GENERATOR = 0b101011100011
#: Distinct fingerprints that a task compares at once; a larger bucket is dealt out as pairs of blocks.
BLOCK = 4096


@cache
def golay_decoder() -> np.ndarray:
    """For each 23-bit word the number of the one codeword within three bits."""
    words = np.zeros(1, dtype=np.uint32)
    for bit in range(12):
        words = np.concatenate([words, words ^ np.uint32(GOLAY_GENERATOR << bit)])
    ones = [1 << i for i in range(23)]
    errors = [0] + ones + [a | b for i, a in enumerate(ones) for b in ones[:i]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    table = np.empty(1 << 23, dtype=np.uint16)
    for e in errors:
        table[words ^ np.uint32(e)] = np.arange(4096, dtype=np.uint16)
    return table


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """The codeword numbers of each word and of its 23 one-bit neighbours.

    Words at most two bits apart have a neighbour in common and so share a number.
    A row holds at most six different numbers; repeats stand in place of the rest.
    """
    table = golay_decoder()
    near = np.stack([table[words]] + [table[words ^ np.uint32(1 << i)] for i in range(23)], axis=1)
    near.sort(axis=1)
    fresh = np.ones(near.shape, dtype=bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    at = np.minimum(np.cumsum(fresh, axis=1) - 1, 5)
    out = np.repeat(near[:, :1], 6, axis=1)
    np.put_along_axis(out, at, near, axis=1)
    return out


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fingerprints, key), each pair once.

    Of two fingerprints that differ in two bits at most, one of the three segments
    is equal and the others differ in two bits at most each: pigeonhole. A key is
    an equal segment with a codeword number of the segment after it.
    """
    rows, keys = [], []
    parts = [((fingerprints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.uint32) for s, n in SEGMENTS]
    for i in range(3):
        fuzzy = fuzzy_keys(parts[(i + 1) % 3])
        key = (np.int64(i) << 40 | parts[i].astype(np.int64) << 12)[:, None] | fuzzy
        fresh = np.ones(key.shape, dtype=bool)
        fresh[:, 1:] = key[:, 1:] != key[:, :1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(key[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype=np.uint64)
    return int(_majority(h))


_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]
_LOW = np.uint64(0x0101010101010101)


def _majority(h: np.ndarray) -> np.uint64:
    """Bits that over half of the hashes have; counted in byte lanes, 255 hashes at a time."""
    ones = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, len(h), 255 * 64):
        lanes = (h[at : at + 255 * 64] >> _SHIFTS) & _LOW
        sums = np.add.reduceat(lanes, np.arange(0, lanes.shape[1], 255), axis=1)
        ones += sums.view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64)
    shift, lane = np.nonzero(ones * 2 > len(h))
    return np.bitwise_or.reduce(np.uint64(1) << (lane * 8 + shift).astype(np.uint64), initial=np.uint64(0))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id and ``fp``, the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _near(a: list[np.ndarray], b: list[np.ndarray], bits: int) -> np.ndarray:
    return sum(np.bitwise_count(x[:, None] ^ y[None, :]).astype(np.int16) for x, y in zip(a, b)) <= bits


def _forest(node: np.ndarray, words: list[np.ndarray], n: int, bits: int, also) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that hold the links together: among all if ``n`` is 0, else between the first ``n`` and the others.

    ``words`` are the parts of the fingerprints. ``also`` makes of them a test that
    near pairs of places have to pass; those joined already are not tested.
    """
    forest = Forest(len(node))
    test = also(words) if also else None
    right, left = [w[n:] for w in words], [w[: n or len(node)] for w in words]
    step = max(1, (1 << 18) // max(1, len(right[0])))
    for at in range(0, len(left[0]), step):
        i, j = np.nonzero(_near([w[at : at + step] for w in left], right, bits))
        i, j = i + at, j + n
        apart = node[i] != node[j]
        i, j = i[apart], j[apart]
        for some in range(0, len(i), 1 << 15):
            a, b = i[some : some + (1 << 15)], j[some : some + (1 << 15)]
            if test is not None:
                apart = forest.roots(a) != forest.roots(b)
                a, b = a[apart], b[apart]
                yes = test(a, b)
                a, b = a[yes], b[yes]
            forest.join(a, b)
    root = forest.all_roots()
    own = np.flatnonzero(root != np.arange(len(root)))
    if len(own):
        yield node[own], node[root[own]]


def _compare(bits: int, names: tuple[str, ...], also=None, within=None):
    """Rows in order of key, left, right and side to edges within each group; ``names``: the node and the words of its fingerprint.

    ``within(key, words)`` may give arrays of places, of which each is compared by itself, in place of the whole group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "left", "right", "side", *names)]
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)] if held else cols
            group = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            done = group[-1] if len(group) else 0
            yield from _groups([c[:done] for c in cols], bits, also, within)
            held = [c[done:] for c in cols]
        if held:
            yield from _groups(held, bits, also, within)
        tidy()

    return run


def _groups(cols: list[np.ndarray], bits: int, also, within=None) -> Iterator[pa.RecordBatch]:
    key, left, right, side, node = cols[:5]
    words = [c.view(np.uint64) for c in cols[5:]]
    if not len(key):
        return
    bounds = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1, [len(key)]])
    out_a, out_b = [], []
    for at, n in zip(bounds[:-1], np.diff(bounds)):
        if n > 1:
            here = slice(at, at + n)
            parts = within(key[at], [w[here] for w in words]) if within else None
            if parts is not None:
                forest = Forest(n)
                for places in parts:
                    for a, b in _forest(places, [w[here][places] for w in words], 0, bits, None):
                        forest.join(a, b)
                root = forest.all_roots()
                own = np.flatnonzero(root != np.arange(n))
                out_a.append(node[here][own])
                out_b.append(node[here][root[own]])
                continue
            first = 0 if left[at] == right[at] else int((side[here] == 0).sum())
            if first == n:
                continue
            for a, b in _forest(node[here], [w[here] for w in words], first, bits, also):
                out_a.append(a)
                out_b.append(b)
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def _dealt(keyed: DataFrame, names: tuple[str, ...], hot: DataFrame) -> DataFrame:
    """Rows of (key, *names) with the pair of blocks that they are compared in; only keys of ``hot`` (key, blocks) have more than one."""
    none = F.lit(0).cast("int")
    if not hot.head(1):
        return keyed.select("key", none.alias("left"), none.alias("right"), none.alias("side"), *names)
    at = F.pmod(F.xxhash64(names[0]), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")),
        lambda k: F.struct(F.least(k, F.col("at")).alias("left"), F.greatest(k, F.col("at")).alias("right"), F.when(F.col("at") > k, 1).otherwise(0).alias("side")),
    )
    alone = F.array(F.struct(none.alias("left"), none.alias("right"), none.alias("side")))
    return (
        keyed.join(hot, "key", "left")
        .withColumn("at", at)
        .select("key", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)).alias("p"), *names)
        .select("key", "p.left", "p.right", "p.side", *names)
    )


def _hot(keyed: DataFrame, block: int) -> DataFrame:
    return stored(keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks")), "hot-keys")


def _edges(dealt: DataFrame, bits: int, names: tuple[str, ...], also=None, within=None) -> DataFrame:
    ordered = dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "side")
    return ordered.mapInArrow(_compare(bits, names, also, within), "a long, b long")


def near_links(distinct: DataFrame, bits: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all fingerprints of ``distinct`` (fp) linked by at most ``bits`` differing bits (0 to 2).

    A bucket of at most ``block`` fingerprints is compared in a task. A larger one
    is cut into blocks by hash, and every pair of its blocks is a task of its own:
    no bucket is capped. Each task returns a spanning forest, not pairs.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the keys guarantee two differing bits at most")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                rows, keys = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(explode, "key long, fp long")
    names = ("node", "fp")
    keyed = keyed.withColumn("node", F.col("fp"))
    return _edges(_dealt(keyed, names, _hot(keyed, block)), bits, names)


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """SimHash groups of ``docs``: one row per document.

    Takes doc_id and text; other columns are ignored. Returns doc_id, fingerprint
    (16 hex digits) and component_id, the smallest doc_id that links reach. Nulls:
    a null text counts as empty; empty texts have fingerprint zero and link like
    any other; a null doc_id keeps its row and never is a component_id unless the
    whole group has no id (then null). Repeated rows come back as often as they came.
    An empty table gives an empty table.
    """
    marked = stored(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = connected_components(near_links(distinct, bits))
    grouped = stored(distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component")), "grouped")
    least = stored(grouped.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    named = grouped.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
