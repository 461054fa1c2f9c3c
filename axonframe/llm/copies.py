"""Near copies by five-word shingles: SimHash with Golay keys and bands of MinHash find candidates, exact similarity decides.

The SimHash of distinct words has 92 bits in four segments of 23. Two fingerprints
are candidates if two segments share a codeword number each and 18 bits differ at
most. By pigeonhole two segments always do if 8 bits differ at most (else three
segments had three errors each). Texts cut short or extended at 0.8 of their shingles
differ in up to 25 bits, so this alone does not find all of them.

The bands do: each is a hash of ROWS least values of the shingle set, which two sets
share with a chance of similarity**ROWS whatever the edit is. All BANDS miss a pair
at exactly 0.8 with a chance of (1 - 0.8**4)**40, under one in a billion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, sieved, sized, slices_of, stored, tidy
from .components import connected_components
from .simhash import BLOCK, _dealt, _edges, _hot, _majority, fuzzy_keys
from .substring import rolling

SIMILARITY = 0.8
SHINGLE = 5
SEGMENT = 23
SEGMENTS = 4
BITS = 18
#: Bands of a shingle set, and least values in each.
BANDS, ROWS = 40, 4
_ODD = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)[:, None] | np.uint64(1)
#: Nodes of a bucket that a task deals by their second keys itself; those of a larger one are dealt anew by shuffling.
HELD = 1 << 16
#: Documents, and their shingles, of a block when a group of candidates is compared in pairs of blocks; and documents
#: compared at once as one matrix product.
BLOCK_DOCS, BLOCK_SHINGLES, TILE = 1 << 14, 1 << 20, 512
#: Candidates that shared rare shingles give, as a share of all pairs, beyond which all pairs are compared.
DENSE = 1 / 64


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingle_set(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of n words; of fewer words, of the whole sequence."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.unique(rolling(h, (min(n, len(words)),))[0] ^ np.uint64(min(n, len(words)))) if words else np.zeros(1, np.uint64)


def word_fingerprint(words: list[bytes]) -> tuple[int, int]:
    """92 bits, 64 and 28, that most distinct words have."""
    if not words:
        return 0, 0
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, set(words))), dtype=np.uint64).reshape(-1, 2)
    return int(_majority(h[:, 0])), int(_majority(h[:, 1])) & ((1 << 28) - 1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of a shingle set: its number and least values, hashed."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (_ODD * shingles[at : at + 1024]).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(bands)], dtype=np.uint64)


def _segments(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SEGMENT) - 1)
    third = (lo >> np.uint64(46)) | ((hi & np.uint64(31)) << np.uint64(18))
    return [x.astype(np.uint32) for x in (lo & mask, (lo >> np.uint64(23)) & mask, third & mask, (hi >> np.uint64(5)) & mask)]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, lo, hi, bands = [], [], [], []
        for t in batch.column("text").cast(pa.large_binary()):
            words = words_of(t.as_py())
            node.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            a, b = word_fingerprint(words)
            lo.append(a), hi.append(b), bands.append(band_keys(shingle_set(words)).view(np.int64))
        made = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, lo, hi)]
        made.append(pa.array(bands, pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rk1", "rk2")), *made], ["doc_id", "rk1", "rk2", "node", "lo", "hi", "bands"])
    tidy()


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each codeword number of all segments but the last."""
    for batch in batches:
        node, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "lo", "hi"))
        parts = _segments(lo.view(np.uint64), hi.view(np.uint64))
        for i in range(SEGMENTS - 1):
            keys = fuzzy_keys(parts[i]).astype(np.int64)
            fresh = np.ones(keys.shape, dtype=bool)
            fresh[:, 1:] = keys[:, 1:] != keys[:, :1]
            r, c = np.nonzero(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(np.int64(i) << 12 | keys[r, c]), pa.array(node[r]), pa.array(lo[r]), pa.array(hi[r])], ["key", "node", "lo", "hi"])


def _second_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a large bucket once more for each codeword number of each later segment."""
    for batch in batches:
        key, node, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "lo", "hi"))
        parts = _segments(lo.view(np.uint64), hi.view(np.uint64))
        for j in range(1, SEGMENTS):
            at = np.flatnonzero(key >> 12 < j)
            keys = fuzzy_keys(parts[j][at]).astype(np.int64)
            fresh = np.ones(keys.shape, dtype=bool)
            fresh[:, 1:] = keys[:, 1:] != keys[:, :1]
            r, c = np.nonzero(fresh)
            full = np.int64(1) << 40 | key[at[r]] << 16 | np.int64(j) << 12 | keys[r, c]
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(node[at[r]]), pa.array(lo[at[r]]), pa.array(hi[at[r]])], ["key", "node", "lo", "hi"])


def _by_second_key(block: int):
    """Places of a bucket of over ``block`` nodes that share a codeword number of a later segment too."""

    def parts(key: int, words: list[np.ndarray]) -> Iterator[np.ndarray]:
        for segment in _segments(*words)[int(key >> 12) + 1 :]:
            rows, numbers = [], []
            for at in range(0, len(segment), 1 << 14):
                keys = fuzzy_keys(segment[at : at + (1 << 14)])
                fresh = np.ones(keys.shape, dtype=bool)
                fresh[:, 1:] = keys[:, 1:] != keys[:, :1]
                r, c = np.nonzero(fresh)
                rows.append(r + at), numbers.append(keys[r, c])
            row, number = np.concatenate(rows), np.concatenate(numbers)
            order = np.argsort(number, kind="stable")
            row, number = row[order], number[order]
            yield from (x for x in np.split(row, np.flatnonzero(number[1:] != number[:-1]) + 1) if len(x) > 1)

    return lambda key, words: parts(key, words) if len(words[0]) > block else None


def _two_shared(words: list[np.ndarray]):
    """A test of pairs of places: whether two segments of their fingerprints share a codeword number each."""
    keys = [fuzzy_keys(s) for s in _segments(*words)]

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(a), dtype=np.int8)
        for k in keys:
            x, y = k[a], k[b]
            shared += np.any([x[:, c, None] == y for c in range(6)], axis=(0, 2))
        return shared >= 2

    return test


def candidates(nodes: DataFrame, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """Edges (a, b) that hold all candidates among ``nodes`` (node, lo, hi) together.

    A bucket of one codeword number is compared in a task. Of one of over ``block``
    nodes the task compares those that share a second number too. One of over ``held``
    is dealt anew by the second number, a row for each, and if that bucket too is
    large, in pairs of blocks: the candidates are the same.
    """
    names = ("node", "lo", "hi")
    schema = "key long, node long, lo long, hi long"
    keyed = nodes.select(*names).mapInArrow(_first_keys, schema)
    hot = _hot(keyed, held)
    plain, large = keyed, None
    if hot.head(1):
        plain = keyed.join(hot, "key", "left_anti")
        large = keyed.join(hot, "key", "left_semi").mapInArrow(_second_keys, schema)
    none = hot.where("false")
    out = _edges(_dealt(plain, names, none), BITS, names, _two_shared, _by_second_key(block))
    return out if large is None else out.unionByName(_edges(_dealt(large, names, _hot(large, block)), BITS, names))


def banded(marked: DataFrame) -> DataFrame:
    """Edges (a, b) from each node of ``marked`` (node, bands) to the least that shares a band with it."""
    keyed = marked.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    low = stored(shared.select("key", "low"), "bands")
    return keyed.join(sized(low, 16), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices_of(batch, "text", 2 << 20):
            sets = [shingle_set(words_of(t.as_py())).view(np.int64) for t in part.column("text").cast(pa.large_binary())]
            column = pa.array(sets, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "cid")), column], ["node", "cid", "shingles"])
    tidy()


def _tiles(owner: np.ndarray, code: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Similar pairs of documents, all compared with all, in tiles. ``owner`` rises."""
    starts = np.searchsorted(owner, np.arange(0, len(sizes) + TILE, TILE))
    for s in range(len(starts) - 1):
        for t in range(s + 1):
            c = np.concatenate([code[starts[s] : starts[s + 1]], code[starts[t] : starts[t + 1]]])
            o = np.concatenate([owner[starts[s] : starts[s + 1]] - s * TILE, owner[starts[t] : starts[t + 1]] - t * TILE + TILE])
            c = np.unique(c, return_inverse=True)[1]
            order = np.argsort(c, kind="stable")
            c, o = c[order], o[order]
            left, right = sizes[s * TILE : (s + 1) * TILE], sizes[t * TILE : (t + 1) * TILE]
            shared, width = np.zeros((len(left), len(right))), 4096
            for at in range(0, int(c[-1]) + 1 if len(c) else 0, width):
                lo, hi = np.searchsorted(c, (at, at + width))
                part = np.zeros((2 * TILE, width), dtype=np.float32)
                part[o[lo:hi], c[lo:hi] - at] = 1
                shared += part[: len(left)] @ part[TILE : TILE + len(right)].T
            i, j = np.nonzero(shared >= similarity * (left[:, None] + right[None, :] - shared) - 1e-9)
            yield i + s * TILE, j + t * TILE


def _verified(i: np.ndarray, j: np.ndarray, owner: np.ndarray, code: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The similar ones of pairs of documents; ``owner`` rises, and ``code`` within it."""
    span = np.int64(code.max()) + 1
    held, first = owner * span + code, np.concatenate([[0], np.cumsum(sizes)])
    pair = np.repeat(np.arange(len(i)), sizes[i])
    at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[i]) - sizes[i], sizes[i]) + first[i][pair]
    want = j[pair] * span + code[at]
    place = np.minimum(np.searchsorted(held, want), len(held) - 1)
    shared = np.bincount(pair, held[place] == want, len(i))
    near = shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[near], j[near]


def _rare_first(owner: np.ndarray, code: np.ndarray, times: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents in order of a shingle, for those shingles of which similar documents share one at least.

    With all shingles in one order, rarest first, two documents that share so many of them share
    one of the first few of each: of all but as many, less one, as they have to share.
    """
    order = np.lexsort((code, times[code], owner))
    c, o = code[order], owner[order]
    place = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = (place < (sizes - np.ceil(similarity * sizes - 1e-6) + 1)[o]) & (times[c] > 1)
    c, o = c[first], o[first]
    order = np.argsort(c, kind="stable")
    return c[order], o[order]


def _pairs(similarity: float):
    """All pairs of a block, or of two: edges between documents of different clusters that are similar enough.

    Pairs are looked for by their rarest shingles; where these say little, all are compared.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s) for s in frame["shingles"]]
        node, cluster, side = (frame[c].to_numpy() for c in ("node", "cluster", "side"))
        two = frame["left"].iloc[0] != frame["right"].iloc[0]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        code = code[np.lexsort((code, owner))]
        forest = Forest(len(node))

        def apart(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (i != j) & (cluster[i] != cluster[j])
            if two:
                ok &= side[i] != side[j]
            return i[ok], j[ok]

        c, o = _rare_first(owner, code, times, sizes, similarity)
        ends = np.append(np.flatnonzero(c[1:] != c[:-1]) + 1, len(c)) if len(c) else np.zeros(0, dtype=np.int64)
        lists = np.diff(ends, prepend=0)
        if (lists * (lists - 1) // 2).sum() > DENSE * len(sets) * len(sets) / 2 + (1 << 12):
            repeated = times[code] > 1
            for i, j in _tiles(owner[repeated], code[repeated], sizes, similarity):
                forest.join(*apart(i, j))
        else:
            places = np.repeat(ends, lists) - np.arange(len(c)) - 1  # documents after it in its list
            at = np.repeat(np.arange(len(c)), places)
            other = np.arange(len(at)) - np.repeat(np.cumsum(places) - places, places) + at + 1
            i, j = apart(o[at], o[other])
            found = np.unique(np.minimum(i, j) * np.int64(len(sets)) + np.maximum(i, j))
            i, j = found // len(sets), found % len(sets)
            fits = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-6
            i, j = i[fits], j[fits]
            ends = np.cumsum(sizes[i]) // (1 << 20)
            for some in np.split(np.arange(len(i)), np.flatnonzero(ends[1:] != ends[:-1]) + 1) if len(i) else ():
                forest.join(*_verified(i[some], j[some], owner, code, sizes, similarity))
        root = forest.all_roots()
        own = np.flatnonzero(root != np.arange(len(root)))
        del sets, owner, code, times, c, o
        tidy()
        return pd.DataFrame({"a": node[own], "b": node[root[own]]})

    return run


def similar(sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK_DOCS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Edges that hold all similar documents of each group of ``sets`` (cid, node, shingles) together.

    Every document is compared with the least of its group. Groups that this leaves
    in parts are compared further in pairs of blocks of ``block`` documents or about
    ``shingles`` shingles, but for pairs of blocks that the first step has joined already.
    """
    pivots = sets.groupBy("cid").agg(F.min("node").alias("pivot"))
    pivots = pivots.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("of")), "pivot")
    common = F.size(F.array_intersect("shingles", "of"))
    joined = stored(sets.join(pivots, "cid").select("cid", "node", "pivot", F.size("shingles").alias("n"), (common >= similarity * (F.size("shingles") + F.size("of") - common) - 1e-9).alias("joined")), "compared")
    blocks = lambda test: F.ceil(F.greatest(F.count_if(test) / block, F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)) / shingles)).cast("int")
    counts = joined.groupBy("cid").agg(blocks(F.col("joined")).alias("ns"), blocks(~F.col("joined")).alias("nu")).where("nu > 0")
    counts = stored(counts, "open-groups")
    ns, nu = F.col("ns"), F.col("nu")
    at = F.pmod(F.xxhash64("node"), F.when(F.col("joined"), ns).otherwise(nu)).cast("int")
    one = lambda k, left, right, side: F.struct(k.alias("kind"), left.alias("left"), right.alias("right"), side.cast("int").alias("side"))
    # parts that are not joined yet among themselves, and against the blocks of those that are
    own = F.transform(F.sequence(F.lit(0), nu - 1), lambda k: one(F.lit(0), F.least(k, F.col("at")), F.greatest(k, F.col("at")), F.col("at") > k))
    across = F.transform(F.sequence(F.lit(0), nu - 1), lambda k: one(F.lit(1), F.col("at"), -1 - k, F.lit(0)))
    back = F.transform(F.sequence(F.lit(0), ns - 1), lambda k: one(F.lit(1), k, -1 - F.col("at"), F.lit(1)))
    places = F.when(F.col("joined"), across).otherwise(F.concat(own, back))
    rest = (
        joined.join(counts, "cid").withColumn("at", at)
        .select("cid", "node", F.when(F.col("joined"), F.col("pivot")).otherwise(F.col("node")).alias("cluster"), F.explode(places).alias("p"))
        .select("cid", "node", "cluster", "p.*")
    )
    dealt = rest.join(sets.select("cid", "node", "shingles"), ["cid", "node"])
    found = dealt.groupBy("cid", "kind", "left", "right").applyInPandas(_pairs(similarity), "a long, b long")
    return joined.where("joined").select(F.col("node").alias("a"), F.col("pivot").alias("b")).unionByName(found)


def row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with rk1 and rk2, together 128 bits that name a row's id and text."""
    return docs.withColumns({"rk1": F.xxhash64("doc_id", "text"), "rk2": F.xxhash64("text", F.lit("second"), "doc_id")})


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, rk1, rk2 and the ``component`` of near copies it belongs to.

    Texts are lower-cased (A-Z) and cut at white space. Two are linked if at least
    ``similarity`` of their distinct five-word shingles, taken together, are common;
    texts equal but for case and white space always are, empty and null ones
    included. Ids may be null or repeated; other columns are ignored; an empty
    table gives an empty table.
    """
    named = row_keys(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    marked = stored(named.mapInArrow(_mark, "doc_id long, rk1 long, rk2 long, node long, lo long, hi long, bands array<long>"), "marked")
    nodes = marked.groupBy("node").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min(F.struct("rk1", "rk2")).alias("first"))
    nodes = stored(nodes.select("node", "lo", "hi", "first.rk1", "first.rk2"), "nodes")
    loose = connected_components(candidates(nodes).unionByName(banded(marked)))
    wanted = stored(nodes.join(loose, "node").select("node", "rk1", "rk2", F.col("component").alias("cid")), "wanted")
    texts = sieved(named, wanted, "rk1").join(sized(wanted, 48), ["rk1", "rk2"]).select("node", "cid", "text")
    sets = stored(texts.mapInArrow(_sets, "node long, cid long, shingles array<long>"), "sets")
    sets = sets.dropDuplicates(["node"]) if _repeats(marked) else sets
    joined = connected_components(similar(sets, similarity))
    return marked.join(joined, "node", "left").select("doc_id", "rk1", "rk2", F.coalesce("component", "node").alias("component"))


def _repeats(marked: DataFrame) -> bool:
    """Whether any row of the input is there more than once."""
    return bool(marked.groupBy("rk1", "rk2").count().where("count > 1").head(1))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with one document of each group of near copies: that of the least doc_id.

    Of rows that share it the least hash of the row stays; a null id counts as least.
    Rows of equal id and text count as one document. See :func:`groups`.
    """
    found = stored(groups(docs, similarity), "groups")
    best = found.groupBy("component").agg(F.min(F.struct("doc_id", "rk1", "rk2")).alias("best")).select("best.rk1", "best.rk2", F.lit(True).alias("stays"))
    gone = stored(found.select("rk1", "rk2").distinct().join(best, ["rk1", "rk2"], "left").where("stays is null").select("rk1", "rk2"), "gone")
    i, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    named = docs.select(F.struct("*").alias("row"), F.xxhash64(i, t).alias("rk1"), F.xxhash64(t, F.lit("second"), i).alias("rk2"))
    kept = named.join(sized(gone, 16), ["rk1", "rk2"], "left_anti")
    kept = kept.dropDuplicates(["rk1", "rk2"]) if _repeats(found) else kept
    return kept.select("row.*")
