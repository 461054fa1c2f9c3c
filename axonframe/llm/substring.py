"""Removal of word sequences that occur more than once: Rabin-Karp windows counted in Spark.

Every window of ``window`` consecutive words has a Rabin-Karp hash. Counting all of
them one row each would move the corpus many times over, so the windows travel in
runs: the windows in a row that share their *anchor*, the lowest hash among the
``gram``-word sequences inside them. Equal windows have equal anchors at equal
places, so dealing runs out by anchor brings all copies of a window together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices_of, stored, tidy

WINDOW = 35
GRAM = 8
#: Base of the polynomial modulo 2**64, odd, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(words: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Rabin-Karp hashes of every ``length`` words from each place on, for each length."""
    n = len(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(INVERSE, n), dtype=np.uint64)])
    up = _powers(BASE, n)
    return [_mix((sums[k:] - sums[:-k]) * up[: n + 1 - k]) if n >= k else np.zeros(0, np.uint64) for k in lengths]


def _anchors(gram: np.ndarray, span: int) -> np.ndarray:
    """For each place the first place of the lowest of ``span`` values from there on."""
    low, at, width = gram, np.arange(len(gram), dtype=np.int64), 1
    while width < span:
        step = min(width, span - width)
        nxt = low[step:]
        less = nxt < low[: len(nxt)]
        low, at, width = np.where(less, nxt, low[: len(nxt)]), np.where(less, at[step:], at[: len(nxt)]), width + step
    return at


def _runs(flag: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of flagged neighbours of one group."""
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on
    cut = np.flatnonzero((np.diff(on) != 1) | (np.diff(group[on]) != 0)) + 1
    return on[np.concatenate([[0], cut])], on[np.concatenate([cut - 1, [len(on) - 1]])]


#: Bytes of a window's hash that travel; the anchor they travel with has 64 bits more.
WIDTH = 6
#: An anchor of more runs than this is hot: its windows are dealt out by their own hash.
HOT_RUNS = 1 << 13
#: Hot anchors at most, which all tasks get; with so many runs in all that there could be more, HOT_RUNS grows.
MOST_HOT = 1 << 22
#: Windows of one key that a task holds before it drops those that it has told already.
HELD_WINDOWS = 1 << 16


def _emit(key, row, lo, n, wh, ids, hashes) -> pa.RecordBatch:
    """Runs, each with the hashes of its windows; without ``wh`` spans that need no counting."""
    if wh is not None:
        offsets = np.concatenate([[0], np.cumsum(n)]) * WIDTH
        low = np.ascontiguousarray(wh.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])
        blobs = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(low)])
    else:
        blobs = pa.nulls(len(key), pa.binary())
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), ids.take(take), hashes.take(take), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), blobs],
        ["key", "doc_id", "text_hash", "lo", "n", "windows"],
    )


class _Windows:
    """The windows of a chunk of texts, and the runs of those in a row that share an anchor."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        words = [(t or b"").split() for t in texts.cast(pa.large_binary()).to_pylist()]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.any = bool((sizes >= window).any())
        if not self.any:
            return
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), dtype=np.uint64, count=int(sizes.sum()))
        del words
        grams, whole = rolling(h, (gram, window))
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)[: len(whole)]
        at = np.flatnonzero(np.arange(len(whole)) + window <= ends[doc])
        anchor = _anchors(grams, window - gram + 1)[at]
        self.hash, self.doc = whole[at], doc[at]
        self.place = at - (ends - sizes)[self.doc]
        start = np.ones(len(at), dtype=bool)
        start[1:] = (anchor[1:] != anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.begin = np.flatnonzero(start)
        self.n = np.diff(np.concatenate([self.begin, [len(at)]]))
        self.key = grams[anchor[self.begin]]


def _count_anchors(window: int, gram: int):
    """Documents to anchors with their number of runs in a chunk; key null: of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, "text", CHUNK_BYTES):
                w = _Windows(part.column("text"), window, gram)
                if w.any:
                    key, count = np.unique(w.key, return_counts=True)
                    keys = pa.concat_arrays([pa.array(key.view(np.int64)), pa.nulls(1, pa.int64())])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.append(count, len(w.key)).astype(np.int64))], ["key", "runs"])
                del w
                tidy()

    return run


def hot_anchors(docs: DataFrame, window: int, gram: int, hot_runs: int = HOT_RUNS) -> np.ndarray:
    """Hashes in order of the anchors of ``docs`` (text) with over ``hot_runs`` runs, MOST_HOT at most."""
    counts = docs.select("text").mapInArrow(_count_anchors(window, gram), "key long, runs long").groupBy("key").agg(F.sum("runs").alias("runs"))
    often = stored(counts.where(F.col("key").isNull() | (F.col("runs") > hot_runs)), "anchors")
    total = often.where("key is null").first()
    bound = max(hot_runs, total.runs // MOST_HOT) if total else hot_runs  # so fewer than MOST_HOT have more
    rows = often.where(F.col("key").isNotNull() & (F.col("runs") > bound)).select("key").toArrow()
    return np.sort(rows.column("key").to_numpy().view(np.uint64))


def _cut_windows(window: int, gram: int, hot: np.ndarray):
    """Documents to runs of windows, those of ``hot`` anchors to runs of one window each
    that have its own hash for a key. Windows that repeat within a chunk are counted
    here and answered with rows that have no ``windows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, "text", CHUNK_BYTES):
                w = _Windows(part.column("text"), window, gram)
                if not w.any:
                    continue
                wh, doc, pos, begin, n = w.hash, w.doc, w.place, w.begin, w.n
                _, first, inverse, count = np.unique(wh, return_index=True, return_inverse=True, return_counts=True)
                again = count[inverse] > 1
                needed = ~again
                needed[first] = True
                is_hot = np.isin(w.key, hot, kind="sort") if len(hot) else np.zeros(len(w.key), dtype=bool)
                send = (np.add.reduceat(needed, begin) > 0) & ~is_hot
                ids, hashes = part.column("doc_id"), part.column("text_hash")
                if send.any():
                    b = begin[send]
                    yield _emit(w.key[send], doc[b], pos[b], n[send], wh[np.repeat(send, n)], ids, hashes)
                alone = np.flatnonzero(np.repeat(is_hot, n) & needed)
                for at in range(0, len(alone), 200_000):
                    some = alone[at : at + 200_000]
                    yield _emit(_mix(wh[some] ^ np.uint64(INVERSE)), doc[some], pos[some], np.ones(len(some), dtype=np.int64), wh[some], ids, hashes)
                lo, hi = _runs(again, doc)
                if len(lo):
                    yield _emit(_mix(wh[lo]), doc[lo], pos[lo], hi - lo + 1, None, ids, hashes)
                del w, wh, doc, pos, inverse, again, needed
                tidy()

    return run


def _count_windows(window: int, held_windows: int = HELD_WINDOWS):
    """Runs in order of key to spans (doc_id, text_hash, start, end) of repeated windows.

    The windows of a key are told when the next key begins. Of a key with over
    ``held_windows`` only one place of each window is kept beyond that, marked if it
    is told already. A window is a column in five arrays: full hash, document (row
    of ``docs``: id, whether that is null, hash of the text), place, told.
    """

    def spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc["id"], mask=doc["null"]), pa.array(doc["hash"]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
            ["doc_id", "text_hash", "start", "end"],
        )

    def settle(cols: list[np.ndarray]) -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
        """Spans of the repeated windows not told yet, and one place of each window, told or not."""
        full, doc, place, told = cols
        _, first, inverse, count = np.unique(full, return_index=True, return_inverse=True, return_counts=True)
        many = count[inverse] > 1
        on = np.flatnonzero(many & ~told)
        out = None
        if len(on):
            cut = np.flatnonzero((np.diff(place[on]) != 1) | (doc[on][1:] != doc[on][:-1])) + 1
            lo, hi = on[np.concatenate([[0], cut])], on[np.concatenate([cut - 1, [len(on) - 1]])]
            out = spans(doc[lo], place[lo], place[hi] + window)
        kept = [c[first] for c in cols]
        kept[3] = kept[3] | (count > 1)
        return out, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        last = None
        for batch in batches:
            key, lo, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "n"))
            doc = np.zeros(len(key), dtype=[("id", np.int64), ("hash", np.int64), ("null", np.bool_)])
            doc["id"], doc["hash"] = pc.fill_null(batch.column("doc_id"), 0).to_numpy(), pc.fill_null(batch.column("text_hash"), 0).to_numpy()
            doc["null"] = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            blobs = batch.column("windows")
            plain = blobs.is_null().to_numpy(zero_copy_only=False)
            if plain.any():
                yield spans(doc[plain], lo[plain], lo[plain] + n[plain] + window - 1)
            rows = np.flatnonzero(~plain)
            if not len(rows):
                continue
            n, key = n[rows].astype(np.int64), key[rows]
            wide = np.zeros((int(n.sum()), 8), dtype=np.uint8)
            wide[:, :WIDTH] = np.frombuffer(b"".join(blobs.take(pa.array(rows)).to_pylist()), dtype=np.uint8).reshape(-1, WIDTH)
            row = np.repeat(np.arange(len(rows)), n)
            place = (lo[rows] - (np.cumsum(n) - n))[row] + np.arange(len(row))
            full = wide.view("<u8").ravel() + _mix(key.view(np.uint64))[row]
            cols = [full, doc[rows][row], place, np.zeros(len(full), dtype=bool)]
            first_of_last = int(np.flatnonzero(key == key[-1])[0])
            if held is not None and key[0] == last:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            elif held is not None:
                out, _ = settle(held)
                if out is not None:
                    yield out
            open_at = len(cols[0]) - int(n[first_of_last:].sum()) if first_of_last else 0
            if open_at:
                out, _ = settle([c[:open_at] for c in cols])
                if out is not None:
                    yield out
            held, last = [c[open_at:] for c in cols], key[-1]
            if len(held[0]) > held_windows:
                out, held = settle(held)
                if out is not None:
                    yield out
        if held is not None:
            out, _ = settle(held)
            if out is not None:
                yield out
        tidy()

    return run


_RUNS = "key long, doc_id long, text_hash long, lo int, n int, windows binary"
_SPANS = "doc_id long, text_hash long, start int, end int"


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Word spans (start, end) of ``docs`` (doc_id, text, text_hash) that repeated windows cover, by document; spans may overlap.

    Anchors with over ``hot_runs`` runs, such as those of a line that a third of all
    documents hold, are found first: their windows are dealt out by their own hash,
    and each chunk sends a window once, however often it has it.
    """
    gram = min(GRAM, window)
    hot = hot_anchors(docs, window, gram, hot_runs)
    runs = docs.select("doc_id", "text_hash", "text").mapInArrow(_cut_windows(window, gram, hot), _RUNS)
    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(_count_windows(window), _SPANS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in slices_of(batch, "text", CHUNK_BYTES):
            at = part.schema.get_field_index("text")
            packed = pa.array([None if t is None else squeeze.compress(t) for t in part.column(at).cast(pa.large_binary()).to_pylist()], pa.binary())
            yield part.set_column(at, "text", packed)


def _cut(joined: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes = np.cumsum([0 if t is None else zstandard.frame_content_size(t) for t in batch.column("text").to_pylist()])
            start = 0
            while start < len(batch):  # by the size of the texts once expanded
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHUNK_BYTES, side="right")))
                yield _cut_batch(batch.slice(start, end - start), expand, joined)
                start = end
        tidy()

    return run


def _cut_batch(batch: pa.RecordBatch, expand: zstandard.ZstdDecompressor, joined: bool) -> pa.RecordBatch:
    at, spans_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("removed_spans")
    spans = batch.column(spans_at)
    offsets = spans.offsets.to_numpy()
    start, end = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    kept, words, removed = [], [], []
    for i, t in enumerate(batch.column(at).to_pylist()):
        if t is None:
            kept.append(None), words.append(0), removed.append(0)
            continue
        text = expand.decompress(t)
        ws = text.split()
        words.append(len(ws))
        a, b = start[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]]
        if spans[i].is_valid and len(a):
            depth = np.zeros(len(ws) + 1, dtype=np.int64)
            np.add.at(depth, a, 1)
            np.add.at(depth, b, -1)
            stay = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
            removed.append(len(ws) - len(stay))
            kept.append(b" ".join([ws[j] for j in stay]))
        else:
            removed.append(0)
            kept.append(b" ".join(ws) if joined else text)
    cols = dict(zip(batch.schema.names, batch.columns)) | {"text": pa.array(kept, pa.binary()).cast(pa.string())}
    cols.pop("removed_spans")
    cols |= {"n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def cut_repeats(docs: DataFrame, extra: list[str], window: int = WINDOW, joined: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """What :func:`remove_repeats` returns, with the columns named in ``extra`` in a struct ``extra``, so that no names clash."""
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.struct(*extra, F.lit(0).alias(fresh("_", extra))).alias("extra")).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(named, window, hot_runs).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("removed_spans"))
    packed = named.mapInArrow(_pack, named.withColumn("text", F.col("text").cast("binary")).schema)
    both = packed.alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.text_hash = s.text_hash"), "left")
    both = both.select("d.doc_id", "d.text", "d.extra", "s.removed_spans")
    schema = named.select("doc_id", "text", "extra", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    return both.mapInArrow(_cut(joined), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, joined: bool = False, extra: list[str] = (), hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` (doc_id, text) without the words that repeated windows cover.

    Returns doc_id, text, the columns named in ``extra`` as they are, n_words and
    n_removed, one row per row of ``docs``. A text of which nothing goes is returned
    as it is unless ``joined``; else the words kept are joined by one space. A window
    is ``window`` consecutive words of one document; it counts as repeated if its
    words also start at any other place of any document, as ``docs`` stands. A null
    text has no words and stays null; rows that repeat are documents of their own,
    so their windows repeat; ids may be null or shared; texts shorter than a window
    lose nothing; columns not named are dropped; an empty table gives an empty table.
    """
    extra = list(extra)
    return cut_repeats(docs, extra, window, joined, hot_runs).select("doc_id", "text", *[F.col("extra")[c].alias(c) for c in extra], "n_words", "n_removed")
