"""Token sequences packed by a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, slices_of, stored, tidy

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of a shard, islands that evolve each shard, their size and their generations between migrations.
SHARD_PIECES = 4096
ISLANDS = 2
POPULATION = 6
GENERATIONS = 8
EPOCHS = 2
#: A bin at least this full is settled; the others of all shards are packed once more together.
SETTLED = 0.98
#: Bytes of parts of words, with their ids, that a worker keeps at hand.
CACHED_BYTES = 32 << 20
#: Text that is tokenized at once.
CHUNK_BYTES = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word that is letters and then punctuation: its tokens are those of the two parts,
#: and those of the letters do not depend on their case. Other words are encoded whole.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that are encoded in one string, with blanks between them.
_JOINED = 512


class Parts:
    """A tokenizer, and the ids of the parts of words met so far, in Arrow and numpy arrays of bounded size."""

    def __init__(self, path: str, most_bytes: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        # of a vocabulary with word ends: the tokens that end a word
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.most_bytes = CACHED_BYTES if most_bytes is None else most_bytes
        self.clear()

    def clear(self) -> None:
        self.known, self.flat, self.lengths = pa.array([], pa.large_string()), np.zeros(0, self.kind), np.zeros(0, np.int32)

    def _one_by_one(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for at in range(0, len(parts), 20_000) for e in self.tokenizer.encode_batch_fast(parts[at : at + 20_000], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        return np.fromiter((i for some in ids for i in some), dtype=self.kind, count=int(lengths.sum())), lengths

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, told apart by the tokens that end a word."""
        if not len(words) or not self.ends.any():
            return self._one_by_one(words.to_pylist())
        lines = [" ".join(words.slice(at, _JOINED).to_pylist()) for at in range(0, len(words), _JOINED)]
        flat = []
        for at in range(0, len(lines), 64):
            flat += [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(lines[at : at + 64], add_special_tokens=False)]
        flat = np.concatenate(flat)
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(words) or ends[-1] != len(flat):
            return self._one_by_one(words.to_pylist())
        return flat, np.diff(ends, prepend=0).astype(np.int32)

    def encode(self, parts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``parts`` one after another, and how many each has; ``letters`` tells which are of lower-case letters only."""
        at = pc.fill_null(pc.index_in(parts, self.known), -1).to_numpy(zero_copy_only=False)
        fresh = np.flatnonzero(at < 0)
        if (self.known.nbytes + self.flat.nbytes + self.lengths.nbytes) + 32 * len(fresh) > self.most_bytes and len(self.known):
            self.clear()
            fresh = np.arange(len(parts))
        words, others = fresh[letters[fresh]], fresh[~letters[fresh]]
        found = self._words(parts.take(pa.array(words))), self._one_by_one(parts.take(pa.array(others)).to_pylist())
        order = np.concatenate([words, others])
        before = len(self.known)
        known = pa.concat_arrays([self.known, parts.take(pa.array(order))])
        flat = np.concatenate([self.flat, *(f[0] for f in found)])
        lengths = np.concatenate([self.lengths, *(f[1] for f in found)])
        which = at.astype(np.int64)
        which[order] = before + np.arange(len(order))
        if known.nbytes + flat.nbytes + lengths.nbytes <= self.most_bytes:
            self.known, self.flat, self.lengths = known, flat, lengths
        else:  # a chunk with so many parts is not kept
            self.clear()
        out, ends = _gather(flat, lengths, which)
        return out, np.diff(ends)


_state: dict[str, Parts] = {}
CACHES.append(_state)


def _parts(path: str) -> Parts:
    """The tokenizer and the parts met so far, one for each worker."""
    if path not in _state:
        _state[path] = Parts(path)
    return _state[path]


def _gather(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat``, one after another, and where each ends, from 0."""
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    n = lengths[which]
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    out = np.empty(ends[-1], dtype=flat.dtype)
    for at in range(0, len(n), 1 << 18):  # so that the places of all ids are never held at once
        some = n[at : at + (1 << 18)]
        lo, hi = ends[at], ends[at + len(some)]
        out[lo:hi] = flat[np.repeat(starts[which[at : at + len(some)]] - ends[at : at + len(some)], some) + np.arange(lo, hi)]
    return out, ends


def _tails(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last bytes of each word, ``sizes`` of them."""
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1 + words.offset)[words.offset + 1 :]
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    places = np.repeat(ends - sizes - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data[places])])


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text's ids start and end.

    The tokenizer never joins across white space, so each distinct word is looked up
    once and its ids are put wherever the word stands.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    letters = pc.ascii_rtrim(words, _PUNCTUATION)
    plain = pc.match_substring_regex(letters, _LETTERS)
    first = pc.if_else(plain, pc.utf8_lower(letters), words).dictionary_encode()
    tails = (pc.binary_length(words).to_numpy() - pc.binary_length(letters).to_numpy()).astype(np.int64)
    tails[~plain.to_numpy(zero_copy_only=False)] = 0
    second = _tails(words, tails).dictionary_encode()
    whole = pc.match_substring_regex(first.dictionary, _LETTERS).to_numpy(zero_copy_only=False)
    parts = pa.concat_arrays([first.dictionary, second.dictionary])
    is_word = np.concatenate([whole, np.zeros(len(second.dictionary), dtype=bool)])
    flat, lengths = _parts(path).encode(parts, is_word)
    # the ids of each distinct word from those of its two parts, then those of all words
    both = np.column_stack([first.indices.to_numpy(), second.indices.to_numpy() + np.int64(len(first.dictionary))]).ravel()
    flat, ends = _gather(flat, lengths, both)
    flat, ends = _gather(flat, np.diff(ends[::2]), coded.indices.to_numpy())
    return flat, ends[offsets]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Documents to pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([SEPARATOR], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices_of(batch, "text", CHUNK_BYTES):
                rows, piece, length, crc = [], [], [], []
                flat, bounds = token_ids(part.column("text").cast(pa.large_string()), path)
                for i in range(len(part)):
                    ids = flat[bounds[i] : bounds[i + 1]].astype("<u4").tobytes() + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        some = ids[at : at + 4 * capacity]
                        rows.append(i), piece.append(k), length.append(len(some) // 4), crc.append(zlib.crc32(some))
                numbers = np.array(piece, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers), pa.array(numbers.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names
                )
        tidy(_state)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], order, bins: list[int], free: list[tuple[int, int]], capacity: int, next_bin: int) -> int:
    """Put the pieces of ``order`` each into the fullest bin that has room, ``free`` being (room, bin) in order; returns the next new bin."""
    for i in order:
        size = lengths[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b, next_bin = capacity, next_bin, next_bin + 1
        bins[i] = b
        if room > size:
            insort(free, (room - size, b))
    return next_bin


def _fresh(lengths: np.ndarray, noise: float, rng, capacity: int) -> np.ndarray:
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    bins = [0] * len(lengths)
    best_fit(lengths.tolist(), order.tolist(), bins, [], capacity, 0)
    return np.array(bins, dtype=np.int32)


def _fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewest bins first, then the most uneven filling."""
    fill = np.bincount(bins, weights=lengths)
    return len(fill), -float(np.square(fill / capacity).sum())


def crossover(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, rng, capacity: int) -> np.ndarray:
    """A child of ``one`` with well-filled bins of ``two`` injected whole.

    Bins of ``one`` that hold a piece of an injected bin go, and so do some of its
    emptiest; their pieces that are left without a bin are placed by best fit.
    """
    fill = np.bincount(two, weights=lengths) / capacity
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[rng.choice(good, max(1, len(good) // 3), replace=False)] = True
    injected = chosen[two]
    own = np.bincount(one, weights=lengths)
    gone = np.zeros(len(own), dtype=bool)
    gone[one[injected]] = True
    gone[np.argsort(own, kind="stable")[: 1 + rng.integers(0, 1 + len(own) // 20)]] = True
    displaced = np.flatnonzero(gone[one] & ~injected)
    child = np.where(injected, two + len(own), one)
    stay = ~(gone[one] & ~injected)
    used, dense = np.unique(child[stay], return_inverse=True)
    child[stay] = dense
    room = capacity - np.bincount(dense, weights=lengths[stay], minlength=len(used)).astype(int)
    free = sorted((int(r), b) for b, r in enumerate(room) if r > 0)
    bins = child.tolist()
    best_fit(lengths.tolist(), displaced[np.argsort(-lengths[displaced], kind="stable")].tolist(), bins, free, capacity, len(used))
    return np.array(bins, dtype=np.int32)


def evolve(lengths: np.ndarray, members: list[np.ndarray], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION) -> list[np.ndarray]:
    """Generations of one island; returns its two best members, the best first."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    if not members:
        members = [_fresh(lengths, 0.0, rng, capacity)]
    scored = [(_fitness(m, lengths, capacity), i, m) for i, m in enumerate(members)]
    count = len(scored)
    if min(scored)[0][0] > least:
        while len(scored) < population:
            m = _fresh(lengths, 0.05 * count, rng, capacity)
            scored.append((_fitness(m, lengths, capacity), count, m))
            count += 1
        for _ in range(generations):
            scored.sort()
            if scored[0][0][0] <= least:
                break
            for _ in range(population // 2):
                a, b = np.sort(rng.choice(len(scored), 2, replace=False))
                child = crossover(scored[a][2], scored[b][2], lengths, rng, capacity)
                scored.append((_fitness(child, lengths, capacity), count, child))
                count += 1
            scored = sorted(scored)[:population]
    scored.sort()
    return [m for _, _, m in scored[:2]]


_ISLAND = "shard long, island int, pids array<long>, lengths array<int>, elites array<array<int>>"


def _settle(items: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """Pack items (pid, length) in ``shards`` parts: pid, shard, bin, offset, fill."""

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "pid"], ascending=[False, True])
        lengths = frame["length"].to_numpy().astype(np.int64)
        shard, island = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
        elites = evolve(lengths, [_fresh(lengths, 0.0 if island == 0 else 0.1, np.random.default_rng(island), capacity)], shard * ISLANDS + island, capacity)
        return pd.DataFrame({"shard": [shard], "island": [island], "pids": [frame["pid"].to_numpy()], "lengths": [lengths.astype(np.int32)], "elites": [[e.tolist() for e in elites]]})

    def go_on(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = np.asarray(frame["lengths"].iloc[0]).astype(np.int64)
        members = [np.asarray(m, dtype=np.int32) for m in [*frame["elites"].iloc[0], *frame["guests"].iloc[0]]]
        shard, island = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
        elites = evolve(lengths, members, (level + 2) << 20 | (shard * ISLANDS + island) & 0xFFFFF, capacity)
        return frame[["shard", "island", "pids", "lengths"]].assign(elites=[[e.tolist() for e in elites]])

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        best = min((_fitness(np.asarray(e[0]), np.asarray(n, dtype=float), capacity), i) for i, (e, n) in enumerate(zip(frame["elites"], frame["lengths"])))[1]
        lengths, bins = np.asarray(frame["lengths"].iloc[best]).astype(np.int64), np.asarray(frame["elites"].iloc[best][0])
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], np.diff(bins[order]) != 0])
        offset = before - np.repeat(before[first], np.diff(np.concatenate([np.flatnonzero(first), [len(order)]])))
        fill = np.bincount(bins, weights=lengths)[bins[order]]
        return pd.DataFrame({"pid": np.asarray(frame["pids"].iloc[best])[order], "shard": int(frame["shard"].iloc[0]), "bin": bins[order].astype(np.int64), "offset": offset, "fill": fill.astype(np.int64)})

    dealt = items.select("pid", "length", F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(shards)).alias("shard"))
    islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = islands.groupBy("shard", "island").applyInPandas(begin, _ISLAND)
    for _ in range(EPOCHS - 1):
        state = stored(state, "islands")
        guests = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("elites", 1, 1).alias("guests"))
        state = state.join(guests, ["shard", "island"]).groupBy("shard", "island").applyInPandas(go_on, _ISLAND)
    return state.groupBy("shard").applyInPandas(place, "pid long, shard long, bin long, offset long, fill long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and pack the pieces into sequences of ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row for
    each piece. A document is its token ids and a separator, so a null or empty text
    is one token; only documents longer than ``capacity`` are cut. Full pieces are
    sequences by themselves. The others are dealt by hash into shards of bounded
    size, each evolved by islands that exchange elites; bins that stay poorly filled
    are emptied and packed again with those of other shards. Ids may be null or
    repeated: each row is packed by itself. Other columns are ignored; an empty
    table gives an empty table.
    """
    cut = stored(pieces(docs, tokenizer, capacity).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < capacity)
    full = cut.where(F.col("length") == capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shards = max(1, -(-rest.count() // SHARD_PIECES))
    placed = _settle(rest, shards, 0, capacity)
    final = [full]
    if shards > 1:
        placed = stored(placed, "bins")
        poor = placed.where(F.col("fill") < SETTLED * capacity)
        final.append(_numbered(placed.where(F.col("fill") >= SETTLED * capacity), 0))
        again = max(1, -(-poor.count() // SHARD_PIECES))
        final.append(_numbered(_settle(poor.select("pid").join(rest, "pid"), again, 1, capacity), 1))
    else:
        final.append(_numbered(placed, 0))
    every = final[0]
    for more in final[1:]:
        every = every.unionByName(more)
    return cut.join(every, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _numbered(placed: DataFrame, level: int) -> DataFrame:
    return placed.select("pid", ((F.col("shard") * 2 + level) * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
