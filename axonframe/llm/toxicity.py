"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text."""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import slices_of, stored

#: Letters of other scripts, and digits, that are written for Latin letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝкмтвнαεορτυικνχβγη", "aeopcyxijshdqwkmtbhaeoptuiknxbyn"))
SUBSTITUTES = dict(zip("0123456789@$€£", "oizeasbtbgasei"))
#: l, like 1 and i, stands for any of the three.
FOLDED = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES | {"l": "i", "ı": "i"}).items()}
FOLDED |= {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) in "@$")}
FOLDED |= {i: None for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


class _Folding(dict):
    """What a character folds to: itself if it is a letter or digit, nothing if it is a mark on one, else a blank, whatever its code point."""

    def __missing__(self, code: int) -> int | str | None:
        c = chr(code)
        self[code] = found = code if c.isalnum() else None if unicodedata.category(c)[0] == "M" else " "
        return found


FOLDED = _Folding(FOLDED)
_INNER = re.compile(r"(?<=\w)[!|](?=\w)")

#: Terms with weights that hold without training; they match at the start of a word.
SEED_TERMS = {
    "idiot": 4.0, "moron": 4.0, "stupid": 3.5, "scum": 4.0, "worthless": 3.5,
    "pathetic": 3.5, "loser": 4.0, "disgusting": 3.5, "trash": 3.0, "clown": 3.0,
}
#: Matches inside these do not count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "circus clown", "pond scum", "soap scum", "not an idiot", "not a loser", "not stupid")
#: Labelled documents at most that a lexicon is learned from.
MOST_LABELLED = 10_000
#: Letters of the stems that may become terms, besides whole words of any length.
SHORTEST, LONGEST = 4, 9


def fold(text: str) -> str:
    """Lower case, with look-alikes, styled letters and digits as plain letters, without accents, and with blanks for all else."""
    text = text.lower()
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower()
    return text.translate(FOLDED)


@dataclass
class Lexicon:
    """``terms`` by folded stem; coefficients of the two measures and the base of the log-odds."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: np.ndarray = field(default_factory=lambda: np.array([2.0, 1.0, -3.0]))

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            out.add_word(" " + term, (len(term), weight))
        for phrase in self.exceptions:
            phrase = " ".join(fold(phrase).split())
            out.add_word(" " + phrase, (len(phrase), None))
        out.make_automaton()
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def measure(self, text: str | None) -> tuple[float, float, int]:
        """Logs of the weight against the log of the length and of the weight a hundred words; matches.

        Of the terms that start at a place the longest counts; those within an exception
        phrase do not.
        """
        folded = " " + fold(text or "")
        longest: dict[int, tuple[int, float]] = {}
        spans: list[tuple[int, int]] = []
        if self.terms or self.exceptions:
            for end, (length, weight) in self.automaton.iter(folded):
                if weight is None:
                    spans.append((end - length + 1, end))
                else:
                    longest[end - length + 1] = end, weight
        if spans and longest:
            spans.sort()
            starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
            longest = {a: hit for a, hit in longest.items() if (i := bisect_right(starts, a)) == 0 or ends[i - 1] < hit[0]}
        if not longest:
            return 0.0, 0.0, 0
        total, words = sum(w for _, w in longest.values()), len(folded.split())
        return math.log1p(total / math.log(10 + words)), math.log1p(100 * total / words), len(longest)

    def score(self, measures: np.ndarray) -> np.ndarray:
        x = np.column_stack([measures[:, :2], np.ones(len(measures))])
        return 0.5 * (1 + np.tanh(0.5 * (x @ self.coefficients)))


def _starts(text: str) -> set[str]:
    """All words of a text that may become terms, and their starts."""
    words = {w for w in fold(text).split() if len(w) >= SHORTEST}
    return words | {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST + 1))}


def _told(toxic: int, clean: int, share: float, tested: int) -> bool:
    """Whether a word that has nothing to do with toxicity is unlikely to stand in so many toxic documents: under one in
    a hundred among all ``tested`` terms, ``share`` of all documents being toxic (by Chernoff's bound)."""
    n = toxic + clean
    part = toxic / n
    if part <= share:
        return False
    bound = part * math.log(part / share) + ((1 - part) * math.log((1 - part) / (1 - share)) if part < 1 else 0.0)
    return n * bound >= math.log(100 * max(1, tested))


def _cover(found: list[set[str]], clean: dict[str, int], n_clean: int) -> dict[str, float]:
    """Terms that explain the toxic documents, each chosen for those that no term before it explains.

    ``found`` has the candidates in each toxic document. A term needs four documents
    of its own, and at least seven tenths of its documents toxic; of terms that
    explain the same documents the longest is taken. Weights are log-odds.
    """
    by: dict[str, set[int]] = {}
    for i, terms in enumerate(found):
        for t in terms:
            by.setdefault(t, set()).add(i)
    whole = {t: len(docs) for t, docs in by.items()}

    def gain(t: str) -> float:
        n, c = len(by[t]), clean.get(t, 0)
        return n * float(np.log((n + 0.5) / (len(found) + 1)) - np.log((c + 0.5) / (n_clean + 1))) if n >= 4 and n >= 0.7 * (n + c) else 0.0

    heap = [(-gain(t), -len(t), t) for t in by]
    heapq.heapify(heap)
    out: dict[str, float] = {}
    done: set[int] = set()
    while heap and heap[0][0] < 0:
        was, length, t = heapq.heappop(heap)
        by[t] -= done
        if (now := -gain(t)) > was + 1e-9:
            heapq.heappush(heap, (now, length, t))
            continue
        done |= by[t]
        out[t] = float(np.log((whole[t] + 0.5) / (len(found) + 1)) - np.log((clean.get(t, 0) + 0.5) / (n_clean + 1)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton steps of a slightly damped logistic regression."""
    w = np.zeros(x.shape[1])
    damp = 0.05 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Lexicon:
    """Learn terms and weights from ``labels`` (doc_id, toxic) of ``docs``.

    The first ``most_labelled`` labels in order of a hash of their id are used, each
    with one text: of a repeated id the one with the least hash. Labels that are
    null, neither 0 nor 1, or at odds with another of the same id do not count.
    Whole words and word starts of 4 to 9 folded letters are counted in documents of
    either label; those that tell, beyond what chance gives among so many, become candidates, of
    which a greedy cover of the toxic documents takes terms, weighted by their log-odds. Without labels of both
    kinds only the seed terms hold.
    """
    seeds = {fold(k): v for k, v in SEED_TERMS.items()}
    # bounded by most_labelled, and so fit for a broadcast
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("low")).where("toxic = low")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(known), "doc_id")
    sample = stored(found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                sums[label].update(_starts(text))
                sums[label][""] += 1
        both = list(sums[0].keys() | sums[1].keys())
        for at in range(0, len(both), 100_000):
            part = both[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([sums[1][p] for p in part], pa.int64()), pa.array([sums[0][p] for p in part], pa.int64())], ["term", "toxic", "clean"])

    counts = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    seen = Observation()
    telling = counts.observe(seen, F.count_if(F.col("toxic") + F.col("clean") >= 4).alias("tested")).where((F.col("term") == "") | ((F.col("toxic") >= 4) & (F.col("clean") <= 0.43 * F.col("toxic"))))
    rows = sorted((r.term, r.toxic, r.clean) for r in telling.collect())  # each in four of the labelled documents at least, so bounded by these
    if not rows or rows[0][0] or not rows[0][1] or not rows[0][2]:
        return Lexicon(seeds)
    share, tested = rows[0][1] / (rows[0][1] + rows[0][2]), seen.get["tested"]
    clean = {t: c for t, n, c in rows[1:] if _told(n, c, share, tested)}
    toxic = [_starts(r.text) & clean.keys() for r in sample.where("toxic = 1").orderBy("doc_id").select("text").toLocalIterator()]
    lexicon = Lexicon(seeds | _cover(toxic, clean, rows[0][2]))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["toxic", "a", "b"])

    m = sample.mapInArrow(measured, "toxic int, a double, b double").toPandas().sort_values(["toxic", "a", "b"])
    x = np.column_stack([m["a"], m["b"], np.ones(len(m))])
    w = _logistic(x, m["toxic"].to_numpy(dtype=float))
    for i in (0, 1):  # more weight never means less toxic
        if w[i] < 0:
            x[:, i] = 0
            w = _logistic(x, m["toxic"].to_numpy(dtype=float))
            w[i] = 0.0
    lexicon.coefficients = w
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, score (0 to 1) and n_matches, from the whole text alone.

    A null text scores as an empty one, at the base rate. Ids may be null or
    repeated; other columns are ignored; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices_of(batch, "text"):
                got = np.array([shared.value.measure(t.as_py()) for t in some.column("text")], dtype=float).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(shared.value.score(got)), pa.array(got[:, 2].astype(np.int32))], ["doc_id", "score", "n_matches"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_matches int")
