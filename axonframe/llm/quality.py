"""Document quality by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of, tidy

FEATURES = (
    "log_words", "symbols", "upper", "digits", "shouts", "bars", "stops", "distinct", "top_word", "word_length",
    "capital_words", "lines", "repeated_lines", "junk_ends", "short_words", "sentence_length", "high_bytes", "repeated_pairs",
)
#: Most trusted positives and most unlabelled documents that a model is fitted on.
MOST_POSITIVE = 20_000
MOST_UNLABELLED = 20_000
_JUNK = b"#$%&*@^~<>{}[]\\/+=_"


def features(text: bytes | None) -> list[float]:
    """What ``FEATURES`` names, of one whole text."""
    text = text or b""
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if text else np.zeros(256, dtype=np.int64)
    words, n = text.split(), max(1, len(text))
    m = max(1, len(words))
    upper, letters = int(c[65:91].sum()), max(1, int(c[65:91].sum() + c[97:123].sum()))
    times = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    stops = int(c[46] + c[33] + c[63])
    return [
        float(np.log1p(len(words))),
        int(c[list(_JUNK)].sum()) / n,
        upper / letters,
        int(c[48:58].sum()) / n,
        int(c[33]) / m,
        int(c[124]) / m,
        int(c[46] + c[44]) / m,
        float(np.log1p(len(times)) / np.log1p(m)),
        max(times.values(), default=0) / m,
        n / m if words else 0.0,
        sum(map(bytes.istitle, words)) / m,
        len(lines) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(w[-1] in _JUNK for w in words) / m,
        sum(len(w) < 4 for w in words) / m,
        float(np.log1p(m / (stops + 1))),
        int(c[128:].sum()) / n,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


def _table(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts.cast(pa.large_binary())], dtype=np.float64).reshape(-1, len(FEATURES))


class Net:
    """One hidden layer of tanh units; the output is a log-odds."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def gradient(self, x: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradient of the sum of outputs weighted by ``weight``."""
        h = np.tanh(x @ self.p[0] + self.p[1])
        back = weight[:, None] * self.p[2] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ weight, np.array([weight.sum()])]


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def risk_parts(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """The logistic risk of outputs on positives (``fp``) and unlabelled (``fu``): prior * P+, and U- - prior * P-, the part that must not be negative."""
    return prior * float(np.logaddexp(0, -fp).mean()), float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())


def descent(fp: np.ndarray, fu: np.ndarray, prior: float) -> np.ndarray:
    """Derivatives by the outputs, positives first, of what a step lowers: the risk or, where its second part is negative, minus that part, as published."""
    away = np.concatenate([-prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)])
    if risk_parts(fp, fu, prior)[1] < 0:
        return -away
    return away + np.concatenate([-prior * _sigmoid(-fp) / len(fp), np.zeros(len(fu))])


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int, rounds: int = 300, hidden: int = 12) -> Net:
    """Adam on the non-negative risk of ``prior``; without it, on positives against unlabelled."""
    net = Net(pos.shape[1], hidden, seed)
    first, second = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    r = np.random.default_rng(seed)
    for step in range(1, rounds + 1):
        p, u = pos[r.integers(0, len(pos), 2048)], unl[r.integers(0, len(unl), 2048)]
        fp, fu = net(p), net(u)
        x = np.concatenate([p, u])
        weight = np.concatenate([-_sigmoid(-fp) / len(p), _sigmoid(fu) / len(u)]) if prior is None else descent(fp, fu, prior)
        for i, g in enumerate(net.gradient(x, weight)):
            g = g + 1e-4 * net.p[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.p[i] = net.p[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 0) -> float:
    """Share of positives among the unlabelled, by the best bin of held-back scores.

    At any threshold at least prior * (share of positives above it) of the unlabelled
    lie above it; the least ratio, with bounds for chance added, is the estimate.
    """
    a, b = len(pos) // 2, len(unl) // 2
    net = _train(pos[:a], unl[:b], None, seed)
    p, u = np.sort(net(pos[a:])), np.sort(net(unl[b:]))
    at = np.unique(np.quantile(p, np.linspace(0, 0.95, 96)))
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


class Model:
    """A fitted classifier; ``prior`` is the estimated share of positives."""

    def __init__(self, pos: np.ndarray, unl: np.ndarray, seed: int = 0):
        self.net, self.prior = None, 1.0
        if min(len(pos), len(unl)) < 20:
            return
        every = np.concatenate([pos, unl])
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-6
        pos, unl = self.scaled(pos), self.scaled(unl)
        self.prior = class_prior(pos, unl, seed)
        self.net = _train(pos, unl, self.prior, seed, rounds=800)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x)) if self.net is None else _sigmoid(self.net(self.scaled(x)))


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, seed: int = 0) -> Model:
    """Fit on the trusted positives of ``labels`` (doc_id, quality = 1) and on unlabelled ``docs``.

    The first ``most_positive`` positives and ``most_unlabelled`` documents in order
    of a hash of their id are taken, each with one text: of a repeated id the one with
    the least hash. So the rows that come to the driver are bounded.
    With fewer than 20 of either every score is 1: nothing can be told apart.
    """
    order = F.xxhash64("doc_id")
    pos = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(most_positive).select("doc_id", F.lit(1).alias("trusted"))
    unl = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most_unlabelled).distinct().select("doc_id", F.lit(0).alias("trusted"))
    # bounded by the two parameters, and so fit for a broadcast
    wanted = pos.unionByName(unl).groupBy("doc_id").agg(F.collect_list("trusted").alias("trusted"))
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id").withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(_table(batch.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("trusted"), batch.column("text_hash"), x], ["doc_id", "trusted", "text_hash", "x"])

    measured = sample.mapInArrow(run, "doc_id long, trusted array<int>, text_hash long, x array<double>")
    one = measured.groupBy("doc_id").agg(F.min_by(F.struct("trusted", "x"), "text_hash").alias("one"))
    rows = one.select("doc_id", F.explode("one.trusted").alias("trusted"), "one.x").toArrow().sort_by([("doc_id", "ascending"), ("trusted", "descending")])
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    trusted = rows.column("trusted").to_numpy()
    mixed = np.random.default_rng(seed).permutation(len(x))
    return Model(x[mixed[trusted[mixed] == 1]], x[mixed[trusted[mixed] == 0]], seed)


def score(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``column`` (replacing any of that name), from the whole text alone.

    A null text scores as an empty one. Ids, repeats and other columns play no part.
    An empty table gives an empty table.
    """
    schema = docs.drop(column).withColumn(column, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices_of(batch, "text"):
                yield some.append_column(column, pa.array(shared.value(_table(some.column("text"))), pa.float64()))
        tidy()

    return docs.drop(column).mapInArrow(run, schema)
