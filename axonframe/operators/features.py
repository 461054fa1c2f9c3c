"""Operators over feature rows (item, x ARRAY<FLOAT>, label) and their readouts."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normaliser(rows: DataFrame, x: str = "x") -> DataFrame:
    """Mean and population deviation of each feature; deviations that are tiny or not finite become 1."""
    each = rows.select(F.posexplode(x).alias("feature", "v")).groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    bad = F.col("std").isNull() | F.isnan("std") | (F.abs("std") == float("inf")) | (F.col("std") <= 1e-6)
    return each.select("feature", "mean", F.when(bad, 1.0).otherwise(F.col("std")).alias("std"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shares(e: Column) -> Column:
    return let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Stable softmax of an array."""
    return let(F.array_max(x), lambda top: let(F.transform(x, lambda v: F.exp((v.cast("double") - top) / F.lit(temperature))), _shares))


def masked_softmax(x: Column, mask: Column, temperature: float, idle: float = 0.1) -> Column:
    """Softmax over the places of ``mask``; others get 0; where none is set each gets ``idle``."""
    pairs = F.zip_with(x, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    grown = lambda top: F.transform(pairs, lambda p: F.when(p["m"], F.exp((p["v"].cast("double") - top) / F.lit(temperature))).otherwise(0.0))
    top = F.array_max(F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["v"]))
    return F.when(F.exists(mask, lambda m: m), let(top, lambda t: let(grown(t), _shares))).otherwise(F.transform(x, lambda v: F.lit(idle)))


def argmax(x: Column) -> Column:
    """First place, from 0, of the greatest element."""
    return F.array_position(x, F.array_max(x)) - 1


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg((F.col(label) == F.col(predicted)).cast("double")), 9).alias("accuracy"))


def balanced_subset(rows: DataFrame, label: str, key: str, each: int, seed: int) -> DataFrame:
    """``each`` rows of every label, in order of a seeded rank of their key."""
    rank = (F.col(key) * 48271 + seed * 7919) % 2147483647
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(label).orderBy(rank, key))).where(F.col("_n") <= each).drop("_n")


def block_mean(x: Column, width: int, factor: int) -> Column:
    """An array read as rows of ``width``, averaged in squares of ``factor``."""
    side = width // factor
    part = lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(factor - 1)), lambda r: F.slice(x, ((F.floor(b / side) * factor + r) * width + (b % side) * factor + 1).cast("int"), F.lit(factor))))
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda b: F.aggregate(part(b), F.lit(0.0), lambda s, v: s + v) / F.lit(float(factor * factor)))


def every_second(x: Column, width: int) -> Column:
    """An array read as rows of ``width``, every second row and column of it."""
    return F.filter(x, lambda _, i: (i % width % 2 == 0) & (F.floor(i / width) % 2 == 0))


def nearest(x: Column, width: int, height: int, new_width: int, new_height: int) -> Column:
    """An array read as rows of ``width``, to another size by the nearest place."""
    place = lambda i: F.floor(F.floor(i / new_width) * height / new_height) * width + F.floor(i % new_width * width / new_width)
    return F.transform(F.sequence(F.lit(0), F.lit(new_width * new_height - 1)), lambda i: F.get(x, place(i).cast("int")))


def cross_entropy(scores: Column, label: Column) -> Column:
    """Minus the log of the softmax of ``scores`` at ``label``, from their differences to the largest so that nothing overflows."""
    most = F.array_max(scores).cast("double")
    total = F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - most))
    return F.log(total) + most - F.get(scores, label.cast("int")).cast("double")


def centred_layout(index: Column, count: int, side: int) -> Column:
    """Neurons for ``count`` inputs: the square of the least side that holds them, in the middle of a square of neurons of ``side``."""
    own = math.ceil(math.sqrt(count))
    if own > side:
        raise ValueError(f"{count} inputs don't fit {side} x {side} neurons")
    first = (side - own) // 2
    return (F.floor(index / own) + first) * side + index % own + first


def gram(rows: DataFrame, x: str, y: Column, alpha: float) -> DataFrame:
    """Normal equations of ridge regression, (i, j, value): the sums of x_i x_j with alpha on the diagonal, and with j = -1 those of x_i y."""
    v = rows.select(F.col(x).alias("x"), y.cast("double").alias("y")).select(F.posexplode("x").alias("i", "a"), "x", "y")
    square = v.select("i", F.posexplode("x").alias("j", "b"), "a").groupBy("i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("value"))
    right = v.groupBy("i").agg(F.sum(F.col("a").cast("double") * F.col("y")).alias("value")).select("i", F.lit(-1).alias("j"), "value")
    return square.select("i", "j", (F.col("value") + F.when(F.col("i") == F.col("j"), alpha).otherwise(0.0)).alias("value")).unionByName(right)


def ridge(rows: DataFrame, x: str, label: str, classes: int, alpha: float = 1.0) -> np.ndarray:
    """Weights (features + bias, classes) of a ridge readout; the driver solves equations of the features' size."""
    augmented = rows.where(F.col(x).isNotNull() & F.col(label).isNotNull()).select(F.concat(F.transform(x, lambda v: v.cast("double")), F.array(F.lit(1.0))).alias("x"), label)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = b = None
        for frame in batches:
            if len(frame):
                m, t = np.stack(frame["x"]), np.eye(classes)[frame[label].to_numpy().astype(int)]
                a, b = (m.T @ m, m.T @ t) if a is None else (a + m.T @ m, b + m.T @ t)
        if a is not None:
            yield pd.DataFrame({"row": np.arange(len(a)), "v": list(np.hstack([a, b]))})

    sums = augmented.mapInPandas(part, "row int, v array<double>").groupBy("row").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(_width(rows, x) + 1 + classes)]).alias("v")).orderBy("row").collect()
    m = np.array([r.v for r in sums])
    n = len(m)
    return np.linalg.solve(m[:, :n] + alpha * np.diag([1.0] * (n - 1) + [0.0]), m[:, n:])


def _width(rows: DataFrame, x: str) -> int:
    return rows.select(F.max(F.size(x))).first()[0] or 0


class OnlineSoftmax:
    """Softmax readout by stochastic gradient steps, one row after another."""

    def __init__(self, features: int, classes: int, rate: float = 0.05):
        self.w, self.rate = np.zeros((features + 1, classes)), rate

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.append(x, 1.0) @ self.w
        e = np.exp(z - z.max())
        return e / e.sum()

    def update(self, x: np.ndarray, label: int) -> None:
        error = self.predict(x)
        error[label] -= 1
        self.w -= self.rate * np.outer(np.append(x, 1.0), error)


class OnlineRLS:
    """Linear readout by recursive least squares with forgetting."""

    def __init__(self, features: int, classes: int, forget: float = 1.0, alpha: float = 1.0):
        self.w, self.p, self.forget = np.zeros((features + 1, classes)), np.eye(features + 1) / alpha, forget
        self.classes = classes

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.append(x, 1.0) @ self.w

    def update(self, x: np.ndarray, label: int) -> None:
        z = np.append(x, 1.0)
        gain = self.p @ z / (self.forget + z @ self.p @ z)
        self.w += np.outer(gain, np.eye(self.classes)[label] - z @ self.w)
        self.p = (self.p - np.outer(gain, z @ self.p)) / self.forget


def fit_online(rows: DataFrame, key: str, x: str, label: str, model: str, classes: int, replicate: str) -> DataFrame:
    """An online readout over the ordered rows of each ``replicate``: (replicate, n, correct), each row predicted before it is learned."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        m = {"softmax": OnlineSoftmax, "rls": OnlineRLS}[model](len(frame[x].iloc[0]), classes)
        correct = 0
        for v, y in zip(frame[x], frame[label]):
            v = np.asarray(v, dtype=float)
            correct += int(np.argmax(m.predict(v)) == y)
            m.update(v, int(y))
        return pd.DataFrame({replicate: [frame[replicate].iloc[0]], "n": [len(frame)], "correct": [correct]})

    return rows.select(key, x, label, replicate).groupBy(replicate).applyInPandas(run, f"{replicate} long, n long, correct long")


def evidence(rows: DataFrame, sequence: str, step: str, scores: str, threshold: float, leak: float = 1.0) -> DataFrame:
    """Evidence summed over the ordered steps of each sequence until a class reaches ``threshold``: (sequence, decision, steps), -1 if none does."""
    ordered = F.array_sort(F.collect_list(F.struct(step, scores)))
    start = F.struct(F.transform(F.get(F.col("r"), F.lit(0))[scores], lambda v: F.lit(0.0)).alias("e"), F.lit(-1).cast("long").alias("decision"), F.lit(0).alias("steps"))

    def on(a, r):
        e = F.zip_with(a["e"], r[scores], lambda s, v: s * F.lit(leak) + v.cast("double"))
        open_ = a["decision"] < 0
        hit = F.when(F.array_max(e) >= threshold, argmax(e)).otherwise(F.lit(-1).cast("long"))
        return F.struct(F.when(open_, e).otherwise(a["e"]).alias("e"), F.when(open_, hit).otherwise(a["decision"]).alias("decision"), F.when(open_, a["steps"] + 1).otherwise(a["steps"]).alias("steps"))

    grouped = rows.groupBy(sequence).agg(ordered.alias("r"))
    return grouped.select(sequence, F.aggregate("r", start, on).alias("a")).select(sequence, "a.decision", "a.steps")
