"""How a model is run: by a fold in the JVM, by a task for each replicate, or as a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import column, names
from ..sources.model import Model


@dataclass(frozen=True)
class Choice:
    strategy: str  # fold, replicates or stream
    why: str


def choose(model: Model, live: bool = False) -> Choice:
    """A stream for live ticks; a fold where no cell hears another; else a task a replicate, as each tick needs all of a network."""
    if live:
        return Choice("stream", "ticks have no end")
    if model.edges:
        return Choice("replicates", "cells hear each other in every tick")
    simple = all(len(model.components[c].type.regimes) == 1 for _, c, _ in model.populations)
    return Choice("fold", "cells are on their own") if simple else Choice("replicates", "cells change between regimes")


def fold_cells(spark: SparkSession, model: Model, current: float) -> DataFrame:
    """Spikes (neuron, tick) of cells on their own under a constant current, with a fold of all ticks in one expression."""
    ticks, parts, at = round(model.length / model.step), [], 0
    for _, name, size in model.populations:
        c = model.components[name]
        kind, regime = c.type, c.type.regimes[0]
        fixed = {k: F.lit(float(v)) for k, v in c.values.items()} | {"t": F.lit(0.0)}
        first = dict.fromkeys(kind.states, F.lit(0.0))
        for state, tree in kind.start:
            first[state] = column(tree, fixed | first)
        start = F.struct(*[v.alias(k) for k, v in first.items()], F.array().cast("array<long>").alias("_spikes"))

        def step(a, k, kind=kind, regime=regime, fixed=fixed):  # noqa: B023
            values = fixed | {s: a[s] for s in kind.states} | {"t": k * F.lit(model.step)}
            for d, cases, select in kind.derived:
                if select:
                    values[d] = F.lit(float(current))
                    continue
                out = F.lit(0.0)
                for test, value in reversed(cases):
                    out = column(value, values) if test is None else F.when(column(test, values) != 0, column(value, values)).otherwise(out)
                values[d] = out
            after = {s: a[s] + F.lit(model.step) * column(regime.derivatives[s], values) if s in regime.derivatives else a[s] for s in kind.states}
            spikes = a["_spikes"]
            for test, what, emits, _ in regime.conditions:
                now = column(test, values | after) != 0
                if emits:
                    spikes = F.when(now, F.concat(spikes, F.array(k))).otherwise(spikes)
                for s, tree in what:
                    after[s] = F.when(now, column(tree, values | after)).otherwise(after[s])
            return F.struct(*[after[s].alias(s) for s in kind.states], spikes.alias("_spikes"))

        # two parameters: Spark looks at how many a function has
        run = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ticks - 1).cast("long")), start, lambda a, k: step(a, k))
        parts.append(spark.range(at, at + size).select(F.col("id").alias("neuron"), F.explode(run["_spikes"]).alias("tick")))
        at += size
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reads(model: Model, component: str) -> set[str]:
    """Names that the dynamics of a component use."""
    kind = model.components[component].type
    trees = [t for r in kind.regimes for t in r.derivatives.values()] + [t for _, cases, _ in kind.derived for _, t in cases]
    return set().union(*map(names, trees)) if trees else set()
