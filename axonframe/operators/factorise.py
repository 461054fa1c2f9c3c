"""Low-rank fits of a value of each connection: rows of sources and of targets whose products come near it.

The objective is the sum over edges of weight * (fit - value)^2 / 2 and of ridge / 2 * the squares of the
rows that move, in units of the plane's root mean square; an edge weighs 1 / max(|value|, 1)^2. Rows are
tables (node, lanes). Every sweep or step is written to the shared folder, so that plans stay short and
nothing but a few numbers comes to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .events import prefix_sums

RIDGE = 1e-7
#: Sweeps at most; and a fit stalls if so many of them gain less than this share of the error.
MOST_SWEEPS, STALL_SWEEPS, STALL_GAIN = 100, 10, 0.05
#: Steps at most of the quasi-Newton fit, those it looks back on, and steps without gain after which it stalls.
MOST_STEPS, HISTORY, STALL_STEPS = 2000, 5, 100
#: Presets: the largest error that a plane may have, as a share of max(|value|, root mean square).
TOLERANCES = {"exact": 1e-5, "fine": 1e-4, "normal": 1e-3, "coarse": 1e-2}


def delay_is_exact(tolerance: float, delay_ticks: float) -> bool:
    """Whether a delay read with ``tolerance`` still rounds to the same tick."""
    return tolerance * delay_ticks < 0.5


@dataclass
class Fit:
    """Rows of sources and of targets, the worst error that they leave, and the sweeps or steps taken."""

    u: DataFrame
    v: DataFrame
    error: float
    rounds: int


def scaled(edges: DataFrame) -> tuple[DataFrame, float]:
    """Edges (src, dst, weight) with ``value`` in units of the plane's root mean square and ``w``; and that unit, 0 for a plane of zeros."""
    unit = edges.agg(F.sqrt(F.avg(F.col("weight") * F.col("weight"))).alias("rms")).first().rms or 0.0
    value = F.col("weight") / F.lit(unit or 1.0)
    out = edges.select("src", "dst", value.alias("value"))
    return stored(out.withColumn("w", 1 / F.pow(F.greatest(F.abs("value"), F.lit(1.0)), F.lit(2.0))), "plane"), unit


#: Products of rows of so many lanes at most are written out, which Spark compiles.
WRITTEN_OUT = 16
#: Bytes of all rows, up to which they go to all executors when they are joined to edges.
MOST_BROADCAST = 16 << 20


def _product(a: str, b: str, lanes: int | None = None) -> Column:
    if lanes and lanes <= WRITTEN_OUT:
        return sum((F.get(a, F.lit(k)) * F.get(b, F.lit(k)) for k in range(lanes)), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _with_rows(plane: DataFrame, u: DataFrame, v: DataFrame, a: str = "a", b: str = "b", few: bool = False) -> DataFrame:
    sent = F.broadcast if few else lambda rows: rows
    return plane.join(sent(u.select(F.col("node").alias("src"), F.col("lanes").alias(a))), "src").join(sent(v.select(F.col("node").alias("dst"), F.col("lanes").alias(b))), "dst")


def worst_error(plane: DataFrame, u: DataFrame, v: DataFrame, lanes: int | None = None, few: bool = False) -> float:
    """Largest |fit - value| / max(|value|, 1) over all edges of a scaled plane."""
    error = F.abs(_product("a", "b", lanes) - F.col("value")) * F.sqrt("w")
    found = _with_rows(plane, u, v, few=few).agg(F.max(error).alias("e")).first().e
    return 0.0 if found is None else float(found)


def start_rows(plane: DataFrame, lanes: int) -> tuple[DataFrame, DataFrame]:
    """First rows: lane 0 holds the mean of a source, lane 1 the mean of a target less the mean of all, which
    is exact where a value is a sum of one for each; a tenth of a normal spread, fixed by the node's number, on the others."""
    whole = plane.agg(F.avg("value").alias("m")).first().m or 0.0

    def noise(side: str) -> list[Column]:
        radius = lambda k: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("node", F.lit(k), F.lit(side)), F.lit(1 << 24)) + 0.5) / float(1 << 24)))
        angle = lambda k: F.cos(2 * math.pi * F.pmod(F.xxhash64("node", F.lit(k), F.lit(side + "2")), F.lit(1 << 24)) / float(1 << 24))
        return [0.1 * lanes**-0.25 * radius(k) * angle(k) for k in range(2, lanes)]

    rows = plane.groupBy(F.col("src").alias("node")).agg(F.avg("value").alias("m")).select("node", F.array(F.col("m"), *([F.lit(1.0)] if lanes > 1 else []), *noise("u")).alias("lanes"))
    cols = plane.groupBy(F.col("dst").alias("node")).agg(F.avg("value").alias("m"))
    cols = cols.select("node", F.array(F.lit(1.0), *([F.col("m") - F.lit(whole)] if lanes > 1 else []), *noise("v")).alias("lanes"))
    return stored(rows, "u"), stored(cols, "v")


def balanced(u: DataFrame, v: DataFrame, lanes: int) -> tuple[DataFrame, DataFrame]:
    """The same products with each lane as long on one side as on the other."""
    squares = lambda rows, name: rows.agg(F.array(*[F.sum(F.get("lanes", F.lit(k)) * F.get("lanes", F.lit(k))) for k in range(lanes)]).alias(name))
    found = squares(u, "a").crossJoin(squares(v, "b")).first()
    factors = [(b / a) ** 0.25 if a and b else 1.0 for a, b in zip(found.a, found.b)]
    times = lambda rows, f: rows.select("node", F.zip_with("lanes", F.array(*map(F.lit, f)), lambda x, y: x * y).alias("lanes"))
    return times(u, factors), times(v, [1 / f for f in factors])


def _normal(plane: DataFrame, other: DataFrame, side: str, against: str, lanes: int, use, kinds: str) -> DataFrame:
    """What ``use(matrices, right sides)`` gives for the normal equations of each node of ``side``, given the rows of the other side.

    The sums of each node are added up before the shuffle, so a node of very many edges is no burden.
    """
    both = plane.join(other.select(F.col("node").alias(against), F.col("lanes").alias("x")), against)
    pairs = [F.sum(F.col("w") * F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i in range(lanes) for j in range(i, lanes)]
    right = [F.sum(F.col("w") * F.get("x", F.lit(i)) * F.col("value")) for i in range(lanes)]
    sums = both.groupBy(F.col(side).alias("node")).agg(F.array(*pairs, *right).alias("s"))
    upper = np.triu_indices(lanes)

    def run(batches):
        for frame in batches:
            if not len(frame):
                continue
            s = np.stack(frame["s"])
            m = np.zeros((len(s), lanes, lanes))
            m[:, upper[0], upper[1]] = s[:, : len(upper[0])]
            m[:, upper[1], upper[0]] = s[:, : len(upper[0])]
            yield pd.DataFrame({"node": frame["node"]} | use(m, s[:, len(upper[0]) :, None]))

    return sums.mapInPandas(run, f"node long, {kinds}")


def solve_side(plane: DataFrame, other: DataFrame, side: str, against: str, lanes: int, ridge: float = RIDGE) -> DataFrame:
    """Rows of ``side`` that fit all its edges best, given the rows of the other side; a task solves one small system a node."""
    solve = lambda m, right: {"lanes": list(np.linalg.solve(m + ridge * np.eye(lanes), right)[:, :, 0])}
    return _normal(plane, other, side, against, lanes, solve, "lanes array<double>")


def _units(plane: DataFrame, other: DataFrame, side: str, against: str, lanes: int, ridge: float) -> DataFrame:
    """For each node of ``side`` the rows of a matrix, and its columns: the inverse of the lower factor of the node's own curvature.

    A hundredth of its mean is added to the curvature, so that nodes of few edges take no far steps where these say nothing.
    """

    def factor(m, _):
        trace = np.trace(m, axis1=1, axis2=2)[:, None, None]
        inverse = np.linalg.inv(np.linalg.cholesky(m + (ridge + np.where(trace > 0, 1e-2 * trace / lanes, 1.0)) * np.eye(lanes)))
        return {"rows": [x.tolist() for x in inverse], "columns": [x.T.tolist() for x in inverse]}

    return _normal(plane, other, side, against, lanes, factor, "rows array<array<double>>, columns array<array<double>>")


def _moved(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` with those of ``new`` in place of theirs."""
    return rows.join(new.select("node", F.col("lanes").alias("_n")), "node", "left").select("node", F.coalesce("_n", "lanes").alias("lanes"))


def alternate(plane: DataFrame, lanes: int, tolerance: float = 0.0, sweeps: int = MOST_SWEEPS, start: tuple[DataFrame, DataFrame] | None = None, moved: tuple[DataFrame, DataFrame] | None = None, ridge: float = RIDGE) -> Fit:
    """Alternating least squares on a scaled plane: balance, sources, balance, targets, until the worst error is within
    ``tolerance``, stalls, or all sweeps are done; the best sweep is kept. ``moved`` (src, dst) names the only nodes whose rows move."""
    u, v = start or start_rows(plane, lanes)
    best = Fit(u, v, worst_error(plane, u, v), 0)
    after = [best.error]
    of_src = plane if moved is None else plane.join(moved[0].select(F.col("node").alias("src")), "src", "left_semi")
    of_dst = plane if moved is None else plane.join(moved[1].select(F.col("node").alias("dst")), "dst", "left_semi")
    for sweep in range(1, sweeps + 1):
        if best.error <= tolerance:
            break
        u, v = balanced(u, v, lanes)
        new = solve_side(of_src, v, "src", "dst", lanes, ridge)
        u = stored(new if moved is None else _moved(u, new), "u")
        u, v = balanced(u, v, lanes)
        new = solve_side(of_dst, u, "dst", "src", lanes, ridge)
        u, v = stored(u, "u"), stored(new if moved is None else _moved(v, new), "v")
        error = worst_error(plane, u, v)
        if error < best.error:
            best = Fit(u, v, error, sweep)
        after.append(best.error)
        if sweep >= STALL_SWEEPS and best.error > (1 - STALL_GAIN) * after[sweep - STALL_SWEEPS]:
            break
    return Fit(best.u, best.v, best.error, len(after) - 1)


def _gradient(plane: DataFrame, u: DataFrame, v: DataFrame, lanes: int, ridge: float, few: bool = False) -> tuple[DataFrame, DataFrame]:
    """Derivatives of the objective by all rows: (node, lanes) of either side."""
    pull = _with_rows(plane, u, v, few=few).withColumn("r", F.col("w") * (_product("a", "b", lanes) - F.col("value")))

    def of(rows: DataFrame, side: str, against: str) -> DataFrame:
        sums = pull.groupBy(F.col(side).alias("node")).agg(F.array(*[F.sum(F.get(against, F.lit(k)) * F.col("r")) for k in range(lanes)]).alias("g"))
        return rows.join(sums, "node").select("node", F.zip_with("g", "lanes", lambda g, x: g + ridge * x).alias("lanes"))

    return of(u, "src", "b"), of(v, "dst", "a")


def direction(gram: np.ndarray, pairs: int) -> np.ndarray:
    """Weights of the vectors s_1.., y_1.., g (oldest first) that add up to the quasi-Newton direction, from their dot products alone."""
    n = 2 * pairs + 1
    d = np.zeros(n)
    d[-1] = -1.0
    alpha = np.zeros(pairs)
    for i in reversed(range(pairs)):
        alpha[i] = d @ gram[:, i] / gram[i, pairs + i]
        d[pairs + i] -= alpha[i]
    if pairs:
        d *= gram[pairs - 1, 2 * pairs - 1] / gram[2 * pairs - 1, 2 * pairs - 1]
    for i in range(pairs):
        beta = d @ gram[:, pairs + i] / gram[i, pairs + i]
        d[i] += alpha[i] - beta
    return d


def best_step(c: np.ndarray) -> float:
    """Where the polynomial c[0] + c[1] t + ... + c[4] t^4, which falls at 0, has its first low for t > 0."""
    roots = np.roots([4 * c[4], 3 * c[3], 2 * c[2], c[1]])
    lows = sorted(r.real for r in roots if abs(r.imag) < 1e-9 * max(1.0, abs(r)) and r.real > 0)
    return lows[0] if lows else 0.0


def quasi_newton(plane: DataFrame, lanes: int, tolerance: float = 0.0, steps: int = MOST_STEPS, start: tuple[DataFrame, DataFrame] | None = None, ridge: float = RIDGE) -> Fit:
    """Limited-memory BFGS on a scaled plane.

    Rows, their derivatives and the differences of the last steps are one table; the
    driver sees their dot products. Along a direction the objective is a polynomial of
    degree four, whose coefficients one pass over the edges adds up, so the first low
    is found exactly: there the slope is zero, which is within any Wolfe condition.
    Each node's derivatives are taken in units of its own curvature at the start, else
    nodes of many edges and of few would need very many steps.
    """
    u, v = start or start_rows(plane, lanes)
    side = lambda rows, name: rows.select(F.lit(name).alias("side"), "node", "lanes")
    both = lambda pair: side(pair[0], "u").unionByName(side(pair[1], "v"))
    join = lambda x, g: x.withColumnRenamed("lanes", "x").join(g.withColumnRenamed("lanes", "g"), ["side", "node"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    times = lambda matrix, x: F.transform(matrix, lambda row: dot(row, x))
    few = (u.count() + v.count()) * (8 * lanes + 24) <= MOST_BROADCAST
    units = _units(plane, v, "src", "dst", lanes, ridge).withColumn("side", F.lit("u")).unionByName(_units(plane, u, "dst", "src", lanes, ridge).withColumn("side", F.lit("v")))
    state = join(both((u, v)), both(_gradient(plane, u, v, lanes, ridge, few))).join(units, ["side", "node"]).withColumn("g", times("rows", F.col("g")))
    state = stored(state.withColumn("s", F.array().cast("array<array<double>>")).withColumn("y", F.array().cast("array<array<double>>")), "state")
    best, since, pairs = Fit(u, v, worst_error(plane, u, v, lanes, few), 0), 0, 0
    for step in range(1, steps + 1):
        if best.error <= tolerance or since >= STALL_STEPS:
            break
        vectors = [F.get("s", F.lit(i)) for i in range(pairs)] + [F.get("y", F.lit(i)) for i in range(pairs)] + [F.col("g")]
        upper = [(i, j) for i in range(len(vectors)) for j in range(i, len(vectors))]
        sums = state.agg(F.array(*[F.sum(dot(vectors[i], vectors[j])) for i, j in upper]).alias("d")).first()
        gram = np.zeros((len(vectors), len(vectors)))
        for (i, j), value in zip(upper, sums.d):
            gram[i, j] = gram[j, i] = value
        if gram[-1, -1] <= 1e-30:
            break
        weights = direction(gram, pairs)
        if weights @ gram[:, -1] >= 0:  # not downhill: forget what was and go down the gradient
            weights = np.zeros(len(vectors))
            weights[-1] = -1.0
        along = F.transform("g", lambda _, k: sum((F.lit(float(w)) * F.get(x, k) for w, x in zip(weights, vectors)), F.lit(0.0)))
        state = state.withColumn("e", along).withColumn("d", times("columns", F.col("e")))
        rows = lambda name, column: state.where(F.col("side") == name).select("node", F.col(column).alias("lanes"))  # noqa: E731,B023
        lines = _with_rows(_with_rows(plane, rows("u", "x"), rows("v", "x"), few=few), rows("u", "d"), rows("v", "d"), "da", "db", few)
        a, b, c = _product("a", "b", lanes) - F.col("value"), _product("a", "db", lanes) + _product("da", "b", lanes), _product("da", "db", lanes)
        terms = {"p0": a * a / 2, "p1": a * b, "p2": b * b / 2 + a * c, "p3": b * c, "p4": c * c / 2}
        p = lines.agg(*[F.sum(F.col("w") * t).alias(k) for k, t in terms.items()]).first()
        own = state.agg(F.sum(dot("x", "d")).alias("xd"), F.sum(dot("d", "d")).alias("dd")).first()
        t = best_step(np.array([p.p0, p.p1 + ridge * own.xd, p.p2 + ridge * own.dd / 2, p.p3, p.p4]))
        if t <= 0:
            break
        moved = state.select("side", "node", F.zip_with("x", "d", lambda x, d: x + t * d).alias("x"), "g", F.transform("e", lambda e: e * t).alias("now"), "s", "y", "rows", "columns")
        moved = stored(moved, "moved")
        u, v = (moved.where(F.col("side") == n).select("node", F.col("x").alias("lanes")) for n in ("u", "v"))
        g = both(_gradient(plane, u, v, lanes, ridge, few)).withColumnRenamed("lanes", "new")
        keep = lambda old, new: F.slice(F.concat(old, F.array(new)), F.greatest(F.lit(1), F.size(old) + 2 - HISTORY), HISTORY)
        state = stored(moved.join(g, ["side", "node"]).withColumn("new", times("rows", F.col("new"))).select("side", "node", "x", F.col("new").alias("g"), keep(F.col("s"), F.col("now")).alias("s"), keep(F.col("y"), F.zip_with("new", "g", lambda a, b: a - b)).alias("y"), "rows", "columns"), "state")
        pairs = min(pairs + 1, HISTORY)
        error = worst_error(plane, u, v, lanes, few)
        since = since + 1 if error > (1 - STALL_GAIN) * best.error else 0
        if error < best.error:
            best = Fit(u, v, error, step)
    return Fit(best.u, best.v, best.error, best.rounds)


def fit(edges: DataFrame, lanes: int, sweeps: int = MOST_SWEEPS, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Rows of sources and of targets, in the plane's own units, of edges (src, dst, weight)."""
    plane, unit = scaled(edges)
    found = alternate(plane, lanes, tolerance, sweeps)
    return found.u.select("node", F.transform("lanes", lambda x: x * F.lit(unit)).alias("lanes")), found.v


def errors(edges: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """Root mean square of the plane and of what the fit leaves, and its worst error: one row."""
    rows = _with_rows(edges, u, v).withColumn("fit", _product("a", "b"))
    whole = edges.agg(F.sqrt(F.avg(F.col("weight") * F.col("weight"))).alias("rms"))
    left = F.abs(F.col("fit") - F.col("weight"))
    return rows.crossJoin(F.broadcast(whole)).agg(F.max("rms").alias("rms"), F.sqrt(F.avg(left * left)).alias("error"), F.max(left / F.greatest(F.abs("weight"), F.col("rms"), F.lit(1e-300))).alias("worst"))


def lane_errors(edges: DataFrame, lanes: list[int], sweeps: int = 5) -> DataFrame:
    """One row for each number of lanes: the error of its fit against the plane's root mean square."""
    out = None
    for n in lanes:
        row = errors(edges, *fit(edges, n, sweeps)).select(F.lit(n).alias("lanes"), F.round("rms", 9).alias("rms"), F.round("error", 6).alias("error"), F.round("worst", 6).alias("worst"))
        out = row if out is None else out.unionByName(row)
    return out


def _wider(found: Fit, plane: DataFrame, lanes: int, more: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``found`` with new lanes that leave all products as they are: nothing on the sources' side."""
    _, fresh = start_rows(plane, lanes + more + 2)
    u = found.u.select("node", F.concat("lanes", F.array_repeat(F.lit(0.0), more)).alias("lanes"))
    v = found.v.join(fresh.select("node", F.col("lanes").alias("f")), "node").select("node", F.concat("lanes", F.slice("f", lanes + 3, more)).alias("lanes"))
    return stored(u, "u"), stored(v, "v")


def fewest_lanes(edges: DataFrame, tolerance: float, most: int = 64, sweeps: int = MOST_SWEEPS, method: str = "alternate") -> tuple[int, float, bool]:
    """Fewest lanes whose worst error is within ``tolerance``: 1, 2, 4, ... up to ``most``, then by halves between the last that
    missed and the first that held. Returns the lanes, their error, and whether the tolerance is met.

    Each probe starts from the rows of the last that missed. The search ends where two doublings in a
    row gained under 5 % each; a plane of zeros needs no lanes.
    """
    solve = {"alternate": alternate, "quasi-newton": quasi_newton}[method]
    plane, unit = scaled(edges)
    if not unit:
        return 0, 0.0, True

    def probe(n: int, low: tuple[int, Fit] | None) -> Fit:
        return solve(plane, n, tolerance, sweeps, None if low is None else _wider(low[1], plane, low[0], n - low[0]))

    n, low, poor = 1, None, 0
    while True:
        found = probe(n, low)
        if found.error <= tolerance:
            break
        poor = poor + 1 if low is not None and found.error > (1 - STALL_GAIN) * low[1].error else 0
        low = n, found
        if n >= most or poor == 2:
            return n, found.error, False
        n = min(2 * n, most)
    high = n, found
    while low is not None and high[0] - low[0] > 1:
        n = (low[0] + high[0]) // 2
        found = probe(n, low)
        low, high = (low, (n, found)) if found.error <= tolerance else ((n, found), high)
    return high[0], high[1].error, True


def budgets(searched: DataFrame, fraction: float, cap: int) -> DataFrame:
    """Lanes (plane, wanted, lanes) of planes (plane, searched): the searched number times 1 + ``fraction``; a plane
    that starts at zero (0 searched) asks for as much as the largest. While all together pass ``cap`` a lane comes
    off the largest budget, of equal ones off that of the lowest plane, but never the last."""
    largest = searched.agg(F.max("searched").alias("m")).first().m or 0
    asked = F.when(F.col("searched") == 0, F.lit(largest)).otherwise(F.col("searched"))
    wanted = searched.select("plane", F.greatest(F.lit(1), F.ceil(asked * F.lit(1 + fraction))).cast("long").alias("wanted"))
    counts = sorted((r.wanted, r["count"]) for r in wanted.groupBy("wanted").count().collect())  # a row for each number of lanes
    whole = lambda h: sum(min(w, h) * c for w, c in counts)
    level = max((h for h in range(1, (counts[-1][0] if counts else 0) + 1) if whole(h) <= cap), default=1)
    spare = max(0, cap - whole(level))
    over = wanted.withColumn("over", (F.col("wanted") > level).cast("long"))
    total = sum(c for w, c in counts if w > level)
    ranked = prefix_sums(over, "plane", F.floor(F.col("plane") / 1024), "over")
    lanes = F.when((F.col("wanted") > level) & (F.col("over_sum") > total - spare), level + 1).otherwise(F.least("wanted", F.lit(level)))
    return ranked.select("plane", "wanted", lanes.cast("long").alias("lanes"))


class Lanes:
    """Which planes use which lanes of a basis: a lane is a plane's own if no other uses it, shared if several do, free if none does."""

    def __init__(self) -> None:
        self.users: list[set[str]] = []

    def owned(self, plane: str) -> list[int]:
        return [i for i, u in enumerate(self.users) if u == {plane}]

    def shared(self) -> list[int]:
        return [i for i, u in enumerate(self.users) if len(u) > 1]

    def free(self) -> list[int]:
        return [i for i, u in enumerate(self.users) if not u]

    def take(self, plane: str, count: int) -> list[int]:
        """So many lanes for a plane, free ones first, then new ones."""
        got = self.free()[:count]
        got += range(len(self.users), len(self.users) + count - len(got))
        self.users += [set() for _ in range(len(self.users), max(got, default=-1) + 1)]
        for i in got:
            self.users[i].add(plane)
        return got

    def share(self, plane: str, lane: int) -> None:
        """Let a plane use a lane that others have."""
        if not self.users[lane]:
            raise ValueError(f"nothing uses lane {lane}")
        self.users[lane].add(plane)

    def release(self, plane: str, keep: int = 0) -> list[int]:
        """Free a plane's own lanes but the first ``keep``, and leave the shared ones unless ``keep`` is 0; returns what is free now."""
        gone = self.owned(plane)[keep:]
        for i in gone if keep else range(len(self.users)):
            self.users[i].discard(plane)
        return gone

    def compact(self) -> dict[int, int]:
        """Move lanes in use to the front, in order; returns where each went."""
        used = [i for i, u in enumerate(self.users) if u]
        self.users = [self.users[i] for i in used]
        return {old: new for new, old in enumerate(used)}
