"""Edge stores, adjacency, callbacks, bitmaps and fits against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import factorise as Fa
from axonframe.operators import graph as G
from axonframe.operators.edge_store import EdgeStore, StoreError


@pytest.fixture(scope="module")
def pairs():
    r = np.random.default_rng(1)
    return sorted({(int(a), int(b)) for a, b in r.integers(0, 25, (160, 2))})


@pytest.fixture(scope="module")
def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 0.5 + a % 4 + 0.25 * (b % 3), 1.0 + (a + b) % 5) for a, b in pairs], "src long, dst long, w double, d double")


def test_reads_updates_and_files(spark, tmp_path, frame, pairs):
    store = EdgeStore.of(frame, {"weight": F.col("w"), "delay": F.col("d")}, F.col("src") % 2)
    asked = spark.createDataFrame([*pairs[:20], (0, 99), (98, 1)], "src long, dst long")
    value = {(a, b): 0.5 + a % 4 + 0.25 * (b % 3) for a, b in pairs}
    assert {(r.src, r.dst): r.value for r in store.get(asked, "weight").collect()} == {p: value.get(p, 0.0) for p in [*pairs[:20], (0, 99), (98, 1)]}
    assert {(r.src, r.dst): r.delay_ticks for r in store.delay_ticks(asked).collect()} == {(a, b): 1 + (a + b) % 5 if (a, b) in value else 0 for a, b in [*pairs[:20], (0, 99), (98, 1)]}
    assert {(r.src, r.dst): r.prototype for r in store.prototypes(asked).collect()} == {(a, b): a % 2 if (a, b) in value else -1 for a, b in [*pairs[:20], (0, 99), (98, 1)]}
    (a, b), (c, d) = pairs[3], pairs[7]
    updates = lambda *rows: spark.createDataFrame(rows, "plane string, src long, dst long, delta double")
    store.accumulate(updates(("weight", a, b, 1.0), ("weight", a, b, 0.5), ("weight", c, d, 2.0), ("weight", c, d, -2.0)))
    assert store.deltas.count() == 1 and store.occupancy() == pytest.approx(1 / len(pairs))
    for bad in (("weight", 0, 99, 1.0), ("weight", a, b, float("nan")), ("weight", a, b, float("inf")), ("none", a, b, 1.0)):
        with pytest.raises(StoreError):
            store.accumulate(updates(("weight", a, b, 5.0), bad))
    value[a, b] += 1.5
    assert {(r.src, r.dst): r.value for r in store.neighbor_values("weight").collect()} == value
    store.save(str(tmp_path / "s"))
    other = EdgeStore.load(spark, str(tmp_path / "s"))
    assert {(r.src, r.dst): r.value for r in other.neighbor_values("weight").collect()} == value and other.planes == ["weight", "delay"]
    factor = other.scale_to_rms("weight", 2.0)
    assert other.stats("weight").first().rms == pytest.approx(2.0) and other.deltas.first().delta == pytest.approx(1.5 * factor)
    assert {r.value for r in other.neighbor_values("delay").collect()} == {1.0, 2.0, 3.0, 4.0, 5.0}
    with pytest.raises(StoreError):
        other.scale_to_rms("weight", -1.0)
    assert other.fold(500) == ["weight"] and other.deltas.count() == 0
    assert not other.refit_due(1400, every=100) and other.refit_due(1500, every=100) and not other.refit_due(1501, every=100) and not other.refit_due(1501, threshold=0.1)


def test_damaged_files_are_refused(spark, tmp_path, frame):
    store = EdgeStore.of(frame, {"weight": F.col("w")})
    store.save(str(tmp_path / "s"))
    store.values.withColumn("value", F.col("value") + 1).write.mode("overwrite").parquet(str(tmp_path / "s" / "values"))
    for path in ("s", "nothing"):
        with pytest.raises(StoreError):
            EdgeStore.load(spark, str(tmp_path / path))
    with pytest.raises(StoreError):
        EdgeStore.of(frame.unionByName(frame), {"weight": F.col("w")})


def test_runs(spark, frame, pairs):
    runs = lambda *rows: spark.createDataFrame(rows, "first_ordinal long, n long, prototype int, weight double")
    n = len(pairs)
    store = EdgeStore.of_runs(frame, runs((0, 5, 1, 0.5), (5, n - 5, 0, 2.0)), ["weight"])
    got = {r.ordinal: r.value for r in store.neighbor_values("weight").collect()}
    assert got == {i: 0.5 if i < 5 else 2.0 for i in range(n)} and store.edges.where("prototype = 1").count() == 5
    for bad in ([(0, 5, 1, 0.5)], [(0, 5, 1, 0.5), (4, n - 5, 0, 2.0)], [(0, n, -1, 1.0)], [(1, n, 0, 1.0)]):
        with pytest.raises(StoreError):
            EdgeStore.of_runs(frame, runs(*bad), ["weight"])


def test_adjacency_and_callbacks(spark):
    rows = spark.createDataFrame([(0, [2, 1]), (1, []), (2, [0, 2])], "node long, targets array<long>")
    edges = G.from_adjacency(rows)
    assert sorted((r.src, r.dst, r.position) for r in edges.collect()) == [(0, 1, 1), (0, 2, 0), (2, 0, 0), (2, 2, 1)]
    for bad in ([1, 1], [3], [-1], [None]):
        with pytest.raises(Exception, match="node"):
            G.from_adjacency(spark.createDataFrame([(0, bad), (1, []), (2, [])], "node long, targets array<long>")).collect()
    got = {(r.src, r.dst): (r.weight, r.delay) for r in G.from_callback(edges, lambda s, d: (s + 10.0 * d, 3)).collect()}
    assert got == {(0, 1): (10.0, 3.0), (0, 2): (20.0, 3.0), (2, 0): (2.0, 3.0), (2, 2): (22.0, 3.0)}


def test_bitmap_rank(spark):
    r = np.random.default_rng(2)
    bits = r.integers(0, 2, 300)
    words = [int(sum(int(b) << k for k, b in enumerate(bits[i : i + 64]))) for i in range(0, 300, 64)]
    words = [w - (1 << 64) if w >= 1 << 63 else w for w in words]
    one = spark.createDataFrame([(words, i) for i in range(300)], "w array<long>, i long")
    for x in one.select("i", G.rank1(F.col("w"), F.col("i")).alias("rank"), G.get_bit(F.col("w"), F.col("i")).alias("bit")).collect():
        assert (x["rank"], x.bit) == (bits[: x.i].sum(), bits[x.i])


def test_masks_of_wide_matrices(spark):
    edges = spark.createDataFrame([((1 << 30) - 1, 5), (3, (1 << 30) - 2), (3, (1 << 30) - 2)], "src long, dst long")
    got = {(r.level, r.prefix): r["mask"] for r in G.k2_masks(edges, 2, 31).collect()}
    want: dict = {}
    for s, d in ((1 << 30) - 1, 5), (3, (1 << 30) - 2):
        code = 0
        for level in range(30, -1, -1):
            digit = (s >> level & 1) * 2 + (d >> level & 1)
            want[31 - level, code] = want.get((31 - level, code), 0) | 1 << digit
            code = code * 4 + digit
    assert got == want
    with pytest.raises(ValueError):
        G.k2_masks(edges, 2, 40)


def plane_of(pairs, rank, seed=3):
    r = np.random.default_rng(seed)
    u, v = r.normal(size=(25, rank)), r.normal(size=(25, rank))
    return [(a, b, float(u[a] @ v[b])) for a, b in pairs]


def test_solved_rows_against_numpy(spark, pairs):
    rows = plane_of(pairs, 2)
    plane, unit = Fa.scaled(spark.createDataFrame(rows, "src long, dst long, weight double"))
    assert unit == pytest.approx(np.sqrt(np.mean([w * w for _, _, w in rows])))
    _, v = Fa.start_rows(plane, 3)
    got = {r.node: r.lanes for r in Fa.solve_side(plane, v, "src", "dst", 3, 0.01).collect()}
    other = {r.node: np.array(r.lanes) for r in v.collect()}
    for node, lanes in got.items():
        own = [(b, w / unit) for a, b, w in rows if a == node]
        x, y = np.array([other[b] for b, _ in own]), np.array([w for _, w in own])
        s = 1 / np.maximum(np.abs(y), 1) ** 2
        assert lanes == pytest.approx(np.linalg.solve((x * s[:, None]).T @ x + 0.01 * np.eye(3), (x * s[:, None]).T @ y))


def test_balance_keeps_products(spark, pairs):
    plane, _ = Fa.scaled(spark.createDataFrame(plane_of(pairs, 2), "src long, dst long, weight double"))
    u, v = Fa.start_rows(plane, 3)
    a, b = Fa.balanced(u, v, 3)
    table = lambda rows: {r.node: np.array(r.lanes) for r in rows.collect()}
    u, v, a, b = map(table, (u, v, a, b))
    assert all(a[s] * b[d] == pytest.approx(u[s] * v[d]) for s, d in pairs)
    assert sum(x * x for x in a.values()) == pytest.approx(sum(x * x for x in b.values()))


def test_start_is_exact_for_sums(spark, pairs):
    plane, _ = Fa.scaled(spark.createDataFrame([(a, b, 2.0 + a % 3) for a, b in pairs], "src long, dst long, weight double"))
    assert Fa.worst_error(plane, *Fa.start_rows(plane, 2)) < 1.0 and Fa.alternate(plane, 1, 1e-6, 3).error < 1e-6


def test_direction_against_the_two_loops():
    r = np.random.default_rng(4)
    s, g = r.normal(size=(3, 12)), r.normal(size=12)
    y = s @ (np.eye(12) * 2) + 0.1 * r.normal(size=(3, 12))
    q, alpha = -g.copy(), [0.0] * 3
    for i in (2, 1, 0):
        alpha[i] = s[i] @ q / (s[i] @ y[i])
        q -= alpha[i] * y[i]
    q *= s[2] @ y[2] / (y[2] @ y[2])
    for i in range(3):
        q += s[i] * (alpha[i] - y[i] @ q / (s[i] @ y[i]))
    vectors = np.vstack([s, y, g])
    assert Fa.direction(vectors @ vectors.T, 3) @ vectors == pytest.approx(q)
    assert Fa.best_step(np.array([3.0, -2.0, 1.0, 0.0, 0.0])) == pytest.approx(1.0)


def test_quasi_newton_gets_near(spark, pairs):
    plane, _ = Fa.scaled(spark.createDataFrame(plane_of(pairs, 1), "src long, dst long, weight double"))
    first = Fa.worst_error(plane, *Fa.start_rows(plane, 2))
    found = Fa.quasi_newton(plane, 2, 1e-3, steps=7)
    assert found.error < 0.7 * first and found.error == pytest.approx(Fa.worst_error(plane, found.u, found.v))


def test_refit_moves_changed_rows_only(spark, pairs):
    rows = [(a, b, 1.0 + a % 3) for a, b in pairs]
    store = EdgeStore.of(spark.createDataFrame(rows, "src long, dst long, weight double"), {"weight": F.col("weight")})
    plane, _ = Fa.scaled(store.neighbor_values("weight").withColumnRenamed("value", "weight"))
    old = Fa.alternate(plane, 2, 1e-6, 6)
    a, b = pairs[10]
    store.accumulate(spark.createDataFrame([("weight", a, b, 0.01)], "plane string, src long, dst long, delta double"))
    new = store.refit("weight", 2, old, 0.05, tick=7, sweeps=2)
    assert new.error <= 0.05 and store.last_refit == 7 and store.deltas.count() == 0


def test_budgets_take_from_the_largest():
    def plain(searched, fraction, cap):
        most = max(searched)
        out = [max(1, int(np.ceil((s or most) * (1 + fraction)))) for s in searched]
        while sum(out) > cap and max(out) > 1:
            out[out.index(max(out))] -= 1
        return out

    from pyspark.sql import SparkSession

    spark, r = SparkSession.getActiveSession(), np.random.default_rng(6)
    for cap in (5, 40, 75, 1000):
        searched = r.integers(0, 12, 15).tolist()
        got = Fa.budgets(spark.createDataFrame(list(enumerate(searched)), "plane long, searched int"), 0.25, cap)
        assert [x.lanes for x in got.orderBy("plane").collect()] == plain(searched, 0.25, cap)


def test_presets():
    assert Fa.delay_is_exact(Fa.TOLERANCES["normal"], 400) and not Fa.delay_is_exact(Fa.TOLERANCES["normal"], 500)


def test_search_bisects(spark, pairs, monkeypatch):
    """Three lanes are found between two that missed and four that held."""
    monkeypatch.setattr(Fa, "alternate", lambda plane, n, tolerance, sweeps, start: Fa.Fit(*Fa.start_rows(plane, n), 0.0 if n >= 3 else 1.0 / (1 + n) ** 3, 1))
    edges = spark.createDataFrame(plane_of(pairs, 1), "src long, dst long, weight double")
    assert Fa.fewest_lanes(edges, 1e-3) == (3, 0.0, True) and Fa.fewest_lanes(edges, 1e-3, most=2)[2] is False
    assert Fa.fewest_lanes(edges.withColumn("weight", F.lit(0.0)), 1e-3) == (0, 0.0, True)


def test_lanes_are_taken_released_and_moved():
    lanes = Fa.Lanes()
    assert lanes.take("a", 3) == [0, 1, 2] and lanes.take("b", 2) == [3, 4]
    lanes.share("b", 1)
    assert lanes.owned("a") == [0, 2] and lanes.shared() == [1] and lanes.free() == []
    assert lanes.release("a", keep=1) == [2] and lanes.free() == [2] and lanes.shared() == [1]
    assert lanes.take("c", 2) == [2, 5]
    lanes.release("b")
    assert lanes.owned("a") == [0, 1] and lanes.free() == [3, 4]
    assert lanes.compact() == {0: 0, 1: 1, 2: 2, 5: 3} and lanes.owned("c") == [2, 3] and lanes.free() == []
    with pytest.raises(ValueError):
        lanes.release("c")
        lanes.share("a", 3)


def test_quasi_newton_takes_few_steps(spark):
    """Sources of 1 to 60 edges: the fit of two lanes is there after five steps, not after dozens."""
    edges = spark.range(400).selectExpr("id AS src", "explode(sequence(0L, id % 60)) AS k").selectExpr("src", "(src * 31 + k * 7) % 83 AS dst", "CAST(1 + src % 7 + (src * 31 + k * 7) % 83 % 5 AS double) AS weight")
    plane, _ = Fa.scaled(edges)
    found = Fa.quasi_newton(plane, 2, 1e-2, steps=5)
    assert found.error <= 1e-2
    assert Fa.worst_error(plane, found.u, found.v) == pytest.approx(found.error, rel=1e-9)
