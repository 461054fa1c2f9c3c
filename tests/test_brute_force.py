"""Queries that have no SQL against plain doubles of theirs."""

import duckdb
import numpy as np
import pytest

from axonframe.operators import catalogue
from axonframe.operators.queries_models import network_text
from axonframe.sources.model import loads
from axonframe.streaming.network import Network

SF = "/root/testdata/sf0.001"
EDGES = f"SELECT o_custkey AS src, l_suppkey AS dst, round(avg(l_discount), 8) AS weight FROM '{SF}/orders.parquet' JOIN '{SF}/lineitem.parquet' ON o_orderkey = l_orderkey GROUP BY 1, 2"


@pytest.fixture(scope="module")
def vectors():
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return [i for i, _, _ in rows], np.array([e for _, e, _ in rows], dtype=float), np.array([y for _, _, y in rows])


def test_ridge_readout(spark, vectors):
    _, x, y = vectors
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(z.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.inv(z.T @ z + penalty) @ z.T @ np.eye(10)[y]
    row = catalogue.QUERIES["ridge_readout"](spark, SF).first()
    assert (row.n, row.correct) == (len(y), int(((z @ w).argmax(axis=1) == y).sum()))


def test_online_softmax(spark, vectors):
    ids, x, y = vectors
    for row in catalogue.QUERIES["online_softmax_fit"](spark, SF).collect():
        own = [k for k, i in enumerate(ids) if i % 4 == row.replicate]
        w, b, correct = np.zeros((10, x.shape[1])), np.zeros(10), 0
        for k in own:
            logits = w @ x[k] + b
            correct += int(logits.argmax() == y[k])
            p = np.exp(logits) / np.exp(logits).sum() - np.eye(10)[y[k]]
            w, b = w - 0.05 * p[:, None] * x[k], b - 0.05 * p
        assert (row.n, row.correct) == (len(own), correct)


def test_online_least_squares(spark, vectors):
    """After each row the weights are those of a ridge regression over all rows so far."""
    ids, x, y = vectors
    for row in catalogue.QUERIES["online_rls_fit"](spark, SF).collect():
        own, correct, w = [k for k, i in enumerate(ids) if i % 4 == row.replicate], 0, np.zeros((x.shape[1] + 1, 10))
        gram, right = np.eye(x.shape[1] + 1), np.zeros((x.shape[1] + 1, 10))
        for k in own:
            z = np.append(x[k], 1.0)
            correct += int((z @ w).argmax() == y[k])
            gram, right = gram + np.outer(z, z), right + np.outer(z, np.eye(10)[y[k]])
            w = np.linalg.solve(gram, right)
        assert row.n == len(own) and abs(row.correct - correct) <= 1


def test_network_vector_run(spark):
    want = sorted((r, t, n) for r, seed in enumerate((1, 2, 3, 4)) for t, n in Network(loads(network_text(60)), seed).run())
    assert sorted((r.replicate, r.tick, r.neuron) for r in catalogue.QUERIES["network_vector_run"](spark, SF).collect()) == want


def test_declarations(spark):
    rows = {(r.type, r.name): (r.kind, r.dimension, r.value) for r in catalogue.QUERIES["xml_declarations"](spark, SF).collect()}
    assert rows["iafCell", "C"] == ("Parameter", "capacitance", None) and rows["iafRefCell", "refract"] == ("Parameter", "time", None)
    assert rows["izhikevichCell", "MVOLT"] == ("Constant", None, "1mV") and rows["alphaCurrentSynapse", "i"][0] == "Exposure"
    assert {n for t, n in rows if t == "pulseGenerator"} == {"delay", "duration", "amplitude"}


def swept(rows, lanes, sweeps, u=None, v=None, only=None):
    """Alternating least squares with numpy on a plane in units of its root mean square; the rows with the least worst error."""
    value = np.array([w for _, _, w in rows])
    value = value / np.sqrt(np.mean(value**2))
    weight = 1 / np.maximum(np.abs(value), 1) ** 2
    src, dst = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    error = lambda: max(abs(u[s] @ v[d] - x) / max(abs(x), 1) for s, d, x in zip(src, dst, value))
    best = (error(), dict(u), dict(v))

    def solve(own, other, side, against):
        for node in set(side) if only is None else only[0 if own is u else 1] & set(side):
            at = np.flatnonzero(side == node)
            x = np.array([other[o] for o in against[at]])
            own[node] = np.linalg.solve((x * weight[at, None]).T @ x + 1e-7 * np.eye(lanes), (x * weight[at, None]).T @ value[at])

    for _ in range(sweeps):
        for own, other, side, against in ((u, v, src, dst), (v, u, dst, src)):
            a, b = sum(x * x for x in u.values()), sum(x * x for x in v.values())
            f = (b / a) ** 0.25
            for k in u:
                u[k] = u[k] * f
            for k in v:
                v[k] = v[k] / f
            solve(own, other, side, against)
        if error() < best[0]:
            best = (error(), dict(u), dict(v))
    return best


def test_sweeps(spark):
    from axonframe.operators import factorise as Fa

    rows = duckdb.sql(EDGES).fetchall()
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = {r.lanes: r.worst for r in catalogue.QUERIES["als_sweep"](spark, SF).collect()}
    plane, _ = Fa.scaled(edges)
    for lanes in (1, 2, 4):
        u, v = ({r.node: np.array(r.lanes) for r in side.collect()} for side in Fa.start_rows(plane, lanes))
        assert got[lanes] == pytest.approx(swept(rows, lanes, 3, u, v)[0], abs=2e-5)


def test_refit(spark):
    """The fit of changed values starts from the old rows and is better than those."""
    got = {r.fit: r.error for r in catalogue.QUERIES["refit_plane"](spark, SF).collect()}
    assert 0 < got["after"] < got["before"]
