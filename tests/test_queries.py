"""Every registered query with SQL gives the same rows in Spark and in DuckDB; the others run."""

import duckdb
import pandas as pd
import pytest

from axonframe.operators import catalogue, graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if hasattr(v, "__iter__") and not isinstance(v, str):
            return str(list(v))
        return "null" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


TIMES = [62_500, 187_500, 500, 1_500, 128_062_500, -62_500, -187_500, -500, -1, 0, 1, 499, 999_500, 1_704_067_211_172_500, 1_704_067_211_173_500, 253_402_300_799_999_500, None]


@pytest.mark.parametrize("name", ["spike_selection_time_id", "spike_selection_id_time"])
def test_selected_spikes_between_two_milliseconds(spark, tmp_path, name):
    """Times half-way between two milliseconds, times before 1970, and nulls."""
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    rows = [(i, 3 + i % 2 * 3, t) for i, t in enumerate(TIMES + [1_704_067_200_000_500 + 1_000_003_000 * k for k in range(200)])]
    duck.execute("CREATE TABLE e (event_id BIGINT, user_id BIGINT, t BIGINT)")
    duck.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    duck.execute(f"COPY (SELECT event_id, user_id, make_timestamp(t) AS ts, 'view' AS event_type, 1.0 AS value FROM e) TO '{tmp_path}/events.parquet'")
    duck.execute(f"COPY (SELECT * FROM (VALUES (3::BIGINT, 'A'), (6::BIGINT, NULL)) t(c_custkey, c_mktsegment)) TO '{tmp_path}/customer.parquet'")
    for t in ("events", "customer"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert len(got) == len(rows) and normal(got) == normal(want)


@pytest.mark.parametrize("name", ["membership", "non_edge_reads_zero"])
def test_pairs_are_not_shuffled(spark, name):
    """All pairs of a nation's customers and suppliers are made after the last shuffle."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [part" in plan.split("Exchange")[0]


@pytest.mark.parametrize("few", [0, 16 << 20])
def test_grid_against_all_pairs(spark, monkeypatch, few):
    """Repeated and unknown nodes, null parts and keys, negative targets, a source of very many edges."""
    monkeypatch.setattr(graph, "MOST_BROADCAST", few)
    sources = [(1, 0), (2, 0), (3, 1), (3, 1), (4, None), (5, 7), (None, 0)]
    targets = [(d, d % 3) for d in range(-150, 450)] + [(900, None), (9, 0), (None, 1)]
    edges = [(1, d, d / 8) for d in range(-150, 450)] + [(2, 9, None), (3, 10, 1.0), (3, 9, 2.0), (4, 9, 3.0), (77, 9, 4.0), (3, 5000, 5.0)]
    found = graph.grid(spark.createDataFrame(sources, "src long, part int"), spark.createDataFrame(targets, "dst long, part int"), spark.createDataFrame(edges, "src long, dst long, w double"), "w")
    known = {(s, d): w for s, d, w in edges}
    want = [(s, d, (s, d) in known, known.get((s, d))) for s, p in sources for d, q in targets if p is not None and p == q]
    got = [(r.src, r.dst, r.edge is not None, r.edge.w if r.edge else None) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
