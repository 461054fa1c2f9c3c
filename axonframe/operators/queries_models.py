"""Queries over models: expressions, quantities, single cells, networks and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.units import UNITS, quantity_to_si, split_quantity
from ..plans.storage import stored
from . import planes as P
from .registry import SPK, query, spikes, table

EV = "ev AS (SELECT event_id, coalesce(value, 0.0) / 10 AS x, (event_id % 17)::DOUBLE - 8 AS y FROM events)"


def samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.coalesce("value", F.lit(0.0)) / 10).alias("x"), ((F.col("event_id") % 17).cast("double") - 8).alias("y"))


def compiled(text: str):
    return X.column(X.parse(text), {"x": F.col("x"), "y": F.col("y")})


@query(f"WITH {EV} SELECT event_id, CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN x - 5 > 0 THEN 1.0 ELSE 0.0 END AS h FROM ev")
def heaviside_case(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", compiled("H(y) + H(x - 5)").alias("h"))


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN x > 6 AND y < 0 THEN x * 2 WHEN y >= 4 THEN x - y ELSE 0.0 END, 9) AS derived FROM ev")
def conditional_derived(spark, sf_dir):
    cases = [("x .gt. 6 .and. y .lt. 0", "x * 2"), ("y .geq. 4", "x - y")]
    out = F
    for test, value in cases:
        out = out.when(compiled(test) != 0, compiled(value))
    return samples(spark, sf_dir).select("event_id", F.round(out.otherwise(0.0), 9).alias("derived"))


@query(f"""WITH {EV} SELECT event_id, round(exp(-x / 5) + ln(1 + x) - sqrt(x), 6) AS a, round(abs(y) + ceil(x) - floor(y / 3), 6) AS b, round(sin(y) * cos(x) + tan(x / 20), 6) AS c,
round(sinh(y / 4) - cosh(y / 4) + tanh(y), 6) AS d, round(-pow(y, 2) + pow(pow(2, 3), 2), 6) AS e, CASE WHEN y = 0 THEN CASE WHEN x > 0 THEN 'inf' ELSE 'nan' END ELSE CAST(CAST(floor(x / y) AS BIGINT) AS VARCHAR) END AS f FROM ev""")
def lems_functions(spark, sf_dir):
    quotient = compiled("x / y")
    shown = F.when(F.isnan(quotient), "nan").when(quotient == float("inf"), "inf").otherwise(F.floor(F.when(F.abs(quotient) < 1e15, quotient)).cast("string"))
    texts = {"a": "exp(-x / 5) + ln(1 + x) - sqrt(x)", "b": "abs(y) + ceil(x) - floor(y / 3)", "c": "sin(y) * cos(x) + tan(x / 20)", "d": "sinh(y / 4) - cosh(y / 4) + tanh(y)", "e": "-y^2 + 2^3^2"}
    return samples(spark, sf_dir).select("event_id", *[F.round(compiled(t), 6).alias(n) for n, t in texts.items()], shown.alias("f"))


EXPRESSIONS = ("(gL * (EL - v) + iSyn) / C", "t .gt. lastSpikeTime + 2.7e-5", "-x^2 + .5", "H(v - 1) .and. random(3) .leq. 1")


_TOKENS = (
    "( gL * ( EL - v ) + iSyn ) / C",
    "t > lastSpikeTime + 2.7e-5",
    "- x ^ 2 + .5",
    "H ( v - 1 ) && random ( 3 ) <= 1",
)


@query(" UNION ALL ".join(f"SELECT '{e}' AS expression, CAST(i - 1 AS INTEGER) AS position, CASE WHEN i > len(w) THEN 'end' WHEN regexp_full_match(w[i], '[.]?[0-9].*') THEN 'number' WHEN regexp_full_match(w[i], '[A-Za-z].*') THEN 'name' ELSE 'op' END AS kind, coalesce(w[i], '') AS token FROM (SELECT string_split('{t}', ' ') AS w), range(1, {len(t.split()) + 2}) r(i)" for e, t in zip(EXPRESSIONS, _TOKENS)))
def tokenize_expressions(spark, sf_dir):
    rows = [(e, i, k, t) for e in EXPRESSIONS for i, (k, t) in enumerate(X.tokenize(e))]
    return spark.createDataFrame(rows, "expression string, position int, kind string, token string")


SUFFIXES = ("mV", "ms", "nS", "pA", "per_ms", "", "Mohm", "bad")
QTY = "q AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '-' ELSE '' END || p_size || CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END AS quantity FROM part)"


def quantities(spark, sf_dir):
    sign = F.when(F.col("p_partkey") % 11 == 0, "-").otherwise("")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(sign, F.col("p_size").cast("string"), suffix).alias("quantity"))


@query(f"WITH {QTY} SELECT p_partkey, CAST(regexp_extract(quantity, '^([+-]?[0-9]+)', 1) AS DOUBLE) AS number, regexp_extract(quantity, '([A-Za-z_]*)$', 1) AS suffix FROM q")
def quantity_parse(spark, sf_dir):
    return quantities(spark, sf_dir).select("p_partkey", split_quantity(F.col("quantity")).alias("s")).select("p_partkey", "s.number", "s.suffix")


@query(f"WITH {QTY}, u(suffix, scale) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v[0]!r}::DOUBLE)' for k, v in UNITS.items())}), p AS (SELECT p_partkey, CAST(regexp_extract(quantity, '^([+-]?[0-9]+)', 1) AS DOUBLE) AS number, regexp_extract(quantity, '([A-Za-z_]*)$', 1) AS suffix FROM q) SELECT p_partkey, number * scale AS si FROM p LEFT JOIN u USING (suffix)")
def unit_to_si(spark, sf_dir):
    return quantities(spark, sf_dir).select("p_partkey", quantity_to_si(F.col("quantity")).alias("si"))


@query(f"WITH {QTY}, u(suffix, dimension) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v[1]}{chr(39)})' for k, v in UNITS.items())}) SELECT dimension, count(*) AS n FROM q JOIN u ON regexp_extract(quantity, '([A-Za-z_]*)$', 1) = suffix GROUP BY dimension")
def dimension_check(spark, sf_dir):
    known = spark.createDataFrame([(k, v[1]) for k, v in UNITS.items()], "suffix string, dimension string")  # a few dozen rows
    q = quantities(spark, sf_dir).select(split_quantity(F.col("quantity"))["suffix"].alias("suffix"))
    return q.join(F.broadcast(known), "suffix").groupBy("dimension").agg(F.count("*").alias("n"))


DT, STEPS = 0.05, 10_000


@query(f"""WITH RECURSIVE s(k, v, n) AS (SELECT 0, -62.0::DOUBLE, 0 UNION ALL
SELECT k + 1, CASE WHEN v + {DT} * ((4.0 * (-62.0 - v) + 80.0) / 120.0) > -48 THEN -68.0::DOUBLE ELSE v + {DT} * ((4.0 * (-62.0 - v) + 80.0) / 120.0) END,
CASE WHEN v + {DT} * ((4.0 * (-62.0 - v) + 80.0) / 120.0) > -48 THEN k ELSE NULL END FROM s WHERE k < {STEPS}), f AS (SELECT n AS tick FROM s WHERE n IS NOT NULL AND k > 0)
SELECT tick, coalesce(tick - lag(tick) OVER (ORDER BY tick), -1) AS isi FROM f""")
def euler_iaf_isi(spark, sf_dir):
    """A driven cell stepped by a fold in one row; the ticks that it spikes on and their intervals."""
    start = F.struct(F.lit(-62.0).alias("v"), F.array().cast("array<int>").alias("spikes"))

    def step(a, k):
        v = a["v"] + F.lit(DT) * ((F.lit(4.0) * (F.lit(-62.0) - a["v"]) + 80.0) / 120.0)
        return F.struct(F.when(v > -48, -68.0).otherwise(v).alias("v"), F.when(v > -48, F.concat(a["spikes"], F.array(k))).otherwise(a["spikes"]).alias("spikes"))

    one = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), start, step)["spikes"].alias("s"))
    ticks = F.transform("s", lambda t, i: F.struct(t.alias("tick"), F.when(i > 0, t - F.get("s", i - 1)).otherwise(-1).alias("isi")))
    return one.select(F.explode(ticks).alias("r")).select("r.tick", "r.isi")


def _response_sql(kind: str) -> str:
    value = {"exp": "exp(-t / 5.0)", "alpha": "exp(1.0) * t / 5.0 * exp(-t / 5.0)"}[kind]
    return f"SELECT tick, round(CASE WHEN t >= 0 THEN {value} ELSE 0.0 END, 9) AS current FROM (SELECT tick, (tick * 0.1::DOUBLE - 2.0) AS t FROM range(500) r(tick))"


def _response(spark, text: str):
    t = F.col("tick") * F.lit(0.1) - 2.0
    value = X.column(X.parse(text), {"t": t})
    return spark.range(500).select(F.col("id").alias("tick")).select("tick", F.round(F.when(t >= 0, value).otherwise(0.0), 9).alias("current"))


@query(_response_sql("exp"))
def exp_synapse_response(spark, sf_dir):
    return _response(spark, "exp(-t / 5)")


@query(_response_sql("alpha"))
def alpha_synapse_response(spark, sf_dir):
    return _response(spark, f"{math.e!r} * t / 5 * exp(-t / 5)")


@query("""WITH s AS (SELECT event_id, -70.0 + coalesce(value, 0.0) / 5 AS v, -50.0 + event_id % 5 AS theta, -(event_id % 7) * 10.0 AS asc1, -(event_id % 3) * 20.0 AS asc2 FROM events),
n AS (SELECT event_id, v + 0.05 * ((10.0 * (-70.0 - v) + 500.0 + asc1 + asc2) / 100.0) AS v, theta + 0.05 * ((-50.0 - theta) / 50.0) AS theta, asc1 + 0.05 * (-asc1 / 100.0) AS asc1, asc2 + 0.05 * (-asc2 / 10.0) AS asc2 FROM s)
SELECT event_id, v > theta AS spiked, round(CASE WHEN v > theta THEN -70.0 ELSE v END, 9) AS v, round(CASE WHEN v > theta THEN theta + 5 ELSE theta END, 9) AS theta,
round(CASE WHEN v > theta THEN asc1 - 100 ELSE asc1 END, 9) AS asc1, round(CASE WHEN v > theta THEN asc2 - 200 ELSE asc2 END, 9) AS asc2 FROM n""")
def glif5_step(spark, sf_dir):
    """One tick of cells with an adapting threshold and two after-spike currents: all steps from the old state, then the reset."""
    e = table(spark, sf_dir, "events")
    old = e.select("event_id", (F.lit(-70.0) + F.coalesce("value", F.lit(0.0)) / 5).alias("v"), (F.lit(-50.0) + F.col("event_id") % 5).alias("theta"), (-(F.col("event_id") % 7) * 10.0).alias("asc1"), (-(F.col("event_id") % 3) * 20.0).alias("asc2"))
    change = {"v": "(10 * (0 - 70 - v) + 500 + asc1 + asc2) / 100", "theta": "(0 - 50 - theta) / 50", "asc1": "0 - asc1 / 100", "asc2": "0 - asc2 / 10"}
    names = {n: F.col(n) for n in change}
    new = old.select("event_id", *[(F.col(n) + F.lit(0.05) * X.column(X.parse(t), names)).alias(n) for n, t in change.items()])
    fired = F.col("v") > F.col("theta")
    reset = {"v": F.lit(-70.0), "theta": F.col("theta") + 5, "asc1": F.col("asc1") - 100, "asc2": F.col("asc2") - 200}
    return new.select("event_id", fired.alias("spiked"), *[F.round(F.when(fired, r).otherwise(F.col(n)), 9).alias(n) for n, r in reset.items()])


#: A network as text: driven cells in a ring with a few long connections.
def network_text(cells: int) -> str:
    links = "".join(f'<connectionWD id="{i}" preCellId="../pop[{i}]" postCellId="../pop[{(i * 7 + 1) % cells}]" weight="{0.5 + i % 3 / 4}" delay="{1 + i % 4} ms"/>' for i in range(cells) if (i * 7 + 1) % cells != i)
    drive = "".join(f'<explicitInput target="pop[{i}]" input="drive"/>' for i in range(0, cells, 3))
    return f"""<neuroml><iafRefCell id="cell" leakConductance="4 nS" leakReversal="-62 mV" thresh="-48 mV" reset="-68 mV" C="120 pF" refract="4 ms"/>
    <alphaCurrentSynapse id="syn" tau="3 ms" ibase="70 pA"/><pulseGenerator id="drive" delay="5 ms" duration="80 ms" amplitude="100 pA"/>
    <spikeGeneratorPoisson id="noise" averageRate="50 Hz"/>
    <network id="net"><population id="pop" component="cell" size="{cells}"/><population id="poisson" component="noise" size="4"/>
    <projection id="p" presynapticPopulation="pop" postsynapticPopulation="pop" synapse="syn">{links}</projection>{drive}</network>
    <Simulation id="s" length="100 ms" step="0.1 ms" target="net" seed="7"><EventOutputFile id="o" fileName="ring.dat" format="TIME_ID"><EventSelection id="0" select="pop[0]" eventPort="spike"/></EventOutputFile></Simulation></neuroml>"""


@query("SELECT i AS src, (i * 7 + 1) % 60 AS dst, 'syn' AS synapse, 0.5 + i % 3 / 4 AS weight, (1 + i % 4) / 1000.0::DOUBLE AS delay, CAST(row_number() OVER (ORDER BY i) - 1 AS BIGINT) AS doc_order FROM range(60) t(i) WHERE (i * 7 + 1) % 60 <> i")
def xml_connections(spark, sf_dir):
    from ..sources.model import loads

    return loads(network_text(60)).tables(spark)["edges"].withColumn("delay", F.round("delay", 9))


@query("SELECT i AS neuron, CASE WHEN i < 60 THEN 'pop' ELSE 'poisson' END AS population, CAST(CASE WHEN i < 60 THEN i ELSE i - 60 END AS INTEGER) AS index_in_population, CASE WHEN i < 60 THEN 'cell' ELSE 'noise' END AS cell FROM range(64) t(i)")
def xml_neurons(spark, sf_dir):
    from ..sources.model import loads

    return loads(network_text(60)).tables(spark)["neurons"]


@query()
def xml_declarations(spark, sf_dir):
    from ..sources.model import loads

    return loads(network_text(60)).tables(spark)["declarations"]


@query()
def network_vector_run(spark, sf_dir):
    """Spikes of a recurrent network, a task for each of four seeds."""
    from ..sources.model import loads
    from ..streaming.network import run_replicates

    return run_replicates(spark, loads(network_text(60)), [1, 2, 3, 4])


@query(f"""WITH {SPK}, b AS (SELECT neuron % 4 AS file, t_us // 86400000000 AS frame, count(*) AS n FROM spk GROUP BY 1, 2) SELECT file, count(*) AS frames, CAST(sum(n) AS BIGINT) AS total FROM b GROUP BY file""")
def spire_roundtrip(spark, sf_dir):
    """Daily counts as frames, encoded as compressed files and read back."""
    from ..sources.frames import decode_frames, encode_frames

    b = spikes(spark, sf_dir).groupBy((F.col("neuron") % 4).alias("file"), F.floor(F.col("t_us") / 86_400_000_000).alias("day")).agg(F.count("*").alias("n"))
    files = encode_frames(b.select("file", "day", F.array(F.col("n").cast("float")).alias("values")), "file", "day", "values", "gzip")
    return decode_frames(files, "file", "gzip").groupBy("file").agg(F.count("*").alias("frames"), F.sum(F.get("values", F.lit(0))).cast("long").alias("total"))


@query(f"WITH {SPK} SELECT neuron, count(*) AS n, max(t_us) AS last FROM spk GROUP BY neuron")
def stream_state_counts(spark, sf_dir):
    """Keyed streaming state over the events, run until all that there are have been read."""
    from ..streaming.network import latest, stream_counts

    schema = table(spark, sf_dir, "events").schema
    # the streaming source reads folders: the glob makes one of a single file too
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parque*")
    rows = stream.select(F.col("user_id").alias("neuron"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    return latest(spark, stream_counts(rows, "neuron", "t_us"), "stream_state_counts", "neuron")


@query()
def als_sweep(spark, sf_dir):
    """Error of low-rank fits of a connection plane with 1, 2 and 4 lanes after alternating sweeps."""
    from .factorise import lane_errors
    from .registry import edges

    return lane_errors(stored(edges(spark, sf_dir), "edges"), [1, 2, 4], sweeps=3)


def _delays(spark, sf_dir):
    """A plane that two lanes hold: a part of the source and a part of the target."""
    from .registry import edges

    return stored(edges(spark, sf_dir).select("src", "dst", (1 + F.col("src") % 7 + F.col("dst") % 5).cast("double").alias("weight")), "edges")


@query("SELECT 2 AS lanes, true AS met")
def lane_search(spark, sf_dir):
    """Fewest lanes that hold a plane of delays, each a sum of one for its source and one for its target: two, by definition."""
    from .factorise import TOLERANCES, fewest_lanes

    lanes, _, met = fewest_lanes(_delays(spark, sf_dir), TOLERANCES["normal"])
    return spark.createDataFrame([(lanes, met)], "lanes int, met boolean")


@query("SELECT true AS held")
def quasi_newton_fit(spark, sf_dir):
    """The same plane fitted by quasi-Newton steps: the worst error is within the coarse tolerance."""
    from .factorise import TOLERANCES, quasi_newton, scaled

    found = quasi_newton(scaled(_delays(spark, sf_dir))[0], 2, TOLERANCES["coarse"], steps=60)
    return spark.createDataFrame([(found.error <= TOLERANCES["coarse"],)], "held boolean")


@query()
def refit_plane(spark, sf_dir):
    """A plane with its deltas folded in, fitted again from the old rows: the worst error before any fit of the changes, and after."""
    from .edge_store import EdgeStore
    from .factorise import alternate, scaled, worst_error
    from .queries_planes import updates
    from .registry import edges

    store = EdgeStore.of(edges(spark, sf_dir), {"weight": F.col("weight")})
    plane, unit = scaled(store.neighbor_values("weight").withColumnRenamed("value", "weight"))
    old = alternate(plane, 2, sweeps=2)
    changes = P.compact(updates(spark, sf_dir).where("plane = 0")).join(store.edges, "ordinal")
    store.accumulate(changes.select(F.lit("weight").alias("plane"), "src", "dst", (F.col("delta") / 1000).alias("delta")))
    changed, _ = scaled(store.neighbor_values("weight").withColumnRenamed("value", "weight"))
    before = worst_error(changed, old.u, old.v)
    new = store.refit("weight", 2, old, sweeps=2)
    return spark.createDataFrame([("before", round(before, 6)), ("after", round(new.error, 6))], "fit string, error double")


@query("""WITH edge AS (SELECT o_custkey AS src, l_suppkey AS dst, round(avg(l_discount), 8) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT src, dst, round(weight + CASE WHEN src % 3 = 0 THEN (src + dst) % 5 ELSE 0 END, 9) AS value FROM edge""")
def edge_store_reads(spark, sf_dir):
    """Values of all edges after updates, two for an edge, read from a store that was saved and loaded."""
    import os
    import uuid

    from ..plans.storage import shared_dir
    from .edge_store import EdgeStore
    from .registry import edges

    store = EdgeStore.of(edges(spark, sf_dir), {"weight": F.col("weight")})
    change = store.edges.where("src % 3 = 0").select(F.lit("weight").alias("plane"), "src", "dst", ((F.col("src") + F.col("dst")) % 5 + 1.0).alias("delta"))
    store.accumulate(change.unionByName(change.withColumn("delta", F.lit(-1.0))))
    path = os.path.join(shared_dir(spark), f"saved-{uuid.uuid4().hex}")
    store.save(path)
    return EdgeStore.load(spark, path).neighbor_values("weight").select("src", "dst", F.round("value", 9).alias("value"))
