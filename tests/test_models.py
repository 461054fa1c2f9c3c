"""Models: the catalogue, single cells against closed forms, networks, frames and streams."""

import math
from collections import Counter

import numpy as np
import pytest

from axonframe.operators.queries_models import network_text
from axonframe.plans.strategy import choose, fold_cells
from axonframe.sources import frames as Fr
from axonframe.sources.model import ModelError, loads
from axonframe.streaming.network import Network, run_replicates

CELL = """<neuroml><iafCell id="c" leakConductance="4 nS" leakReversal="-62 mV" thresh="-48 mV" reset="-68 mV" C="120 pF"/>
<pulseGenerator id="p" delay="0 ms" duration="500 ms" amplitude="80 pA"/>
<network id="n"><population id="pop" component="c" size="1"/>{drive}</network><Simulation id="s" length="500 ms" step="0.05 ms" target="n"/></neuroml>"""
DRIVE = '<explicitInput target="pop[0]" input="p"/>'


def test_interval_of_a_driven_cell():
    ticks = [t for t, _ in Network(loads(CELL.format(drive=DRIVE))).run()]
    assert np.diff(ticks).mean() * 0.05 == pytest.approx(30 * math.log(26 / 6), abs=0.1)


def test_fold_agrees_with_the_engine(spark):
    model = loads(CELL.format(drive=DRIVE))
    want = sorted(t for t, _ in Network(model).run())
    alone = loads(CELL.format(drive=""))
    assert choose(alone).strategy == "fold"
    assert sorted(r.tick for r in fold_cells(spark, alone, 80e-12).collect()) == want


def test_replicates_depend_on_nothing_but_their_seed(spark):
    model = loads(network_text(30))
    assert choose(model).strategy == "replicates"
    rows = run_replicates(spark, model, [5, 5, 6]).collect()
    by = {r: sorted((x.tick, x.neuron) for x in rows if x.replicate == r) for r in range(3)}
    assert by[0] == by[1] == sorted(Network(model, 5).run()) and by[0] != by[2]


def test_delivery_takes_the_delay():
    text = """<neuroml><iafCell id="c" leakConductance="4 nS" leakReversal="-62 mV" thresh="-48 mV" reset="-68 mV" C="120 pF"/><spikeGenerator id="g" period="10 ms"/>
    <alphaCurrentSynapse id="s" tau="2 ms" ibase="40 pA"/><network id="n"><population id="a" component="g" size="1"/><population id="b" component="c" size="1"/>
    <projection id="p" presynapticPopulation="a" postsynapticPopulation="b" synapse="s"><connectionWD id="0" preCellId="../a[0]" postCellId="../b[0]" weight="1" delay="1 ms"/></projection></network>
    <Simulation id="x" length="12 ms" step="0.1 ms" target="n"/></neuroml>"""
    net = Network(loads(text))
    spike = moved = None
    for tick in range(120):
        if 0 in net.step() and spike is None:
            spike = tick
        if moved is None and net.state(1, "v") != -0.062:
            moved = tick
    assert moved == spike + 10 + 3


@pytest.mark.parametrize("text", [
    '<neuroml><ComponentType name="a" extends="b"/><ComponentType name="b" extends="a"/></neuroml>',
    '<neuroml><ComponentType name="a" extends="nothing"/></neuroml>',
    '<neuroml><network id="n"><population id="p" component="none" size="1"/></network></neuroml>',
    '<neuroml><ComponentType name="a"><Dynamics><StateVariable name="v"/><TimeDerivative variable="v" value="1"/><TimeDerivative variable="v" value="2"/></Dynamics></ComponentType></neuroml>',
    '<neuroml><ComponentType name="a"><Dynamics><DerivedVariable name="i" select="x[*]/i" reduce="multiply"/></Dynamics></ComponentType></neuroml>',
])
def test_refused(text):
    with pytest.raises(ModelError):
        loads(text)


def test_connect_refuses_repeats():
    model = loads(network_text(10))
    with pytest.raises(ModelError):
        model.connect([0], [1], "syn")


@pytest.mark.parametrize("codec", ["none", "gzip", "xz", "bz2"])
def test_frames(spark, tmp_path, codec):
    data = np.random.default_rng(1).normal(size=(7, 5)).astype(np.float32)
    raw = Fr.encode(data, codec, level=99)
    assert (Fr.decode(raw, codec) == data).all()
    ending = {"none": "", "gzip": ".gz", "xz": ".xz", "bz2": ".bz2"}[codec]
    (tmp_path / f"a.spire{ending}").write_bytes(raw)
    rows = Fr.read_frames(spark, str(tmp_path)).orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(7)) and np.allclose([r["values"] for r in rows], data)


def test_cut_frames():
    raw = Fr.encode(np.ones((2, 3), np.float32))[:-2]
    with pytest.raises(ValueError):
        Fr.decode(raw)
    assert len(Fr.decode(raw, permissive=True)) == 1


def test_spike_files(spark, tmp_path):
    rows = spark.createDataFrame([(0.5, "1"), (0.25, "0")], "time double, id string")
    Fr.write_spikes(rows, str(tmp_path / "s"))
    assert [tuple(r) for r in Fr.read_spikes(spark, str(tmp_path / "s")).orderBy("time").collect()] == [(0.25, "0"), (0.5, "1")]


def test_chain_passes_every_spike():
    spikes = "".join(f'<spike id="{i}" time="{20 + 50 * i}ms"/>' for i in range(4))
    model = loads(f"""<neuroml><iafRefCell id="c" leakConductance="10 nS" leakReversal="-70 mV" thresh="-50 mV" reset="-70 mV" C="100 pF" refract="5 ms"/><alphaCurrentSynapse id="s" tau="5 ms" ibase="600 pA"/>
    <spikeArray id="in">{spikes}</spikeArray><network id="n"><population id="p" component="c" size="3"/><inputList id="l" component="in" population="p"><input id="0" target="../p[0]" destination="synapses"/></inputList></network>
    <Simulation id="x" length="220 ms" step="0.1 ms" target="n"/></neuroml>""")
    model.connect([0, 1], [1, 2], "s", 1.0, 1e-3)
    assert Counter(n for _, n in Network(model).run()) == {0: 4, 1: 4, 2: 4}


RECORDED = CELL.replace('target="n"/>', 'target="n"><OutputFile id="o" fileName="v.dat"><OutputColumn id="v0" quantity="pop[0]/v"/></OutputFile>'
    '<OutputFile id="f" fileName="v.spire.gz"><OutputColumn id="v1" quantity="pop[0]/v"/></OutputFile><EventOutputFile id="e" fileName="s.dat" format="ID_TIME"><EventSelection id="c0" select="pop[0]" eventPort="spike"/></EventOutputFile></Simulation>')  # fmt: skip


def test_recording(spark, tmp_path):
    from axonframe.streaming.recorder import Recording

    whole = Recording(loads(RECORDED.format(drive=DRIVE)), video_stride=100).run()
    parts, seen = Recording(loads(RECORDED.format(drive=DRIVE)), video_stride=100), []

    def stop(tick):
        seen.append(tick)
        if tick == 1234:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        parts.run(after_each_tick=stop)
    parts.run(100).run()
    assert parts.spikes == whole.spikes and parts.rows == whole.rows and len(whole.rows) == 10_000 and seen[-1] == 1234
    with pytest.raises(ModelError):
        whole.run()
    whole.write(str(tmp_path))
    whole.write_video(str(tmp_path / "m.spire"))
    lines = (tmp_path / "v.dat").read_text().splitlines()
    assert lines[2].split("\t")[0] == "0.0001" and len(lines) == 10_000
    assert np.allclose(Fr.decode((tmp_path / "v.spire.gz").read_bytes(), "gzip")[:, 0], [r[0] for r in whole.rows])
    assert (tmp_path / "s.dat").read_text().startswith(f"c0\t{whole.spikes[0][0] * 5e-5:.9g}\n") and len(Fr.decode((tmp_path / "m.spire").read_bytes())) == 100
    assert whole.trace_table(spark).count() == 20_000 and whole.spike_table(spark).count() == len(whole.spikes)
    assert whole.mean_firing_rate() == pytest.approx(len(whole.spikes) / 0.5)
    with pytest.raises(ModelError):
        whole.state_variable_array("nothing")


def test_reservoir_features(spark):
    from axonframe.streaming.recorder import reservoir_features

    model = loads(network_text(12))
    items = spark.createDataFrame([(i, [i * 1e-11] * 5) for i in range(4)], "item long, drive array<double>")
    rows = {r.item: r.features for r in reservoir_features(spark, model, items, "item", "drive", 50.0, 600).collect()}
    assert all(len(f) == 16 for f in rows.values()) and rows[0] != rows[3]


def test_jumps_arrive_exactly_with_their_delay():
    text = """<neuroml><ComponentType name="jumpSynapse"><Parameter name="jump" dimension="voltage"/><Dynamics><StateVariable name="sum" exposure="sum"/>
      <OnEvent port="in"><StateAssignment variable="sum" value="sum + weight * jump"/></OnEvent></Dynamics></ComponentType>
    <ComponentType name="jumpCell"><Parameter name="tau" dimension="time"/><Dynamics><StateVariable name="v"/><StateVariable name="had"/><DerivedVariable name="all" select="synapses[*]/sum" reduce="add"/>
      <TimeDerivative variable="v" value="-1 * v / tau"/><OnCondition test="all .neq. had"><StateAssignment variable="v" value="v + all - had"/><StateAssignment variable="had" value="all"/></OnCondition></Dynamics></ComponentType>
    <jumpSynapse id="s" jump="1 mV"/><jumpCell id="c" tau="20 ms"/><spikeGenerator id="g" period="5 ms"/><network id="n"><population id="a" component="g" size="1"/><population id="b" component="c" size="1"/>
    <projection id="p" presynapticPopulation="a" postsynapticPopulation="b" synapse="s"><connectionWD id="0" preCellId="../a[0]" postCellId="../b[0]" weight="3" delay="1.5 ms"/></projection></network>
    <Simulation id="x" length="9 ms" step="0.1 ms" target="n"/></neuroml>"""
    net, v = Network(loads(text)), []
    for _ in range(90):
        net.step()
        v.append(net.state(1, "v"))
    first = next(i for i, x in enumerate(v) if x)
    assert first == 50 + 15 and v[first] == pytest.approx(3e-3) and v[first + 10] == pytest.approx(3e-3 * 0.995**10)


def test_a_synapse_must_show_what_its_cells_sum():
    text = network_text(10).replace("<alphaCurrentSynapse", '<ComponentType name="other"><Dynamics><StateVariable name="x" exposure="x"/></Dynamics></ComponentType><other id="o"/><alphaCurrentSynapse').replace('synapse="syn"', 'synapse="o"')
    with pytest.raises(ModelError):
        Network(loads(text))


def test_random_targets_are_filled_up(spark):
    from axonframe.operators import graph

    skip = spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long")
    got = {}
    for r in graph.random_fixed_outdegree(spark, 12, 11, 1, skip).collect():
        got.setdefault(r.src, []).append(r.dst)
    assert {k: sorted(v) for k, v in got.items()} == {i: [j for j in range(12) if j != i and (i or j not in (1, 2))] for i in range(12)}
    rows = graph.random_fixed_outdegree(spark, 49, 48, 1).collect()
    assert len(rows) == len(set(rows)) == 49 * 48


def ring_by_hand(cells, ticks, weights, delays):
    """The same ring of cells as below, each tick and each cell in turn, without numpy."""
    dt, tau, base, e = 1e-4, 3e-3, 70e-12, 2.7182818284590451
    v, since, spikes = [-0.062] * cells, [None] * cells, []
    links = [(i, (i * 3 + 1) % cells) for i in range(cells) if (i * 3 + 1) % cells != i]
    current, change = [0.0] * len(links), [0.0] * len(links)
    held = [0.0] * cells
    at = {}
    for tick in range(ticks):
        drive = [100e-12 if i % 2 == 0 and 0.002 <= tick / 10_000 < 0.002 + 0.058 else 0.0 for i in range(cells)]
        total, held = [h + d for h, d in zip(held, drive)], [0.0] * cells
        now = set()
        for i in range(cells):
            v[i] += dt * ((4e-9 * (-0.062 - v[i]) + total[i]) / 120e-12)
            if v[i] > -0.048:
                v[i] = -0.068
                now.add(i)
                spikes.append((tick, i))
        at[tick] = now
        for k, (a, b) in enumerate(links):
            held[b] += current[k]
            step_i, step_j = (e * change[k] - current[k]) / tau, -change[k] / tau
            current[k] += dt * step_i
            change[k] += dt * step_j
            if a in at.get(tick - delays[k], ()):
                change[k] += weights[k] * base
    return spikes


def test_network_against_brute_force():
    cells, ticks = 12, 900
    links = [(i, (i * 3 + 1) % cells) for i in range(cells) if (i * 3 + 1) % cells != i]
    weights, delays = [3.0 + k % 4 for k in range(len(links))], [5 + 7 * (k % 3) for k in range(len(links))]
    text = f"""<neuroml><iafCell id="c" leakConductance="4 nS" leakReversal="-62 mV" thresh="-48 mV" reset="-68 mV" C="120 pF"/><alphaCurrentSynapse id="s" tau="3 ms" ibase="70 pA"/>
    <pulseGenerator id="p" delay="2 ms" duration="58 ms" amplitude="100 pA"/><network id="n"><population id="a" component="c" size="{cells}"/>
    <projection id="j" presynapticPopulation="a" postsynapticPopulation="a" synapse="s">{"".join(f'<connectionWD id="{k}" preCellId="../a[{s}]" postCellId="../a[{d}]" weight="{weights[k]}" delay="{delays[k] / 10} ms"/>' for k, (s, d) in enumerate(links))}</projection>
    {"".join(f'<explicitInput target="a[{i}]" input="p"/>' for i in range(0, cells, 2))}</network><Simulation id="x" length="90 ms" step="0.1 ms" target="n"/></neuroml>"""
    got = list(Network(loads(text)).run())
    assert got == ring_by_hand(cells, ticks, weights, delays) and len(got) > 20 and any(n % 2 for _, n in got)


def test_synapses_come_to_rest():
    """A synapse that no spike reached for its settle time is at rest exactly, and is stepped no more; until then it moves as it always did."""
    model = loads(network_text(20))
    net, plain = Network(model, 3), Network(model, 3)
    assert net.synapses[0].settle > 100
    for x in plain.synapses:
        x.settle = 0
    for _ in range(600):
        assert net.step().tolist() == plain.step().tolist()
    x, y = net.synapses[0], plain.synapses[0]
    resting = x.until <= net.tick
    assert all((x.group.states[k][resting] == 0).all() and np.allclose(x.group.states[k], y.group.states[k], atol=1e-16) for k in x.group.states)


def test_derived_variables_in_any_order():
    text = """<neuroml><ComponentType name="late"><Dynamics><StateVariable name="v"/><DerivedVariable name="a" value="b + 1"/><DerivedVariable name="b" value="v * 2 + 3"/>
      <TimeDerivative variable="v" value="a"/></Dynamics></ComponentType><late id="c"/><network id="n"><population id="p" component="c" size="2"/></network><Simulation id="x" length="1 ms" step="0.1 ms" target="n"/></neuroml>"""
    net = Network(loads(text))
    net.step()
    assert net.state(0, "v") == pytest.approx(4e-4)
    for bad in ("b - 0 + a", "a"):
        with pytest.raises(ModelError):
            Network(loads(text.replace('value="v * 2 + 3"', f'value="{bad}"')))


def test_compiled_expressions_agree_with_the_interpreter():
    from axonframe.functions.expressions import compiled, evaluate, parse

    values = {"x": np.array([-2.0, 0.0, 0.5, 3.0]), "y": np.array([1.0, 0.0, -4.0, 2.0])}
    for e in ("x / y + exp(-x) * 2", "-x^2 + 2^3^2", "H(y) .and. x .gt. 0", "x == y .or. x .leq. -2", "sqrt(abs(x)) - ln(y + 5) / 3", "1 / x", "(x > y) * 4 - ceil(x / 3)"):
        with np.errstate(all="ignore"):
            assert np.array_equal(np.broadcast_to(compiled(parse(e))(values, None), 4), np.broadcast_to(evaluate(parse(e), values), 4), equal_nan=True), e


INPUTS = """<neuroml><iafCell id="c" leakConductance="4 nS" leakReversal="-62 mV" thresh="-48 mV" reset="-68 mV" C="120 pF"/><alphaCurrentSynapse id="s" tau="3 ms" ibase="70 pA"/>
<compoundInput id="two"><pulseGenerator id="a" delay="1 ms" duration="20 ms" amplitude="60 pA"/><pulseGenerator id="b" delay="5 ms" duration="30 ms" amplitude="40 pA"/></compoundInput><compoundInput id="none"/>
<timedSynapticInput id="timed" synapse="s"><spike id="0" time="3 ms"/><spike id="1" time="3 ms"/><spike id="2" time="9 ms"/></timedSynapticInput>
<pulseGenerator id="pa" delay="1 ms" duration="20 ms" amplitude="60 pA"/><pulseGenerator id="pb" delay="5 ms" duration="30 ms" amplitude="40 pA"/>
<network id="n"><population id="p" component="c" size="4"/>{drive}</network><Simulation id="x" length="40 ms" step="0.1 ms" target="n"/></neuroml>"""


def potentials(drive, ticks=400):
    net, out = Network(loads(INPUTS.format(drive=drive))), []
    for _ in range(ticks):
        net.step()
        out.append([net.state(i, "v") for i in range(4)])
    return np.array(out)


def test_parts_of_inputs_are_added():
    whole = potentials('<explicitInput target="p[0]" input="two"/><explicitInput target="p[1]" input="none"/>')
    parts = potentials('<explicitInput target="p[0]" input="pa"/><explicitInput target="p[0]" input="pb"/>')
    assert np.allclose(whole[:, 0], parts[:, 0], rtol=0, atol=1e-15) and (whole[:, 1] == -0.062).all() and whole[:, 0].max() > -0.055


def test_spikes_go_along_routes():
    v = potentials('<inputList id="l" component="timed" population="p"><inputW id="0" target="../p[2]" weight="0.5"/></inputList>')
    i = j = 0.0
    cell, e = -0.062, 2.7182818284590451
    for tick in range(400):
        cell += 1e-4 * ((4e-9 * (-0.062 - cell) + i) / 120e-12)
        step_i, step_j = (e * j - i) / 3e-3, -j / 3e-3
        i, j = i + 1e-4 * step_i, j + 1e-4 * step_j
        j += {30: 2, 90: 1}.get(tick, 0) * 0.5 * 70e-12
        assert v[tick, 2] == pytest.approx(cell, abs=1e-12)
    assert (v[:, 0] == -0.062).all()


@pytest.mark.parametrize("old,new", [
    ('value="(gain * v)"', 'value="(nothing * v)"'), ('variable="v" value="1 / S"', 'variable="w" value="1 / S"'), ('regime="on"', 'regime="away"'),
    ('initial="true"', ""), ('weight="1" delay="1 ms"', 'weight="1" delay="-1 ms"'), ('weight="1" delay', 'weight="nan" delay'), ('step="0.1 ms"', 'step="0 ms"'), ('synapse="y"', 'synapse="z"'),
])
def test_refused_before_a_run(old, new):
    text = """<neuroml><ComponentType name="cellx"><Parameter name="gain"/><Constant name="S" value="1s"/><Dynamics><StateVariable name="v"/><DerivedVariable name="g" value="(gain * v)"/><DerivedVariable name="all" select="synapses[*]/i" reduce="add"/>
      <Regime name="on" initial="true"><TimeDerivative variable="v" value="1 / S"/><OnCondition test="v .gt. 2"><Transition regime="off"/></OnCondition></Regime>
      <Regime name="off"><OnCondition test="v .gt. 3"><Transition regime="on"/></OnCondition></Regime></Dynamics></ComponentType><cellx id="c" gain="2"/><alphaCurrentSynapse id="y" tau="2 ms" ibase="1 pA"/>
    <network id="n"><population id="p" component="c" size="2"/><projection id="j" presynapticPopulation="p" postsynapticPopulation="p" synapse="y"><connectionWD id="0" preCellId="../p[0]" postCellId="../p[1]" weight="1" delay="1 ms"/></projection></network>
    <Simulation id="x" length="1 ms" step="0.1 ms" target="n"/></neuroml>"""
    Network(loads(text)).step()
    assert old in text
    with pytest.raises(ModelError):
        Network(loads(text.replace(old, new)))


def test_connections_from_lists_and_functions():
    a, b = loads(network_text(10)), loads(network_text(10))
    a.edges, b.edges = [], []
    lists = [[1, 2], [], [0], *[[] for _ in range(7)]]
    a.connect_lists(lists, "syn", 0.5, 2e-3)
    b.connect_by(lists, "syn", lambda s, t: (s + t / 10, 1e-3 * (1 + t)))
    assert a.edges == [(0, 1, "syn", 0.5, 2e-3), (0, 2, "syn", 0.5, 2e-3), (2, 0, "syn", 0.5, 2e-3)]
    assert b.edges == [(0, 1, "syn", 0.1, 2e-3), (0, 2, "syn", 0.2, 3e-3), (2, 0, "syn", 2.0, 1e-3)]
    for bad in ([[0, 0]], [[14]], [[-1]], [[1]]):
        with pytest.raises(ModelError):
            a.connect_lists(bad, "syn")
    with pytest.raises(ModelError):
        a.connect([4], [5], "syn", float("nan"))


def test_snapshots_are_of_one_tick(spark, tmp_path):
    import threading

    from axonframe.streaming.recorder import Recording

    run = Recording(loads(network_text(20)))
    thread = threading.Thread(target=run.run, args=(400,))
    thread.start()
    seen = []
    while thread.is_alive():
        s = run.snapshot()
        seen.append(s)
        assert all(t < s["tick"] for t, _ in s["spike_history"]) and len(s["traces"]) == s["tick"]
    thread.join()
    last = run.snapshot()
    assert last["tick"] == 400 and (last["last_spiked"][[n for _, n in last["spike_history"]]] >= 0).all() and set(last["cell_state"]) == {"pop", "poisson"}
    run.save(spark, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "spikes")).count() == len(run.spikes)


def test_random_numbers(spark):
    from pyspark.sql import functions as F

    from axonframe.functions import randoms as R

    a, b = R.RandomGenerator(5), R.RandomGenerator(5)
    assert a.uniform() == b.uniform() and (a.normal(size=4) == b.normal(size=4)).all() and a.poisson(3) == b.poisson(3) and a.exponential(2.0) == b.exponential(2.0)
    x = a.uniform(-1, 1, 20_000)
    assert -1 < x.min() and x.max() < 1 and abs(x.mean()) < 0.03
    rows = spark.range(20_000).select(R.uniform(3, F.col("id")).alias("u"), R.normal(3, F.col("id"), mean=2.0, deviation=0.5).alias("n"), R.exponential(3, F.col("id"), rate=4.0).alias("e"), R.poisson(3, F.col("id"), mean=6.0).alias("p")).toPandas()
    assert 0 < rows.u.min() and rows.u.max() < 1 and abs(rows.u.mean() - 0.5) < 0.01 and abs(rows.n.mean() - 2) < 0.02 and abs(rows.n.std() - 0.5) < 0.01
    assert abs(rows.e.mean() - 0.25) < 0.01 and abs(rows.p.mean() - 6) < 0.08 and abs(rows.p.var() - 6) < 0.3


def test_time_units():
    from axonframe.functions import units as U

    assert U.ms_to_seconds(2.5) == 0.0025 and U.seconds_to_ms(0.5) == 500 and U.tick_to_ms(15, 0.1) == pytest.approx(1.5)
    for f in (U.ms_to_seconds, U.seconds_to_ms):
        with pytest.raises(ValueError):
            f(-1)


def test_events_of_cells_run_once_an_arrival():
    text = """<neuroml><ComponentType name="counter"><Dynamics><StateVariable name="v"/><StateVariable name="n"/><DerivedVariable name="all" select="synapses[*]/i" reduce="add"/><DerivedVariable name="twice" value="n * 2"/>
      <TimeDerivative variable="v" value="0 * twice"/><OnEvent port="in"><StateAssignment variable="n" value="n * 2 + 1"/>PASS</OnEvent></Dynamics></ComponentType>
    <counter id="c"/><spikeGenerator id="g" period="2 ms"/><alphaCurrentSynapse id="s" tau="2 ms" ibase="1 pA"/><network id="n"><population id="a" component="g" size="3"/><population id="b" component="c" size="2"/>
    <projection id="p" presynapticPopulation="a" postsynapticPopulation="b" synapse="s"><connectionWD id="0" preCellId="../a[0]" postCellId="../b[0]" weight="1" delay="1 ms"/><connectionWD id="1" preCellId="../a[1]" postCellId="../b[0]" weight="1" delay="1 ms"/>
    <connectionWD id="2" preCellId="../a[2]" postCellId="../b[0]" weight="1" delay="1.5 ms"/><connectionWD id="3" preCellId="../a[2]" postCellId="../b[1]" weight="1" delay="1 ms"/></projection></network>
    <Simulation id="x" length="4 ms" step="0.1 ms" target="n"/></neuroml>"""
    net, seen = Network(loads(text.replace("PASS", ""))), {}
    first = None
    for tick in range(40):
        if 0 in net.step() and first is None:
            first = tick
        seen[tick] = (net.state(3, "n"), net.state(4, "n"))
    assert seen[first + 9] == (0, 0) and seen[first + 10] == (3, 1) and seen[first + 14] == (3, 1) and seen[first + 15] == (7, 1)
    spikes = list(Network(loads(text.replace("PASS", '<EventOut port="spike"/>'))).run())
    assert [(t, n) for t, n in spikes if n > 2][:3] == [(first + 10, 3), (first + 10, 4), (first + 15, 3)]
