"""Models in XML: component types, instances, populations, connections, inputs and recordings, as objects and as tables."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.expressions import Node, evaluate, names, parse
from ..functions.units import Units
from .library import LIBRARY


class ModelError(ValueError):
    pass


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


@dataclass
class Regime:
    name: str
    initial: bool
    derivatives: dict[str, Node] = field(default_factory=dict)
    entry: list[tuple[str, Node]] = field(default_factory=list)
    conditions: list[tuple] = field(default_factory=list)  # test, assignments, emits, next regime
    events: list[tuple] = field(default_factory=list)  # assignments and whether a spike goes out, for each arriving spike


@dataclass
class ComponentType:
    name: str
    extends: str | None
    declarations: dict[str, tuple[str, str | None, str | None]] = field(default_factory=dict)  # kind, dimension, value
    states: list[str] = field(default_factory=list)
    derived: list[tuple[str, list[tuple[Node | None, Node]], str | None]] = field(default_factory=list)  # name, cases, select
    start: list[tuple[str, Node]] = field(default_factory=list)
    events: list[tuple[str, Node]] = field(default_factory=list)
    #: Whether an arriving spike makes one go out, whatever the regime.
    passes_on: bool = False
    regimes: list[Regime] = field(default_factory=list)
    exposures: dict[str, str] = field(default_factory=dict)
    has_dynamics: bool = False
    #: Roles of parts, by whether there may be many; aliases of parts, references that are parts, and routes of events between aliases.
    parts: dict[str, bool] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    instances: list[str] = field(default_factory=list)
    routes: list[tuple[str, str]] = field(default_factory=list)


def _assignments(e: ET.Element) -> list[tuple[str, Node]]:
    return [(a.get("variable"), parse(a.get("value"))) for a in e if _tag(a) == "StateAssignment"]


def _condition(e: ET.Element) -> tuple:
    after = next((a.get("regime") for a in e if _tag(a) == "Transition"), None)
    return parse(e.get("test")), _assignments(e), any(_tag(a) == "EventOut" for a in e), after


def _type(e: ET.Element) -> ComponentType:
    t = ComponentType(e.get("name"), e.get("extends"))
    for c in e:
        tag = _tag(c)
        if tag in ("Parameter", "Constant", "DerivedParameter", "Property", "Text", "Path", "ComponentReference", "Fixed", "Exposure", "Requirement"):
            t.declarations[c.get("name") or c.get("parameter")] = (tag, c.get("dimension"), c.get("value"))
        if tag in ("Child", "Children"):
            t.parts[c.get("name")] = tag == "Children"
        if tag == "Structure":
            for x in c:
                if _tag(x) == "With":
                    t.aliases[x.get("as")] = x.get("instance")
                elif _tag(x) == "ChildInstance":
                    t.instances.append(x.get("component"))
                elif _tag(x) == "EventConnection":
                    t.routes.append((x.get("from"), x.get("to")))
        if tag != "Dynamics":
            continue
        t.has_dynamics = True
        whole = Regime("", True)
        for d in c:
            kind = _tag(d)
            if kind == "StateVariable":
                t.states.append(d.get("name"))
            elif kind == "DerivedVariable":
                cases = [(None, parse(d.get("value")))] if d.get("value") else []
                if d.get("select") and d.get("reduce") not in (None, "add") or "[*]" in (d.get("select") or "") and d.get("reduce") != "add":
                    raise ModelError(f"{t.name}: select of {d.get('name')} needs reduce=\"add\"")
                t.derived.append((d.get("name"), cases, d.get("select")))
            elif kind == "ConditionalDerivedVariable":
                t.derived.append((d.get("name"), [(parse(x.get("condition")) if x.get("condition") else None, parse(x.get("value"))) for x in d], None))
            elif kind == "TimeDerivative":
                if d.get("variable") in whole.derivatives:
                    raise ModelError(f"{t.name}: two derivatives of {d.get('variable')}")
                whole.derivatives[d.get("variable")] = parse(d.get("value"))
            elif kind == "OnStart":
                t.start += _assignments(d)
            elif kind == "OnEvent":
                t.events += _assignments(d)
                t.passes_on |= any(_tag(a) == "EventOut" for a in d)
            elif kind == "OnCondition":
                whole.conditions.append(_condition(d))
            elif kind == "Regime":
                r = Regime(d.get("name"), d.get("initial") == "true")
                for x in d:
                    if _tag(x) == "TimeDerivative":
                        r.derivatives[x.get("variable")] = parse(x.get("value"))
                    elif _tag(x) == "OnEntry":
                        r.entry += _assignments(x)
                    elif _tag(x) == "OnCondition":
                        r.conditions.append(_condition(x))
                    elif _tag(x) == "OnEvent":
                        r.events.append((_assignments(x), any(_tag(a) == "EventOut" for a in x)))
                t.regimes.append(r)
            if d.get("exposure"):
                t.exposures[d.get("exposure")] = d.get("name")
        if t.regimes:
            for r in t.regimes:
                r.derivatives = whole.derivatives | r.derivatives
                r.conditions = whole.conditions + r.conditions
        else:
            t.regimes = [whole]
    return t


@dataclass
class Component:
    id: str
    type: ComponentType
    values: dict[str, float]
    attributes: dict[str, str]
    spike_times: list[float] = field(default_factory=list)
    #: Parts with their roles, in order; each has the path of this component before its id.
    children: list[tuple[str, Component]] = field(default_factory=list)


class Model:
    """What a model's files declare; see :func:`load`."""

    def __init__(self):
        self.types: dict[str, ComponentType] = {}
        self.components: dict[str, Component] = {}
        self.populations: list[tuple[str, str, int]] = []
        self.edges: list[tuple[int, int, str, float, float]] = []  # src, dst, synapse, weight, delay in seconds
        self.inputs: list[tuple[int, str, float]] = []  # neuron, input, weight
        self.step, self.length, self.target, self.seed = 1e-4, 0.0, None, 0
        self.outputs: list[tuple[str, str, str, str]] = []  # file, format, selection, path
        self.units = Units()

    def lineage(self, name: str) -> list[ComponentType]:
        out, seen = [], []
        while name:
            if name in seen or name not in self.types:
                raise ModelError(f"{' -> '.join([*seen, name])}: " + ("a cycle" if name in seen else "not declared"))
            seen.append(name)
            out.append(self.types[name])
            name = self.types[name].extends
        return out

    def resolved(self, name: str) -> ComponentType:
        """A type with what it inherits: the nearest dynamics, all declarations, states of ancestors first."""
        line = self.lineage(name)
        nearest = next((t for t in line if t.has_dynamics), line[0])
        out = ComponentType(name, line[0].extends, {}, [], nearest.derived, nearest.start, nearest.events, nearest.passes_on, nearest.regimes, nearest.exposures, nearest.has_dynamics)
        for t in reversed(line):
            out.parts |= t.parts
            out.aliases |= t.aliases
            out.instances += [i for i in t.instances if i not in out.instances]
            out.routes += [r for r in t.routes if r not in out.routes]
            out.declarations |= t.declarations
            out.states += [s for s in t.states if s not in out.states]
        return out

    def offset(self, population: str) -> int:
        at = 0
        for name, _, size in self.populations:
            if name == population:
                return at
            at += size
        raise ModelError(f"no population {population!r}")

    def neuron(self, path: str) -> int:
        """Neuron number of ``pop[3]``, ``../pop[3]`` or ``pop/3/cell``, with any variable after it."""
        m = re.match(r"(?:\.\./)*(\w+)(?:\[(\d+)\]|/(\d+))", path)
        if not m:
            raise ModelError(f"not a path to a cell: {path!r}")
        size = next((s for n, _, s in self.populations if n == m[1]), -1)
        index = int(m[2] or m[3])
        if index >= size:
            raise ModelError(f"{path!r}: no such cell")
        return self.offset(m[1]) + index

    def connect(self, src, dst, synapse: str, weight=1.0, delay=0.0) -> None:
        """Connections from arrays of neuron numbers, with a weight and a delay for all or for each; a pair must not be there twice."""
        src, dst = np.asarray(src, dtype=np.int64), np.asarray(dst, dtype=np.int64)
        if src.shape != dst.shape or src.ndim != 1:
            raise ModelError("sources and targets have to be as many")
        size = sum(s for _, _, s in self.populations)
        weights, delays = (np.broadcast_to(np.asarray(x, dtype=float), len(src)) for x in (weight, delay))
        if len(src) and (min(src.min(), dst.min()) < 0 or max(src.max(), dst.max()) >= size):
            raise ModelError(f"a connection reaches outside of the {size} neurons")
        if not np.isfinite(weights).all() or not (delays >= 0).all():
            raise ModelError("weights have to be finite and delays not negative")
        known = np.array([(e[0], e[1]) for e in self.edges], dtype=np.int64).reshape(-1, 2)
        pairs = np.concatenate([known[:, 0] * size + known[:, 1], src * size + dst])
        if len(np.unique(pairs)) < len(pairs):
            raise ModelError("a connection is there twice")
        self.edges += zip(src.tolist(), dst.tolist(), [synapse] * len(src), weights.tolist(), delays.tolist())

    def connect_lists(self, adjacency: list, synapse: str, weight: float = 1.0, delay: float = 0.0) -> None:
        """Connections from adjacency lists: the i-th lists the targets of neuron i."""
        n = [len(row) for row in adjacency]
        self.connect(np.repeat(np.arange(len(n)), n), np.array([t for row in adjacency for t in row], dtype=np.int64), synapse, weight, delay)

    def connect_by(self, adjacency: list, synapse: str, values) -> None:
        """As :meth:`connect_lists`, with (weight, delay) of each connection from ``values(source, target)``, which must depend on nothing else."""
        pairs = [(i, t) for i, row in enumerate(adjacency) for t in row]
        found = np.array([values(s, t) for s, t in pairs], dtype=float).reshape(-1, 2)
        self.connect([s for s, _ in pairs], [t for _, t in pairs], synapse, found[:, 0], found[:, 1])

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The catalogue as small DataFrames, and neurons and connections as rows."""
        at, neurons = 0, []
        for name, cell, size in self.populations:
            neurons += [(at + i, name, i, cell) for i in range(size)]
            at += size
        frames = {
            "component_types": ([(t.name, t.extends) for t in self.types.values()], "name string, extends string"),
            "declarations": ([(t.name, i, k, n, d, v) for t in self.types.values() for i, (n, (k, d, v)) in enumerate(t.declarations.items())], "type string, ordinal int, kind string, name string, dimension string, value string"),
            "instances": ([(c.id, c.type.name, c.attributes) for c in self.components.values()], "id string, type string, data map<string,string>"),
            "neurons": (neurons, "neuron long, population string, index_in_population int, cell string"),
            "edges": ([(*e, i) for i, e in enumerate(self.edges)], "src long, dst long, synapse string, weight double, delay double, doc_order long"),
            "input_entries": ([(i, *e) for i, e in enumerate(self.inputs)], "entry long, neuron long, input string, weight double"),
            "recordings": (self.outputs, "file string, format string, selection_id string, quantity_path string"),
            "simulation": ([(self.step, self.length, round(self.length / self.step), self.seed)], "step_dt double, duration double, ticks long, seed long"),
        }
        return {k: spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", schema)]) if len(rows) > 10_000 else rows, schema) for k, (rows, schema) in frames.items()}


def load(path: str) -> Model:
    """Read a model's main file and what it includes, each file once; files of the standard library need not exist."""
    model, queue, seen, roots = Model(), [os.path.abspath(path)], set(), [ET.fromstring(LIBRARY)]
    while queue:
        file = queue.pop(0)
        if file in seen:
            continue
        seen.add(file)
        root = ET.parse(file).getroot()
        roots.append(root)
        for e in root:
            if _tag(e) in ("Include", "include"):
                found = os.path.join(os.path.dirname(file), e.get("file") or e.get("href"))
                if os.path.exists(found):
                    queue.append(os.path.abspath(found))
    return _build(model, roots)


def loads(*texts: str) -> Model:
    """As :func:`load`, of documents held in memory."""
    return _build(Model(), [ET.fromstring(LIBRARY), *map(ET.fromstring, texts)])


def _build(model: Model, roots: list[ET.Element]) -> Model:
    library = roots[0]
    for root in roots:
        for e in root:
            if _tag(e) == "Unit":
                scale = float(e.get("scale") or 1) * 10 ** int(e.get("power") or 0)
                model.units.table[e.get("symbol")] = (scale, e.get("dimension"), float(e.get("offset") or 0))
            elif _tag(e) == "ComponentType":
                if e.get("name") in model.types and root is not library and any(t.get("name") == e.get("name") for r in roots if r is not library and r is not root for t in r if _tag(t) == "ComponentType"):
                    raise ModelError(f"type {e.get('name')!r} is declared twice")
                model.types[e.get("name")] = _type(e)
            elif _tag(e) == "Target":
                model.target = model.target or e.get("component")
    for name in model.types:
        model.lineage(name)
    networks = []
    for root in roots:
        for e in root:
            tag = e.get("type") if _tag(e) == "Component" else _tag(e)
            if tag in model.types and e.get("id"):
                model.components[e.get("id")] = _component(model, tag, e)
            elif tag == "network":
                networks.append(e)
            elif tag == "Simulation":
                model.step, model.length = model.units.resolve(e.get("step"), "time"), model.units.resolve(e.get("length"), "time")
                model.seed = int(e.get("seed") or 0)
                for out in e:
                    for s in out:
                        quantity = s.get("quantity") or s.get("select")
                        model.outputs.append((out.get("fileName"), out.get("format") or "columns", s.get("id"), quantity))
    for e in networks:
        _network(model, e)
    return model


def _component(model: Model, tag: str, e: ET.Element) -> Component:
    kind = model.resolved(tag)
    values: dict[str, float] = {}
    for name, (what, dimension, fixed) in kind.declarations.items():
        text = fixed if what in ("Constant", "Fixed") else e.get(name)
        if what in ("Parameter", "Constant", "Fixed", "Property") and text is not None:
            values[name] = model.units.resolve(text, dimension if what == "Parameter" else None)
    waiting = {n: parse(v) for n, (what, _, v) in kind.declarations.items() if what == "DerivedParameter"}
    while waiting:
        ready = [n for n, tree in waiting.items() if names(tree) <= values.keys()]
        if not ready:
            raise ModelError(f"{e.get('id')}: can't work out {sorted(waiting)}")
        for n in ready:
            values[n] = evaluate(waiting.pop(n), values)
    times = [model.units.resolve(s.get("time"), "time") for s in e if _tag(s) == "spike"]
    out = Component(e.get("id"), kind, values, dict(e.attrib), times)
    for x in e:
        inner = x.get("type") if _tag(x) == "Component" else _tag(x)
        if inner in model.types and inner != "spike":
            role = inner if inner in kind.parts else next((r for r, many in kind.parts.items() if many), None) or next(iter(kind.parts), inner)
            part = _component(model, inner, x)
            part.id = f"{out.id}/{part.id or role}"
            out.children.append((role, part))
    return out


def check(model: Model) -> None:
    """Refuse what would not be simulated as it is written: names that nothing gives, states that aren't there, regimes and synapses not declared, times without sense."""
    if not (model.step > 0 and model.length >= 0):
        raise ModelError(f"a step of {model.step} s and a length of {model.length} s make no run")
    for e in model.edges:
        if e[2] not in model.components:
            raise ModelError(f"no synapse {e[2]!r}")
        if not np.isfinite(e[3]) or not e[4] >= 0:
            raise ModelError(f"connection {e[0]} -> {e[1]}: weight {e[3]}, delay {e[4]}")
    for _, name, _ in model.inputs:
        if name not in model.components:
            raise ModelError(f"no input {name!r}")
    used = {c for _, c, _ in model.populations} | {e[2] for e in model.edges} | {i[1] for i in model.inputs}
    for c in (model.components[n] for n in used):
        _check(c)


def _check(c: Component) -> None:
    kind = c.type
    regimes = [r.name for r in kind.regimes]
    if len(set(regimes)) < len(regimes) or len(regimes) > 1 and sum(r.initial for r in kind.regimes) != 1:
        raise ModelError(f"{kind.name}: of its regimes one has to be initial, and each has its name once")
    known = {*c.values, *kind.states, *(d[0] for d in kind.derived), "t", "weight", *(n for n, d in kind.declarations.items() if d[0] in ("Requirement", "Property"))}

    def read(tree: Node | None) -> None:
        if tree is not None and (missing := names(tree) - known):
            raise ModelError(f"{kind.name} ({c.id}): nothing gives {sorted(missing)}")

    def assigned(what: list) -> None:
        for name, tree in what:
            if name not in kind.states:
                raise ModelError(f"{kind.name}: {name!r} is assigned but is no state")
            read(tree)

    assigned(kind.start)
    assigned(kind.events)
    for _, cases, _ in kind.derived:
        for case in cases:
            for tree in case:
                read(tree)
    for r in kind.regimes:
        for name, tree in r.derivatives.items():
            if name not in kind.states:
                raise ModelError(f"{kind.name}: the derivative of {name!r}, which is no state")
            read(tree)
        assigned(r.entry)
        for what, _ in r.events:
            assigned(what)
        for test, what, _, after in r.conditions:
            read(test)
            assigned(what)
            if after is not None and after not in regimes:
                raise ModelError(f"{kind.name}: a transition to {after!r}, which is no regime")
    for _, part in c.children:
        _check(part)


def _network(model: Model, e: ET.Element) -> None:
    get = lambda x, name, default: model.units.resolve(x.get(name), None) if x.get(name) else default
    for p in e:
        if _tag(p) == "population":
            size = int(p.get("size") or sum(_tag(i) == "instance" for i in p))
            if p.get("component") not in model.components:
                raise ModelError(f"population {p.get('id')!r}: no component {p.get('component')!r}")
            model.populations.append((p.get("id"), p.get("component"), size))
    for p in e:
        if _tag(p) == "projection":
            for c in p:
                model.edges.append((model.neuron(c.get("preCellId")), model.neuron(c.get("postCellId")), p.get("synapse"), float(c.get("weight") or 1.0), get(c, "delay", 0.0)))
        elif _tag(p) == "explicitInput":
            model.inputs.append((model.neuron(p.get("target")), p.get("input"), 1.0))
        elif _tag(p) == "inputList":
            model.inputs += [(model.neuron(i.get("target")), p.get("component"), float(i.get("weight") or 1.0)) for i in p]
        elif _tag(p) in ("electricalProjection", "continuousProjection", "explicitConnection"):
            raise ModelError(f"{_tag(p)} isn't supported")
