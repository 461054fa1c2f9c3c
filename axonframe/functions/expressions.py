"""The expression language of models: tokens, a parser, and compilers to numbers, numpy and Spark columns."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)(?=\.(?:gt|lt|geq|leq|eq|neq|and|or)\.|(?![\w.]))|(?P<dotted>\.(?:gt|lt|geq|leq|eq|neq|and|or)\.)|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||[<>=!]=|[-+*/^<>(),]))"
)
#: The dotted operators and what they stand for.
DOTTED = {".gt.": ">", ".lt.": "<", ".geq.": ">=", ".leq.": "<=", ".eq.": "==", ".neq.": "!=", ".and.": "&&", ".or.": "||"}
#: Binary operators from the loosest to the tightest; all take the left first.
LEVELS = (("||",), ("&&",), ("==", "!="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/"), ("^",))
FUNCTIONS = ("exp", "ln", "log", "sqrt", "abs", "ceil", "floor", "sin", "cos", "tan", "sinh", "cosh", "tanh", "H", "random")


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str  # number, name, call, negate, or binary
    value: object
    args: tuple["Node", ...] = ()


def tokenize(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token, and an ("end", "") last."""
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"can't read {text[at:]!r} of {text!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        out.append(("op", DOTTED[value]) if kind == "dotted" else (kind, value))
        at = m.end()
    return [*out, ("end", "")]


def parse(text: str) -> Node:
    tokens, at = tokenize(text), 0

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        kind, found = tokens[at]
        if value is not None and found != value:
            raise ExpressionError(f"{value!r} expected, not {found!r}, in {text!r}")
        at += 1
        return kind, found

    def binary(level: int) -> Node:
        # a sign binds more loosely than a power and more tightly than all else
        if level == len(LEVELS) - 1:
            if tokens[at] in (("op", "-"), ("op", "+")):
                sign = take()[1]
                inner = binary(level)
                return Node("negate", "-", (inner,)) if sign == "-" else inner
            left = atom()
        else:
            left = binary(level + 1)
        while tokens[at][0] == "op" and tokens[at][1] in LEVELS[level]:
            op = take()[1]
            signed = level == len(LEVELS) - 1 and tokens[at] in (("op", "-"), ("op", "+"))
            right = binary(level) if signed else atom() if level == len(LEVELS) - 1 else binary(level + 1)
            left = Node("binary", op, (left, right))
        return left

    def atom() -> Node:
        kind, value = take()
        if kind == "number":
            return Node("number", float(value))
        if kind == "name":
            if tokens[at] != ("op", "("):
                return Node("name", value)
            if value not in FUNCTIONS:
                raise ExpressionError(f"no function {value!r}")
            take("(")
            arg = binary(0)
            take(")")
            return Node("call", value, (arg,))
        if value == "(":
            inner = binary(0)
            take(")")
            return inner
        raise ExpressionError(f"{value or 'the end'!r} not expected in {text!r}")

    tree = binary(0)
    if tokens[at][0] != "end":
        raise ExpressionError(f"{tokens[at][1]!r} not expected in {text!r}")
    return tree


def names(tree: Node) -> set[str]:
    return {tree.value} if tree.kind == "name" else set().union(*(names(a) for a in tree.args)) if tree.args else set()


def _divide(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.divide(a, b)


_NUMPY: dict[str, Callable] = {
    "exp": np.exp, "ln": np.log, "log": np.log, "sqrt": np.sqrt, "abs": np.abs, "ceil": np.ceil, "floor": np.floor, "sin": np.sin, "cos": np.cos, "tan": np.tan,
    "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh, "H": lambda x: np.where(np.asarray(x) > 0, 1.0, 0.0),
    "+": np.add, "-": np.subtract, "*": np.multiply, "/": _divide, "^": np.power, ">": np.greater, "<": np.less, ">=": np.greater_equal, "<=": np.less_equal,
    "==": np.equal, "!=": np.not_equal, "&&": np.logical_and, "||": np.logical_or,
}


def evaluate(tree: Node, values: dict, rng: np.random.Generator | None = None):
    """Value for numbers or arrays; comparisons give 1.0 and 0.0, x/0 is infinite."""
    if tree.kind == "number":
        return tree.value
    if tree.kind == "name":
        if tree.value not in values:
            raise ExpressionError(f"no value for {tree.value!r}")
        return values[tree.value]
    args = [evaluate(a, values, rng) for a in tree.args]
    if tree.kind == "negate":
        return -args[0]
    if tree.value == "random":
        if rng is None:
            raise ExpressionError("random() has no generator here")
        return args[0] * rng.random(np.shape(args[0]))
    with np.errstate(all="ignore"):
        out = _NUMPY[tree.value](*[np.asarray(a, dtype=float) for a in args])
    out = np.asarray(out, dtype=float)
    return float(out) if out.ndim == 0 else out


_WRITTEN = {"+": "({0} + {1})", "-": "({0} - {1})", "*": "({0} * {1})", "/": "_n['/']({0}, {1})", "^": "_power({0}, {1})", "&&": "_true(_n['&&']({0}, {1}))", "||": "_true(_n['||']({0}, {1}))"}


def _power(a, b):
    return np.power(np.asarray(a, dtype=float), b)


def _true(test):
    return np.asarray(test, dtype=float)


def compiled(tree: Node) -> Callable[[dict, np.random.Generator | None], object]:
    """What :func:`evaluate` gives, as one function of (values, generator) for arrays of one length; the caller holds numpy's warnings back."""

    def written(t: Node) -> str:
        if t.kind == "number":
            return repr(t.value)
        if t.kind == "name":
            return f"v[{t.value!r}]"
        args = [written(a) for a in t.args]
        if t.kind == "negate":
            return f"(-{args[0]})"
        if t.value == "random":
            return f"_random({args[0]}, r)"
        if t.kind == "call":
            return f"_n[{t.value!r}]({args[0]})"
        if t.value in _WRITTEN:
            return _WRITTEN[t.value].format(*args)
        return f"_true(_n[{t.value!r}]({args[0]}, {args[1]}))"

    def _random(x, rng):
        if rng is None:
            raise ExpressionError("random() has no generator here")
        return x * rng.random(np.shape(x))

    made = eval(f"lambda v, r: {written(tree)}", {"_n": _NUMPY, "_power": _power, "_true": _true, "_random": _random})  # noqa: S307  of the parsed tree alone

    def run(values: dict, rng: np.random.Generator | None = None):
        try:
            return made(values, rng)
        except KeyError as missing:
            raise ExpressionError(f"no value for {missing.args[0]!r}") from None

    return run


def column(tree: Node, values: dict[str, Column]) -> Column:
    """A Spark column of doubles with the same results; division never raises."""
    if tree.kind == "number":
        return F.lit(tree.value)
    if tree.kind == "name":
        if tree.value not in values:
            raise ExpressionError(f"no column for {tree.value!r}")
        return values[tree.value].cast("double")
    args = [column(a, values) for a in tree.args]
    x, op = args[0], tree.value
    if tree.kind == "negate":
        return -x
    if tree.kind == "call":
        if op == "random":
            return x * F.rand()
        if op == "H":
            return F.when((x > 0) & ~F.isnan(x), 1.0).otherwise(0.0)
        if op in ("ln", "log"):
            return F.when(F.isnan(x), x).when(x > 0, F.log(x)).when(x == 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
        if op in ("ceil", "floor"):  # whole already, or not finite
            return F.when(F.abs(x) < 2.0**52, getattr(F, op)(x).cast("double")).otherwise(x)
        return getattr(F, op)(x).cast("double")
    y = args[1]
    if op == "/":
        # only its text tells a zero's sign; this is worked out for divisors of zero alone
        infinite = F.when(y.cast("string").startswith("-"), F.lit(-math.inf)).otherwise(F.lit(math.inf))
        return F.when(F.isnan(x) | F.isnan(y), F.lit(math.nan)).when(y != 0, F.try_divide(x, y)).when(x > 0, infinite).when(x < 0, -infinite).otherwise(F.lit(math.nan))
    simple = {"+": x + y, "-": x - y, "*": x * y, "^": F.pow(x, y)}
    if op in simple:
        return simple[op]
    test = {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "==": x == y, "!=": x != y, "&&": (x != 0) & (y != 0), "||": (x != 0) | (y != 0)}[op]
    if op in ("&&", "||"):
        return test.cast("double")
    # Spark has NaN equal to itself and above all numbers; here no comparison with it holds
    return F.when(F.isnan(x) | F.isnan(y), 1.0 if op == "!=" else 0.0).otherwise(test.cast("double"))
