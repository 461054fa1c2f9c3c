import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axonframe.functions import expressions as X
from axonframe.functions.units import Units, ms_to_ticks, quantity_to_si


@pytest.mark.parametrize("text,value", [("-x^2", -9), ("2^3^2", 64), ("1+2*3", 7), ("8-3-2", 3), ("x .gt. 1 .and. y .lt. 2", 1), ("2^-1", 0.5), ("H(0)+H(.5)", 1), ("1/0", math.inf), ("1.gt.2", 0), ("2.7e-5*2", 5.4e-5)])
def test_values(text, value):
    assert X.evaluate(X.parse(text), {"x": 3, "y": 1}) == pytest.approx(value)


@pytest.mark.parametrize("text", ["1.2.3", "foo(2)", "1 +", "!x", "(1", "1 2", "pow(2,3)"])
def test_refused(text):
    with pytest.raises(X.ExpressionError):
        X.parse(text)


def trees():
    leaf = st.one_of(st.integers(0, 9).map(str), st.sampled_from(["x", "y"]))
    return st.recursive(leaf, lambda t: st.one_of(st.tuples(t, st.sampled_from("+-*/"), t).map(lambda p: f"({p[0]} {p[1]} {p[2]})"), t.map(lambda a: f"H({a})"), t.map(lambda a: f"-{a}"), st.tuples(t, st.sampled_from([".gt.", "<=", "==", "&&", "||"]), t).map(lambda p: f"({p[0]} {p[1]} {p[2]})")), max_leaves=6)


@settings(max_examples=15, deadline=None)
@given(st.lists(trees(), min_size=8, max_size=8))
def test_column_agrees_with_evaluation(spark, texts):
    data = [(float(x), float(y)) for x in (-2, 0, 3) for y in (0, 1.5)]
    frame = spark.createDataFrame(data, "x double, y double")
    got = frame.select("x", "y", *[X.column(X.parse(t), {"x": F.col("x"), "y": F.col("y")}).alias(f"c{i}") for i, t in enumerate(texts)]).collect()
    for r in got:
        for i, t in enumerate(texts):
            want = X.evaluate(X.parse(t), {"x": r.x, "y": r.y})
            np.testing.assert_allclose(r[f"c{i}"], want, rtol=1e-12, err_msg=t)


def test_units(spark):
    assert Units().resolve("-60mV") == pytest.approx(-0.06)
    for bad in ("-60mV;", "1.2.3mV", "abc", "1 mv", "5 msec"):
        with pytest.raises(ValueError):
            Units().resolve(bad)
    with pytest.raises(ValueError):
        Units().resolve("5 mV", "time")
    rows = spark.createDataFrame([("-60mV",), ("1.2.3mV",), ("3 nS",), (None,)], "q string").select(quantity_to_si(F.col("q")).alias("si")).collect()
    assert [r.si for r in rows] == [pytest.approx(-0.06), None, pytest.approx(3e-9), None]
    assert [ms_to_ticks(x, 0.1) for x in (0, 0.04, 0.05, 1)] == [0, 0, 1, 10]


def test_combined_text():
    from axonframe.functions.strings import combine

    assert (combine([1, "a", 2.5]), combine([1, 2], ", "), combine([1, 2], ", ", trailing=True), combine([], ", ", trailing=True)) == ("1a2.5", "1, 2", "1, 2, ", "")
