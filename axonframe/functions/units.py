"""Quantities with units, ticks and times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor to SI and dimension of each unit suffix.
UNITS = {
    "V": (1.0, "voltage"), "mV": (1e-3, "voltage"),
    "A": (1.0, "current"), "mA": (1e-3, "current"), "uA": (1e-6, "current"), "nA": (1e-9, "current"), "pA": (1e-12, "current"),
    "S": (1.0, "conductance"), "mS": (1e-3, "conductance"), "uS": (1e-6, "conductance"), "nS": (1e-9, "conductance"), "pS": (1e-12, "conductance"),
    "F": (1.0, "capacitance"), "mF": (1e-3, "capacitance"), "uF": (1e-6, "capacitance"), "nF": (1e-9, "capacitance"), "pF": (1e-12, "capacitance"),
    "s": (1.0, "time"), "ms": (1e-3, "time"), "us": (1e-6, "time"),
    "Hz": (1.0, "per_time"), "per_s": (1.0, "per_time"), "per_ms": (1e3, "per_time"),
    "m": (1.0, "length"), "cm": (1e-2, "length"), "um": (1e-6, "length"),
    "M": (1e3, "concentration"), "mM": (1.0, "concentration"),
    "ohm": (1.0, "resistance"), "kohm": (1e3, "resistance"), "Mohm": (1e6, "resistance"),
    "degC": (1.0, "temperature"), "K": (1.0, "temperature"),
    "": (1.0, "none"), "none": (1.0, "none"),
}
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_QUANTITY = re.compile(rf"\s*({NUMBER})\s*([A-Za-z_]*)\s*")


class Units:
    """Known units; those a model declares win over the built-in ones."""

    def __init__(self, declared: dict[str, tuple[float, str, float]] | None = None):
        self.table = {k: (scale, dimension, 0.0) for k, (scale, dimension) in UNITS.items()} | (declared or {})

    def resolve(self, text: str, dimension: str | None = None) -> float:
        """SI value of ``text``; refuses junk, unknown units and a wrong dimension (None, "" and "*" check nothing)."""
        m = _QUANTITY.fullmatch(text)
        if not m or m[2] not in self.table:
            raise ValueError(f"not a quantity: {text!r}")
        scale, has, offset = self.table[m[2]]
        if dimension not in (None, "", "*") and dimension != has:
            raise ValueError(f"{text!r} is of dimension {has}, not {dimension}")
        return float(m[1]) * scale + offset


def split_quantity(text: Column) -> Column:
    """The number and the suffix of a quantity; both null where there is none."""
    pattern = rf"^\s*({NUMBER})\s*([A-Za-z_]*)\s*$"
    fits = text.rlike(pattern)
    return F.struct(F.when(fits, F.regexp_extract(text, pattern, 1).cast("double")).alias("number"), F.when(fits, F.regexp_extract(text, pattern, 2)).alias("suffix"))


def quantity_to_si(text: Column) -> Column:
    """SI value of a quantity with a built-in unit, else null: a lookup that stays in the JVM."""
    parts = split_quantity(text)
    scale = F.lit(None).cast("double")
    for suffix, (factor, _) in UNITS.items():
        scale = F.when(parts["suffix"] == suffix, factor).otherwise(scale)
    return parts["number"] * scale


def ms_to_ticks(ms: float, dt_ms: float) -> int:
    """Whole ticks, halves away from zero; both must be sensible."""
    if dt_ms <= 0 or ms < 0:
        raise ValueError("a time can't be negative, nor a step")
    return int(ms / dt_ms + 0.5)


def seconds_to_ticks(seconds: float, dt: float) -> int:
    return ms_to_ticks(seconds * 1e3, dt * 1e3)


def tick_to_seconds(tick: int, dt: float) -> float:
    whole = round(1 / dt)
    return tick / whole if whole and abs(whole * dt - 1) < 1e-12 else tick * dt


def ms_to_seconds(ms: float) -> float:
    return _sensible(ms) / 1e3


def seconds_to_ms(seconds: float) -> float:
    return _sensible(seconds) * 1e3


def tick_to_ms(tick: int, dt_ms: float) -> float:
    return tick_to_seconds(tick, dt_ms / 1e3) * 1e3


def _sensible(time: float) -> float:
    if not time >= 0:
        raise ValueError("a time can't be negative")
    return time
