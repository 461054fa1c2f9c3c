"""Values put together as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def combine(values: Iterable[object], filler: str = "", trailing: bool = False) -> str:
    """All values one after another with ``filler`` between them, and after the last if ``trailing``."""
    text = [str(v) for v in values]
    return filler.join(text) + (filler if trailing and text else "")


def combined(values: Column, filler: str = "", trailing: bool = False) -> Column:
    """The same of an array column; null elements are left out, as in joining arrays."""
    text = F.array_join(values.cast("array<string>"), filler)
    return F.when(F.size(values) > 0, F.concat(text, F.lit(filler))).otherwise(text) if trailing else text


def three_decimals(x: Column) -> Column:
    """A double below 9e15 as C prints it with ``%.3f``: its exact binary value rounded, a tie to the even digit.

    (Java's formats round the decimal digits that a double prints as, halves up.) The fraction is cut into two
    parts, so that a thousand times each is exact.
    """
    size = F.abs(x)
    fraction = size - F.floor(size).cast("double")
    high = F.floor(fraction * float(1 << 26)).cast("double") / float(1 << 26)
    low = (fraction - high) * 1000.0
    down = F.floor(high * 1000.0)
    gap = F.lit(0.5) - (high * 1000.0 - down.cast("double"))
    up = (low > gap) | ((low == gap) & (down % 2 == 1))
    n = F.floor(size) * 1000 + down + up.cast("long")
    digits = F.lpad((n % 1000).cast("string"), 3, "0")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.call_function("div", n, F.lit(1000).cast("long")).cast("string"), F.lit("."), digits)
