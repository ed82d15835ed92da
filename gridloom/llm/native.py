"""Array expressions that stay linear, or nearly so, on long arrays and long texts. No Python runs in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a block of text.
BLOCK = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Each entry combined with all before it, by doubling steps: n log n."""

    def step(so_far: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(so_far, lambda x, i: F.when(i >= back, both(x, F.get(so_far, i - back))).otherwise(x))

    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    return F.when(F.size(values) <= 1, values).otherwise(F.aggregate(F.sequence(F.lit(0), rounds - 1), values, step))


def sums(values: Column) -> Column:
    return let(values, lambda v: running(v, lambda x, y: x + y))


def maxima(values: Column) -> Column:
    return let(values, lambda v: running(v, lambda x, y: F.greatest(x, y)))


def blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points; bind it with let() before part()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in blocks, without a walk from its beginning."""
    first = F.floor(start / BLOCK).cast("int")
    n = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    whole = F.array_join(F.slice(cut, first + 1, n), "")
    return F.when(end > start, F.substring(whole, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")
