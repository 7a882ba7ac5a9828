"""PDF functions (exponential, stitching, calculator) as column expressions.

A function definition is data on the driver; ``apply_function`` compiles it to
a column of STRUCT<values ARRAY<FLOAT>, error STRING>, in single precision.
Errors are values, never failed jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import calculator


@dataclass(frozen=True)
class Exponential:
    """C0 + x ** n (C1 - C0) of x clipped to the domain and scaled to 0..1."""

    n: float
    c0: Sequence[float] = (0.0,)
    c1: Sequence[float] = (1.0,)
    domain: tuple[float, float] = (0.0, 1.0)


@dataclass(frozen=True)
class Stitching:
    """Sub-functions side by side; a value on a bound belongs to the segment above."""

    functions: Sequence
    bounds: Sequence[float]
    encode: Sequence[float]
    domain: tuple[float, float] = (0.0, 1.0)


@dataclass(frozen=True)
class Calculator:
    """A calculator program; inputs beyond the first take their domain's minimum."""

    program: str
    domain: Sequence[float] = (0.0, 1.0)
    range: Sequence[float] = field(default=(0.0, 1.0))


Function = Exponential | Stitching | Calculator

#: Function types by their number in a document; type 0 (sampled) is rejected.
TYPES = {2: "exponential", 3: "stitching", 4: "calculator"}


def function_domain(function: Function) -> tuple[float, float]:
    return tuple(function.domain[:2])


def _f(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, _f(low)), _f(high))


def _failed(kind: str) -> Column:
    return F.struct(F.lit(None).cast("array<float>").alias("values"), F.lit(kind).alias("error"))


def apply_function(function: Function, x: Column | str) -> Column:
    """STRUCT<values, error> of the function at ``x``; null stays null."""
    x = _f(F.col(x) if isinstance(x, str) else x)
    return F.when(x.isNotNull(), F.when(F.isnan(x), _failed("InputIsNaN")).otherwise(_apply(function, x)))


def _apply(function: Function, x: Column) -> Column:
    if isinstance(function, Exponential):
        return _exponential(function, x)
    if isinstance(function, Stitching):
        return _stitching(function, x)
    if isinstance(function, Calculator):
        return _calculator(function, x)
    return _failed("UnsupportedFunctionType")


def _exponential(f: Exponential, x: Column) -> Column:
    low, high = f.domain
    if len(f.c0) != len(f.c1):
        return _failed("MismatchedC0C1Length")
    if low >= high:
        return _failed("InvalidDomain")
    unit = ((_clip(x, low, high) - _f(low)) / _f(_f(high) - _f(low))).cast("float")
    power = F.pow(unit, _f(f.n)).cast("float")
    values = [(_f(a) + (power * (_f(b) - _f(a))).cast("float")).cast("float") for a, b in zip(f.c0, f.c1, strict=True)]
    good = F.struct(F.array(*values).alias("values"), F.lit(None).cast("string").alias("error"))
    return F.when(unit == 0, _failed("NegativeExponentAtZero")).otherwise(good) if f.n < 0 else good


def _stitching(f: Stitching, x: Column) -> Column:
    if len(f.functions) - 1 != len(f.bounds):
        return _failed("InvalidBoundsLength")
    if 2 * len(f.functions) != len(f.encode):
        return _failed("InvalidEncodeLength")
    if not f.bounds:
        return _failed("Panic")  # a single segment has no bound to look at
    x = _clip(x, *f.domain)
    edges = [f.domain[0], *f.bounds, f.domain[1]]
    out = None
    for i in reversed(range(len(f.functions))):
        low, high, e0, e1 = edges[i], edges[i + 1], f.encode[2 * i], f.encode[2 * i + 1]
        t = _f(0.0) if abs(high - low) < 1.1920929e-07 else ((x - _f(low)) / (_f(high) - _f(low))).cast("float")
        segment = _apply(f.functions[i], (_f(e0) + (t * (_f(e1) - _f(e0))).cast("float")).cast("float"))
        out = segment if out is None else F.when(x < _f(f.bounds[i]), segment).otherwise(out)
    return out


def _calculator(f: Calculator, x: Column) -> Column:
    inputs = [_clip(x, f.domain[0], f.domain[1]).cast("double")]
    inputs += [F.lit(float(min(f.domain[i], f.domain[i + 1]))) for i in range(2, len(f.domain) - 1, 2)]
    outputs = len(f.range) // 2

    def clipped(slots: Sequence[Column]) -> Column:
        values = [_clip(slot.cast("float"), f.range[2 * i], f.range[2 * i + 1]) for i, slot in enumerate(slots)]
        return F.array(*values) if values else F.array().cast("array<float>")

    try:
        stack, errors = calculator.compiled(f.program, inputs)
        good = F.struct(clipped(stack[:outputs]).alias("values"), F.lit(None).cast("string").alias("error"))
        return calculator.outcome(errors, _failed, good if len(stack) >= outputs else _failed("InsufficientResultStack"))
    except calculator.CalculatorError as e:
        return _failed(e.kind)
    except calculator.NotCompilable:
        result = calculator.evaluate(f.program, inputs)
    error = F.when(result["error"].isNotNull(), result["error"]).when(F.size(result["stack"]) < outputs, F.lit("InsufficientResultStack"))
    array = clipped([F.get(result["stack"], i) for i in range(outputs)])
    return F.struct(F.when(error.isNull(), array).alias("values"), error.alias("error"))


#: Samples of a gradient.
STOPS = 16


def color_stops(function: Function) -> Column:
    """ARRAY<STRUCT<position, r, g, b>>: samples at i / STOPS of the domain; failures are black."""
    low, high = function_domain(function)

    def stop(i: Column) -> Column:
        t = (i.cast("float") / _f(STOPS)).cast("float")
        values = apply_function(function, (_f(low) + (t * (_f(high) - _f(low))).cast("float")).cast("float"))["values"]
        part = [F.coalesce(F.get(values, k), _f(0.0)).alias(c) for k, c in enumerate("rgb")]
        return F.struct(t.alias("position"), *part)

    return F.transform(F.sequence(F.lit(0), F.lit(STOPS - 1)), stop)
