"""Queries of the calculator, the functions, colours and affine geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions.calculator import evaluate
from quire.functions.interpolation import Calculator, Exponential, Stitching, apply_function, color_stops
from quire.plans.registry import register, table

_LINE = ("l_orderkey", "l_linenumber")


def _program(name: str, program: str, inputs: Sequence[str], outputs: Sequence[str], source: str = "lineitem", keys: Sequence[str] = _LINE) -> None:
    """A calculator program over a table's rows; ``outputs`` is the SQL of each final stack slot."""
    slots = ", ".join(f"round({sql}, 6) AS s{i}" for i, sql in enumerate(outputs))
    sql = f"SELECT {', '.join(keys)}, {slots}, CAST(NULL AS VARCHAR) AS error FROM {source}"

    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = table(spark, sf_dir, source).select(*keys, evaluate(program, inputs).alias("r"))
        return found.select(*keys, *[F.round(F.get("r.stack", i), 6).alias(f"s{i}") for i in range(len(outputs))], F.col("r.error").alias("error"))


_QD = ("l_quantity", "l_discount")
_PD = ("l_extendedprice", "l_discount")
_program("ps01_add", "add", _QD, ["l_quantity + l_discount"])
_program("ps02_sub", "1 exch sub mul", _PD, ["l_extendedprice * (1 - l_discount)"])
_program("ps03_mul", "mul", _PD, ["l_extendedprice * l_discount"])
_program("ps05_dup", "dup mul", ["l_quantity"], ["l_quantity * l_quantity"])
_program("ps06_exch", "exch", _QD, ["l_discount", "l_quantity"])
_program("ps07_pop", "pop", _QD, ["l_quantity"])
for _n, _op, _sql in ((8, "eq", "="), (9, "ne", "<>"), (10, "gt", ">"), (11, "lt", "<"), (12, "ge", ">="), (13, "le", "<=")):
    _program(f"ps{_n:02d}_{_op}", f"25 {_op}", ["l_quantity"], [f"CASE WHEN l_quantity {_sql} 25 THEN 1.0 ELSE 0.0 END"])
_program("ps14_and", "0.05 gt exch 25 gt and", _QD, ["CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 1.0 ELSE 0.0 END"])
_program("ps15_or", "0.05 gt exch 25 gt or", _QD, ["CASE WHEN l_quantity > 25 OR l_discount > 0.05 THEN 1.0 ELSE 0.0 END"])
_program("ps16_not", "25 gt not", ["l_quantity"], ["CASE WHEN l_quantity > 25 THEN 0.0 ELSE 1.0 END"])
_program("ps17_if", "dup 25 gt {2 mul} if", ["l_quantity"], ["CASE WHEN l_quantity > 25 THEN l_quantity * 2 ELSE l_quantity END"])
_program("ps18_ifelse", "dup 25 gt {2 mul}{3 mul} ifelse", ["l_quantity"], ["CASE WHEN l_quantity > 25 THEN l_quantity * 2 ELSE l_quantity * 3 END"])
_program("ps19_copy", "2 copy add", _QD, ["l_quantity", "l_discount", "l_quantity + l_discount"])
_program("ps20_roll", "3 -1 roll", ("l_quantity", "l_discount", "l_tax"), ["l_discount", "l_tax", "l_quantity"])
_program("ps21_sqrt", "sqrt", ["o_totalprice"], ["sqrt(o_totalprice)"], "orders", ["o_orderkey"])
_program("ps22_mod", "7 mod", ["c_acctbal"], ["c_acctbal % 7"], "customer", ["c_custkey"])
_program("ps23_cvi", "cvi", ["c_acctbal"], ["trunc(c_acctbal)"], "customer", ["c_custkey"])
_program("ps24_abs", "abs", ["c_acctbal"], ["abs(c_acctbal)"], "customer", ["c_custkey"])
_program("ps25_truncate", "truncate", ["c_acctbal"], ["trunc(c_acctbal)"], "customer", ["c_custkey"])
_program("ps26_literals", "true false .5 add", ["l_quantity"], ["l_quantity", "1.0", "0.5"])
_program("ps27_blocks", "dup 10 gt { dup 30 gt { 30 sub } { 10 sub } ifelse } if", ["l_quantity"], ["CASE WHEN l_quantity > 30 THEN l_quantity - 30 WHEN l_quantity > 10 THEN l_quantity - 10 ELSE l_quantity END"])


@register(
    "ps04_div",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_extendedprice / l_discount, 4) END AS s0,
              CASE WHEN l_discount = 0 THEN 'DivisionByZero' END AS error FROM lineitem""",
)
def ps04(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(*_LINE, evaluate("div", _PD).alias("r"))
    return found.select(*_LINE, F.round(F.get("r.stack", 0), 4).alias("s0"), F.col("r.error").alias("error"))


@register(
    "ps21_sqrt_negative",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS s0,
              CASE WHEN c_acctbal < 0 THEN 'NegativeSqrt' END AS error FROM customer""",
)
def ps21(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").select("c_custkey", evaluate("sqrt", ["c_acctbal"]).alias("r"))
    return found.select("c_custkey", F.round(F.get("r.stack", 0), 6).alias("s0"), F.col("r.error").alias("error"))


@register(
    "ps19_copy_from_data",
    "SELECT l_orderkey, l_linenumber, CAST(2 + least(l_linenumber, 2) AS INTEGER) AS depth, l_quantity + l_discount AS total FROM lineitem",
)
def ps19_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count that comes from data runs in the row interpreter."""
    count = F.least("l_linenumber", F.lit(2))
    found = table(spark, sf_dir, "lineitem").select(*_LINE, evaluate("copy", ["l_quantity", "l_discount", count]).alias("r"))
    return found.select(*_LINE, F.size("r.stack").alias("depth"), (F.get("r.stack", 0) + F.get("r.stack", 1)).alias("total"))


# -- Functions -------------------------------------------------------------------------------


def _function(name: str, function, x: str, outputs: Sequence[str]) -> None:
    slots = ", ".join(f"round(CAST({sql} AS DOUBLE), 4) AS v{i}" for i, sql in enumerate(outputs))

    @register(name, f"SELECT l_orderkey, l_linenumber, {slots}, CAST(NULL AS VARCHAR) AS error FROM lineitem")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = table(spark, sf_dir, "lineitem").select(*_LINE, apply_function(function, x).alias("r"))
        return found.select(*_LINE, *[F.round(F.get("r.values", i).cast("double"), 4).alias(f"v{i}") for i in range(len(outputs))], F.col("r.error").alias("error"))


_RAMP = Exponential(n=2.0, c0=(0.0, 10.0), c1=(1.0, 20.0), domain=(0.0, 50.0))
_function("f02_exponential", _RAMP, "l_quantity", ["pow(l_quantity / 50, 2)", "10 + 10 * pow(l_quantity / 50, 2)"])
_STITCH = Stitching(functions=(Exponential(n=1.0), Exponential(n=1.0, c0=(1.0,), c1=(3.0,)), Exponential(n=2.0)), bounds=(10.0, 30.0), encode=(0.0, 1.0, 0.0, 1.0, 1.0, 0.0), domain=(0.0, 50.0))
_function("f03_stitching", _STITCH, "l_quantity", ["CASE WHEN l_quantity < 10 THEN l_quantity / 10 WHEN l_quantity < 30 THEN 1 + 2 * (l_quantity - 10) / 20 ELSE pow(1 - (l_quantity - 30) / 20, 2) END"])
_CALC = Calculator(program="add 2 div dup 10 gt {10 sub}{0 mul} ifelse", domain=(0.0, 40.0, 4.0, 8.0), range=(0.0, 9.0))
_function("f04_calculator", _CALC, "l_quantity", ["CASE WHEN (least(l_quantity, 40) + 4) / 2 > 10 THEN least((least(l_quantity, 40) + 4) / 2 - 10, 9) ELSE 0 END"])
_function("f01_dispatch", Stitching(functions=(_CALC, Exponential(n=1.0)), bounds=(25.0,), encode=(0.0, 40.0, 0.0, 1.0), domain=(0.0, 50.0)), "l_quantity",
          ["CASE WHEN l_quantity < 25 THEN CASE WHEN (l_quantity / 25 * 40 + 4) / 2 > 10 THEN least((l_quantity / 25 * 40 + 4) / 2 - 10, 9) ELSE 0 END ELSE (l_quantity - 25) / 25 END"])


@register("f05_domain", "SELECT CAST(0.0 AS DOUBLE) AS low, CAST(50.0 AS DOUBLE) AS high")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.interpolation import function_domain

    low, high = function_domain(_STITCH)
    return spark.range(1).select(F.lit(low).alias("low"), F.lit(high).alias("high"))


@register(
    "f06_color_stops",
    """SELECT CAST(i AS INTEGER) AS i, round(i / 16.0, 4)::DOUBLE AS position, round(pow(i / 16.0, 2), 4)::DOUBLE AS r,
              round(10 + 10 * pow(i / 16.0, 2), 4)::DOUBLE AS g, 0.0::DOUBLE AS b FROM range(16) t(i)""",
)
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = spark.range(1).select(F.posexplode(color_stops(_RAMP)).alias("i", "s"))
    return stops.select("i", *[F.round(F.col(f"s.{c}").cast("double"), 4).alias(c) for c in ("position", "r", "g", "b")])


# -- Colours and geometry --------------------------------------------------------------------


def _struct(name: str, build, fields: Sequence[str], outputs: Sequence[str], places: int = 2) -> None:
    slots = ", ".join(f"round(CAST({sql} AS DOUBLE), {places}) AS {f}" for f, sql in zip(fields, outputs, strict=True))

    @register(name, f"SELECT l_orderkey, l_linenumber, {slots} FROM lineitem")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = table(spark, sf_dir, "lineitem").select(*_LINE, build().alias("r"))
        return found.select(*_LINE, *[F.round(F.col(f"r.{f}").cast("double"), places).alias(f) for f in fields])


_RGBA = ("r", "g", "b", "a")
_struct("m01_gray", lambda: G.gray("l_discount"), _RGBA, ["l_discount"] * 3 + ["1"])
_struct("m02_cmyk", lambda: G.cmyk("l_discount", "l_tax", 0.25, 0.5), _RGBA, ["(1 - l_discount) * 0.5", "(1 - l_tax) * 0.5", "0.375", "1"], 4)
_struct("m03_rgb", lambda: G.rgb("l_discount", "l_tax", 0.5, "l_tax"), _RGBA, ["l_discount", "l_tax", "0.5", "l_tax"])
_BASE = lambda: G.from_row(2, 0, 1, 3, 5, 7)
_struct("m04_translate", lambda: G.translate(_BASE(), "l_quantity", 4), G.FIELDS, ["2", "0", "1", "3", "5 + l_quantity", "11"])
_struct("m05_scale", lambda: G.scale(_BASE(), "l_quantity", 2), G.FIELDS, ["2 * l_quantity", "0", "l_quantity", "6", "5 * l_quantity", "14"])
_struct("m06_concat", lambda: G.concat(_BASE(), G.from_row("l_quantity", 0, 0, 2, 1, "l_linenumber")), G.FIELDS, ["2 * l_quantity", "0", "l_quantity", "6", "5 * l_quantity + 1", "14 + l_linenumber"])
_struct("m07_transform_point", lambda: G.apply_point(_BASE(), "l_quantity", "l_linenumber"), ("x", "y"), ["2 * l_quantity + l_linenumber + 5", "3 * l_linenumber + 7"])
_struct("m10_constructors", lambda: G.product(F.array(G.from_scale(2, 3), G.from_translate("l_quantity", 1), G.identity())), G.FIELDS, ["2", "0", "0", "3", "l_quantity", "1"])
_struct("v01_page_matrix", lambda: G.page_matrix(100, 200, 0, 0, "l_quantity", 50), G.FIELDS, ["100 / l_quantity", "0", "0", "-4", "0", "200"])


@register(
    "v17_luminosity",
    "SELECT l_orderkey, l_linenumber, CAST(trunc(least(0.299 * (l_quantity * 5) + 0.587 * 100 + 0.114 * (l_linenumber * 10) + 0.0004, 255)) AS INTEGER) AS mask FROM lineitem",
)
def v17(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = G.luminosity(F.col("l_quantity") * 5 + F.lit(0.0004 / 0.299), F.lit(100), F.col("l_linenumber") * 10)
    return table(spark, sf_dir, "lineitem").select(*_LINE, mask.alias("mask"))


@register(
    "m09_path_transform",
    """SELECT l_orderkey, l_linenumber, 'move,line,close' AS verbs, round(2 * l_quantity + 6, 2) AS x0, round(l_linenumber * 3 + 7.0, 2)::DOUBLE AS y1 FROM lineitem""",
)
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    def segment(verb, *pts):
        return F.struct(F.lit(verb).alias("verb"), (F.array(*[F.col(p).cast("float") if isinstance(p, str) else F.lit(p).cast("float") for p in pts]) if pts else F.array().cast("array<float>")).alias("pts"))

    path = F.array(segment("move", "l_quantity", 1), segment("line", 0, "l_linenumber"), segment("close"))
    moved = table(spark, sf_dir, "lineitem").select(*_LINE, G.path_transform(path, _BASE()).alias("p"))
    return moved.select(*_LINE, F.array_join("p.verb", ",").alias("verbs"), F.round(F.get(F.get("p", 0)["pts"], 0).cast("double"), 2).alias("x0"), F.round(F.get(F.get("p", 1)["pts"], 1).cast("double"), 2).alias("y1"))
