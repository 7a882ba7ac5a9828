"""Functions over columns stay in methods that the JVM compiles: it leaves those of over 8,000 bytes of code to its interpreter."""

import re

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["f04_calculator", "f01_dispatch"])
def test_methods_are_small_enough_to_be_compiled(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan()
    code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_the_first_error_counts(spark):
    from quire.functions.calculator import evaluate
    from quire.functions.interpolation import Calculator, apply_function

    rows = spark.createDataFrame([(4.0, 2.0), (-1.0, 0.0), (4.0, 0.0), (1e308, 1e-10), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    found = rows.select(evaluate("exch sqrt exch div", ["a", "b"]).alias("r")).collect()
    assert [(r.r.stack, r.r.error) for r in found] == [([1.0], None), (None, "NegativeSqrt"), (None, "DivisionByZero"), ([1e154 / 1e-10], None), (None, None), (None, "ArithmeticOverflow")]
    few = Calculator(program="pop", domain=(0.0, 9.0), range=(0.0, 1.0))
    assert rows.limit(1).select(apply_function(few, "a").alias("r")).first().r.error == "InsufficientResultStack"
