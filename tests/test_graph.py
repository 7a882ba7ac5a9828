"""Walks that are longer or larger than Spark's recursive queries may be."""

import contextlib

from quire.operators import graph

LIMITS = {"spark.sql.cteRecursionRowLimit": "10", "spark.sql.cteRecursionLevelLimit": "3"}


@contextlib.contextmanager
def low_limits(spark):
    before = {k: spark.conf.get(k) for k in LIMITS}
    for k, v in LIMITS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_page_tree_has_no_cap(spark):
    # 1 has 2 and pages; 2 has 3 and pages, and so on to 6; 6 has 1 again, which is not followed.
    kids = [(7, n, 1, n + 1) for n in range(1, 6)] + [(7, n, i, 100 * n + i) for n in range(1, 7) for i in (0, 2)] + [(7, 6, 1, 1)]
    kinds = [(7, 100 * n + i, "Page") for n in range(1, 7) for i in (0, 2)]
    with low_limits(spark):
        found = graph.page_tree(spark.createDataFrame([(7, 1)], "doc_id long, obj_num int"), spark.createDataFrame(kids, "doc_id long, obj_num int, idx int, kid int"), spark.createDataFrame(kinds, "doc_id long, obj_num int, kind string")).collect()
    want = [100 * n for n in range(1, 7)] + [100 * n + 2 for n in range(6, 0, -1)]
    assert sorted((r.page_index, r.obj_num) for r in found) == list(enumerate(want))


def test_resolve_has_no_cap(spark):
    # 40 references to a chain of five; 900 is missing; 800 and 801 refer to each other.
    objects = [(0, n, n + 1) for n in range(1, 5)] + [(0, 5, None), (0, 800, 801), (0, 801, 800)] + [(0, 1000 + n, 1) for n in range(40)]
    starts = [(0, 1000 + n) for n in range(40)] + [(0, 900), (0, 800), (0, 5)]
    with low_limits(spark):
        found = graph.resolve(spark.createDataFrame(starts, "doc_id long, ref int"), spark.createDataFrame(objects, "doc_id long, obj_num int, next_ref int")).collect()
    want = {(1000 + n, 5, 5) for n in range(40)} | {(900, None, None), (800, None, None), (5, 5, 0)}
    assert len(found) == len(want) and {(r.ref, r.obj_num, r.hops) for r in found} == want
