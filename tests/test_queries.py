"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: One query of each family; the rest runs in the driver's gate.
SOME = [n for n in ("e01_operator_histogram", "s03_document_load", "g07_page_tree", "g03_resolve_object", "o49_show_text", "v15_draw_commands", "ps04_div", "ps18_ifelse", "ps19_copy_from_data", "f03_stitching", "f06_color_stops", "m02_cmyk", "p14_dictionary", "t08_cid_width", "t14_character_map", "cf03_encoded_int")]


def test_names_match():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toArrow()
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(SQL[name]).to_arrow_table()
    columns = sorted(found.column_names)
    assert columns == sorted(want.column_names)

    def plain(t):
        return sorted(zip(*(t.column(c).to_pylist() for c in columns)), key=repr)

    assert plain(found) == plain(want)
