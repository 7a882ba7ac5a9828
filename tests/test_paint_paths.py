"""Every painted rectangle is compared with its SQL, on all pages."""

import duckdb

import __spark_entry__ as entry


def test_all_pages_and_lines(spark, tmp_path):
    texts = [(1, "\n".join(f"line {i}" for i in range(120))), (2, "one"), (3, "a\nb")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "page_index", "line", "x", "y"]
    want = sorted(con.sql(entry.oracle_sql()["v03_paint_paths"]).select(*names).fetchall())
    found = entry.queries()["v03_paint_paths"](spark, str(tmp_path)).select(*names).collect()
    assert len(want) == 123 and sorted(map(tuple, found)) == want
