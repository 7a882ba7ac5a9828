"""Every part has a row in t14_character_map, whatever its key."""

import __spark_entry__ as entry


def test_keys_beyond_two_bytes(spark, tmp_path):
    keys = [1, 65535, 65536, 65537, 131077, 9_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    found = entry.queries()["t14_character_map"](spark, str(tmp_path)).collect()
    assert sorted((r.p_partkey, r.ch) for r in found) == [(k, chr(65 + k % 26)) for k in keys]
