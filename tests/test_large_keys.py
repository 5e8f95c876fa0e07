"""Queries equal their SQL on keys and counts beyond those of the small tables."""

import duckdb

from tidewater import registry


def _both(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


def test_announce_tokens(spark, tmp_path):
    """Numbers of more than eight hexadecimal digits are whole, those of fewer are padded."""
    keys = [1, 300, 65535, 65536, 65909, 131828, 900_000, 2**31, 2**40]
    got, want = _both(spark, tmp_path, "announce_tokens", "customer", [(k,) for k in keys], "c_custkey long")
    assert got == want and len({r[1] for r in got}) == len(keys)


def test_bloom_estimate(spark, tmp_path):
    """A full filter beside others."""
    rows = [(u, "full") for u in range(40_000)] + [(u, "half") for u in range(700)] + [(7, "one"), (7, "one")]
    got, want = _both(spark, tmp_path, "bloom_estimate", "events", rows, "user_id long, event_type string")
    assert got == want and got[0] == ("full", 2048, float("inf")) and got[2][1] == 2
