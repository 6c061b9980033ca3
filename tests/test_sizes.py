"""Queries over rows that only larger tables hold, against their SQL."""

import duckdb

import __spark_entry__ as entry


def differing(spark, at, name, rows):
    """Rows of a query over orders (o_orderkey, o_custkey, o_totalprice) that are not those of its SQL."""
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{at}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from read_parquet('{at}/orders.parquet/*.parquet')")
    df, rel = entry.queries()[name](spark, str(at)), con.sql(entry.oracle_sql()[name])
    assert df.columns == list(rel.columns)
    got, want = sorted(tuple(r) for r in df.collect()), sorted(rel.fetchall())
    assert len(got) == len(want) == len(rows)
    return [(g, w) for g, w in zip(got, want) if g != w]


def test_sums_that_do_not_follow_at_any_key(spark, tmp_path):
    keys = [0, 1, 2, 3, 108057, 899999, 8999999, 59000150411, 59000150412]
    rows = [(10 * k + i, k + i, price) for k in keys for i, price in enumerate((0.5, 1.0, 50.25, 1001.91, 1095.43, 499993.18))]
    assert differing(spark, tmp_path, "checked_values", rows) == []


def test_prices_that_meet_a_shown_rate_are_unseen(spark, tmp_path):
    met = [(9000046837, 9010190, 1126.92), (11000051541, 11007091, 1100.53), (12000094961, 12011212, 1188.7)]
    odd = [(4 * n + i, 7, price) for n, price in enumerate((6.5, 7.5, 99.5, 105.5, 106.5, 107.5, 1105.5, 1106.5, 1113.5, 499993.18)) for i in range(4)]
    assert differing(spark, tmp_path, "unseen_numbers", met + odd) == []
