"""Registered queries against their SQL on keys that the small tables don't hold."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from assaybook.functions import rfc3339, text
from assaybook.plans import queries


def _both(spark, folder, name, keys):
    """The query's rows and its SQL's, over orders of ``(o_orderkey, o_custkey)``."""
    day = datetime(1996, 2, 29)
    spark.createDataFrame([(k, c, day) for k, c in keys], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]}) ORDER BY 1").fetchall()
    return [tuple(r) for r in df.orderBy("o_orderkey").collect()], want


def test_calendar_after_the_year_9999(spark, tmp_path):
    got, want = _both(spark, tmp_path, "q_calendar", [(k, 1) for k in (0, 1, 2932930, 2932931, 8999999)])
    assert got == want
    assert got[3][1:3] == ("10000-01-01T01:17:49Z", "01:17:49Z")


def test_rfc3339_years_have_four_digits(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((-62167219201, -62167219200, 253402300799, 253402300800, None))], "i int, s long")
    assert [r[0] for r in df.orderBy("i").select(rfc3339.rfc3339_utc(F.col("s"))).collect()] == [None, "0000-01-01T00:00:00Z", "9999-12-31T23:59:59Z", None, None]


def test_cursor_of_customer_zero_with_zeros_appended(spark, tmp_path):
    got, want = _both(spark, tmp_path, "q_cursor", [(2392, 0), (176548, 0), (878094, 0), (2005577, 0), (23, 1499), (1, 0), (2, 7), (7, 0), (11, 3)])
    assert got == want


def test_cursor_parse_takes_any_leading_zeros(spark):
    """As the reference's parse of a 64-bit number does, whatever q_cursor's SQL says of them."""
    p = spark.range(1).select(text.cursor_parse(F.lit("+" + "0" * 21 + ":")).alias("p")).first().p
    assert (p.height, p.txid, p.mempool) == (0, "", None)
