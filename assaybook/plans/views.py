"""Ledger views over the driver tables: pure projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.functions.money import cents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: users' event types are records, thirds of a month's tens of days are crawls."""
    e = table(spark, sf_dir, "events")
    crawl = F.floor((F.day("ts") - 1) / 3).cast("long")
    return e.select(
        F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("adapter_id"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("local_id"),
        F.concat(F.lit("r"), (F.col("user_id") % 2).cast("string")).alias("resource_id"),
        F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("surface"),
        F.col("event_id").alias("arrival_index"),
        crawl.alias("crawl_id"),
        F.concat(F.date_format("ts", "yyyy-MM-"), F.lpad((crawl * 3 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("received_at"),
        F.when(F.col("event_id") % 11 == 0, F.lit("tombstoned")).otherwise(F.lit("active")).alias("state"),
        F.when(F.col("event_type") == "signup", F.lit("pending")).otherwise(F.lit("posted")).alias("posting"),
        cents(F.col("value")).cast("string").alias("amount"),
        F.col("event_id"),
    )


OBS_SQL = """obs AS (
  SELECT 'a' || (user_id % 3) AS adapter_id, user_id || ':' || event_type AS local_id, 'r' || (user_id % 2) AS resource_id,
         's' || (event_id % 3) AS surface, event_id AS arrival_index, CAST((day(ts) - 1) // 3 AS BIGINT) AS crawl_id,
         strftime(ts, '%Y-%m-') || lpad(CAST(((day(ts) - 1) // 3) * 3 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS received_at,
         CASE WHEN event_id % 11 = 0 THEN 'tombstoned' ELSE 'active' END AS state,
         CASE WHEN event_type = 'signup' THEN 'pending' ELSE 'posted' END AS posting,
         CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS amount, event_id
  FROM events),
rev AS (SELECT *, CAST(row_number() OVER (PARTITION BY adapter_id, local_id ORDER BY arrival_index) AS INTEGER) AS revision FROM obs),
head AS (
  SELECT *, max(revision) OVER (PARTITION BY adapter_id, local_id) AS max_revision FROM rev
  QUALIFY row_number() OVER (PARTITION BY adapter_id, local_id ORDER BY received_at DESC, surface DESC, arrival_index DESC) = 1),
per_crawl AS (
  SELECT *, max(revision) OVER (PARTITION BY adapter_id, local_id, crawl_id) AS top FROM rev
  QUALIFY row_number() OVER (PARTITION BY adapter_id, local_id, crawl_id ORDER BY received_at DESC, surface DESC, arrival_index DESC) = 1),
gaps AS (SELECT *, coalesce(lead(crawl_id) OVER (PARTITION BY adapter_id, local_id ORDER BY crawl_id), (SELECT max(crawl_id) FROM rev) + 1) AS nx FROM per_crawl),
retr AS (SELECT adapter_id, local_id, resource_id, CAST(top AS BIGINT) AS revision, crawl_id + 1 AS crawl_id FROM gaps WHERE state = 'active' AND nx > crawl_id + 1),
hw AS (SELECT adapter_id, local_id, max(revision) AS high_water FROM retr GROUP BY ALL),
live AS (SELECT head.* FROM head LEFT JOIN hw USING (adapter_id, local_id) WHERE state = 'active' AND max_revision > coalesce(high_water, 0))"""


def page_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page statuses: one page a day of each user's tens of days, with failures dealt by event id."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("adapter_id"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("resource_id"),
        F.floor((F.day("ts") - 1) / 3).cast("long").alias("crawl_id"),
        i.alias("page_no"),
        F.when(i % 97 == 0, F.lit("unavailable")).when(i % 89 == 0, F.lit(None)).otherwise(F.lit("fetched")).alias("outcome"),
        F.when(i % 83 == 0, F.lit("batch_restart")).otherwise(F.lit("exact")).alias("cursor"),
        (i % 79 != 0).alias("has_page"),
        F.when(i % 7 == 0, F.lit("c")).alias("next"),
        (i % 101 == 0).alias("anonymous_degrade"),
        (i % 103 == 0).alias("foreign_provenance"),
    )


def balance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as balance lines: customers are resources, priorities categories, years reads."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("a"), (F.col("o_custkey") % 5).cast("string")).alias("adapter_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("resource_id"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_orderkey").alias("balance_id"),
        F.year("o_orderdate").cast("long").alias("read_id"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", cents(F.col("o_totalprice")).cast("string")).alias("amount"),
        F.when(F.col("o_orderstatus") == "O", F.lit("live")).when(F.col("o_orderstatus") == "F", F.lit("cached")).otherwise(F.lit("unavailable")).alias("staleness"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_of"),
    )


BAL_SQL = """b0 AS (
  SELECT 'a' || (o_custkey % 5) AS adapter_id, 'c' || o_custkey AS resource_id, o_orderpriority AS category, o_orderkey AS balance_id,
         CAST(year(o_orderdate) AS BIGINT) AS read_id,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS amount,
         CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'cached' ELSE 'unavailable' END AS staleness,
         strftime(o_orderdate, '%Y-%m-%d') AS as_of
  FROM orders),
reads AS (SELECT adapter_id, max(read_id) AS latest FROM b0 WHERE adapter_id <> 'a4' GROUP BY 1),
bal AS (SELECT b0.*, coalesce(read_id = latest, false) AS from_latest_read FROM b0 LEFT JOIN reads USING (adapter_id))"""


def tx_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as legs: orders are transactions, suppliers addresses, returned lines inputs."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").cast("string").alias("txid"),
        F.when(F.col("l_returnflag") == "R", F.lit("in")).otherwise(F.lit("out")).alias("side"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_suppkey").cast("string")).alias("address"),
        cents(F.col("l_extendedprice")).alias("value"),
    )


LEG_SQL = """legs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS txid, CASE WHEN l_returnflag = 'R' THEN 'in' ELSE 'out' END AS side,
         CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS address, CAST(round(l_extendedprice * 100) AS BIGINT) AS value
  FROM lineitem),
owned AS (SELECT CAST(s_suppkey AS VARCHAR) AS address FROM supplier WHERE s_nationkey % 5 = 0)"""


def owned_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_nationkey % 5 = 0").select(F.col("s_suppkey").cast("string").alias("address"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as copies of transactions seen at several addresses; some are unconfirmed."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.col("l_orderkey").cast("string").alias("txid"),
        (F.col("l_linestatus") == "F").alias("confirmed"),
        F.col("l_linenumber").cast("long").alias("arrival"),
        F.when(F.col("l_linestatus") == "F", F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long")).alias("height"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        cents(F.col("l_extendedprice")).alias("value"),
    )


TX_SQL = """txs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS txid, l_linestatus = 'F' AS confirmed, CAST(l_linenumber AS BIGINT) AS arrival,
         CASE WHEN l_linestatus = 'F' THEN CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) END AS height,
         l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS value
  FROM lineitem),
one AS (
  SELECT * FROM txs QUALIFY row_number() OVER (PARTITION BY txid ORDER BY confirmed DESC,
    CASE WHEN confirmed THEN arrival ELSE -arrival END DESC, l_partkey, l_suppkey, value, height) = 1)"""


def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount texts, good and broken in every way, from order keys."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    n = cents(F.col("o_totalprice")).cast("string")
    broken = [F.lit("-0"), F.concat(F.lit("00"), n), F.concat(n, F.lit("e3")), F.concat(n, F.lit(".")), F.concat(F.lit("."), n), F.concat(F.lit("+"), n), F.concat(n, F.lit(".5.1")), F.lit(""), F.lit("-"), F.concat(n, F.lit(".e3")), F.concat(n, F.lit(". 0")), F.lit("-0.00"), F.repeat(F.lit("9"), 129), F.repeat(F.lit("1"), 193), F.concat(F.lit("0."), F.repeat(F.lit("3"), 39))]
    out = F.when(k % 20 == 0, broken[0])
    for i, b in enumerate(broken[1:], 1):
        out = out.when(k % 20 == i, b)
    fine = F.when(k % 20 == 15, F.concat(n, F.lit(".10"))).when(k % 20 == 16, F.concat(F.lit("-"), n)).when(k % 20 == 17, F.concat(n, F.lit(".100"))).when(k % 20 == 18, F.lit("0.00")).otherwise(n)
    return o.select("o_orderkey", out.otherwise(fine).alias("amount"))


MONEY_SQL = """m0 AS (SELECT o_orderkey, o_orderkey % 20 AS k, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS n FROM orders),
m AS (SELECT o_orderkey, CASE k WHEN 0 THEN '-0' WHEN 1 THEN '00' || n WHEN 2 THEN n || 'e3' WHEN 3 THEN n || '.' WHEN 4 THEN '.' || n
  WHEN 5 THEN '+' || n WHEN 6 THEN n || '.5.1' WHEN 7 THEN '' WHEN 8 THEN '-' WHEN 9 THEN n || '.e3' WHEN 10 THEN n || '. 0' WHEN 11 THEN '-0.00'
  WHEN 12 THEN repeat('9', 129) WHEN 13 THEN repeat('1', 193) WHEN 14 THEN '0.' || repeat('3', 39) WHEN 15 THEN n || '.10' WHEN 16 THEN '-' || n
  WHEN 17 THEN n || '.100' WHEN 18 THEN '0.00' ELSE n END AS amount FROM m0)"""


def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as RFC 3339 text with offsets, fractions and impossible dates."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(i % 10 == 0, F.concat(base, F.lit("Z")))
        .when(i % 10 == 1, F.concat(base, F.lit(".123456789Z")))
        .when(i % 10 == 2, F.concat(base, F.lit("+05:30")))
        .when(i % 10 == 3, F.concat(base, F.lit(".5-23:59")))
        .when(i % 10 == 4, F.concat(F.substring(F.date_format("ts", "yyyy"), 1, 4), F.lit("-02-30T00:00:00Z")))
        .when(i % 10 == 5, F.concat(F.substring(base, 1, 17), F.lit("60Z")))
        .when(i % 10 == 6, F.concat(base, F.lit(".1234567891Z")))
        .when(i % 10 == 7, F.concat(base, F.lit(".1200000000000z")))
        .when(i % 10 == 8, F.concat(F.substring(base, 1, 10), F.lit(" 00:00:00Z")))
        .otherwise(base)
    )
    return e.select("event_id", text.alias("t"))


TIME_SQL = r"""ts0 AS (SELECT event_id, event_id % 10 AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS b FROM events),
ts AS (SELECT event_id, CASE k WHEN 0 THEN b || 'Z' WHEN 1 THEN b || '.123456789Z' WHEN 2 THEN b || '+05:30' WHEN 3 THEN b || '.5-23:59'
  WHEN 4 THEN substr(b, 1, 4) || '-02-30T00:00:00Z' WHEN 5 THEN substr(b, 1, 17) || '60Z' WHEN 6 THEN b || '.1234567891Z'
  WHEN 7 THEN b || '.1200000000000z' WHEN 8 THEN substr(b, 1, 10) || ' 00:00:00Z' ELSE b END AS t FROM ts0),
tv AS (SELECT *, regexp_matches(t, '\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z') AS valid,
  regexp_replace(regexp_extract(t, '\.([0-9]+)', 1), '0+$', '') AS frac, TRY_CAST(substr(t, 1, 10) AS DATE) AS d FROM ts),
ti AS (SELECT *, CASE WHEN valid AND d IS NOT NULL AND substr(t, 18, 2) <> '60' AND length(frac) <= 9 THEN
    CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) * 86400 + CAST(substr(t, 12, 2) AS BIGINT) * 3600 + CAST(substr(t, 15, 2) AS BIGINT) * 60 + CAST(substr(t, 18, 2) AS BIGINT)
    - CASE WHEN regexp_matches(t, '[+-][0-9]{2}:[0-9]{2}\z') THEN (CASE WHEN substr(t, length(t) - 5, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(t, length(t) - 4, 2) AS BIGINT) * 60 + CAST(substr(t, length(t) - 1, 2) AS BIGINT)) * 60 ELSE 0 END END AS secs,
  CASE WHEN valid AND d IS NOT NULL AND substr(t, 18, 2) <> '60' AND length(frac) <= 9 THEN CAST(rpad(frac, 9, '0') AS INTEGER) END AS nanos FROM tv)"""
