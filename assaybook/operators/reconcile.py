"""Reconciliation of emitted evidence against declared evidence."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_diff(actual: DataFrame, expected: DataFrame, key: list[str], content: str) -> DataFrame:
    """Keys that differ: missing, unexpected or different content."""
    a = actual.select(*key, F.col(content).alias("_a"), F.lit(1).alias("_in_a"))
    e = expected.select(*key, F.col(content).alias("_e"), F.lit(1).alias("_in_e"))
    verdict = F.when(F.col("_in_a").isNull(), F.lit("missing")).when(F.col("_in_e").isNull(), F.lit("unexpected")).when(~F.col("_a").eqNullSafe(F.col("_e")), F.lit("differs"))
    return a.join(e, key, "full_outer").select(*key, verdict.alias("verdict")).filter("verdict IS NOT NULL")


def sequence_diff(actual: DataFrame, declared: DataFrame, key: list[str], content: str) -> DataFrame:
    """Positions at which two ordered sequences of a key differ: duplicates and reordering count, unlike in a set."""
    return content_diff(actual, declared, [*key, "seq"], content)


def align_slice(emitted: DataFrame, declared: DataFrame, key: list[str], content: str) -> DataFrame:
    """Per key of ``emitted``: the offset at which it agrees best with a slice of the declared sequence, and its differences.

    The slice lies inside the declared sequence; of equally good offsets the
    first counts. Where nothing agrees anywhere that is 0. A sequence longer
    than the declared one fits nowhere: its offset is null and its differences
    are the elements too many. Only offsets at which an element agrees are
    compared: an equi-join on content, of which the pairs outside are dropped.
    """
    size = Window.partitionBy(*key)
    e = emitted.select(*key, F.col("seq").alias("_e"), F.col(content).alias("_c"))
    d = declared.select(*key, F.col("seq").alias("_d"), F.col(content).alias("_c"), F.count(F.lit(1)).over(size).alias("_m"))
    n = e.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(d.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key, "left").fillna(0, ["m"])
    counted = e.withColumn("_n", F.count(F.lit(1)).over(size))
    inside = (F.col("_d") >= F.col("_e")) & (F.col("_d") - F.col("_e") <= F.col("_m") - F.col("_n"))
    agree = counted.join(d, [*key, "_c"]).filter(inside).groupBy(*key, (F.col("_d") - F.col("_e")).cast("long").alias("offset")).agg(F.count(F.lit(1)).alias("agree"))
    best = agree.groupBy(*key).agg(F.max(F.struct("agree", (-F.col("offset")).alias("o"))).alias("b"))
    fits = F.col("n") <= F.col("m")
    offset = F.when(fits, F.coalesce(-F.col("b.o"), F.lit(0).cast("long")))
    return n.join(best, key, "left").select(*key, offset.alias("offset"), F.when(fits, F.col("n") - F.coalesce("b.agree", F.lit(0))).otherwise(F.col("n") - F.col("m")).cast("long").alias("differences"), fits.alias("fits"))


def set_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    left = a.select(*key).distinct().join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("right")))


def not_monotone(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value does not exceed the one before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("previous", before).filter(F.col("previous").isNotNull() & (F.col(value) <= F.col("previous")))


def reconcile(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Totals by key on both sides and whether they agree; a missing side is zero rows, not an agreement."""
    a = left.groupBy(*key).agg(F.sum(value).alias("left_total"))
    b = right.groupBy(*key).agg(F.sum(value).alias("right_total"))
    return a.join(b, key, "full_outer").select(*key, "left_total", "right_total", F.col("left_total").eqNullSafe(F.col("right_total")).alias("agrees"))


def stable_view(rows: DataFrame) -> DataFrame:
    """Rows without the time of their arrival, which differs from one crawl to the next."""
    return rows.withColumn("provenance", F.col("provenance").dropFields("received_at"))


def extra_differs(actual: Column, expected: Column) -> Column:
    """Whether an extra object is not exactly the expected one, whatever the order of its keys and its white space.

    Nothing expected (null) accepts anything; an absent object is JSON null.
    """
    exact = lambda c: F.to_json(F.parse_json(c))
    return expected.isNotNull() & (exact(F.coalesce(actual, F.lit("null"))) != exact(expected))


def history_lists(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("local_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]).alias("history"))


def json_subset_diff(actual, expected, path: str = "$") -> list[str]:
    """Where ``actual`` is not a superset of ``expected``; money compares by value, arrays by length and place."""
    if isinstance(expected, dict):
        if not isinstance(actual, dict):
            return [f"{path}: not an object"]
        if path.rsplit(".", 1)[-1] in ("amount", "fees") and {"asset", "amount"} <= expected.keys():
            same = actual.get("asset") == expected["asset"] and _value(actual.get("amount")) == _value(expected["amount"])
            return [] if same else [f"{path}: {actual.get('amount')} {actual.get('asset')} is not {expected['amount']} {expected['asset']}"]
        return [d for k, v in expected.items() for d in (json_subset_diff(actual[k], v, f"{path}.{k}") if k in actual else [f"{path}.{k}: absent"])]
    if isinstance(expected, list):
        if not isinstance(actual, list) or len(actual) != len(expected):
            return [f"{path}: length differs"]
        return [d for i, (a, e) in enumerate(zip(actual, expected, strict=True)) for d in json_subset_diff(a, e, f"{path}[{i}]")]
    return [] if type(actual) is type(expected) and actual == expected else [f"{path}: {actual!r} is not {expected!r}"]


def _value(text) -> str | None:
    return None if not isinstance(text, str) else text.rstrip("0").rstrip(".") if "." in text else text


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_diff(actual: pd.Series, expected: pd.Series) -> pd.Series:
    """``json_subset_diff`` over columns of JSON text."""
    return pd.Series([json_subset_diff(json.loads(a, parse_float=str), json.loads(e, parse_float=str)) if a is not None and e is not None else None for a, e in zip(actual, expected, strict=True)])
