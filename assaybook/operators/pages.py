"""Pages of a reply: coverage, oversized records, degradation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(requested: DataFrame, statuses: DataFrame) -> DataFrame:
    """``resource_id, verdict``: each requested resource must have exactly one status; others are extra."""
    want = requested.select("resource_id").distinct().withColumn("_want", F.lit(True))
    have = statuses.groupBy("resource_id").agg(F.count(F.lit(1)).alias("_n"))
    verdict = F.when(F.col("_want").isNull(), F.lit("extra")).when(F.col("_n").isNull(), F.lit("missing")).when(F.col("_n") > 1, F.lit("repeated")).otherwise(F.lit("ok"))
    return want.join(have, "resource_id", "full_outer").select("resource_id", verdict.alias("verdict"))


def split_oversized(rows: DataFrame, size: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and for each resource the dropped ones as a ``degraded`` list."""
    sized = rows.withColumn("_bytes", size)
    dropped = sized.filter(F.col("_bytes") > most).groupBy("resource_id").agg(F.array_sort(F.collect_list(F.struct("local_id", F.col("_bytes").cast("long").alias("bytes")))).alias("degraded"))
    return sized.filter(F.col("_bytes") <= most).drop("_bytes"), dropped


def degrade(extra: Column, total: Column, most: int) -> Column:
    """What becomes of an observation's extra object: kept, cut down to its size, or the whole row omitted (null)."""
    bytes_ = F.octet_length(extra)
    cut = F.to_json(F.struct(F.lit(True).alias("_truncated"), bytes_.alias("_original_bytes")))
    return F.when(total <= most, extra).when(total - bytes_ + F.octet_length(cut) <= most, cut)


def refuse_foreign(rows: DataFrame, adapter: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the adapter itself, and whether there were others; judged before any other filter."""
    own = F.coalesce(F.col("provenance_adapter") == adapter, F.lit(False))
    return rows.filter(own), rows.agg(F.coalesce(F.bool_or(~own), F.lit(False)).alias("foreign_provenance"))
