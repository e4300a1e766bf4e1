"""Revisions, chains, heads and the live set.

A record's key is ``(adapter_id, local_id)``. Revisions count arrivals; the
chain's own order is (received_at, surface, arrival_index), and its last entry
is the head. Every window here is partitioned by the key in the same order, so
one exchange serves them all. The resource filter comes after the fold: a
record that moved must not have its chain split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("adapter_id", "local_id")


def revisions(observations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add ``revision``: arrival order, going on from the stored maximum."""
    count = F.row_number().over(Window.partitionBy(*KEY).orderBy("arrival_index"))
    if stored is None:
        return observations.withColumn("revision", count)
    top = stored.groupBy(*KEY).agg(F.max("revision").alias("_top"))
    return observations.join(top, list(KEY), "left").withColumn("revision", count + F.coalesce("_top", F.lit(0))).drop("_top")


def chain_order(revised: DataFrame) -> DataFrame:
    """Add ``position`` in the chain and ``is_head``."""
    chain = Window.partitionBy(*KEY).orderBy("received_at", "surface", "arrival_index")
    every = Window.partitionBy(*KEY)
    return revised.withColumn("position", F.row_number().over(chain)).withColumn("is_head", F.col("position") == F.count(F.lit(1)).over(every))


def heads(revised: DataFrame) -> DataFrame:
    """The last entry of each chain, with the chain's ``max_revision``."""
    last = Window.partitionBy(*KEY).orderBy(F.col("received_at").desc(), F.col("surface").desc(), F.col("arrival_index").desc())
    top = F.max("revision").over(Window.partitionBy(*KEY))
    return revised.withColumn("max_revision", top).withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")


def highest_revisions(revised: DataFrame) -> DataFrame:
    return revised.groupBy(*KEY).agg(F.max("revision").alias("max_revision"))


def high_water(retractions: DataFrame) -> DataFrame:
    return retractions.groupBy(*KEY).agg(F.max("revision").alias("high_water"))


def live_set(revised: DataFrame, retractions: DataFrame, resource_id: str | None = None) -> DataFrame:
    """Heads that are active and not buried by a retraction of their chain's highest revision."""
    found = heads(revised).join(high_water(retractions), list(KEY), "left").filter((F.col("state") == "active") & (F.col("max_revision") > F.coalesce("high_water", F.lit(0)))).drop("high_water")
    return found if resource_id is None else found.filter(F.col("resource_id") == resource_id)


def listed(live: DataFrame) -> DataFrame:
    """The live set in the order in which it is shown."""
    return live.orderBy("local_id", "adapter_id")


def retractions_of_complete_sweeps(revised: DataFrame) -> DataFrame:
    """All retractions at once, if every crawl was complete and no exemption applies.

    A key whose head is active after crawl c and that crawl c + 1 did not
    observe is retracted there. Revival needs no rule of its own.
    """
    crawl = Window.partitionBy(*KEY, "crawl_id")
    last = crawl.orderBy(F.col("received_at").desc(), F.col("surface").desc(), F.col("arrival_index").desc())
    per_crawl = revised.withColumn("_top", F.max("revision").over(crawl)).withColumn("_r", F.row_number().over(last)).filter("_r = 1")
    following = F.lead("crawl_id").over(Window.partitionBy(*KEY).orderBy("crawl_id"))
    final = revised.agg(F.max("crawl_id")).first()[0] or 0
    gaps = per_crawl.withColumn("_next", F.coalesce(following, F.lit(final + 1)))
    return gaps.filter((F.col("state") == "active") & (F.col("_next") > F.col("crawl_id") + 1)).select(*KEY, "resource_id", F.col("_top").cast("long").alias("revision"), (F.col("crawl_id") + 1).alias("crawl_id"))


def unchanged(observations: DataFrame) -> DataFrame:
    """Add ``appended``: false where an observation repeats its predecessor's content. For chains in arrival order."""
    before = F.lag("content_hash").over(Window.partitionBy(*KEY).orderBy("arrival_index"))
    return observations.withColumn("appended", ~F.coalesce(before == F.col("content_hash"), F.lit(False)))


def moved(revised: DataFrame) -> DataFrame:
    """Chains seen under more than one resource; they live under their head's alone."""
    seen = revised.groupBy(*KEY).agg(F.countDistinct("resource_id").alias("resources"))
    return heads(revised).join(seen.filter("resources > 1"), list(KEY))


def show(revised: DataFrame, retractions: DataFrame) -> DataFrame:
    """A chain and its retractions together, by revision, the observation first."""
    entries = revised.select(*KEY, "revision", F.lit(0).alias("kind"), "state", F.col("crawl_id").cast("long").alias("crawl_id"))
    return entries.unionByName(retractions.select(*KEY, "revision", F.lit(1).alias("kind"), F.lit("retracted").alias("state"), F.col("crawl_id").cast("long").alias("crawl_id")))
