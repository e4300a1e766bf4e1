"""Streaming ingestion: each micro-batch is a crawl, folded against the store and committed once.

No watermark: late observations are never dropped, the fold orders them. A
batch that runs again after a failure finds its crawl committed and changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.operators import fold, sweep
from assaybook.sources.store import Store


def stored_heads(store: Store) -> DataFrame:
    """Heads of all chains in the store, and whether a retraction has buried them."""
    water = fold.high_water(store.table("retraction"))
    joined = fold.heads(store.table("observation")).join(water, list(fold.KEY), "left")
    return joined.withColumn("buried", F.coalesce("high_water", F.lit(0)) >= F.col("max_revision")).drop("high_water")


RESOURCE = ("adapter_id", "resource_id")


def judged(crawl_id: int, sweeps: DataFrame, pages: DataFrame) -> DataFrame:
    """Each sweep of a crawl with ``disqualified_reason``, null if it may retract; one without pages did not drain."""
    gated = sweep.gate(pages.withColumn("crawl_id", F.lit(crawl_id))).drop("crawl_id")
    why = sweep.disqualifier(F.col("violation"), F.col("began_at_start"), F.col("derivation"))
    return sweeps.join(gated, list(RESOURCE), "left").withColumn("disqualified_reason", why)


def refresh(store: Store, crawl_id: int, rows: DataFrame, complete: bool, sweeps: DataFrame | None = None, pages: DataFrame | None = None) -> None:
    """Fold one crawl's observations into the store; a complete sweep retracts what it did not observe of its resource.

    ``rows`` have the columns of ``observation`` but ``revision`` and ``crawl_id``.
    ``sweeps`` has a row a resource: ``adapter_id, resource_id, violation, began_at_start, derivation, fingerprint,
    provider_id, confirm_empty, history_start``; ``pages`` has the columns of ``sweep.gate`` and ``degraded``. With
    them the gate decides which sweeps retract. Without them ``complete`` is the caller's word that the rows are
    the whole of every resource they name; no other resource is touched.
    """
    old = stored_heads(store)
    decided = sweep.ingest(old, rows.select(*fold.KEY, "received_at", "surface", "arrival_index", "content_hash"))
    decided = decided.select(*fold.KEY, "arrival_index", "revision", "appended")
    joined = rows.drop("revision", "crawl_id").join(decided, [*fold.KEY, "arrival_index"]).withColumn("crawl_id", F.lit(crawl_id))
    tables = {"observation": joined.filter("appended"), "seen": joined.select(*fold.KEY, "revision", "crawl_id", "derivation", "fingerprint")}
    live = old.filter("state = 'active' AND NOT buried")
    if sweeps is not None:
        verdicts = judged(crawl_id, sweeps, pages)
        counted = verdicts.join(rows.groupBy(*RESOURCE).agg(F.count(F.lit(1)).alias("observed")), list(RESOURCE), "left")
        counted = counted.join(live.groupBy(*RESOURCE).agg(F.count(F.lit(1)).alias("live")), list(RESOURCE), "left").fillna(0, ["observed", "live"])
        counted = counted.join(store.vantage().withColumnRenamed("provider_id", "previous"), list(RESOURCE), "left")
        changed = sweep.vantage_exempt(F.col("previous"), F.col("provider_id"))
        kind = F.when(changed, F.lit("vantage_changed")).when(sweep.empty_sweep(F.col("observed"), F.col("live"), F.col("confirm_empty")), F.lit("empty_sweep"))
        counted = counted.withColumn("kind", F.when(F.col("disqualified_reason").isNull(), kind)).withColumn("crawl_id", F.lit(crawl_id))
        tables["crawl"] = counted.withColumn("complete", F.col("disqualified_reason").isNull())
        tables["discrepancy"] = counted.filter("kind IS NOT NULL")
        # a sweep that did not pass adopts no vantage
        tables["resource"] = counted.withColumn("provider_id", F.when(F.col("disqualified_reason").isNull(), F.col("provider_id")))
        passed = counted.filter("disqualified_reason IS NULL AND kind IS NULL").select(*RESOURCE, "history_start", F.col("derivation").alias("_derivation"), F.col("fingerprint").alias("_fingerprint"))
        exempt = pages.select("adapter_id", F.explode("degraded").alias("d")).select("adapter_id", "d.local_id").filter("local_id IS NOT NULL")
    else:
        passed = rows.groupBy(*RESOURCE).agg(F.lit(None).cast("string").alias("history_start"), F.max("derivation").alias("_derivation"), F.max("fingerprint").alias("_fingerprint"))
        exempt = rows.limit(0)
    if complete:
        stamped = sweep.seen_view(store.table("seen")).select(*fold.KEY, "revision", F.col("derivation").alias("_d"), F.col("fingerprint").alias("_f"))
        why = sweep.reason(F.coalesce("_d", "derivation"), F.col("_derivation"), F.coalesce("_f", "fingerprint"), F.col("_fingerprint"))
        reach = live.join(stamped, [*fold.KEY, "revision"], "left").join(passed, list(RESOURCE)).withColumn("reason", why)
        reach = reach.withColumns({"effective_at": F.col("provenance.effective_at"), "observed_at": F.col("provenance.observed_at")})
        gone = sweep.retract(reach, rows, exempt, F.col("history_start"))
        tables["retraction"] = gone.join(reach.select(*fold.KEY, "reason"), list(fold.KEY)).withColumn("crawl_id", F.lit(crawl_id))
    store.commit(crawl_id, tables)


def start(source: DataFrame, store: Store, checkpoint: str, complete: bool | None = None, reads=None):
    """Run ``refresh`` over a stream of observation rows until it has no more.

    ``reads`` gives the ``sweeps`` and ``pages`` of a crawl by its number, and the gate decides what it retracts.
    Without it nothing is retracted, unless ``complete=True`` gives the caller's word that every micro-batch is
    the whole of the resources it holds.
    """
    retracts = reads is not None if complete is None else complete

    def batch(rows: DataFrame, number: int) -> None:
        with store.writer():
            refresh(store, number + 1, rows, retracts, *(reads(number + 1) if reads else ()))

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(store: Store, resource_id: str | None = None) -> DataFrame:
    return fold.live_set(store.table("observation"), store.table("retraction"), resource_id)
