"""The gate over a sweep's pages, retractions by a complete sweep, and ingestion of new rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaybook.functions.rfc3339 import precedes_bound
from assaybook.operators.fold import KEY

SWEEP = ("adapter_id", "resource_id", "crawl_id")
# Reasons and kinds that readers of the store rely on.
ABSENT, DERIVATION, DEFINITION = "absent_from_complete_sweep", "derivation_changed", "resource_definition_changed"


def gate(page_status: DataFrame) -> DataFrame:
    """One row a sweep from its pages: ``page_no, outcome, cursor, has_page, next, anonymous_degrade, foreign_provenance``.

    Aggregates over booleans skip nulls, which would let a missing answer pass;
    every input is therefore false unless known to be true.
    """
    fetched = F.coalesce(F.col("outcome") == "fetched", F.lit(False))
    last = F.struct(F.col("page_no"), (F.col("next").isNull() & F.coalesce("has_page", F.lit(False))).alias("drained"))
    offender = F.min(F.when(~fetched, F.struct("page_no", F.coalesce("outcome", F.lit("missing")).alias("outcome"))))
    return page_status.groupBy(*SWEEP).agg(
        F.max(last)["drained"].alias("drained"),
        F.bool_and(fetched).alias("every_page_fetched"),
        offender.alias("offender"),
        F.bool_or(F.coalesce("anonymous_degrade", F.lit(True))).alias("anonymous_degrade"),
        F.bool_and(F.coalesce(F.col("cursor") == "exact", F.lit(False))).alias("every_cursor_exact"),
        F.bool_or(F.coalesce("foreign_provenance", F.lit(True))).alias("foreign_provenance"),
    )


def disqualifier(violation: Column, began_at_start: Column, derivation: Column) -> Column:
    """The first condition that a gated sweep fails, or null if it may retract. The sentences are fixed values: the store keeps them."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(violation.isNotNull(), violation)
        .when(no(began_at_start), F.lit("did not begin at the start of available history"))
        .when(no(F.col("drained")), F.lit("did not drain to next: null"))
        .when(no(F.col("every_page_fetched")), F.concat(F.col("offender.outcome"), F.lit(" on page "), F.col("offender.page_no").cast("string")))
        .when(F.coalesce(F.col("anonymous_degrade"), F.lit(True)), F.lit("an anonymous degraded record"))
        .when(no(F.col("every_cursor_exact")), F.lit("a page cursor was not exact-resumable"))
        .when(F.coalesce(derivation, F.lit("")) == "", F.lit("no hello local_id_derivation on the crawl"))
        .when(F.coalesce(F.col("foreign_provenance"), F.lit(True)), F.lit("an observation's provenance named another adapter"))
    )


def vantage_exempt(previous: Column, current: Column) -> Column:
    """A changed vantage defers retraction for one sweep; a first one does not."""
    return F.coalesce(previous.isNotNull() & (previous != current), F.lit(False))


def empty_sweep(observed: Column, live: Column, confirmed: Column) -> Column:
    return (observed == 0) & (live > 0) & ~F.coalesce(confirmed, F.lit(False))


def reason(head_derivation: Column, derivation: Column, head_fingerprint: Column, fingerprint: Column) -> Column:
    """Why an absent record is retracted. A record never seen (no derivation) is only absent; one seen without a fingerprint was defined otherwise."""
    seen = head_derivation.isNotNull()
    return F.when(seen & ~head_derivation.eqNullSafe(derivation), F.lit(DERIVATION)).when(seen & ~head_fingerprint.eqNullSafe(fingerprint), F.lit(DEFINITION)).otherwise(F.lit(ABSENT))


def retract(live: DataFrame, observed: DataFrame, exempt: DataFrame, history_start: Column | None = None) -> DataFrame:
    """Live records that a complete sweep did not observe and may not excuse; ``revision`` is the chain's highest."""
    gone = live.join(observed.select(*KEY).distinct(), list(KEY), "left_anti").join(exempt.select(*KEY).distinct(), list(KEY), "left_anti")
    if history_start is not None:
        gone = gone.filter(precedes_bound(F.col("effective_at"), F.col("observed_at"), history_start) | history_start.isNull())
    return gone.select(*KEY, "resource_id", F.col("max_revision").alias("revision"))


def discrepancies(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SWEEP, "kind").agg(F.count(F.lit(1)).alias("n"))


def ingest(head: DataFrame, rows: DataFrame) -> DataFrame:
    """New rows with ``revision`` and ``appended``, where a key may come several times in one crawl.

    Each decision depends on the one before, so a key's rows follow one another
    in arrival order, beside its head. A repetition of the head's content appends
    nothing, unless the chain is buried. Rows stream through: what is held is one
    key's top revision, head content and head place, however long its chain.
    Keys with one new row can take the join in ``ingest_single``; both agree on those.
    """
    schema = "adapter_id string, local_id string, arrival_index long, content_hash string, revision long, appended boolean"
    place = lambda t: F.struct(F.col(f"{t}received_at").alias("r"), F.col(f"{t}surface").alias("s"), F.col(f"{t}arrival_index").cast("long").alias("i"))
    known = head.select(*KEY, F.col("max_revision").cast("long").alias("_top"), F.col("buried").alias("_buried"), F.col("content_hash").alias("_hash"), place("").alias("_place"))
    # the window asks for each key's rows together and in order; the number of a key's first row is 1
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("arrival_index"))
    beside = rows.join(known, list(KEY), "left").select(*KEY, "arrival_index", "content_hash", place("").alias("place"), "_top", "_buried", "_hash", "_place", number.alias("_n"))

    def fold(batches):
        top, buried, digest, order = 0, False, None, ("", "", -1)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            revisions, fresh_ones = [], []
            for content, here, known_top, known_buried, known_hash, known_place, n in zip(*columns[3:], strict=True):
                if n == 1:
                    top, buried, digest, order = known_top or 0, bool(known_buried), known_hash, tuple(known_place.values()) if known_top else ("", "", -1)
                fresh = buried or digest is None or content != digest
                if fresh:
                    top, buried = top + 1, False
                    if tuple(here.values()) > order:
                        digest, order = content, tuple(here.values())
                revisions.append(top)
                fresh_ones.append(fresh)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(revisions, pa.int64()), pa.array(fresh_ones, pa.bool_())], ["adapter_id", "local_id", "arrival_index", "content_hash", "revision", "appended"])

    return beside.mapInArrow(fold, schema)


def ingest_single(head: DataFrame, rows: DataFrame) -> DataFrame:
    """``ingest`` for at most one new row a key: a join."""
    h = head.select(*KEY, F.col("content_hash").alias("_hash"), "max_revision", "buried")
    fresh = F.col("max_revision").isNull() | F.col("buried") | (F.col("content_hash") != F.col("_hash"))
    joined = rows.join(h, list(KEY), "left").withColumn("appended", F.coalesce(fresh, F.lit(True)))
    return joined.select(*KEY, "arrival_index", "content_hash", (F.coalesce("max_revision", F.lit(0)) + F.col("appended").cast("int")).cast("long").alias("revision"), "appended")


def counters(ingested: DataFrame) -> DataFrame:
    return ingested.agg(
        F.count_if(F.col("appended") & (F.col("revision") == 1)).alias("new"),
        F.count_if(F.col("appended") & (F.col("revision") > 1)).alias("revised"),
        F.count_if(~F.col("appended")).alias("unchanged"),
    )


def latest_crawls(crawls: DataFrame, n: int) -> DataFrame:
    return crawls.orderBy(F.col("crawl_id").desc()).limit(n)


def resumable(crawls: DataFrame) -> DataFrame:
    """The newest crawl of each resource, if it stopped with a page to go on from."""
    newest = Window.partitionBy("adapter_id", "resource_id").orderBy(F.col("crawl_id").desc())
    return crawls.withColumn("_r", F.row_number().over(newest)).filter("_r = 1 AND NOT drained AND next_page IS NOT NULL").drop("_r")


def seen_view(seen: DataFrame) -> DataFrame:
    """Latest stamp of each chain's row: what replaces an in-place update."""
    return seen.groupBy(*KEY, "revision").agg(F.max_by(F.struct("derivation", "fingerprint", "crawl_id"), F.col("crawl_id")).alias("s")).select(*KEY, "revision", "s.*")
