"""Crawls: their states from appended events, where one may resume, and how replies are judged and budgeted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaybook.operators import sweep

RESOURCE = ("adapter_id", "resource_id")


def crawl_states(events: DataFrame) -> DataFrame:
    """Each crawl as its latest events leave it, from ``adapter_id, resource_id, crawl_id, event_no, kind, page, drained, complete, disqualified_reason``.

    ``kind`` is open, cursor or finish. The cursor is the page last written by an
    open or cursor event. It is null once the crawl has drained, and once a newer
    crawl of the resource was opened: a resource has one place to go on from at most.
    """
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("event_no"))
    ended = F.max_by(F.struct("drained", "complete", "disqualified_reason"), at("finish"))
    states = events.groupBy(*RESOURCE, "crawl_id").agg(F.max_by("page", at("open")).alias("start_page"), F.max_by("page", at("open", "cursor")).alias("_page"), ended.alias("_end"))
    newest = F.max("crawl_id").over(Window.partitionBy(*RESOURCE))
    drained = F.coalesce("_end.drained", F.lit(False))
    return states.select(
        *RESOURCE,
        "crawl_id",
        "start_page",
        F.when(~drained & (F.col("crawl_id") == newest), F.col("_page")).alias("next_page"),
        drained.alias("drained"),
        F.coalesce("_end.complete", F.lit(False)).alias("complete"),
        F.col("_end.disqualified_reason").alias("disqualified_reason"),
    )


def resume_points(crawls: DataFrame, hello: DataFrame) -> DataFrame:
    """``adapter_id, resource_id, start_page, began_at_start`` of each resource of ``hello``.

    A page to go on from holds only while derivation and fingerprint are those
    of the crawl that left it; a missing fingerprint never matches. The gate
    takes ``began_at_start``: a resumed sweep retracts nothing.
    """
    left = sweep.resumable(crawls).select(*RESOURCE, F.col("next_page").alias("_page"), F.col("derivation").alias("_d"), F.col("fingerprint").alias("_f"))
    same = F.coalesce((F.col("_d") == F.col("derivation")) & (F.col("_f") == F.col("fingerprint")), F.lit(False))
    page = F.when(same, F.col("_page"))
    return hello.join(left, list(RESOURCE), "left").select(*RESOURCE, page.alias("start_page"), page.isNull().alias("began_at_start"))


def with_outcome(balances: DataFrame, statuses: DataFrame) -> DataFrame:
    """Balances with the ``outcome`` of their resource's status; none or several of them fail the query."""
    one = statuses.groupBy("resource_id").agg(F.count(F.lit(1)).alias("_n"), F.min("outcome").alias("outcome"))
    why = F.concat(F.lit("a balance for resource "), F.col("resource_id"), F.lit(" whose statuses number "), F.coalesce("_n", F.lit(0)).cast("string"))
    checked = F.when(F.coalesce(F.col("_n") == 1, F.lit(False)), F.col("outcome")).otherwise(F.raise_error(why).cast("string"))
    return balances.drop("outcome").join(one, "resource_id", "left").withColumn("outcome", checked).drop("_n")


def broke_contract(error: Column, code: Column) -> Column:
    """Whether an error is the adapter's breach: a protocol violation, or a request that it calls invalid."""
    return F.coalesce((error == "protocol_violation") | ((error == "wire") & (code == "invalid_request")), F.lit(False))


def must_not_appear(emitted: DataFrame, omitted: DataFrame) -> DataFrame:
    """The ids declared as wholly omitted that were emitted all the same."""
    return omitted.select("local_id").distinct().join(emitted.select("local_id"), "local_id", "left_semi")


def reply_pages(rows: DataFrame, resources: DataFrame, order: str, budget: int, page: int) -> DataFrame:
    """``reply, resource_id, page_budget, n_taken, bytes_taken``: one byte budget over all resources of a reply.

    ``resources`` are ``reply, place, resource_id, status_bytes``, ``rows`` are
    ``reply, resource_id, size`` and the order column. Every resource's status is
    reserved before the first row is taken. Then resource by resource takes rows
    in order, a byte between them, up to what is left or to ``page``. Rows past
    ``page`` cannot be taken, so what is gathered of a resource is bounded by it,
    and a reply's resources by the frame that asks for them.
    """
    run = F.sum(F.col("size").cast("long") + 1).over(Window.partitionBy("reply", "resource_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    ends = rows.withColumn("_end", run).filter(F.col("_end") <= page).groupBy("reply", "resource_id").agg(F.array_sort(F.collect_list("_end")).alias("ends"))
    asked = resources.join(ends, ["reply", "resource_id"], "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<bigint>")))
    replies = asked.groupBy("reply").agg(F.array_sort(F.collect_list(F.struct("place", "resource_id", "status_bytes", "ends"))).alias("asked"))
    left = F.greatest(F.lit(0).cast("long"), F.lit(budget).cast("long") - F.aggregate("asked", F.lit(0).cast("long"), lambda s, r: s + r["status_bytes"].cast("long")))
    empty = F.array().cast("array<struct<resource_id: string, page_budget: bigint, n_taken: int, bytes_taken: bigint>>")

    def take(state: Column, r: Column) -> Column:
        most = F.least(state["left"], F.lit(page).cast("long"))
        taken = F.filter(r["ends"], lambda end: end <= most)
        spent = F.coalesce(F.array_max(taken), F.lit(0).cast("long"))
        told = F.struct(r["resource_id"].cast("string").alias("resource_id"), most.alias("page_budget"), F.size(taken).alias("n_taken"), spent.alias("bytes_taken"))
        return F.struct((state["left"] - spent).alias("left"), F.concat(state["told"], F.array(told)).alias("told"))

    told = F.aggregate("asked", F.struct(left.alias("left"), empty.alias("told")), take, lambda s: s["told"])
    return replies.select("reply", F.explode(told).alias("t")).select("reply", "t.*")
