"""Balance lines: freshness by the read that made them, and the verdict a reader sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = ("adapter_id", "resource_id", "category")


def with_freshness(balances: DataFrame, reads: DataFrame) -> DataFrame:
    """Add ``from_latest_read``: false, not null, where no read is known."""
    current = reads.groupBy("adapter_id").agg(F.max("read_id").alias("_latest"))
    return balances.join(current, "adapter_id", "left").withColumn("from_latest_read", F.coalesce(F.col("read_id") == F.col("_latest"), F.lit(False))).drop("_latest")


def latest_lines(balances: DataFrame) -> DataFrame:
    newest = Window.partitionBy(*LINE).orderBy(F.col("balance_id").desc())
    return balances.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def verdicts(balances: DataFrame) -> DataFrame:
    """The latest line of each category: its figure or the last one known, and live, stale, unknown or unavailable.

    A recovered figure keeps its own date, not that of the line that failed.
    """
    history = Window.partitionBy(*LINE).orderBy("balance_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.last(F.when(F.col("amount").isNotNull(), F.struct("amount", "as_of")), ignorenulls=True).over(history)
    live = F.col("from_latest_read") & (F.col("staleness") == "live")
    out = latest_lines(balances.withColumn("_known", known).withColumn("_live", live))
    verdict = F.when(F.col("amount").isNotNull() & F.col("_live"), F.lit("live")).when(F.col("amount").isNotNull(), F.lit("stale")).when(F.col("_live"), F.lit("unknown")).when(F.col("_known").isNotNull(), F.lit("stale")).otherwise(F.lit("unavailable"))
    figure = F.when(verdict != "unknown", F.col("_known.amount"))
    return out.select(*LINE, "balance_id", verdict.alias("verdict"), figure.alias("figure"), F.when(verdict == "stale", F.col("_known.as_of")).alias("as_of"))


def by_category(balances: DataFrame) -> DataFrame:
    return balances.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n_lines"), F.count("amount").alias("n_known"), F.max("balance_id").alias("last_id"))


def staleness(outcome: Column) -> Column:
    """What an outcome says of the figures read with it; without an outcome they are unavailable, never live."""
    return F.when(outcome.isNull() | outcome.isin("unavailable", "gone"), F.lit("unavailable")).when(outcome == "stale", F.lit("cached")).otherwise(F.lit("live"))


def render(verdict: Column, category: Column, figure: Column, asset: Column, as_of: Column) -> Column:
    """A line of the text report."""
    state = F.when(verdict == "stale", F.concat(F.lit("stale (as of "), as_of, F.lit(")"))).otherwise(verdict)
    shown = F.when(verdict == "unknown", F.lit("unknown")).when(verdict == "unavailable", F.lit("--")).otherwise(F.concat(figure, F.lit(" "), asset))
    return F.concat(F.lit("  "), F.rpad(category, 14, " "), F.lit(" "), F.lpad(shown, 18, " "), F.lit("   "), state)


def needs_reauth(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("adapter_id").agg(F.bool_or(F.coalesce(F.col("outcome").isin("reauth_required", "sca_required", "revoked"), F.lit(False))).alias("needs_reauth"))
