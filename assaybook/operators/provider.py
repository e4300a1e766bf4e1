"""Provider mapping: transactions of an unspent-output ledger as wallet observations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"


def net_deltas(legs: DataFrame, owned: DataFrame) -> DataFrame:
    """Per transaction: what came to owned addresses less what left them, and whether the wallet spent.

    ``legs`` are ``txid, side ('in' or 'out'), address, value``; a leg without an address moves nothing.
    """
    mark = owned.select("address").distinct().withColumn("_own", F.lit(True))
    own = F.coalesce("_own", F.lit(False))
    joined = legs.join(mark, "address", "left")
    signed = F.when(own & (F.col("side") == "out"), F.col("value")).when(own & (F.col("side") == "in"), -F.col("value")).otherwise(F.lit(0)).cast(WHOLE)
    return joined.groupBy("txid").agg(F.sum(signed).cast(WHOLE).alias("net_delta"), F.bool_or(own & (F.col("side") == "in")).alias("wallet_spent"))


def net_delta_of(vin: Column, vout: Column, owned: Column) -> Column:
    """The same over arrays of ``struct(address, value)`` in one row, for wallets of few addresses."""
    total = lambda legs: F.aggregate(F.filter(legs, lambda x: F.array_contains(owned, x["address"])), F.lit(0).cast(WHOLE), lambda s, x: (s + x["value"].cast(WHOLE)).cast(WHOLE))
    return (total(vout) - total(vin)).cast(WHOLE)


def wallet_balances(stats: DataFrame) -> DataFrame:
    """Confirmed and unconfirmed balance of each wallet, never added together."""
    part = lambda section: F.sum(F.when(F.col("section") == section, F.col("funded") - F.col("spent")).otherwise(0)).cast("long")
    return stats.groupBy("wallet").agg(part("chain").alias("confirmed"), part("mempool").alias("unconfirmed"))


def distinct_transactions(txs: DataFrame, *ties: str) -> DataFrame:
    """One row a transaction: the last confirmed copy, else the first unconfirmed."""
    rank = F.when(F.col("confirmed"), F.col("arrival")).otherwise(-F.col("arrival"))
    w = Window.partitionBy("txid").orderBy(F.col("confirmed").desc(), rank.desc(), *ties)
    return txs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def plan(txs: DataFrame, floor: Column | None = None, floor_mempool: Column | None = None) -> DataFrame:
    """Emission order: confirmed by (height, txid) above the floor, then the mempool by txid."""
    above = F.lit(True) if floor is None else F.struct("height", "txid") > floor
    after = F.lit(True) if floor_mempool is None else F.col("txid") > floor_mempool
    confirmed = txs.filter("height IS NOT NULL").filter(above).withColumn("section", F.lit(0))
    return confirmed.unionByName(txs.filter("height IS NULL").filter(after).withColumn("section", F.lit(1)))


def emission_order(planned: DataFrame) -> DataFrame:
    """Add ``seq``, the place of a planned transaction in its section.

    A block's transactions are numbered in a task of their own, after those of
    all lower blocks, which are counted by height: no task sees a whole section
    but the one of the mempool, which is one block's worth of what can wait.
    """
    blocks = planned.groupBy("section", "height").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy("section").orderBy("height").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("section").alias("_s"), F.col("height").alias("_h"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("section", "height").orderBy("txid"))
    return planned.withColumn("_i", number).join(starts, (F.col("section") == F.col("_s")) & F.col("height").eqNullSafe(F.col("_h"))).withColumn("seq", (F.col("_before") + F.col("_i")).cast("int")).drop("_i", "_s", "_h", "_before")


def high_water(txs: DataFrame) -> DataFrame:
    return txs.filter("height IS NOT NULL").agg(F.max(F.struct("height", "txid")).alias("high_water")).select("high_water.*")


def mempool_ids(txs: DataFrame) -> DataFrame:
    """The transactions that wait for a block, each once."""
    return txs.filter("height IS NULL").select("txid").distinct()


def first_page(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Add ``on_first_page``: a running sum of sizes, and a byte between, within the budget."""
    run = F.sum(F.col(size) + 1).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("on_first_page", run - 1 <= budget)


def cut_pages(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """``key, order, page``: greedy packing, which no window expresses; a row over the budget gets no page.

    A key's rows stream through in order, and only the page and what it holds
    are kept: a key of any length needs no memory.
    """
    kind = dict(rows.dtypes)
    number = F.row_number().over(Window.partitionBy(key).orderBy(order))

    def pack(batches):
        page, used = 1, 0
        for batch in batches:
            out = []
            for n, first in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if first == 1:
                    page, used = 1, 0
                if n is None or n > budget:
                    out.append(None)
                    continue
                if used and used + 1 + n > budget:
                    page, used = page + 1, 0
                used += n + (used > 0)
                out.append(page)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], [key, order, "page"])

    return rows.select(key, order, size, number.alias("_n")).mapInArrow(pack, f"{key} {kind[key]}, {order} {kind[order]}, page long")


def esplora_observations(txs: DataFrame, wallet: str) -> DataFrame:
    """Transactions with ``net_delta``, ``wallet_spent``, ``fee`` and ``height`` as observation rows."""
    delta = F.col("net_delta")
    return txs.select(
        F.concat_ws(":", F.lit(wallet), F.col("txid")).alias("local_id"),
        F.lit("active").alias("state"),
        F.when(F.col("height").isNull(), F.lit("pending")).otherwise(F.lit("posted")).alias("posting"),
        delta.cast("string").alias("amount"),
        F.when(F.col("wallet_spent"), F.col("fee").cast("string")).alias("fees"),
        F.when(delta >= 0, F.lit("provider_positive")).otherwise(F.lit("provider_negative")).alias("raw_sign"),
        F.when(delta > 0, F.lit("received")).when(delta < 0, F.lit("sent")).otherwise(F.lit("self-transfer")).alias("description"),
    )
