"""Recorded provider replies and wallet files as DataFrames, with given schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.functions.wire import valid_address
from assaybook.sources.schemas import ESPLORA_ADDRESS, ESPLORA_TX, WALLETS


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``name, status, body`` of each recording: ``.json`` files are answers, ``.status`` files begin with their HTTP status."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{json,status}").select(F.col("_metadata.file_name").alias("file"), "value")
    failed = F.col("file").endswith(".status")
    return files.select(
        F.regexp_replace("file", r"\.(json|status)$", "").alias("name"),
        F.when(failed, F.trim(F.substring_index("value", "\n", 1)).try_cast("int")).otherwise(F.lit(200)).alias("status"),
        F.when(failed, F.regexp_replace("value", r"\A[^\n]*\n?", "")).otherwise(F.col("value")).alias("body"),
    )


def transaction_legs(corpus: DataFrame) -> DataFrame:
    """``txid, side, address, value, height, confirmed, fee``: every input and output of recorded transactions, one copy each."""
    pages = corpus.filter("status = 200 AND name LIKE 'address_%_txs_%'").select(F.explode(F.from_json("body", ESPLORA_TX)).alias("t"))
    height = F.when(F.col("t.status.confirmed"), F.col("t.status.block_height"))
    once = pages.select("t.txid", "t.fee", "t.vin", "t.vout", height.alias("height")).groupBy("txid").agg(F.max_by(F.struct("fee", "vin", "vout", "height"), F.coalesce("height", F.lit(-1))).alias("t"))
    into = once.select("txid", F.lit("in").alias("side"), F.explode("t.vin").alias("x"), "t.height", "t.fee").select("txid", "side", F.col("x.prevout.scriptpubkey_address").alias("address"), F.coalesce("x.prevout.value", F.lit(0)).alias("value"), "height", "fee")
    out = once.select("txid", F.lit("out").alias("side"), F.explode("t.vout").alias("x"), "t.height", "t.fee").select("txid", "side", F.col("x.scriptpubkey_address").alias("address"), "x.value", "height", "fee")
    return into.unionByName(out).withColumn("confirmed", F.col("height").isNotNull())


def address_stats(corpus: DataFrame) -> DataFrame:
    """``address, section, funded, spent`` of recorded address summaries."""
    rows = corpus.filter("status = 200").filter(F.col("name").rlike(r"^address_[0-9A-Za-z]+$")).select(F.substring_index("name", "_", -1).alias("address"), F.from_json("body", ESPLORA_ADDRESS).alias("s"))
    part = lambda name, field: rows.select("address", F.lit(name).alias("section"), F.col(f"s.{field}.funded_txo_sum").alias("funded"), F.col(f"s.{field}.spent_txo_sum").alias("spent"))
    return part("chain", "chain_stats").unionByName(part("mempool", "mempool_stats"))


def read_wallets(spark: SparkSession, path: str) -> DataFrame:
    """``resource_id, label, address, problem``: a repeated wallet or address, or an invalid one, is named."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", WALLETS).alias("w"))
    rows = raw.select(F.posexplode("w.wallets").alias("n", "w")).select("n", "w.resource_id", "w.label", F.explode("w.addresses").alias("address"))
    twice = rows.groupBy("address").agg(F.count(F.lit(1)).alias("_n"))
    wallets = rows.groupBy("resource_id").agg(F.countDistinct("n").alias("_w"))
    problem = F.when(F.col("_w") > 1, F.lit("repeated_wallet")).when(~valid_address(F.col("address")), F.lit("invalid_address")).when(F.col("_n") > 1, F.lit("repeated_address"))
    return rows.join(twice, "address").join(wallets, "resource_id").select("resource_id", "label", "address", problem.alias("problem"))
