"""JSON Lines frames: framing limits and strict decoding.

Spark's JSON readers coerce numbers, ignore unknown keys and keep the last of
repeated ones. These expressions check presence, kinds and key sets on the text
before anything becomes a nullable column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.functions.money import amount_error, asset_error
from assaybook.functions.text import MAX_FRAME, strict_object


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """``value, violation``: lines by line feed alone; a line too long or no JSON is named, not dropped."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.withColumn("violation", F.when(F.octet_length("value") > MAX_FRAME, F.lit("frame_too_large")).when(F.try_parse_json("value").isNull(), F.lit("not_json")))


def kind(json: Column, path: str) -> Column:
    """Kind of the value at a path: OBJECT, STRING, BIGINT ...; VOID for JSON null, SQL null if absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def envelope_error(reply: Column) -> Column:
    """What is wrong with a reply: it has an id and exactly one of ``ok`` and ``err``."""
    good = strict_object(reply, ["id", "ok"]) | strict_object(reply, ["id", "err"])
    return F.when(F.try_parse_json(reply).isNull(), F.lit("not_json")).when(~good, F.lit("bad_envelope")).when(~F.coalesce(kind(reply, "$.id") == "BIGINT", F.lit(False)), F.lit("bad_id"))


def money_error(money: Column) -> Column:
    """What is wrong with ``{"asset", "amount"}``: both must be strings, a JSON number is refused."""
    text = lambda name: F.coalesce(kind(money, f"$.{name}") == "STRING", F.lit(False))
    asset, amount = F.get_json_object(money, "$.asset"), F.get_json_object(money, "$.amount")
    return F.when(~strict_object(money, ["asset", "amount"]), F.lit("not_a_money_object")).when(~text("asset") | ~text("amount"), F.lit("not_a_string")).otherwise(F.coalesce(asset_error(asset), amount_error(amount)))


def balance_amount_error(line: Column) -> Column:
    """A balance line's amount may be null (unknown) but not absent."""
    present = F.array_contains(F.json_object_keys(line), "amount")
    null = F.coalesce(kind(line, "$.amount") == "VOID", F.lit(False))
    return F.when(~F.coalesce(present, F.lit(False)), F.lit("amount_absent")).when(~null, money_error(F.get_json_object(line, "$.amount")))
