"""Exact money as text: ``-?(0|[1-9][0-9]*)(\\.[0-9]+)?``, at most 128 digits, 38 of them after the point.

Text is the truth; nothing here passes through floating point. Everything is a
Column expression except the addition of numbers over 38 digits, which runs in
an Arrow UDF on Python integers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the money contract.
MAX_BYTES, MAX_DIGITS, MAX_SCALE, MAX_ASSET = 192, 128, 38, 128
GRAMMAR = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?\z"
ASSET = r"\A[\x21-\x7E]{1,128}\z"


def asset_valid(asset: Column) -> Column:
    return asset.rlike(ASSET)


def asset_error(asset: Column) -> Column:
    return F.when(asset == "", F.lit("AssetIdEmpty")).when(F.octet_length(asset) > MAX_ASSET, F.lit("AssetIdTooLong")).when(~asset.rlike(ASSET), F.lit("AssetIdInvalidByte"))


def digits(amount: Column) -> Column:
    return F.regexp_replace(amount, "[^0-9]", "")


def digit_count(amount: Column) -> Column:
    """Digits of the magnitude without leading zeros; zero has one."""
    return F.greatest(F.lit(1), F.length(F.regexp_replace(digits(amount), r"\A0+", "")))


def scale(amount: Column) -> Column:
    return F.length(F.split_part(amount, F.lit("."), F.lit(2)))


def amount_error(amount: Column) -> Column:
    """Name of the first rule that the text breaks, or null. The byte bound comes before the grammar."""
    return (
        F.when(F.octet_length(amount) > MAX_BYTES, F.lit("InputTooLong"))
        .when(amount == "", F.lit("Empty"))
        .when(amount.rlike(r"\A-?(\z|\.)"), F.lit("MissingIntegerPart"))
        .when(amount.rlike(r"\A-?0[0-9]"), F.lit("LeadingZero"))
        .when(~amount.rlike(r"\A-?[0-9]"), F.lit("InvalidByte"))
        .when(amount.rlike(r"\A-?[0-9]+\.\z"), F.lit("MissingFractionDigits"))
        .when(amount.rlike(r"\A-?[0-9]+(\.[0-9]*)?[eE]"), F.lit("ExponentNotation"))
        .when(~amount.rlike(GRAMMAR), F.lit("InvalidByte"))
        .when(amount.rlike(r"\A-0(\.0+)?\z"), F.lit("SignOnZero"))
        .when(digit_count(amount) > MAX_DIGITS, F.lit("TooManyDigits"))
        .when(scale(amount) > MAX_SCALE, F.lit("ScaleTooLarge"))
    )


def error_offset(amount: Column) -> Column:
    """Byte at which LeadingZero, ExponentNotation and InvalidByte are found."""
    good = F.regexp_extract(amount, r"\A-?(?:(?:0|[1-9][0-9]*)(?:\.[0-9]*)?)?", 0)
    sign = F.length(F.regexp_extract(amount, r"\A-?", 0))
    error = amount_error(amount)
    return F.when(error == "LeadingZero", sign).when(error.isin("ExponentNotation", "InvalidByte"), F.octet_length(good)).cast("int")


def is_zero(amount: Column) -> Column:
    return amount.rlike(r"\A-?0(\.0+)?\z")


def negated(amount: Column) -> Column:
    """Sign flipped, scale kept; zero stays unsigned."""
    return F.when(is_zero(amount), amount).when(amount.startswith("-"), F.substring(amount, F.lit(2), F.length(amount))).otherwise(F.concat(F.lit("-"), amount))


def normalized(amount: Column) -> Column:
    """Equal values get equal text: no trailing zeros after the point. A grouping and join key with the asset."""
    return F.regexp_replace(F.when(amount.contains("."), F.regexp_replace(amount, r"0+\z", "")).otherwise(amount), r"\.\z", "")


def rescaled_digits(amount: Column, to: Column) -> Column:
    return F.concat(digits(amount), F.repeat(F.lit("0"), to - scale(amount)))


def format_decimal(units: Column, at: Column) -> Column:
    """Plain notation of an integer text and a scale."""
    sign = F.when(units.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(units, r"\A-", "")
    body = F.lpad(body, F.greatest(F.length(body), at + 1), F.lit("0"))
    whole = F.substring(body, F.lit(1), F.length(body) - at)
    return F.concat(sign, whole, F.when(at > 0, F.concat(F.lit("."), F.right(body, at))).otherwise(F.lit("")))


@F.pandas_udf(T.StringType())
def _wide_add(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        sx, sy = (len(v.partition(".")[2]) for v in (x, y))
        s = max(sx, sy)
        n = int(x.replace(".", "")) * 10 ** (s - sx) + int(y.replace(".", "")) * 10 ** (s - sy)
        if len(str(abs(n))) > MAX_DIGITS:
            raise OverflowError("CoefficientOverflow")
        t = str(abs(n)).rjust(s + 1, "0")
        return ("-" if n < 0 else "") + (f"{t[:-s]}.{t[-s:]}" if s else t)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def _units(amount: Column, to: Column) -> Column:
    sign = F.when(amount.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, rescaled_digits(amount, to)).cast("decimal(38,0)")


def added(a: Column, b: Column) -> Column:
    """Exact sum at the larger scale, for values whose aligned digits fit 37 places; null operands give null."""
    to = F.greatest(scale(a), scale(b))
    total = (_units(a, to) + _units(b, to)).cast("decimal(38,0)").cast("string")
    return format_decimal(total, to)


def added_wide(a: Column, b: Column) -> Column:
    """As ``added``, up to 128 digits."""
    return _wide_add(a, b)


def fits_fast(a: Column, b: Column) -> Column:
    to = F.greatest(scale(a), scale(b))
    return F.greatest(F.length(rescaled_digits(a, to)), F.length(rescaled_digits(b, to))) <= 37


def subtracted(a: Column, b: Column) -> Column:
    return added(a, negated(b))


def same_asset(asset_a: Column, asset_b: Column, value: Column) -> Column:
    """``value`` where the assets agree; an error where they don't. For sums, never for comparisons."""
    return F.when(asset_a == asset_b, value).otherwise(F.raise_error(F.lit("AssetMismatch")))


def compared(asset_a: Column, a: Column, asset_b: Column, b: Column) -> Column:
    """-1, 0 or 1 by value; null across assets. Text only, so no bound on digits."""
    to = F.greatest(scale(a), scale(b))
    strip = lambda x: F.regexp_replace(rescaled_digits(x, to), r"\A0+", "")
    x, y = strip(a), strip(b)
    sx, sy = (F.when(is_zero(v), 0).when(v.startswith("-"), -1).otherwise(1) for v in (a, b))
    size = F.when(F.length(x) != F.length(y), F.when(F.length(x) < F.length(y), -1).otherwise(1)).when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(asset_a == asset_b, F.when(sx != sy, F.when(sx < sy, -1).otherwise(1)).otherwise(size * sx))


def from_integer(n: Column) -> Column:
    """A whole number of smallest units as an amount of scale 0."""
    return n.cast("string")


def wire(asset: Column, amount: Column) -> Column:
    return F.to_json(F.struct(asset.alias("asset"), amount.alias("amount")))


def cents(x: Column) -> Column:
    """A double with two decimals as whole cents: the only step that meets a double."""
    return F.round(x * 100).cast("long")
