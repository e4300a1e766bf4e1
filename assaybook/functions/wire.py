"""Small expressions over wire and provider values."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.functions import money
from assaybook.functions.rfc3339 import instant

BODY_CAP, CAP_MARK = 4096, " [truncated]"


def as_of(staleness_reason: Column, received_at: Column) -> Column:
    """The time a figure was observed: that of a ``stale:`` label, else its receipt."""
    return F.when(staleness_reason.startswith("stale:"), F.substring(staleness_reason, F.lit(7), F.length(staleness_reason))).otherwise(received_at)


def grammar_evidence(amount: Column) -> Column:
    """``struct(digits, scale)``: all digits shown, also leading zeros, and those after the point."""
    return F.struct(F.length(money.digits(amount)).alias("digits"), money.scale(amount).alias("scale"))


def in_window(effective_at: Column, start: Column, end: Column) -> Column:
    """Half-open window on instants: the start belongs to it, the end doesn't."""
    return F.coalesce((instant(effective_at) >= instant(start)) & (instant(effective_at) < instant(end)), F.lit(False))


def resource_fingerprint(kind: Column, extra_json: Column) -> Column:
    """SHA-256 of the JSON object of what defines a resource, keys in order; its label does not. No extra is an empty one."""
    extra = F.try_parse_json(F.coalesce(extra_json, F.lit("{}")))
    return F.when(extra.isNotNull(), F.sha2(F.to_json(F.struct(kind.alias("kind"), extra.alias("provider_extra"))), 256))


def request_shape(params_json: Column) -> Column:
    """Request parameters with every page cursor masked, so that two crawls compare."""
    return F.regexp_replace(params_json, r'("cursor"\s*:\s*)"(?:[^"\\]|\\.)*"', r'$1"*"')


def valid_address(address: Column) -> Column:
    return address.rlike(r"\A[0-9A-Za-z]{1,128}\z")


@F.pandas_udf(T.StringType())
def number_amount(payload: pd.Series, path: pd.Series, negate: pd.Series) -> pd.Series:
    """Amount text of a JSON number at a dotted path, digit for digit; every JVM reader would normalise it.

    Zero is never negated; exponents become plain notation; null if there is no number.
    """

    def one(text, at, flip):
        try:
            value = json.loads(text, parse_float=Decimal, parse_int=Decimal)
            for key in at.split("."):
                value = value[int(key)] if isinstance(value, list) else value[key]
        except (ValueError, KeyError, IndexError, TypeError):
            return None
        if not isinstance(value, Decimal):
            return None
        return format(abs(value) if value == 0 else value.copy_negate() if flip else value, "f")

    return pd.Series([one(*x) for x in zip(payload, path, negate, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def capped_body(body: pd.Series) -> pd.Series:
    """An error body of at most 4 KiB, cut between characters, with a mark."""

    def one(text):
        if text is None or len(raw := text.encode()) <= BODY_CAP:
            return text
        return raw[: BODY_CAP - len(CAP_MARK)].decode("utf-8", "ignore") + CAP_MARK

    return pd.Series([one(t) for t in body], dtype=object)
