from decimal import Context, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaybook.functions import money

REJECTED = [
    ("", "Empty", None),
    ("007.50", "LeadingZero", 0),
    ("-007", "LeadingZero", 1),
    ("1e18", "ExponentNotation", 1),
    ("1E-7", "ExponentNotation", 1),
    (".5", "MissingIntegerPart", None),
    ("-", "MissingIntegerPart", None),
    ("-.", "MissingIntegerPart", None),
    ("5.", "MissingFractionDigits", None),
    ("100. 0", "InvalidByte", 4),
    ("100.x", "InvalidByte", 4),
    ("5.e3", "ExponentNotation", 2),
    ("-0", "SignOnZero", None),
    ("-0.00", "SignOnZero", None),
    ("+5", "InvalidByte", 0),
    ("1,000", "InvalidByte", 1),
    (" 5", "InvalidByte", 0),
    ("NaN", "InvalidByte", 0),
    ("١٢٣", "InvalidByte", 0),
    ("1\n", "InvalidByte", 1),
    ("9" * 129, "TooManyDigits", None),
    ("0." + "1" * 39, "ScaleTooLarge", None),
    ("1" * 193, "InputTooLong", None),
]
ACCEPTED = ["0", "0.00", "1", "-1.50", "2100000000000000", str(2**256 - 1), "9" * 128, "0." + "0" * 37 + "1"]


def test_rejections_and_offsets(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(REJECTED)], "i int, a string")
    got = {r.i: (r.e, r.o) for r in df.select("i", money.amount_error(F.col("a")).alias("e"), money.error_offset(F.col("a")).alias("o")).collect()}
    for i, (text, error, offset) in enumerate(REJECTED):
        assert got[i] == (error, offset), text


def test_accepted(spark):
    df = spark.createDataFrame([(a,) for a in ACCEPTED], "a string")
    assert df.filter(money.amount_error(F.col("a")).isNotNull()).count() == 0


amounts = st.builds(lambda n, s: f"{Decimal(n).scaleb(-s, Context(prec=200)):f}", st.integers(-(10**30), 10**30), st.integers(0, 6)).filter(lambda t: not t.startswith("-0") or Decimal(t) != 0)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(amounts, amounts), min_size=20, max_size=40))
def test_against_decimal(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    x = F.lit("x")
    rows = df.select("i", money.added(a, b).alias("s"), money.added_wide(a, b).alias("w"), money.subtracted(a, b).alias("d"), money.compared(x, a, x, b).alias("c"), money.normalized(a).alias("n"), money.negated(a).alias("m")).collect()
    exact = Context(prec=200)
    for r in rows:
        p, q = (Decimal(v) for v in pairs[r.i])
        scale = max(len(v.partition(".")[2]) for v in pairs[r.i])
        total = exact.add(p, q)
        assert Decimal(r.s) == total and len(r.s.partition(".")[2]) == scale and r.s == r.w
        assert not (r.s.startswith("-") and total == 0)
        assert Decimal(r.d) == exact.subtract(p, q)
        assert r.c == (p > q) - (p < q)
        assert Decimal(r.n) == p and not (("." in r.n) and r.n.endswith("0"))
        assert Decimal(r.m) == exact.minus(p)


def test_wide_sum_and_overflow(spark):
    nines = "9" * 100
    df = spark.createDataFrame([(nines, "1")], "a string, b string")
    assert df.select(money.added_wide(F.col("a"), F.col("b"))).first()[0] == "1" + "0" * 100
    over = spark.createDataFrame([("9" * 128, "1")], "a string, b string")
    with pytest.raises(Exception, match="CoefficientOverflow"):
        over.select(money.added_wide(F.col("a"), F.col("b"))).collect()


def test_assets_never_mix(spark):
    df = spark.createDataFrame([("usd", "1", "eur", "1")], "x string, a string, y string, b string")
    c = [F.col(n) for n in "xayb"]
    assert df.select(money.compared(*c)).first()[0] is None
    with pytest.raises(Exception, match="AssetMismatch"):
        df.select(money.same_asset(c[0], c[2], money.added(c[1], c[3]))).collect()


def test_assets(spark):
    df = spark.createDataFrame([("usd",), ("",), ("a b",), ("x" * 129,), ("bitcoin:éur",)], "a string")
    assert [r[0] for r in df.select(money.asset_error(F.col("a"))).collect()] == [None, "AssetIdEmpty", "AssetIdInvalidByte", "AssetIdTooLong", "AssetIdInvalidByte"]
