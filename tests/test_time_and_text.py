from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from assaybook.functions import rfc3339, text
from assaybook.plans import queries

TIMES = [
    ("1970-01-01T00:00:00Z", (0, 0)),
    ("0001-01-01T00:00:00Z", (-62135596800, 0)),
    ("9999-12-31T23:59:59Z", (253402300799, 0)),
    ("2024-02-29t12:00:00.5+01:30", (int(datetime(2024, 2, 29, 10, 30, tzinfo=UTC).timestamp()), 500000000)),
    ("2024-01-01T00:00:00-23:59", (int(datetime(2024, 1, 1, 23, 59, tzinfo=UTC).timestamp()), 0)),
    ("2024-01-01T00:00:00.120000000000z", (1704067200, 120000000)),
    ("2023-02-29T00:00:00Z", None),
    ("2024-01-01T00:00:60Z", None),
    ("2024-01-01T00:00:00.0000000001Z", None),
    ("2024-01-01 00:00:00Z", None),
    ("2024-01-01T00:00:00Z\n", None),
    ("", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", rfc3339.instant(F.col("t")).alias("x")).collect()}
    for i, (t, want) in enumerate(TIMES):
        assert (tuple(got[i]) if got[i] else None) == want, t


def test_shape_is_not_calendar(spark):
    df = spark.createDataFrame([("2023-02-30T00:00:00Z",), ("2023-13-01T00:00:00Z",)], "t string")
    assert [r[0] for r in df.select(rfc3339.valid(F.col("t"))).collect()] == [True, False]


def test_unorderable_bound_exempts(spark):
    df = spark.createDataFrame([(None, "2024-01-02T00:00:00Z", "2024-01-01T23:00:00-05:00"), (None, "nonsense", "2024-01-01T00:00:00Z")], "e string, o string, h string")
    assert [r[0] for r in df.select(rfc3339.precedes_bound(F.col("e"), F.col("o"), F.col("h"))).collect()] == [False, False]


@pytest.mark.parametrize(("s", "ok", "at"), [("PAYPAL *STEAM\tx", True, None), ("a<b", False, 1), ("é\x07", False, 2), ("", True, None), ("x\x7f", False, 1), ("a\nb", False, 1)])
def test_plain_text(spark, s, ok, at):
    r = spark.createDataFrame([(s,)], "s string").select(text.plain_text_valid(F.col("s")), text.first_forbidden(F.col("s"))).first()
    assert (r[0], r[1]) == (ok, at)


def test_content_hash_tells_null_from_empty_and_scale_from_value(spark):
    df = spark.createDataFrame([(None, "1.5"), ("", "1.5"), ("", "1.50")], "a string, b string")
    assert len({r[0] for r in df.select(text.content_hash(F.col("a"), F.col("b"))).collect()}) == 3


def test_strict_objects(spark):
    cases = [('{"a":1}', True), ('{"a":1,"a":2}', False), ('{"a":1,"z":2}', False), ("[1]", False), ("{}", False), ("nope", False), (None, False), ('{"a":1,"b":2}', True)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = dict(df.select("i", text.strict_object(F.col("c"), ["a"], ["b"])).collect())
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_outcomes(spark):
    cases = [*queries._OUTCOMES, ('{"stale":{"as_of":"x"}}', None), ('{"stale":1,"gone":2}', None), ('{"fetched":{"page_empty":true,"more":1}}', None), (None, None)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = dict(df.select("i", text.outcome_kind(F.col("c"))).collect())
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_labels(spark):
    df = spark.createDataFrame([(5,), (-1,), (0,)], "d int")
    assert [r[0] for r in df.select(text.describe(F.col("d"))).collect()] == ["received", "sent", "self-transfer"]
    assert spark.range(1).select(text.corpus_name(F.lit("/address/x/txs"))).first()[0] == "address_x_txs"
