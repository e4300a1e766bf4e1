import json

from pyspark.sql import functions as F

from assaybook.functions import wire
from assaybook.operators import provider
from assaybook.sources import corpus


def test_numbers_keep_their_digits(spark):
    cases = [('{"a":{"b":0.10}}', "a.b", False, "0.10"), ('{"a":1E3}', "a", False, "1000"), ('{"a":123456789012345678901234567890.50}', "a", True, "-123456789012345678901234567890.50"), ('{"a":-0.00}', "a", True, "0.00"), ('{"a":"1"}', "a", False, None), ("no", "a", False, None), ('{"a":[1,2.50]}', "a.1", False, "2.50")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, j string, p string, n boolean")
    got = dict(df.select("i", wire.number_amount("j", "p", "n")).collect())
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_bodies_windows_and_shapes(spark):
    df = spark.createDataFrame([("é" * 4000,), ("short",), (None,)], "b string")
    got = [r[0] for r in df.select(wire.capped_body("b")).collect()]
    assert len(got[0].encode()) <= 4096 and got[0].endswith("[truncated]") and got[1:] == ["short", None]
    t = [F.lit(x) for x in ("2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00", "2024-01-02T00:00:00Z")]
    one = spark.range(1)
    assert one.select(wire.in_window(t[0], t[1], t[2]), wire.in_window(t[2], t[1], t[2])).first()[:] == (True, False)
    assert one.select(wire.request_shape(F.lit('{"cursor": "a\\"b", "x": 1}'))).first()[0] == '{"cursor": "*", "x": 1}'
    assert one.select(wire.as_of(F.lit("stale:t1"), F.lit("t2")), wire.as_of(F.lit("live"), F.lit("t2"))).first()[:] == ("t1", "t2")
    assert one.select(wire.grammar_evidence(F.lit("-00.50"))).first()[0][:] == (4, 2)


def test_recorded_corpus_reconciles(spark, tmp_path):
    tx = lambda i, vin, vout, h: {"txid": f"{i:064x}", "fee": sum(v for _, v in vin) - sum(v for _, v in vout), "status": {"confirmed": h is not None, "block_height": h}, "vin": [{"prevout": {"scriptpubkey_address": a, "value": v}} for a, v in vin], "vout": [{"scriptpubkey_address": a, "value": v} for a, v in vout]}
    first, second = tx(1, [("x", 100)], [("A", 90)], 5), tx(2, [("A", 90)], [("x", 50), ("B", 30)], 6)
    (tmp_path / "address_A.json").write_text(json.dumps({"chain_stats": {"funded_txo_sum": 90, "spent_txo_sum": 90, "extra": 1}, "mempool_stats": {"funded_txo_sum": 0, "spent_txo_sum": 0}}))
    (tmp_path / "address_B.json").write_text(json.dumps({"chain_stats": {"funded_txo_sum": 30, "spent_txo_sum": 0}, "mempool_stats": {"funded_txo_sum": 0, "spent_txo_sum": 0}}))
    (tmp_path / "address_A_txs_chain.json").write_text(json.dumps([first, second]))
    (tmp_path / "address_B_txs_chain.json").write_text(json.dumps([second]))
    (tmp_path / "address_B_txs_mempool.status").write_text("429\nslow down")
    found = corpus.read_corpus(spark, str(tmp_path))
    assert found.filter("status = 429").first().body == "slow down"
    owned = spark.createDataFrame([("A",), ("B",)], "address string")
    legs = corpus.transaction_legs(found)
    deltas = provider.net_deltas(legs, owned)
    balance = corpus.address_stats(found).agg(F.sum(F.col("funded") - F.col("spent"))).first()[0]
    assert int(deltas.agg(F.sum("net_delta")).first()[0]) == balance == 30
    (tmp_path / "wallets.json").write_text(json.dumps({"wallets": [{"resource_id": "w1", "addresses": ["A", "B"]}, {"resource_id": "w2", "label": "l", "addresses": ["B", "é"]}]}))
    got = {(r.resource_id, r.address): r.problem for r in corpus.read_wallets(spark, str(tmp_path / "wallets.json")).collect()}
    assert got == {("w1", "A"): None, ("w1", "B"): "repeated_address", ("w2", "B"): "repeated_address", ("w2", "é"): "invalid_address"}
