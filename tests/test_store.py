import json
import sys

import pytest
from pyspark.sql import functions as F

from assaybook.operators import fold
from assaybook.sources import adapter, frames
from assaybook.sources.store import Store, StoreBusy
from assaybook.streaming import ledger_stream

ROWS = "adapter_id string, resource_id string, local_id string, arrival_index long, content_hash string, surface string, state string, received_at string, derivation string, fingerprint string"


def rows(spark, crawl, items):
    return spark.createDataFrame([("a", "r", k, 100 * crawl + i, h, "s", "active", f"2024-01-{crawl:02d}T00:00:00Z", "v1", "f1") for i, (k, h) in enumerate(items)], ROWS)


CRAWLS = [[("k1", "h1"), ("k2", "h1"), ("k2", "h1")], [("k1", "h1"), ("k3", "h1")], [("k1", "h2"), ("k2", "h1")]]


def test_crawls_fold_into_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for n, items in enumerate(CRAWLS, 1):
        with store.writer():
            ledger_stream.refresh(store, n, rows(spark, n, items), complete=True)
    assert store.table("observation").count() == 5  # k1 twice, k2 twice (revived), k3
    assert {(r.local_id, r.crawl_id) for r in store.table("retraction").collect()} == {("k2", 2), ("k3", 3)}
    assert {r.local_id for r in ledger_stream.live(store).collect()} == {"k1", "k2"}
    assert store.next_crawl() == 4


def test_partial_crawls_persist_but_never_retract(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    ledger_stream.refresh(store, 1, rows(spark, 1, [("k1", "h"), ("k2", "h")]), complete=True)
    ledger_stream.refresh(store, 2, rows(spark, 2, [("k1", "h9")]), complete=False)
    assert store.table("observation").count() == 3 and store.table("retraction").count() == 0


SWEEPS = "adapter_id string, resource_id string, violation string, began_at_start boolean, derivation string, fingerprint string, provider_id string, confirm_empty boolean, history_start string"
PAGES = "adapter_id string, resource_id string, page_no long, outcome string, cursor string, has_page boolean, next string, anonymous_degrade boolean, foreign_provenance boolean, degraded array<struct<local_id: string, bytes: long>>"


def test_a_sweep_retracts_in_its_own_resource_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    of = lambda n, r, items: rows(spark, n, items).withColumn("resource_id", F.lit(r))
    ledger_stream.refresh(store, 1, of(1, "r", [("k1", "h"), ("k2", "h")]).union(of(1, "q", [("q1", "h")])), complete=True)
    ledger_stream.refresh(store, 2, of(2, "r", [("k1", "h")]), complete=True)
    assert [r.local_id for r in store.table("retraction").collect()] == ["k2"]


def test_the_gate_decides_what_a_crawl_retracts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    of = lambda n, r, items: rows(spark, n, items).withColumn("resource_id", F.lit(r))
    first = [of(1, r, [(f"{r}{i}", "h") for i in range(3)]) for r in ("good", "part", "empty", "vant")]
    sweeps = lambda derivation, provider: spark.createDataFrame([("a", r, None, True, derivation, "f1", provider if r == "vant" else "p", False, None) for r in ("good", "part", "empty", "vant")], SWEEPS)
    pages = lambda undrained, degraded: spark.createDataFrame([("a", r, 1, "fetched", "exact", True, "more" if r == undrained else None, False, False, degraded if r == "good" else []) for r in ("good", "part", "empty", "vant")], PAGES)
    ledger_stream.refresh(store, 1, first[0].union(first[1]).union(first[2]).union(first[3]), True, sweeps("v1", "p"), pages("", []))
    again = of(2, "good", [("good0", "h")]).union(of(2, "part", [("part0", "h")])).union(of(2, "vant", [("vant0", "h")]))
    ledger_stream.refresh(store, 2, again, True, sweeps("v2", "other"), pages("part", [("good1", 9)]))
    assert [(r.local_id, r.reason) for r in store.table("retraction").collect()] == [("good2", "derivation_changed")]
    assert {(r.resource_id, r.kind) for r in store.table("discrepancy").collect()} == {("empty", "empty_sweep"), ("vant", "vantage_changed")}
    assert {r.resource_id: r.disqualified_reason for r in store.table("crawl").filter("crawl_id = 2").collect()}["part"] == "did not drain to next: null"


def test_nothing_shows_before_the_manifest_and_commits_repeat_safely(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    df = rows(spark, 1, [("k1", "h")])
    real = store._write
    monkeypatch.setattr(store, "_write", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        store.commit(1, {"observation": df})
    assert store.table("observation").count() == 0
    monkeypatch.setattr(store, "_write", real)
    store.commit(1, {"observation": df})
    store.commit(1, {"observation": df})
    assert store.table("observation").count() == 1


def test_one_writer_at_a_time(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with store.writer(), pytest.raises(StoreBusy), Store(spark, store.root).writer():
        pass
    with store.writer():
        pass


def test_other_versions_are_refused(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store._write(f"{store.root}/manifest/000000000001.json", json.dumps({"version": 99, "crawl_id": 1, "folders": {}}), True)
    with pytest.raises(ValueError, match="version 99"):
        store.table("observation")


def test_stream_equals_batches(spark, tmp_path):
    for n, items in enumerate(CRAWLS, 1):
        rows(spark, n, items).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    store = Store(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ledger_stream.start(stream, store, f"{tmp_path}/checkpoint", complete=True).awaitTermination()
    assert {r.local_id for r in ledger_stream.live(store).collect()} == {"k1", "k2"}
    assert fold.highest_revisions(store.table("observation")).count() == 3


def test_a_stream_without_reads_or_word_of_completeness_retracts_nothing(spark, tmp_path):
    for n, items in enumerate(CRAWLS, 1):
        rows(spark, n, items).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    store = Store(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ledger_stream.start(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    assert store.table("retraction").count() == 0
    assert {r.local_id for r in ledger_stream.live(store).collect()} == {"k1", "k2", "k3"}


ADAPTER = r'''
import json, sys
mode = sys.argv[1]
pages = {"r1": ["c1", None], "r2": [None]}
at = {}
for line in sys.stdin:
    q = json.loads(line)
    if q["op"] == "hello": ok = {"protocol": "1" if mode != "old" else "0"}
    elif q["op"] == "resources.list": ok = {"resources": [{"resource_id": r} for r in pages]}
    else:
        r = q["params"]["resources"][0]["resource_id"]; n = at.get(r, 0); at[r] = n + 1
        if mode == "garbage" and r == "r1" and n == 1: print("{not json", flush=True); continue
        if mode == "die" and r == "r1" and n == 1: sys.stdout.write('{"id":'); sys.stdout.flush(); sys.exit(1)
        ok = {"observations": [], "statuses": [{"resource_id": r, "page": {"next": pages[r][n]}}]}
    print(json.dumps({"id": q["id"] + (mode == "ids" and q["op"] == "history.read"), "ok": ok}), flush=True)
'''


@pytest.mark.parametrize(("mode", "pages", "violations"), [("good", 3, set()), ("garbage", 2, {"not_json"}), ("die", 2, {"closed_mid_frame"}), ("ids", 0, {"unknown_id"})])
def test_adapter_source(spark, tmp_path, mode, pages, violations):
    script = tmp_path / "adapter.py"
    script.write_text(ADAPTER)
    adapter.register(spark)
    found = spark.read.format("ledger").option("argv", json.dumps([sys.executable, str(script), mode])).load().collect()
    assert len([r for r in found if r.frame]) == pages
    assert {r.violation for r in found if r.violation} == violations


def test_resume_points():
    start, done = {"cursor": "a"}, {"cursor": "b"}
    assert adapter.resume_point("exact", start, done) == done
    assert adapter.resume_point("batch_restart", start, done) == start and adapter.resume_point("none", None, done) is None


def test_frames(spark, tmp_path):
    (tmp_path / "f.jsonl").write_bytes(b'{"a":1}\n{"a":1,"a":2}\nx\r\n"' + b"y" * 1_048_577 + b'"\n')
    got = [r.violation for r in frames.read_frames(spark, str(tmp_path / "f.jsonl")).collect()]
    assert got == [None, "not_json", "not_json", "frame_too_large"]


def test_strict_money_and_envelopes(spark):
    def errors(f, cases):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
        got = dict(df.select("i", f(F.col("c"))).collect())
        return [got[i] for i in range(len(cases))]

    assert errors(frames.money_error, ['{"asset":"usd","amount":"1.50"}', '{"asset":"usd","amount":1.5}', '{"asset":"usd"}', '{"asset":"usd","amount":"-0"}', '["usd","1"]']) == [None, "not_a_string", "not_a_money_object", "SignOnZero", "not_a_money_object"]
    assert errors(frames.envelope_error, ['{"id":1,"ok":{}}', '{"id":1,"ok":{},"err":{}}', '{"id":"1","ok":{}}', "[]", "{"]) == [None, "bad_envelope", "bad_id", "bad_envelope", "not_json"]
    assert errors(frames.balance_amount_error, ['{"amount":null}', '{"x":1}', '{"amount":{"asset":"u","amount":"1"}}']) == [None, "amount_absent", None]
