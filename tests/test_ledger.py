import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.operators import balances, crawls, fold, pages, provider, reconcile, sweep
from assaybook.plans import queries, views

SF = "/root/testdata/sf0.001"
OBS = "adapter_id string, local_id string, resource_id string, surface string, arrival_index long, crawl_id long, received_at string, state string"


def obs(spark, rows):
    return fold.revisions(spark.createDataFrame(rows, OBS))


def none_retracted(spark):
    return spark.createDataFrame([], "adapter_id string, local_id string, revision long")


def test_head_is_not_the_last_arrival_and_tombstones_are_not_final(spark):
    rows = [("a", "k", "r", "s2", 1, 1, "2024-01-02", "active"), ("a", "k", "r", "s1", 2, 1, "2024-01-02", "tombstoned"), ("b", "k", "r", "s1", 1, 1, "2024-01-01", "tombstoned"), ("b", "k", "r", "s1", 2, 2, "2024-01-02", "active")]
    heads = {r.adapter_id: (r.revision, r.max_revision, r.state) for r in fold.heads(obs(spark, rows)).collect()}
    assert heads == {"a": (1, 2, "active"), "b": (2, 2, "active")}


def test_burial_and_revival(spark):
    rows = [("a", "k", "r", "s", 1, 1, "2024-01-02", "active"), ("a", "k", "r", "s", 2, 3, "2024-01-01", "active")]
    one = obs(spark, rows[:1])
    gone = spark.createDataFrame([("a", "k", 1)], "adapter_id string, local_id string, revision long")
    assert fold.live_set(one, gone).count() == 0
    # a backwards clock doesn't bury a revived record: liveness counts revisions, not times
    assert fold.live_set(obs(spark, rows), gone).count() == 1


def test_moved_record_lives_under_its_head_alone(spark):
    rows = [("a", "k", "r1", "s", 1, 1, "2024-01-01", "active"), ("a", "k", "r2", "s", 2, 2, "2024-01-02", "active")]
    assert fold.live_set(obs(spark, rows), none_retracted(spark), "r1").count() == 0
    assert fold.live_set(obs(spark, rows), none_retracted(spark), "r2").count() == 1


def test_retractions_at_once_equal_crawl_by_crawl(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        crawl = i // 80
        rows.append((f"a{rng.randrange(2)}", f"k{rng.randrange(25)}", "r", f"s{rng.randrange(3)}", i, crawl, f"2024-01-{crawl + 1:02d}", rng.choice(["active", "active", "tombstoned"])))
    got = {tuple(r) for r in fold.retractions_of_complete_sweeps(obs(spark, rows)).select("adapter_id", "local_id", "revision", "crawl_id").collect()}
    want, chains, water = set(), {}, {}
    for crawl in range(5):
        now = [r for r in rows if r[5] == crawl]
        seen = {r[:2] for r in now}
        for r in now:
            chains.setdefault(r[:2], []).append(r)
        if crawl:
            for key, chain in chains.items():
                head = max(chain, key=lambda r: (r[6], r[3], r[4]))
                if head[7] == "active" and len(chain) > water.get(key, 0) and key not in seen:
                    want.add((*key, len(chain), crawl))
                    water[key] = len(chain)
    assert got == want


GATE = "adapter_id string, resource_id string, crawl_id long, page_no long, outcome string, cursor string, has_page boolean, next string, anonymous_degrade boolean, foreign_provenance boolean"
GOOD = [("a", "r", 1, 1, "fetched", "exact", True, "c", False, False), ("a", "r", 1, 2, "fetched", "exact", True, None, False, False)]


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({7: "more"}, "did not drain to next: null"),
        ({6: False}, "did not drain to next: null"),
        ({4: "stale"}, "stale on page 2"),
        ({4: None}, "missing on page 2"),
        ({8: True}, "an anonymous degraded record"),
        ({8: None}, "an anonymous degraded record"),
        ({5: "none"}, "a page cursor was not exact-resumable"),
        ({5: None}, "a page cursor was not exact-resumable"),
        ({9: None}, "an observation's provenance named another adapter"),
    ],
)
def test_each_gate_condition(spark, change, reason):
    last = tuple(change.get(i, v) for i, v in enumerate(GOOD[1]))
    g = sweep.gate(spark.createDataFrame([GOOD[0], last], GATE))
    row = g.select(sweep.disqualifier(F.lit(None).cast("string"), F.lit(True), F.lit("v1")).alias("r")).first()
    assert row.r == reason


def test_gate_needs_a_start_and_a_derivation(spark):
    g = sweep.gate(spark.createDataFrame(GOOD, GATE))
    null = F.lit(None).cast("string")
    assert "begin" in g.select(sweep.disqualifier(null, F.lit(False), F.lit("v"))).first()[0]
    assert "derivation" in g.select(sweep.disqualifier(null, F.lit(True), F.lit(""))).first()[0]
    assert g.select(sweep.disqualifier(F.lit("bad frame"), F.lit(False), F.lit(""))).first()[0] == "bad frame"


def test_vantage_and_empty_sweeps(spark):
    one = spark.range(1)
    null = F.lit(None).cast("string")
    assert not one.select(sweep.vantage_exempt(null, F.lit("p"))).first()[0]
    assert one.select(sweep.vantage_exempt(F.lit("p"), F.lit("q"))).first()[0]
    assert one.select(sweep.empty_sweep(F.lit(0), F.lit(2), F.lit(False))).first()[0]
    assert not one.select(sweep.empty_sweep(F.lit(0), F.lit(2), F.lit(True))).first()[0]


INGEST_HEAD = "adapter_id string, local_id string, received_at string, surface string, arrival_index long, content_hash string, max_revision long, buried boolean"
INGEST_ROWS = "adapter_id string, local_id string, arrival_index long, content_hash string, received_at string, surface string"


def test_sequential_ingestion(spark):
    head = spark.createDataFrame([("a", "k", "t1", "s", 1, "h1", 3, False), ("a", "b", "t1", "s", 1, "h1", 2, True)], INGEST_HEAD)
    rows = spark.createDataFrame([("a", "k", 5, "h1", "t2", "s"), ("a", "k", 6, "h2", "t2", "s"), ("a", "k", 7, "h2", "t2", "s"), ("a", "b", 8, "h1", "t2", "s"), ("a", "b", 9, "h1", "t2", "s"), ("a", "n", 10, "h9", "t2", "s")], INGEST_ROWS)
    got = {r.arrival_index: (r.revision, r.appended) for r in sweep.ingest(head, rows).collect()}
    assert got == {5: (3, False), 6: (4, True), 7: (4, False), 8: (3, True), 9: (3, False), 10: (1, True)}


def test_single_row_ingestion_agrees(spark):
    head = spark.createDataFrame([("a", f"k{i}", "t1", "s", 1, f"h{i % 3}", i + 1, i % 4 == 0) for i in range(12)], INGEST_HEAD)
    rows = spark.createDataFrame([("a", f"k{i}", 100 + i, f"h{i % 2}", "t2", "s") for i in range(16)], INGEST_ROWS)
    key = lambda df: sorted((r.local_id, r.revision, r.appended) for r in df.collect())
    assert key(sweep.ingest(head, rows)) == key(sweep.ingest_single(head, rows))


BALANCE = "adapter_id string, resource_id string, category string, balance_id long, amount string, from_latest_read boolean, staleness string, as_of string"


@pytest.mark.parametrize(
    ("amount", "fresh", "stale", "earlier", "want"),
    [("5", True, "live", None, ("live", "5", None)), ("5", False, "live", None, ("stale", "5", "d2")), ("5", True, "cached", None, ("stale", "5", "d2")), (None, True, "live", "4", ("unknown", None, None)), (None, False, "live", "4", ("stale", "4", "d1")), (None, True, "unavailable", None, ("unavailable", None, None))],
)
def test_balance_verdicts(spark, amount, fresh, stale, earlier, want):
    df = spark.createDataFrame([("a", "r", "c", 1, earlier, False, "live", "d1"), ("a", "r", "c", 2, amount, fresh, stale, "d2")], BALANCE)
    r = balances.verdicts(df).first()
    assert (r.verdict, r.figure, r.as_of) == want


def test_unread_adapters_are_not_fresh(spark):
    b = spark.createDataFrame([("a", 1), ("b", 1)], "adapter_id string, read_id long")
    got = {r.adapter_id: r.from_latest_read for r in balances.with_freshness(b, b.filter("adapter_id = 'a'")).collect()}
    assert got == {"a": True, "b": False}


def test_missing_outcomes_are_unavailable(spark):
    df = spark.createDataFrame([(None,), ("gone",), ("stale",), ("rate_limited",)], "o string")
    assert [r[0] for r in df.select(balances.staleness(F.col("o"))).collect()] == ["unavailable", "unavailable", "cached", "live"]


def test_pages_never_exceed_their_budget(spark):
    rows = spark.createDataFrame([("x", i, n) for i, n in enumerate([50, 49, 1, 101, 100, 10])], "k string, i int, n long")
    got = {r.i: r.page for r in provider.cut_pages(rows, "k", "i", "n", 100).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: None, 4: 3, 5: 4}


def test_oversized_rows_are_named(spark):
    rows = spark.createDataFrame([("r", "a", "x" * 5), ("r", "b", "x" * 50)], "resource_id string, local_id string, body string")
    fits, dropped = pages.split_oversized(rows, F.octet_length("body"), 10)
    assert fits.count() == 1 and dropped.first().degraded[0].local_id == "b"


def test_coinbase_moves_nothing(spark):
    legs = spark.createDataFrame([("t", "in", None, 50), ("t", "out", "own", 20), ("t", "out", "else", 30)], "txid string, side string, address string, value long")
    r = provider.net_deltas(legs, spark.createDataFrame([("own",)], "address string")).first()
    assert (int(r.net_delta), r.wallet_spent) == (20, False)


def test_confirmed_copies_win(spark):
    txs = spark.createDataFrame([("t", False, 1, None), ("t", True, 2, 9), ("t", True, 3, 8), ("u", False, 4, None), ("u", False, 5, None)], "txid string, confirmed boolean, arrival long, height long")
    assert {(r.txid, r.arrival) for r in provider.distinct_transactions(txs).collect()} == {("t", 3), ("u", 4)}


def test_sequences_are_stronger_than_sets(spark):
    s = "k string, seq int, c string"
    a = spark.createDataFrame([("x", 0, "p"), ("x", 1, "q"), ("x", 2, "q")], s)
    b = spark.createDataFrame([("x", 0, "q"), ("x", 1, "p")], s)
    assert {(r.seq, r.verdict) for r in reconcile.sequence_diff(a, b, ["k"], "c").collect()} == {(0, "differs"), (1, "differs"), (2, "unexpected")}


def test_json_subset(spark):
    d = reconcile.json_subset_diff
    assert d({"amount": {"asset": "x", "amount": "1.50"}}, {"amount": {"asset": "x", "amount": "1.5"}}) == []
    assert d({"a": [1]}, {"a": [1, 2]}) and d({}, {"a": None}) and not d({"a": 1, "b": 2}, {"a": 1})
    df = spark.createDataFrame([('{"a":1}', '{"a":2}')], "x string, y string")
    assert len(df.select(reconcile.json_diff("x", "y")).first()[0]) == 1


def test_ingestion_of_all_events_equals_brute_force(spark):
    got = {(r.adapter_id, r.local_id, r.arrival_index): (r.revision, r.appended) for r in queries.q_ingest(spark, SF).collect()}
    rows = queries._hashed(spark, SF).collect()
    state, want = {}, {}
    for r in sorted(rows, key=lambda r: r.arrival_index):
        key, place = (r.adapter_id, r.local_id), (r.received_at, r.surface, r.arrival_index)
        top, head = state.get(key, (0, None))
        fresh = head is None or head[0] != r.content_hash
        if fresh:
            top += 1
            if head is None or place > head[1]:
                head = (r.content_hash, place)
        state[key] = (top, head)
        want[*key, r.arrival_index] = (top, fresh)
    assert got == want


def _kinds(t):
    yield t
    for f in t.fields if isinstance(t, T.StructType) else ():
        yield from _kinds(f.dataType)
    if isinstance(t, T.ArrayType):
        yield from _kinds(t.elementType)


def test_no_query_returns_floating_point(spark):
    for name, f in queries.QUERIES.items():
        assert not any(isinstance(k, T.DoubleType | T.FloatType) for k in _kinds(f(spark, SF).schema)), name


def test_one_exchange_serves_revision_and_head(spark):
    plan = fold.heads(fold.revisions(views.obs_events(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_balance_needs_one_status(spark):
    lines = spark.createDataFrame([(1, "r1"), (2, "r2")], "balance_id long, resource_id string")
    statuses = lambda *rows: spark.createDataFrame(rows, "resource_id string, outcome string")
    got = crawls.with_outcome(lines, statuses(("r1", "fetched"), ("r2", "stale"), ("r3", "gone"))).collect()
    assert {(r.balance_id, r.outcome) for r in got} == {(1, "fetched"), (2, "stale")}
    for bad in (statuses(("r1", "fetched")), statuses(("r1", "fetched"), ("r2", "stale"), ("r2", "stale"))):
        with pytest.raises(Exception, match="whose statuses number"):
            crawls.with_outcome(lines, bad).collect()


def test_crawls_resume_only_where_nothing_moved(spark):
    events = [("a", "r", 1, 1, "open", None, None), ("a", "r", 1, 2, "cursor", "p1", None), ("a", "r", 2, 3, "open", "p1", None), ("a", "r", 2, 4, "cursor", "p2", None), ("a", "r", 2, 5, "finish", None, False)]
    rows = spark.createDataFrame(events, "adapter_id string, resource_id string, crawl_id long, event_no long, kind string, page string, drained boolean")
    states = crawls.crawl_states(rows.withColumn("complete", F.lit(False)).withColumn("disqualified_reason", F.lit(None).cast("string")))
    assert {r.crawl_id: r.next_page for r in states.collect()} == {1: None, 2: "p2"}
    left = lambda d, f: states.withColumn("derivation", F.lit(d)).withColumn("fingerprint", F.lit(f).cast("string"))
    hello = spark.createDataFrame([("a", "r", "v1", "f1"), ("a", "q", "v1", "f1")], "adapter_id string, resource_id string, derivation string, fingerprint string")
    at = lambda d, f: {r.resource_id: (r.start_page, r.began_at_start) for r in crawls.resume_points(left(d, f), hello).collect()}
    assert at("v1", "f1") == {"r": ("p2", False), "q": (None, True)}
    assert at("v2", "f1")["r"] == at("v1", "f2")["r"] == at("v1", None)["r"] == (None, True)


def test_live_records_are_listed_by_id(spark):
    rows = spark.createDataFrame([("b", "k1"), ("a", "k2"), ("a", "k1")], "adapter_id string, local_id string")
    assert [tuple(r) for r in fold.listed(rows).collect()] == [("a", "k1"), ("b", "k1"), ("a", "k2")]


def test_a_reply_reserves_every_status_before_its_pages(spark):
    resources = spark.createDataFrame([(1, 0, "x", 40), (1, 1, "y", 40), (1, 2, "z", 40), (2, 0, "w", 500)], "reply long, place long, resource_id string, status_bytes long")
    rows = spark.createDataFrame([(1, "x", 1, 50), (1, "x", 2, 49), (1, "x", 3, 1), (1, "y", 1, 60), (2, "w", 1, 1)], "reply long, resource_id string, n long, size long")
    got = {r.resource_id: (r.page_budget, r.n_taken, r.bytes_taken) for r in crawls.reply_pages(rows, resources, "n", 260, 100).collect()}
    assert got == {"x": (100, 2, 100), "y": (40, 0, 0), "z": (40, 0, 0), "w": (0, 0, 0)}
