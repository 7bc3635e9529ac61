"""Runs and micro-batches against the tables all their fires give at once, and what they read for it."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from helpers import DAY, fire, fires
from pyspark.sql import functions as F

from talktally.config import Metric, MetricsConfig, Operator, TenantConfig
from talktally.operators.emit import emit_all
from talktally.operators.gold import rollup
from talktally.operators.headers import header_state, merge_headers
from talktally.operators.increments import digests, folded, increments, totals
from talktally.operators.index import index_entries
from talktally.operators.results import apply_hook
from talktally.plans import counters, jobs, serve, silver
from talktally.sources import access, archive, enrichment, lake, locator
from talktally.sources import fires as stored
from talktally.streaming import live

CFG = MetricsConfig(
    (
        Operator("test", "T", (Metric("boolean", "ok", "ok", "OK", surface=True), Metric("number", "n", "n", "N"))),
        Operator("once", "O", (Metric("enum", "why", "why", "Why", surface=True),), once_per_conversation=True),
    )
)


def some_fires(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        payload = {"ok": r.random() < 0.5, "n": r.randint(0, 9), "why": r.choice(["a", "b", None])}
        meta = {"agentId": r.choice(["x", "y", None]), "customerKey": f"k{r.randint(0, 3)}", "channel": r.choice([{"type": "voice"}, "chat"])}
        at = DAY + timedelta(hours=7 * r.randint(0, 20), seconds=r.randint(0, 2))
        rows.append(fire(payload, r.choice(["test", "once", "free"]), f"c{r.randint(0, 6)}", r.choice("tu"), at=at, uri=f"u{k:03d}", metadata=meta))
    return rows


def tables(spark, root):
    heads = lake.scan(spark, f"{root}/conversations", "conversations").drop("enrichment", "created_at")
    results = lake.scan(spark, f"{root}/operator_results", "operator_results").drop("enriched_at")
    index = index_entries(lake.scan(spark, f"{root}/index", "index"))
    gold = lake.scan(spark, f"{root}/metrics", "metrics")
    return [sorted(map(str, df.collect())) for df in (heads, results, index, gold)]


def write(spark, rows, root, run=None):
    jobs.write_all(apply_hook(fires(spark, *rows)), root, CFG, run=run)


@pytest.fixture(scope="module")
def at_once(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("one"))
    write(spark, some_fires(), root)
    return tables(spark, root)


def test_runs_in_any_order_with_redelivery(spark, tmp_path, at_once):
    rows = some_fires()
    random.Random(4).shuffle(rows)
    for part in (rows[40:], rows[:25], rows[20:45]):
        write(spark, part, str(tmp_path))
    assert tables(spark, str(tmp_path)) == at_once


def test_a_corrected_run_takes_its_fires_back(spark, tmp_path, at_once):
    rows, root = some_fires(), str(tmp_path)
    wrong = [fire({"ok": True, "n": 5}, "once", "c9", "v", at=DAY - timedelta(days=3), uri="w1"), fire({"ok": True}, "test", "c1", "t", at=DAY, uri="w2")]
    write(spark, rows[:30], root, "a")
    write(spark, rows[25:50] + wrong, root, "b")
    write(spark, rows[30:], root, "b")
    assert not lake.files_below(spark, f"{root}/fires/tenant_id=v/date=*/batch_id=b")
    assert tables(spark, root) == at_once
    # What run a delivered too stays when b is replaced without it.
    write(spark, rows[:30], root, "c")
    write(spark, rows[:1], root, "a")
    assert tables(spark, root) == at_once


def test_every_call_without_a_name_is_a_run(spark, tmp_path):
    one, two = fire({"ok": True}), fire({"ok": False}, "free", uri="u2")
    for rows in ([one], [two]):
        jobs.write_silver(apply_hook(fires(spark, *rows)), str(tmp_path), CFG)
    assert stored.read_fires(spark, f"{tmp_path}/fires").count() == 2
    assert lake.scan(spark, f"{tmp_path}/conversations", "conversations").first().operator_count == 2
    with pytest.raises(ValueError):
        jobs.write_silver(apply_hook(fires(spark, one)), str(tmp_path), CFG, run="a/b")


def test_header_states_merge_in_any_grouping(spark):
    rows = some_fires(2, 40)
    whole = header_state(fires(spark, *rows))
    parts = [header_state(fires(spark, *rows[a:b])) for a, b in ((0, 5), (5, 22), (22, 40))]
    for order in ((0, 1, 2), (2, 0, 1)):
        merged = merge_headers(merge_headers(parts[order[0]], parts[order[1]]), parts[order[2]])
        shown = lambda df: sorted(map(str, lake.curated_conversations(df).collect()))
        assert shown(merged) == shown(whole)


def test_an_earlier_fire_that_arrives_later_counts_instead(spark, tmp_path):
    late = fire({"why": "a"}, "once", at=DAY, uri="u1")
    early = fire({"why": "b"}, "once", at=DAY - timedelta(hours=1), uri="u2")
    silent = fire({}, "once", at=DAY - timedelta(hours=2), uri="u3")
    for rows, name in (([late], "why_a"), ([early], "why_b"), ([silent], None)):
        write(spark, rows, str(tmp_path))
        found = lake.scan(spark, f"{tmp_path}/metrics", "metrics").where("metric_name LIKE 'why%'").collect()
        assert {r.metric_name for r in found if not r.metric_name.endswith("total") and r.value} == ({name} if name else set())
        entries = lake.scan(spark, f"{tmp_path}/index", "index").where("field_name = 'why'").collect()
        assert [r.field_value for r in entries] == ([name[-1]] if name else [])


def test_increments_fold_to_the_same_totals(spark):
    rows = some_fires(3, 50)
    parts = [fires(spark, *rows[a : a + 10]) for a in range(0, 50, 10)]
    made = [increments(p, CFG, stored.digest_of(p.withColumns({"date": F.date_format("received_at", "yyyyMMdd"), "digest": stored.content_digest()}))) for p in parts]
    key = lambda df: sorted(map(str, df.collect()))
    want = key(rollup(emit_all(fires(spark, *rows), CFG)).select("tenant_id", "date", "metric_name", "value"))
    both = folded(made[3].unionByName(made[1])).unionByName(folded(made[0].unionByName(made[4]))).unionByName(made[2])
    assert key(totals(both)) == want
    assert digests(both).agg(F.sum("fires")).first()[0] == 50


def plan_of(df):
    conf, name = df.sparkSession.conf, "spark.sql.maxMetadataStringLength"
    conf.set(name, "10000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset(name)


def scanned_partitions(df):
    """Partition filters of each scan of a plan."""
    return [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan_of(df).splitlines() if "PartitionFilters: [" in line]


def test_only_partitions_of_the_run_are_opened(spark, tmp_path):
    root = str(tmp_path)
    write(spark, [fire({"ok": True, "n": k}, conversation=f"c{k}", at=DAY + timedelta(days=40 * k), uri=f"u{k}") for k in range(6)], root)
    days = spark.createDataFrame([("t", "20260127")], "tenant_id string, date string")
    read = stored.read_fires(spark, f"{root}/fires", days)
    assert any("date" in p and "20260127" in p for p in scanned_partitions(read))
    assert read.select("conversation_id").collect() == [("c0",)]
    named = spark.createDataFrame([("t", "c2")], "tenant_id string, conversation_id string")
    heads = silver._stored_heads(spark, root, named)
    assert heads.count() == 1 and any(all(x in p for x in ("day", "17", "month", "04")) for p in scanned_partitions(heads))
    places = locator.find(spark, f"{root}/conversation_days", named)
    assert [r.day for r in places.collect()] == ["20260417"] and any("share" in p for p in scanned_partitions(places))
    locator.fold(spark, f"{root}/conversation_days")
    assert locator.find(spark, f"{root}/conversation_days", named).count() == 1
    known = stored.day_digests(spark, f"{root}/fires", days.collect())
    assert known.first().fires == 1
    scans = [line for line in plan_of(known).splitlines() if "FileScan parquet" in line and "/fires" in line]
    assert scans and all("metadata:" not in s.split("ReadSchema")[1] and "data:" not in s.split("ReadSchema")[1] for s in scans)


def test_copies_are_found_without_shuffling_payloads(spark, tmp_path):
    rows = [fire({"ok": True}, conversation=f"c{k}") for k in range(3)]
    for run in ("a", "b"):
        stored.store_fires(apply_hook(fires(spark, *rows)), f"{tmp_path}/f", run)
    read = stored.read_fires(spark, f"{tmp_path}/f")
    assert read.count() == 3
    assert "Exchange hashpartitioning" not in plan_of(read) and "BroadcastHashJoin" in plan_of(read)
    twice = [fire({"ok": True}), fire({"ok": True})]  # one document that holds the same result twice
    stored.store_fires(apply_hook(fires(spark, *twice)), f"{tmp_path}/g", "a")
    stored.store_fires(apply_hook(fires(spark, twice[0])), f"{tmp_path}/g", "b")
    assert stored.read_fires(spark, f"{tmp_path}/g").count() == 2


def test_many_copies_are_not_broadcast(spark, tmp_path):
    """Addresses of copies compress to almost nothing on disk, and take 200 bytes each in a broadcast."""
    n, path = F.col("id"), f"{tmp_path}/f"
    ids = {"conversation_id": F.concat(F.lit("c"), n % 1000), "source_uri": F.concat(F.lit("u"), n), "received_at": F.lit(DAY) + F.make_dt_interval(secs=n % 997)}
    rows = apply_hook(spark.range(60_000).crossJoin(fires(spark, fire({"ok": True}))).withColumns(ids).drop("id"))
    stored.store_fires(rows, path, "a")
    stored.store_fires(rows, path, "b")
    stored.store_fires(rows.unionByName(apply_hook(fires(spark, fire({"ok": False}, uri="new")))), path, "c")
    every, fresh = stored.read_fires(spark, path), stored.fresh_fires(spark, path, "c")
    assert "Broadcast" not in plan_of(every) and "Broadcast" not in plan_of(fresh)
    assert [r.source_uri for r in fresh.collect()] == ["new"]
    assert every.count() == every.select("source_uri").distinct().count() == 60_001
    none = stored.fresh_fires(spark, path, "b")
    assert none.isEmpty() and "/fires" not in plan_of(none) and "Join" not in plan_of(none)


def stream_batches(spark, root, batches, **options):
    for n, rows in enumerate(batches):
        live.apply_fires(apply_hook(fires(spark, *rows)), root, str(n), CFG, **options)


def test_digests_of_a_run_are_those_stored(spark, tmp_path):
    """Keys and digests of the fresh fires come without their payloads, and count as the digests of the day."""
    root, rows = str(tmp_path), [fire({"ok": True}, conversation=f"c{k}", uri=f"u{k}") for k in range(4)]
    silver.store_run(apply_hook(fires(spark, *rows[:2])), root, "0")
    run = silver.store_run(apply_hook(fires(spark, *rows)), root, "1")
    assert run.keys.count() == 2 and not run.empty
    scans = [line for line in plan_of(run.keys).splitlines() if "FileScan parquet" in line and "digest" in line]
    assert scans and all("metadata:" not in s.split("ReadSchema")[1] and "data:" not in s.split("ReadSchema")[1] for s in scans)
    counters.add(spark, root, run, "1", CFG)
    counted = digests(counters.read(spark, root, run.days)).first()
    fresh = stored.digest_of(run.fresh.withColumns({"date": F.date_format("received_at", "yyyyMMdd"), "digest": stored.content_digest()})).first()
    assert (counted.fires, counted.digest) == (2, fresh.digest)


def test_a_micro_batch_is_read_by_all_cores(spark, tmp_path, monkeypatch):
    """One file a micro-batch would be parsed by one core."""
    from checks import stored_queries

    batches = []
    monkeypatch.setattr(stored_queries.live, "apply_fires", lambda rows, *_, **__: batches.append((rows.rdd.getNumPartitions(), rows.count())))
    stamp = (F.lit(DAY) + F.make_dt_interval(secs=F.col("id"))).alias("ts")
    events = spark.range(400).select(F.col("id").alias("event_id"), stamp, F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props"))
    stored_queries._stream(spark, "", str(tmp_path), events.withColumn("file", F.when(F.col("event_id") < 150, 1).otherwise(2)), "file")
    assert batches == [(spark.sparkContext.defaultParallelism, n) for n in (150, 250)]


def test_increments_of_many_batches_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counters, "FOLD_AT", 3)
    root, n = str(tmp_path), 7
    batches = [[fire({"ok": k % 2 == 0, "n": k}, ("test", "once")[k % 2], f"c{k % 3}", at=DAY + timedelta(seconds=100 - k), uri=f"u{k}")] for k in range(n)]
    most = 0
    def count(k):
        counters.add(spark, root, silver.store_run(apply_hook(fires(spark, *batches[k])), root, str(k)), k, CFG)

    for k in range(n):
        count(k)
        most = max(most, len(lake.files_below(spark, f"{root}/increments/tenant_id=t/date=*/batch_id=*")))
    assert most <= 5
    whole = rollup(emit_all(fires(spark, *[r for b in batches for r in b]), CFG))
    got = lake.scan(spark, f"{root}/metrics", "metrics").where("metric_name NOT LIKE '%avg' AND metric_name NOT LIKE '%percent'")
    key = lambda df: sorted((r.metric_name, r.value) for r in df.collect())
    assert key(got) == key(whole)
    # The last micro-batch again, as after a failure.
    count(n - 1)
    assert key(lake.scan(spark, f"{root}/metrics", "metrics").where("metric_name NOT LIKE '%avg' AND metric_name NOT LIKE '%percent'")) == key(whole)


def test_late_fires_are_counted_and_their_days_made_anew(spark, tmp_path):
    root = str(tmp_path)
    old, new = fire({"ok": True, "n": 1}, at=DAY - timedelta(days=9), uri="a"), fire({"ok": True, "n": 2}, at=DAY, uri="b")
    late = [fire({"ok": False, "n": 4}, conversation=f"c{k}", at=DAY - timedelta(days=9, hours=1), uri=f"l{k}") for k in (1, 2)]
    stream_batches(spark, root, [[old, new], late], close_after=timedelta(days=7))
    assert [(r.tenant_id, r.date, r.rows, r.batch_id) for r in counters.late_rows(spark, root).collect()] == [("t", "20260118", 2, "1")]
    got = {(r.date, r.metric_name): r.value for r in lake.scan(spark, f"{root}/metrics", "metrics").collect()}
    assert (got["20260118", "n_sum"], got["20260118", "conversation_count"], got["20260127", "n_sum"]) == (9.0, 2.0, 2.0)
    days = spark.createDataFrame([("t", "20260118"), ("t", "20260127")], "tenant_id string, date string")
    assert counters.differing_days(spark, root, days.collect()) == []
    stored.store_fires(apply_hook(fires(spark, fire({"ok": True, "n": 1}, conversation="c7", at=DAY, uri="x"))), f"{root}/fires", "lost")
    assert [r.date for r in counters.differing_days(spark, root, days.collect())] == ["20260127"]
    live.reconcile(spark, root, days, CFG)
    got = {(r.date, r.metric_name): r.value for r in lake.scan(spark, f"{root}/metrics", "metrics").collect()}
    assert got["20260127", "n_sum"] == 3.0 and counters.differing_days(spark, root, days.collect()) == []


def test_replay_of_a_range_beside_the_live_stream(spark, tmp_path):
    source, root, tenants = tmp_path / "in", str(tmp_path / "out"), TenantConfig({}, "v2")
    for day in range(1, 6):
        folder = source / f"t/test/v1/2026-01-0{day}"
        folder.mkdir(parents=True)
        body = {"conversationId": f"c{day}", "operatorName": "test", "schemaVersion": "v1", "data": {"ok": True}, "_meta": {"tenantId": "t", "receivedAt": f"2026-01-0{day}T00:00:00Z"}}
        (folder / f"c{day}-2026010{day}000000.json").write_text(json.dumps(body))
    some = archive.stream_documents(spark, str(source), since="2026-01-01", until="2026-01-02")
    live.start_silver(some, live.silver_batch(CFG, tenants, root), f"{root}/live").awaitTermination()
    again = archive.stream_documents(spark, str(source), since="2026-01-02", until="2026-01-04")
    live.start_silver(again, live.silver_batch(CFG, tenants, root, name="replay"), f"{root}/replay").awaitTermination()
    got = lake.scan(spark, f"{root}/metrics", "metrics").where("metric_name = 'conversation_count'").collect()
    assert sorted((r.date, r.value) for r in got) == [(f"2026010{d}", 1.0) for d in (1, 2, 3, 4)]
    assert lake.scan(spark, f"{root}/conversations", "conversations").count() == 4


def test_pages_by_agent_open_the_newest_periods_only(spark, tmp_path):
    root = str(tmp_path)
    rows = [fire({}, "free", f"c{k:02d}", at=DAY + timedelta(days=20 * k), uri=f"u{k}", metadata={"agentId": "a" if k % 2 else "b", "queueId": "q"}) for k in range(12)]
    write(spark, rows, root)
    page = serve.newest_conversations(spark, root, CFG, "t", {"agentId": "a"}, limit=2)
    assert [r.conversation_id for r in page.collect()] == ["c11", "c09"]
    near = access.newest(spark, root, "t", "agent_id", "a", 2)
    opened = {r[0] for r in near.select(F.date_format("started_at", "yyyyMM")).collect()}
    assert near.count() >= 2 and len(opened) <= 4 and any("period" in p for p in scanned_partitions(near))
    token, walked = None, []
    while True:
        found = serve.newest_conversations(spark, root, CFG, "t", {"agentId": "a", "queueId": "q"}, limit=5, after=token).collect()
        walked += [r.conversation_id for r in found]
        if len(found) < 5:
            break
        token = found[-1].page_token
    assert walked == [f"c{k:02d}" for k in range(11, 0, -2)]
    # Another agent took a conversation over: it is listed there only.
    write(spark, [fire({}, "free", "c11", at=DAY + timedelta(days=221), uri="v", metadata={"agentId": "b"})], root)
    listed = lambda agent: [r.conversation_id for r in serve.newest_conversations(spark, root, CFG, "t", {"agentId": agent}, limit=2).collect()]
    assert listed("a") == ["c09", "c07"] and listed("b") == ["c11", "c10"]
    assert serve.newest_conversations(spark, root, CFG, "t", {"agentId": "nobody"}).count() == 0
    assert serve.newest_conversations(spark, root, CFG, "t", {}, datetime(2026, 3, 1), date(2026, 4, 1)).count() == 2


def test_all_pages_at_once_are_those_of_the_walk(spark, tmp_path):
    root = str(tmp_path)
    heads = spark.range(23).select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("c"), "id").alias("conversation_id"), F.lit("a").alias("agent_id"),
        F.when(F.col("id") != 7, "q").alias("queue_id"), (F.lit(DAY) + F.make_dt_interval(days=F.col("id") % 6 * 40)).alias("started_at"),
    )
    other = heads.withColumn("tenant_id", F.lit("u"))
    silver.write_headers(spark, root, lake.curated_conversations(heads.unionByName(other)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many parts of the order
    try:
        got = serve.every_page(spark, root, "t", {"agentId": "a", "queueId": "q"}, limit=5).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    walked, token = [], None
    while True:
        page = serve.newest_conversations(spark, root, CFG, "t", {"agentId": "a", "queueId": "q"}, limit=5, after=token).collect()
        walked.append([(r.conversation_id, r.page_token) for r in page])
        if len(page) < 5:
            break
        token = page[-1].page_token
    assert [(r.position, r.page, r.conversation_id, r.page_token) for r in got] == [
        (5 * n + k, n + 1, *row) for n, page in enumerate(walked) for k, row in enumerate(page, 1)
    ]
    assert len(got) == 22
    inside = serve.every_page(spark, root, "t", {"agentId": "a"}, DAY + timedelta(days=40), (DAY + timedelta(days=80)).date())
    assert inside.count() == 8 and serve.every_page(spark, root, "t", {"agentId": "nobody"}).count() == 0


def test_results_of_one_second_keep_the_latest_whatever_comes_first(spark, tmp_path):
    later, sooner = (fire({"n": k}, at=DAY + timedelta(microseconds=k), uri=f"u{k}") for k in (900, 100))
    for rows in ([later], [sooner]):
        write(spark, rows, str(tmp_path))
    assert [r.s3_uri for r in lake.scan(spark, f"{tmp_path}/operator_results", "operator_results").collect()] == ["u900"]


def test_counts_of_every_output(spark, tmp_path):
    written = jobs.write_silver(apply_hook(fires(spark, fire({"ok": True}), fire({"ok": True}, "free", uri="u2"))), str(tmp_path), CFG, run="a")
    assert written.get["rows"] == 2
    assert {r.output: r.rows for r in silver.run_counts(spark, str(tmp_path)).collect()} == {"conversations": 1, "results": 2, "index": 1}


def test_expired_entries_leave_the_index_and_the_lists(spark, tmp_path):
    root = str(tmp_path)
    write(spark, [fire({"ok": True}, conversation="c1"), fire({"ok": True}, conversation="c2", at=DAY + timedelta(days=100), uri="u2")], root)
    index, heads = lake.scan(spark, f"{root}/index", "index"), lake.scan(spark, f"{root}/conversations", "conversations")
    tables = serve.Tables(lake.stored_headers(heads), index=index)

    def found(after):
        as_of = F.lit(DAY + timedelta(days=after)).cast("timestamp")
        return sorted(r.conversation_id for r in serve.conversations(tables, CFG, "t", {"ok": "true"}, as_of=as_of).collect())

    assert (found(179), found(181), found(281)) == (["c1", "c2"], ["c2"], [])
    as_of = F.lit(DAY + timedelta(days=200)).cast("timestamp")
    assert lake.drop_expired(spark, f"{root}/index", "index", lake.INDEX_PARTITIONS, as_of) == 1
    assert [r.conversation_id for r in lake.scan(spark, f"{root}/index", "index").collect()] == ["c2"]
    assert lake.drop_expired(spark, f"{root}/index", "index", lake.INDEX_PARTITIONS, as_of) == 0


def test_a_repeated_archive_run_replaces_its_lines(spark, tmp_path):
    rows = fires(spark, fire({"ok": True}), fire({"ok": False}, conversation="c2", at=DAY + timedelta(days=1)))
    for _ in range(2):
        archive.append_archive(rows, str(tmp_path / "a"), run="r1")
    archive.append_archive(rows.where("conversation_id = 'c2'"), str(tmp_path / "a"))
    assert archive.read_lines(spark, str(tmp_path / "a")).count() == 3
    assert archive.read_lines(spark, str(tmp_path / "a"), since="2026-01-28").count() == 2


def test_enrichment_runs_in_any_order_keep_the_newest(spark, tmp_path):
    def records(*rows):
        df = spark.createDataFrame(list(rows), "tenant_id string, correlation_type string, correlation_key string, received_at timestamp, source_uri string")
        return df.withColumn("expires_at", F.col("received_at") + F.expr("INTERVAL 90 DAYS"))

    path, new, old = str(tmp_path / "e"), ("t", "CALL", "k", DAY, "b"), ("t", "CALL", "k", DAY - timedelta(days=1), "z")
    for rows in ([new], [old, ("t", "CONV", "k", DAY - timedelta(days=200), "c")], [new]):
        enrichment.store_enrichment(records(*rows), path)
    at = lambda days: F.lit(DAY + timedelta(days=days)).cast("timestamp")
    shown = lambda days: sorted((r.correlation_type, r.source_uri) for r in enrichment.stored_enrichment(spark, path, "t", at(days)).collect())
    assert (shown(-150), shown(80), shown(91)) == ([("CALL", "b"), ("CONV", "c")], [("CALL", "b")], [])
