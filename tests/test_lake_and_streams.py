"""Stored tables, recompute, archive and streaming."""

import json
from datetime import date, datetime, timedelta

import pytest
from helpers import DAY, as_dict, fire, fires, gold
from pyspark.sql import functions as F

from talktally import session
from talktally.config import MetricsConfig, Metric, Operator, TenantConfig
from talktally.operators.gates import with_day
from talktally.operators.gold import rollup
from talktally.operators.emit import emit_all
from talktally.operators.headers import headers
from talktally.operators.results import apply_hook, operator_results
from talktally.plans import jobs
from talktally.sources import archive, lake
from talktally.streaming import live

CFG = MetricsConfig(
    (
        Operator("test", "T", (Metric("boolean", "ok", "ok", "OK", surface=True), Metric("number", "n", "n", "N"))),
        Operator("once", "O", (Metric("boolean", "ok", "first_ok", "OK"),), once_per_conversation=True),
    )
)
TENANTS = TenantConfig({}, "v2")


def stored(spark, path):
    rows = lake.scan(spark, path, "metrics")
    return sorted((r.tenant_id, r.date, r.metric_name, r.value) for r in rows.collect())


def test_overwrite_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "m")
    lake.write_metrics(gold(spark, ("20260127", "a", 1), ("20260228", "a", 2)).unionByName(gold(spark, ("20260127", "a", 5)).withColumn("tenant_id", F.lit("u"))), path)
    lake.write_metrics(gold(spark, ("20260127", "a", 9)), path)
    assert stored(spark, path) == [("t", "20260127", "a", 9), ("t", "20260228", "a", 2), ("u", "20260127", "a", 5)]


def test_replacing_a_day_keeps_the_month(spark, tmp_path):
    path = str(tmp_path / "m")
    day = gold(spark, ("20260127", "a", 1), ("20260127", "gone", 1))
    lake.replace_days(day, day, path)
    lake.replace_days(gold(spark, ("20260128", "a", 2)), gold(spark, ("20260128", "", 0)), path)
    lake.replace_days(gold(spark, ("20260127", "a", 7)), gold(spark, ("20260127", "", 0)), path)
    assert stored(spark, path) == [("t", "20260127", "a", 7), ("t", "20260128", "a", 2)]


def test_recompute_twice_changes_nothing_and_dry_run_shows_it(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = fires(spark, fire({"ok": True, "n": 0.1}), fire({"ok": False, "n": 0.2}, conversation="c2"), fire({"ok": True}, at=DAY + timedelta(days=1)))
    days = jobs.touched_days(rows)
    plan = jobs.recompute(rows, days, CFG, path, dry_run=True)
    assert {r.change for r in plan.collect()} == {"added"}
    jobs.recompute(rows, days, CFG, path)
    first = stored(spark, path)
    assert ("t", "20260127", "ok_rate_percent", 50.0) in first and ("t", "20260127", "n_sum", 0.3) in first
    jobs.recompute(rows, days, CFG, path)
    assert stored(spark, path) == first
    assert jobs.recompute(rows, days, CFG, path, dry_run=True).count() == 0
    more = rows.unionByName(fires(spark, fire({"ok": True}, conversation="c3")))
    changed = as_dict(jobs.recompute(more, days.where("date = '20260127'"), CFG, path, dry_run=True), "metric_name", "change")
    assert changed["ok_total"] == "changed" and "n_sum" not in changed


def test_silver_tables_and_backfill(spark, tmp_path):
    root = str(tmp_path)
    rows = fires(
        spark, fire({"ok": True, "text": "x"}, metadata={"customerKey": "k", "channel": {"type": "voice"}}),
        fire({"ok": False}, at=DAY + timedelta(days=4), conversation="c2"), fire({"ok": True}, tenant="u"),
    )
    written = jobs.write_silver(apply_hook(rows), root, CFG)
    assert written.get["rows"] == 3
    heads = lake.scan(spark, f"{root}/conversations", "conversations")
    assert [f.name for f in heads.schema] == [f.name for f in lake.CONVERSATIONS]
    assert as_dict(heads.where("tenant_id = 't'"), "conversation_id", "channel") == {"c1": '{"type":"voice"}', "c2": "unknown"}
    pruned = lake.scan_results(spark, f"{root}/operator_results", "t", date(2026, 1, 27), date(2026, 1, 28))
    assert [r.conversation_id for r in pruned.collect()] == ["c1"]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tenant_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    again = jobs.stored_fires(spark, f"{root}/operator_results", "t", operator="test")
    assert as_dict(again, "conversation_id", "source_uri") == {"c1": "u1", "c2": "u1"}
    jobs.backfill(spark, f"{root}/fires", f"{root}/metrics", CFG, "t", date(2026, 1, 1), date(2026, 1, 31))
    assert ("t", "20260131", "ok_total", 1.0) in stored(spark, f"{root}/metrics")
    assert not [r for r in stored(spark, f"{root}/metrics") if r[0] == "u"]
    counts = jobs.copy_metrics(spark, f"{root}/metrics", f"{root}/copy", ["t"])
    assert counts.first().migrated == len(stored(spark, f"{root}/copy"))


def test_runs_add_up(spark, tmp_path):
    root = str(tmp_path)
    one = fires(spark, fire({"ok": True}, conversation="c1"), fire({"ok": True}, conversation="c2", at=DAY + timedelta(hours=1)))
    two = fires(spark, fire({"ok": False}, conversation="c1", at=DAY - timedelta(days=1), uri="u2"), fire({"ok": True}, conversation="c3"))
    for rows, run in ((one, "a"), (two, "b"), (two, "b"), (two, "again")):
        jobs.write_silver(apply_hook(rows), root, CFG, run=run)
    heads = lake.scan(spark, f"{root}/conversations", "conversations").collect()
    assert sorted((r.conversation_id, r.operator_count, r.day) for r in heads) == [("c1", 2, "26"), ("c2", 1, "27"), ("c3", 1, "27")]
    results = lake.scan(spark, f"{root}/operator_results", "operator_results").collect()
    assert sorted((r.conversation_id, r.s3_uri) for r in results) == [("c1", "u1"), ("c1", "u2"), ("c2", "u1"), ("c3", "u1")]


def test_copied_metrics_keep_the_target(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    lake.write_metrics(gold(spark, ("20260127", "a", 1), ("20260127", "b", 2)), source)
    lake.write_metrics(gold(spark, ("20260127", "a", 9), ("20260128", "c", 3)), target)
    jobs.copy_metrics(spark, source, target)
    assert stored(spark, target) == [("t", "20260127", "a", 1.0), ("t", "20260127", "b", 2.0), ("t", "20260128", "c", 3.0)]


def test_an_emptied_day_goes(spark, tmp_path):
    path = str(tmp_path / "m")
    lake.write_metrics(gold(spark, ("20260127", "a", 1), ("20260301", "a", 2)), path)
    days = spark.createDataFrame([("t", "20260127")], "tenant_id string, date string")
    lake.replace_days(gold(spark, ("20260127", "a", 1)).limit(0), days, path)
    assert stored(spark, path) == [("t", "20260301", "a", 2.0)]


def test_backfill_keeps_the_trigger_gate(spark, tmp_path):
    cfg = MetricsConfig((Operator("test", "T", (Metric("boolean", "ok", "ok", "OK"),), triggers=("CONVERSATION_END",)),))
    rows = fires(spark, fire({"ok": True}, trigger="CONVERSATION_END"), fire({"ok": True}, trigger="COMMUNICATION", conversation="c2"))
    jobs.write_silver(apply_hook(rows), str(tmp_path), cfg)
    jobs.backfill(spark, f"{tmp_path}/fires", f"{tmp_path}/metrics", cfg, "t", date(2026, 1, 27), date(2026, 1, 27))
    assert ("t", "20260127", "ok_total", 1.0) in stored(spark, f"{tmp_path}/metrics")


def test_catalog_table(spark, tmp_path):
    path = str(tmp_path / "m")
    lake.write_metrics(gold(spark, ("20260127", "a", 1)), path)
    lake.register_table(spark, "registered_metrics", "metrics", path)
    try:
        lake.write_metrics(gold(spark, ("20260327", "b", 1)), path)
        lake.repair_table(spark, "registered_metrics")
        rows = spark.sql("SELECT metric_name FROM registered_metrics WHERE year = '2026' AND month IN ('01', '03')").collect()
        assert sorted(r.metric_name for r in rows) == ["a", "b"]
    finally:
        spark.sql("DROP TABLE registered_metrics")


def test_range_predicates():
    assert lake.months_between(date(2025, 11, 3), date(2026, 2, 1)) == [("2025", "11"), ("2025", "12"), ("2026", "01"), ("2026", "02")]


def write_document(root, name, body):
    file = root / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(body if isinstance(body, str) else json.dumps(body, indent=2))


def result_document(conversation, at, **data):
    return {
        "conversationId": conversation, "operatorName": "test", "schemaVersion": "v1", "data": data,
        "_meta": {"tenantId": "t", "receivedAt": at},
    }


def test_archive_read_replay_and_quarantine(spark, tmp_path):
    write_document(tmp_path, "t/my op/v1/2026-01-27/c1-20260127120000.json", result_document("c1", "2026-01-27T12:00:00Z", ok=True))
    write_document(tmp_path, "t/my op/v1/2026-01-28/c2-20260128120000.json", {"conversationId": "c2", "operatorName": "test"})
    write_document(tmp_path, "t/my op/v1/2026-01-28/c3-20260128120001.json", '{"broken": ')
    write_document(tmp_path, "t/my op/v1/2026-01-28/c4-20260128120002.json", "[1]")
    docs = archive.read_documents(spark, str(tmp_path))
    good, bad = archive.split_unreadable(docs)
    assert sorted(r.reason for r in bad.collect()) == ["not JSON", "not a JSON object"]
    found, rejected = jobs.fires_from_documents(good, TENANTS)
    times = as_dict(found, "conversation_id", "received_at")
    assert times == {"c1": datetime(2026, 1, 27, 12), "c2": datetime(2026, 1, 28, 12)} and rejected.count() == 0
    assert {r.tenant_id for r in found.collect()} == {"t"}
    assert archive.read_documents(spark, str(tmp_path), since="2026-01-28").count() == 3
    assert archive.read_documents(spark, str(tmp_path), until="2026-01-27").count() == 1
    picked = archive.documents_at(docs, found.where("conversation_id = 'c1'").select("source_uri"))
    assert picked.count() == 1


def test_append_and_read_lines(spark, tmp_path):
    rows = fires(spark, fire({"ok": True, "n": 2}, metadata={"agentId": "a"}))
    archive.append_archive(rows, str(tmp_path / "a"))
    back, _ = jobs.fires_from_documents(archive.read_lines(spark, str(tmp_path / "a")), TENANTS)
    row = back.withColumn("d", F.to_json("data")).first()
    assert (row.tenant_id, row.conversation_id, row.received_at, json.loads(row.d)) == ("t", "c1", DAY, {"ok": True, "n": 2})


def run_stream(spark, source, root):
    run = live.silver_batch(CFG, TENANTS, root)
    live.start_silver(archive.stream_documents(spark, source, 2), run, f"{root}/checkpoint").awaitTermination()


def test_stream_to_silver_and_gold(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    for i in range(5):
        write_document(source, f"t/test/v1/2026-01-27/c{i % 3}-2026012712000{i}.json", result_document(f"c{i % 3}", f"2026-01-27T12:00:0{i}Z", ok=i % 2 == 0, n=i / 10))
    write_document(source, "t/test/v1/2026-01-27/bad-20260127120009.json", "{nope")
    write_document(source, "t/test/v1/2026-01-27/odd-20260127120008.json", {"x": 1})
    run_stream(spark, str(source), root)
    batch, _ = jobs.fires_from_documents(archive.split_unreadable(archive.read_documents(spark, str(source)))[0], TENANTS)
    expected = sorted((r.tenant_id, r.date, r.metric_name, r.value) for r in jobs.gold_of(jobs.prepared(batch), CFG).collect())
    assert stored(spark, f"{root}/metrics") == expected
    reasons = {r.reason for r in spark.read.parquet(f"{root}/quarantine").collect()}
    assert reasons == {"not JSON", "payload does not match v2"}
    # A late document of an old day, and a redelivered one under a new file name.
    write_document(source, "t/test/v1/2025-01-01/c9-20250101000000.json", result_document("c9", "2025-01-01T00:00:00Z", ok=True))
    write_document(source, "t/test/v1/2026-01-27/again/c0-20260127120000.json", result_document("c0", "2026-01-27T12:00:00Z", ok=True, n=0.0))
    run_stream(spark, str(source), root)
    after = stored(spark, f"{root}/metrics")
    assert ("t", "20250101", "conversation_count", 1.0) in after
    assert [r for r in after if r[1] == "20260127"] == expected
    days = spark.createDataFrame([("t", "20260127")], "tenant_id string, date string")
    assert live.reconcile(spark, root, days, CFG, dry_run=True).count() == 0


def test_repeated_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    rows = fires(spark, fire({"ok": True}), fire({"ok": True}, operator="once"))
    for _ in range(2):
        live.store_fires(rows, f"{root}/fires", 0)
    assert live.read_fires(spark, f"{root}/fires").count() == 2
    assert spark.read.parquet(f"{root}/fires").count() == 2


def test_running_counts_equal_batch(spark, tmp_path):
    parts = [[fire({"ok": i % 2 == 0, "n": i}, operator=o, conversation=f"c{i % 4}", at=DAY + timedelta(hours=9 * i), uri=str(i))
              for o in ("test", "once", "free")] for i in range(12)]
    table, source = fires(spark, *[f for p in parts for f in p]).drop("metadata"), str(tmp_path / "in")
    ordered = table.where(F.col("operator_name") != "once").unionByName(table.where("operator_name = 'once'").dropDuplicates(["conversation_id"]))
    ordered.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    counts = live.running_counts(live.streamed_increments(stream, CFG))
    live.start_running_counts(counts, str(tmp_path / "c"), str(tmp_path / "k")).awaitTermination()
    got = live.read_running_counts(spark, str(tmp_path / "c"))
    expected = rollup(emit_all(ordered, CFG))
    key = lambda df: sorted((r.tenant_id, str(r.date), r.metric_name, r.value) for r in df.collect())
    assert key(got) == key(expected)


def test_stream_static_enrichment_and_observation(spark, tmp_path):
    rows = fires(spark, fire({}, metadata={"conversationSid": "CH1"}), fire({}, conversation="c2"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    records = spark.createDataFrame([("t", "CONV", "CH1", '{"a": 1}')], "tenant_id string, correlation_type string, correlation_key string, fields string")
    joined = live.enriched_stream(live.with_arrival_counts(stream), records.withColumn("fields", F.parse_json("fields")))
    query = (
        joined.select("conversation_id", F.to_json("enrichment").alias("e")).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "k")).option("path", str(tmp_path / "o")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert as_dict(spark.read.parquet(str(tmp_path / "o")), "conversation_id", "e") == {"c1": '{"a":1}', "c2": None}
    assert query.lastProgress["observedMetrics"]["arrivals"]["rows"] == 2


def test_checkpoint_folder_comes_from_the_session(spark):
    root = session.checkpoint_root(spark)
    assert session.scratch_path(spark, "x").startswith(root.rstrip("/"))
    assert session.cut_lineage(spark.range(3)).count() == 3


def test_results_scan_reads_only_needed_columns(spark, tmp_path):
    rows = operator_results(apply_hook(fires(spark, fire({"ok": True}))))
    lake.write_results(rows, str(tmp_path / "r"))
    plan = lake.scan_results(spark, str(tmp_path / "r"), "t").where("operator_name = 'test'").select("conversation_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "enriched_payload" not in text and "EqualTo(operator_name,test)" in text


def test_header_days(spark):
    assert with_day(fires(spark, fire({}))).first().date == "20260127"
    assert headers(fires(spark, fire({}))).first().operator_count == 1


@pytest.mark.parametrize("days", [0, 1, 3, 62, 90, 150])
def test_day_predicate_is_exact(spark, days):
    start = date(2026, 1, 30)
    rows = spark.range(300).select(F.date_add(F.lit(date(2025, 12, 1)), F.col("id").cast("int")).alias("d"))
    rows = lake.with_date_parts(rows, F.col("d"))
    end = start + timedelta(days=days)
    hit = {r.d for r in rows.where(lake.day_predicate(start, end)).collect()}
    assert {start + timedelta(days=i) for i in range(days + 1)} == hit
