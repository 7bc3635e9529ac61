"""Documents to fires, headers, results, enrichment, index, registries, views."""

import json
from datetime import datetime, timedelta

import pytest
from helpers import DAY, as_dict, documents, fire, fires
from pyspark.sql import functions as F

from talktally.config import MetricsConfig, Metric, Operator, TenantConfig
from talktally.functions import phones, values
from talktally.functions import variants as V
from talktally.operators import normalize as N
from talktally.operators.conformance import conformance
from talktally.operators.headers import headers, merge_headers, with_enrichment
from talktally.operators.index import build_index, by_index, operator_index, pick_filter
from talktally.operators.results import apply_hook, latest_results, operator_results, unwrapped
from talktally.operators.skew import lookup_join
from talktally.plans import serve, views
from talktally.sources.archive import integrity_audit
from talktally.sources.enrichment import latest_enrichment, parse_enrichment, read_enrichment_csv
from talktally.sources.registry import lookup, read_registry_tree, upsert, with_overrides

TENANTS = TenantConfig({"three": "v3"}, "v2")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rule_document(results, conversation="conv1"):
    return {
        "accountId": "AC1",
        "conversationId": conversation,
        "intelligenceConfiguration": {"id": "cfg", "displayName": "C", "version": 1, "ruleId": "rule"},
        "operatorResults": results,
    }


def rule_result(fmt="JSON", result=None, trigger="COMMUNICATION", refs=("XX1", "CH2")):
    return {
        "id": "r1",
        "operator": {"id": "op1", "displayName": "Lookup", "version": 1, "parameters": None},
        "outputFormat": fmt,
        "result": {"a": 1} if result is None else result,
        "dateCreated": "2026-04-16T10:11:12.123456789Z",
        "referenceIds": list(refs),
        "executionDetails": {
            "trigger": {"on": trigger},
            "channels": ["WHATSAPP"],
            "participants": [{"id": "p", "profileId": "agent", "type": "HUMAN_AGENT"}, {"id": "q", "profileId": "mem1", "type": "CUSTOMER"}],
        },
        "metadata": {"system": {"model": "m"}},
    }


def v3(spark, *docs):
    return N.normalize_v3(N.split_shapes(documents(spark, *docs, tenant="three"), TENANTS)["v3"])


def test_rule_document(spark):
    row = v3(spark, rule_document([rule_result()])).withColumn("m", F.to_json("metadata")).withColumn("d", F.to_json("data")).first()
    meta = json.loads(row.m)
    assert (row.operator_name, row.schema_version, row.trigger, row.ci_version) == ("Lookup", "v1", "COMMUNICATION", "v3")
    assert (meta["customerKey"], meta["channel"], meta["conversationSid"], meta["ruleId"]) == ("mem1", "whatsapp", "CH2", "rule")
    assert meta["executionMetadata"] == {"model": "m"} and json.loads(row.d) == {"a": 1}
    assert row.result_at == datetime(2026, 4, 16, 10, 11, 12, 123456)


@pytest.mark.parametrize(
    ("fmt", "result", "data"),
    [
        ("TEXT", "hi", {"text": "hi"}), ("TEXT", 5, {"text": "5"}), ("CLASSIFICATION", {"label": "x"}, {"label": "x"}),
        ("JSON", 5, {"value": 5}), ("JSON", [1], [1]),
    ],
)
def test_result_wrapping(spark, fmt, result, data):
    row = v3(spark, rule_document([rule_result(fmt, result)])).select(F.to_json("data").alias("d")).first()
    assert json.loads(row.d) == data


def test_rule_document_number_of_results_and_unknown_trigger(spark):
    rows = v3(spark, rule_document([]), rule_document([rule_result(), rule_result(trigger="ODD", refs=())], "conv2")).collect()
    assert [r.conversation_id for r in rows] == ["conv2", "conv2"]
    assert sorted(r.trigger or "" for r in rows) == ["", "COMMUNICATION"]


def test_shapes_and_rejects(spark):
    note = {"transcript_sid": "GT1", "event_type": "voice_intelligence_transcript_available"}
    direct = {"conversationId": "c", "operatorName": "o"}
    docs = documents(spark, note, rule_document([]), direct, {"x": 1}, {**note, **rule_document([])})
    shaped = N.with_version(N.with_tenant(docs, "three"), TENANTS)
    assert as_dict(shaped, "source_uri", "shape") == {"doc0": "v2", "doc1": "v3", "doc2": "direct", "doc3": "v3", "doc4": "v2"}
    assert as_dict(shaped, "source_uri", "rejected")["doc3"] == "payload does not match v3"
    other = N.with_version(N.with_tenant(docs, "two"), TENANTS)
    assert as_dict(other, "source_uri", "shape") == {"doc0": "v2", "doc1": "v3", "doc2": "direct", "doc3": "v2", "doc4": "v3"}


def test_tenant_from_header_then_document_then_default(spark):
    docs = documents(spark, {"_meta": {"tenantId": "own"}}, {"tenantId": "top"}, {})
    assert [r.tenant_id for r in N.with_tenant(docs, "dflt").orderBy("source_uri").collect()] == ["own", "top", "dflt"]
    assert {r.tenant_id for r in N.with_tenant(docs.withColumn("tenant_header", F.lit("h"))).collect()} == {"h"}


def test_unwrap_by_type_and_fallback(spark):
    def flat(kind, data):
        text = one(spark, F.to_json(V.unwrap(F.lit(kind), F.parse_json(F.lit(json.dumps(data))))))
        return json.loads(text)

    assert flat("json", {"name": "N", "json_results": {"score": 85, "category": "billing"}}) == {
        "score": 85, "category": "billing", "_operator_type": "json", "_operator_name": "N",
    }
    assert flat("extract", {"name": "N", "extract_results": [1, 2]})["results"] == [1, 2]
    assert flat("text-generation", {"text_generation_results": "t"}) == {"results": "t", "_operator_type": "text-generation"}
    assert flat(None, {"operator_sid": "s", "operator_type": "x", "name": "N", "a": 1}) == {"a": 1, "_operator_type": "x", "_operator_name": "N"}
    assert flat("json", {"a": 1, "json_results": {}}) == {"_operator_type": "json"}
    assert flat("json", {"a": 1, "json_results": None, "name": "N"}) == {"a": 1, "json_results": None, "_operator_type": "json", "_operator_name": "N"}


def test_display_fields(spark):
    payload = {"s": "x", "n": 1, "b": False, "five": list("abcde"), "six": list("abcdef"), "mixed": ["a", 1], "none": None, "o": {}, "e": [], "_h": 1}
    shown = one(spark, V.display_fields(F.parse_json(F.lit(json.dumps(payload)))))
    assert set(json.loads(shown)) == {"s", "n", "b", "five", "e"}


@pytest.mark.parametrize(
    ("phone", "normal", "last4", "mask"),
    [
        ("+5511976932682", "+5511976932682", "2682", "+5511*****2682"),
        ("sip:+553122980059@54.82.188.43", "+553122980059", "0059", "+5531****0059"),
        ("TEL:123", "123", None, "123"),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_phones(spark, phone, normal, last4, mask):
    c = F.lit(phone).cast("string")
    row = spark.range(1).select(phones.normalize_phone(c), phones.phone_last4(c), phones.mask_phone(c)).first()
    assert tuple(row) == (normal, last4, mask)


def test_small_values(spark):
    assert one(spark, values.normalise(F.lit("A \tB  Ç"))) == "a_b_ç"
    assert one(spark, values.round2(F.lit(1.005))) == 1.0
    assert one(spark, values.iso_day(F.lit("20260127"))) == "2026-01-27T00:00:00Z"
    assert one(spark, values.word_count(F.lit("  a b\n c "))) == 3 and one(spark, values.word_count(F.lit("  "))) == 0
    assert one(spark, values.title_case(F.lit("renda_fixa_-_érico"))) == "Renda Fixa - Érico"


def test_header_is_one_row_with_latest_attributes(spark):
    voice = {
        "type": "voice",
        "media_properties": {"source": "Leg", "source_sid": "RE1", "reference_sids": {"call_sid": "CA1"}},
        "participants": [{"role": "Agent", "media_participant_id": "x"}, {"role": "Customer", "media_participant_id": "+5511976932682"}],
    }
    rows = fires(
        spark,
        fire({}, metadata={"channel": "chat", "agentId": "a1", "customerKey": "k", "conversationSid": "CH9"}, uri="1"),
        fire({}, metadata={"channel": voice, "agentId": "", "customerKey": "k"}, at=DAY + timedelta(seconds=3), uri="2"),
    )
    head = headers(rows).first()
    assert (head.operator_count, head.agent_id, head.customer_key, head.channel_type, head.call_sid) == (2, None, "k", "voice", "CA1")
    assert (head.customer_phone, head.customer_phone_last4, head.source_type) == ("+5511*****2682", "2682", "Leg")
    assert (head.started_at, head.updated_at) == (DAY, DAY + timedelta(seconds=3))
    first = headers(rows.where("source_uri = '1'"))
    assert first.first().conversation_sid == "CH9"
    merged = merge_headers(first, headers(rows.where("source_uri = '2'"))).first()
    assert (merged.operator_count, merged.call_sid, merged.started_at) == (2, "CA1", DAY)


def test_latest_result_per_second(spark):
    rows = fires(spark, fire({"n": 1}, uri="a"), fire({"n": 2}, uri="b"), fire({"n": 3}, at=DAY + timedelta(seconds=1)))
    got = latest_results(rows).select(F.try_variant_get("data", "$.n", "int").alias("n")).collect()
    assert sorted(r.n for r in got) == [2, 3]


def test_hook_failure_keeps_the_row(spark):
    def hook(context):
        return {"doubled": context["payload"]["n"] * 2}

    rows = operator_results(apply_hook(fires(spark, fire({"n": 2}), fire({"m": 1}, conversation="c2")), hook))
    got = {r.conversation_id: r for r in rows.collect()}
    assert json.loads(got["c1"].enriched_payload) == {"doubled": 4} and got["c1"].enrichment_error is None
    assert json.loads(got["c2"].enriched_payload) == {"m": 1} and got["c2"].enrichment_error == "'n'" and got["c2"].enriched_at is None


def posts(spark, *bodies):
    rows = [("t", json.dumps(b) if not isinstance(b, str) else b, DAY + timedelta(seconds=i), str(i)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "tenant_id string, body string, received_at timestamp, source_uri string")
    return df.withColumn("body", F.try_parse_json("body"))


def test_enrichment_validation_and_latest(spark):
    good, bad = parse_enrichment(
        posts(
            spark, {"callSid": " CA1 ", "conversationSid": "CH1", "fields": {"v": 1}}, {"callSid": "CA1", "fields": {"w": 2}, "source": "x"},
            {"fields": {}}, {"callSid": "CA2", "fields": [1]}, {"callSid": "CA2"}, "{oops",
        )
    )
    assert {r.reason for r in bad.collect()} == {"no callSid or conversationSid", "fields is not an object", "not JSON"}
    row = latest_enrichment(good).withColumn("f", F.to_json("fields")).first()
    assert (row.correlation_type, row.correlation_key, json.loads(row.f), row.source) == ("CALL", "CA1", {"w": 2}, "x")
    assert row.expires_at == row.received_at + timedelta(days=90)


def test_enrichment_key_choice_and_hot_join(spark):
    heads = spark.createDataFrame(
        [("t", f"c{i}", "CA1" if i < 40 else None, "CH1" if i % 2 else None) for i in range(60)],
        "tenant_id string, conversation_id string, call_sid string, conversation_sid string",
    )
    good, _ = parse_enrichment(posts(spark, {"callSid": "CA1", "fields": {"v": "call"}}, {"conversationSid": "CH1", "fields": {"v": "conv"}}))
    for hot_rows in (None, 5):
        got = with_enrichment(heads, good, hot_rows=hot_rows)
        kinds = [r.v for r in got.select(F.try_variant_get("enrichment", "$.v", "string").alias("v")).collect()]
        assert (kinds.count("call"), kinds.count("conv"), kinds.count(None)) == (40, 10, 10)


def test_lookup_join_equals_plain_join(spark):
    left = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").withColumn("k", F.when(F.col("k") == 3, F.lit(None)).otherwise(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("k"))))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        plain = sorted(map(str, left.join(right, "k", how).select("k", "id", "v").collect()))
        for hot_rows in (None, 100):
            assert sorted(map(str, lookup_join(left, right, ["k"], how, hot_rows, 4).select("k", "id", "v").collect())) == plain


INDEXED = MetricsConfig(
    (
        Operator(
            "test", "T",
            (
                Metric("enum", "status", "st", "S", values=("ACTIVE",), surface=True),
                Metric("integer", "score", "sc", "S", maximum=5, surface=True),
                Metric("category", "internal", "i", "I"),
                Metric("category_array", "topics", "tp", "T", category_field="primary", sub_field="sub", sub_prefix="sp", surface=True),
            ),
        ),
    )
)


def test_index_rows(spark):
    payload = {
        "status": "ACTIVE", "score": 8, "internal": "x",
        "topics": [{"primary": "Renda Fixa", "sub": "A B"}, {"primary": "renda fixa"}, {"primary": "X", "sub": ""}],
    }
    rows = operator_index(fires(spark, fire(payload), fire({"status": None}, conversation="c2")), INDEXED)
    got = sorted((r.field_name, r.field_value, r.conversation_id) for r in rows.collect())
    assert got == [
        ("primary", "renda_fixa", "c1"), ("primary", "x", "c1"), ("score", "8", "c1"), ("status", "active", "c1"), ("sub", "renda_fixa__a_b", "c1"),
    ]


def test_index_of_headers_and_expiry(spark):
    heads = headers(fires(spark, fire({}, metadata={"conversationSid": "CH1"})))
    heads = heads.withColumn("enrichment", F.parse_json(F.lit('{"interaction_id": "AbC", "empty": "", "crm": 7, "other": "x"}')))
    rows = build_index(fires(spark, fire({})), heads, INDEXED, ("interaction_id", "crm", "empty"))
    got = {(r.field_name, r.field_value): r.expires_at for r in rows.collect()}
    assert set(got) == {("interaction_id", "abc"), ("crm", "7")}
    assert set(got.values()) == {DAY + timedelta(days=180)}


def test_index_filter_finds_conversation_whatever_the_second(spark):
    found = fires(spark, fire({"status": "ACTIVE"}), fire({}, conversation="c2"))
    hits = by_index(headers(found), operator_index(found, INDEXED), "status", "Active").collect()
    assert [r.conversation_id for r in hits] == ["c1"]


def test_filter_choice():
    assert pick_filter({"primary": "A", "sub": "B", "status": "x"}, INDEXED) == ("sub", "A__B")
    assert pick_filter({"sub": "B", "score": "4", "status": "x"}, INDEXED) == ("status", "x")
    assert pick_filter({"customer_phone_last4": "1"}, INDEXED) == ("customer_phone_last4", "1")
    assert pick_filter({"crm": "1"}, INDEXED, ["crm"]) == ("crm", "1")
    assert pick_filter({"agentId": "1"}, INDEXED) is None


def test_paging_visits_every_row_once(spark):
    start = datetime(2026, 1, 1)
    rows = [("t", f"c{i:02}", start + timedelta(hours=i // 3)) for i in range(25)]
    tables = serve.Tables(spark.createDataFrame(rows, "tenant_id string, conversation_id string, started_at timestamp"))
    seen, token = [], None
    while True:
        got = serve.conversations(tables, INDEXED, "t", limit=4, after=token).collect()
        if not got:
            break
        seen += [r.conversation_id for r in got]
        token = got[-1].page_token
    assert seen == sorted((r[1] for r in rows), reverse=True)
    assert serve.page_limit("x") == 50 and serve.page_limit(900) == 500 and serve.page_limit(None) == 50
    assert serve.read_token("garbage") is None


def test_surface_fields_last_result_wins(spark):
    found = fires(
        spark, fire({"status": "A", "score": 1}, uri="1"), fire({"status": None}, at=DAY + timedelta(seconds=2), uri="2"),
        fire({"status": "Z"}, operator="unknown", at=DAY + timedelta(seconds=9)),
    )
    rows = serve.with_surface_fields(headers(found), found, INDEXED)
    row = rows.select(F.to_json("status").alias("status"), F.to_json("score").alias("score")).first()
    assert (row.status, row.score) == ("null", "1")


def test_detail_keeps_results_as_rows(spark):
    found = fires(spark, fire({}, operator="a"), fire({}, operator="b"), fire({}, conversation="c2"))
    heads = headers(found).unionByName(headers(fires(spark, fire({}, conversation="c9"))))
    rows = serve.conversation_detail(heads, operator_results(apply_hook(found)), "t", ["c1", "c9"]).collect()
    assert sorted((r.conversation_id, r.operator_name) for r in rows if r.operator_name) == [("c1", "a"), ("c1", "b")]
    assert [r.conversation_id for r in rows if not r.operator_name] == ["c9"]


def test_conformance(spark):
    schema = {
        "type": "object", "required": ["overall", "score"],
        "properties": {
            "overall": {"type": "string", "enum": ["positive", "negative"]}, "score": {"type": "number", "minimum": -1, "maximum": 1},
            "phrases": {"type": "array", "items": {"type": "string"}},
            "by": {"type": "object", "additionalProperties": {"type": "object", "required": ["s"], "properties": {"s": {"type": ["string", "null"]}}}},
        },
    }
    bad = {"overall": 5, "score": 2, "phrases": ["a", 1], "by": {"agent": {"s": None}, "customer": {}}}
    rows = fires(spark, fire(bad), fire({"overall": "positive", "score": 0.5}, conversation="c2"), fire({}, conversation="c3"), fire(bad, operator="free"))
    got = {(r.conversation_id, r.operator_name): r for r in conformance(rows, {("test", "v1"): schema}).collect()}
    assert sorted(got["c1", "test"].errors) == [
        "/by/customer must have required property 's'", "/overall must be equal to one of the allowed values", "/overall must be string",
        "/phrases/1 must be string", "/score must be <= 1",
    ]
    assert got["c2", "test"].valid and got["c1", "free"].valid
    assert got["c3", "test"].errors == [" must have required property 'overall'", " must have required property 'score'"]


def test_registry(spark, tmp_path):
    for name, text in (("intent/v1", "{}"), ("intent/v2", '{"n": 2}')):
        file = tmp_path / f"{name}.schema.json"
        file.parent.mkdir(exist_ok=True)
        file.write_text(text)
    defaults = read_registry_tree(spark, str(tmp_path))
    assert sorted((r.operator_name, r.schema_version) for r in defaults.collect()) == [("intent", "v1"), ("intent", "v2")]
    own = spark.createDataFrame([("t", "intent", "v1", "mine"), ("t", "", "v1", "refused")], "tenant_id string, operator_name string, schema_version string, definition string")
    table = upsert(defaults, own.withColumn("status", F.lit("active")).withColumn("created_at", F.current_timestamp()))
    assert as_dict(with_overrides(table, "t"), "schema_version", "definition") == {"v1": "mine", "v2": '{"n": 2}'}
    assert lookup(table, "t", "intent", "v1").first().definition == "mine"
    assert lookup(table, "other", "intent", "v1").first().definition == "{}"
    assert lookup(table, "t", "none", "v1").count() == 0


def test_view_formats(spark):
    view = {"operatorName": "test", "schemaVersion": "v1", "table": {"columns": [
        {"field": "s", "label": "S", "format": "+0.00"}, {"field": "c", "label": "C", "format": "0%"}, {"field": "b", "label": "B"},
    ]}}
    row = views.table_rows(fires(spark, fire({"s": -0.5, "c": 0.876, "b": True})), view).first()
    assert (row.S, row.C, row.B) == ("-0.50", "88%", "true")


def test_csv_enrichment(spark, tmp_path):
    (tmp_path / "r.csv").write_text("call,status,who\nCA1,ok,me\n,bad,you\n")
    good, bad = parse_enrichment(read_enrichment_csv(spark, str(tmp_path / "r.csv"), "t", "call", "qa"))
    row = good.withColumn("f", F.to_json("fields")).first()
    assert (row.correlation_key, json.loads(row.f), row.source) == ("CA1", {"status": "ok", "who": "me"}, "qa") and bad.count() == 1


def test_integrity(spark):
    rows = spark.createDataFrame([("a", "CA978112CA1BBDCAFAC231B39A23DC4DA786EFF8147C4E72B9807785AFEE48BB"), ("b", None)], "body_text string, declared_hash string")
    assert as_dict(integrity_audit(rows), "body_text", "intact") == {"a": True, "b": False}


def test_unwrapped_fires(spark):
    rows = unwrapped(fires(spark, fire({"name": "N", "x": 1})))
    assert json.loads(rows.select(F.to_json("data").alias("d")).first().d) == {"x": 1, "_operator_name": "N"}
