"""Normalising, unwrapping, headers, results, enrichment, index, conformance, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.base import query
from talktally.config import TenantConfig
from talktally.functions import keys, phones
from talktally.functions import variants as V
from talktally.operators import conformance as C
from talktally.operators import normalize
from talktally.operators.headers import headers, with_enrichment
from talktally.operators.index import ENRICHMENT_DAYS, INDEX_DAYS, header_index, operator_index, with_expiry
from talktally.operators.results import apply_hook, latest_results, operator_results
from talktally.operators.timing import as_struct, timing, typed_sentences
from talktally.sources.archive import integrity_audit
from talktally.sources.enrichment import latest_enrichment, parse_enrichment
from talktally.sources.registry import lookup, upsert, with_overrides

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(column: str):
    return F.date_format(column, MICROS).alias(column)


def stamp_sql(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


# --- raw documents -----------------------------------------------------------------------


def rule_documents(spark, sf_dir):
    """Webhooks of the rule form as JSON text, one per order with a result per line item.

    The result is an object, a text or a bare number by line number.
    """
    orders, lines = I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "lineitem")
    key, number = F.col("o_orderkey"), F.col("l_linenumber")
    rows = orders.join(lines, key == F.col("l_orderkey"), "left")
    form = I.choose(number, "JSON", "TEXT", "CLASSIFICATION")
    result = (
        F.when(form == "TEXT", F.col("l_shipmode_text").cast("variant"))
        .when(form == "JSON", F.to_variant_object(F.struct(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))))
        .otherwise(F.col("l_quantity").cast("variant"))
    )
    rows = rows.withColumn("l_shipmode_text", F.concat("l_returnflag", F.lit(" "), "l_linestatus"))
    participants = F.array(
        F.struct(F.lit("HUMAN_AGENT").alias("type"), F.lit("agent").alias("profileId")),
        F.struct(F.lit("CUSTOMER").alias("type"), F.when(F.col("o_custkey") % 4 != 0, I.text("u", F.col("o_custkey"))).alias("profileId")),
    )
    one = F.struct(
        I.text("r", key, "-", number).alias("id"),
        F.struct(I.text("op", F.col("l_suppkey") % 5).alias("displayName"), (F.col("l_partkey") % 3 + 1).alias("version")).alias("operator"),
        form.alias("outputFormat"),
        result.alias("result"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'000000Z'").alias("dateCreated"),
        F.array(I.text("XX", key), F.when(F.col("o_custkey") % 3 == 0, I.text("CH", F.col("o_custkey"))).otherwise("none")).alias("referenceIds"),
        F.struct(
            F.struct(I.choose(key, "COMMUNICATION", "CONVERSATION_END", "SOMETHING_ELSE").alias("on")).alias("trigger"),
            F.array(F.lit("WhatsApp"), F.lit("sms")).alias("channels"),
            participants.alias("participants"),
        ).alias("executionDetails"),
    )
    # At most seven lines per order, so the array is small by the data's own definition.
    results = rows.groupBy("o_orderkey", "o_orderdate").agg(
        F.collect_list(F.when(number.isNotNull(), F.to_json(one))).alias("results")
    )
    head = F.to_json(
        F.struct(
            F.lit("AC1").alias("accountId"),
            I.text("conv", F.col("o_orderkey")).alias("conversationId"),
            F.struct(F.lit("cfg").alias("id"), F.lit("rule7").alias("ruleId")).alias("intelligenceConfiguration"),
        )
    )
    text = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"operatorResults":['), F.array_join("results", ","), F.lit("]}"))
    return results.select(
        I.text("tenant", F.col("o_orderkey") % 2).alias("tenant_header"),
        V.parse(text).alias("body"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
        I.text("doc/", F.col("o_orderkey")).alias("source_uri"),
    )


TENANTS = TenantConfig({"tenant0": "v3"}, "v2")


@query(
    """SELECT 'tenant' || (o_orderkey % 2) AS tenant_id, 'conv' || o_orderkey AS conversation_id,
      'op' || (l_suppkey % 5) AS operator_name, 'v' || (l_partkey % 3 + 1) AS schema_version,
      strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS result_at, 'v3' AS ci_version,
      CASE o_orderkey % 3 WHEN 0 THEN 'COMMUNICATION' WHEN 1 THEN 'CONVERSATION_END' END AS trigger,
      CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag || ' ' || l_linestatus END AS data_text,
      CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS data_quantity,
      CASE WHEN l_linenumber % 3 = 2 THEN l_quantity END AS data_value,
      CASE WHEN o_custkey % 4 <> 0 THEN 'u' || o_custkey END AS customer_key, 'whatsapp' AS channel,
      CASE WHEN o_custkey % 3 = 0 THEN 'CH' || o_custkey END AS conversation_sid, 'rule7' AS rule_id
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
)
def normalize_rule_documents(spark, sf_dir):
    shapes = normalize.split_shapes(rule_documents(spark, sf_dir), TENANTS)
    fires = normalize.normalize_v3(shapes["v3"])
    data, meta = F.col("data"), F.col("metadata")
    return fires.select(
        "tenant_id", "conversation_id", "operator_name", "schema_version", stamp("result_at"), "ci_version", "trigger",
        V.text_at(data, "text").alias("data_text"),
        V.as_double(V.field(data, "quantity")).alias("data_quantity"),
        V.as_double(V.field(data, "value")).alias("data_value"),
        V.text_at(meta, "customerKey").alias("customer_key"),
        V.text_at(meta, "channel").alias("channel"),
        V.text_at(meta, "conversationSid").alias("conversation_sid"),
        V.text_at(meta, "ruleId").alias("rule_id"),
    )


def transcript_tables(spark, sf_dir):
    """Notifications, transcripts and operator results from the conversations table."""
    turns = I.table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    first = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    tenant = I.text("t", conv % 3).alias("tenant_id")
    sid = I.text("GT", conv).alias("transcript_sid")
    at = F.timestamp_seconds(F.lit(1704067200) + conv * 60)
    note = F.struct(
        sid,
        F.lit("voice_intelligence_transcript_available").alias("event_type"),
        F.when(conv % 4 != 0, I.text("cust", conv)).alias("customer_key"),
    )
    notifications = first.select(
        tenant, I.text("t", conv % 3).alias("tenant_header"), V.parse(F.to_json(note)).alias("body"),
        at.alias("received_at"), I.text("note/", conv).alias("source_uri"),
    )
    channel = F.to_variant_object(F.struct(F.lit("voice").alias("type")))
    transcripts = first.select(tenant, sid, channel.alias("channel"), at.alias("created_at"))
    result = F.struct(
        I.text("LY", F.col("turn")).alias("operatorSid"),
        I.choose(F.col("turn"), "json", "text-generation", "custom").alias("operatorType"),
        F.col("role").alias("name"),
        F.when(F.col("turn") % 3 == 0, F.struct(F.length("text").alias("chars"))).alias("jsonResults"),
        F.when(F.col("turn") % 3 == 1, F.col("text")).alias("textGenerationResults"),
        F.when(F.col("turn") % 3 == 2, F.lit("billing")).alias("predictedLabel"),
        F.when(F.col("turn") % 3 == 2, F.col("turn") / 8).alias("predictedProbability"),
        (F.col("turn") % 2 == 0).alias("extractMatch"),
    )
    results = turns.select(tenant, sid, V.parse(F.to_json(result)).alias("result"))
    return notifications, transcripts, results


def transcript_fires(spark, sf_dir):
    notifications, transcripts, results = transcript_tables(spark, sf_dir)
    times = as_struct(timing(typed_sentences(I.sentences(spark, sf_dir))))
    return normalize.normalize_v2(notifications, transcripts, results, times)


@query(
    f"""WITH {I.SENTENCES_SQL}
    SELECT t.tenant_id, CASE WHEN c.conv_id % 4 <> 0 THEN 'cust' || c.conv_id ELSE 'GT' || c.conv_id END AS conversation_id,
      role AS operator_name, CASE turn % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'text-generation' ELSE 'custom' END AS operator_type,
      'v1' AS schema_version, 'LY' || turn AS operator_sid,
      CASE WHEN turn % 3 = 0 THEN length(text)::DOUBLE END AS chars,
      CASE WHEN turn % 3 = 1 AND text <> '' THEN text END AS generated,
      CASE WHEN turn % 3 = 2 THEN 'billing' END AS prediction, CASE WHEN turn % 3 = 2 THEN turn / 8 END AS probability,
      turn % 2 = 0 AS extract_match, t.handling AS handling_sec, 'voice' AS channel_type
    FROM conversations c LEFT JOIN timings t ON t.conv_id = c.conv_id"""
)
def normalize_transcripts(spark, sf_dir):
    fires = transcript_fires(spark, sf_dir)
    data = F.col("data")
    return fires.select(
        "tenant_id", "conversation_id", "operator_name", "operator_type", "schema_version",
        V.text_at(data, "operator_sid").alias("operator_sid"),
        V.as_double(V.field(data, "json_results.chars")).alias("chars"),
        V.text_at(data, "text_generation_results").alias("generated"),
        V.text_at(data, "text_classification_results.prediction").alias("prediction"),
        V.as_double(V.field(data, "text_classification_results.predicted_probability")).alias("probability"),
        V.as_boolean(V.field(data, "extract_match")).alias("extract_match"),
        F.col("timing.handlingTimeSec").alias("handling_sec"),
        V.channel_type(V.field(F.col("metadata"), "channel")).alias("channel_type"),
    )


@query(
    """SELECT 't' || (conv_id % 3) AS tenant_id, 'GT' || conv_id AS transcript_sid, turn % 3 AS form, role AS name_kept,
      CASE turn % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'text-generation' ELSE 'custom' END AS type_kept,
      CASE WHEN turn % 3 = 0 THEN length(text)::DOUBLE END AS chars,
      CASE WHEN turn % 3 = 1 AND text <> '' THEN text END AS results,
      CASE WHEN turn % 3 = 2 THEN 'billing' END AS prediction,
      turn % 3 = 2 OR (turn % 3 = 1 AND text = '') AS has_extract_match, FALSE AS has_operator_sid
    FROM conversations"""
)
def unwrap_results(spark, sf_dir):
    fires = transcript_fires(spark, sf_dir)
    payload = V.unwrap(F.col("operator_type"), F.col("data"))
    flat = fires.select("tenant_id", "transcript_sid", "data", payload.alias("p"))
    p = F.col("p")
    sid = F.substring(V.text_at(F.col("data"), "operator_sid"), 3, 20).cast("bigint")
    return flat.select(
        "tenant_id", "transcript_sid", (sid % 3).alias("form"),
        V.text_at(p, "_operator_name").alias("name_kept"),
        V.text_at(p, "_operator_type").alias("type_kept"),
        V.as_double(V.field(p, "chars")).alias("chars"),
        V.text_at(p, "results").alias("results"),
        V.text_at(p, "text_classification_results.prediction").alias("prediction"),
        V.field(p, "extract_match").isNotNull().alias("has_extract_match"),
        V.field(p, "operator_sid").isNotNull().alias("has_operator_sid"),
    )


@query(
    """SELECT CASE WHEN doc_id % 4 = 3 THEN 'own' ELSE 'fallback' END AS tenant_id, doc_id::VARCHAR AS conversation_id,
      source AS operator_name, CASE WHEN doc_id % 2 = 0 THEN 'v7' ELSE 'v1' END AS schema_version,
      CASE WHEN doc_id % 3 = 0 THEN 'CONVERSATION_END' END AS trigger, text AS payload_text,
      '2024-02-03 04:05:06.123456' AS received_at
    FROM documents WHERE source <> ''"""
)
def normalize_direct_documents(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    doc = F.struct(
        F.col("doc_id").cast("string").alias("conversationId"),
        F.col("source").alias("operatorName"),
        F.when(F.col("doc_id") % 2 == 0, "v7").alias("schemaVersion"),
        I.choose(F.col("doc_id"), "CONVERSATION_END", "NO_SUCH", "").alias("trigger"),
        F.struct("text").alias("data"),
        F.struct(
            F.when(F.col("doc_id") % 4 == 3, "own").alias("tenantId"),
            F.lit("2024-02-03T04:05:06.123456789Z").alias("receivedAt"),
        ).alias("_meta"),
    )
    raw = docs.select(
        V.parse(F.to_json(doc)).alias("body"),
        F.lit("2020-01-01").cast("timestamp").alias("received_at"),
        F.col("doc_id").cast("string").alias("source_uri"),
    )
    fires = normalize.normalize_direct(normalize.with_tenant(raw, "fallback"))
    return fires.select(
        "tenant_id", "conversation_id", "operator_name", "schema_version", "trigger",
        V.text_at(F.col("data"), "text").alias("payload_text"), stamp("received_at"),
    )


@query(
    """WITH d AS (SELECT page_id % 4 AS form, page_id % 3 AS tenant FROM pages)
    SELECT 'tenant' || tenant AS tenant_id,
      CASE form WHEN 0 THEN 'direct' WHEN 1 THEN 'v3' WHEN 2 THEN 'v2' ELSE CASE WHEN tenant = 0 THEN 'v3' ELSE 'v2' END END AS shape,
      CASE WHEN form = 3 THEN CASE WHEN tenant = 0 THEN 'payload does not match v3' ELSE 'payload does not match v2' END END AS rejected,
      count(*) AS documents
    FROM d GROUP BY ALL"""
)
def adapter_choice(spark, sf_dir):
    """Declared versions, overridden by clear payload shapes; unknown shapes are rejected."""
    pages = I.table(spark, sf_dir, "pages")
    form = F.col("page_id") % 4
    direct = F.to_json(F.struct(F.col("url").alias("conversationId"), F.lit("page").alias("operatorName")))
    v2 = F.to_json(F.struct(F.col("url").alias("transcript_sid"), F.lit("voice_intelligence_transcript_available").alias("event_type")))
    v3 = F.to_json(F.struct(
        F.col("url").alias("conversationId"), F.lit("a").alias("accountId"), F.array().cast("array<string>").alias("operatorResults"),
        F.struct(F.lit("r").alias("ruleId")).alias("intelligenceConfiguration"),
    ))
    body = F.when(form == 0, direct).when(form == 1, v3).when(form == 2, v2).otherwise(F.to_json(F.struct("html")))
    raw = pages.select(
        I.text("tenant", F.col("page_id") % 3).alias("tenant_header"), V.parse(body).alias("body"),
        F.lit("2024-01-01").cast("timestamp").alias("received_at"), F.col("url").alias("source_uri"),
    )
    shaped = normalize.with_version(normalize.with_tenant(raw), TENANTS)
    return shaped.groupBy("tenant_id", "shape", "rejected").agg(F.count(F.lit(1)).alias("documents"))


# --- headers, results, enrichment --------------------------------------------------------


@query(
    f"""WITH {I.FIRES_SQL},
    a AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, conversation_id ORDER BY ts DESC, event_id DESC) AS rn,
            min(ts) OVER w AS first_ts, max(ts) OVER w AS last_ts, (count(*) OVER w)::INTEGER AS n
          FROM p WINDOW w AS (PARTITION BY tenant_id, conversation_id))
    SELECT tenant_id, conversation_id, 'u' || user_id AS customer_key, CASE WHEN k % 5 <> 0 THEN 'agent' || (k % 5) END AS agent_id,
      'queue' || (k % 3) AS queue_id, CASE WHEN user_id % 2 = 0 THEN 'voice' ELSE 'chat' END AS channel_type,
      CASE WHEN user_id % 2 = 0 THEN 'CA' || user_id END AS call_sid, CASE WHEN user_id % 2 = 0 THEN 'LegRecording' END AS source_type,
      {stamp_sql('first_ts', 'started_at')}, {stamp_sql('last_ts', 'updated_at')}, n AS operator_count
    FROM a WHERE rn = 1"""
)
def header_rollup(spark, sf_dir):
    rows = headers(I.fires(spark, sf_dir))
    return rows.select(
        "tenant_id", "conversation_id", "customer_key", "agent_id", "queue_id", "channel_type", "call_sid", "source_type",
        stamp("started_at"), stamp("updated_at"), "operator_count",
    )


def daily_results(spark, sf_dir):
    """Fires whose arrival is cut to the day, so the same result key comes up often."""
    return I.fires(spark, sf_dir).withColumn("received_at", F.date_trunc("DAY", "received_at"))


@query(
    f"""WITH {I.FIRES_SQL}, a AS (
      SELECT *, row_number() OVER (PARTITION BY tenant_id, conversation_id, operator_name, date ORDER BY event_id DESC) AS rn FROM p)
    SELECT tenant_id, conversation_id, operator_name, 'v1' AS schema_version, date,
      'e' || lpad(event_id::VARCHAR, 12, '0') AS s3_uri, k::DOUBLE AS score FROM a WHERE rn = 1"""
)
def operator_result_latest(spark, sf_dir):
    rows = latest_results(daily_results(spark, sf_dir))
    return rows.select(
        "tenant_id", "conversation_id", "operator_name", "schema_version", F.date_format("received_at", "yyyyMMdd").alias("date"),
        F.col("source_uri").alias("s3_uri"), V.as_double(V.field(F.col("data"), "score")).alias("score"),
    )


@query(
    f"""WITH {I.FIRES_SQL} SELECT 'e' || lpad(event_id::VARCHAR, 12, '0') AS s3_uri, 'Topic  ' || (k % 7) AS label, k AS score,
      reason, CASE WHEN event_id % 17 = 0 THEN 'true' WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS ai_retained,
      CASE WHEN k % 4 = 0 THEN 5 ELSE 4 END::INTEGER AS members, NULL::VARCHAR AS enrichment_error
    FROM p"""
)
def display_fields(spark, sf_dir):
    """Scalars stay, objects and arrays of objects go, an empty array stays."""
    rows = operator_results(apply_hook(I.fires(spark, sf_dir)))
    shown = F.col("display_fields")
    return rows.select(
        "s3_uri",
        F.get_json_object(shown, "$.label").alias("label"),
        F.get_json_object(shown, "$.score").cast("int").alias("score"),
        F.get_json_object(shown, "$.reason").alias("reason"),
        F.get_json_object(shown, "$.ai_retained").alias("ai_retained"),
        F.size(F.json_object_keys(shown)).alias("members"),
        "enrichment_error",
    )


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, operator_name, (k + 1)::DOUBLE AS next_score,
      CASE WHEN k % 5 = 0 THEN 'no reason given' END AS enrichment_error, count(*) AS fires
    FROM p WHERE k % 5 <> 0 GROUP BY ALL
    UNION ALL SELECT tenant_id, operator_name, NULL, 'no reason given', count(*) FROM p WHERE k % 5 = 0 GROUP BY ALL"""
)
def enrichment_hook(spark, sf_dir):
    """A Python hook that adds a member and fails for some payloads, which are kept."""

    def hook(context: dict) -> dict:
        payload = context["payload"]
        if payload["reason"] == "NONE":
            raise ValueError("no reason given")
        return {**payload, "next": payload["score"] + 1}

    rows = apply_hook(I.fires(spark, sf_dir), hook)
    score = V.as_double(V.field(F.col("data"), "next")).alias("next_score")
    return rows.groupBy("tenant_id", "operator_name", score, "enrichment_error").agg(F.count(F.lit(1)).alias("fires"))


@query(
    """WITH posts AS (
      SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'fields is not an object' END AS reason, 'CALL' AS kind,
             CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM customer
      UNION ALL SELECT n_nationkey, NULL, 'CONV', 3 FROM nation)
    SELECT coalesce(reason, 'accepted ' || kind) AS outcome, sum(n)::BIGINT AS posts FROM posts GROUP BY ALL"""
)
def enrichment_posts(spark, sf_dir):
    accepted, rejected = parse_enrichment(I.enrichment_posts(spark, sf_dir))
    outcomes = accepted.select(F.concat(F.lit("accepted "), "correlation_type").alias("outcome")).unionByName(
        rejected.select(F.col("reason").alias("outcome"))
    )
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("posts"))


@query(
    f"""WITH {I.ENRICHMENT_SQL} SELECT tenant_id, kind AS correlation_type, key AS correlation_key, nation, tier, balance,
      CASE WHEN kind = 'CALL' THEN 'crm' ELSE 'unknown' END AS source FROM e"""
)
def enrichment_latest(spark, sf_dir):
    rows = latest_enrichment(parse_enrichment(I.enrichment_posts(spark, sf_dir))[0])
    fields = F.col("fields")
    return rows.select(
        "tenant_id", "correlation_type", "correlation_key", V.text_at(fields, "nation").alias("nation"),
        V.text_at(fields, "tier").alias("tier"), V.as_double(V.field(fields, "balance")).alias("balance"), "source",
    )


def enriched_headers(spark, sf_dir, **options):
    records = latest_enrichment(parse_enrichment(I.enrichment_posts(spark, sf_dir))[0])
    return with_enrichment(I.headers(spark, sf_dir), records, **options)


ENRICHED_SQL = f"""WITH {I.HEADERS_SQL}, {I.ENRICHMENT_SQL}
    SELECT h.tenant_id, conversation_id, nation, tier FROM h LEFT JOIN e ON e.tenant_id = h.tenant_id
      AND e.key = coalesce(call_sid, conversation_sid) AND e.kind = CASE WHEN call_sid IS NULL THEN 'CONV' ELSE 'CALL' END"""


def _enriched_columns(rows):
    found = F.col("enrichment")
    return rows.select(
        "tenant_id", "conversation_id", V.text_at(found, "nation").alias("nation"), V.text_at(found, "tier").alias("tier")
    )


@query(ENRICHED_SQL)
def enrichment_write_merge(spark, sf_dir):
    return _enriched_columns(enriched_headers(spark, sf_dir))


@query(ENRICHED_SQL)
def enrichment_merge_hot_keys(spark, sf_dir):
    """The salted path of the same join, taken here from twenty conversations per key on."""
    return _enriched_columns(enriched_headers(spark, sf_dir, hot_rows=20))


@query(
    f"""WITH {I.HEADERS_SQL}, {I.ENRICHMENT_SQL}
    SELECT h.tenant_id, conversation_id, coalesce(nation, 'cached') AS nation FROM h LEFT JOIN e ON e.tenant_id = h.tenant_id
      AND e.key = coalesce(call_sid, conversation_sid) AND e.kind = CASE WHEN call_sid IS NULL THEN 'CONV' ELSE 'CALL' END"""
)
def enrichment_read_merge(spark, sf_dir):
    """A live record wins over the stored value, a missing one keeps it."""
    stored = I.headers(spark, sf_dir).withColumn(
        "enrichment", F.to_variant_object(F.struct(F.lit("cached").alias("nation")))
    )
    records = latest_enrichment(parse_enrichment(I.enrichment_posts(spark, sf_dir))[0])
    rows = with_enrichment(stored, records)
    return rows.select("tenant_id", "conversation_id", V.text_at(F.col("enrichment"), "nation").alias("nation"))


# --- index ---------------------------------------------------------------------------------


def index_sql(rows: str) -> str:
    return f"""WITH {I.FIRES_SQL}, x AS ({rows})
    SELECT tenant_id, field_name, field_value, conversation_id, {stamp_sql('max(ts)', 'received_at')} FROM x
    GROUP BY tenant_id, field_name, field_value, conversation_id"""


def _index(spark, sf_dir, *types, operators=()):
    rows = operator_index(I.fires(spark, sf_dir), I.only(*types, operators=operators))
    return rows.select("tenant_id", "field_name", "field_value", "conversation_id", stamp("received_at"))


@query(
    index_sql(
        """SELECT tenant_id, 'score' AS field_name, k::VARCHAR AS field_value, conversation_id, ts FROM p WHERE operator_name = 'click'
        UNION ALL SELECT tenant_id, 'reason', slug, conversation_id, ts FROM p JOIN reason_name USING (reason) WHERE operator_name = 'view'
        UNION ALL SELECT tenant_id, 'reason', slug, conversation_id, ts FROM first_fire JOIN reason_name USING (reason)"""
    )
)
def index_scalar(spark, sf_dir):
    """Out-of-range scores and ignored reasons are indexed too."""
    return _index(spark, sf_dir, "integer", "number", "enum")


@query(
    index_sql(
        """SELECT tenant_id, 'primary_topic' AS field_name, cat AS field_value, conversation_id, ts FROM items
        WHERE operator_name = 'purchase' AND at_end"""
    )
)
def index_array(spark, sf_dir):
    rows = _index(spark, sf_dir, "category_array")
    return rows.where(F.col("field_name") == "primary_topic")


@query(
    index_sql(
        """SELECT tenant_id, 'subtopic' AS field_name, cat || '__' || sub AS field_value, conversation_id, ts FROM items
        WHERE operator_name = 'purchase' AND at_end AND sub IS NOT NULL"""
    )
)
def index_pair(spark, sf_dir):
    rows = _index(spark, sf_dir, "category_array")
    return rows.where(F.col("field_name") == "subtopic")


@query(
    f"""WITH {I.HEADERS_SQL}, {I.ENRICHMENT_SQL},
    m AS (SELECT h.tenant_id, conversation_id, h.ck, nation, tier, CASE WHEN ck % 50 <> 0 THEN lpad(right(ck::VARCHAR, 4), 4, '0') END AS last4
          FROM h LEFT JOIN e ON e.tenant_id = h.tenant_id
          AND e.key = coalesce(call_sid, conversation_sid) AND e.kind = CASE WHEN call_sid IS NULL THEN 'CONV' ELSE 'CALL' END)
    SELECT tenant_id, 'customer_phone_last4' AS field_name, last4 AS field_value, conversation_id FROM m WHERE last4 IS NOT NULL
    UNION ALL SELECT tenant_id, 'nation', lower(nation), conversation_id FROM m WHERE nation IS NOT NULL
    UNION ALL SELECT tenant_id, 'tier', tier, conversation_id FROM m WHERE tier IS NOT NULL"""
)
def index_headers(spark, sf_dir):
    rows = enriched_headers(spark, sf_dir).withColumn(
        "customer_phone_last4", phones.phone_last4(I.phone(F.col("customer_key").cast("bigint")))
    )
    return header_index(rows, ("nation", "tier", "absent")).drop("received_at")


@query(
    f"""WITH {I.HEADERS_SQL} SELECT tenant_id, queue_id, count(*) FILTER (started_at + INTERVAL 180 DAYS > TIMESTAMP '1998-06-01') AS index_alive,
      count(*) FILTER (started_at + INTERVAL 90 DAYS > TIMESTAMP '1998-06-01') AS enrichment_alive FROM h GROUP BY ALL"""
)
def retention(spark, sf_dir):
    as_of = F.lit("1998-06-01").cast("timestamp")
    rows = I.headers(spark, sf_dir).select("tenant_id", "queue_id", "started_at")
    kept = with_expiry(rows, INDEX_DAYS, "started_at").withColumnRenamed("expires_at", "index_until")
    kept = with_expiry(kept, ENRICHMENT_DAYS, "started_at")
    return kept.groupBy("tenant_id", "queue_id").agg(
        F.count_if(F.col("index_until") > as_of).alias("index_alive"),
        F.count_if(F.col("expires_at") > as_of).alias("enrichment_alive"),
    )


# --- conformance, integrity, registries, keys ----------------------------------------------


SCHEMA = {
    "type": "object",
    "required": ["score", "reason", "missing"],
    "properties": {
        "ai_retained": {"type": "boolean"},
        "score": {"type": "integer", "minimum": 5, "maximum": 90},
        "reason": {"type": "string", "enum": ["NONE", "CUSTOMER_REQUEST", "LACK OF KNOWLEDGE", "Early Transfer"]},
        "topics": {
            "type": "array",
            "items": {"type": "object", "required": ["primary_topic"], "properties": {"subtopic": {"type": "string"}}},
        },
        "sentiment": {"type": "object", "additionalProperties": {"type": "string"}},
        "label": {},
    },
    "additionalProperties": False,
}


@query(
    f"""WITH {I.FIRES_SQL}, x AS (
      SELECT tenant_id, operator_name, ' must have required property ''missing''' AS error FROM p WHERE operator_name = 'view'
      UNION ALL SELECT tenant_id, operator_name, '/ai_retained must be boolean' FROM p WHERE operator_name = 'view' AND retained IS NULL
      UNION ALL SELECT tenant_id, operator_name, '/score must be >= 5' FROM p WHERE operator_name = 'view' AND k < 5
      UNION ALL SELECT tenant_id, operator_name, '/score must be <= 90' FROM p WHERE operator_name = 'view' AND k > 90
      UNION ALL SELECT tenant_id, operator_name, '/reason must be equal to one of the allowed values' FROM p WHERE operator_name = 'view' AND reason = 'OTHER'
      UNION ALL SELECT tenant_id, operator_name, '/topics/' || j || '/subtopic must be string' FROM p, (VALUES (1)) AS s(j) WHERE operator_name = 'view' AND j < k % 4
      UNION ALL SELECT tenant_id, operator_name, '/sentiment/score must be string' FROM p WHERE operator_name = 'view'
      UNION ALL SELECT tenant_id, operator_name, ' must NOT have additional properties' FROM p WHERE operator_name = 'view'
      UNION ALL SELECT tenant_id, operator_name, NULL FROM p WHERE operator_name <> 'view')
    SELECT tenant_id, operator_name, 'v1' AS schema_version, error, count(*) AS results FROM x GROUP BY ALL"""
)
def conformance_report(spark, sf_dir):
    return C.conformance_report(I.fires(spark, sf_dir), {("view", "v1"): SCHEMA})


@query(
    """SELECT page_id, sha256(html) AS body_hash, page_id % 5 <> 0 AS intact FROM pages"""
)
def integrity_audit_pages(spark, sf_dir):
    """Declared hashes are right but for every fifth page, whose body was cut."""
    pages = I.table(spark, sf_dir, "pages")
    declared = F.sha2(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256)
    audited = integrity_audit(pages.withColumn("declared_hash", F.upper(declared)), "html")
    return audited.select("page_id", "body_hash", "intact")


def registry(spark, sf_dir):
    """Defaults from regions, overrides of some of them and extra rows from nations."""
    region, nation = I.table(spark, sf_dir, "region"), I.table(spark, sf_dir, "nation")
    at = F.lit("2024-01-01").cast("timestamp").alias("created_at")
    defaults = region.select(
        F.lit("default").alias("tenant_id"), I.text("op", F.col("r_regionkey")).alias("operator_name"),
        F.lit("v1").alias("schema_version"), F.col("r_name").alias("definition"), at,
    )
    own = nation.select(
        I.text("t", F.col("n_nationkey") % 3).alias("tenant_id"), I.text("op", F.col("n_regionkey") * 2).alias("operator_name"),
        F.lit("v1").alias("schema_version"), F.col("n_name").alias("definition"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_nationkey")).alias("created_at"),
    )
    return upsert(defaults, own)


REGISTRY_SQL = """own AS (
      SELECT 't' || (n_nationkey % 3) AS tenant_id, 'op' || (n_regionkey * 2) AS operator_name,
             arg_max(n_name, n_nationkey) AS definition FROM nation GROUP BY ALL)"""


@query(
    f"""WITH {REGISTRY_SQL}
    SELECT tenant_id, operator_name, 'v1' AS schema_version, definition FROM own WHERE tenant_id = 't1'
    UNION ALL SELECT 'default', 'op' || r_regionkey, 'v1', r_name FROM region
      WHERE 'op' || r_regionkey NOT IN (SELECT operator_name FROM own WHERE tenant_id = 't1')"""
)
def registry_override(spark, sf_dir):
    return with_overrides(registry(spark, sf_dir), "t1").drop("created_at")


@query(
    f"""WITH {REGISTRY_SQL}, hits AS (
      SELECT tenant_id, operator_name, definition FROM own WHERE tenant_id = 't2'
      UNION ALL SELECT 'default', 'op' || r_regionkey, r_name FROM region)
    SELECT tenant_id, operator_name, 'v1' AS schema_version, definition FROM hits WHERE operator_name = 'op2'
    ORDER BY tenant_id = 'default' LIMIT 1"""
)
def registry_lookup(spark, sf_dir):
    return lookup(registry(spark, sf_dir), "t2", "op2", "v1").drop("created_at")


@query(
    """WITH c AS (SELECT c_custkey AS k, '+55' || lpad(c_custkey::VARCHAR, 11, '0') AS n FROM customer)
    SELECT k AS customer, CASE WHEN k % 50 = 0 THEN '12' || (k % 10) ELSE n END AS normalized,
      CASE WHEN k % 50 = 0 THEN NULL ELSE right(n, 4) END AS last4,
      CASE WHEN k % 50 = 0 THEN '12' || (k % 10) ELSE left(n, 5) || '*****' || right(n, 4) END AS masked FROM c"""
)
def phone_mask(spark, sf_dir):
    number = I.phone(F.col("c_custkey"))
    return I.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer"),
        phones.normalize_phone(number).alias("normalized"),
        phones.phone_last4(number).alias("last4"),
        phones.mask_phone(number).alias("masked"),
    )


@query(
    f"""WITH {I.FIRES_SQL}
    SELECT 'TENANT#' || tenant_id || '#CONV#' || conversation_id AS pk,
      'OP#' || operator_name || '#V#v1#TS#' || strftime(ts, '%Y%m%d%H%M%S') AS sk,
      tenant_id AS tenant, operator_name AS operator, 'v1' AS version, strftime(ts, '%Y%m%d%H%M%S') AS second,
      conversation_id AS conversation
    FROM f"""
)
def key_round_trip(spark, sf_dir):
    """Composite keys built and parsed again."""
    fires = I.fires(spark, sf_dir)
    second = F.date_format("received_at", "yyyyMMddHHmmss")
    pk, sk = keys.operator_keys(*(F.col(c) for c in ("tenant_id", "conversation_id", "operator_name", "schema_version")), second)
    _, conversation = keys.conversation_keys(F.col("tenant_id"), second, F.col("conversation_id"))
    rows = fires.select(pk.alias("pk"), sk.alias("sk"), conversation.alias("c"))
    parsed = keys.parse_operator_key(F.col("sk"))
    return rows.select(
        "pk", "sk", keys.tenant_of(F.col("pk")).alias("tenant"), parsed["operator_name"].alias("operator"),
        parsed["schema_version"].alias("version"), parsed["stamp"].alias("second"),
        keys.parse_conversation_key(F.col("c"))["conversation_id"].alias("conversation"),
    )
