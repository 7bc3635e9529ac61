"""Raw documents in three shapes to one row per operator result ("fire").

Input rows are `tenant_header, body VARIANT, received_at, source_uri`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.config import TRIGGERS, TenantConfig
from talktally.functions import variants as V
from talktally.functions.values import blank_to_null
from talktally.operators.staged import evaluated_once
from talktally.operators.skew import lookup_join
from talktally.session import config_table

TRANSCRIPT_EVENT = "voice_intelligence_transcript_available"
DEFAULT_VERSION = "v1"
TIMING_TYPE = (
    "struct<handlingTimeSec:double,avgResponseTimeSec:double,avgCustomerWaitTimeSec:double,"
    "sentenceCount:bigint,agentSentenceCount:bigint,customerSentenceCount:bigint>"
)
FIRE_COLUMNS = (
    "tenant_id",
    "conversation_id",
    "operator_name",
    "operator_type",
    "schema_version",
    "received_at",
    "result_at",
    "ci_version",
    "trigger",
    "data",
    "metadata",
    "timing",
    "transcript_sid",
    "source_uri",
)


def _is_text(body: Column, name: str) -> Column:
    return F.coalesce(V.is_string(V.tag(V.field(body, name))), F.lit(False))


def looks_v3(body: Column) -> Column:
    results, settings = (V.field(body, n) for n in ("operatorResults", "intelligenceConfiguration"))
    return (
        _is_text(body, "conversationId")
        & _is_text(body, "accountId")
        & V.is_array(results)
        & (V.is_object(settings) | V.is_array(settings))
    )


def looks_v2(body: Column) -> Column:
    event = V.text_at(body, "event_type")
    return _is_text(body, "transcript_sid") & F.coalesce(event == TRANSCRIPT_EVENT, F.lit(False))


def looks_direct(body: Column) -> Column:
    return _is_text(body, "conversationId") & _is_text(body, "operatorName")


def with_tenant(raw: DataFrame, default: str = "default") -> DataFrame:
    """Tenant: request header, then the archived document's own, then the deployment's."""
    body = F.col("body")
    own = F.coalesce(V.text_at(body, "_meta.tenantId"), V.text_at(body, "tenantId"))
    header = blank_to_null(F.col("tenant_header")) if "tenant_header" in raw.columns else F.lit(None).cast("string")
    return raw.withColumn("tenant_id", F.coalesce(header, blank_to_null(own), F.lit(default)))


def with_version(raw: DataFrame, tenants: TenantConfig) -> DataFrame:
    """Add `shape` (direct, v2, v3) and `rejected` when the payload is neither.

    The tenant's declared version decides; a payload that clearly has the other
    shape overrides it.
    """
    names = config_table(
        raw.sparkSession,
        {"tenant_id": list(tenants.versions) or [""], "_declared": list(tenants.versions.values()) or [tenants.default]},
    )
    body = F.col("body")
    is_v2, is_v3 = looks_v2(body), looks_v3(body)
    looks = F.when(looks_direct(body), "direct").when(is_v2 & is_v3, "both").when(is_v2, "v2").when(is_v3, "v3")
    declared = F.coalesce("_declared", F.lit(tenants.default))
    # A payload of both shapes contradicts either declaration, and then the other shape wins.
    shape = (
        F.when(F.col("_looks") == "both", F.when(declared == "v3", "v2").otherwise("v3"))
        .otherwise(F.coalesce("_looks", declared))
    )
    misfit = F.concat(F.lit("payload does not match "), F.col("shape"))
    return (
        evaluated_once(raw, {"body": body, "_looks": looks})
        .join(names, "tenant_id", "left")
        .withColumn("shape", shape)
        .withColumn("rejected", F.when(F.col("_looks").isNull(), misfit))
        .drop("_looks", "_declared")
    )


def allowed_trigger(value: Column) -> Column:
    return F.when(value.isin(*TRIGGERS), value)


def _object(**parts: Column) -> Column:
    """VARIANT object without its null members."""
    pairs = [x for name, value in parts.items() for x in (F.lit(name), value.cast("variant"))]
    return V.to_object(F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))


def _first_text(values: Column, keep) -> Column:
    return F.get(F.filter(F.transform(V.items(values), V.as_string), keep), F.lit(0))


def normalize_v3(docs: DataFrame) -> DataFrame:
    """One row per element of `operatorResults`; none for an empty array."""
    body = F.col("body")
    # Outer, then a filter: a plain explode makes Catalyst evaluate the array once more to pre-filter it.
    each = docs.select("*", F.explode_outer(V.items(V.field(body, "operatorResults"))).alias("_r"))
    r = F.col("_r")
    # Parts used more than once are columns of their own, so each is evaluated once per row.
    parts = each.where(r.isNotNull()).withColumns(
        {
            "_details": V.field(r, "executionDetails"),
            "_format": V.text_at(r, "outputFormat"),
            "_result": V.field(r, "result"),
            "_system": V.field(r, "metadata.system"),
            "_conversation_sid": _first_text(V.field(r, "referenceIds"), lambda x: x.startswith("CH")),
        }
    )
    details = F.col("_details")
    people = F.filter(V.items(V.field(details, "participants")), lambda p: V.text_at(p, "type") == "CUSTOMER")
    channel = F.get(V.items(V.field(details, "channels")), F.lit(0))
    parts = parts.withColumn("_customer", V.field(F.get(people, F.lit(0)), "profileId")).withColumn("_channel", channel)
    rows = parts.withColumns(
        {"_customer": V.as_string(F.col("_customer")), "_channel": F.lower(V.as_string(F.col("_channel")))}
    )
    metadata = _object(
        customerKey=blank_to_null(F.col("_customer")),
        channel=blank_to_null(F.col("_channel")),
        conversationSid=F.col("_conversation_sid"),
        ruleId=V.field(body, "intelligenceConfiguration.ruleId"),
        intelligenceConfigurationId=V.field(body, "intelligenceConfiguration.id"),
        operatorResultId=V.field(r, "id"),
        operatorId=V.field(r, "operator.id"),
        outputFormat=F.col("_format"),
        executionDetails=details,
        executionMetadata=F.when(V.truthy(F.col("_system")), F.col("_system")),
    )
    return rows.select(
        "tenant_id",
        V.text_at(body, "conversationId").alias("conversation_id"),
        V.text_at(r, "operator.displayName").alias("operator_name"),
        F.lit(None).cast("string").alias("operator_type"),
        F.concat(F.lit("v"), V.any_text(V.field(r, "operator.version"))).alias("schema_version"),
        "received_at",
        F.try_to_timestamp(V.text_at(r, "dateCreated")).alias("result_at"),
        F.lit("v3").alias("ci_version"),
        allowed_trigger(V.text_at(details, "trigger.on")).alias("trigger"),
        V.wrap_result(F.col("_format"), F.col("_result")).alias("data"),
        metadata.alias("metadata"),
        F.lit(None).cast(TIMING_TYPE).alias("timing"),
        F.lit(None).cast("string").alias("transcript_sid"),
        "source_uri",
    )


# Optional members of an upstream operator result (upstream name, our name, kept when).
RESULT_MEMBERS = (
    ("textGenerationResults", "text_generation_results", "truthy"),
    ("textExtractionResults", "text_extraction_results", "truthy"),
    ("labelProbabilities", "label_probabilities", "truthy"),
    ("extractResults", "extract_results", "truthy"),
    ("utteranceResults", "utterance_results", "truthy"),
    ("normalizedResults", "normalized_results", "truthy"),
    ("jsonResults", "json_results", "truthy"),
    ("predictedProbability", "predicted_probability", "number"),
    ("matchProbability", "match_probability", "number"),
    ("extractMatch", "extract_match", "boolean"),
    ("utteranceMatch", "utterance_match", "boolean"),
)


def operator_result_members(result: Column) -> Column:
    """Upstream operator result (VARIANT) under our member names, absent ones left out."""
    keep = {
        "truthy": V.truthy,
        "number": lambda v: V.is_number(V.tag(v)),
        "boolean": lambda v: V.is_boolean(V.tag(v)),
    }
    parts = {
        "operator_sid": V.field(result, "operatorSid"),
        "operator_type": V.field(result, "operatorType"),
        "name": V.field(result, "name"),
    }
    for source, target, kind in RESULT_MEMBERS:
        value = V.field(result, source)
        parts[target] = F.when(keep[kind](value), value)
    label = V.field(result, "predictedLabel")
    classified = _object(prediction=label, predicted_probability=V.field(result, "predictedProbability"))
    parts["text_classification_results"] = F.when(V.truthy(label), classified)
    return _object(**parts)


def normalize_v2(
    notifications: DataFrame,
    transcripts: DataFrame,
    results: DataFrame,
    timings: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per operator result of the notified transcript.

    transcripts: tenant_id, transcript_sid, channel VARIANT, created_at
    results: tenant_id, transcript_sid, result VARIANT
    timings: tenant_id, transcript_sid, timing STRUCT
    """
    keys = ["tenant_id", "transcript_sid"]
    body = F.col("body")
    notes = notifications.select(
        "tenant_id",
        V.text_at(body, "transcript_sid").alias("transcript_sid"),
        blank_to_null(V.text_at(body, "customer_key")).alias("customer_key"),
        blank_to_null(V.text_at(body, "service_sid")).alias("service_sid"),
        "received_at",
        "source_uri",
    )
    facts = transcripts.select(*keys, "channel", "created_at")
    if timings is not None:
        facts = facts.join(timings.select(*keys, "timing"), keys, "left")
    else:
        facts = facts.withColumn("timing", F.lit(None).cast(TIMING_TYPE))
    # A redelivered notification fires again, so the notes side may repeat a transcript.
    joined = lookup_join(results.select(*keys, "result"), notes.join(facts, keys), keys, "inner", hot_rows)
    members = operator_result_members(F.col("result"))
    metadata = _object(
        transcriptSid=F.col("transcript_sid"),
        customerKey=F.col("customer_key"),
        serviceSid=F.col("service_sid"),
        channel=F.col("channel"),
    )
    return joined.select(
        "tenant_id",
        F.coalesce("customer_key", "transcript_sid").alias("conversation_id"),
        V.text_at(F.col("result"), "name").alias("operator_name"),
        V.text_at(F.col("result"), "operatorType").alias("operator_type"),
        F.lit(DEFAULT_VERSION).alias("schema_version"),
        "received_at",
        F.col("created_at").alias("result_at"),
        F.lit("v2").alias("ci_version"),
        F.lit(None).cast("string").alias("trigger"),
        members.alias("data"),
        metadata.alias("metadata"),
        "timing",
        "transcript_sid",
        "source_uri",
    )


def normalize_direct(docs: DataFrame) -> DataFrame:
    """Documents already in the internal shape, such as archived ones."""
    body = F.col("body")
    kept = docs.where((V.text_at(body, "conversationId") != "") & (V.text_at(body, "operatorName") != ""))
    data = V.field(body, "data")
    timing = V.field(body, "timingMetrics")
    arrival = F.try_to_timestamp(
        F.coalesce(V.text_at(body, "_meta.receivedAt"), V.text_at(body, "receivedAt"))
    )
    return kept.select(
        "tenant_id",
        V.text_at(body, "conversationId").alias("conversation_id"),
        V.text_at(body, "operatorName").alias("operator_name"),
        V.text_at(body, "operatorType").alias("operator_type"),
        F.coalesce(blank_to_null(V.text_at(body, "schemaVersion")), F.lit(DEFAULT_VERSION)).alias("schema_version"),
        F.coalesce(arrival, "received_at").alias("received_at"),
        F.try_to_timestamp(V.text_at(body, "timestamp")).alias("result_at"),
        V.text_at(body, "ciVersion").alias("ci_version"),
        allowed_trigger(V.text_at(body, "trigger")).alias("trigger"),
        F.when(V.truthy(data), data).otherwise(body).alias("data"),
        V.field(body, "metadata").alias("metadata"),
        F.try_variant_get(timing, "$", TIMING_TYPE).alias("timing"),
        V.text_at(body, "transcriptSid").alias("transcript_sid"),
        "source_uri",
    )


def split_shapes(raw: DataFrame, tenants: TenantConfig, default_tenant: str = "default") -> dict[str, DataFrame]:
    """Documents by shape, and those that fit none under `rejected`."""
    shaped = with_version(with_tenant(raw, default_tenant), tenants)
    fitting = shaped.where(F.col("rejected").isNull())
    parts = {s: fitting.where(F.col("shape") == s) for s in ("direct", "v2", "v3")}
    return {**parts, "rejected": shaped.where(F.col("rejected").isNotNull())}


def union_fires(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*FIRE_COLUMNS) for p in parts])
