"""One header row per conversation, and enrichment joined to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.functions import variants as V
from talktally.functions.phones import mask_phone, phone_last4
from talktally.functions.values import blank_to_null
from talktally.operators.gates import FIRE_ORDER
from talktally.operators.skew import lookup_join

KEYS = ["tenant_id", "conversation_id"]
ATTRIBUTES = (
    "customer_key",
    "channel",
    "channel_type",
    "source_type",
    "source_sid",
    "call_sid",
    "conversation_sid",
    "reference_sids",
    "customer_phone",
    "customer_phone_last4",
    "agent_id",
    "team_id",
    "queue_id",
)


def promoted(metadata: Column) -> dict[str, Column]:
    """Header attributes found in a fire's metadata."""

    def plain(name: str) -> Column:
        return blank_to_null(V.text_at(metadata, name))

    channel = V.field(metadata, "channel")
    media = V.field(channel, "media_properties")
    reference = V.members(V.field(media, "reference_sids"))
    reference_texts = F.transform_values(reference, lambda k, v: V.any_text(v))
    customer = F.get(
        F.filter(
            F.coalesce(V.items(V.field(channel, "participants")), F.array().cast("array<variant>")),
            lambda p: F.coalesce(V.text_at(p, "role") == "Customer", F.lit(False)),
        ),
        F.lit(0),
    )
    phone = V.text_at(customer, "media_participant_id")
    return {
        "customer_key": plain("customerKey"),
        "channel": F.when(V.truthy(channel), channel).otherwise(F.lit("unknown").cast("variant")),
        "channel_type": F.coalesce(V.channel_type(channel), F.lit("unknown")),
        "source_type": V.text_at(media, "source"),
        "source_sid": V.text_at(media, "source_sid"),
        "call_sid": V.text_at(media, "reference_sids.call_sid"),
        "conversation_sid": F.coalesce(
            V.text_at(media, "reference_sids.conversation_sid"),
            V.text_at(metadata, "conversationSid"),
            V.text_at(metadata, "referenceSids.conversationSid"),
        ),
        "reference_sids": F.coalesce(reference_texts, F.create_map().cast("map<string,string>")),
        "customer_phone": mask_phone(phone),
        "customer_phone_last4": phone_last4(phone),
        "agent_id": plain("agentId"),
        "team_id": plain("teamId"),
        "queue_id": plain("queueId"),
    }


def headers(fires: DataFrame) -> DataFrame:
    """Earliest arrival, latest attributes (nulls overwrite) and number of fires."""
    return header_state(fires).drop("last_uri")


def header_state(fires: DataFrame) -> DataFrame:
    """Headers with the address of the latest fire (`last_uri`), so that those of disjoint sets of fires can be merged.

    The latest metadata is picked first and taken apart afterwards, once per
    conversation instead of once per fire; partial aggregation keeps a hot
    conversation to one row per input partition.
    """
    position = F.struct(*FIRE_ORDER)
    picked = fires.groupBy(*KEYS).agg(
        F.max_by(F.struct("metadata", F.col("source_uri").alias("uri")), position).alias("_last"),
        F.min("received_at").alias("started_at"),
        F.max("received_at").alias("updated_at"),
        F.count(F.lit(1)).cast("int").alias("operator_count"),
    )
    attributes = promoted(F.col("_last.metadata"))
    return picked.select(
        *KEYS,
        *[attributes[name].alias(name) for name in ATTRIBUTES],
        "started_at",
        F.col("started_at").alias("created_at"),
        "updated_at",
        "operator_count",
        F.col("_last.uri").alias("last_uri"),
    )


def merge_headers(*parts: DataFrame) -> DataFrame:
    """Combine the states of disjoint sets of fires, such as stored ones and a new batch, in any order.

    Equal to the state of all the fires: the attributes are those of the latest one, by arrival and then address.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    carried = [c for c in rows.columns if c not in (*KEYS, "started_at", "created_at", "updated_at", "operator_count", "enrichment")]
    position = F.struct(*[c for c in ("updated_at", "last_uri") if c in rows.columns])
    last = [F.max_by(F.struct(*carried), position).alias("_last")]
    if "enrichment" in rows.columns:
        known = F.when(F.col("enrichment").isNotNull(), position)
        last.append(F.max_by("enrichment", known).alias("enrichment"))
    merged = rows.groupBy(*KEYS).agg(
        F.min("started_at").alias("started_at"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.sum("operator_count").cast("int").alias("operator_count"),
        *last,
    )
    return merged.select("*", "_last.*").select(*rows.columns)


def correlation(call_sid: Column, conversation_sid: Column) -> tuple[Column, Column]:
    """Type and key an enrichment record is found by: the call, else the conversation."""
    call, conversation = blank_to_null(call_sid), blank_to_null(conversation_sid)
    kind = F.when(call.isNotNull(), "CALL").when(conversation.isNotNull(), "CONV")
    return kind, F.coalesce(call, conversation)


def with_enrichment(
    rows: DataFrame, enrichment: DataFrame, prefer_live: bool = True, hot_rows: int | None = None
) -> DataFrame:
    """Add or refresh `enrichment` from the latest record of each correlation key.

    A row without a record keeps what it had. With `prefer_live=False` a stored
    value stays as it is.
    """
    kind, key = correlation(F.col("call_sid"), F.col("conversation_sid"))
    keyed = rows.withColumns({"correlation_type": kind, "correlation_key": key})
    records = enrichment.select("tenant_id", "correlation_type", "correlation_key", F.col("fields").alias("_live"))
    keys = ["tenant_id", "correlation_type", "correlation_key"]
    joined = lookup_join(keyed, records, keys, "left", hot_rows, spread=["conversation_id"])
    live = F.when(V.is_object(F.col("_live")), F.col("_live"))
    cached = F.col("enrichment") if "enrichment" in rows.columns else F.lit(None).cast("variant")
    value = F.coalesce(live, cached) if prefer_live else F.coalesce(cached, live)
    return joined.withColumn("enrichment", value).select(*[c for c in rows.columns if c != "enrichment"], "enrichment")
