"""Enrichment records: validate, keep the latest per key, load from CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.functions import variants as V
from talktally.functions.values import blank_to_null
from talktally.operators.headers import correlation
from talktally.operators.index import ENRICHMENT_DAYS, alive, with_expiry
from talktally.operators.latest import latest
from talktally.operators.staged import evaluated_once
from talktally.sources import keyed

KEYS = ["tenant_id", "correlation_type", "correlation_key"]


def parse_enrichment(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted records, rejected posts with a reason) from `tenant_id, body, received_at, source_uri`."""
    body = F.col("body")
    call = blank_to_null(F.trim(V.text_at(body, "callSid")))
    conversation = blank_to_null(F.trim(V.text_at(body, "conversationSid")))
    kind, key = correlation(call, conversation)
    fields = V.field(body, "fields")
    reason = (
        F.when(body.isNull(), "not JSON")
        .when(key.isNull(), "no callSid or conversationSid")
        .when(~V.is_object(fields), "fields is not an object")
    )
    read = {
        "correlation_type": kind,
        "correlation_key": key,
        "call_sid": call,
        "conversation_sid": conversation,
        "fields": fields,
        "source": F.coalesce(V.text_at(body, "source"), F.lit("unknown")),
        "reason": reason,
    }
    rows = evaluated_once(posts, read)
    accepted = rows.where(F.col("reason").isNull()).select(
        "tenant_id", *[c for c in read if c != "reason"], "received_at", "source_uri"
    )
    rejected = rows.where(F.col("reason").isNotNull()).select("tenant_id", "received_at", "source_uri", "reason")
    return with_expiry(accepted, ENRICHMENT_DAYS), rejected


def latest_enrichment(records: DataFrame) -> DataFrame:
    """The whole newest record of every key."""
    return latest(records, KEYS, "received_at", "source_uri")


def store_enrichment(records: DataFrame, path: str) -> None:
    """Put accepted records over the stored ones: the whole newest record of every key stays."""
    keyed.put(records, path, KEYS, "received_at", "source_uri")


def stored_enrichment(spark: SparkSession, path: str, tenant: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Stored records whose retention has not passed, now or at `as_of`."""
    return alive(keyed.read(spark, path, tenant), as_of)


def read_enrichment_csv(spark: SparkSession, path: str, tenant: str, key_column: str, source: str = "csv") -> DataFrame:
    """CSV rows with a header as posts: the key column names the call, the rest are fields."""
    rows = spark.read.option("header", True).csv(path)
    fields = F.struct(*[c for c in rows.columns if c != key_column])
    post = F.struct(F.col(key_column).alias("callSid"), fields.alias("fields"), F.lit(source).alias("source"))
    return rows.select(
        F.lit(tenant).alias("tenant_id"),
        V.parse(F.to_json(post)).alias("body"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("_metadata.file_path").alias("source_uri"),
    )
