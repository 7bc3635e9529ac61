"""Operator results: unwrap payloads, run the enrichment hook, keep the latest per key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktally.functions import variants as V
from talktally.functions.values import second_stamp
from talktally.operators.latest import latest

RESULT_KEY = ["tenant_id", "conversation_id", "operator_name", "schema_version", "stamp"]


def unwrapped(fires: DataFrame) -> DataFrame:
    """Replace `data` by the flattened operator payload."""
    return fires.withColumn("data", V.unwrap(F.col("operator_type"), F.col("data")))


def apply_hook(fires: DataFrame, hook: Callable[[dict], dict] | None = None) -> DataFrame:
    """Add `enriched_at` and `enrichment_error`; the hook may replace the payload.

    `hook(context)` gets tenant_id, conversation_id, operator_name and payload and
    returns the new payload. A row whose hook fails keeps its payload and the
    message of the error. Without a hook nothing leaves the JVM. A hook that can
    be written with Columns is better given to `DataFrame.transform`.
    """
    if hook is None:
        return fires.withColumns({"enriched_at": F.col("received_at"), "enrichment_error": F.lit(None).cast("string")})

    @F.pandas_udf("struct<payload:string,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for tenants, conversations, operators, payloads in batches:
            made = [_run_hook(hook, *row) for row in zip(tenants, conversations, operators, payloads, strict=True)]
            yield pd.DataFrame(made, columns=["payload", "error"])

    called = fires.withColumn(
        "_hook", run(F.col("tenant_id"), F.col("conversation_id"), F.col("operator_name"), F.to_json("data"))
    )
    failed = F.col("_hook.error").isNotNull()
    return (
        called.withColumn("enrichment_error", F.col("_hook.error"))
        .withColumn("enriched_at", F.when(~failed, F.col("received_at")))
        .withColumn("data", F.when(failed, F.col("data")).otherwise(V.parse(F.col("_hook.payload"))))
        .drop("_hook")
    )


def _run_hook(hook, tenant, conversation, operator, payload) -> tuple[str | None, str | None]:
    context = {
        "tenant_id": tenant,
        "conversation_id": conversation,
        "operator_name": operator,
        "payload": None if payload is None else json.loads(payload),
    }
    try:
        return json.dumps(hook(context)), None
    except Exception as error:  # noqa: BLE001 - any failure of user code is recorded with the row
        return None, str(error) or "Unknown enrichment error"


def latest_results(fires: DataFrame) -> DataFrame:
    """Last result per (tenant, conversation, operator, version, second of arrival)."""
    stamped = fires.withColumn("stamp", second_stamp(F.col("received_at")))
    return latest(stamped, RESULT_KEY, "received_at", "source_uri").drop("stamp")


def operator_results(fires: DataFrame) -> DataFrame:
    """The stored shape of operator results; payloads as JSON text."""
    rows = latest_results(fires)
    return rows.select(
        "tenant_id",
        "conversation_id",
        "operator_name",
        "schema_version",
        "received_at",
        F.col("source_uri").alias("s3_uri"),
        "enriched_at",
        "enrichment_error",
        F.to_json("data").alias("enriched_payload"),
        V.display_fields(F.col("data")).alias("display_fields"),
    )


def as_fires(results: DataFrame) -> DataFrame:
    """Stored results back in fire shape, with a VARIANT payload."""
    return results.withColumn("data", V.parse(F.col("enriched_payload"))).withColumnRenamed("s3_uri", "source_uri")
