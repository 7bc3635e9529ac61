"""Small fixtures as DataFrames."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from talktally.operators.normalize import FIRE_COLUMNS, TIMING_TYPE

DAY = datetime(2026, 1, 27, 12, 0, 0)


def fire(payload, operator="test", conversation="c1", tenant="t", trigger=None, at=DAY, uri="u1", metadata=None):
    return (tenant, conversation, operator, "v1", at, trigger, json.dumps(payload), json.dumps(metadata or {}), uri)


def fires(spark, *rows):
    """Fires from `fire(...)` tuples."""
    schema = (
        "tenant_id string, conversation_id string, operator_name string, schema_version string, received_at timestamp,"
        "trigger string, data string, metadata string, source_uri string"
    )
    df = spark.createDataFrame(list(rows), schema)
    return df.withColumns(
        {
            "data": F.parse_json("data"),
            "metadata": F.parse_json("metadata"),
            "operator_type": F.lit(None).cast("string"),
            "result_at": F.col("received_at"),
            "ci_version": F.lit("v3"),
            "timing": F.lit(None).cast(TIMING_TYPE),
            "transcript_sid": F.lit(None).cast("string"),
        }
    ).select(*FIRE_COLUMNS)


def documents(spark, *bodies, tenant=None):
    rows = [(tenant, body if isinstance(body, str) else json.dumps(body), DAY, f"doc{i}") for i, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, "tenant_header string, body string, received_at timestamp, source_uri string")
    return df.withColumn("body", F.try_parse_json("body"))


def gold(spark, *rows):
    return spark.createDataFrame([("t", d, n, float(v)) for d, n, v in rows], "tenant_id string, date string, metric_name string, value double")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
