"""Composite key strings of the exported spine-and-payload table: build and parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _part(key: Column, index: int) -> Column:
    return F.get(F.split(key, "#"), F.lit(index))


def conversation_keys(tenant: Column, stamp: Column, conversation: Column) -> tuple[Column, Column]:
    return _join("TENANT#", tenant, "#CONV"), _join("TS#", stamp, "#CONV#", conversation)


def operator_keys(
    tenant: Column, conversation: Column, operator: Column, version: Column, stamp: Column
) -> tuple[Column, Column]:
    return (
        _join("TENANT#", tenant, "#CONV#", conversation),
        _join("OP#", operator, "#V#", version, "#TS#", stamp),
    )


def aggregate_keys(tenant: Column, day: Column, metric: Column) -> tuple[Column, Column]:
    return _join("TENANT#", tenant, "#AGG#DAY"), _join("DAY#", day, "#METRIC#", metric)


def index_keys(
    tenant: Column, field: Column, value: Column, stamp: Column, conversation: Column
) -> tuple[Column, Column]:
    return (
        _join("TENANT#", tenant, "#IDX#", field, "#", value),
        _join("TS#", stamp, "#CONV#", conversation),
    )


def registry_keys(tenant: Column, kind: str, operator: Column, version: Column) -> tuple[Column, Column]:
    """`kind` is SCHEMA or VIEW."""
    return _join("TENANT#", tenant, f"#{kind}"), _join("OP#", operator, "#V#", version)


def access_key(tenant: Column, kind: str, value: Column) -> Column:
    """Partition key of a secondary path; `kind` is AGENT, QUEUE or CK."""
    return _join("TENANT#", tenant, f"#{kind}#", value)


def parse_conversation_key(sort_key: Column) -> Column:
    return F.struct(_part(sort_key, 1).alias("stamp"), _part(sort_key, 3).alias("conversation_id"))


def parse_operator_key(sort_key: Column) -> Column:
    return F.struct(
        _part(sort_key, 1).alias("operator_name"),
        _part(sort_key, 3).alias("schema_version"),
        _part(sort_key, 5).alias("stamp"),
    )


def tenant_of(partition_key: Column) -> Column:
    return F.regexp_extract(partition_key, "TENANT#([^#]+)", 1)


def day_of(sort_key: Column) -> Column:
    return F.regexp_extract(sort_key, r"DAY#(\d{8})", 1)


def metric_of(sort_key: Column) -> Column:
    return F.regexp_extract(sort_key, "METRIC#(.+)", 1)
