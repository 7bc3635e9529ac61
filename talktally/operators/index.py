"""Inverse index: field value to conversations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.config import BUILTIN_INDEX_FIELDS, Metric, MetricsConfig
from talktally.functions import variants as V
from talktally.functions.values import normalise
from talktally.operators.emit import category_items, extracted
from talktally.operators.gates import apply_once, gate, with_day

INDEX_DAYS, ENRICHMENT_DAYS, MARKER_DAYS = 180, 90, 7
ENTRY = "array<struct<field_name:string,field_value:string,received_at:timestamp>>"
KEYS = ["tenant_id", "field_name", "field_value", "conversation_id"]


def _entry(name: str, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("field_name"),
        normalise(value).alias("field_value"),
        F.col("received_at").cast("timestamp").alias("received_at"),
    )


def scalar_entries(value: Column, tag: Column, m: Metric) -> Column:
    """Any non-null value is indexed, even one the metric itself would not count."""
    return F.array(F.when(~V.is_missing(value), _entry(m.field, V.any_text(value))))


def category_entries(value: Column, tag: Column, m: Metric) -> Column:
    """Distinct categories, and category with sub-category under the sub field's name."""
    pairs = category_items(value, m)
    primary = F.transform(F.array_distinct(F.transform(pairs, lambda p: normalise(p["category"]))), lambda c: _entry(m.category_field, c))
    if not (m.sub_field and m.sub_prefix):
        return primary
    with_sub = F.filter(pairs, lambda p: p["sub"].isNotNull())
    both = F.transform(with_sub, lambda p: _entry(m.sub_field, F.concat(p["category"], F.lit("__"), p["sub"])))
    return F.concat(primary, both)


def operator_index(fires: DataFrame, cfg: MetricsConfig) -> DataFrame:
    """Entries of fields surfaced in lists, behind the same gates as the metrics."""
    return _dedup(_operator_entries(fires, cfg))


def daily_index(fires: DataFrame, cfg: MetricsConfig) -> DataFrame:
    """The same by day and operator, as it is stored: a day's entries can be replaced without the other days."""
    return _dedup(_operator_entries(fires, cfg), [*KEYS, "operator_name", "date"])


def _operator_entries(fires: DataFrame, cfg: MetricsConfig) -> DataFrame:
    rows, plan = extracted(with_day(gate(fires, cfg)), cfg)
    parts = []
    for m, v, t in plan:
        if m.surface:
            build = category_entries if m.type == "category_array" else scalar_entries
            parts.append(F.coalesce(build(F.col(v), F.col(t), m), F.array().cast(ENTRY)))
    entries = F.concat(*parts) if parts else F.array().cast(ENTRY)
    kept = apply_once(rows.withColumn("entries", entries), cfg, "entries")
    flat = kept.select("tenant_id", "conversation_id", "operator_name", "date", F.inline_outer("entries"))
    return flat.where(F.col("field_name").isNotNull() & F.col("field_value").isNotNull())


def header_index(headers: DataFrame, enrichment_fields: Sequence[str] = ()) -> DataFrame:
    """Entries from headers: last phone digits, and chosen top-level enrichment fields."""
    parts = []
    if "customer_phone_last4" in headers.columns:
        value = F.col("customer_phone_last4")
        parts.append(F.when(value.isNotNull(), _entry("customer_phone_last4", value)))
    if "enrichment" in headers.columns:
        for name in enrichment_fields:
            value = F.try_variant_get("enrichment", f'$["{name}"]', "variant")
            text = V.any_text(value)
            parts.append(F.when(~V.is_missing(value) & (text != ""), _entry(name, text)))
    if not parts:
        parts = [F.lit(None).cast(ENTRY[len("array<") : -1])]
    rows = headers.withColumn("received_at", F.col("updated_at"))
    flat = rows.select("tenant_id", "conversation_id", F.inline_outer(F.array(*parts)))
    return _dedup(flat.where(F.col("field_name").isNotNull()))


def _dedup(flat: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return flat.groupBy(*keys).agg(F.max("received_at").alias("received_at"))


def header_entries(headers: DataFrame, enrichment_fields: Sequence[str] = ()) -> DataFrame:
    """Entries from headers as they are stored: of no operator, on the day of the last arrival."""
    return with_day(header_index(headers, enrichment_fields)).withColumn("operator_name", F.lit(""))


def stored_index(entries: DataFrame) -> DataFrame:
    """Daily entries with their expiry and month."""
    columns = ["field_value", "conversation_id", "operator_name", "date", "received_at", "expires_at", "tenant_id", "field_name"]
    month = F.substring("date", 1, 6).alias("month")
    return with_expiry(entries, INDEX_DAYS).select(*columns, month)


def index_entries(stored: DataFrame) -> DataFrame:
    """Stored daily entries as index rows: one per field value and conversation, with its latest arrival."""
    return stored.groupBy(*KEYS).agg(F.max("received_at").alias("received_at"), F.max("expires_at").alias("expires_at"))


def with_expiry(df: DataFrame, days: int, written_at: str = "received_at") -> DataFrame:
    return df.withColumn("expires_at", F.col(written_at).cast("timestamp") + F.make_dt_interval(days=F.lit(days)))


def alive(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows whose retention has not passed."""
    return df.where(F.col("expires_at") > (F.current_timestamp() if as_of is None else as_of))


def build_index(
    fires: DataFrame,
    headers: DataFrame,
    cfg: MetricsConfig,
    enrichment_fields: Sequence[str] = (),
) -> DataFrame:
    """All index rows with their expiry. Run over all of silver it is the backfill."""
    parts = [operator_index(fires, cfg), header_index(headers, enrichment_fields)]
    return with_expiry(reduce(DataFrame.unionByName, parts), INDEX_DAYS)


def pick_filter(
    params: dict[str, str], cfg: MetricsConfig, enrichment_fields: Sequence[str] = ()
) -> tuple[str, str] | None:
    """Index field and value a list request asks for.

    A category with its sub-category comes first, then single fields in
    configuration order, built-in fields and enrichment fields.
    """
    for primary, sub in cfg.category_pairs():
        if params.get(primary) and params.get(sub):
            return sub, f"{params[primary]}__{params[sub]}"
    for name in [*cfg.filterable_fields(), *BUILTIN_INDEX_FIELDS, *enrichment_fields]:
        if params.get(name):
            return name, params[name]
    return None


def by_index(headers: DataFrame, index: DataFrame, field_name: str, value: str) -> DataFrame:
    """Headers of the conversations listed under a field value."""
    hits = index.where((F.col("field_name") == field_name) & (F.col("field_value") == normalise(F.lit(value))))
    return headers.join(hits.select("tenant_id", "conversation_id"), ["tenant_id", "conversation_id"], "left_semi")
