"""Serving queries: metrics, conversation lists, drill-down, registries."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.config import MetricsConfig
from talktally.functions import variants as V
from talktally.functions.values import iso_day
from talktally.operators.derived import derive_all, raw_only
from talktally.operators.headers import correlation, with_enrichment
from talktally.operators.index import alive, by_index, pick_filter
from talktally.operators.latest import positions
from talktally.operators.naming import with_display_names
from talktally.operators.skew import lookup_join
from talktally.sources import access
from talktally.sources.lake import day_predicate, month_predicate, scan, stored_headers

PAGE, MAX_PAGE = 50, 500
DEFAULT_DAYS = 30
CONVERSATION = ["tenant_id", "conversation_id"]


def metric_range(start: date | None, end: date | None, as_of: date | None = None) -> tuple[date, date]:
    """Given days, or the last thirty up to `as_of` (today)."""
    last = end or as_of or date.today()
    return start or last - timedelta(days=DEFAULT_DAYS), last


def metrics(
    gold: DataFrame,
    cfg: MetricsConfig,
    tenant: str,
    start: date | None = None,
    end: date | None = None,
    metric: str | None = None,
    as_of: date | None = None,
) -> DataFrame:
    """Raw, daily derived and period rows of a range, with display names.

    A raw `metric` gives its raw rows (and nothing derived); a derived one reads only its
    ingredients and gives only its own rows.
    """
    first, last = metric_range(start, end, as_of)
    rows = gold.where(F.col("tenant_id") == tenant)
    if {"year", "month"} <= set(gold.columns):
        rows = rows.where(month_predicate(first, last))
    rows = rows.where(F.col("date").between(f"{first:%Y%m%d}", f"{last:%Y%m%d}"))
    defs = cfg.derived()
    wanted = [d for d in defs if d.name == metric]
    if wanted:
        ingredients = sorted({n for d in wanted for n in (d.numerator, d.denominator)})
        used = rows.where(F.col("metric_name").isin(ingredients))
        found = derive_all(used, wanted)
    else:
        raw = raw_only(rows, cfg) if metric is None else rows.where(F.col("metric_name") == metric)
        raw = raw.select("tenant_id", "date", "metric_name", "value")
        found = raw.unionByName(derive_all(raw, defs)) if metric is None else raw
    named = with_display_names(found, cfg)
    period = F.lit(f"{first:%Y-%m-%d}").alias("period_from"), F.lit(f"{last:%Y-%m-%d}").alias("period_to")
    return named.select(
        "tenant_id", iso_day(F.col("date")).alias("date"), "metric_name", "value", "display_name", *period
    )


def page_limit(limit: int | str | None) -> int:
    """Default for anything that is no positive number; never above the cap."""
    try:
        wanted = int(limit)
    except (TypeError, ValueError):
        return PAGE
    return min(wanted, MAX_PAGE) if wanted > 0 else PAGE


def page_token(started_at: datetime, conversation_id: str) -> str:
    key = {"started_at": started_at.isoformat(), "conversation_id": conversation_id}
    return base64.b64encode(json.dumps(key).encode()).decode()


def read_token(token: str | None) -> tuple[datetime, str] | None:
    """Position in a token; None for no token or an invalid one."""
    try:
        key = json.loads(base64.b64decode(token))
        return datetime.fromisoformat(key["started_at"]), str(key["conversation_id"])
    except (TypeError, ValueError, KeyError):
        return None


def token_column() -> Column:
    """The token of each row, for the caller to pass the last one back."""
    key = F.struct(
        F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("started_at"),
        "conversation_id",
    )
    return F.base64(F.to_json(key).cast("binary"))


def time_range(start: datetime | None, end: date | None) -> Column:
    """`start` inclusive to the end of the day `end`."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("started_at") >= F.lit(start))
    if end is not None:
        last = end.date() if isinstance(end, datetime) else end
        inside = inside & (F.col("started_at") < F.lit(datetime.combine(last + timedelta(days=1), datetime.min.time())))
    return inside


def _newest_first() -> tuple[Column, Column]:
    return F.desc("started_at"), F.desc("conversation_id")


def _behind(ts: datetime, last_id: str) -> Column:
    """Rows that follow a position, newest first."""
    return (F.col("started_at") < F.lit(ts)) | ((F.col("started_at") == F.lit(ts)) & (F.col("conversation_id") < last_id))


def page(rows: DataFrame, limit: int | str | None = None, after: str | None = None) -> DataFrame:
    """Newest first, from behind the token on; a top-k, not a full sort."""
    position = read_token(after)
    if position is not None:
        rows = rows.where(_behind(*position))
    return rows.orderBy(*_newest_first()).limit(page_limit(limit))


@dataclass(frozen=True)
class Tables:
    """What the conversation queries read."""

    headers: DataFrame
    results: DataFrame | None = None
    index: DataFrame | None = None
    enrichment: DataFrame | None = None


FILTERS = (("agentId", "agent_id"), ("queueId", "queue_id"), ("customerKey", "customer_key"))


def conversations(
    tables: Tables,
    cfg: MetricsConfig,
    tenant: str,
    params: dict[str, str] | None = None,
    start: datetime | None = None,
    end: date | None = None,
    limit: int | str | None = None,
    after: str | None = None,
    exclusive: bool = False,
    enrichment_fields: Sequence[str] = (),
    hot_rows: int | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """A page of conversations with surfaced operator fields and fresh enrichment.

    Of an index with expiry, entries count until their retention has passed, now or at `as_of`.

    Filters combine with AND. With `exclusive` an index filter switches the plain
    ones off, and of those only the first given one applies.
    """
    params = params or {}
    rows = tables.headers.where((F.col("tenant_id") == tenant) & time_range(start, end))
    if start is not None and end is not None and {"year", "month", "day"} <= set(rows.columns):
        rows = rows.where(day_predicate(start.date(), end.date() if isinstance(end, datetime) else end))
    hit = pick_filter(params, cfg, enrichment_fields) if tables.index is not None else None
    given = [(column, params[name]) for name, column in FILTERS if params.get(name)]
    if exclusive:
        given = [] if hit else given[:1]
    for column, value in given:
        rows = rows.where(F.col(column) == value)
    if hit:
        index = tables.index.where(F.col("tenant_id") == tenant)
        rows = by_index(rows, alive(index, as_of) if "expires_at" in index.columns else index, *hit)
    rows = page(rows, limit, after)
    if tables.results is not None:
        of_tenant = tables.results.where(F.col("tenant_id") == tenant)
        rows = with_surface_fields(rows, of_tenant, cfg)
    if tables.enrichment is not None:
        kind, key = correlation(F.col("call_sid"), F.col("conversation_sid"))
        # A page has 500 rows at most, so its keys are few.
        named = rows.select(kind.alias("correlation_type"), key.alias("correlation_key"))
        of_page = tables.enrichment.where(F.col("tenant_id") == tenant)
        of_page = of_page.join(F.broadcast(named), ["correlation_type", "correlation_key"], "left_semi")
        rows = with_enrichment(rows, of_page, hot_rows=hot_rows)
    # The joins behind the page may change its order.
    return rows.withColumn("page_token", token_column()).orderBy(*_newest_first())


def newest_conversations(
    spark: SparkSession,
    root: str,
    cfg: MetricsConfig,
    tenant: str,
    params: dict[str, str],
    start: datetime | None = None,
    end: date | None = None,
    limit: int | str | None = None,
    after: str | None = None,
    tables: Tables | None = None,
    **options,
) -> DataFrame:
    """`conversations` of an agent, queue or customer, from the stored copies for it.

    Months are opened from the newest on until the page is full. `tables` gives results and enrichment; without any of the three
    filters the stored headers are read.
    """
    given = [(column, params[name]) for name, column in FILTERS if params.get(name)]
    also = time_range(start, end)
    for column, value in given[1:]:
        also = also & (F.col(column) == value)
    position = read_token(after)
    if position is not None:
        also = also & _behind(*position)
    if given:
        last = min([d for d in (end, position[0] if position else None) if d is not None], default=None, key=lambda d: (d.year, d.month))
        months = {"first": start and f"{start:%Y%m}", "last": last and f"{last:%Y%m}"}
        rows = access.newest(spark, root, tenant, *given[0], page_limit(limit), also, **months)
        rows = rows.withColumn("tenant_id", F.lit(tenant))
    else:
        rows = stored_headers(scan(spark, f"{root}/conversations", "conversations"))
    found = replace(tables or Tables(rows), headers=rows)
    return conversations(found, cfg, tenant, params, start, end, limit, after, **options)


def every_page(
    spark: SparkSession,
    root: str,
    tenant: str,
    params: dict[str, str],
    start: datetime | None = None,
    end: date | None = None,
    limit: int | str | None = None,
) -> DataFrame:
    """All pages of a list of an agent, queue or customer at once, for exports: what `newest_conversations` gives page by page.

    Each row has its `position` and `page`, both from 1 on, and its `page_token`. The list is read and sorted once, in tasks; to
    walk it by tokens costs some jobs a page.
    """
    given = [(column, params[name]) for name, column in FILTERS if params.get(name)]
    if not given:
        raise ValueError(f"one of {', '.join(name for name, _ in FILTERS)} is needed")
    also = time_range(start, end)
    for column, value in given[1:]:
        also = also & (F.col(column) == value)
    rows = access.every(spark, root, tenant, *given[0], also, first=start and f"{start:%Y%m}", last=end and f"{end:%Y%m}")
    rows = positions(rows.withColumns({"tenant_id": F.lit(tenant), "page_token": token_column()}), _newest_first())
    return rows.withColumn("page", F.ceil(F.col("position") / page_limit(limit)))


def surface_values(results: DataFrame, cfg: MetricsConfig) -> DataFrame:
    """One row per conversation with a VARIANT column per surfaced field.

    Results count in the order operator, version, second of arrival; the last one that has the
    field wins, even with a JSON null.
    """
    fields = cfg.surface_fields()
    names = sorted({f for found in fields.values() for f in found})
    order = F.struct("operator_name", "schema_version", "received_at", "source_uri")
    picks = []
    for name in names:
        operators = [op for op, found in fields.items() if name in found]
        value = F.try_variant_get("data", f'$["{name}"]', "variant")
        has_it = F.col("operator_name").isin(operators) & value.isNotNull()
        picks.append(F.max_by(value, F.when(has_it, order)).alias(name))
    surfaced = results.where(F.col("operator_name").isin(list(fields)))
    return surfaced.groupBy(*CONVERSATION).agg(*picks) if picks else surfaced.select(*CONVERSATION).distinct()


def with_surface_fields(rows: DataFrame, results: DataFrame, cfg: MetricsConfig) -> DataFrame:
    """Add the surfaced fields; operators without configuration are skipped.

    Only results of the conversations in `rows` are aggregated.
    """
    needed = results.join(rows.select(*CONVERSATION), CONVERSATION, "left_semi")
    return rows.join(surface_values(needed, cfg), CONVERSATION, "left")


def conversation_detail(
    headers: DataFrame,
    results: DataFrame,
    tenant: str,
    conversation_ids: Sequence[str] | None = None,
    enrichment: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """A header with each of its operator results, one row per result.

    The results stay rows: a conversation may have any number of them.
    """
    heads = headers.where(F.col("tenant_id") == tenant)
    found = results.where(F.col("tenant_id") == tenant)
    if conversation_ids is not None:
        heads = heads.where(F.col("conversation_id").isin(list(conversation_ids)))
        found = found.where(F.col("conversation_id").isin(list(conversation_ids)))
    if enrichment is not None:
        heads = with_enrichment(heads, enrichment, hot_rows=hot_rows)
    shared = [c for c in found.columns if c in heads.columns and c not in CONVERSATION]
    found = found.withColumnsRenamed({c: f"result_{c}" for c in shared})
    with_results = lookup_join(found, heads, CONVERSATION, "inner", hot_rows)
    without = heads.join(found.select(*CONVERSATION).distinct(), CONVERSATION, "left_anti")
    return with_results.unionByName(without, allowMissingColumns=True)


def list_row(headers: DataFrame) -> DataFrame:
    """The listed columns with defaults in place."""
    empty = F.create_map().cast("map<string,string>")
    return headers.withColumn("reference_sids", F.coalesce("reference_sids", empty)).withColumn(
        "channel_type", F.coalesce("channel_type", V.channel_type(F.col("channel")))
    )
