"""The catalogue of BI queries, over gold metrics, headers and results.

Day ranges are inclusive and given as dates; nothing depends on the clock.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.functions.values import day_to_date, suffix_int, threshold_class
from talktally.operators.derived import PERIOD
from talktally.sources.lake import day_predicate, month_predicate


def metric_rows(gold: DataFrame, tenant: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """A tenant's metric rows of a range, with partition predicates where the table has partitions."""
    rows = gold.where(F.col("tenant_id") == tenant)
    if first is None:
        return rows
    last = last or first
    if {"year", "month"} <= set(gold.columns):
        rows = rows.where(month_predicate(first, last))
    return rows.where(F.col("date").between(f"{first:%Y%m%d}", f"{last:%Y%m%d}"))


def header_rows(headers: DataFrame, tenant: str, first: date | None = None, last: date | None = None) -> DataFrame:
    rows = headers.where(F.col("tenant_id") == tenant)
    if first is None:
        return rows
    last = last or first
    if {"year", "month", "day"} <= set(headers.columns):
        rows = rows.where(day_predicate(first, last))
    return rows.where((F.col("started_at") >= F.lit(first)) & (F.col("started_at") < F.lit(last + timedelta(days=1))))


def last_days(as_of: date, days: int) -> tuple[date, date]:
    return as_of - timedelta(days=days), as_of


def metrics_of_day(gold: DataFrame, tenant: str, day: date) -> DataFrame:
    return metric_rows(gold, tenant, day).select("metric_name", "value").orderBy("metric_name")


def trend(gold: DataFrame, tenant: str, metric: str, first: date, last: date) -> DataFrame:
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name") == metric)
    return rows.groupBy("date").agg(F.avg("value").alias("value")).orderBy("date")


def pivot_metrics(gold: DataFrame, tenant: str, columns: dict[str, str], first: date, last: date) -> DataFrame:
    """One row per day, one column per metric of a fixed list."""
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name").isin(list(columns)))
    sums = [F.sum(F.when(F.col("metric_name") == m, F.col("value"))).alias(c) for m, c in columns.items()]
    return rows.groupBy("date").agg(*sums).orderBy("date")


def top_metrics(gold: DataFrame, tenant: str, like: str, first: date, last: date, n: int = 20) -> DataFrame:
    """Largest sums among names that match a LIKE pattern (`_` matches any character)."""
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name").like(like))
    hits = rows.groupBy("metric_name").agg(F.sum("value").alias("hits"))
    return hits.orderBy(F.desc("hits"), "metric_name").limit(n)


def score_distribution(gold: DataFrame, tenant: str, prefix: str, first: date, last: date, pattern: str = "[0-9]+") -> DataFrame:
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name").rlike(f"^{prefix}{pattern}$"))
    return (
        rows.groupBy("metric_name")
        .agg(F.sum("value").alias("responses"))
        .select(suffix_int(F.col("metric_name"), prefix).alias("score"), "responses")
        .orderBy("score")
    )


def metric_averages(gold: DataFrame, tenant: str, like: str, first: date, last: date) -> DataFrame:
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name").like(like))
    return rows.groupBy("metric_name").agg(F.avg("value").alias("avg_value")).orderBy("metric_name")


def total(gold: DataFrame, tenant: str, metric: str, first: date, last: date) -> DataFrame:
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name") == metric)
    return rows.agg(F.sum("value").alias("total"))


def mean_of_days(gold: DataFrame, tenant: str, metric: str, first: date, last: date) -> DataFrame:
    """Unweighted mean of the daily values; on purpose not the period value."""
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name") == metric)
    return rows.agg(F.avg("value").alias("mean_value"))


def daily_volume(gold: DataFrame, tenant: str, first: date, last: date, metric: str = "conversation_count") -> DataFrame:
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name") == metric)
    return rows.groupBy(day_to_date(F.col("date")).alias("date")).agg(F.sum("value").alias("conversation_count")).orderBy("date")


def top_operators(gold: DataFrame, tenant: str, first: date, last: date, n: int = 10) -> DataFrame:
    """Operators by fires; the name keeps what follows its `operator_` prefix."""
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name").like("operator_%_count"))
    counts = rows.groupBy("metric_name").agg(F.sum("value").alias("execution_count"))
    named = counts.select(F.replace("metric_name", F.lit("operator_"), F.lit("")).alias("operator_name"), "execution_count")
    return named.orderBy(F.desc("execution_count"), "operator_name").limit(n)


def top_customers(headers: DataFrame, tenant: str, first: date, last: date, n: int = 20) -> DataFrame:
    rows = header_rows(headers, tenant, first, last)
    counts = rows.groupBy("customer_key").agg(
        F.count(F.lit(1)).alias("conversation_count"), F.max("started_at").alias("last_contact")
    )
    return counts.orderBy(F.desc("conversation_count"), F.desc("last_contact"), "customer_key").limit(n)


def customers_by_conversations(headers: DataFrame, tenant: str, first: date | None = None, last: date | None = None) -> DataFrame:
    rows = header_rows(headers, tenant, first, last)
    counts = rows.groupBy("customer_key").agg(F.count_distinct("conversation_id").alias("conversations"))
    return counts.orderBy(F.desc("conversations"), "customer_key")


def recent_conversations(headers: DataFrame, tenant: str, first: date, last: date, n: int = 50) -> DataFrame:
    rows = header_rows(headers, tenant, first, last)
    columns = ["conversation_id", "started_at", "customer_key", "agent_id", "channel_type", "operator_count"]
    return rows.select(*columns).orderBy(F.desc("started_at"), F.desc("conversation_id")).limit(n)


def conversations_of_day(headers: DataFrame, tenant: str, day: date, n: int = 100) -> DataFrame:
    rows = header_rows(headers, tenant, day)
    columns = ["conversation_id", "agent_id", "team_id", "queue_id", "started_at", "operator_count"]
    return rows.select(*columns).orderBy(F.desc("started_at"), F.desc("conversation_id")).limit(n)


def payload_fields(
    results: DataFrame, tenant: str, operator: str, fields: list[str], n: int | None = 50, payload: str = "enriched_payload"
) -> DataFrame:
    """Scalars out of the stored JSON payloads, newest first."""
    rows = results.where((F.col("tenant_id") == tenant) & (F.col("operator_name") == operator))
    picked = [F.get_json_object(payload, f"$.{f}").alias(f) for f in fields]
    newest = rows.select("conversation_id", "received_at", *picked).orderBy(F.desc("received_at"), "conversation_id")
    return newest if n is None else newest.limit(n)


def channel_distribution(headers: DataFrame, tenant: str, first: date, last: date) -> DataFrame:
    rows = header_rows(headers, tenant, first, last)
    counts = rows.groupBy("channel_type").agg(F.count(F.lit(1)).alias("conversation_count"))
    return counts.orderBy(F.desc("conversation_count"), "channel_type")


def heatmap_week(headers: DataFrame, tenant: str, first: date | None = None, last: date | None = None) -> DataFrame:
    rows = header_rows(headers, tenant, first, last)
    week = F.date_trunc("WEEK", "started_at").cast("date").alias("week")
    return rows.groupBy(week, F.hour("started_at").alias("hour")).agg(F.count("conversation_id").alias("conversations"))


def heatmap_weekday(headers: DataFrame, tenant: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Weekday 1 is Sunday."""
    rows = header_rows(headers, tenant, first, last)
    keys = F.dayofweek("started_at").alias("weekday"), F.hour("started_at").alias("hour")
    return rows.groupBy(*keys).agg(F.count("conversation_id").alias("conversations"))


def period_change(gold: DataFrame, tenant: str, metrics: list[str], as_of: date, days: int = 30) -> DataFrame:
    """Sum of the last `days` days, of as many before, and the change (0 without a base)."""
    split = as_of - timedelta(days=days)
    rows = metric_rows(gold, tenant, split - timedelta(days=days - 1), as_of).where(F.col("metric_name").isin(metrics))
    recent = F.col("date") > f"{split:%Y%m%d}"
    sums = rows.groupBy("metric_name").agg(
        F.sum(F.when(recent, F.col("value"))).alias("current_value"),
        F.sum(F.when(~recent, F.col("value"))).alias("previous_value"),
    )
    change = F.try_divide(F.col("current_value") - F.col("previous_value"), F.col("previous_value"))
    return sums.withColumn("change_ratio", F.coalesce(change, F.lit(0.0)))


def stat_value(metric_rows_: DataFrame, metric: str) -> DataFrame:
    """What a stat panel shows: the last non-null value, and that is the period row."""
    rows = metric_rows_.where(F.col("metric_name") == metric)
    position = F.struct((F.col("date") == PERIOD).alias("is_period"), "date")
    return rows.agg(F.max_by("value", F.when(F.col("value").isNotNull(), position)).alias("value"))


def series(gold: DataFrame, tenant: str, pattern: str, rename: str, first: date, last: date) -> DataFrame:
    """Daily values of the metrics whose name matches, renamed by the groups of the pattern."""
    rows = metric_rows(gold, tenant, first, last).where(F.col("metric_name").rlike(pattern))
    return rows.select("date", F.regexp_replace("metric_name", pattern, rename).alias("series"), "value")


def legend_sums(points: DataFrame) -> DataFrame:
    return points.groupBy("series").agg(F.sum("value").alias("total"))


def with_threshold(df: DataFrame, value: Column, steps: list[tuple[float, str, bool]], name: str = "level") -> DataFrame:
    return df.withColumn(name, threshold_class(value, steps))


def newest_headers(headers: DataFrame, tenant: str, first: date, last: date, n: int = 10) -> DataFrame:
    rows = header_rows(headers, tenant, first, last)
    columns = ["conversation_id", "tenant_id", "customer_key", "channel_type", "started_at"]
    return rows.select(*columns).orderBy(F.desc("started_at"), F.desc("conversation_id")).limit(n)


def newest_metrics(gold: DataFrame, tenant: str, first: date, last: date, n: int = 100) -> DataFrame:
    rows = metric_rows(gold, tenant, first, last).select("tenant_id", "date", "metric_name", "value")
    return rows.orderBy(F.desc("date"), "metric_name").limit(n)


def sample_results(results: DataFrame, tenant: str, n: int = 10) -> DataFrame:
    rows = results.where(F.col("tenant_id") == tenant)
    columns = ["conversation_id", "operator_name", "schema_version", "received_at"]
    return rows.select(*columns).orderBy(*columns).limit(n)
