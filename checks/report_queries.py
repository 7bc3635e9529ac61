"""The BI catalogue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks import inputs as I
from checks.base import query
from checks.silver_queries import stamp, stamp_sql
from talktally.functions import variants as V
from talktally.operators import emit, gold
from talktally.operators.derived import derive_all
from talktally.operators.results import apply_hook, operator_results
from talktally.plans import jobs, reports
from talktally.session import scratch_path
from talktally.sources import lake

FIRST, LAST = date(2024, 1, 3), date(2024, 1, 20)
RANGE = "tenant_id = 't1' AND date BETWEEN '20240103' AND '20240120'"
FROM, TO = date(1997, 1, 1), date(1997, 12, 31)
HEADER_RANGE = "tenant_id = 't1' AND started_at >= TIMESTAMP '1997-01-01' AND started_at < TIMESTAMP '1998-01-01'"
SHOWN = f"""WITH {I.FIRES_SQL}, shown AS (SELECT tenant_id, date, metric_name, value FROM g
  UNION ALL SELECT tenant_id, date, metric_name, value FROM daily)"""


def _family(spark, sf_dir, *operators: str, counts: bool = False):
    """Gold of the operators a report needs, with daily derived rows."""
    cfg = I.only(operators=operators)
    fires = I.fires(spark, sf_dir)
    increments = emit.emit(fires, cfg)
    if counts:
        increments = increments.unionByName(emit.emit_conversation_counts(fires))
    raw = gold.rollup(increments)
    return jobs.with_derived(raw, cfg.derived())


def _counts(spark, sf_dir):
    return gold.rollup(emit.emit_conversation_counts(I.fires(spark, sf_dir)))


@query(f"{SHOWN} SELECT metric_name, value FROM shown WHERE tenant_id = 't1' AND date = '20240105'")
def q_metrics_day(spark, sf_dir):
    rows = jobs.gold_of(I.fires(spark, sf_dir), I.config())
    return reports.metrics_of_day(rows, "t1", date(2024, 1, 5))


@query(f"{SHOWN} SELECT date, value FROM shown WHERE {RANGE} AND metric_name = 'score_avg'")
def q_trend(spark, sf_dir):
    return reports.trend(_family(spark, sf_dir, "click"), "t1", "score_avg", FIRST, LAST)


@query(
    f"""{SHOWN} SELECT date,
      sum(CASE WHEN metric_name = 'handoff_customer_request_rate_percent' THEN value END) AS customer_request_pct,
      sum(CASE WHEN metric_name = 'handoff_lack_of_knowledge_rate_percent' THEN value END) AS lack_of_knowledge_pct
    FROM shown WHERE {RANGE} AND metric_name IN ('handoff_customer_request_rate_percent', 'handoff_lack_of_knowledge_rate_percent') GROUP BY date"""
)
def q_pivot_reasons(spark, sf_dir):
    columns = {
        "handoff_customer_request_rate_percent": "customer_request_pct",
        "handoff_lack_of_knowledge_rate_percent": "lack_of_knowledge_pct",
    }
    return reports.pivot_metrics(_family(spark, sf_dir, "view", counts=True), "t1", columns, FIRST, LAST)


@query(
    f"""{SHOWN} SELECT metric_name, sum(value) AS hits FROM shown WHERE {RANGE} AND metric_name LIKE 'topic_%'
    GROUP BY metric_name ORDER BY hits DESC, metric_name LIMIT 20"""
)
def q_top_topics(spark, sf_dir):
    return reports.top_metrics(_family(spark, sf_dir, "purchase"), "t1", "topic_%", FIRST, LAST)


@query(
    f"""{SHOWN} SELECT CAST(substr(metric_name, 7) AS INTEGER) AS score, sum(value) AS responses FROM shown
    WHERE {RANGE} AND regexp_matches(metric_name, '^score_[0-9]+$') GROUP BY metric_name"""
)
def q_score_distribution(spark, sf_dir):
    return reports.score_distribution(_family(spark, sf_dir, "click"), "t1", "score_", FIRST, LAST)


@query(
    f"""{SHOWN} SELECT metric_name, round(avg(value), 6) AS avg_value FROM shown WHERE {RANGE} AND metric_name LIKE 's%_avg' GROUP BY metric_name"""
)
def q_kpi_avg(spark, sf_dir):
    rows = reports.metric_averages(_family(spark, sf_dir, "click", "error"), "t1", "s%_avg", FIRST, LAST)
    return rows.withColumn("avg_value", F.round("avg_value", 6))


@query(f"{SHOWN} SELECT sum(value) AS total FROM shown WHERE {RANGE} AND metric_name = 'conversation_count'")
def q_total_conversations(spark, sf_dir):
    return reports.total(_counts(spark, sf_dir), "t1", "conversation_count", FIRST, LAST)


@query(f"{SHOWN} SELECT round(avg(value), 6) AS mean_value FROM shown WHERE {RANGE} AND metric_name = 'retained_rate_percent'")
def q_mean_of_days(spark, sf_dir):
    rows = reports.mean_of_days(_family(spark, sf_dir, "click"), "t1", "retained_rate_percent", FIRST, LAST)
    return rows.withColumn("mean_value", F.round("mean_value", 6))


@query(
    f"""{SHOWN} SELECT strptime(date, '%Y%m%d')::DATE AS date, sum(value) AS conversation_count FROM shown
    WHERE {RANGE} AND metric_name = 'conversation_count' GROUP BY ALL"""
)
def q_daily_volume(spark, sf_dir):
    return reports.daily_volume(_counts(spark, sf_dir), "t1", FIRST, LAST)


@query(
    f"""{SHOWN} SELECT replace(metric_name, 'operator_', '') AS operator_name, sum(value) AS execution_count FROM shown
    WHERE {RANGE} AND metric_name LIKE 'operator_%_count' GROUP BY metric_name ORDER BY execution_count DESC, operator_name LIMIT 10"""
)
def q_top_operators(spark, sf_dir):
    rows = gold.rollup(emit.emit_operator_counts(I.fires(spark, sf_dir)))
    return reports.top_operators(rows, "t1", FIRST, LAST)


@query(
    f"""WITH {I.HEADERS_SQL} SELECT customer_key, count(*) AS conversation_count, {stamp_sql('max(started_at)', 'last_contact')}
    FROM h WHERE {HEADER_RANGE} GROUP BY customer_key ORDER BY conversation_count DESC, max(started_at) DESC, customer_key LIMIT 20"""
)
def q_top_customers(spark, sf_dir):
    rows = reports.top_customers(I.headers(spark, sf_dir), "t1", FROM, TO)
    return rows.select("customer_key", "conversation_count", stamp("last_contact"))


@query(f"WITH {I.HEADERS_SQL} SELECT customer_key, count(DISTINCT conversation_id) AS conversations FROM h WHERE {HEADER_RANGE} GROUP BY ALL")
def q_customers_distinct(spark, sf_dir):
    return reports.customers_by_conversations(I.headers(spark, sf_dir), "t1", FROM, TO)


@query(
    f"""WITH {I.HEADERS_SQL} SELECT conversation_id, {stamp_sql('h.started_at', 'started_at')}, customer_key, agent_id, channel_type, operator_count
    FROM h WHERE {HEADER_RANGE.replace('started_at', 'h.started_at')} ORDER BY h.started_at DESC, conversation_id DESC LIMIT 50"""
)
def q_recent(spark, sf_dir):
    rows = reports.recent_conversations(I.headers(spark, sf_dir), "t1", FROM, TO)
    return rows.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    f"""WITH {I.HEADERS_SQL} SELECT conversation_id, agent_id, team_id, queue_id, {stamp_sql('h.started_at', 'started_at')}, operator_count
    FROM h WHERE tenant_id = 't1' AND h.started_at::DATE = DATE '1997-06-15' ORDER BY h.started_at DESC, conversation_id DESC LIMIT 100"""
)
def q_conversations_of_day(spark, sf_dir):
    rows = reports.conversations_of_day(I.headers(spark, sf_dir), "t1", date(1997, 6, 15))
    return rows.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    f"""WITH {I.FIRES_SQL} SELECT conversation_id, {stamp_sql('p.ts', 'received_at')}, reason, k::VARCHAR AS score
    FROM p WHERE tenant_id = 't1' AND operator_name = 'view' ORDER BY p.ts DESC, conversation_id LIMIT 50"""
)
def q_payload_fields(spark, sf_dir):
    results = operator_results(apply_hook(I.fires(spark, sf_dir)))
    rows = reports.payload_fields(results, "t1", "view", ["reason", "score"])
    return rows.withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"WITH {I.HEADERS_SQL} SELECT channel_type, count(*) AS conversation_count FROM h WHERE {HEADER_RANGE} GROUP BY ALL")
def q_channel(spark, sf_dir):
    return reports.channel_distribution(I.headers(spark, sf_dir), "t1", FROM, TO)


def _contacts(spark, sf_dir):
    """Every event as a conversation of its own."""
    events = I.table(spark, sf_dir, "events")
    return events.select(
        I.text("t", F.col("user_id") % 3).alias("tenant_id"), F.col("event_id").alias("conversation_id"),
        F.col("ts").cast("timestamp").alias("started_at"),
    )


@query(
    """SELECT date_trunc('week', ts)::DATE AS week, extract(hour FROM ts)::INTEGER AS hour, count(*) AS conversations
    FROM events WHERE user_id % 3 = 1 GROUP BY ALL"""
)
def q_heatmap_week(spark, sf_dir):
    return reports.heatmap_week(_contacts(spark, sf_dir), "t1")


@query(
    """SELECT (extract(dow FROM ts) + 1)::INTEGER AS weekday, extract(hour FROM ts)::INTEGER AS hour, count(*) AS conversations
    FROM events WHERE user_id % 3 = 1 GROUP BY ALL"""
)
def q_heatmap_weekday(spark, sf_dir):
    return reports.heatmap_weekday(_contacts(spark, sf_dir), "t1")


@query(
    f"""{SHOWN}, s AS (
      SELECT metric_name, sum(value) FILTER (date > '20240115') AS current_value, sum(value) FILTER (date <= '20240115') AS previous_value
      FROM shown WHERE tenant_id = 't1' AND date BETWEEN '20240106' AND '20240125' AND metric_name IN ('conversation_count', 'operator_view_count')
      GROUP BY ALL)
    SELECT metric_name, current_value, previous_value,
      coalesce((current_value - previous_value) / nullif(previous_value, 0), 0) AS change_ratio FROM s"""
)
def q_period_change(spark, sf_dir):
    fires = I.fires(spark, sf_dir)
    rows = gold.rollup(emit.emit_operator_counts(fires).unionByName(emit.emit_conversation_counts(fires)))
    return reports.period_change(rows, "t1", ["conversation_count", "operator_view_count"], date(2024, 1, 25), 10)


@query(
    f"""{SHOWN} SELECT date, value, CASE WHEN value > 42 THEN 'green' WHEN value > 38 THEN 'yellow' WHEN value >= 0 THEN 'red' END AS level
    FROM shown WHERE {RANGE} AND metric_name = 'score_avg'"""
)
def q_thresholds(spark, sf_dir):
    rows = reports.trend(_family(spark, sf_dir, "click"), "t1", "score_avg", FIRST, LAST)
    return reports.with_threshold(rows, F.col("value"), [(42, "green", False), (38, "yellow", False), (0, "red", True)])


@query(
    f"""WITH {I.FIRES_SQL}, {I.period_sql(RANGE)} SELECT value FROM period WHERE metric_name = 'score_avg'"""
)
def q_stat_panel(spark, sf_dir):
    """The period value, which a panel picks as the last one."""
    raw = gold.rollup(emit.emit(I.fires(spark, sf_dir), I.only(operators=("click",))))
    rows = derive_all(reports.metric_rows(raw, "t1", FIRST, LAST), I.config().derived())
    return reports.stat_value(rows, "score_avg")


@query(
    f"""{SHOWN} SELECT date, 'CSAT ' || substr(metric_name, 7) AS series, value FROM shown
    WHERE {RANGE} AND regexp_matches(metric_name, '^score_[0-9]$')"""
)
def q_series(spark, sf_dir):
    return reports.series(_family(spark, sf_dir, "click"), "t1", r"^score_(\d)$", "CSAT $1", FIRST, LAST)


@query(
    f"""{SHOWN} SELECT substr(metric_name, 7) AS series, sum(value) AS total FROM shown
    WHERE {RANGE} AND metric_name LIKE 'topic|_%' ESCAPE '|' GROUP BY ALL"""
)
def q_legend(spark, sf_dir):
    return reports.legend_sums(reports.series(_family(spark, sf_dir, "purchase"), "t1", "^topic_(.*)", "$1", FIRST, LAST))


@query(
    f"""{SHOWN} SELECT tenant_id, date, metric_name, value FROM shown WHERE {RANGE} AND metric_name LIKE 'handoff%'
    ORDER BY date DESC, metric_name LIMIT 100"""
)
def q_newest_metrics(spark, sf_dir):
    rows = _family(spark, sf_dir, "view", counts=True).where(F.col("metric_name").startswith("handoff"))
    return reports.newest_metrics(rows, "t1", FIRST, LAST)


@query(
    f"""WITH {I.HEADERS_SQL} SELECT conversation_id, tenant_id, customer_key, channel_type, {stamp_sql('h.started_at', 'started_at')}
    FROM h WHERE {HEADER_RANGE.replace('started_at', 'h.started_at')} ORDER BY h.started_at DESC, conversation_id DESC LIMIT 10"""
)
def q_newest_headers(spark, sf_dir):
    rows = reports.newest_headers(I.headers(spark, sf_dir), "t1", FROM, TO)
    return rows.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    f"""WITH {I.FIRES_SQL} SELECT conversation_id, operator_name, 'v1' AS schema_version, {stamp_sql('p.ts', 'received_at')}
    FROM p WHERE tenant_id = 't1' ORDER BY conversation_id, operator_name, p.ts LIMIT 10"""
)
def q_sample_results(spark, sf_dir):
    rows = reports.sample_results(I.fires(spark, sf_dir), "t1")
    return rows.withColumn("received_at", F.date_format("received_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def key_value_dump(spark, sf_dir):
    """Conversations and counters in the exported single-table shape."""
    counters = gold.key_value_rows(gold.rollup(emit.emit_operator_counts(I.fires(spark, sf_dir))))
    heads = I.headers(spark, sf_dir)
    payload = F.struct(
        F.col("customer_key").alias("customerKey"), "channel", F.col("agent_id").alias("agentId"),
        F.col("operator_count").alias("operatorCount"),
    )
    second = F.date_format("started_at", "yyyyMMddHHmmss")
    conversations = heads.select(
        F.concat(F.lit("TENANT#"), "tenant_id", F.lit("#CONV")).alias("PK"),
        F.concat(F.lit("TS#"), second, F.lit("#CONV#"), "conversation_id").alias("SK"),
        F.col("conversation_id").alias("conversationId"), F.col("started_at").alias("startedAt"),
        F.lit("CONVERSATION").alias("entityType"), F.to_json(payload).alias("payload"),
    )
    return counters.unionByName(conversations, allowMissingColumns=True)


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, strptime(date, '%Y%m%d')::DATE AS date, metric_name, value AS metric_value
    FROM g WHERE metric_name LIKE 'operator%'"""
)
def metrics_clean_view(spark, sf_dir):
    return lake.metrics_clean(key_value_dump(spark, sf_dir))


@query(
    f"""WITH {I.HEADERS_SQL} SELECT tenant_id, conversation_id, customer_key, agent_id, {stamp_sql('h.started_at', 'started_at')},
      channel_type, operator_count FROM h"""
)
def conversations_clean_view(spark, sf_dir):
    rows = lake.conversations_clean(key_value_dump(spark, sf_dir))
    return rows.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, conversation_id, operator_name, 'v1' AS schema_version, k::DOUBLE AS score,
      reason FROM p"""
)
def operators_clean_view(spark, sf_dir):
    results = operator_results(apply_hook(I.fires(spark, sf_dir)))
    payload = F.to_json(F.struct(F.col("enriched_payload").alias("enrichedPayload"), F.col("display_fields").alias("displayFields")))
    dump = results.select(
        F.concat(F.lit("TENANT#"), "tenant_id", F.lit("#CONV#"), "conversation_id").alias("PK"),
        F.col("conversation_id").alias("conversationId"), F.col("operator_name").alias("operatorName"),
        F.col("schema_version").alias("schemaVersion"), F.col("received_at").alias("receivedAt"),
        F.lit("OPERATOR_RESULT").alias("entityType"), payload.alias("payload"),
    )
    rows = lake.operators_clean(dump)
    return rows.select(
        "tenant_id", "conversation_id", "operator_name", "schema_version",
        V.as_double(V.field(V.parse(F.col("enriched_payload")), "score")).alias("score"),
        F.get_json_object("display_fields", "$.reason").alias("reason"),
    )


# --- stored tables -------------------------------------------------------------------------


@query(
    f"""WITH {I.HEADERS_SQL} SELECT tenant_id, strftime(started_at, '%Y') AS year, strftime(started_at, '%m') AS month,
      strftime(started_at, '%d') AS day, conversation_id, customer_key, agent_id, operator_count
    FROM h WHERE tenant_id = 't1' AND started_at >= TIMESTAMP '1997-03-30' AND started_at < TIMESTAMP '1997-04-03'"""
)
def lake_conversations(spark, sf_dir):
    """All headers written to month partitions and read back over a few days."""
    path = scratch_path(spark, "conversations")
    heads = I.headers(spark, sf_dir).withColumn("created_at", F.col("started_at"))
    lake.write_partitions(lake.curated_conversations(heads), path, lake.GOLD_PARTITIONS, ("customer_key",))
    rows = reports.header_rows(lake.scan(spark, path, "conversations"), "t1", date(1997, 3, 30), date(1997, 4, 2))
    return rows.select("tenant_id", "year", "month", "day", "conversation_id", "customer_key", "agent_id", "operator_count")


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, date, metric_name, value FROM g WHERE metric_name LIKE 'operator%' AND {RANGE}"""
)
def lake_metrics_recompute(spark, sf_dir):
    """Gold written with wrong counters, whose days are then recomputed; the rest stays."""
    path = scratch_path(spark, "metrics")
    right = gold.rollup(emit.emit_operator_counts(I.fires(spark, sf_dir)))
    broken = F.col("date").between("20240110", "20240115")
    lake.write_metrics(right.withColumn("value", F.when(broken, F.col("value") + 1).otherwise(F.col("value"))), path)
    days = right.where(broken).select("tenant_id", "date").distinct()
    lake.replace_days(right.where(broken), days, path)
    return lake.scan_metrics(spark, path, "t1", FIRST, LAST).select("tenant_id", "date", "metric_name", "value")
