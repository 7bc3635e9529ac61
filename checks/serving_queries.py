"""Metrics and conversation endpoints, drill-down, view-driven tables and charts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from checks import inputs as I
from checks.base import query
from checks.silver_queries import stamp, stamp_sql
from talktally.functions import variants as V
from talktally.operators.index import by_index, operator_index
from talktally.plans import jobs, serve, views
from talktally.sources.enrichment import latest_enrichment, parse_enrichment

JANUARY = (date(2024, 1, 5), date(2024, 1, 14))


def metrics_sql(select: str, more: str = "") -> str:
    return f"""WITH {I.FIRES_SQL}, {I.period_sql("date BETWEEN '20240105' AND '20240114' AND tenant_id = 't1'")},
    shown AS (
      SELECT tenant_id, date, metric_name, value FROM g
      UNION ALL SELECT tenant_id, date, metric_name, value FROM daily)
    {select} {more}"""


@query(
    metrics_sql(
        """, rows AS (SELECT * FROM shown WHERE date BETWEEN '20240105' AND '20240114' AND tenant_id = 't1' UNION ALL SELECT * FROM period)
        SELECT tenant_id, CASE WHEN date = 'period' THEN date
          ELSE substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) || 'T00:00:00Z' END AS date,
          metric_name, value, '2024-01-05' AS period_from, '2024-01-14' AS period_to FROM rows"""
    )
)
def metrics_endpoint(spark, sf_dir):
    gold = jobs.gold_of(I.fires(spark, sf_dir), I.config())
    return serve.metrics(gold, I.config(), "t1", *JANUARY).drop("display_name")


@query(
    metrics_sql(
        """, rows AS (SELECT * FROM daily WHERE date BETWEEN '20240105' AND '20240114' AND tenant_id = 't1' UNION ALL SELECT * FROM period)
        SELECT tenant_id, CASE WHEN date = 'period' THEN date
          ELSE substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) || 'T00:00:00Z' END AS date,
          metric_name, value, 'Score Média' AS display_name FROM rows WHERE metric_name = 'score_avg'"""
    )
)
def metrics_endpoint_derived(spark, sf_dir):
    gold = jobs.gold_of(I.fires(spark, sf_dir), I.config())
    rows = serve.metrics(gold, I.config(), "t1", *JANUARY, metric="score_avg")
    return rows.drop("period_from", "period_to")


LISTED = "conversation_id, customer_key, agent_id, queue_id"


def list_sql(where: str, limit: int = 50) -> str:
    return f"""WITH {I.HEADERS_SQL} SELECT {LISTED}, {stamp_sql('started_at', 'started_at')} FROM h
    WHERE {where} ORDER BY h.started_at DESC, conversation_id DESC LIMIT {limit}"""


def _listed(rows):
    return rows.select("conversation_id", "customer_key", "agent_id", "queue_id", stamp("started_at"))


@query(list_sql("tenant_id = 't1' AND agent_id = '1-URGENT'"))
def list_by_agent(spark, sf_dir):
    tables = serve.Tables(I.headers(spark, sf_dir))
    return _listed(serve.conversations(tables, I.config(), "t1", {"agentId": "1-URGENT"}))


@query(list_sql("tenant_id = 't1' AND agent_id = '1-URGENT' AND queue_id = 'F' AND h.started_at >= TIMESTAMP '1997-02-01' AND h.started_at < TIMESTAMP '1998-03-02'", 500))
def list_filtered_range(spark, sf_dir):
    """Filters combine; the end day is included, and the page size is capped at 500."""
    tables = serve.Tables(I.headers(spark, sf_dir))
    params = {"agentId": "1-URGENT", "queueId": "F"}
    rows = serve.conversations(tables, I.config(), "t1", params, datetime(1997, 2, 1), date(1998, 3, 1), limit="900")
    return _listed(rows)


@query(list_sql("tenant_id = 't1' AND agent_id = '1-URGENT'", 500))
def list_first_filter_only(spark, sf_dir):
    tables = serve.Tables(I.headers(spark, sf_dir))
    params = {"agentId": "1-URGENT", "queueId": "F"}
    return _listed(serve.conversations(tables, I.config(), "t1", params, limit=500, exclusive=True))


@query(list_sql("tenant_id = 't1' AND (h.started_at, conversation_id) < (TIMESTAMP '1999-06-01', '5')", 25))
def list_page_after(spark, sf_dir):
    tables = serve.Tables(I.headers(spark, sf_dir))
    token = serve.page_token(datetime(1999, 6, 1), "5")
    return _listed(serve.conversations(tables, I.config(), "t1", limit=25, after=token))


EVENT_HEADERS_SQL = """c AS (
  SELECT tenant_id, conversation_id, max(ts) AS updated_at, min(ts) AS started_at, count(*)::INTEGER AS operator_count
  FROM p GROUP BY ALL)"""


@query(
    f"""WITH {I.FIRES_SQL}, {EVENT_HEADERS_SQL}
    SELECT c.tenant_id, c.conversation_id, operator_count FROM c
    WHERE EXISTS (SELECT 1 FROM items i WHERE i.tenant_id = c.tenant_id AND i.conversation_id = c.conversation_id
      AND operator_name = 'purchase' AND at_end AND cat = 'área_1')"""
)
def list_by_index(spark, sf_dir):
    """Every conversation of a category, found through the index."""
    fires = I.fires(spark, sf_dir)
    index = operator_index(fires, I.config())
    heads = fires.groupBy("tenant_id", "conversation_id").agg(F.count(F.lit(1)).cast("int").alias("operator_count"))
    return by_index(heads, index, "primary_topic", "ÁREA  1")


@query(
    f"""WITH {I.FIRES_SQL}, {EVENT_HEADERS_SQL}
    SELECT c.conversation_id, operator_count, {stamp_sql('started_at', 'started_at')} FROM c
    WHERE tenant_id = 't2' AND EXISTS (SELECT 1 FROM items i WHERE i.tenant_id = c.tenant_id AND i.conversation_id = c.conversation_id
      AND operator_name = 'purchase' AND at_end AND cat = 'área_2' AND sub = 'sub_2')
    ORDER BY c.started_at DESC, c.conversation_id DESC LIMIT 50"""
)
def list_by_index_pair(spark, sf_dir):
    """The list endpoint with a category and its sub-category."""
    fires = I.fires(spark, sf_dir)
    heads = fires.groupBy("tenant_id", "conversation_id").agg(
        F.min("received_at").alias("started_at"), F.count(F.lit(1)).cast("int").alias("operator_count")
    )
    tables = serve.Tables(heads, index=operator_index(fires, I.config()))
    params = {"primary_topic": "Área 2", "subtopic": "Sub 2"}
    rows = serve.conversations(tables, I.config(), "t2", params)
    return rows.select("conversation_id", "operator_count", stamp("started_at"))


@query(
    f"""WITH {I.FIRES_SQL}, a AS (
      SELECT tenant_id, conversation_id,
        arg_max(k, (operator_name, ts, event_id)) FILTER (operator_name = 'click')::DOUBLE AS score,
        arg_max(reason, (operator_name, ts, event_id)) FILTER (operator_name IN ('view', 'signup')) AS reason,
        arg_max(k % 4, (operator_name, ts, event_id)) FILTER (operator_name = 'purchase') AS topics
      FROM p WHERE operator_name <> 'error' GROUP BY ALL)
    SELECT tenant_id, conversation_id, score, reason, topics::INTEGER AS topics FROM a"""
)
def surface_fields(spark, sf_dir):
    rows = serve.surface_values(I.fires(spark, sf_dir), I.config())
    return rows.select(
        "tenant_id", "conversation_id", V.as_double(F.col("score")).alias("score"), V.as_string(F.col("reason")).alias("reason"),
        F.size(V.items(F.col("topics"))).alias("topics"),
    )


@query(
    f"""WITH {I.HEADERS_SQL}, {I.ENRICHMENT_SQL}
    SELECT conversation_id, operator_count, nation, 'v1' AS schema_version, l_linenumber AS result, l_quantity AS quantity
    FROM h LEFT JOIN lineitem ON l_orderkey::VARCHAR = conversation_id
    LEFT JOIN e ON e.tenant_id = h.tenant_id AND e.key = coalesce(call_sid, conversation_sid)
      AND e.kind = CASE WHEN call_sid IS NULL THEN 'CONV' ELSE 'CALL' END
    WHERE h.tenant_id = 't2'"""
)
def detail(spark, sf_dir):
    """Headers with each of their results, here the order's line items."""
    lines = I.table(spark, sf_dir, "lineitem")
    results = lines.select(
        F.lit("t2").alias("tenant_id"), F.col("l_orderkey").cast("string").alias("conversation_id"),
        F.lit("v1").alias("schema_version"), F.col("l_linenumber").alias("result"), F.col("l_quantity").alias("quantity"),
    )
    records = latest_enrichment(parse_enrichment(I.enrichment_posts(spark, sf_dir))[0])
    rows = serve.conversation_detail(I.headers(spark, sf_dir), results, "t2", enrichment=records)
    nation = V.text_at(F.col("enrichment"), "nation").alias("nation")
    version = F.coalesce("schema_version", F.lit("v1")).alias("schema_version")
    return rows.select("conversation_id", "operator_count", nation, version, "result", "quantity")


@query(
    f"""WITH {I.HEADERS_SQL}, {I.ENRICHMENT_SQL}
    SELECT h.conversation_id, tier, h.channel_type FROM h
    LEFT JOIN e ON e.tenant_id = h.tenant_id AND e.key = coalesce(call_sid, conversation_sid)
      AND e.kind = CASE WHEN call_sid IS NULL THEN 'CONV' ELSE 'CALL' END
    WHERE h.tenant_id = 't0' ORDER BY h.started_at DESC, h.conversation_id DESC LIMIT 50"""
)
def list_endpoint(spark, sf_dir):
    """A default page with late enrichment merged in."""
    records = latest_enrichment(parse_enrichment(I.enrichment_posts(spark, sf_dir))[0])
    tables = serve.Tables(I.headers(spark, sf_dir), enrichment=records)
    rows = serve.conversations(tables, I.config(), "t0", limit="many")
    return rows.select("conversation_id", V.text_at(F.col("enrichment"), "tier").alias("tier"), "channel_type")


# --- views ---------------------------------------------------------------------------------

VIEW = {
    "operatorName": "click",
    "schemaVersion": "v1",
    "table": {
        "columns": [
            {"field": "reason", "label": "Reason", "type": "badge"},
            {"field": "sentiment.score", "label": "Signed", "type": "number", "format": "+0.00"},
            {"field": "score", "label": "Percent", "type": "number", "format": "0%"},
        ]
    },
    "detail": {
        "sections": [
            {"title": "Overview", "fields": ["reason", "score"]},
            {"title": "Tags", "field": "topics", "type": "tag-list"},
            {"title": "Sentiment", "field": "sentiment", "type": "key-value-table"},
        ]
    },
    "charts": [
        {"type": "pie", "field": "reason", "title": "Reasons"},
        {"type": "bar", "field": "tags", "title": "Tags"},
        {"type": "line", "field": "points", "title": "Points"},
    ],
}


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, conversation_id, reason AS "Reason", '+' || k || '.00' AS "Signed", k || '00%' AS "Percent"
    FROM p WHERE operator_name = 'click' AND k > 0
    UNION ALL SELECT tenant_id, conversation_id, reason, '+0.00', '0%' FROM p WHERE operator_name = 'click' AND k = 0"""
)
def view_table(spark, sf_dir):
    return views.table_rows(I.fires(spark, sf_dir), VIEW)


@query(
    f"""WITH {I.FIRES_SQL}, c AS (SELECT * FROM p WHERE operator_name = 'click')
    SELECT section, key, value, count(*) AS n FROM (
      SELECT 'Overview' AS section, 'reason' AS key, reason AS value FROM c
      UNION ALL SELECT 'Overview', 'score', k::VARCHAR FROM c
      UNION ALL SELECT 'Tags', (j + 1)::VARCHAR, '[object Object]' FROM c, (VALUES (0), (1), (2)) AS s(j) WHERE j < k % 4
      UNION ALL SELECT 'Sentiment', 'score', k::VARCHAR FROM c
      UNION ALL SELECT 'Sentiment', 'label', CASE k % 3 WHEN 0 THEN '"positive"' WHEN 1 THEN '"neutral"' ELSE '"negative"' END FROM c)
    GROUP BY ALL"""
)
def view_detail(spark, sf_dir):
    rows = views.detail_rows(I.fires(spark, sf_dir), VIEW)
    return rows.groupBy("section", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def _charted(spark, sf_dir):
    """Order results with a tag list and time-stamped points from their line items.

    An order has at most seven line items by the data's definition.
    """
    lines = I.table(spark, sf_dir, "lineitem")
    point = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("l_quantity").alias("score"),
        F.col("l_returnflag").alias("flag"),
    )
    packed = lines.groupBy("l_orderkey").agg(F.collect_list(point).alias("points"), F.collect_list("l_linestatus").alias("tags"))
    data = F.struct("points", "tags", F.get("tags", F.lit(0)).alias("reason"))
    return packed.select(
        I.text("t", F.col("l_orderkey") % 2).alias("tenant_id"), F.lit("click").alias("operator_name"),
        F.lit("v1").alias("schema_version"), F.to_variant_object(data).alias("data"),
    )


@query(
    """SELECT 't' || (l_orderkey % 2) AS tenant_id, 'Tags' AS chart, l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY ALL"""
)
def chart_counts(spark, sf_dir):
    return views.chart_counts(_charted(spark, sf_dir), {**VIEW, "charts": VIEW["charts"][1:2]})


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, 'Reasons' AS chart, reason AS label, count(*) AS n FROM p WHERE operator_name = 'click' GROUP BY ALL"""
)
def chart_counts_scalar(spark, sf_dir):
    return views.chart_counts(I.fires(spark, sf_dir), VIEW)


@query(
    """SELECT 't' || (l_orderkey % 2) AS tenant_id, 'Points' AS chart, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS bucket,
      l_returnflag AS series, count(*) AS n, floor(sum(l_quantity) / count(*) * 100 + 0.5) / 100 AS value FROM lineitem GROUP BY ALL"""
)
def chart_timeline(spark, sf_dir):
    rows = views.chart_timeline(_charted(spark, sf_dir), VIEW, "MONTH", group_field="flag")
    return rows.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))
