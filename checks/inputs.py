"""The engine's inputs, derived from the given tables."""

from __future__ import annotations

from dataclasses import replace
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.config import MetricsConfig, parse_config
from talktally.functions import variants as V
from talktally.operators.normalize import TIMING_TYPE
from talktally.session import prepare


@cache
def config() -> MetricsConfig:
    return parse_config(Path(__file__).with_name("metrics.json").read_text())


def only(*types: str, operators: tuple[str, ...] = ()) -> MetricsConfig:
    """The configuration reduced to some metric types or operators."""
    kept = []
    for op in config().operators:
        if operators and op.name not in operators:
            continue
        metrics = tuple(m for m in op.metrics if not types or m.type in types)
        if metrics:
            kept.append(replace(op, metrics=metrics))
    return MetricsConfig(tuple(kept))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table of fewer files than cores; larger tables are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def choose(number: Column, *labels: str) -> Column:
    """Label by `number % len(labels)`; an empty label is null."""
    shown = F.array(*[F.lit(x or None) for x in labels])
    return F.get(shown, (number % len(labels)).cast("int"))


def payload(k: Column, event_id: Column) -> Column:
    slots = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: j < k % 4)
    topics = F.transform(
        slots,
        lambda j: F.struct(
            F.when((j < 2) | (k % 5 != 0), text("Área ", (k + j) % 3)).alias("primary_topic"),
            F.when(j % 2 == 0, text("Sub ", k % 3)).alias("subtopic"),
        ),
    )
    retained = F.when(event_id % 17 == 0, F.lit("true").cast("variant")).otherwise((k % 2 == 0).cast("variant"))
    return F.to_variant_object(
        F.struct(
            retained.alias("ai_retained"),
            k.alias("score"),
            text("Topic  ", k % 7).alias("label"),
            choose(k, "NONE", "CUSTOMER_REQUEST", "LACK OF KNOWLEDGE", "Early Transfer", "OTHER").alias("reason"),
            topics.alias("topics"),
            F.struct(k.alias("score"), choose(k, "positive", "neutral", "negative").alias("label")).alias("sentiment"),
            F.struct(F.trim(F.repeat(F.lit("word "), (k % 6).cast("int"))).alias("text")).alias("summary"),
        )
    )


def metadata(user: Column, k: Column) -> Column:
    channel = F.when(
        user % 2 == 0,
        F.to_variant_object(F.struct(F.lit("voice").alias("type"), F.struct(
            F.lit("LegRecording").alias("source"),
            F.struct(text("CA", user).alias("call_sid")).alias("reference_sids"),
        ).alias("media_properties"))),
    ).otherwise(F.lit("chat").cast("variant"))
    return F.to_variant_object(
        F.struct(
            text("u", user).alias("customerKey"),
            channel.alias("channel"),
            F.when(k % 5 != 0, text("agent", k % 5)).alias("agentId"),
            text("queue", k % 3).alias("queueId"),
        )
    )


def _event_columns(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return events.select("event_id", "ts", "user_id", "event_type", k)


def fires_of(events: DataFrame) -> DataFrame:
    """Fires from rows of the events table, batch or stream."""
    e = _event_columns(events)
    k, event_id, user = F.col("k"), F.col("event_id"), F.col("user_id")
    return e.select(
        text("t", user % 3).alias("tenant_id"),
        text("c", user).alias("conversation_id"),
        F.col("event_type").alias("operator_name"),
        F.lit(None).cast("string").alias("operator_type"),
        F.lit("v1").alias("schema_version"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.lit(None).cast("timestamp").alias("result_at"),
        F.lit("v3").alias("ci_version"),
        choose(event_id, "COMMUNICATION", "CONVERSATION_INACTIVE", "CONVERSATION_END", "").alias("trigger"),
        payload(k, event_id).alias("data"),
        metadata(user, k).alias("metadata"),
        F.lit(None).cast(TIMING_TYPE).alias("timing"),
        F.lit(None).cast("string").alias("transcript_sid"),
        text("e", F.lpad(event_id.cast("string"), 12, "0")).alias("source_uri"),
    )


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires_of(spread(table(spark, sf_dir, "events")))


# The same rows for DuckDB, from the columns.
FIRES_SQL = """
f AS (
  SELECT event_id, user_id, 't' || (user_id % 3) AS tenant_id, 'c' || user_id AS conversation_id,
         event_type AS operator_name, ts, strftime(ts, '%Y%m%d') AS date,
         CASE event_id % 4 WHEN 0 THEN 'COMMUNICATION' WHEN 1 THEN 'CONVERSATION_INACTIVE'
                           WHEN 2 THEN 'CONVERSATION_END' END AS trigger,
         CAST(props::JSON ->> 'k' AS INTEGER) AS k
  FROM events),
p AS (
  SELECT *, CASE WHEN event_id % 17 <> 0 THEN k % 2 = 0 END AS retained,
         'topic_' || (k % 7) AS label,
         CASE k % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'CUSTOMER_REQUEST' WHEN 2 THEN 'LACK OF KNOWLEDGE'
                    WHEN 3 THEN 'Early Transfer' ELSE 'OTHER' END AS reason,
         (trigger IS NULL OR trigger = 'CONVERSATION_END') AS at_end,
         (trigger IS NULL OR trigger <> 'COMMUNICATION') AS not_message
  FROM f),
items AS (
  SELECT p.*, j, 'área_' || ((k + j) % 3) AS cat, CASE WHEN j % 2 = 0 THEN 'sub_' || (k % 3) END AS sub
  FROM p, (VALUES (0), (1), (2)) AS slots(j)
  WHERE j < k % 4 AND (j < 2 OR k % 5 <> 0)),
first_fire AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, date, operator_name, conversation_id
                                 ORDER BY ts, event_id) AS rn
    FROM p WHERE operator_name = 'signup' AND not_message)
  WHERE rn = 1),
reason_name AS (SELECT * FROM (VALUES ('NONE', 'none'), ('CUSTOMER_REQUEST', 'customer_request'),
  ('LACK OF KNOWLEDGE', 'lack_of_knowledge'), ('Early Transfer', 'early_transfer'), ('OTHER', 'other')) AS r(reason, slug)),
raw AS (
  SELECT tenant_id, date, 'retained_count' AS metric_name, 1.0::DOUBLE AS inc FROM p WHERE operator_name = 'click' AND retained
  UNION ALL SELECT tenant_id, date, 'retained_total', 1 FROM p WHERE operator_name = 'click' AND retained IS NOT NULL
  UNION ALL SELECT tenant_id, date, 'buy_retained_count', 1 FROM p WHERE operator_name = 'purchase' AND at_end AND retained
  UNION ALL SELECT tenant_id, date, 'buy_retained_total', 1 FROM p WHERE operator_name = 'purchase' AND at_end AND retained IS NOT NULL
  UNION ALL SELECT tenant_id, date, 'score_sum', k FROM p WHERE operator_name = 'click' AND k BETWEEN 1 AND 80
  UNION ALL SELECT tenant_id, date, 'score_count', 1 FROM p WHERE operator_name = 'click' AND k BETWEEN 1 AND 80
  UNION ALL SELECT tenant_id, date, 'score_' || k, 1 FROM p WHERE operator_name = 'click' AND k BETWEEN 1 AND 80
  UNION ALL SELECT tenant_id, date, 'label_' || label, 1 FROM p WHERE operator_name = 'view'
  UNION ALL SELECT tenant_id, date, 'handoff_' || slug, 1 FROM p JOIN reason_name USING (reason) WHERE operator_name = 'view' AND reason <> 'NONE'
  UNION ALL SELECT tenant_id, date, 'handoff_total', 1 FROM p WHERE operator_name = 'view' AND reason <> 'NONE'
  UNION ALL SELECT tenant_id, date, 'topic_' || cat, 1 FROM items WHERE operator_name = 'purchase' AND at_end
  UNION ALL SELECT tenant_id, date, 'subtopic_' || cat || '_-_' || sub, 1 FROM items WHERE operator_name = 'purchase' AND at_end AND sub IS NOT NULL
  UNION ALL SELECT tenant_id, date, 'first_score_sum', k FROM first_fire
  UNION ALL SELECT tenant_id, date, 'first_score_count', 1 FROM first_fire
  UNION ALL SELECT tenant_id, date, 'first_reason_' || slug, 1 FROM first_fire JOIN reason_name USING (reason)
  UNION ALL SELECT tenant_id, date, 'first_reason_total', 1 FROM first_fire
  UNION ALL SELECT tenant_id, date, 'sentiment_score_sum', k FROM p WHERE operator_name = 'error'
  UNION ALL SELECT tenant_id, date, 'sentiment_score_count', 1 FROM p WHERE operator_name = 'error'
  UNION ALL SELECT tenant_id, date, 'summary_word_count_sum', k % 6 FROM p WHERE operator_name = 'error'
  UNION ALL SELECT tenant_id, date, 'summary_word_count_count', 1 FROM p WHERE operator_name = 'error'
  UNION ALL SELECT tenant_id, date, 'operator_' || operator_name || '_count', 1 FROM p
  UNION ALL SELECT tenant_id, date, 'conversation_count', count(DISTINCT conversation_id) FROM p GROUP BY ALL),
g AS (SELECT tenant_id, date, metric_name, sum(inc)::DOUBLE AS value FROM raw GROUP BY ALL),
defs AS (
  SELECT * FROM (VALUES
    ('retained_rate_percent', 'retained_count', 'retained_total', 100),
    ('buy_retained_rate_percent', 'buy_retained_count', 'buy_retained_total', 100),
    ('score_avg', 'score_sum', 'score_count', 1),
    ('first_score_avg', 'first_score_sum', 'first_score_count', 1),
    ('sentiment_score_avg', 'sentiment_score_sum', 'sentiment_score_count', 1),
    ('sentiment_avg', 'sentiment_score_sum', 'sentiment_score_count', 1),
    ('summary_word_count_avg', 'summary_word_count_sum', 'summary_word_count_count', 1),
    ('summary_avg_words', 'summary_word_count_sum', 'summary_word_count_count', 1),
    ('handoff_customer_request_rate_percent', 'handoff_customer_request', 'conversation_count', 100),
    ('handoff_lack_of_knowledge_rate_percent', 'handoff_lack_of_knowledge', 'conversation_count', 100),
    ('handoff_early_transfer_rate_percent', 'handoff_early_transfer', 'conversation_count', 100),
    ('first_reason_none_rate_percent', 'first_reason_none', 'first_reason_total', 100),
    ('first_reason_customer_request_rate_percent', 'first_reason_customer_request', 'first_reason_total', 100),
    ('first_reason_lack_of_knowledge_rate_percent', 'first_reason_lack_of_knowledge', 'first_reason_total', 100),
    ('first_reason_early_transfer_rate_percent', 'first_reason_early_transfer', 'first_reason_total', 100)
  ) AS d(name, numerator, denominator, scale)),
daily AS (
  SELECT n.tenant_id, n.date, d.name AS metric_name, floor(n.value / m.value * d.scale * 100 + 0.5) / 100 AS value
  FROM defs d JOIN g n ON n.metric_name = d.numerator
  JOIN g m ON m.metric_name = d.denominator AND m.tenant_id = n.tenant_id AND m.date = n.date
  WHERE m.value > 0)
"""


def period_sql(where: str = "TRUE") -> str:
    """Period rows over the days of `g` that satisfy a condition."""
    return f"""
    totals AS (SELECT tenant_id, metric_name, sum(value) AS value FROM g WHERE {where} GROUP BY ALL),
    period AS (
      SELECT n.tenant_id, 'period' AS date, d.name AS metric_name, floor(n.value / m.value * d.scale * 100 + 0.5) / 100 AS value
      FROM defs d JOIN totals n ON n.metric_name = d.numerator
      JOIN totals m ON m.metric_name = d.denominator AND m.tenant_id = n.tenant_id
      WHERE m.value > 0)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation headers from orders and their customers."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_custkey")
    channel = F.when(
        key % 2 == 0, V.parse(F.to_json(F.struct(F.col("c_mktsegment").alias("type"))))
    ).otherwise(F.col("c_mktsegment").cast("variant"))
    return rows.select(
        text("t", key % 3).alias("tenant_id"),
        F.col("o_orderkey").cast("string").alias("conversation_id"),
        key.cast("string").alias("customer_key"),
        channel.alias("channel"),
        V.channel_type(channel).alias("channel_type"),
        F.when((key % 2 == 0) & (key % 10 != 0), text("CA", key)).alias("call_sid"),
        F.when(key % 2 == 1, text("CH", F.col("c_nationkey"))).alias("conversation_sid"),
        F.col("o_orderpriority").alias("agent_id"),
        text("team", F.col("c_nationkey")).alias("team_id"),
        F.col("o_orderstatus").alias("queue_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("operator_count"),
    )


HEADERS_SQL = """
h AS (
  SELECT 't' || (o_custkey % 3) AS tenant_id, o_orderkey::VARCHAR AS conversation_id, o_custkey::VARCHAR AS customer_key,
         c_mktsegment AS channel_type, o_custkey AS ck, c_nationkey AS nk,
         CASE WHEN o_custkey % 2 = 0 AND o_custkey % 10 <> 0 THEN 'CA' || o_custkey END AS call_sid,
         CASE WHEN o_custkey % 2 = 1 THEN 'CH' || c_nationkey END AS conversation_sid,
         o_orderpriority AS agent_id, 'team' || c_nationkey AS team_id, o_orderstatus AS queue_id,
         o_orderdate AS started_at, (o_orderkey % 4 + 1)::INTEGER AS operator_count
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def phone(key: Column) -> Column:
    """A sip address for odd keys, a plain number for even ones, a short one for every fiftieth."""
    number = text("+55", F.lpad(key.cast("string"), 11, "0"))
    return (
        F.when(key % 50 == 0, text("12", key % 10))
        .when(key % 2 == 1, text("sip:", number, "@10.0.0.", key % 250, ";transport=udp"))
        .otherwise(number)
    )


def enrichment_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted enrichment: two per customer for some, one per nation, and malformed ones."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    versions = F.when(key % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    each = rows.withColumn("version", F.explode(versions))
    fields = F.when(key % 11 == 0, V.parse(F.lit("[1]"))).otherwise(
        V.parse(F.to_json(F.struct(
            F.col("n_name").alias("nation"), text("v", F.col("version")).alias("tier"), F.col("c_acctbal").alias("balance"),
        )))
    )
    by_call = each.select(
        text("t", key % 3).alias("tenant_id"),
        F.to_json(F.struct(text(" CA", key).alias("callSid"), fields.alias("fields"), F.lit("crm").alias("source"))).alias("post"),
        F.make_timestamp(F.lit(2024), F.lit(1), F.col("version"), F.lit(0), F.lit(0), F.lit(0)).alias("received_at"),
        text("post/", key, "/", F.col("version")).alias("source_uri"),
    )
    tenants = nation.withColumn("tenant_id", F.explode(F.array(F.lit("t0"), F.lit("t1"), F.lit("t2"))))
    by_conversation = tenants.select(
        "tenant_id",
        F.to_json(F.struct(
            F.lit("").alias("callSid"), text("CH", F.col("n_nationkey")).alias("conversationSid"),
            F.struct(F.col("n_name").alias("nation"), F.lit("conv").alias("tier")).alias("fields"),
        )).alias("post"),
        F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("received_at"),
        text("nation/", F.col("n_nationkey")).alias("source_uri"),
    )
    return by_call.unionByName(by_conversation).withColumn("body", V.parse(F.col("post"))).drop("post")


ENRICHMENT_SQL = """
e AS (
  SELECT 't' || (c_custkey % 3) AS tenant_id, 'CALL' AS kind, 'CA' || c_custkey AS key, n_name AS nation,
         CASE WHEN c_custkey % 3 = 0 THEN 'v2' ELSE 'v1' END AS tier, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 11 <> 0
  UNION ALL
  SELECT t, 'CONV', 'CH' || n_nationkey, n_name, 'conv', NULL FROM nation, (VALUES ('t0'), ('t1'), ('t2')) AS x(t))
"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript sentences from the turns of the conversations table; times as text."""
    turns = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 10 + F.length("text") % 7
    channel = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "user", 2).otherwise(3)
    return turns.select(
        text("t", F.col("conv_id") % 3).alias("tenant_id"),
        text("GT", F.col("conv_id")).alias("transcript_sid"),
        F.col("turn").cast("int").alias("sentence_index"),
        start.cast("string").alias("start_time"),
        (start + F.length("text") % 9).cast("string").alias("end_time"),
        channel.alias("media_channel"),
    )


SENTENCES_SQL = """
s AS (
  SELECT 't' || (conv_id % 3) AS tenant_id, 'GT' || conv_id AS transcript_sid, conv_id, turn AS idx,
         (turn * 10 + length(text) % 7)::DOUBLE AS st, (turn * 10 + length(text) % 7 + length(text) % 9)::DOUBLE AS en,
         CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS ch
  FROM conversations),
w AS (
  SELECT *, first_value(ch) OVER o AS agent, lead(st) OVER o AS nst, lead(ch) OVER o AS nch
  FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY st, idx, en, ch)),
roles AS (
  SELECT conv_id, arg_min(ch, (st, idx, en, ch)) FILTER (ch <> agent) AS customer FROM w GROUP BY conv_id),
timings AS (
  SELECT tenant_id, transcript_sid, conv_id,
         floor((arg_max(en, (st, idx, en, ch)) - min(st)) * 100 + 0.5) / 100 AS handling,
         coalesce(floor(avg(nst - en) FILTER (ch = customer AND nch = agent AND nst >= en) * 100 + 0.5) / 100, 0) AS response,
         coalesce(floor(avg(nst - en) FILTER (ch = agent AND nch = customer AND nst >= en) * 100 + 0.5) / 100, 0) AS wait,
         count(*) AS n, count(*) FILTER (ch = agent) AS agent_n, count(*) FILTER (ch = customer) AS customer_n
  FROM w JOIN roles USING (conv_id) GROUP BY ALL
  HAVING arg_max(en, (st, idx, en, ch)) - min(st) BETWEEN 0 AND 7200)
"""
