"""Counters, gates, derived metrics, names and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs as I
from checks.base import query
from talktally.config import MetricsConfig, Metric, Operator
from talktally.functions import variants as V
from talktally.operators import derived, emit, gold, naming, timing
from talktally.operators.gates import first_fire, gate, with_day
from talktally.plans import jobs

ROW = "tenant_id, date, metric_name, value"


def gold_sql(where: str) -> str:
    return f"WITH {I.FIRES_SQL} SELECT {ROW} FROM g WHERE {where}"


def _family(spark, sf_dir, *types: str, operators: tuple[str, ...] = ()) -> DataFrame:
    return gold.rollup(emit.emit(I.fires(spark, sf_dir), I.only(*types, operators=operators)))


@query(gold_sql("metric_name IN ('retained_count', 'retained_total', 'buy_retained_count', 'buy_retained_total')"))
def gold_boolean(spark, sf_dir):
    return _family(spark, sf_dir, "boolean")


@query(gold_sql("metric_name IN ('score_sum', 'score_count')"))
def gold_integer(spark, sf_dir):
    cfg = MetricsConfig((Operator("click", "Clicks", (Metric("integer", "score", "score", "Score", minimum=1, maximum=80),)),))
    return gold.rollup(emit.emit(I.fires(spark, sf_dir), cfg))


@query(gold_sql("regexp_matches(metric_name, '^score_([0-9]+|sum|count)$')"))
def gold_distribution(spark, sf_dir):
    return _family(spark, sf_dir, "integer", operators=("click",))


@query(gold_sql("metric_name LIKE 'label%'"))
def gold_category(spark, sf_dir):
    return _family(spark, sf_dir, "category")


@query(gold_sql("metric_name LIKE 'handoff%'"))
def gold_enum(spark, sf_dir):
    return _family(spark, sf_dir, "enum", operators=("view",))


@query(gold_sql("metric_name LIKE 'topic%' OR metric_name LIKE 'subtopic%'"))
def gold_category_array(spark, sf_dir):
    return _family(spark, sf_dir, "category_array")


@query(gold_sql("metric_name LIKE 'sentiment%' OR metric_name LIKE 'summary%'"))
def gold_nested_fields(spark, sf_dir):
    return _family(spark, sf_dir, operators=("error",))


@query(gold_sql("metric_name = 'conversation_count'"))
def gold_conversation_count(spark, sf_dir):
    return gold.rollup(emit.emit_conversation_counts(I.fires(spark, sf_dir)))


@query(gold_sql("metric_name LIKE 'operator%'"))
def gold_operator_count(spark, sf_dir):
    return gold.rollup(emit.emit_operator_counts(I.fires(spark, sf_dir)))


@query(f"WITH {I.FIRES_SQL} SELECT {ROW} FROM g UNION ALL SELECT {ROW} FROM daily")
def gold_all(spark, sf_dir):
    return jobs.gold_of(I.fires(spark, sf_dir), I.config())


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, date, 'sentiment_score_count' AS metric_name, count(*)::DOUBLE AS value
    FROM p WHERE operator_name = 'error' GROUP BY ALL"""
)
def gold_bundle_count(spark, sf_dir):
    return gold.rollup(emit.emit_legacy_sentiment(I.fires(spark, sf_dir), "error"))


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, date, 'high_scores' AS metric_name, count(*)::DOUBLE AS value
    FROM p WHERE operator_name = 'view' AND k > 50 GROUP BY ALL"""
)
def gold_custom_metric(spark, sf_dir):
    score = lambda data: V.as_double(V.field(data, "score"))
    cfg = MetricsConfig().with_metric("high_scores", "view", lambda data: F.when(score(data) > 50, 1.0))
    return gold.rollup(emit.emit(I.fires(spark, sf_dir), cfg))


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, operator_name, coalesce(trigger, 'none') AS fired_on, count(*) AS fires
    FROM p WHERE operator_name IN ('click', 'view', 'error') OR (operator_name = 'purchase' AND at_end)
       OR (operator_name = 'signup' AND not_message) GROUP BY ALL"""
)
def gate_trigger(spark, sf_dir):
    passed = gate(I.fires(spark, sf_dir), I.config())
    fired_on = F.coalesce("trigger", F.lit("none")).alias("fired_on")
    return passed.groupBy("tenant_id", "operator_name", fired_on).agg(F.count(F.lit(1)).alias("fires"))


@query(
    f"""WITH {I.FIRES_SQL} SELECT tenant_id, date, operator_name, conversation_id,
    'e' || lpad(event_id::VARCHAR, 12, '0') AS source_uri FROM first_fire"""
)
def gate_dedup(spark, sf_dir):
    passed = with_day(gate(I.fires(spark, sf_dir), I.only(operators=("signup",))))
    return first_fire(passed, "source_uri")


@query(f"WITH {I.FIRES_SQL} SELECT {ROW} FROM daily")
def derived_daily(spark, sf_dir):
    raw = gold.rollup(emit.emit_all(I.fires(spark, sf_dir), I.config()))
    return derived.derive(raw, I.config().derived())


@query(f"WITH {I.FIRES_SQL}, {I.period_sql()} SELECT {ROW} FROM period")
def derived_period(spark, sf_dir):
    raw = gold.rollup(emit.emit_all(I.fires(spark, sf_dir), I.config()))
    return derived.derive_period(raw, I.config().derived())


LABEL_SQL = """
CASE
  WHEN metric_name = 'retained_count' THEN 'Retained' WHEN metric_name = 'retained_total' THEN 'Retained (Total)'
  WHEN metric_name = 'retained_rate_percent' THEN 'Retained (%)'
  WHEN metric_name = 'buy_retained_count' THEN 'Retained on purchase'
  WHEN metric_name = 'buy_retained_total' THEN 'Retained on purchase (Total)'
  WHEN metric_name = 'buy_retained_rate_percent' THEN 'Retained on purchase (%)'
  WHEN metric_name = 'score_sum' THEN 'Score (Soma)' WHEN metric_name = 'score_count' THEN 'Score (Contagem)'
  WHEN metric_name = 'score_avg' THEN 'Score Média'
  WHEN regexp_matches(metric_name, '^score_[0-9]+$') THEN 'Score ' || substr(metric_name, 7)
  WHEN metric_name = 'first_score_sum' THEN 'First score (Soma)' WHEN metric_name = 'first_score_count' THEN 'First score (Contagem)'
  WHEN metric_name = 'first_score_avg' THEN 'First score Média'
  WHEN metric_name = 'sentiment_score_sum' THEN 'Sentiment (Soma)' WHEN metric_name = 'sentiment_score_count' THEN 'Sentiment (Contagem)'
  WHEN metric_name = 'sentiment_score_avg' THEN 'Sentiment Média'
  WHEN metric_name = 'summary_word_count_sum' THEN 'Words (Soma)' WHEN metric_name = 'summary_word_count_count' THEN 'Words (Contagem)'
  WHEN metric_name = 'summary_word_count_avg' THEN 'Words Média'
  WHEN metric_name = 'handoff_total' THEN 'Handoff (Total)'
  WHEN metric_name = 'handoff_customer_request' THEN 'Handoff: Asked by customer'
  WHEN metric_name = 'handoff_lack_of_knowledge' THEN 'Handoff: Lack Of Knowledge'
  WHEN metric_name = 'handoff_early_transfer' THEN 'Handoff: Early Transfer'
  WHEN metric_name = 'handoff_customer_request_rate_percent' THEN 'Handoff: Asked by customer (%)'
  WHEN metric_name = 'handoff_lack_of_knowledge_rate_percent' THEN 'Handoff: Lack Of Knowledge (%)'
  WHEN metric_name = 'handoff_early_transfer_rate_percent' THEN 'Handoff: Early Transfer (%)'
  WHEN metric_name = 'first_reason_total' THEN 'First reason (Total)'
  WHEN metric_name = 'first_reason_none' THEN 'First reason: None'
  WHEN metric_name = 'first_reason_customer_request' THEN 'First reason: Customer Request'
  WHEN metric_name = 'first_reason_lack_of_knowledge' THEN 'First reason: Lack Of Knowledge'
  WHEN metric_name = 'first_reason_early_transfer' THEN 'First reason: Early Transfer'
  WHEN metric_name = 'first_reason_none_rate_percent' THEN 'First reason: None (%)'
  WHEN metric_name = 'first_reason_customer_request_rate_percent' THEN 'First reason: Customer Request (%)'
  WHEN metric_name = 'first_reason_lack_of_knowledge_rate_percent' THEN 'First reason: Lack Of Knowledge (%)'
  WHEN metric_name = 'first_reason_early_transfer_rate_percent' THEN 'First reason: Early Transfer (%)'
  WHEN metric_name LIKE 'label|_topic|_%' ESCAPE '|' THEN 'Topic ' || substr(metric_name, 13)
  WHEN starts_with(metric_name, 'topic_') THEN 'Área ' || substr(metric_name, 12)
  WHEN starts_with(metric_name, 'subtopic_') THEN 'Área ' || substr(metric_name, 15, 1) || ' - Sub ' || substr(metric_name, 23)
  WHEN metric_name = 'conversation_count' THEN 'Conversas'
  WHEN metric_name = 'sentiment_avg' THEN 'Sentimento Média'
  ELSE metric_name END
"""


@query(
    f"""WITH {I.FIRES_SQL}, names AS (SELECT DISTINCT metric_name FROM (SELECT metric_name FROM g UNION SELECT metric_name FROM daily))
    SELECT metric_name, {LABEL_SQL} AS display_name FROM names"""
)
def display_names(spark, sf_dir):
    names = jobs.gold_of(I.fires(spark, sf_dir), I.config()).select("metric_name").distinct()
    return naming.with_display_names(names, I.config())


TIMING_ROW = """tenant_id, transcript_sid, handling AS "handlingTimeSec", response AS "avgResponseTimeSec",
wait AS "avgCustomerWaitTimeSec", n AS "sentenceCount", agent_n AS "agentSentenceCount", customer_n AS "customerSentenceCount" """


def _timings(spark, sf_dir, **options):
    return timing.timing(timing.typed_sentences(I.sentences(spark, sf_dir)), **options)


@query(f"WITH {I.SENTENCES_SQL} SELECT {TIMING_ROW} FROM timings")
def timing_by_transcript(spark, sf_dir):
    return _timings(spark, sf_dir)


@query(f"WITH {I.SENTENCES_SQL} SELECT {TIMING_ROW} FROM timings")
def timing_split_transcripts(spark, sf_dir):
    """The path of very long transcripts, taken here from six sentences on."""
    return _timings(spark, sf_dir, hot_rows=6, ranges=16)


def _timed_results(spark, sf_dir):
    """Two results per transcript, arriving on one of thirty days, all with its timing."""
    timed = timing.as_struct(_timings(spark, sf_dir))
    number = F.substring("transcript_sid", 3, 20).cast("bigint")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (number % 30).cast("int")).cast("timestamp")
    return timed.withColumn("received_at", day).withColumn("operator_name", F.explode(F.array(F.lit("a"), F.lit("b"))))


def timing_daily_sql(times: int) -> str:
    return f"""WITH {I.SENTENCES_SQL},
    d AS (SELECT *, strftime(DATE '2024-01-01' + (conv_id % 30)::INTEGER, '%Y%m%d') AS date FROM timings),
    m AS (
      SELECT tenant_id, date, 'handling_time_sum' AS metric_name, handling AS inc FROM d WHERE handling > 0
      UNION ALL SELECT tenant_id, date, 'handling_time_count', 1 FROM d WHERE handling > 0
      UNION ALL SELECT tenant_id, date, 'response_time_sum', response FROM d WHERE response > 0
      UNION ALL SELECT tenant_id, date, 'response_time_count', 1 FROM d WHERE response > 0
      UNION ALL SELECT tenant_id, date, 'customer_wait_time_sum', wait FROM d WHERE wait > 0
      UNION ALL SELECT tenant_id, date, 'customer_wait_time_count', 1 FROM d WHERE wait > 0
      UNION ALL SELECT tenant_id, date, 'sentence_count_total', n FROM d
      UNION ALL SELECT tenant_id, date, 'agent_sentence_count', agent_n FROM d
      UNION ALL SELECT tenant_id, date, 'customer_sentence_count', customer_n FROM d)
    SELECT tenant_id, date, metric_name, round(sum(inc) * {times}, 2)::DOUBLE AS value FROM m GROUP BY ALL"""


@query(timing_daily_sql(1))
def timing_daily(spark, sf_dir):
    return gold.rollup(emit.emit_timing(_timed_results(spark, sf_dir)))


@query(timing_daily_sql(2))
def timing_daily_per_result(spark, sf_dir):
    return gold.rollup(emit.emit_timing(_timed_results(spark, sf_dir), grain="fire"))


DOCUMENT_CONFIG = MetricsConfig(
    (
        Operator(
            "quality",
            "Quality",
            (
                Metric("boolean", "quality", "good", "Good"),
                Metric("boolean", "toxic", "toxic", "Toxic"),
                Metric("enum", "lang", "lang", "Language", values=("en", "fr", "de", "es")),
                Metric("category", "source", "source", "Source"),
                Metric("integer", "text", "words", "Words", words=True),
            ),
        ),
    )
)


@query(
    """WITH d AS (
      SELECT 't' || (doc_id % 3) AS tenant_id, text, lang, source, quality, toxic,
             len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS words
      FROM documents LEFT JOIN labels USING (doc_id)),
    m AS (
      SELECT tenant_id, 'good_count' AS metric_name, 1 AS inc FROM d WHERE quality = 1
      UNION ALL SELECT tenant_id, 'good_total', 1 FROM d WHERE quality IS NOT NULL
      UNION ALL SELECT tenant_id, 'toxic_count', 1 FROM d WHERE toxic = 1
      UNION ALL SELECT tenant_id, 'toxic_total', 1 FROM d WHERE toxic IS NOT NULL
      UNION ALL SELECT tenant_id, 'lang_' || lang, 1 FROM d WHERE lang IS NOT NULL
      UNION ALL SELECT tenant_id, 'lang_total', 1 FROM d WHERE lang IS NOT NULL
      UNION ALL SELECT tenant_id, 'source_' || source, 1 FROM d WHERE source <> ''
      UNION ALL SELECT tenant_id, 'words_sum', words FROM d WHERE text IS NOT NULL
      UNION ALL SELECT tenant_id, 'words_count', 1 FROM d WHERE text IS NOT NULL)
    SELECT tenant_id, '20240101' AS date, metric_name, sum(inc)::DOUBLE AS value FROM m GROUP BY ALL"""
)
def document_metrics(spark, sf_dir):
    docs = I.spread(I.table(spark, sf_dir, "documents")).join(I.table(spark, sf_dir, "labels"), "doc_id", "left")
    payload = F.struct(
        (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"), "lang", "source", "text"
    )
    rows = docs.select(
        I.text("t", F.col("doc_id") % 3).alias("tenant_id"),
        F.col("doc_id").cast("string").alias("conversation_id"),
        F.lit("quality").alias("operator_name"),
        F.lit(None).cast("string").alias("trigger"),
        F.lit("2024-01-01").cast("timestamp").alias("received_at"),
        F.col("doc_id").cast("string").alias("source_uri"),
        V.parse(F.to_json(payload)).alias("data"),
    )
    return gold.rollup(emit.emit(rows, DOCUMENT_CONFIG))


@query(
    f"""WITH {I.FIRES_SQL},
    o AS (SELECT * FROM g WHERE metric_name LIKE 'operator%'),
    n AS (SELECT tenant_id, date, 'operator_' || operator_name || '_count' AS metric_name, count(*)::DOUBLE AS value
          FROM p WHERE trigger IS NOT NULL OR operator_name <> 'view' GROUP BY ALL)
    SELECT tenant_id, date, metric_name, o.value AS old_value, n.value AS new_value,
           CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM o FULL JOIN n USING (tenant_id, date, metric_name) WHERE o.value IS DISTINCT FROM n.value"""
)
def backfill_diff(spark, sf_dir):
    """Counters now against counters without the untriggered views."""
    fires = I.fires(spark, sf_dir)
    old = gold.rollup(emit.emit_operator_counts(fires))
    kept = fires.where(F.col("trigger").isNotNull() | (F.col("operator_name") != "view"))
    return gold.diff(old, gold.rollup(emit.emit_operator_counts(kept)))


@query(
    f"""WITH {I.FIRES_SQL}
    SELECT 'TENANT#' || tenant_id || '#AGG#DAY' AS "PK", 'DAY#' || date || '#METRIC#' || metric_name AS "SK",
           tenant_id AS "tenantId", date, metric_name AS "metricName", 'AGGREGATE' AS "entityType", value
    FROM g WHERE metric_name LIKE 'operator%'"""
)
def key_value_rows(spark, sf_dir):
    rows = gold.key_value_rows(gold.rollup(emit.emit_operator_counts(I.fires(spark, sf_dir))))
    return rows.withColumn("value", F.get_json_object("payload", "$.value").cast("double")).drop("payload")


@query(f"WITH {I.FIRES_SQL} SELECT tenant_id, count(*) AS scanned FROM g WHERE metric_name LIKE 'operator%' GROUP BY ALL")
def copy_dry_run(spark, sf_dir):
    return gold.copy_counts(gold.rollup(emit.emit_operator_counts(I.fires(spark, sf_dir))))


@query(f"WITH {I.FIRES_SQL} SELECT DISTINCT tenant_id, metric_name FROM g WHERE metric_name LIKE 'handoff%'")
def metric_discovery(spark, sf_dir):
    return gold.metric_names_in(_family(spark, sf_dir, "enum", operators=("view",)))
