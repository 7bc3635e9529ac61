"""From fires to counter increments `(tenant_id, date, metric_name, inc)`.

All configured metrics come out of one pass: each row yields an array of
(metric_name, inc), which is expanded and summed. Increments that do not apply
are null array items, dropped right after the expansion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.config import Metric, MetricsConfig
from talktally.functions import variants as V
from talktally.functions.values import normalise, word_count
from talktally.operators.gates import counted, first_fire, gate, with_day

INCREMENTS = "array<struct<metric_name:string,inc:double>>"
KEYS = ("tenant_id", "date", "metric_name")


def _inc(name: Column | str, amount: Column | float = 1.0) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    amount = F.lit(amount) if isinstance(amount, float) else amount
    return F.struct(name.alias("metric_name"), amount.cast("double").alias("inc"))


def _named(prefix: str, suffix: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), suffix)


def emit_boolean(value: Column, tag: Column, m: Metric) -> Column:
    flag = F.try_variant_get(value, "$", "boolean")
    ok = V.is_boolean(tag)
    return F.array(F.when(ok & flag, _inc(f"{m.prefix}_count")), F.when(ok, _inc(f"{m.prefix}_total")))


def emit_number(value: Column, tag: Column, m: Metric) -> Column:
    if m.words:
        number = word_count(V.as_string(value)).cast("double")
        ok = V.is_string(tag)
    else:
        number = F.try_variant_get(value, "$", "double")
        ok = V.is_number(tag)
    if m.minimum is not None:
        ok = ok & (number >= F.lit(float(m.minimum)))
    if m.maximum is not None:
        ok = ok & (number <= F.lit(float(m.maximum)))
    parts = [F.when(ok, _inc(f"{m.prefix}_sum", number)), F.when(ok, _inc(f"{m.prefix}_count"))]
    if m.distribution:
        label = number.cast("bigint").cast("string") if m.words else V.number_text(value)
        parts.append(F.when(ok, _inc(_named(m.prefix, label))))
    return F.array(*parts)


def emit_category(value: Column, tag: Column, m: Metric) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.array(F.when(V.is_string(tag) & (text != ""), _inc(_named(m.prefix, normalise(text)))))


def emit_enum(value: Column, tag: Column, m: Metric) -> Column:
    text = F.try_variant_get(value, "$", "string")
    ok = V.is_string(tag)
    if m.ignore:
        ok = ok & ~text.isin(list(m.ignore))
    return F.array(F.when(ok, _inc(_named(m.prefix, normalise(text)))), F.when(ok, _inc(f"{m.prefix}_total")))


def category_items(value: Column, m: Metric) -> Column:
    """ARRAY<STRUCT<category, sub>>: items that are objects with a category text."""
    pairs = F.transform(
        V.items(value),
        lambda item: F.struct(
            _member(item, m.category_field).alias("category"),
            (_member(item, m.sub_field) if m.sub_field else F.lit(None).cast("string")).alias("sub"),
        ),
    )
    return F.filter(pairs, lambda p: p["category"].isNotNull())


def _member(item: Column, name: str) -> Column:
    return F.nullif(V.as_string(F.try_variant_get(item, f'$["{name}"]', "variant")), F.lit(""))


def emit_category_array(value: Column, tag: Column, m: Metric) -> Column:
    def increments(p: Column) -> Column:
        parts = [_inc(_named(m.prefix, normalise(p["category"])))]
        if m.sub_field and m.sub_prefix:
            both = normalise(F.concat(p["category"], F.lit(" - "), p["sub"]))
            parts.append(F.when(p["sub"].isNotNull(), _inc(_named(m.sub_prefix, both))))
        return F.array(*parts)

    return F.flatten(F.transform(category_items(value, m), increments))


EMITTERS = {
    "boolean": emit_boolean,
    "integer": emit_number,
    "number": emit_number,
    "category": emit_category,
    "enum": emit_enum,
    "category_array": emit_category_array,
}


def extracted(fires: DataFrame, cfg: MetricsConfig) -> tuple[DataFrame, list[tuple[Metric, str, str]]]:
    """Add one value and one type-tag column per configured metric.

    Both are null unless the row belongs to the metric's operator, so a row is
    only searched for its own operator's fields.
    """
    values, tags, plan = {}, {}, []
    for i, op in enumerate(cfg.operators):
        for j, m in enumerate(op.metrics):
            v, t = f"_v{i}_{j}", f"_t{i}_{j}"
            values[v] = F.when(counted(op), V.field(F.col("data"), m.field))
            tags[t] = V.tag(F.col(v))
            plan.append((m, v, t))
    return fires.withColumns(values).withColumns(tags), plan


def operator_count() -> Column:
    """Increment of `operator_<name>_count`, for every fire."""
    return _inc(F.concat(F.lit("operator_"), "operator_name", F.lit("_count")))


def with_increments(fires: DataFrame, cfg: MetricsConfig, always: list[Column] | None = None) -> DataFrame:
    """Add `increments` for rows of configured operators (expects `date`).

    `always` are increments every row gets.
    """
    rows, plan = extracted(fires, cfg)
    parts = [F.array(*always)] if always else []
    parts += [
        F.coalesce(EMITTERS[m.type](F.col(v), F.col(t), m), F.array().cast(INCREMENTS)) for m, v, t in plan
    ]
    for c in cfg.custom:
        hit = F.col("operator_name") == c.operator
        amount = F.when(hit, c.emit(F.col("data")))
        parts.append(F.array(F.when(amount.isNotNull(), _inc(c.name, amount))))
    joined = F.concat(*parts) if parts else F.array().cast(INCREMENTS)
    return rows.withColumn("increments", joined)


def expand(df: DataFrame) -> DataFrame:
    """One row per increment."""
    flat = df.select("tenant_id", "date", F.inline_outer("increments"))
    return flat.where(F.col("metric_name").isNotNull())


def emit(fires: DataFrame, cfg: MetricsConfig, time_col: str = "received_at") -> DataFrame:
    """Increments of the configured metrics, behind trigger and once-per-conversation gates; custom ones of every fire."""
    every_fire, first_only = cfg.split_once()
    dated = with_day(fires, time_col)
    rows = expand(with_increments(dated if cfg.custom else gate(dated, every_fire), every_fire))
    if not first_only.operators:
        return rows
    first = first_fire(with_increments(gate(dated, first_only), first_only), "increments")
    return rows.unionByName(expand(first))


def emit_operator_counts(fires: DataFrame, time_col: str = "received_at") -> DataFrame:
    """`operator_<name>_count`: one per fire, configured or not."""
    name = F.concat(F.lit("operator_"), "operator_name", F.lit("_count"))
    return with_day(fires, time_col).select("tenant_id", "date", name.alias("metric_name"), F.lit(1.0).alias("inc"))


def emit_conversation_counts(fires: DataFrame, time_col: str = "received_at") -> DataFrame:
    """`conversation_count`: one per conversation and day.

    Dedup first, then count: partial aggregation leaves one row per key and
    input partition before the shuffle.
    """
    seen = with_day(fires, time_col).select("tenant_id", "date", "conversation_id").distinct()
    return seen.select("tenant_id", "date", F.lit("conversation_count").alias("metric_name"), F.lit(1.0).alias("inc"))


# Timing fields, the counters they feed, and whether zero is skipped.
TIMING_COUNTERS = (
    ("handlingTimeSec", "handling_time"),
    ("avgResponseTimeSec", "response_time"),
    ("avgCustomerWaitTimeSec", "customer_wait_time"),
)
SENTENCE_COUNTERS = (
    ("sentenceCount", "sentence_count_total"),
    ("agentSentenceCount", "agent_sentence_count"),
    ("customerSentenceCount", "customer_sentence_count"),
)


def emit_timing(timed: DataFrame, grain: str = "transcript", time_col: str = "received_at") -> DataFrame:
    """Timing counters from rows with a `timing` struct.

    `transcript` counts each transcript once; `fire` counts every row, as a
    source that repeats the timing on each of a transcript's results would.
    """
    rows = with_day(timed.where(F.col("timing").isNotNull()), time_col)
    if grain == "transcript":
        first = F.min_by(F.struct("date", "timing"), F.struct(F.col(time_col)))
        rows = rows.groupBy("tenant_id", "transcript_sid").agg(first.alias("_first"))
        rows = rows.select("tenant_id", "_first.*")
    elif grain != "fire":
        raise ValueError("grain is 'transcript' or 'fire'")
    return expand(rows.withColumn("increments", timing_increments()))


def timing_increments() -> Column:
    """Increments of a row's `timing`."""
    parts = []
    for source, name in TIMING_COUNTERS:
        value = F.col(f"timing.{source}")
        parts += [F.when(value > 0, _inc(f"{name}_sum", value)), F.when(value > 0, _inc(f"{name}_count"))]
    for source, name in SENTENCE_COUNTERS:
        value = F.col(f"timing.{source}")
        parts.append(F.when(value.isNotNull(), _inc(name, value)))
    return F.array(*parts)


def emit_legacy_sentiment(fires: DataFrame, operator: str = "conversation-intelligence") -> DataFrame:
    """`sentiment_score_count`: fires of the bundled operator."""
    return (
        with_day(fires.where(F.col("operator_name") == operator))
        .select("tenant_id", "date", F.lit("sentiment_score_count").alias("metric_name"), F.lit(1.0).alias("inc"))
    )


def emit_all(fires: DataFrame, cfg: MetricsConfig, time_col: str = "received_at") -> DataFrame:
    """Every raw counter of the given fires.

    Payloads are read in one pass; operators counted once per conversation are read again,
    and only theirs. Conversation counts and timings need no payload.
    """
    dated = with_day(fires, time_col)
    every_fire, first_only = cfg.split_once()
    families = [
        expand(with_increments(dated, every_fire, [operator_count()])),
        emit_conversation_counts(fires, time_col),
    ]
    if first_only.operators:
        first = first_fire(with_increments(gate(dated, first_only), first_only), "increments")
        families.append(expand(first))
    if "timing" in fires.columns and "transcript_sid" in fires.columns:
        families.append(emit_timing(fires, time_col=time_col))
    return reduce(DataFrame.unionByName, families)
