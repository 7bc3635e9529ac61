"""Primitives, gates, derived metrics, names."""

from datetime import date, datetime, timedelta

import pytest
from helpers import DAY, as_dict, fire, fires, gold
from pyspark.sql import functions as F

from talktally.config import ConfigError, MetricsConfig, Operator, Metric, parse_config, parse_tenants
from talktally.operators import emit
from talktally.operators.derived import derive, derive_all, derive_period, with_derived
from talktally.operators.gold import diff, rollup
from talktally.operators.naming import with_display_names
from talktally.plans import jobs, serve

CONFIG = """{"version": "1.0", "operators": [{"operatorName": "test", "operatorSid": "LY1", "displayName": "Test", "metrics": [
  {"field": "passed", "type": "boolean", "metricPrefix": "test_passed", "displayName": "Passed"},
  {"field": "score", "type": "integer", "metricPrefix": "test_score", "displayName": "Score", "min": 1, "max": 10, "distribution": true, "surfaceInList": true},
  {"field": "label", "type": "category", "metricPrefix": "test_label", "displayName": "Label"},
  {"field": "status", "type": "enum", "metricPrefix": "test_status", "displayName": "Status", "values": ["ACTIVE", "ON HOLD", "NONE"],
   "ignoreValues": ["NONE"], "valueDisplayNames": {"ACTIVE": "Ativo"}, "rateDenominator": "conversation_count", "surfaceInList": true},
  {"field": "topics", "type": "category_array", "metricPrefix": "test_topic", "displayName": "Topic", "categoryField": "primary_topic",
   "subcategoryField": "subtopic", "subcategoryPrefix": "test_subtopic", "surfaceInList": true},
  {"field": "deep.list.1.n", "type": "number", "metricPrefix": "test_deep", "displayName": "Deep"}]}]}"""


@pytest.fixture(scope="module")
def cfg():
    return parse_config(CONFIG)


def counted(spark, cfg, *rows):
    return as_dict(rollup(emit.emit(fires(spark, *rows), cfg)), "metric_name", "value")


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ({"passed": True}, {"test_passed_count": 1, "test_passed_total": 1}),
        ({"passed": False}, {"test_passed_total": 1}),
        ({"passed": "true"}, {}),
        ({"passed": 1}, {}),
        ({"score": 8}, {"test_score_sum": 8, "test_score_count": 1, "test_score_8": 1}),
        ({"score": 8.0}, {"test_score_sum": 8, "test_score_count": 1, "test_score_8": 1}),
        ({"score": 4.5}, {"test_score_sum": 4.5, "test_score_count": 1, "test_score_4.5": 1}),
        ({"score": 1}, {"test_score_sum": 1, "test_score_count": 1, "test_score_1": 1}),
        ({"score": 0}, {}),
        ({"score": 11}, {}),
        ({"score": "4"}, {}),
        ({"score": None}, {}),
        ({"label": "Renda  Fixa X"}, {"test_label_renda_fixa_x": 1}),
        ({"label": ""}, {}),
        ({"label": 3}, {}),
        ({"status": "ACTIVE"}, {"test_status_active": 1, "test_status_total": 1}),
        ({"status": "NONE"}, {}),
        ({"status": "none"}, {"test_status_none": 1, "test_status_total": 1}),
        ({"status": 5}, {}),
        (
            {"topics": [{"primary_topic": "RENDA FIXA", "subtopic": "RESGATE"}, {"primary_topic": "POUPANÇA", "subtopic": "RENTABILIDADE"}]},
            {"test_topic_renda_fixa": 1, "test_topic_poupança": 1, "test_subtopic_renda_fixa_-_resgate": 1, "test_subtopic_poupança_-_rentabilidade": 1},
        ),
        ({"topics": [{"subtopic": "X"}, {"primary_topic": "A"}, "x", None, {"primary_topic": 4}]}, {"test_topic_a": 1}),
        ({"topics": [{"primary_topic": "A"}, {"primary_topic": "a"}]}, {"test_topic_a": 2}),
        ({"topics": {"primary_topic": "A"}}, {}),
        ({"topics": []}, {}),
        ({"deep": {"list": [{}, {"n": 2}]}}, {"test_deep_sum": 2, "test_deep_count": 1}),
        ({"deep": {"list": {"1": {"n": 3}}}}, {"test_deep_sum": 3, "test_deep_count": 1}),
        ({"deep": 7}, {}),
    ],
)
def test_primitives(spark, cfg, payload, expected):
    assert counted(spark, cfg, fire(payload)) == expected


def test_operator_by_name_or_sid_only(spark, cfg):
    rows = [fire({"passed": True}, operator=o) for o in ("test", "LY1", "other")]
    assert counted(spark, cfg, *rows) == {"test_passed_count": 2, "test_passed_total": 2}


def gated(triggers=None, once=False):
    return MetricsConfig((Operator("test", "T", (Metric("boolean", "passed", "p", "P"),), triggers=triggers, once_per_conversation=once),))


def test_trigger_list_passes_missing_trigger(spark):
    cfg = gated(("CONVERSATION_END",))
    rows = [fire({"passed": True}, trigger=t) for t in ("CONVERSATION_END", "COMMUNICATION", None, "")]
    assert counted(spark, cfg, *rows)["p_total"] == 3


def test_once_per_conversation_and_day(spark):
    cfg = gated(once=True)
    rows = [
        fire({"passed": False}, at=DAY + timedelta(seconds=5), uri="b"),
        fire({"passed": True}, at=DAY, uri="a"),
        fire({"passed": True}, conversation="c2"),
        fire({"passed": True}, at=DAY + timedelta(days=1)),
    ]
    got = {(r.date, r.metric_name): r.value for r in rollup(emit.emit(fires(spark, *rows), cfg)).collect()}
    assert got == {
        ("20260127", "p_count"): 2, ("20260127", "p_total"): 2, ("20260128", "p_count"): 1, ("20260128", "p_total"): 1,
    }


def test_blocked_trigger_uses_no_slot(spark):
    cfg = gated(("CONVERSATION_END",), once=True)
    rows = [
        fire({"passed": False}, trigger="COMMUNICATION", at=DAY, uri="a"),
        fire({"passed": True}, trigger="CONVERSATION_END", at=DAY + timedelta(seconds=1), uri="b"),
    ]
    assert counted(spark, cfg, *rows) == {"p_count": 1, "p_total": 1}


def test_conversation_and_operator_counts(spark, cfg):
    rows = [fire({}, operator="a b"), fire({}, operator="x"), fire({}, conversation="c2", operator="x")]
    got = as_dict(rollup(emit.emit_all(fires(spark, *rows), cfg)), "metric_name", "value")
    assert got == {"conversation_count": 2, "operator_a b_count": 1, "operator_x_count": 2}


def test_arrival_day_or_chosen_time(spark, cfg):
    rows = fires(spark, fire({"passed": True}, at=datetime(2026, 1, 27, 23, 59, 59)))
    rows = rows.withColumn("result_at", F.lit("2026-02-01").cast("timestamp"))
    assert {r.date for r in emit.emit(rows, cfg).collect()} == {"20260127"}
    assert {r.date for r in emit.emit(rows, cfg, "result_at").collect()} == {"20260201"}


@pytest.mark.parametrize(
    ("rows", "name", "value"),
    [
        ([("sentiment_score_sum", 750), ("sentiment_score_count", 10)], "sentiment_avg", 75),
        ([("handling_time_sum", 600), ("handling_time_count", 5)], "avg_handling_time_sec", 120),
        ([("customer_wait_time_sum", 20), ("customer_wait_time_count", 8)], "avg_customer_wait_time_sec", 2.5),
        ([("human_agent_transfers", 3), ("conversation_count", 10)], "transfer_rate_percent", 30),
        ([("test_status_active", 1), ("conversation_count", 3)], "test_status_active_rate_percent", 33.33),
    ],
)
def test_derived(spark, cfg, rows, name, value):
    table = gold(spark, *[("20260127", n, v) for n, v in rows])
    assert as_dict(derive(table, cfg.derived()), "metric_name", "value") == {name: value}


def test_no_rate_without_both_counters_or_with_zero(spark, cfg):
    table = gold(spark, ("20260127", "test_passed_total", 5), ("20260127", "handling_time_sum", 5), ("20260127", "handling_time_count", 0))
    assert derive(table, cfg.derived()).count() == 0


def test_halves_round_up_also_below_zero(spark, cfg):
    table = gold(spark, ("20260127", "test_score_sum", -1), ("20260127", "test_score_count", 8))
    assert as_dict(derive(table, cfg.derived()), "metric_name", "value") == {"test_score_avg": -0.12}


def test_period_is_sum_then_divide(spark, cfg):
    table = gold(
        spark,
        *[("20260127", n, v) for n, v in (("test_passed_count", 1), ("test_passed_total", 1))],
        *[("20260128", n, v) for n, v in (("test_passed_count", 1), ("test_passed_total", 9))],
    )
    assert as_dict(derive_period(table, cfg.derived()), "date", "value") == {"period": 20}
    assert as_dict(derive_all(table, cfg.derived()), "date", "value") == {"period": 20, "20260127": 100, "20260128": 11.11}


def test_with_derived_equals_union(spark, cfg):
    table = gold(spark, ("20260127", "test_passed_count", 1), ("20260127", "test_passed_total", 4), ("20260127", "other", 2))
    both = {(r.metric_name, r.value) for r in with_derived(table, cfg.derived()).collect()}
    assert both == {("test_passed_count", 1), ("test_passed_total", 4), ("other", 2), ("test_passed_rate_percent", 25)}


def test_shared_prefix_is_derived_once(spark):
    enum = Metric("enum", "s", "shared", "Shared", values=("YES",))
    cfg = MetricsConfig((Operator("a", "A", (enum,)), Operator("b", "B", (enum,))))
    rows = [fire({"s": "YES"}, operator="a"), fire({"s": "YES"}, operator="b")]
    got = jobs.gold_of(fires(spark, *rows), cfg)
    values = [(r.metric_name, r.value) for r in got.collect() if r.metric_name.startswith("shared")]
    assert sorted(values) == [("shared_total", 2), ("shared_yes", 2), ("shared_yes_rate_percent", 100)]


def test_rate_denominator_defaults_to_total():
    enum = Metric("enum", "s", "x", "X", values=("A B",))
    found = {d.name: d.denominator for d in MetricsConfig((Operator("a", "A", (enum,)),)).derived()}
    assert found["x_a_b_rate_percent"] == "x_total"


def test_custom_metric_and_derived(spark):
    cfg = MetricsConfig().with_metric("big", "test", lambda d: F.try_variant_get(d, "$.n", "double")).with_derived("big_each", "big", "conversation_count")
    got = jobs.gold_of(fires(spark, fire({"n": 5}), fire({"n": 2}, conversation="c2"), fire({})), cfg)
    values = as_dict(got, "metric_name", "value")
    assert values["big"] == 7 and values["big_each"] == 3.5


@pytest.mark.parametrize(
    ("name", "shown"),
    [
        ("test_passed_rate_percent", "Passed (%)"),
        ("test_score_avg", "Score Média"),
        ("test_score_3", "Score 3"),
        ("test_status_active", "Status: Ativo"),
        ("test_status_on_hold_rate_percent", "Status: On Hold (%)"),
        ("test_topic_atendimento", "Atendimento"),
        ("test_subtopic_renda_fixa_-_resgate", "Renda Fixa - Resgate"),
        ("test_label_ótimo_dia", "Ótimo Dia"),
        ("conversation_count", "Conversas"),
        ("nothing_known", "nothing_known"),
    ],
)
def test_display_names(spark, cfg, name, shown):
    table = spark.createDataFrame([(name,)], "metric_name string")
    assert with_display_names(table, cfg).first().display_name == shown


def test_metrics_query(spark, cfg):
    table = gold(spark, *[(d, n, v) for d, v in (("20260127", 200), ("20260128", 300)) for n, v in (("sentiment_score_sum", v), ("sentiment_score_count", v / 100))], ("20251201", "sentiment_score_sum", 9), ("20260127", "sentiment_avg", 1))
    rows = serve.metrics(table, cfg, "t", as_of=date(2026, 1, 28)).collect()
    averages = {r.date: r.value for r in rows if r.metric_name == "sentiment_avg"}
    assert averages == {"2026-01-27T00:00:00Z": 100, "2026-01-28T00:00:00Z": 100, "period": 100}
    assert {(r.period_from, r.period_to) for r in rows} == {("2025-12-29", "2026-01-28")}
    assert not [r for r in rows if r.date == "period" and r.metric_name == "sentiment_score_sum"]
    only = serve.metrics(table, cfg, "t", date(2026, 1, 1), date(2026, 1, 31), "sentiment_avg").collect()
    assert {r.metric_name for r in only} == {"sentiment_avg"} and len(only) == 3
    raw = serve.metrics(table, cfg, "t", date(2026, 1, 1), date(2026, 1, 31), "sentiment_score_sum").collect()
    assert len(raw) == 2


def test_diff_finds_each_kind(spark):
    old = gold(spark, ("1", "a", 1), ("1", "b", 1), ("1", "c", 1))
    new = gold(spark, ("1", "a", 1), ("1", "b", 2), ("1", "d", 1))
    assert as_dict(diff(old, new), "metric_name", "change") == {"b": "changed", "c": "removed", "d": "added"}


def test_invariants(spark, cfg):
    rows = [fire({"status": s, "score": n}, conversation=f"c{n}", uri=str(n)) for n, s in enumerate(["ACTIVE", "ON HOLD", "ACTIVE", "X"] * 3)]
    got = counted(spark, cfg, *rows)
    assert got == counted(spark, cfg, *reversed(rows))
    assert sum(v for n, v in got.items() if n.startswith("test_status_") and n != "test_status_total") == got["test_status_total"]
    assert sum(v for n, v in got.items() if n.startswith("test_score_") and n[11:].isdigit()) == got["test_score_count"]


def test_config_errors_and_lookups(cfg):
    for text in ("nonsense", "{}", '{"operators": 3}'):
        with pytest.raises(ConfigError):
            parse_config(text)
    with pytest.raises(ConfigError):
        Metric("no_such", "f", "p", "P")
    assert cfg.operator("LY1").name == "test" and cfg.operator("none") is None
    assert cfg.surface_fields() == {"test": ["score", "status", "topics"]}
    assert cfg.filterable_fields() == ["score", "status", "primary_topic"]
    assert cfg.category_pairs() == [("primary_topic", "subtopic")]
    tenants = parse_tenants('{"tenants": {"a": {"ciVersion": "v3"}}, "defaults": {"ciVersion": "v2"}}')
    assert tenants.versions == {"a": "v3"} and tenants.default == "v2"
