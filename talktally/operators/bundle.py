"""Counters of the bundled operator: sentiment, summary, intent, resolution, virtual and human agents.

The averages and rates over them are derived metrics that every deployment has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talktally.config import Metric, MetricsConfig, Operator
from talktally.functions import variants as V

# Fields of the payload, the counters they feed and their types.
MEASURES = (
    ("category", "sentiment.overall", "sentiment"),
    ("number", "sentiment.score", "sentiment_score"),
    ("category", "classification.primary_intent", "intent"),
    ("number", "classification.primary_confidence", "intent_confidence"),
    ("category", "classification.resolution_status", "resolution"),
    ("number", "quality.virtual_agent.quality_score", "virtual_agent_quality"),
    ("number", "quality.human_agent.quality_score", "human_agent_quality"),
)
# Flags counted where they are true.
VIRTUAL_AGENT = ("resolved_questions", "resolved_without_human", "avoided_hallucinations", "avoided_repetitions", "maintained_consistency")
HUMAN_AGENT = ("resolved_questions", "was_cordial", "avoided_repetitions", "resolved_problem", "clear_closing")
TRANSFERRED = "quality.human_agent.was_transferred"
SUMMARY = "summary.paragraph"


def true_at(path: str) -> Callable[[Column], Column]:
    """1 where the payload's field is the boolean true."""

    def emit(payload: Column) -> Column:
        value = V.field(payload, path)
        return F.when(V.is_boolean(V.tag(value)) & F.try_variant_get(value, "$", "boolean"), 1.0)

    return emit


def with_bundle(cfg: MetricsConfig, operator: str) -> MetricsConfig:
    """The configuration with all counters of the bundled operator, under the name `operator`."""
    metrics = [Metric(kind, field, prefix, prefix) for kind, field, prefix in MEASURES]
    metrics.append(Metric("integer", SUMMARY, "summary_word_count", "summary_word_count", words=True))
    found = MetricsConfig((*cfg.operators, Operator(operator, operator, tuple(metrics))), cfg.custom, cfg.custom_derived)
    for agent, flags in (("virtual_agent", VIRTUAL_AGENT), ("human_agent", HUMAN_AGENT)):
        for flag in flags:
            found = found.with_metric(f"{agent}_{flag}", operator, true_at(f"quality.{agent}.{flag}"))
    return found.with_metric("human_agent_transfers", operator, true_at(TRANSFERRED))
