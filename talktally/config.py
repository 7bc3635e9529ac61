"""Declarative metric definitions and what follows from them.

Everything here is small driver-side data: it is compiled into Column
expressions or becomes a local relation whose size Catalyst knows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as dc_field

from pyspark.sql import Column

from talktally.functions.values import normalise_text

# Triggers a rule may fire on.
TRIGGERS = ("COMMUNICATION", "CONVERSATION_INACTIVE", "CONVERSATION_END")
METRIC_TYPES = ("boolean", "integer", "number", "category", "enum", "category_array")
BUILTIN_INDEX_FIELDS = ("customer_phone_last4",)


class ConfigError(ValueError):
    """The configuration text cannot be used."""


@dataclass(frozen=True)
class Metric:
    """One field of an operator's payload and how it is counted."""

    type: str
    field: str
    prefix: str
    display: str
    surface: bool = False
    minimum: float | None = None
    maximum: float | None = None
    distribution: bool = False
    values: tuple[str, ...] = ()
    value_display: dict[str, str] = dc_field(default_factory=dict)
    ignore: tuple[str, ...] = ()
    denominator: str | None = None
    category_field: str | None = None
    sub_field: str | None = None
    sub_prefix: str | None = None
    words: bool = False

    def __post_init__(self) -> None:
        if self.type not in METRIC_TYPES:
            raise ConfigError(f"unknown metric type {self.type!r}")
        if self.type == "category_array" and not self.category_field:
            raise ConfigError(f"{self.prefix}: category_array needs a category field")

    @property
    def is_number(self) -> bool:
        return self.type in ("integer", "number")

    @property
    def counted_values(self) -> list[str]:
        return [v for v in self.values if v not in self.ignore]

    @property
    def rate_denominator(self) -> str:
        return self.denominator or f"{self.prefix}_total"


@dataclass(frozen=True)
class Operator:
    name: str
    display: str
    metrics: tuple[Metric, ...]
    sid: str | None = None
    triggers: tuple[str, ...] | None = None
    once_per_conversation: bool = False

    @property
    def names(self) -> list[str]:
        return [self.name] + ([self.sid] if self.sid else [])


@dataclass(frozen=True)
class Derived:
    """`name = round2(numerator / denominator * scale)`."""

    name: str
    numerator: str
    denominator: str
    scale: float = 1.0


@dataclass(frozen=True)
class CustomMetric:
    """A counter written by hand: `emit(payload)` gives an increment, null for none."""

    name: str
    operator: str
    emit: Callable[[Column], Column]


@dataclass(frozen=True)
class MetricsConfig:
    operators: tuple[Operator, ...] = ()
    custom: tuple[CustomMetric, ...] = ()
    custom_derived: tuple[Derived, ...] = ()

    def operator(self, name_or_sid: str) -> Operator | None:
        """The last operator listed under this name or SID."""
        found = [op for op in self.operators if name_or_sid in op.names]
        return found[-1] if found else None

    def split_once(self) -> tuple[MetricsConfig, MetricsConfig]:
        """(operators counted on every fire with the custom metrics, those counted once per conversation)."""
        once = tuple(op for op in self.operators if op.once_per_conversation)
        rest = tuple(op for op in self.operators if not op.once_per_conversation)
        return MetricsConfig(rest, self.custom, self.custom_derived), MetricsConfig(once)

    def with_metric(self, name: str, operator: str, emit: Callable[[Column], Column]) -> MetricsConfig:
        return MetricsConfig(self.operators, (*self.custom, CustomMetric(name, operator, emit)), self.custom_derived)

    def with_derived(self, name: str, numerator: str, denominator: str, scale: float = 1.0) -> MetricsConfig:
        extra = (*self.custom_derived, Derived(name, numerator, denominator, scale))
        return MetricsConfig(self.operators, self.custom, extra)

    def surface_fields(self) -> dict[str, list[str]]:
        """Operator name to the payload fields shown in conversation lists."""
        found = {op.name: [m.field for m in op.metrics if m.surface] for op in self.operators}
        return {name: fields for name, fields in found.items() if fields}

    def filterable_fields(self) -> list[str]:
        return [
            m.category_field if m.type == "category_array" else m.field
            for op in self.operators
            for m in op.metrics
            if m.surface
        ]

    def category_pairs(self) -> list[tuple[str, str]]:
        return [
            (m.category_field, m.sub_field)
            for op in self.operators
            for m in op.metrics
            if m.type == "category_array" and m.surface and m.sub_field
        ]

    def derived(self) -> list[Derived]:
        """Distinct derived definitions; a configured name replaces a built-in one."""
        found: dict[str, Derived] = {d.name: d for d in BUILTIN_DERIVED}
        for op in self.operators:
            for m in op.metrics:
                for d in _derived_of(m):
                    found[d.name] = d
        for d in self.custom_derived:
            found[d.name] = d
        return list(found.values())

    def display_names(self) -> dict[str, str]:
        names = dict(BUILTIN_DISPLAY_NAMES)
        for op in self.operators:
            for m in op.metrics:
                names.update(_display_names_of(m))
        return names

    def label_prefixes(self) -> list[str]:
        """Prefixes whose suffix is the label, in the order they are tried."""
        found: list[str] = []
        for op in self.operators:
            for m in op.metrics:
                if m.type == "category_array":
                    found += [p for p in (m.sub_prefix, m.prefix) if p]
                elif m.type == "category":
                    found.append(m.prefix)
        return list(dict.fromkeys(found))


def _derived_of(m: Metric) -> list[Derived]:
    p = m.prefix
    if m.type == "boolean":
        return [Derived(f"{p}_rate_percent", f"{p}_count", f"{p}_total", 100.0)]
    if m.is_number:
        return [Derived(f"{p}_avg", f"{p}_sum", f"{p}_count")]
    if m.type == "enum":
        return [
            Derived(f"{p}_{normalise_text(v)}_rate_percent", f"{p}_{normalise_text(v)}", m.rate_denominator, 100.0)
            for v in m.counted_values
        ]
    return []


def _display_names_of(m: Metric) -> dict[str, str]:
    p, shown = m.prefix, m.display
    if m.type == "boolean":
        return {f"{p}_count": shown, f"{p}_total": f"{shown} (Total)", f"{p}_rate_percent": f"{shown} (%)"}
    if m.is_number:
        names = {f"{p}_sum": f"{shown} (Soma)", f"{p}_count": f"{shown} (Contagem)", f"{p}_avg": f"{shown} Média"}
        if m.distribution and m.minimum is not None and m.maximum is not None:
            value = m.minimum
            while value <= m.maximum:
                label = str(int(value)) if float(value).is_integer() else str(value)
                names[f"{p}_{label}"] = f"{shown} {label}"
                value += 1
        return names
    if m.type == "enum":
        names = {f"{p}_total": f"{shown} (Total)"}
        for v in m.counted_values:
            label = m.value_display.get(v) or title_text(normalise_text(v))
            names[f"{p}_{normalise_text(v)}"] = f"{shown}: {label}"
            names[f"{p}_{normalise_text(v)}_rate_percent"] = f"{shown}: {label} (%)"
        return names
    return {}


def title_text(text: str) -> str:
    words = text.replace("_", " ").split(" ")
    return " ".join(w[:1].upper() + w[1:] for w in words).strip()


def parse_config(text: str) -> MetricsConfig:
    """Read the JSON form of a metrics configuration."""
    try:
        doc = json.loads(text)
    except ValueError as error:
        raise ConfigError(f"not JSON: {error}") from error
    if not isinstance(doc, dict) or not isinstance(doc.get("operators"), list):
        raise ConfigError("missing operators array")
    return MetricsConfig(tuple(_read_operator(o) for o in doc["operators"]))


def _read_operator(o: dict) -> Operator:
    triggers = o.get("aggregateOnTriggers")
    return Operator(
        name=o["operatorName"],
        display=o.get("displayName", o["operatorName"]),
        metrics=tuple(_read_metric(m) for m in o.get("metrics", [])),
        sid=o.get("operatorSid"),
        triggers=tuple(triggers) if triggers is not None else None,
        once_per_conversation=o.get("dedupBy") == "conversation",
    )


def _read_metric(m: dict) -> Metric:
    return Metric(
        type=m["type"],
        field=m["field"],
        prefix=m["metricPrefix"],
        display=m.get("displayName", m["metricPrefix"]),
        surface=bool(m.get("surfaceInList", False)),
        minimum=m.get("min"),
        maximum=m.get("max"),
        distribution=bool(m.get("distribution", False)),
        values=tuple(m.get("values", ())),
        value_display=dict(m.get("valueDisplayNames", {})),
        ignore=tuple(m.get("ignoreValues", ())),
        denominator=m.get("rateDenominator"),
        category_field=m.get("categoryField"),
        sub_field=m.get("subcategoryField"),
        sub_prefix=m.get("subcategoryPrefix"),
        words=bool(m.get("countWords", False)),
    )


def _averages(*pairs: tuple[str, str]) -> list[Derived]:
    return [Derived(name, f"{raw}_sum", f"{raw}_count") for name, raw in pairs]


# Derived metrics every deployment has.
BUILTIN_DERIVED = (
    *_averages(
        ("avg_handling_time_sec", "handling_time"),
        ("avg_response_time_sec", "response_time"),
        ("avg_customer_wait_time_sec", "customer_wait_time"),
        ("sentiment_avg", "sentiment_score"),
        ("summary_avg_words", "summary_word_count"),
        ("classification_avg_confidence", "classification_confidence"),
        ("intent_avg_confidence", "intent_confidence"),
        ("virtual_agent_quality_avg", "virtual_agent_quality"),
        ("human_agent_quality_avg", "human_agent_quality"),
    ),
    Derived("pii_avg_entities_per_conversation", "pii_entities_detected", "pii_conversations_with_entities"),
    Derived("transfer_rate_percent", "human_agent_transfers", "conversation_count", 100.0),
    *(
        Derived(f"virtual_agent_{m}_percent", f"virtual_agent_{m}", "conversation_count", 100.0)
        for m in (
            "resolved_questions",
            "resolved_without_human",
            "avoided_hallucinations",
            "avoided_repetitions",
            "maintained_consistency",
        )
    ),
    *(
        Derived(f"human_agent_{m}_percent", f"human_agent_{m}", "human_agent_transfers", 100.0)
        for m in ("resolved_questions", "was_cordial", "avoided_repetitions", "resolved_problem", "clear_closing")
    ),
)

# Labels of metrics that no configuration names.
BUILTIN_DISPLAY_NAMES = {
    "conversation_count": "Conversas",
    "avg_handling_time_sec": "Tempo Média de Atendimento (s)",
    "avg_response_time_sec": "Tempo Média de Resposta (s)",
    "avg_customer_wait_time_sec": "Tempo Média de Espera do Cliente (s)",
    "sentiment_avg": "Sentimento Média",
    "transfer_rate_percent": "Taxa de Transferência (%)",
    "virtual_agent_quality_avg": "Qualidade do Agente Virtual",
    "human_agent_quality_avg": "Qualidade do Agente Humano",
}


@dataclass(frozen=True)
class TenantConfig:
    """Payload version a tenant declares, with a default for the rest."""

    versions: dict[str, str] = dc_field(default_factory=dict)
    default: str = "v2"


def parse_tenants(text: str) -> TenantConfig:
    doc = json.loads(text)
    versions = {t: c.get("ciVersion") for t, c in doc.get("tenants", {}).items()}
    default = doc.get("defaults", {}).get("ciVersion", "v2")
    return TenantConfig({t: v for t, v in versions.items() if v}, default)
