"""Friendly metric names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.config import BUILTIN_DISPLAY_NAMES, MetricsConfig
from talktally.functions.values import title_case
from talktally.session import config_table


def dynamic_label(metric_name: Column, cfg: MetricsConfig) -> Column:
    """Label of a name with a free suffix: the first configured prefix that fits."""
    chain = None
    for prefix in cfg.label_prefixes():
        hit = metric_name.startswith(f"{prefix}_")
        label = title_case(F.substring(metric_name, len(prefix) + 2, 2**31 - 1))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return F.lit(None).cast("string") if chain is None else chain


def with_display_names(df: DataFrame, cfg: MetricsConfig) -> DataFrame:
    """Add `display_name`: configured, then by prefix, then built-in, then the raw name."""
    shown = cfg.display_names()
    configured = {n: s for n, s in shown.items() if BUILTIN_DISPLAY_NAMES.get(n) != s}
    names = config_table(
        df.sparkSession,
        {
            "metric_name": list(shown),
            "_configured": [configured.get(n) for n in shown],
            "_builtin": [BUILTIN_DISPLAY_NAMES.get(n) for n in shown],
        },
        pa.schema([(c, pa.string()) for c in ("metric_name", "_configured", "_builtin")]),
    )
    name = F.col("metric_name")
    label = F.coalesce("_configured", dynamic_label(name, cfg), "_builtin", name)
    return df.join(names, "metric_name", "left").withColumn("display_name", label).select(*df.columns, "display_name")
