"""Tables, detail sections and chart data described by a view configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.functions import variants as V
from talktally.functions.values import round2


def formatted(value: Column, pattern: str | None) -> Column:
    """Text of a payload value: `0%`, a signed or plain fixed number, or as it is."""
    number = V.as_double(value)
    if pattern == "0%":
        text = F.concat(F.floor(number * 100 + 0.5).cast("string"), F.lit("%"))
    elif pattern and pattern.lstrip("+").replace(".", "").strip("0") == "":
        digits = len(pattern.split(".")[1]) if "." in pattern else 0
        plain = F.regexp_replace(F.format_number(number, digits), ",", "")
        text = F.when(number >= 0, F.concat(F.lit("+"), plain)).otherwise(plain) if pattern.startswith("+") else plain
    else:
        return V.any_text(value)
    return F.coalesce(text, V.any_text(value))


def of_view(results: DataFrame, view: dict) -> DataFrame:
    return results.where(
        (F.col("operator_name") == view["operatorName"]) & (F.col("schema_version") == view["schemaVersion"])
    )


def table_rows(results: DataFrame, view: dict) -> DataFrame:
    """One labelled text column per configured table column."""
    columns = [
        formatted(V.field(F.col("data"), c["field"]), c.get("format")).alias(c["label"])
        for c in view.get("table", {}).get("columns", [])
    ]
    return of_view(results, view).select("tenant_id", "conversation_id", *columns)


def _section(value: Column, kind: str | None) -> Column:
    """ARRAY<STRUCT<key, value>> of one payload member."""
    listed = V.items(value)
    as_list = F.transform(listed, lambda e, i: F.struct((i + 1).cast("string").alias("key"), F.to_json(e).alias("value")))
    tags = F.transform(listed, lambda e, i: F.struct((i + 1).cast("string").alias("key"), V.any_text(e).alias("value")))
    table = F.transform(
        F.map_entries(V.members(value)), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))
    )
    moments = F.transform(
        listed,
        lambda e: F.struct(V.text_at(e, "timestamp").alias("key"), F.to_json(e).alias("value")),
    )
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.to_json(value).alias("value")))
    return {
        "tag-list": tags,
        "key-value-table": F.coalesce(table, as_list),
        "timeline": moments,
    }.get(kind, whole)


def _titled(title: str, pairs: Column) -> Column:
    return F.transform(
        pairs, lambda e: F.struct(F.lit(title).alias("section"), e["key"].alias("key"), e["value"].alias("value"))
    )


def detail_rows(results: DataFrame, view: dict) -> DataFrame:
    """Long form `(section, key, value)` of the configured detail sections."""
    rows = of_view(results, view).select("tenant_id", "conversation_id", "data")
    parts = []
    for section in view.get("detail", {}).get("sections", []):
        if "fields" in section:
            values = [
                F.struct(F.lit(f).alias("key"), V.any_text(V.field(F.col("data"), f)).alias("value"))
                for f in section["fields"]
            ]
            found = F.filter(F.array(*values), lambda p: p["value"].isNotNull())
        else:
            value = V.field(F.col("data"), section["field"])
            found = F.when(value.isNotNull(), _section(value, section.get("type")))
        parts.append((section["title"], found))
    entry = "array<struct<section:string,key:string,value:string>>"
    tagged = [F.coalesce(_titled(title, pairs), F.array().cast(entry)) for title, pairs in parts]
    return rows.select("tenant_id", "conversation_id", F.inline_outer(F.concat(*tagged)))


def chart_counts(results: DataFrame, view: dict) -> DataFrame:
    """Value histogram of the pie and bar charts; array fields count per item."""
    rows = of_view(results, view)
    parts = []
    for chart in view.get("charts", []):
        if chart["type"] not in ("pie", "bar"):
            continue
        value = V.field(F.col("data"), chart["field"])
        each = F.when(V.is_array(value), V.items(value)).otherwise(F.array(value))
        labels = rows.select("tenant_id", F.lit(chart["title"]).alias("chart"), F.explode_outer(each).alias("_v"))
        parts.append(labels.select("tenant_id", "chart", V.any_text(F.col("_v")).alias("label")).where("label IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts).groupBy("tenant_id", "chart", "label").agg(F.count(F.lit(1)).alias("n"))


def chart_timeline(
    results: DataFrame, view: dict, grain: str = "DAY", measure: str = "score", group_field: str | None = None
) -> DataFrame:
    """Points of line and area charts: average of a time-stamped array's measure per bucket."""
    rows = of_view(results, view)
    parts = []
    for chart in view.get("charts", []):
        if chart["type"] not in ("line", "area"):
            continue
        group = chart.get("groupBy", group_field)
        points = rows.select(
            "tenant_id",
            F.lit(chart["title"]).alias("chart"),
            F.explode_outer(V.items(V.field(F.col("data"), chart["field"]))).alias("_p"),
        )
        parts.append(
            points.select(
                "tenant_id",
                "chart",
                F.date_trunc(grain, F.try_to_timestamp(V.text_at(F.col("_p"), "timestamp"))).alias("bucket"),
                (V.any_text(V.field(F.col("_p"), group)) if group else F.lit(None).cast("string")).alias("series"),
                V.as_double(V.field(F.col("_p"), measure)).alias("_m"),
            )
        )
    pooled = reduce(DataFrame.unionByName, parts).where(F.col("bucket").isNotNull())
    return pooled.groupBy("tenant_id", "chart", "bucket", "series").agg(
        F.count(F.lit(1)).alias("n"), round2(F.avg("_m")).alias("value")
    )
