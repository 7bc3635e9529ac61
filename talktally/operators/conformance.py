"""Report of payloads that do not follow their registered JSON Schema.

A schema (type, properties, items, enum, required, minimum, maximum,
additionalProperties) becomes one Column of error texts. Nothing is blocked.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.functions import variants as V

NO_ERRORS = "array<string>"


def _none() -> Column:
    return F.array().cast(NO_ERRORS)


def _error(path: Column, message: str) -> Column:
    return F.concat(path, F.lit(f" {message}"))


def _when(broken: Column, path: Column, message: str) -> Column:
    return F.when(broken, F.array(_error(path, message))).otherwise(_none())


def _has_type(value: Column, name: str) -> Column:
    t = V.tag(value)
    number = F.try_variant_get(value, "$", "double")
    return {
        "string": V.is_string(t),
        "number": V.is_number(t),
        "integer": V.is_number(t) & (number == F.floor(number)),
        "boolean": V.is_boolean(t),
        "array": V.is_array(value),
        "object": V.is_object(value),
        "null": F.is_variant_null(value),
    }[name]


def errors(value: Column, schema: dict, path: Column | None = None) -> Column:
    """ARRAY<STRING> of "path message"; empty for a missing value."""
    path = F.lit("") if path is None else path
    t = V.tag(value)
    parts: list[Column] = []
    kinds = schema.get("type")
    if kinds:
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        fits = _has_type(value, kinds[0])
        for kind in kinds[1:]:
            fits = fits | _has_type(value, kind)
        parts.append(_when(~fits, path, f"must be {','.join(kinds)}"))
    if "enum" in schema:
        allowed = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in schema["enum"]]
        parts.append(_when(~F.to_json(value).isin(allowed), path, "must be equal to one of the allowed values"))
    number = F.when(V.is_number(t), F.try_variant_get(value, "$", "double"))
    if "minimum" in schema:
        parts.append(_when(number < float(schema["minimum"]), path, f"must be >= {schema['minimum']}"))
    if "maximum" in schema:
        parts.append(_when(number > float(schema["maximum"]), path, f"must be <= {schema['maximum']}"))
    declared = schema.get("properties", {})
    for name in schema.get("required", []):
        absent = V.is_object(value) & F.try_variant_get(value, f'$["{name}"]', "variant").isNull()
        parts.append(_when(absent, path, f"must have required property '{name}'"))
    for name, sub in declared.items():
        member = F.try_variant_get(value, f'$["{name}"]', "variant")
        parts.append(errors(member, sub, F.concat(path, F.lit(f"/{name}"))))
    if "items" in schema:
        per_item = F.transform(
            V.items(value),
            lambda item, i: errors(item, schema["items"], F.concat(path, F.lit("/"), i.cast("string"))),
        )
        parts.append(F.flatten(per_item))
    extra = schema.get("additionalProperties")
    if extra is False or isinstance(extra, dict):
        others = F.filter(F.map_entries(V.members(value)), lambda e: ~e["key"].isin(list(declared)) if declared else F.lit(True))
        if extra is False:
            parts.append(F.transform(others, lambda e: _error(path, "must NOT have additional properties")))
        elif extra:
            per_member = F.transform(
                others, lambda e: errors(e["value"], extra, F.concat(path, F.lit("/"), e["key"]))
            )
            parts.append(F.flatten(per_member))
    if not parts:
        return _none()
    found = F.concat(*[F.coalesce(p, _none()) for p in parts])
    return F.when(value.isNotNull(), found).otherwise(_none())


def conformance(fires: DataFrame, schemas: dict[tuple[str, str], dict]) -> DataFrame:
    """Add `errors` and `valid`; a result without a schema is valid.

    `schemas` maps (operator name, schema version) to a JSON Schema.
    """
    chain = None
    for (operator, version), schema in schemas.items():
        hit = (F.col("operator_name") == operator) & (F.col("schema_version") == version)
        found = errors(F.col("data"), schema)
        chain = F.when(hit, found) if chain is None else chain.when(hit, found)
    found = _none() if chain is None else F.coalesce(chain.otherwise(_none()), _none())
    return fires.withColumn("errors", found).withColumn("valid", F.size("errors") == 0)


def conformance_report(fires: DataFrame, schemas: dict[tuple[str, str], dict]) -> DataFrame:
    """Per operator, version and error text: number of results, with valid ones under a null text."""
    checked = conformance(fires, schemas)
    return (
        checked.select("tenant_id", "operator_name", "schema_version", F.explode_outer("errors").alias("error"))
        .groupBy("tenant_id", "operator_name", "schema_version", "error")
        .agg(F.count(F.lit(1)).alias("results"))
    )
