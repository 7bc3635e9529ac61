"""Strict typing over free-form payloads held as VARIANT.

Types are decided by the variant's own type tag, never by a coercing cast:
`"4"` is no number and `1` is no boolean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talktally.functions.values import blank_to_null

# Result member that holds the payload, by operator type.
RESULT_MEMBER = {
    "json": "json_results",
    "text-generation": "text_generation_results",
    "extract": "extract_results",
    "extract-normalize": "normalized_results",
    "pii-extract": "extract_results",
    "conversation-classify": "label_probabilities",
    "utterance-classify": "utterance_results",
}
# Members the fallback unwrap drops.
DROPPED_MEMBERS = ("operator_sid", "operator_type", "name")


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def _path(segments: list[str], as_index: bool) -> str:
    steps = (f"[{s}]" if as_index and s.isdigit() else f'["{s}"]' for s in segments)
    return "$" + "".join(steps)


def field(payload: Column, path: str) -> Column:
    """Member at a dot path as VARIANT; SQL NULL when any step is missing.

    A numeric step reads an array item, or an object member of that name.
    """
    segments = path.split(".")
    by_name = F.try_variant_get(payload, _path(segments, False), "variant")
    if not any(s.isdigit() for s in segments):
        return by_name
    return F.coalesce(F.try_variant_get(payload, _path(segments, True), "variant"), by_name)


def text_at(payload: Column, path: str) -> Column:
    return as_string(field(payload, path))


def tag(value: Column) -> Column:
    """Type tag. Cheap for scalars; for a container it describes all of its content,
    so `is_object` and `is_array` do not use it."""
    return F.schema_of_variant(value)


def is_boolean(t: Column) -> Column:
    return t == "BOOLEAN"


def is_number(t: Column) -> Column:
    return t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


def is_string(t: Column) -> Column:
    return t == "STRING"


def is_array(value: Column) -> Column:
    return items(value).isNotNull()


def is_object(value: Column) -> Column:
    """By a cast that looks at the top level only."""
    return F.try_variant_get(value, "$", "struct<_:variant>").isNotNull()


def is_missing(value: Column) -> Column:
    """SQL NULL or a JSON null."""
    return value.isNull() | F.is_variant_null(value)


def as_boolean(value: Column) -> Column:
    return F.when(is_boolean(tag(value)), F.try_variant_get(value, "$", "boolean"))


def as_double(value: Column) -> Column:
    return F.when(is_number(tag(value)), F.try_variant_get(value, "$", "double"))


def as_string(value: Column) -> Column:
    """The text of a JSON string; null for any other type."""
    return F.when(is_string(tag(value)), F.try_variant_get(value, "$", "string"))


def number_text(value: Column) -> Column:
    """A JSON number as JavaScript prints it: no trailing `.0`."""
    number = F.try_variant_get(value, "$", "double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e18)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(
        F.try_variant_get(value, "$", "string")
    )


def any_text(value: Column) -> Column:
    """Text of any non-null value, for index entries."""
    return (
        F.when(is_array(value), F.array_join(F.try_variant_get(value, "$", "array<string>"), ",", ""))
        .when(is_object(value), F.lit("[object Object]"))
        .when(is_number(tag(value)), number_text(value))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def truthy(value: Column) -> Column:
    """JavaScript truthiness of a variant; false for SQL NULL."""
    t = tag(value)
    return (
        F.when(is_missing(value), False)
        .when(is_object(value) | is_array(value), True)
        .when(is_boolean(t), F.try_variant_get(value, "$", "boolean"))
        .when(is_number(t), F.try_variant_get(value, "$", "double") != 0)
        .otherwise(F.try_variant_get(value, "$", "string") != "")
    )


def items(value: Column) -> Column:
    """Array items as ARRAY<VARIANT>; null if the value is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def members(value: Column) -> Column:
    """Object members as MAP<STRING, VARIANT>; null if the value is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def to_object(members_map: Column) -> Column:
    return F.to_variant_object(members_map)


def merge(*maps: Column) -> Column:
    """Later members win (needs `spark.sql.mapKeyDedupPolicy=LAST_WIN`)."""
    return F.map_concat(*maps)


def unwrap(operator_type: Column, data: Column) -> Column:
    """Flatten an operator result: the typed member if there is one, else all but the header.

    Missing data becomes an empty object. `_operator_type` and `_operator_name`
    are added when known.
    """
    lookup = F.create_map(*[F.lit(x) for pair in RESULT_MEMBER.items() for x in pair])
    all_members = F.coalesce(members(data), F.create_map().cast("map<string,variant>"))
    chosen = F.try_element_at(all_members, F.coalesce(lookup[operator_type], F.lit("")))
    use_chosen = truthy(chosen)
    wrapped = F.create_map(F.lit("results"), chosen)
    rest = F.map_filter(all_members, lambda k, v: ~k.isin(*DROPPED_MEMBERS))
    body = (
        F.when(use_chosen & is_object(chosen), members(chosen))
        .when(use_chosen, wrapped)
        .otherwise(rest)
    )
    declared = F.try_element_at(all_members, F.lit("operator_type"))
    given = blank_to_null(operator_type).cast("variant")
    type_member = F.coalesce(given, F.when(~use_chosen, declared))
    header = F.map_filter(
        F.create_map(
            F.lit("_operator_type"),
            type_member,
            F.lit("_operator_name"),
            F.try_element_at(all_members, F.lit("name")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return F.when(truthy(data), to_object(merge(body, header))).otherwise(
        to_object(F.create_map().cast("map<string,variant>"))
    )


def display_fields(payload: Column) -> Column:
    """JSON text of the members fit for a list: scalars and up to five strings."""

    def fits(key: Column, value: Column) -> Column:
        t, entries = tag(value), items(value)
        fine = (
            F.when(key.startswith("_") | is_missing(value) | is_object(value), False)
            .when(entries.isNotNull(), (F.size(entries) <= 5) & F.forall(entries, lambda e: is_string(tag(e))))
            .otherwise(is_string(t) | is_number(t) | is_boolean(t))
        )
        return F.coalesce(fine, F.lit(False))

    return F.to_json(F.map_filter(members(payload), fits))


def wrap_result(output_format: Column, result: Column) -> Column:
    """TEXT becomes `{text}`, an object or array stays, any other value becomes `{value}`."""
    text = F.when(is_missing(result), F.lit("")).otherwise(any_text(result))
    return (
        F.when(output_format == "TEXT", F.to_variant_object(F.struct(text.alias("text"))))
        .when(is_object(result) | is_array(result), result)
        .otherwise(F.to_variant_object(F.struct(result.alias("value"))))
    )


def channel_type(channel: Column) -> Column:
    """Type of a channel given as an object with `type`, or as a plain string."""
    return F.coalesce(blank_to_null(text_at(channel, "type")), blank_to_null(as_string(channel)))
