"""Scalar value rules: rounding, normalising, labels, dates and small text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of JavaScript's \s, which Java's \s lacks in part.
JS_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def normalise(text: Column) -> Column:
    """Lower case, every whitespace run becomes one underscore."""
    return F.regexp_replace(F.lower(text), JS_SPACE + "+", "_")


def normalise_text(text: str) -> str:
    """Driver-side twin of `normalise`, for names built from configuration."""
    return re.sub(JS_SPACE + "+", "_", text.lower())


def round2(number: Column) -> Column:
    """Two decimals, halves toward plus infinity."""
    return (F.floor(number * 100 + 0.5) / 100).cast("double")


def ratio2(numerator: Column, denominator: Column, scale: Column) -> Column:
    """Rounded numerator / denominator * scale; null unless both exist and denominator > 0."""
    usable = numerator.isNotNull() & (denominator > 0)
    return F.when(usable, round2(numerator / denominator * scale))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def title_case(text: Column) -> Column:
    """Underscores to spaces, first letter of every word upper, the rest untouched."""
    spaced = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"\s+-\s+", " - ")
    words = F.transform(
        F.split(spaced, " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1)),
    )
    return F.trim(F.array_join(words, " "))


def day_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def second_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def iso_day(day: Column) -> Column:
    """`yyyyMMdd` to `yyyy-MM-ddT00:00:00Z`; other lengths stay as they are."""
    iso = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    return F.when(F.length(day) == 8, F.concat(iso, F.lit("T00:00:00Z"))).otherwise(day)


def day_to_date(day: Column) -> Column:
    return F.to_date(F.try_to_timestamp(day, F.lit("yyyyMMdd")))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text, null for null."""

    def blank(edge: Column) -> Column:
        return edge.rlike(JS_SPACE).cast("int")

    # A blank at either end makes one empty piece.
    pieces = F.size(F.split(text, JS_SPACE + "+"))
    words = pieces - blank(F.left(text, F.lit(1))) - blank(F.right(text, F.lit(1)))
    return F.when(text == "", F.lit(0)).when(text.isNotNull(), words).cast("bigint")


def suffix_int(name: Column, prefix: str) -> Column:
    """Integer after a metric-name prefix, null if it is not one."""
    return F.substring(name, len(prefix) + 1, 2**31 - 1).try_cast("int")


def threshold_class(value: Column, steps: list[tuple[float, str, bool]]) -> Column:
    """First matching step wins; a step is (bound, label, bound included)."""
    chain = None
    for bound, label, inclusive in steps:
        hit = value >= bound if inclusive else value > bound
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
