"""Customer phone handling: unwrap, last four digits, mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talktally.functions.values import blank_to_null


def normalize_phone(phone: Column) -> Column:
    """User part of a sip:, sips: or tel: address; null for empty input."""
    bare = F.regexp_replace(blank_to_null(phone), r"(?i)^(?:sips?|tel):", "")
    return F.split(bare, "[@;?]", 2)[0]


def phone_last4(phone: Column) -> Column:
    digits = F.regexp_replace(normalize_phone(phone), "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4)))


def mask_phone(phone: Column) -> Column:
    """Keep five leading and four trailing characters; nine or fewer stay unmasked."""
    bare = blank_to_null(normalize_phone(phone))
    hidden = F.repeat(F.lit("*"), F.greatest(F.length(bare) - 9, F.lit(0)))
    masked = F.concat(F.left(bare, F.lit(5)), hidden, F.right(bare, F.lit(4)))
    return F.when(F.length(bare) > 9, masked).otherwise(bare)
