"""Cues in remarks, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.fixed_values import MONTH_UNITS, NUMBER_WORDS, SWITCHED_OFF_CUE, YEAR_UNITS, any_of

_UNIT = "|".join((*MONTH_UNITS, *YEAR_UNITS))
_SPAN = rf"(?i)\b(\d+|{'|'.join(NUMBER_WORDS)})\s*({_UNIT})\b"


def months_switched_off(remark: Column) -> Column:
    """The longest time, in months, that a remark says a line has been off; null if it says none.

    Digits or number words before a unit of months or years count, years twelve times, and only in a
    remark with a switched-off cue.
    """
    numbers = F.regexp_extract_all(remark, F.lit(_SPAN), F.lit(1))
    units = F.regexp_extract_all(remark, F.lit(_SPAN), F.lit(2))
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    value = lambda n: F.coalesce(n.try_cast("bigint"), F.try_element_at(words, F.lower(n)).cast("bigint"))
    year = rf"(?i)^(?:{'|'.join(YEAR_UNITS)})$"
    months = F.zip_with(numbers, units, lambda n, u: value(n) * F.when(u.rlike(year), 12).otherwise(1))
    most = F.array_max(months)
    return F.when(remark.rlike(any_of(SWITCHED_OFF_CUE)) & (most > 0), most)
