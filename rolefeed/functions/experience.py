"""Years of experience asked for in free text."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefeed import rules
from rolefeed.functions.choice import contains_any
from rolefeed.functions.text import SPACE

# Fixed value: which phrasings count as a stated requirement. The first number is captured.
# Repeats are possessive and a match may not start inside a number: neither changes what is
# found, but both keep the scan linear on long runs of digits or spaces.
STATED_YEARS = (
    rf"(?iU)(\d(?<!\d\d)\d*+)\+?{SPACE}*+(?:-{SPACE}*+\d++)?{SPACE}*+(?:years?|yrs?){SPACE}*+(?:of{SPACE}++)?"
    rf"(?:relevant{SPACE}++|professional{SPACE}++|prior{SPACE}++)?experience"
)

_LARGEST = 2**63 - 1


@functools.cache
def _other_digits() -> tuple[str, str]:
    """Every decimal digit outside ASCII and the ASCII digit it stands for."""
    digits = [ch for ch in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(ch) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(ch)) for ch in digits)


def _to_number(digits: Column) -> Column:
    # Beyond BIGINT the exact value no longer matters: no cap admits it.
    significant = F.ltrim(F.translate(digits, *_other_digits()), F.lit("0"))
    return F.when(significant == "", F.lit(0).cast("bigint")).otherwise(
        F.coalesce(significant.try_cast("bigint"), F.lit(_LARGEST))
    )


def min_years_required(
    text: Column, phrases: Sequence[str] = rules.ENTRY_LEVEL_PHRASES, strict_zero: bool = False
) -> Column:
    """Smallest stated number of years; 0 for an entry-level phrase anywhere; NULL if neither.

    With ``strict_zero`` a phrase that begins with a digit does not count inside a longer number, so
    that "10 years of experience" is not 0 years.
    """
    lowered = F.lower(text)
    numeric = [p for p in phrases if strict_zero and p[:1].isdigit()]
    entry_level = contains_any(lowered, [p for p in phrases if p not in numeric])
    if numeric:
        entry_level = entry_level | lowered.rlike(r"(?U)(?<!\d)(?:" + "|".join(map(re.escape, numeric)) + ")")
    stated = F.regexp_extract_all(lowered, F.lit(STATED_YEARS), F.lit(1))
    return F.when(entry_level, F.lit(0).cast("bigint")).otherwise(
        F.array_min(F.transform(stated, _to_number))
    )


def experience_note(years: Column) -> Column:
    """What the digest says about the requirement."""
    return F.coalesce(
        F.concat(F.lit("~"), years.cast("string"), F.lit("+ yrs stated")), F.lit(rules.NOT_STATED)
    )
