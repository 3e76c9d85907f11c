"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefeed.functions.html import text_of_html

# Every Unicode space, as a Java character class under (?U); the ASCII separators are not part of
# Java's \s.
SPACE = r"[\s\x1c-\x1f]"
_ZERO_WIDTH_SPACE = "\u200b"


def clean_text(text: Column) -> Column:
    """Drop U+200B, turn every run of spaces into one blank, strip. NULL stays NULL."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit(_ZERO_WIDTH_SPACE), F.lit("")), rf"(?U){SPACE}+", " "))


def html_to_text(html: Column) -> Column:
    """Visible text of an HTML fragment, cleaned. NULL and "" both give "".

    Only values with markup or entities reach the Python parser; plain text stays in the JVM.
    """
    marked_up = F.when(html.contains("<") | html.contains("&"), html)
    return F.coalesce(clean_text(F.coalesce(text_of_html(marked_up), html)), F.lit(""))


def falsy_to_null(text: Column) -> Column:
    """NULL for an empty string, so that ``coalesce`` picks the first non-empty value."""
    return F.nullif(text, F.lit(""))


def link_title(text: Column, placeholder: str) -> Column:
    """The cleaned link text, or a placeholder for a link without any."""
    return F.coalesce(falsy_to_null(text), F.lit(placeholder))


def card_title(heading: Column, full_text: Column, aria_label: Column) -> Column:
    """Title of a rendered card: a heading longer than four characters, else the whole link
    text; an aria-label replaces either when it is longer."""
    visible = F.when(F.length(heading) > 4, heading).otherwise(full_text)
    return F.when(F.length(aria_label) > F.length(visible), aria_label).otherwise(visible)
