"""Role, seniority, experience and link filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefeed import rules
from rolefeed.functions.choice import contains_any
from rolefeed.functions.experience import experience_note, min_years_required

# A letter, a numeral of any script, or an underscore.
_WORD = r"[\p{L}\p{N}_]"


def whole_words(terms: Sequence[str]) -> str:
    """One Java regex that finds any of the terms as whole words in lower-cased text.

    A term's edge must be a word boundary: next to a letter that means no word character beside
    it, next to punctuation that means one. A blank term is found wherever there is a word.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for term in (t.strip() for t in rules.folded(terms)):
        if not term:
            groups.setdefault(("", ""), []).append(_WORD)
            continue
        before = "(?<!" if _is_word(term[0]) else "(?<="
        after = "(?!" if _is_word(term[-1]) else "(?="
        edges = (f"{before}{_WORD})", f"{after}{_WORD})")
        groups.setdefault(edges, []).append(re.escape(term))
    return "|".join(f"{a}(?:{'|'.join(words)}){b}" for (a, b), words in groups.items())


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def title_matches(title: Column, keywords: Sequence[str] = rules.KEYWORDS, whole_word: bool = False) -> Column:
    """Any keyword anywhere in the title, inside words too unless ``whole_word``; false for none."""
    if whole_word:
        return F.lower(title).rlike(whole_words(keywords)) if keywords else F.lit(False)
    return contains_any(F.lower(title), rules.folded(keywords))


def too_senior(title: Column, terms: Sequence[str] = rules.SENIORITY_TERMS) -> Column:
    """Any term as a whole word in the title; false for an empty list."""
    return F.lower(title).rlike(whole_words(terms)) if terms else F.lit(False)


def link_matches(text: Column, href: Column, keywords: Sequence[str] = rules.KEYWORDS) -> Column:
    """Any keyword in the text of a link or in its address as written."""
    return contains_any(F.lower(F.concat_ws(" ", text, href)), rules.folded(keywords))


def is_job_link(href: Column, fragments: Sequence[str] = rules.JOB_LINK_FRAGMENTS) -> Column:
    """The address as written contains a fragment typical of job pages."""
    return contains_any(F.lower(href), fragments)


def is_card_title(title: Column, boilerplate: Sequence[str] = rules.BOILERPLATE_TITLES) -> Column:
    """More than three characters and not a legal notice."""
    return (F.length(title) > 3) & ~contains_any(F.lower(title), boilerplate)


def drop_senior(df: DataFrame, terms: Sequence[str] = rules.SENIORITY_TERMS) -> DataFrame:
    return df.where(~too_senior(F.col("title"), terms)) if terms else df


def role_filter(
    df: DataFrame,
    keywords: Sequence[str] = rules.KEYWORDS,
    exclude: Sequence[str] = rules.SENIORITY_TERMS,
    whole_word: bool = False,
) -> DataFrame:
    """Postings for the wanted roles that are not too senior."""
    return df.where(title_matches(F.col("title"), keywords, whole_word)).transform(drop_senior, exclude)


def with_experience(df: DataFrame, max_years: int = rules.MAX_YEARS, strict_zero: bool = False) -> DataFrame:
    """Add ``yoe`` (years asked for), ``yoe_note`` and ``yoe_ok`` (not above the cap)."""
    text = F.col("description") if "description" in df.columns else F.lit(None).cast("string")
    kept = [c for c in df.columns if c != "yoe"]
    # As a generator's output the number is not computed again where it is tested and noted.
    years = F.explode_outer(F.array(min_years_required(text, strict_zero=strict_zero))).alias("yoe")
    return (
        df.select(*kept, years)
        .withColumn("yoe_note", experience_note(F.col("yoe")))
        .withColumn("yoe_ok", F.coalesce(F.col("yoe") <= max_years, F.lit(True)))
    )


def experience_gate(df: DataFrame, max_years: int = rules.MAX_YEARS, strict_zero: bool = False) -> DataFrame:
    """Postings that ask for at most ``max_years`` or do not say; adds ``yoe_note``."""
    return with_experience(df, max_years, strict_zero).where("yoe_ok").drop("yoe", "yoe_ok")


# Rules kept in a table instead of a parameter, of any size. Distinct titles meet the terms that
# begin like some part of them; what is found is joined back. Nothing is gathered: Spark
# broadcasts the terms or the titles found if they are small, and shuffles both sides if not.

KEY_CHARS = 4


def _titles_with(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct lower-cased titles that contain a ``term`` and match its ``pattern``, if it has one."""
    key = F.substring("term", 1, KEY_CHARS)
    terms = terms.where("term is not null").distinct().withColumn("part", key)
    size = F.length("found")
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(KEY_CHARS)), lambda k: F.transform(
        F.sequence(F.lit(1), F.greatest(size - k + 1, F.lit(1))), lambda i: F.col("found").substr(i, k)
    )))
    titles = df.select(F.lower("title").alias("found")).where("found is not null").distinct()
    near = titles.select("found", F.explode(F.array_distinct(parts)).alias("part")).join(terms, "part")
    fits = F.col("pattern").isNull() | (F.regexp_instr(F.col("found"), F.col("pattern")) > 0)
    return near.where(F.contains("found", "term") & fits).select("found").distinct()


def _quoted(term: Column) -> Column:
    return F.regexp_replace(term, r"([^\p{L}\p{N}_\s])", r"\\$1")


def matching_rule_table(df: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Postings whose title contains any ``term`` of a rule table. NULL terms are left out."""
    terms = rule_table.select(F.lower("term").alias("term"), F.lit(None).cast("string").alias("pattern"))
    found = _titles_with(df, terms)
    return df.join(found, F.lower(df["title"]) == found["found"], "left_semi")


def without_rule_table(df: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Postings whose title has no ``term`` of a rule table as a whole word. A NULL title has none."""
    term = F.trim(F.lower("term"))
    before = F.when(term.rlike(f"^{_WORD}"), f"(?<!{_WORD})").otherwise(f"(?<={_WORD})")
    after = F.when(term.rlike(f"{_WORD}$"), f"(?!{_WORD})").otherwise(f"(?={_WORD})")
    one = F.when(term == "", F.lit(_WORD)).otherwise(F.concat(before, _quoted(term), after))
    found = _titles_with(df, rule_table.select(term.alias("term"), one.alias("pattern")))
    return df.join(found, F.lower(df["title"]) == found["found"], "left_anti")
