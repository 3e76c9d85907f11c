"""Rule lists and constants.

Everything in the first part is a FIXED VALUE: results depend on these exact words, patterns and
numbers, so they are kept together as plain text in their natural order. Every operator takes
them as default arguments, so a user can pass other lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

# --- fixed values -------------------------------------------------------------------------

KEYWORDS = (
    "software engineer", "swe", "full stack", "fullstack", "full-stack", "backend engineer",
    "back-end engineer", "ai engineer", "machine learning engineer", "ml engineer",
    "artificial intelligence", "applied scientist", "llm", "genai", "generative ai",
)

SENIORITY_TERMS = (
    "senior", "sr", "staff", "principal", "lead", "director", "head of", "vp",
    "vice president", "architect", "manager", "iii", "iv",
)

ENTRY_LEVEL_PHRASES = (
    "no prior experience", "no experience required", "no experience necessary", "entry level",
    "entry-level", "fresher", "new grad", "recent graduate", "0 years of experience",
)

MAX_YEARS = 1

JOB_LINK_FRAGMENTS = (
    "/job/", "/jobs/", "/posting/", "/careers/", "/viewjob", "jobid=", "req_id=",
)

BOILERPLATE_TITLES = ("privacy", "terms", "cookie")

# Tried in this order; the first fragment found in the URL decides the platform.
PLATFORM_BY_URL_FRAGMENT = (
    ("greenhouse.io", "greenhouse"),
    ("lever.co", "lever"),
    ("smartrecruiters.com", "smartrecruiters"),
    ("ashbyhq.com", "ashby"),
    ("myworkdayjobs.com", "workday"),
    ("amazon.jobs", "amazon"),
)

GENERIC = "generic"
UNTITLED_LINK = "(untitled link — check URL)"
DEFAULT_LOCATION = "India"
NOT_STATED = "YOE not stated"

# Rows per request.
WORKDAY_LIMIT = 20
AMAZON_LIMIT = 100

# --- reading user-edited rules ------------------------------------------------------------


def load_rules(spark: SparkSession, path: str) -> dict:
    """A rule file (YAML, or JSON, which YAML includes) from any file system Spark can read.

    Rule files are short hand-edited configuration; they end up as literals in the plan.
    """
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first().value)


def rule_list(spark: SparkSession, path: str, key: str) -> tuple[str, ...]:
    """One list of words out of a rule file."""
    return tuple(load_rules(spark, path)[key])


def max_years(spark: SparkSession, path: str) -> int:
    """The experience cap of a rule file; ``MAX_YEARS`` when the file does not set it."""
    return int(load_rules(spark, path).get("max_years", MAX_YEARS))


def folded(words: Sequence[str]) -> tuple[str, ...]:
    return tuple(word.lower() for word in words)
