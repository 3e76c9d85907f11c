"""Scalar functions on values that the test tables do not have."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rolefeed.functions.experience import experience_note, min_years_required
from rolefeed.functions.text import card_title, clean_text, html_to_text, link_title
from rolefeed.functions.urls import detect_platform, host_path, resolve_type, route, url_slug, workday_board
from rolefeed.operators.filters import (
    is_card_title, is_job_link, link_matches, title_matches, too_senior, whole_words,
)
from rolefeed.plans.oracle import _YEARS


def apply(spark, values, make, schema="v string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r.out for r in df.select("i", make().alias("out")).orderBy("i").collect()]


def v():
    return F.col("v")


def test_clean_text(spark):
    cases = {
        None: None, "": "", "  a  b ": "a b", "a\xa0b": "a b", "a\u200bb": "ab", "a\u2028b": "a b",
        "a\x85\u2029\u3000\x1c\x1fb\t\n": "a b", "\u200b": "", "\ufeffa\u200c": "\ufeffa\u200c",
        "x \u200b y": "x y", "\v\fq\r\n": "q",
    }
    assert apply(spark, list(cases), lambda: clean_text(v())) == list(cases.values())


def test_clean_text_agrees_with_python(spark):
    rng = random.Random(7)
    alphabet = "ab \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u200a\u200b\u200c\u2028\u2029\u202f\u205f\u3000\ufeff\xe9"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(400)]
    expected = [" ".join(t.replace("\u200b", "").split()) for t in texts]
    assert apply(spark, texts, lambda: clean_text(v())) == expected


def test_html_to_text(spark):
    cases = {
        None: "", "": "", "plain  text": "plain text", "a < b": "a < b",
        "<p>4&nbsp;years  experience</p>": "4 years experience",
        "<ul><li>one</li><li>two</li></ul>": "one two",
        "<b>bo</b>ld": "bo ld", "a<!-- c -->b": "a b",
        "<style>p{}</style>x<script>var a='<p>';</script>y": "x y",
        "&lt;p&gt;kept&lt;/p&gt;": "<p>kept</p>",
        "caf&eacute; &#8211; &#x41; &#150;": "café – A –", "&nosuch; x": "&nosuch x",
    }
    assert apply(spark, list(cases), lambda: html_to_text(v())) == list(cases.values())


def test_years_table(spark):
    cases = {
        "3-5 years of experience": 3, "2 - 4 years of relevant experience": 2,
        "3–5 years of experience": 5, "3 to 5 years of experience": 5, "1.5 years of experience": 5,
        "7 yrs of prior experience and 2 years of professional experience": 2,
        "2 years of software experience": None, "3 years' experience": None,
        "5 plus years of experience": None, "3 years of relevant professional experience": None,
        "5 years ofexperience": None, "10 years of experience": 0, "100 years of experience": 0,
        "10+ years of experience": 10, "20+ years of experience": 20, "12 years experience": 12,
        "refresher course, 8 years experience": 0, "new grading rubric; 9 yrs experience": 0,
        "4\xa0years\x1fexperience": 4, "٣ years experience": 3, "007 YEARS EXPERIENCE": 7,
        "12345678901234567890 years experience": 2**63 - 1, "1000000000000000000 years experience": 10**18, "0" * 30 + "5 years experience": 5,
        "1" * 5000 + " " * 5000: None, None: None, "": None, "We ship things": None,
    }
    assert apply(spark, list(cases), lambda: min_years_required(v())) == list(cases.values())


def test_years_agree_with_the_plain_pattern(spark):
    """The pattern in use scans in linear time; it must find what the plain one finds."""
    rng = random.Random(11)
    parts = ["1", "23", "٤", "+", "-", " ", "  ", "\xa0", "year", "years", "yrs", "yr", "of ", "of", "relevant ",
             "prior ", "professional ", "experience", "Experience", "x", ".", "4-6", "5 - 8"]
    likely = ["3", "+", " ", "years", " ", "of ", "prior ", "experience"]
    texts = []
    for _ in range(3000):
        chosen = [rng.choice(parts) if rng.random() < 0.3 else p for p in likely * rng.randint(1, 3)]
        texts.append("".join(p for p in chosen if rng.random() < 0.93))
    plain = re.compile(_YEARS, re.IGNORECASE)
    expected = [min((int(m[0]) for m in plain.findall(t.lower())), default=None) for t in texts]
    assert sum(e is not None for e in expected) > 500
    assert apply(spark, texts, lambda: min_years_required(v(), ())) == expected


def test_notes(spark):
    assert apply(spark, [None, 0, 3], lambda: experience_note(v()), "v bigint") == [
        "YOE not stated", "~0+ yrs stated", "~3+ yrs stated"]


def test_slug_and_platform(spark):
    slugs = {"https://x.io/a/": "a", "https://x.io/a//": "a", "https://x.io/a?b=c": "a?b=c", "a": "a", "": "", "//": ""}
    assert apply(spark, list(slugs), lambda: url_slug(v())) == list(slugs.values())
    platforms = {
        "https://boards.greenhouse.io/x": "greenhouse", "https://jobs.lever.co/x": "lever",
        "https://www.AMAZON.jobs/": "generic", "https://x.myworkdayjobs.com/lever.co": "lever",
        "https://jobs.ashbyhq.com/x": "ashby", "": "generic",
    }
    assert apply(spark, list(platforms), lambda: detect_platform(v())) == list(platforms.values())


def test_resolved_type_and_route(spark):
    rows = [(None, "https://jobs.lever.co/x"), ("", "https://jobs.lever.co/x"), ("generic", "https://jobs.lever.co/x"), ("taleo", "u")]
    make = lambda: resolve_type(F.col("t"), F.col("u"))
    assert apply(spark, rows, make, "t string, u string") == ["lever", "lever", "generic", "taleo"]
    assert apply(spark, rows, lambda: route(make()), "t string, u string") == ["lever", "lever", "generic", "generic"]


def test_workday_board(spark):
    cases = {
        "https://capitalone.wd12.myworkdayjobs.com/en-US/Capital_One": ("capitalone", "wd12", "Capital_One"),
        "https://cisco.wd5.myworkdayjobs.com/Cisco_Careers": ("cisco", "wd5", "Cisco_Careers"),
        "see HTTP://A.WD1.MyWorkdayJobs.com/Site/job/x": ("A", "WD1", "job"),
        "https://a.myworkdayjobs.com/Site": (None, None, None),
    }
    for part in range(3):
        got = apply(spark, list(cases), lambda: workday_board(v())[part])
        assert got == [parts[part] for parts in cases.values()]


def test_host_path(spark):
    rows = [("/a",), ("",), (None,)]
    assert apply(spark, rows, lambda: host_path(F.lit("h"), v(), F.lit("fall"))) == ["h/a", "fall", "fall"]


def test_titles(spark):
    titles = {
        "Fulfillment Lead": True, "Enrollment": True, "Answer desk": True, "Account Manager": False,
        "FULL-STACK dev": True, "": False, None: None,
    }
    assert apply(spark, list(titles), lambda: title_matches(v())) == list(titles.values())
    assert apply(spark, ["x", "llm"], lambda: title_matches(v(), ())) == [False, False]
    assert apply(spark, ["x"], lambda: title_matches(v(), ("",))) == [True]


def test_seniority(spark):
    titles = {
        "Senior Dev": True, "Sr. Dev": True, "Seniority Analyst": False, "Dev III": True, "Dev IIII": False,
        "Head  of X": False, "head of x": True, "MVP": False, "VP": True, "sr_dev": False, "Leadership": False,
        "Team-Lead": True, "élead": False, "lead²": False, "Dev IV/V": True,
    }
    assert apply(spark, list(titles), lambda: too_senior(v())) == list(titles.values())


@pytest.mark.parametrize("term", ["c++", ".net", "a.b", " lead ", "(x)", "", "ü"])
def test_whole_words_agree_with_python(spark, term):
    texts = ["c++", "c++x", "xc++", "x.net", ".net", ".net y", "a.b", "acb", "lead", "a lead", "leads", "(x)", "y(x)z",
             "", " ", "!", "ü", "für", "a ü b", "c++ c++x"]
    python = re.compile(r"\b" + re.escape(term.strip().lower()) + r"\b")
    expected = [bool(python.search(t)) for t in texts]
    assert apply(spark, texts, lambda: v().rlike(whole_words([term]))) == expected


def test_links_and_cards(spark):
    assert apply(spark, [("", "/SWE")], lambda: link_matches(F.col("t"), F.col("h")), "t string, h string") == [True]
    hrefs = {"/Jobs/1": True, "/career": False, "x?JobId=3": True, "/job": False, "": False}
    assert apply(spark, list(hrefs), lambda: is_job_link(v())) == list(hrefs.values())
    titles = {"Dev": False, "Devs": True, "Privacy notice": False, "COOKIES!": False}
    assert apply(spark, list(titles), lambda: is_card_title(v())) == list(titles.values())
    assert apply(spark, [("",)], lambda: link_title(v(), "none")) == ["none"]


def test_card_title(spark):
    rows = [("Heading", "Heading and more", "", "Heading"), ("Head", "Head and more", "", "Head and more"),
            (None, "text", "", "text"), (None, "text", "longer label", "longer label"), ("Heading", "t", "label", "Heading")]
    make = lambda: card_title(F.col("h"), F.col("t"), F.col("a"))
    assert apply(spark, [r[:3] for r in rows], make, "h string, t string, a string") == [r[3] for r in rows]


def test_resolved_like_urljoin(spark):
    """Ten thousand random pairs, and every base with every form."""
    import random
    from urllib.parse import urljoin

    from rolefeed.functions.resolve import resolved

    rng = random.Random(8)
    parts = ["/", "/", "//", ".", "..", "a", "b.html", "?", "q=1", "#", "f", ":", ";", "p=2", "@", "%20", "é", " ", "\t", "\n", "\x01", "[", "]",
             "[::1]", "host.example", "https:", "http://", "HTTP:", "mailto:", "javascript:", "-", "+", "1", "\u2100", "\uff1a", "ws:", "file:", "data:,"]
    bases = ["https://x.example.com/a/b/c", "http://x.example.com", "https://x.example.com/a/b/?q=1#f", "http://h/a;p=1?q", "", None,
             "file:///a/b", "mailto:x@y", "//h/a/b", "a/b", "/a/b/", "https:", "https://u:p@[::1]:8/x", "http://[bad/x", "ws://h/a;b/c;d", "?q", "https://h/.."]
    pairs = [("".join(rng.choices(parts, k=rng.randint(0, 6))) if rng.random() < 0.3 else rng.choice(bases),
              "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(10000)]
    forms = ["", ".", "..", "./", "../", "../..", "../../g", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "g;x", "g;x?y#s", "g;", "g?", "g#",
             "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "http:g", "https:g", "a//b", "//", "///x", " x"]
    pairs += [(b, f) for b in bases for f in forms]

    def expected(base, address):
        try:
            return urljoin(base or "", address)
        except ValueError:
            return None

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, base string, address string")
    got = {r.i: r.resolved for r in df.select("i", resolved(F.col("base"), F.col("address")).alias("resolved")).collect()}
    wrong = [(b, a, got[i], expected(b, a)) for i, (b, a) in enumerate(pairs) if got[i] != expected(b, a)]
    assert not wrong, (len(wrong), wrong[:10])
    assert sum(v is None for v in got.values()) > 100
    assert spark.sql("select 1").select(resolved(F.lit("https://h/"), F.lit(None).cast("string"))).first()[0] is None


def test_strict_options(spark):
    from rolefeed.operators.filters import experience_gate, role_filter

    rows = [(i, t, d) for i, (t, d) in enumerate([
        ("Fulfillment lead-in", None), ("LLM engineer", "10 years of experience"), ("Answer desk", ""), ("SWE", "0 years of experience"),
        ("full-stack dev", "100 years of experience; no prior experience"), ("Backend  Engineer", None)])]
    df = spark.createDataFrame(rows, "i int, title string, description string")
    assert [r.i for r in role_filter(df, whole_word=True).collect()] == [1, 3, 4]
    assert [r.i for r in role_filter(df, exclude=()).collect()] == [0, 1, 2, 3, 4]
    assert role_filter(df, keywords=(), whole_word=True).count() == 0
    assert {r.i: r.yoe_note for r in experience_gate(df, strict_zero=True).collect()}.keys() == {0, 2, 3, 4, 5}
    assert experience_gate(df).count() == 6
