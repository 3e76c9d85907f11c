"""Whole runs on a small world."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.errors import AnalysisException

from rolefeed import rules, schemas
from rolefeed.operators import report
from rolefeed.plans.flow import Rules, run
from rolefeed.plans.oracle import _YEARS
from rolefeed.session import shared_dir
from rolefeed.sources.catalog import lookup, read_catalog, routed
from rolefeed.sources.fetch_plan import fetch_plan
from rolefeed.sources.seen import read_seen, record_new

NOW = dt.datetime(2025, 1, 1)

CATALOG = [
    (0, "Acme", "https://boards.greenhouse.io/acme", None),
    (1, "Static", "https://static.example.com/careers", "generic"),
    (2, "Rendered", "https://rendered.example.com/careers", None),
    (3, "Senior only", "https://senior.example.com/", None),
    (4, "Broken", "https://jobs.lever.co/broken", None),
    (5, "Bad link", "https://bad.example.com/", None),
    (6, "Acme", "https://jobs.ashbyhq.com/acme2", None),
    (7, "Silent", "https://silent.example.com/", "taleo"),
]
PAYLOADS = [
    (0, "greenhouse", 0, json.dumps({"jobs": [
        {"title": "Software Engineer", "absolute_url": "https://a/1", "content": "<p>1+ years of experience</p>"},
        {"title": "Senior Software Engineer", "absolute_url": "https://a/2"},
        {"title": "ML Engineer", "absolute_url": "https://a/3", "content": "5 years of experience"},
        {"title": "Accountant", "absolute_url": "https://a/4"},
        {"title": "SWE", "absolute_url": None},
    ]})),
    (4, "lever", 0, '[{"text":"Software Engineer","hostedUrl":"https://l/1"},{"text":null,"hostedUrl":"u"}]'),
    (6, "ashby", 0, json.dumps({"jobs": [
        {"title": "Software Engineer", "jobUrl": "https://a/1"}, {"title": "Backend Engineer"}]})),
]
STATIC = [
    (1, "https://static.example.com/careers", '<a href="/swe">Junior</a><a href="/x">Senior SWE</a>'),
    (2, "https://rendered.example.com/careers", "<div id=root></div>"),
    (3, "https://senior.example.com/", '<a href="/swe">Senior SWE</a>'),
    (5, "https://bad.example.com/", '<a href="/swe">SWE</a><a href="http://[swe">x</a>'),
]
RENDERED = [
    (company, url, '<li><a href="/jobs/9"><h3>Data Steward</h3></a></li><a href="/jobs/8">Staff Nurse</a>')
    for company, _, url, _ in CATALOG if company in (1, 2, 3, 5)
]


@pytest.fixture()
def world(spark):
    return (
        spark.createDataFrame(CATALOG, schemas.CATALOG), spark.createDataFrame(PAYLOADS, schemas.PAYLOAD),
        spark.createDataFrame(STATIC, schemas.PAGE), spark.createDataFrame(RENDERED, schemas.PAGE),
    )


def titles(df):
    return sorted((r.company_ord, r.title, r.url) for r in df.collect())


def test_run(spark, world):
    path, digest, kept = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    outcome = run(*world, path, 1, NOW, digest, kept)
    assert titles(outcome.new) == sorted([
        (0, "Software Engineer", "https://a/1"), (0, "SWE", None),
        (1, "Junior", "https://static.example.com/swe"),
        (2, "Data Steward", "https://rendered.example.com/jobs/9"),
        (6, "Backend Engineer", None),  # https://a/1 was reported by company 0
    ], key=lambda r: r[:2])
    assert [tuple(r) for r in outcome.totals.collect()] == [(5, 1)]
    metrics = {r.company_ord: (r.matched, r.dropped) for r in outcome.companies.collect()}
    assert metrics == {0: (2, 1), 1: (1, 0), 2: (1, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (2, 0), 7: (0, 0)}
    totals = spark.read.parquet(f"{kept}/totals").collect()
    assert [(r.run_id, r.new_postings, r.dropped_for_experience) for r in totals] == [(1, 5, 1)]
    assert spark.read.parquet(f"{kept}/companies").count() == len(CATALOG)
    # The two companies named Acme share a block, in the place of the first.
    text = "\n".join(r.value for r in spark.read.text(digest).collect())
    assert text == "\n".join([
        "== Acme ==", "- Software Engineer (~1+ yrs stated)", "  https://a/1", "- SWE (YOE not stated)", "  None",
        "- Backend Engineer (YOE not stated)", "  None", "",
        "== Static ==", "- Junior (YOE not stated)", "  https://static.example.com/swe", "",
        "== Rendered ==", "- Data Steward (YOE not stated)", "  https://rendered.example.com/jobs/9", "",
    ])
    # The next run reports only what has no address to recognise it by.
    again = run(*world, path, 2, NOW)
    assert titles(again.new) == [(0, "SWE", None), (6, "Backend Engineer", None)]


def test_options(spark, world):
    def reported(**options):
        return {t for _, t, _ in titles(run(*world, shared_dir(spark), 0, NOW, chosen=Rules(**options)).new)}

    assert "Data Steward" not in reported(use_rendered=False)
    assert "Data Steward" not in reported(filter_rendered=True)
    assert "ML Engineer" in reported(max_years=5)
    assert "Senior Software Engineer" in reported(exclude=())
    kept = run(*world, shared_dir(spark), 0, NOW, chosen=Rules(on_bad="row")).new
    assert (4, "Software Engineer", "https://l/1") in titles(kept)


def test_no_postings_no_digest(spark, tmp_path):
    none = spark.createDataFrame([], schemas.SEEN)
    assert report.write_digest(none, str(tmp_path / "digest")) is False
    assert not (tmp_path / "digest").exists()
    assert report.digest_subject(none).count() == 0


def test_catalog_files(spark, tmp_path):
    yaml_file, json_file = tmp_path / "companies.yaml", tmp_path / "companies.json"
    yaml_file.write_text("companies:\n  - name: A\n    url: https://jobs.lever.co/a\n  - {name: B, url: u, type: generic}\n")
    json_file.write_text('{"company_ord":0,"name":"A","url":"https://jobs.lever.co/a"}\n{"company_ord":1,"name":"B","url":"u","type":"generic"}\n')
    for path in (yaml_file, json_file):
        rows = [tuple(r) for r in routed(read_catalog(spark, str(path))).orderBy("company_ord").collect()]
        assert rows == [(0, "A", "https://jobs.lever.co/a", None, "lever"), (1, "B", "u", "generic", "generic")]
    with pytest.raises(AnalysisException):
        read_catalog(spark, str(tmp_path / "missing.yaml"))


def test_rule_files(spark, tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("keywords: [swe, llm]\nmin_years: 0\n")
    assert rules.rule_list(spark, str(path), "keywords") == ("swe", "llm")
    assert rules.max_years(spark, str(path)) == rules.MAX_YEARS
    path.write_text("max_years: 3\n")
    assert rules.max_years(spark, str(path)) == 3


def test_rules_from_files(spark, tmp_path):
    files = {"keywords": "keywords: [dev]", "seniority": "exclude_terms: [lead]", "experience": "max_years: 4"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    chosen = Rules.read(spark, *(str(tmp_path / name) for name in files), use_rendered=False)
    assert chosen == Rules(keywords=("dev",), exclude=("lead",), max_years=4, use_rendered=False)


def test_runs_agree_with_a_plain_loop(spark):
    """Three runs over random responses, one posting after the other in plain Python."""
    rng = random.Random(5)
    titles = ["Software Engineer", "Sr. SWE", "Fulfillment", "Account Manager", "ML Engineer IV", "Full Stack, Lead", "LLM ops"]
    texts = [None, "", "1 yr experience", "10 years of experience", "2-3 yrs of prior experience", "6 years experience", "<b>3</b> years experience"]
    urls = [None, *(f"https://x/{i}" for i in range(25))]
    companies = [(i, f"C{i % 3}", f"https://boards.greenhouse.io/c{i}", None) for i in range(4)]
    catalog = spark.createDataFrame(companies, schemas.CATALOG)
    pages = spark.createDataFrame([], schemas.PAGE)
    path, seen = shared_dir(spark), set()
    for run_id in range(3):
        jobs = {i: [{"title": rng.choice(titles), "absolute_url": rng.choice(urls), "content": rng.choice(texts)}
                    for _ in range(rng.randint(0, 40))] for i, *_ in companies}
        payloads = spark.createDataFrame(
            [(i, "greenhouse", 0, json.dumps({"jobs": rows})) for i, rows in jobs.items()], schemas.PAYLOAD)
        expected, dropped = [], 0
        for i, name, *_ in companies:
            for ordinal, job in enumerate(jobs[i]):
                title, text = job["title"].lower(), (job["content"] or "").replace("<b>", "").replace("</b>", "").lower()
                if not any(k in title for k in rules.KEYWORDS) or any(re.search(rf"\b{t}\b", title) for t in rules.SENIORITY_TERMS):
                    continue
                years = None if any(p in text for p in rules.ENTRY_LEVEL_PHRASES) else min(
                    (int(m[0]) for m in re.findall(_YEARS, text)), default=None)
                if years is not None and years > 1:
                    dropped += 1
                elif job["absolute_url"] is None or job["absolute_url"] not in seen:
                    seen.add(job["absolute_url"])
                    expected.append((i, ordinal, name, job["title"], job["absolute_url"]))
        outcome = run(catalog, payloads, pages, pages, path, run_id, NOW)
        got = [(r.company_ord, r.posting_ord, r.company, r.title, r.url) for r in outcome.new.collect()]
        assert sorted(got, key=lambda r: r[:2]) == expected
        assert [tuple(r) for r in outcome.totals.collect()] == [(len(expected), dropped)]


def test_lookup(spark, world):
    assert [tuple(r) for r in lookup(world[0], "ACME").collect()] == [("Acme", "https://boards.greenhouse.io/acme")]
    assert [tuple(r) for r in lookup(world[0], "https://z").collect()] == [("https://z", "https://z")]
    assert lookup(world[0], "nobody").count() == 0


@pytest.mark.parametrize("total, workday, amazon", [
    (None, 1, 1), (0, 1, 1), (1, 1, 1), (20, 1, 1), (21, 2, 1), (100, 5, 1), (101, 6, 2), (500, 25, 5), (501, 26, 6),
    (521, 27, 6), (10**5, 5000, 1000),
])
def test_request_counts(spark, total, workday, amazon):
    catalog = spark.createDataFrame([
        (0, "https://a.wd1.myworkdayjobs.com/S", "workday", total), (1, "u", "amazon", total), (2, "u", "generic", total),
        (3, "https://nowhere.example.com", "workday", total),
    ], "company_ord long, url string, source_type string, total long")
    rows = fetch_plan(catalog).collect()
    counts = [sum(r.company_ord == c for r in rows) for c in range(4)]
    assert counts == [workday, amazon, 1, 0]
    assert max(r.page_offset for r in rows if r.company_ord == 0) == (workday - 1) * rules.WORKDAY_LIMIT


def test_last_offsets(spark):
    catalog = spark.createDataFrame([
        (0, "https://a.wd1.myworkdayjobs.com/S", "workday", 10**6), (1, "u", "amazon", 10**6),
    ], "company_ord long, url string, source_type string, total long")
    rows = fetch_plan(catalog, {"workday": 500, "amazon": 1000}).collect()
    assert [sum(r.company_ord == c for r in rows) for c in (0, 1)] == [26, 11]


def test_repeated_runs(spark, tmp_path):
    def postings(*urls):
        rows = [(0, i, "C", "t", u, None) for i, u in enumerate(urls)]
        return spark.createDataFrame(rows, "company_ord long, posting_ord long, company string, title string, url string, yoe_note string")

    path, digest = shared_dir(spark), str(tmp_path / "digest")

    def once(run_id, *urls):
        new = record_new(postings(*urls), path, run_id, NOW)
        report.write_digest(new, digest)
        return sorted(r.url for r in new.collect())

    assert once(1, "a") == ["a"]
    assert spark.read.text(digest).count() > 0
    assert once(1) == [] and spark.read.text(digest).count() == 0
    assert once(1, "a") == ["a"] and once(2, "a", "b") == ["b"]
    # An older run again, with a posting that a later run has reported meanwhile.
    assert once(1, "a", "b", "c") == ["a", "c"]
    assert sorted((r.run_id, r.url) for r in read_seen(spark, path).collect()) == [(1, "a"), (1, "c"), (2, "b")]


def test_company_without_a_name(spark):
    rows = spark.createDataFrame([(0, 0, None, "t", "u", "n"), (1, 0, "B", "t", "v", "n")],
                                 "company_ord long, posting_ord long, company string, title string, url string, yoe_note string")
    lines = [r.line for r in report.digest_lines(rows).orderBy(*report.DIGEST_ORDER).collect()]
    assert lines[0] == "== None ==" and lines[3] == "== B ==" and len(lines) == 6


def test_shared_dir_needs_a_setting_on_a_cluster(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
            self.sparkContext = self

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError):
        shared_dir(Session(spark_master="yarn"))
    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y")).startswith("hdfs://x/y/")
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_seventh_platform(spark):
    from pyspark.sql import functions as F

    from rolefeed.sources.adapters import Adapter
    from rolefeed.sources.payloads import Field, Platform, value_of

    def fetch(company, url):
        if company == "Down":
            raise TimeoutError
        if company == "Odd":
            return [{"title": 5, "url": "u"}]
        return ({"title": "SWE", "url": f"{url}{n}", "description": f"{n} yrs experience"} for n in range(3))

    own = Adapter("board", "board.example/", Platform(
        "roles", (Field("name", required=True, nullable=False), Field("link")),
        lambda: value_of("name"), lambda: value_of("link"), lambda: F.lit(None).cast("string")))
    called = Adapter("called", "greenhouse.io/called/", fetch=fetch)
    catalog = spark.createDataFrame([
        (0, "Own", "https://board.example/x", None), (1, "Typed", "https://x.example/", "board"), (2, "Called", "https://greenhouse.io/called/c", None),
        (3, "Down", "https://x.example/", "called"), (4, "Odd", "https://x.example/", "called"), (5, "Other", "https://boards.greenhouse.io/o", None),
    ], schemas.CATALOG)
    payloads = spark.createDataFrame([
        (0, "board", 0, '{"roles":[{"name":"SWE","link":"b/1"},{"name":"Clerk","link":"b/2"}]}'), (1, "board", 0, '{"roles":[{"link":"b/3"}]}'),
        (5, "greenhouse", 0, '{"jobs":[{"title":"SWE","absolute_url":"g/1"}]}'),
    ], schemas.PAYLOAD)
    pages = spark.createDataFrame([], schemas.PAGE)
    outcome = run(catalog, payloads, pages, pages, shared_dir(spark), 0, NOW, adapters=(own, called))
    assert titles(outcome.new) == [(0, "SWE", "b/1"), (2, "SWE", "https://greenhouse.io/called/c0"),
                                   (2, "SWE", "https://greenhouse.io/called/c1"), (5, "SWE", "g/1")]
    assert {(r.company_ord, r.reason) for r in outcome.quarantined.collect()} == {
        (1, "missing field: name"), (3, "adapter failed: TimeoutError"), (4, "unusable value: title")}
    assert {r.company_ord: r.dropped for r in outcome.companies.collect()}[2] == 1


def test_fetch_rounds(spark):
    """A listing whose total grows, one that ends early, one that is silent; every page once."""
    from rolefeed.sources.fetch_plan import fetch_rounds

    catalog = spark.createDataFrame([
        (0, "https://a.wd1.myworkdayjobs.com/S", "workday", None), (1, "u", "amazon", None), (2, "u", "lever", None),
        (3, "https://b.wd1.myworkdayjobs.com/S", "workday", None), (4, "https://c.wd1.myworkdayjobs.com/S", "workday", None),
        (5, "https://nowhere.example.com", "workday", None),
    ], "company_ord long, url string, source_type string, total long")
    # Total reported on a page, and whether it holds postings.
    site = {
        (0, 0): (25, 1), (0, 20): (65, 1), (0, 40): (65, 1), (0, 60): (65, 1), (1, 0): (250, 1), (1, 100): (250, 0), (1, 200): (900, 1),
        (2, 0): (0, 1), (3, 0): (0, 0),
    }
    asked = []

    def fetch(todo):
        rows = [(r.company_ord, r.source_type, r.page_offset) for r in todo.collect()]
        asked.append(sorted((c, o) for c, _, o in rows))
        landed = []
        for company, kind, offset in rows:
            if (company, offset) in site:
                total, full = site[company, offset]
                names = ("total", "jobPostings") if kind == "workday" else ("hits", "jobs")
                landed.append((company, kind, offset, json.dumps({names[0]: total, names[1]: [{"title": "t"}] * full})))
        return spark.createDataFrame(landed, schemas.PAYLOAD)

    requests, landed = fetch_rounds(catalog, fetch)
    assert asked == [[(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)], [(0, 20), (1, 100), (1, 200)], [(0, 40), (0, 60)]]
    assert requests.count() == 10 and landed.count() == 9 and requests.where("round = 2").count() == 2
    none, nothing = fetch_rounds(catalog.limit(0), fetch)
    assert none.count() == 0 and none.columns == requests.columns and nothing.count() == 0
