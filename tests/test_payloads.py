"""Responses that are damaged or unusual."""

import json

import pytest

from rolefeed.sources.payloads import normalise, normalise_all, quarantined, reported_totals, usable, with_catalog


def landed(spark, bodies, source_type="greenhouse", url="https://boards.greenhouse.io/acme"):
    rows = [
        (company, f"C{company}", url, source_type, offset, body if isinstance(body, str) or body is None else json.dumps(body))
        for company, offset, body in bodies
    ]
    return spark.createDataFrame(
        rows, "company_ord long, company string, catalog_url string, source_type string, page_offset long, body string")


def good(spark, bodies, source_type, url="https://boards.greenhouse.io/acme"):
    rows = usable(normalise(landed(spark, bodies, source_type, url), source_type)).collect()
    return sorted((r.company_ord, r.posting_ord, r.title, r.url, r.description) for r in rows)


def test_greenhouse(spark):
    jobs = [{"title": " A\u200b  B ", "absolute_url": None, "content": "<b>x</b>y"}, {"title": "C", "absolute_url": "u"}]
    assert good(spark, [(1, 0, {"jobs": jobs, "meta": {}}), (2, 0, {})], "greenhouse") == [
        (1, 0, "A B", None, "x y"), (1, 1, "C", "u", "")]


@pytest.mark.parametrize("body", [
    '{"jobs":[{"title":"a","absolute_url":"u"},{"ti', "<html>", "", None, "[]", "null", '{"jobs":{"a":1}}', '{"jobs":[1]}',
    '{"jobs":[null]}', "{'jobs':[]}", '{"jobs":[]} x', '{"jobs":[]}{"jobs":[]}', '{"jobs":[]}}', '{"jobs":[{"title":"a"}]}', '{"jobs":[{"absolute_url":"u"}]}',
    '{"jobs":[{"title":null,"absolute_url":"u"}]}', '{"jobs":[{"title":5,"absolute_url":"u"}]}',
    '{"jobs":[{"title":"a","absolute_url":"u","content":7}]}',
])
def test_one_bad_record_fails_its_company_only(spark, body):
    fine = {"jobs": [{"title": "ok", "absolute_url": "u"}]}
    rows = normalise(landed(spark, [(1, 0, fine), (1, 100, body), (2, 0, fine)]), "greenhouse")
    assert [(r.company_ord, r.title) for r in usable(rows).collect()] == [(2, "ok")]
    assert {r.company_ord for r in quarantined(rows).collect()} == {1}
    assert sum(r.title == "ok" for r in usable(rows, "row").collect()) == 2


@pytest.mark.parametrize("empty", [False, 0, 0.0, [], {}, "", None])
def test_empty_values_of_any_type_are_missing(spark, empty):
    assert good(spark, [(1, 0, {"jobs": [{"title": "a", "absolute_url": "u", "content": empty}]})], "greenhouse") == [(1, 0, "a", "u", "")]
    jobs = [{"text": "a", "hostedUrl": "u", "descriptionPlain": empty, "description": "<b>x</b>"},
            {"text": "b", "hostedUrl": "u", "descriptionPlain": empty, "description": empty},
            {"text": "c", "hostedUrl": "u", "descriptionPlain": "p", "description": 7}]
    assert [r[4] for r in good(spark, [(1, 0, jobs)], "lever")] == ["x", "", "p"]
    jobs = {"jobs": [{"title": "a", "jobUrl": empty, "applyUrl": "v", "descriptionHtml": empty}]}
    assert good(spark, [(1, 0, jobs)], "ashby") == [(1, 0, "a", "v", None)]
    url = "https://acme.wd3.myworkdayjobs.com/Jobs"
    assert good(spark, [(1, 0, {"jobPostings": [{"title": "a", "externalPath": empty}]})], "workday", url) == [(1, 0, "a", url, None)]
    jobs = {"jobs": [{"title": "a", "job_path": empty, "description_short": empty}]}
    assert good(spark, [(1, 0, jobs)], "amazon", "cat") == [(1, 0, "a", "cat", None)]


@pytest.mark.parametrize("value", [True, 1, 2.5, ["x"], {"a": 1}])
def test_other_values_in_place_of_a_text_are_bad(spark, value):
    fine = {"jobs": [{"title": "ok", "absolute_url": "u"}]}
    rows = normalise(landed(spark, [(1, 0, {"jobs": [{"title": "a", "absolute_url": "u", "content": value}]}), (2, 0, fine)]), "greenhouse")
    assert [r.company_ord for r in usable(rows).collect()] == [2]
    assert [r.bad for r in quarantined(rows).collect()] == ["unusable value: content"]
    lever = [{"text": "a", "hostedUrl": "u", "descriptionPlain": "", "description": value}]
    assert good(spark, [(1, 0, lever)], "lever") == []
    # An empty title of another type has no letters to look for keywords in.
    assert good(spark, [(1, 0, {"jobs": [{"title": False, "absolute_url": "u"}]})], "greenhouse") == []


@pytest.mark.parametrize("number", ["1", "1.0", "1.50", "true", "false", "0", "0.0", "1e3", "1e16", "12345678.5", "1e-5", "0.0001", "123456789012345678",
                                    "12345678901234567890", "1.5e300", "123456789.0", "1e15", "3.14e-7", "1e-320", '"x"'])
def test_ids_are_written_as_numbers_are(spark, number):
    body = '{"content":[{"id":%s,"name":"A"}]}' % number
    ((_, _, _, url, _),) = good(spark, [(1, 0, body)], "smartrecruiters", "https://jobs.smartrecruiters.com/Acme")
    assert url == f"https://jobs.smartrecruiters.com/Acme/{json.loads(number)}"


def test_unknown_failure_policy(spark):
    with pytest.raises(ValueError):
        usable(normalise(landed(spark, []), "greenhouse"), "page")


def test_lever(spark):
    jobs = [{"text": "A", "hostedUrl": "u", "descriptionPlain": "<i>p</i>", "description": "<b>no</b>"},
            {"text": "B", "hostedUrl": "v", "descriptionPlain": "", "description": "<b>yes</b>"},
            {"text": "C", "hostedUrl": "w"}]
    assert good(spark, [(1, 0, jobs), (2, 0, {"text": "x"})], "lever") == [
        (1, 0, "A", "u", "<i>p</i>"), (1, 1, "B", "v", "yes"), (1, 2, "C", "w", "")]


def test_smartrecruiters(spark):
    jobs = {"content": [{"id": "7", "name": "A"}, {"id": 8, "name": "B"}, {"id": None, "name": "C"}]}
    url = "https://jobs.smartrecruiters.com/Acme/"
    assert good(spark, [(1, 0, jobs)], "smartrecruiters", url) == [
        (1, i, t, f"https://jobs.smartrecruiters.com/Acme/{id_}", None)
        for i, (t, id_) in enumerate([("A", "7"), ("B", "8"), ("C", "None")])]


def test_ashby(spark):
    jobs = {"jobs": [{"title": "A", "jobUrl": "", "applyUrl": "u", "descriptionHtml": ""},
                     {"title": "B", "descriptionHtml": "<p>d</p>"}]}
    assert good(spark, [(1, 0, jobs)], "ashby") == [(1, 0, "A", "u", None), (1, 1, "B", None, "d")]


def test_workday(spark):
    url = "https://acme.wd3.myworkdayjobs.com/en-US/Jobs"
    bodies = [(1, 0, {"total": 3, "jobPostings": [{"title": "A", "externalPath": "/job/1"}, {}]}),
              (1, 20, {"jobPostings": [{"title": "B", "externalPath": ""}]}), (1, 40, {"jobPostings": None}), (1, 60, {})]
    assert good(spark, bodies, "workday", url) == [
        (1, 0, "A", "https://acme.wd3.myworkdayjobs.com/job/1", None), (1, 1, "", url, None), (1, 20, "B", url, None)]
    assert good(spark, bodies, "workday", "https://acme.example.com") == []


def test_amazon(spark):
    bodies = [(1, 0, {"hits": 2, "jobs": [{"title": "A", "job_path": "/en/1", "description_short": " 3 yrs\n experience"},
                                          {"title": "B", "description_short": ""}]})]
    assert good(spark, bodies, "amazon", "cat") == [
        (1, 0, "A", "https://www.amazon.jobs/en/1", "3 yrs experience"), (1, 1, "B", "cat", None)]


def test_reported_totals(spark):
    bodies = [(1, 0, {"total": 50}), (1, 20, {"total": 45}), (2, 0, {}), (3, 0, "oops")]
    got = {r.company_ord: r.total for r in reported_totals(landed(spark, bodies, "workday")).collect()}
    assert got == {1: 45, 2: 0, 3: 0}


def test_only_the_routed_platform_counts(spark):
    catalog = spark.createDataFrame(
        [(1, "greenhouse", "One", "u1"), (2, "generic", "Two", "u2")], "company_ord long, source_type string, name string, url string")
    payload = landed(spark, [(1, 0, {"jobs": [{"title": "a", "absolute_url": "u"}]}), (2, 0, {"jobs": [{"title": "b", "absolute_url": "u"}]})])
    rows = normalise_all(with_catalog(payload.drop("company", "catalog_url"), catalog)).collect()
    assert [(r.company, r.title) for r in rows] == [("One", "a")]
