"""Rules kept in tables, with characters that mean something to a regex."""

from rolefeed.operators.filters import (
    experience_gate, matching_rule_table, with_experience, without_rule_table,
)

TITLES = ["C++ Dev", "Cxx Dev", "a.b", "axb", "Sr. Dev", "srx", "", "dev (x)", "DEV"]


def kept(spark, operator, terms):
    titles = spark.createDataFrame([(t,) for t in TITLES], "title string")
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    return {r.title for r in operator(titles, table).collect()}


def test_keywords(spark):
    assert kept(spark, matching_rule_table, ["c++", "a.b"]) == {"C++ Dev", "a.b"}
    assert kept(spark, matching_rule_table, ["(X)"]) == {"dev (x)"}
    assert kept(spark, matching_rule_table, [""]) == set(TITLES)
    assert kept(spark, matching_rule_table, []) == set()


def test_exclusions(spark):
    assert kept(spark, without_rule_table, [" SR "]) == set(TITLES) - {"Sr. Dev"}
    assert kept(spark, without_rule_table, ["a.b", "dev"]) == {"axb", "srx", ""}
    assert kept(spark, without_rule_table, []) == set(TITLES)


def test_null_terms_and_titles(spark):
    titles = spark.createDataFrame([(None,), ("dev",), ("dev",)], "title string")
    table = spark.createDataFrame([(None,), ("dev",)], "term string")
    assert matching_rule_table(titles, table).count() == 2  # repeated rows stay
    assert [r.title for r in without_rule_table(titles, table).collect()] == [None]


def test_many_terms(spark):
    titles = spark.createDataFrame([("Role 77777 x",), ("role 177777",), ("other",)], "title string")
    table = spark.range(100_000).selectExpr("'role ' || id as term")
    whole = spark.range(100_000).selectExpr("cast(id as string) as term")
    matching = matching_rule_table(titles, table)
    assert {r.title for r in matching.collect()} == {"Role 77777 x", "role 177777"}
    left = without_rule_table(titles, whole)
    assert {r.title for r in left.collect()} == {"role 177777", "other"}
    for frame in (matching, left):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan


def test_years_are_searched_once(spark):
    rows = spark.createDataFrame([("t", "2 years of experience"), ("u", None)], "title string, description string")
    for operator in (with_experience, experience_gate):
        plan = operator(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, plan
    assert [r.title for r in experience_gate(rows).collect()] == ["u"]
