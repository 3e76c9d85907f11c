"""Input views over the driver's test tables that reach every branch of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefeed.functions.choice import first_match
from rolefeed.session import spread

# Runs unchanged in Spark and DuckDB.
POSTINGS_SQL = """
select o.o_orderkey as posting_ord, cast(n.n_nationkey as bigint) as company_ord, n.n_name as company,
 concat(case cast(o.o_orderkey % 8 as int) when 0 then 'Senior ' when 1 then 'Sr. '
             when 2 then 'Junior ' when 3 then 'Lead ' else '' end,
        case cast(o.o_custkey % 7 as int) when 0 then 'Software Engineer'
             when 1 then 'Backend Engineer' when 2 then 'Fulfillment Associate'
             when 3 then 'Account Manager' when 4 then 'ML Engineer'
             when 5 then 'Full Stack Developer' else 'Sales Representative' end,
        case cast(o.o_orderkey % 5 as int) when 0 then ' III' when 1 then ' II' else '' end) as title,
 case when o.o_orderkey % 97 = 0 then null
      when o.o_orderkey % 89 = 0 then concat('https://jobs.example.com/shared/', cast(o.o_orderkey % 10 as varchar(20)))
      else concat('https://jobs.example.com/', cast(n.n_nationkey as varchar(20)), '/', cast(o.o_orderkey % 401 as varchar(20))) end as url,
 case cast(o.o_orderkey % 13 as int)
  when 0 then null when 1 then '' when 2 then '1+ years of experience'
  when 3 then '3-5 years of professional experience' when 4 then '10 years of experience'
  when 5 then 'Entry level role' when 6 then '8+ yrs experience'
  when 7 then '7 yrs of prior experience and 1 year of relevant experience'
  when 8 then 'We ship things' when 9 then '2 years of software experience'
  when 10 then 'Refresher: 6 years experience'
  when 11 then '<p>4&nbsp;years  experience</p>' else '4 years experience' end as description,
 o.o_orderdate as captured_at,
 cast(year(o.o_orderdate) * 100 + month(o.o_orderdate) as bigint) as run_id
from {orders} o join {nation} n on cast(o.o_custkey % 25 as int) = n.n_nationkey
"""

CATALOG_SQL = """
select s_suppkey as company_ord, s_name as name,
 case cast(s_suppkey % 8 as int)
  when 0 then concat('https://boards.greenhouse.io/c', cast(s_suppkey as varchar(20)))
  when 1 then concat('https://jobs.lever.co/c', cast(s_suppkey as varchar(20)), '/')
  when 2 then concat('https://jobs.smartrecruiters.com/c', cast(s_suppkey as varchar(20)))
  when 3 then concat('https://jobs.ashbyhq.com/c', cast(s_suppkey as varchar(20)))
  when 4 then concat('https://t', cast(s_suppkey as varchar(20)), '.wd5.myworkdayjobs.com/en-US/Site_', cast(s_suppkey as varchar(20)))
  when 5 then 'https://www.amazon.jobs/en/search?base_query=x'
  when 6 then concat('https://c', cast(s_suppkey as varchar(20)), '.example.com/careers')
  else concat('https://T', cast(s_suppkey as varchar(20)), '.WD1.myworkdayjobs.com/Careers') end as url,
 case when s_suppkey % 11 = 5 then 'generic' when s_suppkey % 17 = 3 then 'taleo'
      when s_suppkey % 13 = 0 then ''
      when s_suppkey % 3 = 0 then 'greenhouse' else null end as type,
 cast(s_suppkey * 7 % 1500 as bigint) as total
from {supplier}
"""

# One company per nation; the platform goes by company_ord unless one is given for all.
COMPANY_URLS = {
    "greenhouse": "https://boards.greenhouse.io/c{}",
    "lever": "https://jobs.lever.co/c{}",
    "smartrecruiters": "https://jobs.smartrecruiters.com/c{}",
    "ashby": "https://jobs.ashbyhq.com/c{}",
    "workday": "https://t{}.wd5.myworkdayjobs.com/en-US/Site_{}",
    "amazon": "https://www.amazon.jobs/en/search?c={}",
}

# Posting ids per landed response, which bounds the size of a response.
PAGE_IDS = 2500
# The name of the title field per platform.
TITLE_FIELD = {
    "greenhouse": "title", "lever": "text", "smartrecruiters": "name", "ashby": "title",
    "workday": "title", "amazon": "title",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        POSTINGS_SQL, orders=table(spark, sf_dir, "orders"), nation=table(spark, sf_dir, "nation")
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOG_SQL, supplier=table(spark, sf_dir, "supplier"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


# The links of ``nested_pages``: a list item holds a box with a first link, which holds a heading, and
# behind the box a second link.
NESTED_ITEM = (
    '<li><div>Open <a href="/jobs/$1"><h3>Role $2</h3> <i>apply</i></a></div> till <b>May</b> '
    '<a href="/jobs/x$1">$2 more</a></li>'
)
NESTED_FRAGMENTS = ("/jobs/",)


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` whose list items hold links with headings, in parents inside parents."""
    item = r'<li><a href="/([^"]*)">([^<]*)</a></li>'
    return pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", item, NESTED_ITEM))


# Addresses of every form that a page may hold.
ADDRESS_FORMS = (
    "x/y", "./x?q=1#f", "../x", "../../../x", "/a/./b/../c/", "?n=1", "#top", "//cdn.example.com/x", "mailto:a@b.example", "",
    "HTTP://Up.example/X/../Y", "x//y", "g;p=1/../h", " x y ", "..", ".", "g;p=1", "http://[bad", "http://[::1]:80/x", "x?a=/../b",
)


def seventh_payloads(spark: SparkSession, sf_dir: str, source_type: str) -> DataFrame:
    """``postings`` of every second company as responses of a platform of its own."""
    item = F.struct(
        "posting_ord", F.col("title").alias("headline"),
        F.when(F.col("posting_ord") % 4 > 0, F.col("posting_ord")).alias("ref"), F.col("description").alias("summary"),
    )
    page = (F.col("posting_ord") - F.col("posting_ord") % PAGE_IDS).alias("page_offset")
    grouped = postings(spark, sf_dir).where("company_ord % 2 = 0").groupBy("company_ord", page).agg(
        F.array_sort(F.collect_list(item)).alias("items"))
    shaped = F.transform("items", lambda x: x.dropFields("posting_ord"))
    return grouped.select(
        "company_ord", F.lit(source_type).alias("source_type"), "page_offset",
        F.to_json(F.struct(shaped.alias("openings")), {"ignoreNullFields": "false"}).alias("body"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _choose(key, values: dict):
    return first_match((key == name, value) for name, value in values.items())


def platform_of(company_ord, source_type: str | None = None):
    names = F.array(*(F.lit(name) for name in COMPANY_URLS))
    return F.lit(source_type) if source_type else F.get(names, (company_ord % 6).cast("int"))


def companies(spark: SparkSession, sf_dir: str, source_type: str | None = None) -> DataFrame:
    """Routed catalog of the 25 companies in ``postings``."""
    ord_ = F.col("n_nationkey").cast("bigint")
    return (
        table(spark, sf_dir, "nation")
        .select(ord_.alias("company_ord"), F.col("n_name").alias("name"),
                platform_of(ord_, source_type).alias("type"))
        .withColumn("source_type", F.col("type"))
        .withColumn("url", company_url(F.col("type"), F.col("company_ord")))
    )


def company_url(kind, company_ord):
    return _choose(kind, {
        name: F.replace(F.lit(url), F.lit("{}"), company_ord.cast("string"))
        for name, url in COMPANY_URLS.items()
    })


def payloads(spark: SparkSession, sf_dir: str, source_type: str | None = None) -> DataFrame:
    """``postings`` as the JSON responses of their companies' platforms.

    A response holds the postings of one company out of ``PAGE_IDS`` consecutive ids, so no group
    grows with the data.
    """
    page = (F.col("posting_ord") - F.col("posting_ord") % PAGE_IDS).alias("page_offset")
    item = F.struct("posting_ord", "title", "url", "description")
    grouped = (
        postings(spark, sf_dir).groupBy("company_ord", page)
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .withColumn("source_type", platform_of(F.col("company_ord"), source_type))
    )
    path = lambda x: F.coalesce(F.regexp_extract(x.url, "^https://[^/]+(.*)$", 1), F.lit(""))
    keep = {"ignoreNullFields": "false"}  # write null, where platforms do

    def items(shape):
        return F.transform("items", shape)

    even = lambda x: x.posting_ord % 2 == 0
    bodies = {
        "greenhouse": F.to_json(F.struct(items(lambda x: F.struct(
            x.title.alias("title"), x.url.alias("absolute_url"), x.description.alias("content"),
        )).alias("jobs")), keep),
        "lever": F.to_json(items(lambda x: F.struct(
            x.title.alias("text"), x.url.alias("hostedUrl"),
            F.when(even(x), x.description).alias("descriptionPlain"),
            F.when(~even(x), x.description).alias("description"),
        )), keep),
        # Numbers as ids, those that end in 7 with a decimal point.
        "smartrecruiters": F.regexp_replace(F.regexp_replace(F.to_json(F.struct(items(lambda x: F.struct(
            F.substring_index(x.url, "/", -1).alias("id"), x.title.alias("name"),
        )).alias("content")), keep), r'"id":"([0-9]*7)"', '"id":$1.0'), r'"id":"([0-9]*3)"', '"id":$1'),
        "ashby": F.to_json(F.struct(items(lambda x: F.struct(
            x.title.alias("title"), F.when(even(x), x.url).alias("jobUrl"),
            F.when(~even(x), x.url).alias("applyUrl"), x.description.alias("descriptionHtml"),
        )).alias("jobs"))),
        "workday": F.to_json(F.struct(F.size("items").alias("total"), items(lambda x: F.struct(
            x.title.alias("title"), path(x).alias("externalPath"),
        )).alias("jobPostings"))),
        "amazon": F.to_json(F.struct(F.size("items").alias("hits"), items(lambda x: F.struct(
            x.title.alias("title"), path(x).alias("job_path"),
            x.description.alias("description_short"),
        )).alias("jobs"))),
    }
    if source_type:
        bodies = {source_type: bodies[source_type]}
    return grouped.select(
        "company_ord", "source_type", "page_offset", _choose(F.col("source_type"), bodies).alias("body")
    )


# The description fields of all platforms, and what stands for nothing in them.
DESCRIPTION_FIELDS = "content|descriptionPlain|description|descriptionHtml|description_short"
NOTHING = ("false", "0", "[]", "{}", "0.0")


def damaged_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``payloads`` whose first response per company is cut off, lacks the title field, or has
    null titles, for three of every five companies. For a fourth its descriptions are empty values
    of other types, which do no damage."""
    key = _choose(F.col("source_type"), {k: F.lit(v) for k, v in TITLE_FIELD.items()})
    quoted = F.concat(F.lit('"'), key, F.lit('":'))
    body, kind = F.col("body"), F.col("company_ord") % 5
    return payloads(spark, sf_dir).withColumn(
        "body",
        F.when(F.col("page_offset") > 0, body)
        .when(kind == 1, F.expr("substring(body, 1, length(body) - 20)"))
        .when(kind == 2, F.replace(body, quoted, F.lit('"x":')))
        .when(kind == 3, F.regexp_replace(body, F.concat(quoted, F.lit('"[^"]*"')), F.concat(quoted, F.lit("null"))))
        .when(kind == 4, F.regexp_replace(
            body, F.lit(f'"({DESCRIPTION_FIELDS})":(?:"[^"]*"|null)'),
            F.concat(F.lit('"$1":'), F.get(F.array(*map(F.lit, NOTHING)), (F.col("company_ord") % len(NOTHING)).cast("int"))),
        ))
        .otherwise(body),
    )
