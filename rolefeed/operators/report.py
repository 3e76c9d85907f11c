"""Digest, metrics and preview."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefeed.session import broadcast_if_small, settle

HEADER, POSTING, BLANK = 0, 1, 2

# Sorting digest lines by these columns gives the text of the digest.
DIGEST_ORDER = ("first_company_ord", "first_posting_ord", "part", "company_ord", "posting_ord")


def digest_line(title: Column, note: Column, url: Column) -> Column:
    """One posting: title, note if there is one, and the address on the next line. A missing
    address is spelled ``None``."""
    suffix = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" ("), note, F.lit(")")))
    return F.concat(
        F.lit("- "), title, F.coalesce(suffix, F.lit("")),
        F.lit("\n  "), F.coalesce(url, F.lit("None")),
    )


def digest_lines(df: DataFrame) -> DataFrame:
    """The digest as one row per line: per company name a header, its postings, a blank line.

    Companies come in order of their first posting. The text is never gathered into one value, so
    a company may have any number of postings; it is put in order only by the sort of the sink.
    ``df`` is read twice, so give it committed or settled rows.
    """
    # The first step aggregates by hash, before the shuffle; the second sees one row per company.
    companies = (
        df.groupBy("company", "company_ord").agg(F.min("posting_ord").alias("posting_ord"))
        .groupBy("company").agg(F.min(F.struct("company_ord", "posting_ord")).alias("first"))
        .select(
            "company",
            F.col("first.company_ord").alias("first_company_ord"),
            F.col("first.posting_ord").alias("first_posting_ord"),
        )
    )
    # Settled, so that a list of usual size is known to fit a broadcast and the postings stay put.
    companies = broadcast_if_small(settle(companies))
    frame = F.explode(F.array(
        F.struct(F.lit(HEADER).alias("part"), F.concat(F.lit("== "), F.coalesce("company", F.lit("None")), F.lit(" ==")).alias("line")),
        F.struct(F.lit(BLANK).alias("part"), F.lit("").alias("line")),
    ))
    framing = companies.select("*", frame.alias("f")).select(
        "first_company_ord", "first_posting_ord", "f.part",
        F.lit(0).cast("bigint").alias("company_ord"), F.lit(0).cast("bigint").alias("posting_ord"),
        "company", "f.line",
    )
    # A posting without a company name is listed under the name None.
    named = companies.withColumnRenamed("company", "of")
    postings = df.join(named, df["company"].eqNullSafe(named["of"])).select(
        "first_company_ord", "first_posting_ord", F.lit(POSTING).alias("part"),
        F.col("company_ord").cast("bigint").alias("company_ord"), "posting_ord", "company",
        digest_line(F.col("title"), F.col("yoe_note"), F.col("url")).alias("line"),
    )
    return framing.unionByName(postings)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def write_digest(df: DataFrame, path: str) -> bool:
    """Write the digest as text files whose names follow its order. For no postings nothing is
    written, but a digest that an earlier try left is emptied."""
    if df.isEmpty():
        if _exists(df.sparkSession, path):
            df.select(F.lit("").alias("line")).limit(0).write.mode("overwrite").text(path)
        return False
    digest_lines(df).orderBy(*DIGEST_ORDER).select("line").write.mode("overwrite").text(path)
    return True


def digest_subject(df: DataFrame) -> DataFrame:
    """One row with the subject line; no row when there is nothing to report."""
    count = df.agg(F.count("*").alias("n"))
    return count.where("n > 0").select(
        F.concat(F.col("n").cast("string"), F.lit(" new matching posting(s)")).alias("subject")
    )


def company_metrics(catalog: DataFrame, gated: DataFrame) -> DataFrame:
    """Matched and dropped postings of every catalog company, zeros included.

    ``gated`` has ``company_ord`` and ``yoe_ok``. It is aggregated before the join.
    """
    counts = gated.groupBy("company_ord").agg(
        F.count_if("yoe_ok").alias("matched"), F.count_if(~F.col("yoe_ok")).alias("dropped")
    )
    return catalog.select("company_ord", F.col("name").alias("company")).join(
        counts, "company_ord", "left"
    ).fillna(0, ["matched", "dropped"])


def run_metrics(new: DataFrame, gated: DataFrame) -> DataFrame:
    """One row: postings reported as new, and postings dropped for experience."""
    reported = new.agg(F.count("*").alias("new_postings")).scalar()
    return gated.agg(F.count_if(~F.col("yoe_ok")).alias("dropped_for_experience")).select(
        reported.alias("new_postings"), "dropped_for_experience"
    )


def write_metrics(metrics: DataFrame, path: str, run_id: int) -> None:
    """Keep a run's metrics in its own partition; writing them again, also none, replaces them."""
    metrics.write.mode("overwrite").parquet(f"{path}/run_id={int(run_id)}")


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` postings in report order, each with the total count."""
    total = df.agg(F.count("*")).scalar()
    return df.withColumn("total", total).orderBy("company_ord", "posting_ord").limit(n)
