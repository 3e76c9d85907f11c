"""Company catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefeed import rules, schemas
from rolefeed.functions.urls import resolve_type, route
from rolefeed.sources.adapters import Adapter


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog from parquet, JSON lines or a YAML file ``companies: [{name, url, type?}]``.

    A missing file is an error. YAML files are short hand-edited configuration; list order
    becomes ``company_ord``.
    """
    if path.endswith((".yaml", ".yml")):
        rows = [
            (i, company["name"], company["url"], company.get("type"))
            for i, company in enumerate(rules.load_rules(spark, path)["companies"])
        ]
        return spark.createDataFrame(rows, schemas.CATALOG)
    reader = spark.read.schema(schemas.CATALOG)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def routed(catalog: DataFrame, adapters: Sequence[Adapter] = ()) -> DataFrame:
    """Add ``source_type``: the platform or adapter that applies, or generic."""
    own = [(a.fragment, a.name) for a in adapters]
    return catalog.withColumn("source_type", route(resolve_type(F.col("type"), F.col("url"), own), own))


def lookup(catalog: DataFrame, name: str) -> DataFrame:
    """The first company of that name, in any letter case. An address is its own answer."""
    if name.startswith("http"):
        return catalog.sparkSession.range(1).select(
            F.lit(name).alias("name"), F.lit(name).alias("url")
        )
    return (
        catalog.where(F.lower("name") == name.lower())
        .orderBy("company_ord").limit(1).select("name", "url")
    )


def route_counts(landed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Landed records and companies per route. Records are counted per company before the join,
    so it sees one row per company."""
    per_company = landed.groupBy("company_ord").agg(F.count("*").alias("records"))
    return (
        routed(catalog).select("company_ord", "source_type").join(per_company, "company_ord")
        .groupBy("source_type")
        .agg(F.count("*").alias("companies"), F.sum("records").alias("records"))
    )
