"""Schemas of the tables that cross operator boundaries."""

from pyspark.sql import types as T

# One row per posting, whatever its source. DataFrames have no row order, so catalog order and
# payload/page order travel as columns; (run_id, company_ord, posting_ord) identifies a posting.
POSTING = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("captured_at", T.TimestampNTZType()),
    T.StructField("company_ord", T.LongType()),
    T.StructField("posting_ord", T.LongType()),
    T.StructField("company", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("context_text", T.StringType()),
])

CATALOG = T.StructType([
    T.StructField("company_ord", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("type", T.StringType()),
])

# One row per landed API response.
PAYLOAD = T.StructType([
    T.StructField("company_ord", T.LongType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("page_offset", T.LongType()),
    T.StructField("body", T.StringType()),
])

# One row per landed career page (static response or rendered document).
PAGE = T.StructType([
    T.StructField("company_ord", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# One row per response or page of any kind (payload, static, rendered), as it lands.
LANDING = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("company_ord", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("page_offset", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("body", T.StringType()),
])

# Everything ever reported. The ordinals and the note are kept so that
# the digest of any run can be rebuilt from its committed rows.
SEEN = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("first_seen", T.TimestampNTZType()),
    T.StructField("company_ord", T.LongType()),
    T.StructField("posting_ord", T.LongType()),
    T.StructField("yoe_note", T.StringType()),
    T.StructField("run_id", T.LongType()),
])
