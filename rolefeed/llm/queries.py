"""The operators' queries over the driver's tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefeed.llm import (
    archives, decontaminate, hard_negatives, jaccard_join, line_dedup, neighbours, packing,
    personal_data, quality, secret_scan, token_counts, url_lists, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark, sf_dir):
    """Documents without lines that are common on their source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    """Near-duplicate groups of documents."""
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark, sf_dir):
    """Passages of test items in documents."""
    return decontaminate.contamination_report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


@query
def op8_best_fit_packing(spark, sf_dir):
    """Documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@query
def op10_quality_classifier(spark, sf_dir):
    """Quality of every document by its nearest labelled neighbours."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


ORACLE["op1_line_dedup"] = f"""
with l as (select doc_id, source, text, unnest(string_split(text, chr(10))) as line,
    unnest(range(len(string_split(text, chr(10))))) as pos from documents),
 k as (select *, trim(line, ' ' || chr(9) || chr(13)) as bare from l),
 c as (select source, bare, count(distinct doc_id) as n from k where bare <> '' group by all),
 t as (select source, count(*) as pages from documents group by all),
 b as (select c.source, c.bare from c join t on c.source is not distinct from t.source
   where n >= {line_dedup.MIN_PAGES} and n > pages * {line_dedup.MAX_RATIO}),
 m as (select k.*, b.bare is not null as gone from k left join b
   on k.source is not distinct from b.source and k.bare = b.bare),
 r as (select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text,
   count(*) as n_lines, count(*) filter (gone) as n_dropped from m group by doc_id)
select d.doc_id, case when d.text is null then null else r.text end as text,
  coalesce(r.n_lines, 0) as n_lines, coalesce(r.n_dropped, 0) as n_dropped
from documents d left join r on d.doc_id = r.doc_id"""

_SPACED = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE["op3_ngram_jaccard_join"] = f"""
with recursive w as (select doc_id, {_SPACED} as words from documents),
 s as (select distinct doc_id, unnest(case when len(words) = 0 then []
     when len(words) < 5 then [array_to_string(words, ' ')]
     else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as shingle
   from w where words is not null),
 n as (select doc_id, count(*) as n_shingles from s group by doc_id),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b
   on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
 e as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id
   where 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)),
 r as (select doc_id, doc_id as other from documents
   union select r.doc_id, e.b from r join e on r.other = e.a),
 c as (select doc_id, min(other) as component_id from r group by doc_id),
 same as (select doc_id, list_sort(list(shingle)) as shingles from s group by doc_id),
 k as (select shingles, count(*) as n_copies from same group by shingles)
select c.doc_id, coalesce(n.n_shingles, 0) as n_shingles, c.component_id,
  coalesce(k.n_copies, 1) as n_copies
from c left join n on c.doc_id = n.doc_id left join same on c.doc_id = same.doc_id
  left join k on same.shingles = k.shingles"""

_WORDS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE["op4_decontamination"] = f"""
with i as (select cast(item_id as varchar) as id, {_WORDS} as words from benchmark where item_id is not null),
 iw as (select distinct id, least({decontaminate.WINDOW}, len(words)) as k,
   unnest(list_transform(range(1, len(words) - least({decontaminate.WINDOW}, len(words)) + 2),
     lambda p: array_to_string(words[p:p + least({decontaminate.WINDOW}, len(words)) - 1], ' '))) as win
   from i where len(words) > 0),
 d as (select doc_id, coalesce({_WORDS}, []) as words from documents),
 ks as (select distinct k from iw),
 dw as (select doc_id, k, unnest(range(1, len(words) - k + 2)) as p,
   unnest(list_transform(range(1, len(words) - k + 2), lambda p: array_to_string(words[p:p + k - 1], ' '))) as win
   from d, ks where len(words) >= k),
 h as (select dw.doc_id, dw.p, dw.k, iw.id from dw join iw on dw.k = iw.k and dw.win = iw.win),
 hits as (select doc_id, count(distinct q) as n_hit from (
   select doc_id, unnest(range(p, p + k)) as q from h) group by doc_id),
 items as (select doc_id, count(distinct id) as n_items,
   sha256(string_agg(distinct id, ',' order by id)) as items_sha256 from h group by doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
  coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  n_hit is not null as contaminated
from d left join hits on d.doc_id = hits.doc_id left join items on d.doc_id = items.doc_id"""


# --- operators with inputs derived from the tables -------------------------------------------


def _edited(docs: DataFrame) -> DataFrame:
    """Three edits for every document: near its start, middle and end, one that only inserts, one
    that replaces and one that only deletes."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    third = F.floor(size / 3).cast("bigint")
    edit = F.struct(third.alias("start"), third.alias("stop"), F.lit(" (noted later)").alias("insert"))
    swap = F.struct((2 * third).alias("start"), (2 * third + 7 + F.coalesce(F.col("doc_id"), F.lit(0)) % 5).alias("stop"), F.col("source").alias("insert"))
    cut = F.struct((size - F.least(size, F.lit(12))).alias("start"), size.alias("stop"), F.lit("").alias("insert"))
    return docs.withColumn("edits", F.array(edit, swap, cut))


@query
def op2_token_counts(spark, sf_dir):
    """Token counts of all documents before and after three edits each."""
    docs = _edited(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    trees = token_counts.build_trees(docs).withColumnsRenamed(
        {"n_tokens": "n_tokens_before", "n_pretokens": "n_pretokens_before"}
    )
    return token_counts.apply_edits(trees).select(
        "doc_id", "n_pretokens_before", "n_tokens_before", F.size("edits").cast("bigint").alias("n_edits"),
        "n_pretokens", "n_tokens", "n_recounted",
    )


@query
def op5_ann(spark, sf_dir):
    """The 20 nearest vectors of every twentieth vector."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op6_warc(spark, sf_dir):
    """Pages through ARC files and WARC files."""
    return archives.round_trip(_table(spark, sf_dir, "pages"))


# Fetch times and list entries, made of the pages' own ids and hosts. ``{h}`` is a number made of
# a key's digest. The same text runs in both engines.
_START, _YEAR = 1704067200, 31536000


def _captures(spark, sf_dir):
    fetched = F.timestamp_seconds(F.lit(_START) + (F.col("page_id") * 7919) % _YEAR)
    return _table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))


def _list_entries(captures: DataFrame) -> DataFrame:
    """Up to four dated entries for every domain, host and first path segment that occurs."""
    keys = captures.select(F.explode(url_lists.url_keys(F.col("url"))["key"]).alias("key")).distinct()
    h = F.conv(F.substring(F.md5("key"), 1, 7), 16, 10).cast("bigint")
    actions = F.array(*map(F.lit, ("block", "remove", "allow", "remove")))
    return keys.select("key", h.alias("h"), F.explode(F.sequence(F.lit(0), (h % 4).cast("int"))).alias("i")).select(
        "key", F.timestamp_seconds(F.lit(_START) + (F.col("h") * (2 * F.col("i") + 3)) % _YEAR).alias("at"),
        F.element_at(actions, ((F.col("h") + F.col("i")) % 4 + 1).cast("int")).alias("action"),
    )


@query
def op7_url_filters(spark, sf_dir):
    """Every page under the list entries that held when it was fetched."""
    captures = _captures(spark, sf_dir)
    return url_lists.apply_lists(captures, _list_entries(captures)).select(
        "page_id", "url", "n_active", "verdict", "rule"
    )


@query
def op9_secret_scans(spark, sf_dir):
    """Secrets in all documents."""
    return secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )


@query
def op11_hard_negatives(spark, sf_dir):
    """For every hundredth vector and its positives, the nearest rows of other labels below them."""
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", changed.alias("label"))
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


@query
def op12_pii(spark, sf_dir):
    """Personal data in all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.report(docs, personal_data.train(docs))


@query
def op13_embedding_whitening(spark, sf_dir):
    """All vectors, whitened."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.per_component(whitening.whiten(vectors))


ORACLE["op11_hard_negatives"] = """
with f as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
   list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
   from embeddings where vec_id is not null and label is not null and embedding is not null
   and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
 s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
   cast(list_dot_product(a.v, b.v) as bigint) as score
   from f a join f b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, id as positive_id, score as positive_score from s where same
   qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, s.id as negative_id,
  p.positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same
  and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)
qualify rank <= 5"""

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"

ORACLE["op7_url_filters"] = f"""
with c as (select page_id, url, {_START} + (page_id * 7919) % {_YEAR} as t, rtrim({_HOST}, '.') as host,
    list_filter(list_slice(string_split(regexp_extract(url, '^[^:]+://[^/?#]*/([^?#]*)', 1), '/'), 1, 2),
      lambda s: s <> '') as segments from pages),
 l as (select *, string_split(host, '.') as labels from c where host <> ''),
 k as (select page_id, t, unnest(list_concat(
     list_filter(list_transform(range(1, len(labels) + 1),
       lambda i: struct_pack(key := array_to_string(labels[len(labels) - i + 1:], '.'), rank := i)),
       lambda d: d.rank >= 2 or len(labels) = 1),
     list_transform(range(1, len(segments) + 1),
       lambda i: struct_pack(key := host || '/' || array_to_string(segments[1:i], '/'), rank := i + 1000))
   )) as k from l),
 keys as (select distinct k.key as key from k),
 h as (select key, cast('0x' || substr(md5(key), 1, 7) as bigint) as h from keys),
 e as (select key, h, unnest(range(0, h % 4 + 1)) as i from h),
 entries as (select key, {_START} + (h * (2 * i + 3)) % {_YEAR} as at_s,
   ['block', 'remove', 'allow', 'remove'][(h + i) % 4 + 1] as action from e),
 states as (select key, at_s, max(list_position(['remove', 'allow', 'block'], action)) as place
   from entries group by key, at_s),
 held as (select key, place, at_s as since, lead(at_s) over (partition by key order by at_s) as until from states),
 m as (select k.page_id, k.k.rank as rank, k.k.key as key, held.place from k join held
   on k.k.key = held.key and k.t >= held.since and (held.until is null or k.t < held.until) where held.place > 1),
 b as (select page_id, count(*) as n, max_by(key, rank) as rule, max_by(place, rank) as place from m group by page_id)
select p.page_id, p.url, coalesce(b.n, 0) as n_active,
  case b.place when 3 then 'block' when 2 then 'allow' else 'none' end as verdict, b.rule
from pages p left join b on p.page_id = b.page_id"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE["op6_warc"] = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
 d as (select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes, sha1(body) as hex from p),
 g as (select *, cast(array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
     lambda s: substr('{_BASE32}', cast((cast('0x' || substr(hex, 5 * i + 1, 5) as bigint) >> s) & 31 as bigint) + 1, 1)), '')), '')
     as varchar) as payload_digest, max(page_id) over (partition by hex, payload_bytes) as first from d)
select page_id, payload_bytes, payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from g"""
