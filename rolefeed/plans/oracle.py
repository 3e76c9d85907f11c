"""DuckDB SQL for the same results, from the tables themselves and without the library."""

from __future__ import annotations

from rolefeed import rules
from rolefeed.plans import inputs, registry


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _contains_any(text: str, words) -> str:
    return f"list_bool_or(list_transform({_list([w.lower() for w in words])}, lambda w: contains({text}, w)))"


POSTINGS = inputs.POSTINGS_SQL.format(orders="orders", nation="nation")
CATALOG = inputs.CATALOG_SQL.format(supplier="supplier")

# The patterns that results must agree with, in their plain form.
_WORDS = "|".join(term.replace(" ", r"\s") for term in rules.SENIORITY_TERMS)
SENIOR = rf"regexp_matches(lower(title), '\b(?:{_WORDS})\b')"
KEYWORD = _contains_any("lower(title)", rules.KEYWORDS)

_YEARS = (
    r"(\d+)\+?\s*(?:-\s*(\d+))?\s*(?:years?|yrs?)\s*(?:of\s+)?"
    r"(?:relevant\s+|professional\s+|prior\s+)?experience"
)


def _yoe(text: str) -> str:
    numbers = f"regexp_extract_all(lower({text}), '{_YEARS}', 1)"
    return (
        f"case when {_contains_any(f'lower({text})', rules.ENTRY_LEVEL_PHRASES)} then cast(0 as bigint) "
        f"else list_min(list_transform({numbers}, lambda n: cast(n as bigint))) end"
    )


NOTE = (f"case when yoe is null then '{rules.NOT_STATED}' "
        "else concat('~', cast(yoe as varchar), '+ yrs stated') end")

# The description as plain text: one of the test descriptions has markup.
PLAIN = "case when description like '<p>%' then '4 years experience' else coalesce(description, '') end"


def _postings(extra: str = "") -> str:
    return f"with p as ({POSTINGS}){extra} "


FLAGGED = f""",
 r as (select *, {_yoe('description')} as yoe from p where {KEYWORD} and not {SENIOR}),
 flagged as (select *, {NOTE} as yoe_note, yoe is null or yoe <= 1 as yoe_ok from r)"""


def _first(source: str, order: str, keep: str = "true", columns: str = "*") -> str:
    """First row per url in the given order, and every row without a url."""
    return f"""select {columns} from (select *,
      row_number() over (partition by url order by {order}) as rn from {source} where {keep})
      where rn = 1 or url is null"""


NEW = FLAGGED + f""",
 new as ({_first('flagged', 'company_ord, posting_ord', 'yoe_ok')})"""

# --- payloads -----------------------------------------------------------------------------

# Position inside the response, plus the offset of the response.
PLACED = f""",
 q as (select *, posting_ord // {inputs.PAGE_IDS} * {inputs.PAGE_IDS} as page_offset from p),
 placed as (select * exclude (posting_ord), posting_ord as id,
   page_offset + row_number() over (partition by company_ord, page_offset order by posting_ord) - 1
     as posting_ord,
   regexp_extract(url, '^https://[^/]+(.*)$', 1) as path from q)"""


def _catalog_url(platform: str) -> str:
    return f"replace('{inputs.COMPANY_URLS[platform]}', '{{}}', cast(company_ord as varchar))"


_URL = {
    "greenhouse": "url",
    "lever": "url",
    "ashby": "url",
    "smartrecruiters": "concat('https://jobs.smartrecruiters.com/c', cast(company_ord as varchar), '/', "
                       "coalesce(regexp_extract(url, '([^/]*)$', 1) || case when url like '%7' then '.0' else '' end, 'None'))",
    "workday": "case when coalesce(path, '') = '' then " + _catalog_url("workday")
               + " else concat('https://t', cast(company_ord as varchar), '.wd5.myworkdayjobs.com', path) end",
    "amazon": "case when coalesce(path, '') = '' then " + _catalog_url("amazon")
              + " else concat('https://www.amazon.jobs', path) end",
}
_DESCRIPTION = {
    "greenhouse": PLAIN,
    # Even ids carry the description as plain text, which keeps its markup.
    "lever": "case when id % 2 = 0 then case when description like '<p>%' "
             "then '<p>4&nbsp;years experience</p>' else coalesce(description, '') end "
             f"else {PLAIN} end",
    "smartrecruiters": "cast(null as varchar)",
    "ashby": f"case when coalesce(description, '') <> '' then {PLAIN} end",
    "workday": "cast(null as varchar)",
    "amazon": "case when description like '<p>%' then '<p>4&nbsp;years experience</p>' "
              "else nullif(description, '') end",
}


def _source(platform: str) -> str:
    return _postings(PLACED) + f"""select company_ord, company, '{platform}' as source_type,
      cast(posting_ord as bigint) as posting_ord, title, {_URL[platform]} as url,
      {_DESCRIPTION[platform]} as description from placed"""


_PLATFORMS = list(inputs.COMPANY_URLS)
_KIND = "case cast(company_ord % 6 as int) " + " ".join(
    f"when {i} then '{name}'" for i, name in enumerate(_PLATFORMS)) + " end"
_ANY_URL = "case source_type " + " ".join(f"when '{k}' then {v}" for k, v in _URL.items()) + " end"
_ANY_DESCRIPTION = "case source_type " + " ".join(
    f"when '{k}' then {v}" for k, v in _DESCRIPTION.items()) + " end"
ALL_SOURCES = PLACED + f""",
 typed as (select *, {_KIND} as source_type from placed),
 united as (select company_ord, company, source_type, cast(posting_ord as bigint) as posting_ord, title,
   {_ANY_URL} as url, {_ANY_DESCRIPTION} as description, page_offset from typed)"""

_KEYED = "source_type not in ('workday', 'amazon')"
DAMAGED = ALL_SOURCES + f""",
 marked as (select *, case
    when page_offset > 0 then null
    when company_ord % 5 = 1 then 'unreadable body'
    when company_ord % 5 = 2 and {_KEYED} then 'missing field: ' || field
    when company_ord % 5 = 3 then 'unusable value: ' || field end as bad
  from (select *, case source_type when 'lever' then 'text' when 'smartrecruiters' then 'name'
    else 'title' end as field from united))"""
_SURVIVOR = f"""select company_ord, source_type, posting_ord,
  case when page_offset = 0 and company_ord % 5 = 2 then '' else title end as title, url from marked"""

# --- pages --------------------------------------------------------------------------------

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_ANCHOR = r"""<a href="([^"]*)">([^<]*)</a>"""


def _unescape(text: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
                         ("&copy;", "©"), ("&middot;", "·")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def _clean(text: str) -> str:
    return f"trim(regexp_replace(replace({text}, chr(8203), ''), '{_SPACE}', ' ', 'g'))"


LINKS = f"""with a as (select page_id, url,
   regexp_extract_all(html, '{_ANCHOR}', 1) as hrefs, regexp_extract_all(html, '{_ANCHOR}', 2) as texts
   from pages),
 b as (select page_id, url, hrefs, texts, unnest(range(1, len(hrefs) + 1)) as i from a),
 links as (select page_id, i - 1 as link_ord, {_unescape('hrefs[i]')} as href,
   regexp_extract(url, '^(https?://[^/]+)', 1) || {_unescape('hrefs[i]')} as full_url,
   {_clean(_unescape('texts[i]'))} as text from b)"""


def _link_hit(words) -> str:
    return _contains_any("lower(text || ' ' || href)", words)


def _card(fragments, boilerplate) -> str:
    return (f"{_contains_any('lower(href)', fragments)} and length(text) > 3 "
            f"and not {_contains_any('lower(text)', boilerplate)}")


_ON_PAGE = "row_number() over (partition by page_id, full_url order by link_ord)"
STATIC_HITS = f""",
 hits as (select * from (select *, {_ON_PAGE} as rn from links where {_link_hit(registry.FALLBACK_KEYWORDS)}) where rn = 1),
 cards as (select * from (select *, {_ON_PAGE} as rn from links
   where {_card(registry.PAGE_FRAGMENTS, registry.PAGE_BOILERPLATE)}) where rn = 1)"""


def _either(senior: str) -> str:
    return f""",
 either as (
   select page_id, 'static' as source_type, link_ord, coalesce(nullif(text, ''), '{rules.UNTITLED_LINK}') as title, full_url
   from hits
   union all
   select page_id, 'rendered', link_ord, text, full_url from cards
   where page_id not in (select page_id from hits)),
 kept as (select * from either where not {senior})"""


_LOS_LAS = r"regexp_matches(lower(title), '(^|[^\p{L}\p{N}_])(los|las)([^\p{L}\p{N}_]|$)')"

_WORKDAY = r"(?i)https?://([\w-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[\w-]+/)?([\w-]+)"


def _part(i: int) -> str:
    return f"nullif(regexp_extract(url, '{_WORKDAY}', {i}), '')"


DETECTED = "case " + " ".join(
    f"when contains(url, '{f}') then '{name}'" for f, name in rules.PLATFORM_BY_URL_FRAGMENT
) + " else 'generic' end"
RESOLVED = f"coalesce(nullif(type, ''), {DETECTED})"
ROUTED = f"""with c as (select *, {RESOLVED} as resolved from ({CATALOG})),
 routed as (select *, case when resolved in {tuple(_PLATFORMS)} then resolved else 'generic' end as source_type from c)"""
_SLUG = "regexp_extract(rtrim(url, '/'), '([^/]*)$', 1)"

_TEXT_OF_PAGE = "html"
for _pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
    _TEXT_OF_PAGE = f"regexp_replace({_TEXT_OF_PAGE}, '{_pattern}', ' ', 'g')"

_BEFORE, _SINCE = f"run_id < {registry.SPLIT_RUN}", f"run_id >= {registry.SPLIT_RUN}"
_ORD = "company_ord, posting_ord"
_LANDING = "case " + " ".join(
    f"when run_id < {high} then {i}" for i, high in enumerate(registry.LANDINGS[1:])) + " end"

# A heading of more than four characters is the title; the whole link text has no blank in it.
_role_title = "case when length('Role ' || text) > 4 then 'Role ' || text else 'Role ' || text || 'apply' end"

_FORM = {
    "x/y": "site || dir || 'x/y'", "./x?q=1#f": "site || dir || 'x?q=1#f'", "../x": "site || up || 'x'",
    "../../../x": "site || '/x'", "/a/./b/../c/": "site || '/a/c/'", "?n=1": "site || path || '?n=1'",
    "#top": "site || path || q || '#top'", "//cdn.example.com/x": "scheme || '://cdn.example.com/x'",
    "mailto:a@b.example": "href", "": "url",
    "HTTP://Up.example/X/../Y": "case scheme when 'http' then 'http://Up.example/X/../Y' else href end",
    "x//y": "site || dir || 'x/y'", "g;p=1/../h": "site || dir || 'h'", " x y ": "site || dir || 'x y '",
    "..": "site || up", ".": "site || dir", "g;p=1": "site || dir || 'g;p=1'", "http://[bad": "null",
    "http://[::1]:80/x": "href", "x?a=/../b": "site || dir || 'x?a=/../b'",
}
RESOLVED_FORMS = f"""with u as (select page_id, url, regexp_extract(url, '^(https?)', 1) as scheme,
   regexp_extract(url, '^(https?://[^/?#]+)', 1) as site, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path,
   regexp_extract(url, '([?][^#]*)', 1) as q from pages),
 d as (select *, regexp_extract(path, '^(.*/)', 1) as dir from u),
 f as (select *, regexp_replace(dir, '[^/]+/$', '') as up, unnest({_list(inputs.ADDRESS_FORMS)}) as href,
   unnest(range({len(inputs.ADDRESS_FORMS)})) as form from d)
 select page_id, cast(form as integer) as form, case href
   {" ".join(f"when {_list([form])[1:-1]} then {value}" for form, value in _FORM.items())} end as resolved from f"""

_DAY = "case cast(posting_ord % 5 as int) " + " ".join(f"when {i} then {day}" for i, day in enumerate(registry.LANDED_DAYS)) + " end"

ORACLE = {
    "flagship": _postings(NEW) + "select company_ord, posting_ord, company, title, url, yoe_note from new",
    "catalog_scan": f"select company_ord, name, url, type from ({CATALOG})",
    **{f"src_{name}": _source(name) for name in _PLATFORMS},
    "union_sources": _postings(ALL_SOURCES)
    + "select company_ord, source_type, posting_ord, title, url from united",
    "quarantine": _postings(DAMAGED) + _SURVIVOR
    + " where company_ord not in (select company_ord from marked where bad is not null)",
    "quarantine_rows": _postings(DAMAGED) + _SURVIVOR + " where bad is null",
    "quarantine_report": _postings(DAMAGED) + """select company_ord, source_type, bad,
      case when bad = 'unreadable body' then 1 else count(*) end as n
      from marked where bad is not null group by company_ord, source_type, bad""",
    "html_links": LINKS + " select page_id, link_ord, href, full_url, text from links",
    # Every link of the test pages is the whole content of its list item.
    "rendered_cards": LINKS + f""" select page_id, link_ord, href, full_url, text,
      cast(null as varchar) as heading_text, '' as aria_label, text as context_text, text as title,
      '{rules.DEFAULT_LOCATION}' as location from links""",
    "fetch_plan": ROUTED + f""",
 e as (select company_ord, source_type, total, case source_type
   when 'greenhouse' then 'https://boards-api.greenhouse.io/v1/boards/' || {_SLUG} || '/jobs?content=true'
   when 'lever' then 'https://api.lever.co/v0/postings/' || {_SLUG} || '?mode=json'
   when 'smartrecruiters' then 'https://api.smartrecruiters.com/v1/companies/' || {_SLUG} || '/postings'
   when 'ashby' then 'https://api.ashbyhq.com/posting-api/job-board/' || {_SLUG}
   when 'workday' then 'https://' || {_part(1)} || '.' || {_part(2)} || '.myworkdayjobs.com/wday/cxs/'
     || {_part(1)} || '/' || {_part(3)} || '/jobs'
   when 'amazon' then 'https://www.amazon.jobs/en/search.json' else url end as endpoint,
   case source_type when 'workday' then 20 when 'amazon' then 100 else 1 end as lim,
   case when source_type in ('workday', 'amazon') then greatest(coalesce(total, 0), 1) else 1 end as up from routed),
 o as (select *, unnest(range(0, up, lim)) as page_offset from e where endpoint is not null)
 select company_ord, source_type, endpoint, case when source_type = 'workday' then 'POST' else 'GET' end as method,
   page_offset, case source_type
     when 'workday' then concat('{{"limit":20,"offset":', cast(page_offset as varchar), ',"searchText":""}}')
     when 'amazon' then concat('base_query=&offset=', cast(page_offset as varchar), '&result_limit=100&sort=recent')
     end as request
 from o where page_offset = 0 or page_offset < total""",
    "reported_totals": _postings(PLACED) + """select company_ord, max_by(n, page_offset) as total
      from (select company_ord, page_offset, count(*) as n from placed group by company_ord, page_offset)
      where company_ord % 6 in (4, 5) group by company_ord""",
    "seen_append": _postings(f""",
 runs as (select * replace (cast({_SINCE} as int) as run_id) from p)""")
    + f"""select cast(run_id as bigint) as run_id, company_ord, posting_ord, company, title, url,
      timestamp '2025-01-01' as first_seen from ({_first('runs', 'run_id, ' + _ORD)})""",
    "seen_commit": _postings(f""",
 runs as (select * replace (cast({_SINCE} as int) as run_id) from p),
 evens as ({_first('runs', 'run_id, ' + _ORD, 'run_id = 0 or posting_ord % 2 = 0')}),
 whole as ({_first('runs', 'run_id, ' + _ORD)}),
 states as (select *, unnest(['before', 'kept']) as state from evens union all select *, 'after' from whole)""")
    + "select cast(run_id as bigint) as run_id, company_ord, posting_ord, company, title, url, state from states",
    "seen_compacted": _postings(f""",
 years as (select * replace (cast((run_id // 100 - {registry.FIRST_YEAR}) // 2 as bigint) as run_id), run_id as month from p)""")
    + _first("years", "month, " + _ORD, columns="run_id, company_ord, posting_ord, title, url"),
    "card_contexts": LINKS + f""", n as (select page_id, unnest([0, 1]) as second, link_ord, href, text,
   regexp_extract(full_url, '^(https?://[^/]+)', 1) as site from links),
 c as (select page_id, 2 * link_ord + second as link_ord,
   site || case second when 0 then '/jobs' || href else '/jobs/x' || substr(href, 2) end as full_url,
   case second when 0 then {_role_title} else text || ' more' end as title,
   case second when 0 then 'Open Role ' || text || ' apply'
     else 'Open Role ' || text || ' apply till May ' || text || ' more' end as context_text
 from n)
 select page_id, link_ord, full_url, title, context_text from (select *, {_ON_PAGE} as rn from c) where rn = 1""",
    "fetch_outstanding": ROUTED + f""",
 e as (select company_ord, source_type, coalesce(total, 0) as total, source_type in ('workday', 'amazon') as paged,
   case source_type when 'workday' then 20 when 'amazon' then 100 else 1 end as lim, ceil(coalesce(total, 0) / 2) as half
   from routed where source_type <> 'workday' or {_part(1)} is not null),
 o as (select *, cast(unnest(range(0, case when paged then greatest(total, 1) else 1 end, lim)) as bigint) as page_offset from e),
 r as (select *, case when page_offset = 0 then 0 when page_offset < half then 1
   when half > lim and not (company_ord % 7 = 3 and half > 2 * lim) then 2 end as round from o)
 select company_ord, source_type, page_offset, cast(round as bigint) as round from r where round is not null""",
    "adapter_run": _postings(f""",
 seventh as (select company_ord, posting_ord // {inputs.PAGE_IDS} * {inputs.PAGE_IDS}
     + row_number() over (partition by company_ord, posting_ord // {inputs.PAGE_IDS} order by posting_ord) - 1 as posting_ord,
   company, title, case when posting_ord % 4 > 0 then concat('https://roleboard.example/o/', cast(posting_ord as varchar))
     else concat('https://roleboard.example/c', cast(company_ord as varchar)) end as url, {PLAIN} as description
   from p where company_ord % 2 = 0),
 called as (select cast(n_nationkey as bigint) as company_ord, unnest([0, 1]) as posting_ord, n_name as company,
   concat('Software Engineer, ', n_name) as title, n_nationkey as k from nation where n_nationkey % 2 = 1 and n_name <> 'CHINA'),
 both_kinds as (select * from seventh union all
   select company_ord, posting_ord, company, title, concat('https://called.example/c', cast(k as varchar), '/', cast(posting_ord + 1 as varchar)),
     concat(cast(posting_ord + 1 as varchar), ' years of experience') from called),
 judged as (select *, {_yoe('description')} as yoe from both_kinds where {KEYWORD} and not {SENIOR}),
 passed as (select *, {NOTE} as yoe_note from judged where yoe is null or yoe <= 1)""")
    + _first("passed", _ORD, columns="company_ord, posting_ord, company, title, url, yoe_note"),
    "resolve_url": RESOLVED_FORMS,
    "clean_text": f"select doc_id, {_clean('text')} as cleaned from documents",
    "html_to_text": f"select page_id, {_clean(_unescape(_TEXT_OF_PAGE))} as plain from pages",
    "description_text": _postings() + f"select posting_ord, {PLAIN} as plain from p",
    "url_slug": f"select company_ord, {_SLUG} as slug from ({CATALOG})",
    "workday_url_parts": f"""select company_ord, {_part(1)} as tenant, {_part(2)} as host, {_part(3)} as site
      from ({CATALOG})""",
    "detect_platform": f"select company_ord, {DETECTED} as platform from ({CATALOG})",
    "resolve_type": f"select company_ord, {RESOLVED} as resolved from ({CATALOG})",
    "yoe_extract": _postings() + f"select posting_ord, {_yoe('description')} as yoe from p",
    "yoe_documents": f"""select doc_id, {_yoe('claim')} as yoe from (select doc_id,
      concat_ws(' ', text, cast(doc_id % 40 as varchar), 'years of experience') as claim from documents)""",
    "yoe_note": _postings(f", y as (select posting_ord, {_yoe('description')} as yoe from p)")
    + f"select posting_ord, {NOTE} as note from y",
    "rendered_title": _postings("""
 , c as (select posting_ord, title,
    case when posting_ord % 3 = 0 then company end as heading,
    coalesce(case posting_ord % 4 when 0 then url when 1 then company else '' end, '') as aria
    from p),
 v as (select *, case when length(heading) > 4 then heading else title end as visible from c)""")
    + "select posting_ord, case when length(aria) > length(visible) then aria else visible end as title from v",
    "kw_title": _postings() + f"select posting_ord, title from p where {KEYWORD}",
    "kw_documents": f"select doc_id from documents where {_contains_any('lower(text)', rules.KEYWORDS)}",
    "not_senior": _postings() + f"select posting_ord, title from p where not {SENIOR}",
    "role_filter": _postings() + f"select posting_ord, title from p where {KEYWORD} and not {SENIOR}",
    "yoe_gate": _postings(f", y as (select posting_ord, {_yoe('description')} as yoe from p)")
    + f"select posting_ord, {NOTE} as yoe_note from y where yoe is null or yoe <= 1",
    "strict_roles": _postings(f""",
 y as (select *, case when {_contains_any('lower(description)', [w for w in rules.ENTRY_LEVEL_PHRASES if not w[0].isdigit()])}
     or regexp_matches(lower(description), '(^|[^0-9])0 years of experience') then 0
   else list_min(list_transform(regexp_extract_all(lower(description), '{_YEARS}', 1), lambda n: cast(n as bigint))) end as yoe from p
   where regexp_matches(lower(title), '\\b(?:{"|".join(rules.KEYWORDS)})\\b') and not {SENIOR})""")
    + f"select posting_ord, title, {NOTE} as yoe_note from y where yoe is null or yoe <= 1",
    "html_keyword_links": LINKS + f""" select page_id, link_ord, full_url,
      coalesce(nullif(text, ''), '{rules.UNTITLED_LINK}') as title
      from links where {_link_hit(registry.PAGE_KEYWORDS)}""",
    "job_link_filter": LINKS + f""" select page_id, link_ord, full_url, text as title
      from links where {_card(registry.PAGE_FRAGMENTS, registry.PAGE_BOILERPLATE)}""",
    "catalog_lookup": f"""select name, url from ({CATALOG}) where lower(name) = 'supplier#000000007'
      order by company_ord limit 1""",
    "route_counts": ROUTED + """select source_type, count(distinct company_ord) as companies,
      count(*) as records from lineitem join routed on l_suppkey = company_ord group by source_type""",
    "fallback": LINKS + STATIC_HITS + _either(_LOS_LAS)
    + " select page_id as company_ord, source_type, link_ord as posting_ord, title, full_url as url from kept",
    "static_only": LINKS + STATIC_HITS + _either(_LOS_LAS)
    + " select page_id as company_ord, source_type, link_ord as posting_ord, title, full_url as url from kept"
    + " where source_type = 'static'",
    "rendered_roles": LINKS + STATIC_HITS + f""" select page_id, link_ord, text as title, full_url,
      '{rules.DEFAULT_LOCATION}' as location from (select *, text as title from cards) where not {_LOS_LAS}""",
    "new_postings": _postings(f""",
 fresh as ({_first('p', _ORD, _SINCE)})""")
    + f"""select posting_ord, company, title, url from fresh
      where url is null or url not in (select url from p where {_BEFORE} and url is not null)""",
    "kw_semi_join": _postings(f", k as (select unnest({_list(rules.KEYWORDS)}) as term)")
    + "select posting_ord, title from p where exists (select 1 from k where contains(lower(title), term))",
    "senior_anti_join": _postings(f", s as (select unnest({_list(rules.SENIORITY_TERMS)}) as term)")
    + r"""select posting_ord, title from p where not exists
      (select 1 from s where regexp_matches(lower(title), '\b' || term || '\b'))""",
    "dedup_page": LINKS + f""" select page_id, link_ord, full_url, coalesce(nullif(text, ''), '{rules.UNTITLED_LINK}') as title
      from (select *, {_ON_PAGE} as rn from links where {_link_hit(registry.PAGE_KEYWORDS)}) where rn = 1""",
    "dedup_run": _postings() + _first("p", _ORD, columns="company_ord, posting_ord, title, url"),
    "new_per_run": _postings()
    + _first("p", "run_id, " + _ORD, columns="run_id, company_ord, posting_ord, title, url"),
    "first_seen": _postings()
    + _first("p", "run_id, " + _ORD, columns="url, company, title, captured_at as first_seen, run_id"),
    "digest": _postings(NEW + """,
 firsts as (select company, first(company_ord order by company_ord, posting_ord) as first_company_ord,
   first(posting_ord order by company_ord, posting_ord) as first_posting_ord from new group by company)""")
    + """select first_company_ord, first_posting_ord, 0 as part, cast(0 as bigint) as company_ord,
      cast(0 as bigint) as posting_ord, company, concat('== ', company, ' ==') as line from firsts
     union all select first_company_ord, first_posting_ord, 2, 0, 0, company, '' from firsts
     union all select first_company_ord, first_posting_ord, 1, company_ord, posting_ord, new.company,
      concat('- ', title, ' (', yoe_note, ')', chr(10), '  ', coalesce(url, 'None'))
      from new join firsts on new.company = firsts.company""",
    "digest_subject": _postings(NEW)
    + "select concat(cast(count(*) as varchar), ' new matching posting(s)') as subject from new having count(*) > 0",
    "company_metrics": _postings(FLAGGED)
    + """select cast(n_nationkey as bigint) as company_ord, n_name as company,
      count(*) filter (where yoe_ok) as matched, count(*) filter (where not yoe_ok) as dropped
      from nation left join flagged on n_nationkey = company_ord group by all""",
    "metrics_sink": _postings(FLAGGED)
    + """select cast(n_nationkey as bigint) as company_ord, n_name as company,
      count(*) filter (where yoe_ok) as matched, count(*) filter (where not yoe_ok) as dropped,
      cast(n_nationkey % 2 as bigint) as run_id
      from nation left join flagged on n_nationkey = company_ord group by all""",
    "run_metrics": _postings(NEW)
    + """select (select count(*) from new) as new_postings,
      (select count(*) from flagged where not yoe_ok) as dropped_for_experience""",
    "preview": _postings(NEW)
    + """select company_ord, posting_ord, title, url, (select count(*) from new) as total
      from new order by company_ord, posting_ord limit 10""",
    "stream_new": _postings()
    + _first("p", "run_id, " + _ORD, columns="company_ord, posting_ord, title, url"),
    "stream_digest": _postings(FLAGGED + f""",
 first_rows as ({_first('flagged', 'run_id, ' + _ORD, 'yoe_ok')}),
 landed as (select *, {_LANDING} as landing from first_rows),
 lines as (
   select landing, concat('- ', title, ' (', yoe_note, ')') as value from landed
   union all select landing, concat('  ', coalesce(url, 'None')) from landed
   union all select distinct landing, concat('== ', company, ' ==') from landed
   union all select landing, '' from (select distinct landing, company from landed))""")
    + "select cast(landing as bigint) as run_id, value from lines",
    "rule_files": _postings(f""",
 r as (select *, {_yoe('description')} as yoe from p where {_contains_any('lower(title)', registry.FILE_RULES['keywords']['keywords'])}
   and not regexp_matches(lower(title), '\\b(?:lead|senior)\\b'))""")
    + f"select posting_ord, title, {NOTE} as yoe_note from r where yoe is null or yoe <= 3",
    "full_run": LINKS + STATIC_HITS + _either(SENIOR)
    + f", p as ({POSTINGS})" + ALL_SOURCES + f""",
 matching as (
   select company_ord, posting_ord, company, title, url, description from united
     where {_contains_any('lower(title)', (*rules.KEYWORDS, *registry.FALLBACK_KEYWORDS))} and not {SENIOR}
   union all
   select page_id + {registry.PAGE_COMPANY_BASE}, link_ord, concat('Company ', cast(page_id as varchar)),
     title, full_url, null from kept),
 judged as (select *, {_yoe('description')} as yoe from matching),
 passed as (select *, {NOTE} as yoe_note from judged where yoe is null or yoe <= 1)
 """ + _first("passed", _ORD, columns="company_ord, posting_ord, company, title, url, yoe_note"),
}



def _bounded() -> str:
    """A url is known until the watermark, the last landing's day less the delay, passes the day of
    its report plus the delay."""
    days, delay, steps = registry.LANDED_DAYS, int(registry.FORGET.split()[0]), []
    for k, day in enumerate(days):
        known = [j for j in range(k) if days[j] + delay > days[k - 1] - delay]
        fresh = " and ".join(["true", *(f"url not in (select url from e{j})" for j in known)])
        steps.append(f"e{k} as (select * from l where day = {day} and {fresh})")
    found = " union all ".join(f"select *, 1 as n from e{k}" for k in range(len(days)))
    return _postings(f""",
 l as (select distinct {_DAY} as day, url from p where url is not null),
 {", ".join(steps)}""") + f"""select cast(day as bigint) as day, url, cast(n as bigint) as n from ({found}
   union all select {_DAY}, null, count(*) from p where url is null group by 1)"""


ORACLE["stream_bounded"] = _bounded()

ORACLE["stream_pages"] = ORACLE["fallback"]
ORACLE["stream_landings"] = ORACLE["full_run"]
ORACLE["stream_metrics"] = _postings(FLAGGED + f""",
 first_rows as ({_first('flagged', 'run_id, ' + _ORD, 'yoe_ok')}),
 new as (select {_LANDING} as landing, count(*) as n from first_rows group by all),
 gone as (select {_LANDING} as landing, count(*) filter (where not yoe_ok) as n from flagged group by all)""") + """
 select cast(gone.landing as bigint) as run_id, coalesce(new.n, 0) as new_postings, gone.n as dropped_for_experience
 from gone left join new on gone.landing = new.landing"""

# The run keeps the same records that the normalisers set aside.
ORACLE["run_quarantine"] = ORACLE["quarantine_report"]
