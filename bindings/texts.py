"""Scalar functions and extraction on the given documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.relational import words
from meadowlark import constants as K
from meadowlark.functions import dates, urls
from meadowlark.functions import extract as X
from meadowlark.functions import text as T
from meadowlark.operators import html as HT
from meadowlark.operators import joins as C
from meadowlark.sources import web


def esc(p: str) -> str:
    """A pattern as an SQL string body."""
    return p.replace("'", "''")


def first_sql(c: str, patterns, group=0) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{esc(p)}', {group}), '')" for p in patterns) + ")"


def any_word(c: str, ws) -> str:
    return f"list_bool_or([contains(lower({c}), w) FOR w IN [{words(ws)}]])"


def count_words(c: str, ws) -> str:
    return f"CAST(len(list_filter([{words(ws)}], lambda w: contains(lower({c}), w))) AS BIGINT)"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


UNESCAPE = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&middot;", "·"), ("&eacute;", "é"), ("&#8217;", "’"), ("&ndash;", "–"), ("&#x2014;", "—"), ("&amp;", "&")]


def unescaped(c: str) -> str:
    for a, b in UNESCAPE:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def simple_text(c: str) -> str:
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"
    c = f"regexp_replace({c}, '(?is)<(?:script|style|nav)\\b[^>]*>.*?</(?:script|style|nav)\\s*>', ' ', 'g')"
    return squeezed(unescaped(f"regexp_replace({c}, '(?s)<[^>]+>', ' ', 'g')"))


# --- scalar functions --------------------------------------------------------------------

@query("case_trim", "org", sql="""
    SELECT id, lower(trim(name)) AS name_key, rtrim(lower(trim(website)), '/') AS url_key, rtrim(description || '!?', ',.!?;') AS bare FROM org""")
def _(t):
    return t.org.select("id", T.norm_key("name").alias("name_key"), T.norm_url_key("website").alias("url_key"),
                        T.strip_punctuation(F.concat("description", F.lit("!?"))).alias("bare"))


@query("slice_len", "doc", sql="SELECT id, substr(text, 1, 120) AS head, CAST(length(text) AS BIGINT) AS n, length(text) >= 500 AS is_long FROM doc")
def _(t):
    return t.doc.select("id", T.prefix("text", 120).alias("head"), F.length("text").cast("long").alias("n"),
                        (F.length("text") >= 500).alias("is_long"))


@query("concat_skip_empty", "org", sql="SELECT id, concat_ws(', ', nullif(address, ''), nullif(city, ''), nullif(country, '')) AS place FROM org")
def _(t):
    return t.org.select("id", T.join_nonempty(", ", "address", "city", "country").alias("place"))


@query("coalesce_blank", "org", sql="SELECT id, coalesce(nullif(website, ''), nullif(direct_website, ''), '') AS url FROM org")
def _(t):
    return t.org.select("id", T.first_nonempty("website", "direct_website").alias("url"))


@query("like_contains", "org", sql="""
    SELECT id, name ILIKE '%ER#%7' OR false AS a, contains(country, '_1') AS b, starts_with(city, 'City 1') AS c, ends_with(website, '5.example.com/') AS d FROM org""")
def _(t):
    return t.org.select("id", F.col("name").ilike("%ER#%7").alias("a"), F.col("country").contains("_1").alias("b"),
                        F.col("city").startswith("City 1").alias("c"), F.col("website").endswith("5.example.com/").alias("d"))


@query("regex", "doc", sql=f"""
    SELECT id, {first_sql('text', ['(?i)\\b(th[a-z]+)\\s+(an[a-z]*)', '(?i)\\b(de)\\s+([a-z]+)'], 2)} AS second,
        CAST(len(regexp_extract_all(text, '(?i)\\bth\\w*')) AS BIGINT) AS n FROM doc""")
def _(t):
    pats = [r"(?i)\b(th[a-z]+)\s+(an[a-z]*)", r"(?i)\b(de)\s+([a-z]+)"]
    return t.doc.select("id", T.first_match("text", pats, 2).alias("second"),
                        F.size(T.extract_all("text", r"(?i)\bth\w*")).cast("long").alias("n"))


@query("word_split", "passage", sql="""
    SELECT id, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 2), ' ') AS words FROM passage""")
def _(t):
    return t.passage.select("id", F.array_join(T.query_words("text"), " ").alias("words"))


@query("slugify", "doc", sql=f"""
    SELECT id, regexp_replace(regexp_replace({trimmed("regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9\\s-]', '', 'g')")}, '\\s+', '-', 'g'), '-+', '-', 'g') AS slug FROM doc""")
def _(t):
    return t.doc.select("id", T.slugify(F.element_at(F.split("text", "\n"), 1)).alias("slug"))


_LINKS = """links AS (SELECT page_id, url, pos, a.h AS href FROM (SELECT page_id, url, unnest(list_filter(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1), lambda x: true)) AS h,
        unnest(range(len(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)))) AS pos FROM rich) a)"""
_RESOLVED = """CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '//%' THEN 'https:' || href
        WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
        ELSE CASE WHEN url LIKE '%/' THEN url ELSE regexp_replace(url, '/[^/]*$', '') || '/' END || href END"""


@query("url_parts", "rich", sql=f"""
    WITH {_LINKS} SELECT page_id, pos, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
        regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, {_RESOLVED} AS full_url FROM links""")
def _(t):
    ex = t.rich.select("page_id", "url", F.posexplode(X.hrefs("html")).alias("pos", "href"))
    return ex.select("page_id", F.col("pos").cast("long").alias("pos"), urls.host("url").alias("host"), urls.origin("url").alias("origin"),
                     urls.path("url").alias("path"), urls.resolve("url", "href").alias("full_url"))


@query("repair_url", "page", sql="""
    WITH d AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || url WHEN 1 THEN ' ' || url ELSE replace(url, 'http', 'ftp') END AS u FROM page)
    SELECT page_id, CASE WHEN trim(u) LIKE 'http%' THEN CASE WHEN substr(trim(u), 1, length(trim(u)) // 2) = substr(trim(u), length(trim(u)) // 2 + 1)
        THEN substr(trim(u), 1, length(trim(u)) // 2) ELSE trim(u) END END AS fixed FROM d""")
def _(t):
    u = F.expr("CASE page_id % 3 WHEN 0 THEN concat(url, url) WHEN 1 THEN concat(' ', url) ELSE replace(url, 'http', 'ftp') END")
    return t.page.select("page_id", urls.repair_url(u).alias("fixed"))


@query("clean_url_markdown", "page", sql="""
    WITH d AS (SELECT page_id, rtrim(replace('](' || url || '))', '](', ''), ')') AS u FROM page) SELECT page_id, CASE WHEN length(u) <= 40 AND u LIKE 'http%' THEN u END AS u FROM d""")
def _(t):
    return t.page.select("page_id", urls.clean_md_url(F.concat(F.lit("]("), F.col("url"), F.lit("))")), 40).alias("u"))


@query("html_escape", "doc", sql="SELECT id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM doc")
def _(t):
    return t.doc.select("id", T.html_escape("text").alias("html"))


@query("sql_escape", "doc", sql="SELECT id, chr(39) || replace(text, chr(39), chr(39) || chr(39)) || chr(39) AS sql_text FROM doc")
def _(t):
    return t.doc.select("id", T.sql_quote("text").alias("sql_text"))


@query("ics_escape", "doc", sql="""
    SELECT id, replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), ';', chr(92) || ';'), ',', chr(92) || ','), chr(10), chr(92) || 'n'), chr(13), '') AS ics FROM doc""")
def _(t):
    return t.doc.select("id", T.ics_escape("text").alias("ics"))


@query("date_parts", "evt", sql="""
    SELECT id, strftime(start_date, '%Y%m%d') AS ics_date, strftime(start_date, '%Y%m%dT%H%M%S') AS ics_datetime,
        CASE WHEN strftime(start_date, '%H%M%S') = '000000' THEN '' ELSE strftime(start_date, '%-I:%M %p') END AS clock FROM evt""")
def _(t):
    return t.evt.select("id", dates.ics_date("start_date").alias("ics_date"), dates.ics_datetime("start_date").alias("ics_datetime"),
                        dates.clock12("start_date").alias("clock"))


@query("parse_date", "evt", sql="""
    WITH s AS (SELECT id, CASE id % 8 WHEN 0 THEN strftime(start_date, '%Y-%m-%dT%H:%M') WHEN 1 THEN strftime(start_date, '%B %d, %Y')
        WHEN 2 THEN strftime(start_date, '%m/%d/%Y') WHEN 3 THEN strftime(start_date, '%d.%m.%Y') WHEN 4 THEN strftime(start_date, '%A, %B %d, %Y')
        WHEN 5 THEN strftime(start_date, '%B %d, %Y at %I:%M %p') WHEN 6 THEN strftime(start_date, '%d %b %Y') ELSE 'next week' END AS raw, start_date FROM evt)
    SELECT id, raw, CASE id % 8 WHEN 7 THEN NULL WHEN 0 THEN date_trunc('minute', start_date) WHEN 5 THEN date_trunc('minute', start_date)
        ELSE date_trunc('day', start_date) END AS parsed FROM s""")
def _(t):
    d = "start_date"
    raw = F.expr(f"""CASE id % 8 WHEN 0 THEN date_format({d}, "yyyy-MM-dd'T'HH:mm") WHEN 1 THEN date_format({d}, 'MMMM dd, yyyy')
        WHEN 2 THEN date_format({d}, 'MM/dd/yyyy') WHEN 3 THEN date_format({d}, 'dd.MM.yyyy') WHEN 4 THEN date_format({d}, 'EEEE, MMMM dd, yyyy')
        WHEN 5 THEN date_format({d}, "MMMM dd, yyyy 'at' hh:mm a") WHEN 6 THEN date_format({d}, 'dd MMM yyyy') ELSE 'next week' END""")
    return t.evt.select("id", raw.alias("raw")).select("id", "raw", dates.parse_date("raw").alias("parsed"))


@query("math", "org", sql="""
    SELECT id, round(1 / (1 + exp(-balance / 5000)), 6) AS sig, round(100.0 * balance / nullif(abs(balance) + 1000, 0), 1) AS share,
        CAST(ceil(balance / 3000) AS BIGINT) AS pages, round(sqrt(abs(balance)), 6) AS root FROM org""")
def _(t):
    b = F.col("balance")
    return t.org.select("id", F.round(T.sigmoid(b / 5000), 6).alias("sig"), T.pct(b, F.abs(b) + 1000).alias("share"),
                        F.ceil(b / 3000).alias("pages"), F.round(F.sqrt(F.abs(b)), 6).alias("root"))


@query("array_ops", "vec", sql="""
    SELECT id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm2, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive,
        CAST(embedding[1:4][4] AS DOUBLE) AS fourth, list_contains(embedding, embedding[7]) AS has FROM vec""")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.vec.select("id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"),
                        F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"),
                        F.get(F.slice(v, 1, 4), F.lit(3)).alias("fourth"), F.array_contains(v, F.get(v, F.lit(6))).alias("has"))


@query("json_ops", "evt", sql="SELECT id, CAST(json_extract_string(description, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(description, '$.none.x'), '-') AS missing FROM evt")
def _(t):
    return t.evt.select("id", T.json_field("description", "$.k").cast("int").alias("k"),
                        F.coalesce(T.json_field("description", "$.none.x"), F.lit("-")).alias("missing"))


@query("base64", "doc", sql="SELECT id, base64(encode(text)) AS packed, decode(from_base64(base64(encode(text)))) AS back FROM doc")
def _(t):
    packed = F.regexp_replace(F.base64("text"), r"\s", "")
    return t.doc.select("id", packed.alias("packed"), F.unbase64(packed).cast("string").alias("back"))


@query("score_terms", "rich", sql=f"SELECT page_id, {count_words('html', K.JOB_TERMS)} AS score FROM rich")
def _(t):
    return t.rich.select("page_id", T.score_terms("html", K.JOB_TERMS).cast("long").alias("score"))


@query("label_map", "org", sql="""
    SELECT id, CASE WHEN source IS NULL OR source = '' THEN '' ELSE 'Source: ' || source END AS source_label,
        CASE organization_type WHEN 'building' THEN 'Builders' WHEN 'machinery' THEN 'Makers' ELSE 'Other' END AS kind FROM org""")
def _(t):
    kind = T.label("organization_type", {"building": "Builders", "machinery": "Makers"}, F.lit("Other"))
    return t.org.select("id", T.source_label("source").alias("source_label"), kind.alias("kind"))


@query("bool_cast", "org", sql="SELECT id, coalesce(jobs_rescraped <> 0, false) AS done, coalesce(accepts_volunteers, false) AS volunteers FROM org")
def _(t):
    return t.org.select("id", T.truthy("jobs_rescraped").alias("done"), T.truthy("accepts_volunteers").alias("volunteers"))


# --- pages to text -----------------------------------------------------------------------

@query("html_text", "rich", sql=f"SELECT page_id, {simple_text('html')} AS text FROM rich")
def _(t):
    return t.rich.select("page_id", X.text_simple("html").alias("text"))


def full_text(c: str, tags=tuple(K.SKIP_TAGS_FULL)) -> str:
    for part in ("<!--.*?-->", "<!DOCTYPE[^>]*>", *(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in tags)):
        c = f"regexp_replace({c}, '(?is){part}', ' ', 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]+>', ' ', 'g')"
    # the references that lost their end in a cut title are decoded too
    return squeezed(f"regexp_replace({unescaped(c)}, '&amp$|&amp ', '& ', 'g')")


def lines_text(c: str, tags) -> str:
    """The visible text runs of a page, one a line."""
    for part in ("<!--.*?-->", "<!DOCTYPE[^>]*>", *(rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in tags)):
        c = f"regexp_replace({c}, '(?is){part}', chr(1), 'g')"
    runs = f"string_split(regexp_replace({c}, '(?s)<[^>]+>', chr(1), 'g'), chr(1))"
    return f"array_to_string(list_filter(list_transform({runs}, lambda x: {squeezed(unescaped('x'))}), lambda x: x <> ''), chr(10))"


@query("html_text_full", "rich", sql=f"SELECT page_id, {full_text('html')} AS text FROM rich")
def _(t):
    return HT.html_text(t.rich, "full").select("page_id", "text")


@query("title_h1", "rich", sql=f"""
    SELECT page_id, nullif({squeezed(unescaped("nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')"))}, '') AS title,
        nullif({squeezed(unescaped("regexp_replace(nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ''), '(?s)<[^>]+>', '', 'g')"))}, '') AS h1 FROM rich""")
def _(t):
    return t.rich.select("page_id", X.page_title("html").alias("title"), X.page_h1("html").alias("h1"))


_META = """'(?i)<meta\\s+name=["'']description["'']\\s+content=["'']([^"'']{20,})["'']'"""
_PARAS = f"list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda p: {trimmed(chr(34) + 'placeholder' + chr(34))}), lambda p: length(p) > 50)".replace(
    '"placeholder"', "regexp_replace(p, '(?s)<[^>]+>', '', 'g')")


DESCRIBED_SQL = f"""WITH m AS (SELECT page_id, {squeezed(f"nullif(regexp_extract(html, {_META}, 1), '')")} AS meta, {_PARAS} AS paras,
        {trimmed("nullif(regexp_extract(html, 'name=" + chr(34) + "description" + chr(34) + "[^>]*content=" + chr(34) + "([^" + chr(34) + "]+)" + chr(34) + "', 1), '')")} AS tag FROM rich)
    SELECT page_id, CASE WHEN length(meta) > 30 THEN meta END AS meta,
        coalesce(CASE WHEN length(tag) > 30 THEN tag END, paras[1], '') AS described FROM m"""


@query("meta_description", "rich", sql=DESCRIBED_SQL)
def _(t):
    return t.rich.select("page_id", X.meta_description("html").alias("meta"), X.listing_description("html").alias("described"))


_ANCHOR = """'(?is)(<a\\s[^>]*?href=["''][^"'']+["''][^>]*>.*?</a>)'"""


def found_links_sql(pages):
    """``found``: page_id, pos, text, href of the content links of pages (page_id, url, html)."""
    return f"""
    a AS (SELECT page_id, url, list_filter(list_transform(regexp_extract_all(html, {_ANCHOR}, 1), lambda x: {{
            'text': {squeezed(unescaped("regexp_replace(regexp_extract(x, '(?is)^<a\\s[^>]*>(.*)</a>$', 1), '(?s)<[^>]+>', '', 'g')"))},
            'href': {unescaped("regexp_extract(x, '(?is)href=[" + chr(34) + "'']([^" + chr(34) + "'']+)[" + chr(34) + "'']', 1)")}}}),
            lambda p: p.text <> '' AND NOT regexp_matches(p.href, '^(#|javascript:|mailto:|tel:|data:)')) AS l FROM {pages}),
    u AS (SELECT page_id, url, unnest(l) AS p, unnest(range(len(l))) AS pos FROM a),
    v AS (SELECT page_id, url, pos, p.text AS text, p.href AS href FROM u),
    found AS (SELECT page_id, pos, text, {_RESOLVED} AS href FROM v)"""


_FOUND_LINKS = f"WITH {found_links_sql('rich')}"


@query("links", "rich", sql=_FOUND_LINKS + " SELECT page_id, pos, text, href FROM found")
def _(t):
    return C.links(t.rich).select("page_id", F.col("pos").cast("long").alias("pos"), "text", "href")


@query("link_page_follow", "rich", sql=_FOUND_LINKS + """,
    target AS (SELECT href, min(page_id) AS target_id FROM found GROUP BY href)
    SELECT f.href, f.text, f.page_id, t.target_id FROM found f JOIN target t ON f.href = t.href WHERE contains(f.href, '/the')
    QUALIFY row_number() OVER (PARTITION BY f.href ORDER BY f.page_id, f.pos) = 1""")
def _(t):
    # the targets are the addresses the pages link to
    targets = C.links(t.rich).groupBy(F.col("href").alias("url")).agg(F.min("page_id").alias("page_id"), F.min("text").alias("html"))
    return C.follow_links(t.rich, targets, "/the").select("href", "text", "page_id", "target_id")


@query("emails", "note", sql=f"""
    WITH e AS (SELECT id, regexp_extract_all(text, '{K.EMAIL}') AS found FROM note)
    SELECT id, array_to_string(list_sort(list_distinct(found)), ',') AS emails,
        coalesce(list_filter(found, lambda e: NOT regexp_matches(lower(e), '^(info@|contact@|admin@|support@|office@|hello@|webmaster@)'))[1], found[1]) AS contact FROM e""")
def _(t):
    return t.note.select("id", F.array_join(F.array_sort(X.emails("text")), ",").alias("emails"), X.contact_email("text").alias("contact"))


GEO_SQL = ("SELECT page_id, " + ", ".join(
    "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(html, '{esc(p)}', {g}), '') AS DOUBLE)" for p in K.GEO_PATTERNS) + f") AS {n}"
    for g, n in ((1, "latitude"), (2, "longitude"))) + " FROM rich")


@query("geo_from_html", "rich", sql=GEO_SQL)
def _(t):
    return t.rich.select("page_id", X.geo_point("html").alias("p")).select("page_id", "p.latitude", "p.longitude")


OWN_SITE_SQL = f"""WITH a AS (SELECT page_id, nullif(regexp_extract(html, 'og:url"[^>]*content="([^"]+)"', 1), '') AS og, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
        list_filter(list_transform(regexp_extract_all(html, {_ANCHOR}, 1), lambda x: {{'text': regexp_replace(regexp_extract(x, '(?is)^<a\\s[^>]*>(.*)</a>$', 1), '(?s)<[^>]+>', '', 'g'),
            'href': {unescaped("regexp_extract(x, '(?is)href=[" + chr(34) + "'']([^" + chr(34) + "'']+)[" + chr(34) + "'']', 1)")}}}), lambda p: trim(p.text) <> '') AS l FROM rich)
    SELECT page_id, coalesce(og, list_filter(l, lambda p: p.href LIKE 'http%' AND NOT contains(p.href, host)
        AND NOT regexp_matches(p.href, '{'|'.join(K.SOCIAL_WORDS)}'))[1].href, '') AS website FROM a"""


@query("own_website", "rich", sql=OWN_SITE_SQL)
def _(t):
    return t.rich.select("page_id", X.own_website("html", "url").alias("website"))


@query("popup_to_description", "org", sql="""
    WITH p AS (SELECT id, coalesce(popup_html, '<strong>' || name || '</strong>' || coalesce(description, '') || '<br>') AS h FROM org)
    SELECT id, coalesce(nullif(trim(regexp_replace(regexp_replace(nullif(regexp_extract(h, '(?s)<p>(.*?)</p>', 1), ''), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), ''),
        nullif(trim(regexp_replace(regexp_replace(nullif(regexp_extract(h, '(?s)</strong>(.*?)(?:<br>|<span|<div|<a|<small|$)', 1), ''), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), ''), '') AS text FROM p""")
def _(t):
    from meadowlark.functions.text import first_nonempty
    made = F.concat(F.lit("<strong>"), F.col("name"), F.lit("</strong>"), first_nonempty("description"), F.lit("<br>"))
    return t.org.select("id", X.popup_description(F.coalesce("popup_html", made)).alias("text"))


@query("page_relevance", "rich", sql=f"SELECT page_id FROM rich WHERE {count_words('html', K.STAY_BOARD_TERMS)} >= 2 AND length(html) > 150")
def _(t):
    return t.rich.where(X.relevant("html", K.STAY_BOARD_TERMS, 2, 150)).select("page_id")


# --- jobs, stays ---------------------------------------------------------------------------

def _clean_sql(c):
    c = f"regexp_replace({c}, '\\[LINK:[^\\]]+\\]', '', 'g')"
    for p in K.NAV_PHRASES:
        c = f"regexp_replace({c}, '(?i)(?:{p})', '', 'g')"
    return trimmed(f"regexp_replace({squeezed(c)}, '^[|·–—\\s]+', '')")


def _skills_sql(c):
    tries = []
    for p in K.SKILLS_PATTERNS:
        f = f"rtrim({trimmed(f'''nullif(regexp_extract({c}, '{esc(p)}', 1), '')''')}, ',.;:')"
        tries.append(f"CASE WHEN length({f}) > 10 AND length({f}) < 300 THEN {f} END")
    return "coalesce(" + ", ".join(tries) + ")"


def _commit_sql(c):
    tries = []
    for p in K.COMMITMENT_PATTERNS:
        f = trimmed(f"nullif(regexp_extract({c}, '{esc(p)}', 0), '')")
        tries.append(f"CASE WHEN length({f}) > 3 AND length({f}) < 200 THEN {f} END")
    return "coalesce(" + ", ".join(tries) + ")"


@query("job_role", "note", sql=f"""
    SELECT id, CASE WHEN contains(lower(text), 'intern') THEN 'internship' WHEN contains(lower(text), 'apprentice') THEN 'apprenticeship'
        WHEN {any_word('text', K.PAID_WORDS)} THEN 'paid_job' ELSE 'volunteer' END AS role FROM note""")
def _(t):
    return t.note.select("id", X.job_role("text").alias("role"))


@query("job_attributes", "note", sql=f"""
    SELECT id, {_skills_sql('text')} AS skills_needed, {_commit_sql('text')} AS commitment,
        try_strptime(nullif(regexp_extract(text, '{esc(K.START_DATE)}', 1), ''), '%m/%d/%Y') AS start_date,
        {' OR '.join(f"regexp_matches(text, '{esc(p)}')" for p in K.REMOTE_PATTERNS)} AS remote_options FROM note""")
def _(t):
    a = t.note.select("id", X.job_attributes("text").alias("a"))
    return a.select("id", "a.skills_needed", "a.commitment", "a.start_date", "a.remote_options")


def job_blocks_sql(pages, name, terms, min_len=100):
    """``blocks``: page_id, title, block, role of pages (page_id, text, name). A block starts at each
    word from which capitals run on; the pattern's look-ahead is tested at every position."""
    caps = r"^[A-Z][A-Z\s&\-/,]{5,80}[A-Z](?:[^\p{L}\p{N}_]|$)"
    first = _clean_sql(r"string_split_regex(block, '[.!?]\s+')[1]")
    return rf"""
    j0 AS (SELECT page_id, {name} AS name, CASE WHEN length(text) >= 200 THEN {_clean_sql('text')} ELSE '' END AS t FROM {pages}),
    j1 AS (SELECT *, list_filter(range(1, length(t) + 1), lambda i: i = 1 OR (NOT regexp_matches(substr(t, i - 1, 1), '[\p{{L}}\p{{N}}_]') AND regexp_matches(substr(t, i, 84), '{caps}'))) AS starts FROM j0),
    j2 AS (SELECT page_id, name, t, list_filter(list_transform(range(1, len(starts) + 1), lambda k: {trimmed('substr(t, starts[k], coalesce(starts[k + 1], length(t) + 1) - starts[k])')}),
        lambda b: length(b) >= {min_len} AND {count_words('b', terms)} >= 2) AS hits FROM j1),
    j3 AS (SELECT page_id, name, unnest(hits) AS block, false AS whole FROM j2 UNION ALL
        SELECT page_id, name, t, true FROM j2 WHERE len(hits) = 0 AND length(t) > 300 AND {count_words('t', terms)} >= 3),
    j4 AS (SELECT *, {first} AS lead FROM j3),
    blocks AS (SELECT page_id, CASE WHEN length(lead) < 5 THEN 'Opportunity at ' || name ELSE lead END AS title, block, CASE WHEN whole THEN 'volunteer' WHEN contains(lower(block), 'intern') THEN 'internship'
        WHEN contains(lower(block), 'apprentice') THEN 'apprenticeship' WHEN {any_word('block', K.PAID_WORDS)} THEN 'paid_job' ELSE 'volunteer' END AS role FROM j4)"""


@query("job_blocks", "rich", sql=f"""
    WITH p AS (SELECT page_id, url, {full_text('html')} AS text FROM rich), {job_blocks_sql('p', 'url', K.JOB_TERMS)}
    SELECT page_id, title, role, length(block) AS n FROM blocks""")
def _(t):
    pages = HT.html_text(t.rich, "full")
    return pages.select("page_id", F.inline(X.job_blocks("text", F.col("url"), min_len=100))).select("page_id", "title", "role", F.length("block").cast("long").alias("n"))


def title_blocks_sql(lined, key):
    """``titled``: key, b (title, description) of the listings in texts with line breaks (key, text)."""
    return rf"""
    l AS (SELECT {key}, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {trimmed('x')}), lambda x: x <> '') AS lines FROM {lined}),
    m AS (SELECT {key}, text, string_split(array_to_string(list_transform(lines, lambda x: CASE WHEN length(x) < 100 AND ((regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))
        OR (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '(^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(x, '\p{{L}}\p{{Lu}}')) OR ends_with(x, ':'))
        THEN chr(1) || x ELSE x END), chr(10)), chr(1))[2:] AS pieces FROM l),
    k AS (SELECT {key}, text, list_filter(list_transform(pieces, lambda p: {{'title': split_part(p, chr(10), 1),
        'description': {trimmed("replace(regexp_replace(p, '^[^' || chr(10) || ']*' || chr(10) || '?', ''), chr(10), ' ')")}}}), lambda x: length(x.description) > 50) AS kept FROM m),
    titled AS (SELECT {key}, unnest(CASE WHEN len(kept) = 0 AND length(text) > 200 THEN [{{'title': split_part(text, '. ', 1), 'description': text}}] ELSE kept END) AS b FROM k)"""


@query("title_blocks", "doc", sql=f"""
    WITH n AS (SELECT id, replace(text, '. ', '.' || chr(10)) AS text FROM doc), {title_blocks_sql('n', 'id')}
    SELECT id, b.title AS title, b.description AS description FROM titled""")
def _(t):
    lined = t.doc.select("id", F.replace("text", F.lit(". "), F.lit(".\n")).alias("text"))
    return lined.select("id", F.inline(X.title_blocks("text")))


def job_title_sql(h1, title, name):
    """The first usable of heading and page title of an organization called ``name``."""
    words_ = r"string_split_regex(t, '\s+')"
    return rf"""list_filter([{trimmed("regexp_replace(" + squeezed(h1) + r", '\s*[|–—-]\s*.*$', '')")},
        regexp_replace({trimmed("regexp_replace(" + squeezed(title) + r", '\s*[|–—-]\s*.*$', '')")}, '(?i)^Home\s*[-|]\s*', '')],
        lambda t: length(t) > 5 AND length(t) < 80 AND NOT {any_word('t', K.TITLE_JUNK)} AND lower(t) <> lower({name})
        AND NOT (len({words_}) > 8 AND len(list_filter({words_}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) > len({words_}) * 0.7))[1]"""


H1_SQL = unescaped("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]+>', '', 'g')")


@query("job_title", "rich", sql=rf"""
    WITH c AS (SELECT page_id, list_filter([{trimmed("regexp_replace(" + squeezed('h1') + r", '\s*[|–—-]\s*.*$', '')")},
        regexp_replace({trimmed("regexp_replace(" + squeezed('title') + r", '\s*[|–—-]\s*.*$', '')")}, '(?i)^Home\s*[-|]\s*', '')],
        lambda t: length(t) > 5 AND length(t) < 80 AND NOT {any_word('t', K.TITLE_JUNK)} AND lower(t) <> 'farm'
        AND NOT (len(string_split_regex(t, '\s+')) > 8 AND len(list_filter(string_split_regex(t, '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}'))) > len(string_split_regex(t, '\s+')) * 0.7)) AS l
        FROM (SELECT page_id, {unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
            {unescaped("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]+>', '', 'g')")} AS h1 FROM rich))
    SELECT page_id, coalesce(l[1], 'Volunteer at Farm') AS title FROM c""")
def _(t):
    return t.rich.select("page_id", X.job_title(X.page_h1("html"), X.page_title("html"), F.lit("Farm")).alias("title"))


_BREAK = r"string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _list_of(c):
    return f"list_transform({_BREAK.format(c=c)}, lambda s: {trimmed('s')})"


def _prose_sql(s, skip):
    ws = rf"string_split_regex({s}, '\s+')"
    return (rf"length({s}) >= 25 AND NOT {any_word(s, skip)} AND NOT (len(list_filter({ws}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) > len({ws}) * 0.7 AND len({ws}) > 5)"
            rf" AND length({s}) - length(replace({s}, '|', '')) <= 2 AND NOT regexp_matches({s}, '(?i)^[\w\s\-]+\.(com|org|net|de|io|uk|co)\b')"
            rf" AND NOT regexp_matches({s}, '^(Home|About|Contact|Blog|Events|Gallery|Shop)\s+')")


@query("best_sentences", "doc", sql=f"""
    WITH p AS (SELECT id, list_filter({_list_of(squeezed('text'))}, lambda s: {_prose_sql('s', K.SENTENCE_SKIP + K.SENTENCE_SKIP_EXTRA)}
        AND NOT regexp_matches(s, '^(Transition Group|Community Growing|Other food|Nature Community)')) AS l FROM doc),
    r AS (SELECT id, unnest(l) AS s, unnest(range(len(l))) AS i FROM p),
    b AS (SELECT *, 3 * {count_words('s', K.SENTENCE_HIGH)} + 2 * {count_words('s', K.SENTENCE_MEDIUM)} + {count_words('s', K.SENTENCE_LOW)} AS base FROM r),
    a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k FROM b WHERE i < 5 OR base > 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY base + greatest(0, 5 - k) DESC, k) AS o FROM a),
    g AS (SELECT id, string_agg(s, ' ' ORDER BY o) AS best FROM t GROUP BY id)
    SELECT d.id, coalesce(g.best, '') AS best FROM doc d LEFT JOIN g ON d.id = g.id""")
def _(t):
    return t.doc.select("id", X.best_sentences(T.squeeze("text")).alias("best"))


# page_id, text, title and meta of pages -> their job description; an organization is called ``name``
def described_sql(pages, name):
    lead = "ltrim(substr({c}, length({l}) + 1), ' —|-–·')"
    drop = lambda c, l: f"CASE WHEN starts_with({c}, {l}) THEN {lead.format(c=c, l=l)} ELSE {c} END"
    return rf"""
    d1 AS (SELECT *, {drop('text', "coalesce(title, '')")} AS x FROM {pages}),
    d2 AS (SELECT *, {drop('x', name)} AS y FROM d1),
    d3 AS (SELECT *, {trimmed(r"regexp_replace(y, '^[—–\-|·\s]+', '')")} AS body FROM d2),
    d4 AS (SELECT *, {_list_of('body')} AS every FROM d3),
    d5 AS (SELECT page_id, list_filter(every, lambda s: {_prose_sql('s', K.SENTENCE_SKIP + K.SENTENCE_SKIP_EXTRA)}
        AND NOT regexp_matches(s, '^(Transition Group|Community Growing|Other food|Nature Community)')) AS l FROM d4),
    d6 AS (SELECT page_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM d5),
    d7 AS (SELECT *, 3 * {count_words('s', K.SENTENCE_HIGH)} + 2 * {count_words('s', K.SENTENCE_MEDIUM)} + {count_words('s', K.SENTENCE_LOW)} AS base FROM d6),
    d8 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS k FROM d7 WHERE i < 5 OR base > 0),
    d9 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY base + greatest(0, 5 - k) DESC, k) AS o FROM d8),
    dg AS (SELECT page_id, string_agg(s, ' ' ORDER BY o) AS best FROM d9 GROUP BY page_id),
    dj AS (SELECT d4.*, coalesce(dg.best, '') AS best, list_filter(every, lambda s: length(s) > 40 AND {any_word('s', K.SENTENCE_HIGH + K.SENTENCE_MEDIUM)})[1] AS topical
        FROM d4 LEFT JOIN dg ON d4.page_id = dg.page_id),
    described AS (SELECT page_id, CASE WHEN length(meta) > 80 AND NOT {any_word('meta', K.META_JUNK)} THEN meta
        WHEN coalesce(text, '') = '' THEN CASE WHEN length(meta) > 50 THEN meta END
        WHEN length(best) > 50 THEN best
        ELSE coalesce(topical, CASE WHEN length(meta) > 50 THEN meta END) END AS description FROM dj)"""


TITLE_SQL = f"""nullif({squeezed(unescaped("nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')"))}, '')"""


META_SQL = squeezed(f"nullif(regexp_extract(html, {_META}, 1), '')")


@query("job_description", "rich", sql=f"""
    WITH p AS (SELECT page_id, {full_text('html')} AS text, {TITLE_SQL} AS title, {META_SQL} AS m FROM rich),
    q AS (SELECT page_id, text, title, CASE WHEN length(m) > 30 THEN m END AS meta FROM p), {described_sql('q', "'Farm'")}
    SELECT page_id, description FROM described""")
def _(t):
    pages = HT.html_text(t.rich, "full")
    return pages.select("page_id", X.job_description("text", X.page_title("html"), F.lit("Farm"), X.meta_description("html")).alias("description"))


@query("lead_sentences", "doc", sql=rf"""
    WITH b AS (SELECT id, {trimmed("regexp_replace(" + _clean_sql("text") + r", '^[—–\-|·\s]+', '')")} AS body FROM doc),
    e AS (SELECT id, body, {_list_of('body')} AS l FROM b),
    c AS (SELECT id, body, array_to_string(list_filter(l, lambda s: {_prose_sql('s', K.SENTENCE_SKIP)}), ' ') AS lead,
        list_filter(l, lambda s: length(s) > 40 AND {any_word('s', K.SENTENCE_FALLBACK)})[1] AS topical FROM e),
    x AS (SELECT id, body, CASE WHEN length(lead) >= 50 THEN lead ELSE coalesce(topical, lead) END AS chosen FROM c)
    SELECT id, CASE WHEN length(chosen) >= 50 THEN chosen ELSE body END AS lead FROM x""")
def _(t):
    return t.doc.select("id", X.lead_sentences("text").alias("lead"))


@query("clean_text", "note", sql=f"""
    SELECT id, {_clean_sql('text')} AS cleaned, {squeezed("regexp_replace(" + squeezed('text') + ", 'https?://\\S+', '', 'g')")} AS without_urls FROM note""")
def _(t):
    return t.note.select("id", X.clean_text("text").alias("cleaned"), X.drop_urls("text").alias("without_urls"))


@query("strip_markdown", "doc", sql=r"""
    WITH m AS (SELECT id, '## ' || text || ' [link](http://a.b) ![i](x) **bold**' || chr(10) || '- item' AS md FROM doc)
    SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '!\[[^\]]*\]\([^)]*\)', '', 'g'),
        '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '#+\s*', '', 'g'), '[\*_]{1,3}', '', 'g'), '(?m)^[\*\-]\s+', '', 'g'), '\s+', ' ', 'g')) AS plain FROM m""")
def _(t):
    md = F.concat(F.lit("## "), F.col("text"), F.lit(" [link](http://a.b) ![i](x) **bold**\n- item"))
    return t.doc.select("id", X.strip_markdown(md).alias("plain"))


def _plain_md(c):
    for p, to in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"#+\s*", ""), (r"[\*_]{1,3}", ""), (r"(?m)^[\*\-]\s+", "")):
        c = f"regexp_replace({c}, '{p}', '{to}', 'g')"
    return squeezed(c)


@query("markdown_block", "doc", sql=rf"""
    WITH m AS (SELECT id, {trimmed("replace(text, chr(10), chr(10) || '## ')")} AS body FROM doc),
    b AS (SELECT id, {_plain_md('body')} AS whole, list_filter(list_transform(string_split_regex(body, '\n#{{1,3}}\s+'), lambda x: {_plain_md('x')}),
        lambda x: {any_word('x', K.COMMUNITY_WORDS)})[1] AS topical FROM m)
    SELECT id, coalesce(topical, CASE WHEN length(whole) > 60 THEN whole END) AS block FROM b""")
def _(t):
    md = F.concat(F.lit("Title: x\nMarkdown Content:\n"), F.regexp_replace("text", "\n", "\n## "))
    return t.doc.select("id", X.markdown_block(md).alias("block"))


def price_sql(c):
    phrases = ", ".join(f"CASE WHEN length(regexp_extract({c}, '{esc(p)}', 0)) < 200 THEN nullif({trimmed(f"regexp_extract({c}, '{esc(p)}', 0)")}, '') END" for p in K.PRICE_PATTERNS)
    return f"coalesce({phrases}, nullif(array_to_string(regexp_extract_all({c}, '{esc(K.AMOUNT)}', 1), ', '), ''))"


def stay_types_sql(c):
    named = ", ".join(f"CASE WHEN {any_word(c, ws)} THEN '{n}' END" for n, ws in K.STAY_TYPE_WORDS)
    return f"coalesce(nullif(concat_ws(', ', {named}), ''), 'accommodation')"


@query("price_info", "note", sql=f"SELECT id, {price_sql('text')} AS price FROM note")
def _(t):
    return t.note.select("id", X.price_info("text").alias("price"))


@query("stay_types", "note", sql=f"SELECT id, {stay_types_sql('text')} AS types FROM note")
def _(t):
    return t.note.select("id", X.stay_types("text").alias("types"))


@query("booking_class", "rich", sql=f"""
    WITH f AS (SELECT page_id, regexp_matches(lower(html), '<form\\b') AS form, regexp_matches(lower(html), '<iframe\\b') AS frame, regexp_matches(html, '{K.EMAIL}') AS mail,
        regexp_matches(html, '{esc(K.PHONE)}') AS phone, {any_word('html', K.BOOKING_CALENDARS)} AS cal, {count_words(simple_text('html'), K.BOOKING_KEYWORDS)} AS kw,
        CAST(len(list_filter(regexp_extract_all(lower(html), 'href=["'']([^"'']+)["'']', 1), lambda h: regexp_matches(h, '{'|'.join(w.replace('.', '\\.') for w in K.BOOKING_HOSTS)}'))) AS BIGINT) AS ext FROM rich)
    SELECT page_id, kw AS keywords, ext AS external, CASE WHEN form AND kw >= 2 THEN 'direct_form' WHEN frame OR ext > 0 THEN 'external_widget' WHEN cal THEN 'calendar_tool'
        WHEN (mail OR phone) AND kw >= 1 THEN 'email_phone' ELSE 'unknown' END AS booking_type FROM f""")
def _(t):
    f = t.rich.withColumn("text", X.text_simple("html")).select("page_id", X.booking_features("html", "text", "url").alias("f"))
    return f.select("page_id", F.col("f.booking_keywords").cast("long").alias("keywords"), F.size("f.external_links").cast("long").alias("external"),
                    X.booking_class(F.col("f")).alias("booking_type"))


# page_id, html, t (text) of pages -> booking features and class of the second pass
def booking_fine_sql(pages):
    hosts = "|".join(w.replace(".", chr(92) + ".") for w in K.BOOKING_HOSTS_FINE)
    return f"""
    f0 AS (SELECT page_id, lower(html) AS h, lower(t) AS t FROM {pages}),
    f1 AS (SELECT page_id, regexp_matches(h, '<form\\b') AS form, regexp_matches(h, '<iframe\\b') AS frame, regexp_matches(t, '{K.EMAIL}') AS mail,
        regexp_matches(t, '{esc(K.PHONE)}') AS phone, {any_word('t', K.BOOKING_CALENDARS_FINE)} AS cal, {count_words('t', K.BOOKING_KEYWORDS_FINE)} AS keywords,
        CAST(len(list_filter(regexp_extract_all(h, '<a\\b[^>]*href=["'']([^"'']+)["'']', 1), lambda x: regexp_matches(x, '{hosts}'))) AS BIGINT) AS external FROM f0),
    booked AS (SELECT page_id, keywords, external, CASE WHEN form AND keywords >= 2 THEN 'direct_form' WHEN frame OR external > 0 THEN 'external_widget' WHEN cal THEN 'calendar_tool'
        WHEN (mail OR phone) AND keywords >= 1 THEN 'email_phone' ELSE 'unknown' END AS booking_type FROM f1)"""


@query("booking_class_fine", "rich", sql=f"WITH p AS (SELECT page_id, html, {simple_text('html')} AS t FROM rich), {booking_fine_sql('p')} SELECT * FROM booked")
def _(t):
    f = t.rich.withColumn("text", X.text_simple("html")).select("page_id", X.booking_features_fine("html", "text", "url").alias("f"))
    return f.select("page_id", F.col("f.booking_keywords").cast("long").alias("keywords"), F.size("f.external_links").cast("long").alias("external"),
                    X.booking_class(F.col("f")).alias("booking_type"))


@query("stay_listing", "doc", sql="SELECT id, split_part(text, '. ', 1) AS title, text AS description FROM doc")
def _(t):
    return t.doc.select("id", X.stay_listing("text").alias("s")).select("id", "s.title", "s.description")


# --- events ----------------------------------------------------------------------------------

CALENDAR_SQL = """CASE WHEN regexp_matches(lower(html), 'href=["''][^"'']+\\.ics["'']') THEN 'ics_feed' WHEN contains(lower(html), 'calendar.google.com') OR contains(lower(html), 'google.com/calendar') THEN 'google_embed'
        WHEN contains(lower(html), 'eventbrite') THEN 'eventbrite' WHEN contains(lower(html), 'meetup.com') THEN 'meetup'
        WHEN contains(lower(html), 'outlook.office365.com') OR contains(lower(html), 'outlook.live.com') THEN 'outlook' END"""


@query("calendar_system", "rich", sql=f"SELECT page_id, {CALENDAR_SQL} AS system FROM rich")
def _(t):
    return t.rich.select("page_id", X.calendar_system("html").alias("system"))


_EVENT_DATES = f"list_filter(list_transform(list_concat({', '.join(f"regexp_extract_all(text, '{esc(p)}', 1)" for p in K.EVENT_DATE_PATTERNS)}), lambda x: {trimmed('x')}), lambda x: length(x) > 5)"


def event_blocks_sql(pages):
    """``ev``: the listings of pages (page_id, url, html), found by the patterns of whole containers."""
    marked = (rf"(?is)<(?:{K.EVENT_MARKED_TAGS})[^>]*?(?:class|id)=[" + '"' + rf"''][^" + '"' + rf"'']*(?:{K.EVENT_MARKS})[^" + '"' + rf"'']*["
              + '"' + rf"''][^>]*>(.*?)</(?:{K.EVENT_MARKED_TAGS})>")
    dated = rf"(?is)<(?:{K.EVENT_DATED_TAGS})[^>]*>(.*?{K.EVENT_BLOCK_DATE}.*?)</(?:{K.EVENT_DATED_TAGS})>"
    timed = rf"(?is)<(?:{K.EVENT_DATED_TAGS})[^>]*>(.*?<time[^>]*>.*?</time>.*?)</(?:{K.EVENT_DATED_TAGS})>"
    title = "|".join(f"(?:{p})" for p in K.JUNK_TITLES)
    about = "|".join(f"(?:{p})" for p in K.JUNK_DESCRIPTIONS)
    junk = (rf"(({trimmed('title')} = '' AND {trimmed('description')} = '') OR regexp_matches({trimmed('title')}, '(?i){esc(title)}') OR regexp_matches({trimmed('description')}, '(?i){esc(about)}')"
            rf" OR (len(list_filter(string_split_regex({trimmed('title')}, '\s+'), lambda w: w <> '')) <= 2 AND length({trimmed('description')}) < 50 AND start_raw IS NULL))")
    flags = f"regexp_matches(text, '{K.BLOCK_ONLINE}') AS is_online, regexp_matches(text, '{K.BLOCK_IN_PERSON}') AS is_in_person"
    link = rf"""list_filter(list_transform(list_filter(regexp_extract_all(b, '(?is)<a\s[^>]*?href=["'']([^"'']+)["'']', 1), lambda href: NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:|data:)')),
        lambda href: {_RESOLVED}), lambda x: regexp_matches(x, '{K.BLOCK_REGISTER}'))[1]"""
    return rf"""
    v0 AS (SELECT page_id, url, html, regexp_extract_all(html, '{marked}', 1) AS marked, regexp_extract_all(html, '{dated}', 1) AS dated, regexp_extract_all(html, '{timed}', 1) AS timed FROM {pages}),
    v1 AS (SELECT *, CASE WHEN len(marked) < 2 THEN list_concat(marked, list_filter(dated, lambda x, i: list_position(dated, x) = i)) ELSE marked END AS f FROM v0),
    v2 AS (SELECT page_id, url, CASE WHEN len(f) < 2 THEN list_concat(f, timed) ELSE f END AS f FROM v1),
    v3 AS (SELECT page_id, url, unnest(f) AS b, unnest(range(len(f))) AS pos FROM v2),
    v4 AS (SELECT *, {simple_text('b')} AS text, {simple_text("regexp_extract(b, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)")} AS heading FROM v3),
    v5 AS (SELECT *, {_EVENT_DATES} AS l FROM v4),
    v6 AS (SELECT page_id, 1000000 + pos AS pos, coalesce(nullif(heading, ''), string_split_regex(text, '[.!?]\s+')[1]) AS title, text AS description,
        list_filter(l, lambda x, i: list_position(l, x) = i)[1] AS start_raw, list_filter(l, lambda x, i: list_position(l, x) = i)[2] AS end_raw, {flags}, {link} AS registration_url, url AS event_url FROM v5),
    v7 AS (SELECT * FROM v6 WHERE length(description) >= 20 AND NOT {junk}),
    w0 AS (SELECT page_id, unnest(l) AS j, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\+json["''][^>]*>(.*?)</script>', 1) AS l FROM {pages})),
    w1 AS (SELECT page_id, pos, coalesce(j ->> '$.name', '') AS title, coalesce(j ->> '$.description', '') AS description, j ->> '$.startDate' AS start_raw, j ->> '$.endDate' AS end_raw,
        regexp_matches(lower(coalesce(j ->> '$.location', '')), 'virtual|online') AS is_online, NOT regexp_matches(lower(coalesce(j ->> '$.location', '')), 'virtual|online') AS is_in_person,
        CAST(NULL AS VARCHAR) AS registration_url, coalesce(j ->> '$.url', '') AS event_url FROM w0 WHERE contains(lower(j ->> '$."@type"'), 'event')),
    y0 AS (SELECT page_id, url, html, {simple_text('html')} AS text, {CALENDAR_SQL} AS kind, nullif(regexp_extract(html, '(?i)href=["'']([^"'']+\.ics)["'']', 1), '') AS href FROM {pages}
        WHERE page_id NOT IN (SELECT page_id FROM v7) AND page_id NOT IN (SELECT page_id FROM w1)),
    y1 AS (SELECT *, CASE WHEN href IS NOT NULL THEN {_RESOLVED} END AS feed FROM y0 WHERE len(regexp_extract_all(text, '{K.DATE_MENTION}', 1)) >= 3 OR regexp_matches(text, '{K.EVENT_PAGE_WORDS}')),
    y2 AS (SELECT page_id, 0 AS pos, coalesce('Calendar (' || CASE kind WHEN 'ics_feed' THEN 'Ics Feed' WHEN 'google_embed' THEN 'Google Embed' ELSE upper(kind[1]) || kind[2:] END || ')', 'Events & Programs') AS title,
        coalesce('Embedded ' || kind || ' calendar detected. ' || text || coalesce(' Feed: ' || feed, ''), text) AS description, CAST(NULL AS VARCHAR) AS start_raw, CAST(NULL AS VARCHAR) AS end_raw, {flags},
        feed AS registration_url, url AS event_url, length(text) AS n FROM y1),
    every AS (SELECT * FROM v7 UNION ALL SELECT * FROM w1 UNION ALL SELECT * EXCLUDE (n) FROM y2 WHERE n >= 20 AND NOT {junk}),
    ev AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY page_id, lower({trimmed('title')}), CASE WHEN {trimmed('title')} = '' THEN pos END ORDER BY pos) = 1)"""


@query("event_blocks", "rich", sql=f"""
    WITH {event_blocks_sql('rich')} SELECT page_id, title, description, start_raw, end_raw, is_online, is_in_person, registration_url FROM ev""")
def _(t):
    from meadowlark.operators.events import event_blocks
    return event_blocks(t.rich).select("page_id", "title", "description", "start_raw", "end_raw", "is_online", "is_in_person", "registration_url")


@query("event_dates", "note", sql=f"""
    WITH d AS (SELECT id, list_filter(list_transform(list_concat({', '.join(f"regexp_extract_all(text, '{esc(p)}', 1)" for p in K.EVENT_DATE_PATTERNS)}), lambda x: {trimmed('x')}), lambda x: length(x) > 5) AS l FROM note),
    u AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM d)
    SELECT id, l[1] AS first_date, l[2] AS second_date, array_to_string(l, '|') AS dates FROM u""")
def _(t):
    return t.note.select("id", X.event_dates("text").alias("d")).select("id", F.get("d", F.lit(0)).alias("first_date"), F.get("d", F.lit(1)).alias("second_date"),
                                                                         F.array_join("d", "|").alias("dates"))


@query("jsonld_blocks", "rich", sql=r"""
    WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\+json["''][^>]*>(.*?)</script>', 1)) AS j FROM rich)
    SELECT page_id, '{"@type":"' || (j ->> '$."@type"') || '","location":"' || (j ->> '$.location') || '","name":"' || (j ->> '$.name') || '","startDate":"' || (j ->> '$.startDate') || '"}' AS item FROM b""")
def _(t):
    return web.jsonld_items(t.rich).select("page_id", "item")


@query("jsonld_event", "rich", sql=r"""
    WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*type=["'']application/ld\+json["''][^>]*>(.*?)</script>', 1)) AS j FROM rich)
    SELECT page_id, j ->> '$.name' AS title, strptime(j ->> '$.startDate', '%Y-%m-%dT%H:%M') AS start_date, contains(lower(j ->> '$.location'), 'online') AS is_online,
        NOT contains(lower(j ->> '$.location'), 'online') AS is_in_person, coalesce(j ->> '$.url', '') AS url FROM b WHERE contains(lower(j ->> '$."@type"'), 'event')""")
def _(t):
    return web.jsonld_events(web.jsonld_items(t.rich)).select("page_id", "title", "start_date", "is_online", "is_in_person", "url")


_PLATFORM = "(?i)" + "|".join(K.VIDEO_PATTERNS)


def event_dates_sql(pages):
    """``resolved``: page_id, start_date, end_date, online, person, video of pages (page_id, html)."""
    date = "coalesce(try_strptime({x}, '%Y-%m-%dT%H:%M'), try_strptime({x}, ['%Y-%m-%d %H:%M', '%Y-%m-%d', '%B %d, %Y', '%B %d %Y', '%b %d, %Y', '%b %d %Y', '%d %B %Y', '%d %b %Y']))"
    meta = lambda *names: "coalesce(" + ", ".join(date.format(x=f"""nullif(regexp_extract(html, '(?i)<meta\\s+(?:property|name)=["'']{n}["'']\\s+content=["'']([^"'']+)["'']', 1), '')""") for n in names) + ")"
    found = ", ".join(date.format(x=f"nullif(regexp_extract(t, '{esc(p)}', 1), '')") for p in K.PAGE_DATE_PATTERNS)
    half = "upper(regexp_extract(c, '(?i)([ap]m)$', 1))"
    hour = "CAST(regexp_extract(c, '^(\\d{1,2})', 1) AS INTEGER)"
    minute = "coalesce(TRY_CAST(nullif(regexp_extract(c, ':(\\d{2})', 1), '') AS INTEGER), 0)"
    return f"""
    e0 AS (SELECT page_id, html, {simple_text('html')} AS t FROM {pages}),
    e1 AS (SELECT page_id, html, t, regexp_extract(html, '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1) AS raw FROM e0),
    e2 AS (SELECT page_id, html, t, CASE WHEN raw <> '' AND contains(lower(raw ->> '$."@type"'), 'event') THEN raw END AS j FROM e1),
    e3 AS (SELECT page_id, t, j IS NOT NULL AS known, try_strptime(j ->> '$.startDate', '%Y-%m-%dT%H:%M') AS s1, lower(coalesce(j ->> '$.location', '')) AS place,
        coalesce({meta('og:start_date', 'article:published_time', 'event:start_time')}, list_filter([{found}], lambda d: year(d) >= 2024)[1]) AS s2,
        {meta('og:end_date', 'event:end_time')} AS end_date,
        coalesce(nullif(regexp_extract(t, '\\b(\\d{{1,2}}:\\d{{2}})\\s*(AM|PM|am|pm)\\b', 0), ''), nullif(regexp_extract(t, '\\b(\\d{{1,2}})\\s*(AM|PM|am|pm)\\b', 0), ''), nullif(regexp_extract(t, '\\b(\\d{{1,2}}:\\d{{2}})\\b', 0), '')) AS c,
        list_filter(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1), lambda h: regexp_matches(h, '{esc(_PLATFORM)}'))[1] AS h,
        {first_sql('t', ['(?i)' + p for p in K.VIDEO_PATTERNS])} AS w FROM e2),
    e4 AS (SELECT *, coalesce(s1, s2) AS s, CASE WHEN {minute} < 60 AND (CASE WHEN {half} <> '' THEN {hour} BETWEEN 1 AND 12 ELSE {hour} < 24 END)
        THEN (CASE {half} WHEN 'PM' THEN {hour} % 12 + 12 WHEN 'AM' THEN {hour} % 12 ELSE {hour} END) * 60 + {minute} END AS clock FROM e3),
    resolved AS (SELECT page_id, CASE WHEN strftime(s, '%H%M%S') <> '000000' OR clock IS NULL THEN s ELSE s + to_minutes(clock) END AS start_date, end_date,
        CASE WHEN known THEN regexp_matches(place, 'virtual|online') ELSE {any_word('t', K.ONLINE_WORDS)} END AS online,
        CASE WHEN known THEN NOT regexp_matches(place, 'virtual|online') ELSE {any_word('t', K.IN_PERSON_WORDS)} END AS person,
        coalesce(CASE WHEN h LIKE 'http%' THEN h ELSE 'https://' || h END, CASE WHEN w LIKE 'http%' THEN w ELSE 'https://' || w END) AS video FROM e4)"""


@query("event_start_resolution", "rich", sql=f"WITH {event_dates_sql('rich')} SELECT page_id, start_date, end_date FROM resolved")
def _(t):
    from meadowlark.operators.events import resolve_event_dates
    return resolve_event_dates(t.rich).select("page_id", "start_date", "end_date")


@query("online_status", "note", sql=f"SELECT id, {any_word('text', K.ONLINE_WORDS)} AS is_online, {any_word('text', K.IN_PERSON_WORDS)} AS is_in_person FROM note")
def _(t):
    return t.note.select("id", X.is_online("text").alias("is_online"), X.is_in_person("text").alias("is_in_person"))


@query("video_link", "rich", sql=f"""
    WITH v AS (SELECT page_id, list_filter(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1), lambda h: regexp_matches(h, '{esc(_PLATFORM)}'))[1] AS h,
        {first_sql(simple_text('html'), ['(?i)' + p for p in K.VIDEO_PATTERNS])} AS w FROM rich)
    SELECT page_id, coalesce(CASE WHEN h LIKE 'http%' THEN h ELSE 'https://' || h END, CASE WHEN w LIKE 'http%' THEN w ELSE 'https://' || w END, '') AS video FROM v""")
def _(t):
    return t.rich.withColumn("text", X.text_simple("html")).select("page_id", X.video_link("html", "text").alias("video"))


@query("registration_link", "rich", sql=f"""
    WITH {_LINKS}, r AS (SELECT page_id, pos, {_RESOLVED} AS full_url FROM links WHERE NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:|data:)')),
    f AS (SELECT page_id, arg_min(full_url, pos) AS link FROM r WHERE regexp_matches(full_url, '{K.BLOCK_REGISTER}') GROUP BY page_id)
    SELECT p.page_id, f.link FROM rich p LEFT JOIN f ON p.page_id = f.page_id""")
def _(t):
    return t.rich.select("page_id", X.registration_link("html", "url").alias("link"))


@query("page_urls", "note", sql=f"""
    SELECT id, array_to_string(regexp_extract_all(text, '{esc(K.PAGE_URL)}'), ' ') AS urls FROM note""")
def _(t):
    return t.note.select("id", F.array_join(X.page_urls("text"), " ").alias("urls"))


@query("social_handles", "note", sql=f"""
    SELECT id, array_to_string(list_sort(list_distinct(list_concat({', '.join(f"regexp_extract_all(text, '{p}', 1)" for p in K.SOCIAL_HANDLES)}))), ' ') AS handles FROM note""")
def _(t):
    return t.note.select("id", F.array_join(F.array_sort(X.social_handles("text")), " ").alias("handles"))


# --- documents of the web ----------------------------------------------------------------------

@query("robots_sitemaps", "page", sql="""
    WITH b AS (SELECT url, 'User-agent: *' || chr(10) || 'sitemap: ' || url || '/a.xml' || chr(10) || 'Sitemap:  https://cdn.example/' || page_id AS body FROM page),
    s AS (SELECT url, regexp_extract_all(body, '(?i)Sitemap:\\s*(\\S+)', 1) AS l FROM b)
    SELECT url, unnest(range(len(l))) AS pos, unnest(l) AS sitemap_url FROM s""")
def _(t):
    body = F.concat(F.lit("User-agent: *\nsitemap: "), F.col("url"), F.lit("/a.xml\nSitemap:  https://cdn.example/"), F.col("page_id").cast("string"))
    return web.robots_sitemaps(t.page.select("url", body.alias("body"))).withColumn("pos", F.col("pos").cast("long"))


def sitemap_docs(t):
    """Sitemaps of at most twenty neighbouring pages each, and for every one an index that leads to it."""
    p = t.page.withColumn("site", urls.origin("url")).withColumn("part", F.expr("page_id div 20").cast("string"))
    leaf = p.groupBy("site", "part").agg(F.array_sort(F.collect_list("url")).alias("l"))
    locs = F.array_join(F.transform("l", lambda u: F.concat(F.lit("<url><loc>"), T.html_escape(u), F.lit("</loc></url>"))), "")
    at = F.concat("site", F.lit("/s"), "part", F.lit(".xml"))
    leaves = leaf.select(at.alias("url"), F.concat(F.lit("<urlset>"), locs, F.lit("</urlset>")).alias("body"))
    index = leaf.select(F.concat("site", F.lit("/i"), "part", F.lit(".xml")).alias("url"),
                        F.concat(F.lit("<sitemapindex><sitemap><loc>"), at, F.lit("</loc></sitemap></sitemapindex>")).alias("body"))
    return leaves.unionByName(index)


@query("sitemap_urls", "page", sql="""
    WITH p AS (SELECT regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, page_id // 20 AS part,
            replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS u FROM page),
    e AS (SELECT site || '/s' || part || '.xml' AS url, u FROM p UNION ALL SELECT site || '/i' || part || '.xml', u FROM p)
    SELECT url, row_number() OVER (PARTITION BY url ORDER BY u) - 1 AS pos, u AS page_url FROM e""")
def _(t):
    return web.sitemap_urls(sitemap_docs(t)).withColumn("pos", F.col("pos").cast("long"))


def api_payloads(t):
    """REST payload arrays made of the organizations of a country."""
    item = F.struct(
        F.struct(F.concat(F.lit("<b>"), F.col("name"), F.lit("</b>")).alias("rendered")).alias("title"),
        F.struct(F.concat(F.lit("<p>"), F.coalesce("description", F.lit("")), F.lit("</p>")).alias("rendered")).alias("content"),
        F.col("website").alias("link"),
        F.struct(F.when(F.col("id") % 2 == 0, F.col("latitude").cast("string")).otherwise("0").alias("latitude"),
                 F.col("longitude").cast("string").alias("longitude")).alias("meta"),
        F.struct(F.lit("12.5").alias("latitude"), F.lit("x").alias("longitude")).alias("acf"))
    return t.org.select(F.col("id").alias("payload_id"), F.to_json(F.array(item)).alias("body"))


@query("api_items", "org", sql="""
    SELECT id AS payload_id, name, trim(coalesce(description, '')) AS description, coalesce(website, '') AS website,
        CASE WHEN id % 2 = 0 AND latitude <> 0 THEN latitude ELSE 12.5 END AS latitude, nullif(longitude, 0) AS longitude FROM org""")
def _(t):
    return web.api_items(api_payloads(t))
