"""Composite plans and streams on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bindings.registry import query
from bindings.relational import NOW, words
from bindings.searching import BASE, ICALENDAR_SQL, POPUP_SQL, calendar_entries, ref, ref_sql
from bindings.texts import (
    DESCRIBED_SQL, GEO_SQL, H1_SQL, META_SQL, OWN_SITE_SQL, TITLE_SQL, _clean_sql, _commit_sql, _skills_sql, any_word, booking_fine_sql, count_words, described_sql,
    event_blocks_sql, event_dates_sql, esc, found_links_sql, full_text, job_blocks_sql, job_title_sql, lines_text, price_sql, simple_text, squeezed,
    stay_types_sql, title_blocks_sql, trimmed,
)
from meadowlark import constants as K
from meadowlark import schemas
from meadowlark.functions import urls
from meadowlark.operators import mutations as H
from meadowlark.operators import search as S
from meadowlark.operators import privacy
from meadowlark.operators.aggregates import vector_range
from meadowlark.plans import catalogue, listings
from meadowlark.scale import list_pages
from meadowlark.session import ensure_checkpoint_dir
from meadowlark.sinks import files
from meadowlark.sources import tables
from meadowlark.streaming import ingest


def site_org(t):
    """One organization per site of the pages."""
    sites = t.spage.groupBy(urls.origin("url").alias("website")).agg(F.min("page_id").alias("id"))
    named = sites.select("id", F.concat(F.lit("Site "), urls.host("website")).alias("name"), "website")
    return H.evolve_schema(named, schemas.ORGANIZATIONS)


def site_children(t, schema):
    """One old child row per page, owned by the page's site, pointing at the page."""
    org = site_org(t).select(F.col("id").alias("organization_id"), "website")
    rows = t.spage.withColumn("website", urls.origin("url")).join(org, "website").select(
        F.col("page_id").alias("id"), "organization_id", F.concat(F.lit("Old "), F.col("page_id").cast("string")).alias("title"),
        F.lit("old text").alias("description"), F.col("url").alias("source_url"), F.col("url").alias("booking_url"), F.col("url").alias("event_url"))
    known = [f.name for f in schema.fields]
    return H.evolve_schema(rows.select(*[c for c in rows.columns if c in known]), schema)


def _scratch(t):
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark)}/files-{uuid.uuid4().hex}"


@query("map_features", "org", sql=f"""
    WITH p AS ({POPUP_SQL}) SELECT o.id, o.name, p.popup FROM org o JOIN p ON o.id = p.id
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND source = 'BUILDING' AND has_jobs = true""")
def _(t):
    f = catalogue.map_features(t.org, BASE, source="BUILDING", has_jobs=True)
    return f.select("id", F.get_json_object("feature", "$.properties.name").alias("name"), F.get_json_object("feature", "$.properties.popup").alias("popup"))


@query("discover_jobs_stays", "spage", sql=f"""
    WITH o AS (SELECT min(page_id) AS oid, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site, 'Site ' || split_part(split_part(url, '/', 3), ':', 1) AS name FROM spage GROUP BY 2, 3),
    owned AS (SELECT page_id, oid FROM spage JOIN o ON site = split_part(url, '/', 1) || '//' || split_part(url, '/', 3)),
    jp AS (SELECT unnest([{words(K.JOB_PATHS)}]) AS path, unnest(range({len(K.JOB_PATHS)})) AS path_pos),
    sp AS (SELECT unnest([{words(K.STAY_PATHS)}]) AS path, unnest(range({len(K.STAY_PATHS)})) AS path_pos),
    jf AS (SELECT oid, name, p.page_id, html FROM o, jp JOIN spage p ON p.url = o.site || '/' || jp.path
        WHERE length(html) > 500 AND {any_word('html', K.JOB_PAGE_KEYWORDS)} QUALIFY row_number() OVER (PARTITION BY oid ORDER BY path_pos, p.page_id) = 1),
    p AS (SELECT page_id, name, {full_text('html', K.SKIP_TAGS_SIMPLE)} AS text FROM jf), {job_blocks_sql('p', 'name', K.JOB_FIRST_TERMS, 120)},
    nj AS (SELECT oid, title, role FROM blocks JOIN jf ON blocks.page_id = jf.page_id),
    sf AS (SELECT oid, name, p.page_id, html, {full_text('html', K.SKIP_TAGS_SIMPLE)} AS text FROM o, sp JOIN spage p ON p.url = o.site || '/' || sp.path
        WHERE length(html) > 500 AND {any_word('html', K.STAY_PAGE_KEYWORDS)} QUALIFY row_number() OVER (PARTITION BY oid ORDER BY path_pos, p.page_id) = 1),
    sb AS (SELECT oid, name, regexp_matches(lower(html), '<form\\b') AS form, regexp_matches(lower(html), '<iframe\\b') AS frame, regexp_matches(html, '{K.EMAIL}') AS mail,
        regexp_matches(html, '{esc(K.PHONE)}') AS phone, {any_word('html', K.BOOKING_CALENDARS)} AS cal, {count_words('text', K.BOOKING_KEYWORDS)} AS kw,
        len(list_filter(regexp_extract_all(lower(html), 'href=["'']([^"'']+)["'']', 1), lambda h: regexp_matches(h, '{'|'.join(w.replace('.', chr(92) + '.') for w in K.BOOKING_HOSTS)}'))) AS ext FROM sf),
    ns AS (SELECT oid, 'Stay at ' || name AS title, CASE WHEN form AND kw >= 2 THEN 'direct_form' WHEN frame OR ext > 0 THEN 'external_widget' WHEN cal THEN 'calendar_tool'
        WHEN (mail OR phone) AND kw >= 1 THEN 'email_phone' ELSE 'unknown' END AS booking_type FROM sb)
    SELECT 'job' AS kind, oid AS organization_id, title, role AS detail FROM nj
    UNION ALL SELECT 'job', oid, 'Old ' || page_id, NULL FROM owned WHERE oid NOT IN (SELECT oid FROM nj)
    UNION ALL SELECT 'stay', oid, title, booking_type FROM ns UNION ALL SELECT 'stay', oid, 'Old ' || page_id, NULL FROM owned
    UNION ALL SELECT 'org', oid, name, CAST(oid IN (SELECT oid FROM nj) AS VARCHAR) || ',' || CAST(oid IN (SELECT oid FROM ns) AS VARCHAR) FROM o""")
def _(t):
    got = listings.discover_jobs_stays(site_org(t), t.spage, site_children(t, schemas.VOLUNTEER_OPPORTUNITIES), site_children(t, schemas.STAYS), NOW)
    jobs = got.jobs.select(F.lit("job").alias("kind"), "organization_id", "title", F.col("role").alias("detail"))
    stays = got.stays.select(F.lit("stay").alias("kind"), "organization_id", "title", F.col("booking_type").alias("detail"))
    orgs = got.organizations.select(F.lit("org").alias("kind"), F.col("id").alias("organization_id"), F.col("name").alias("title"),
                                    F.concat_ws(",", F.col("has_jobs").cast("string"), F.col("has_stays").cast("string")).alias("detail"))
    return jobs.unionByName(stays).unionByName(orgs)


_SITES_SQL = """o AS (SELECT min(page_id) AS oid, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site FROM spage GROUP BY 2)"""


def _first_page_sql(paths, terms, least, longer_than):
    """Of every site the page at the first path whose text speaks of the terms."""
    return f"""SELECT oid, p.page_id, url, html FROM o, (SELECT unnest([{words(paths)}]) AS path, unnest(range({len(paths)})) AS path_pos) x JOIN spage p ON p.url = o.site || '/' || x.path
        WHERE {count_words(simple_text('html'), terms)} >= {least} AND length({simple_text('html')}) > {longer_than}
        QUALIFY row_number() OVER (PARTITION BY oid ORDER BY path_pos, p.page_id) = 1"""


@query("board_listings", "spage", sql=f"""
    WITH {_SITES_SQL}, jf AS ({_first_page_sql(K.JOB_DETAIL_PATHS, K.JOB_BOARD_TERMS, 2, 200)}), sf AS ({_first_page_sql(K.STAY_PATHS, K.STAY_BOARD_TERMS, 2, 150)}),
    jt AS (SELECT oid, url, {lines_text('html', K.SKIP_TAGS_FRAME)} AS text FROM jf), {title_blocks_sql('(SELECT struct_pack(oid, url) AS page, text FROM jt)', 'page')}
    SELECT 'job' AS kind, page.oid AS organization_id, page.url AS url, b.title AS title, b.description AS description FROM titled
    UNION ALL SELECT 'stay', oid, url, split_part({full_text('html', K.SKIP_TAGS_SIMPLE)}, '. ', 1), {full_text('html', K.SKIP_TAGS_SIMPLE)} FROM sf""")
def _(t):
    org = site_org(t)
    jobs = listings.board_jobs(org, t.spage).select(F.lit("job").alias("kind"), "organization_id", "url", "title", "description")
    return jobs.unionByName(listings.board_stays(org, t.spage).select(F.lit("stay").alias("kind"), "organization_id", "url", "title", "description"))


def _event_url_sql(u):
    host = f"regexp_extract({u}, '^[A-Za-z]+://([^/?#:]*)', 1)"
    hosts = " OR ".join(f"lower({host}) = '{h}' OR ends_with(lower({host}), '.{h}')" for h in K.EVENT_BLOCKED_HOSTS)
    return f"NOT ({hosts}) AND NOT regexp_matches(lower(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '^({'|'.join(K.EVENT_BLOCKED_PATHS)})')"


def _dated_sql(c):
    layouts = ["%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%m/%d/%Y", "%d.%m.%Y"]
    return f"try_strptime({c}, [{', '.join(f"'{x}'" for x in layouts)}])"


@query("discover_events", "spage", sql=f"""
    WITH {_SITES_SQL}, ok AS (SELECT * FROM spage WHERE {_event_url_sql('url')}), {event_blocks_sql('ok')},
    path AS (SELECT unnest([{words(K.EVENT_PATHS)}]) AS path, unnest(range({len(K.EVENT_PATHS)})) AS ord),
    direct AS (SELECT oid, page_id, ord FROM o, path JOIN ok ON ok.url = o.site || '/' || path.path),
    e1 AS (SELECT oid, ord, ev.* FROM direct JOIN ev ON direct.page_id = ev.page_id
        QUALIFY row_number() OVER (PARTITION BY oid, lower({trimmed('title')}), CASE WHEN {trimmed('title')} = '' THEN struct_pack(ord, p := ev.page_id, pos) END ORDER BY ord, ev.page_id, pos) = 1),
    home AS (SELECT oid, ok.* FROM o JOIN ok ON rtrim(ok.url, '/') = o.site WHERE oid NOT IN (SELECT oid FROM e1)), {found_links_sql('home')},
    led AS (SELECT home.oid, ok.page_id, found.pos AS ord FROM home JOIN found ON home.page_id = found.page_id JOIN ok ON ok.url = found.href
        WHERE regexp_matches(lower(found.href), '{'|'.join(K.EVENT_LINK_WORDS)}') AND {_event_url_sql('found.href')}),
    e2 AS (SELECT oid, ord, ev.* FROM led JOIN ev ON led.page_id = ev.page_id
        QUALIFY row_number() OVER (PARTITION BY oid, lower({trimmed('title')}), CASE WHEN {trimmed('title')} = '' THEN struct_pack(ord, p := ev.page_id, pos) END ORDER BY ord, ev.page_id, pos) = 1)
    SELECT oid AS organization_id, title, description, {_dated_sql('start_raw')} AS start_date, is_online, event_url FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2)""")
def _(t):
    got = listings.discover_events(site_org(t), t.spage, NOW)
    return got.events.select("organization_id", "title", "description", "start_date", "is_online", "event_url")


@query("refine_jobs", "spage", sql=f"""
    WITH o AS (SELECT min(page_id) AS oid, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site, 'Site ' || split_part(split_part(url, '/', 3), ':', 1) AS name FROM spage GROUP BY 2, 3),
    path AS (SELECT unnest([{words(K.JOB_DETAIL_PATHS)}]) AS path, unnest(range({len(K.JOB_DETAIL_PATHS)})) AS path_pos),
    f AS (SELECT oid, name, p.page_id, html FROM o, path JOIN spage p ON p.url = o.site || '/' || path.path
        WHERE length(html) > 500 AND {any_word('html', K.JOB_PAGE_KEYWORDS)} QUALIFY row_number() OVER (PARTITION BY oid ORDER BY path_pos, p.page_id) = 1),
    p AS (SELECT page_id, name, {full_text('html')} AS text FROM f), {job_blocks_sql('p', 'name', K.JOB_TERMS)},
    n AS (SELECT oid AS organization_id, title, role, {_skills_sql('block')} AS skills_needed, {_commit_sql('block')} AS commitment,
        try_strptime(nullif(regexp_extract(block, '{esc(K.START_DATE)}', 1), ''), '%m/%d/%Y') AS start_date,
        coalesce(list_filter(regexp_extract_all(html, '{K.EMAIL}'), lambda e: NOT regexp_matches(lower(e), '^(info@|contact@|admin@|support@|office@|hello@|webmaster@)'))[1],
            regexp_extract_all(html, '{K.EMAIL}')[1]) AS application_email FROM blocks JOIN f ON blocks.page_id = f.page_id)
    SELECT * FROM n UNION ALL SELECT oid, 'Old ' || page_id, NULL, NULL, NULL, NULL, NULL FROM spage JOIN o ON site = split_part(url, '/', 1) || '//' || split_part(url, '/', 3)
        WHERE oid NOT IN (SELECT organization_id FROM n)""")
def _(t):
    return listings.refine_jobs(site_org(t), site_children(t, schemas.VOLUNTEER_OPPORTUNITIES), t.spage).select(
        "organization_id", "title", "role", "skills_needed", "commitment", "start_date", "application_email")


@query("refine_stays", "spage", sql=rf"""
    WITH o AS (SELECT min(page_id) AS oid, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site, 'Site ' || split_part(split_part(url, '/', 3), ':', 1) AS name FROM spage GROUP BY 2, 3),
    s AS (SELECT page_id AS id, url, (SELECT name FROM o WHERE site = split_part(url, '/', 1) || '//' || split_part(url, '/', 3)) AS name FROM spage),
    q AS (SELECT url, min(page_id) AS page_id FROM spage GROUP BY url),
    x AS (SELECT p.page_id, p.html, {full_text('p.html')} AS text FROM q JOIN spage p ON q.page_id = p.page_id),
    p AS (SELECT page_id, html, {_clean_sql('text')} AS t FROM x), {booking_fine_sql('p')},
    c AS (SELECT page_id, t, {trimmed("regexp_replace(" + trimmed("nullif(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), '')") + r", '\s*[|–—-]\s*.*$', '')")} AS cut FROM p)
    SELECT s.id, CASE WHEN length(cut) > 5 AND length(cut) < 100 THEN cut ELSE 'Stay at ' || s.name END AS title, {stay_types_sql('t')} AS stay_type, {price_sql('t')} AS price_info,
        booking_type, 1 AS rescraped FROM s JOIN q ON s.url = q.url JOIN c ON q.page_id = c.page_id JOIN booked ON booked.page_id = c.page_id""")
def _(t):
    return listings.refine_stays(site_children(t, schemas.STAYS), site_org(t), t.spage).stays.select(
        "id", "title", "stay_type", "price_info", "booking_type", "rescraped")


@query("refine_events", "spage", sql=f"""
    WITH q AS (SELECT url, min(page_id) AS page_id FROM spage GROUP BY url), x AS (SELECT p.page_id, html FROM q JOIN spage p ON q.page_id = p.page_id), {event_dates_sql('x')}
    SELECT s.page_id AS id, s.url AS event_url, CASE WHEN s.page_id % 3 = 0 THEN TIMESTAMP '2021-07-11' ELSE r.start_date END AS start_date, r.end_date, online AS is_online, person AS is_in_person,
        video AS registration_url FROM spage s JOIN q ON s.url = q.url JOIN resolved r ON q.page_id = r.page_id""")
def _(t):
    events = site_children(t, schemas.EVENTS).withColumn("start_raw", F.when(F.col("id") % 3 == 0, "July 11, 2021")).withColumn(
        "end_raw", F.lit(None).cast("string"))
    return listings.refine_events(events, t.spage).select("id", "event_url", "start_date", "end_date", "is_online", "is_in_person", "registration_url")


@query("redescribe_jobs", "spage", sql=rf"""
    WITH o AS (SELECT min(page_id) AS oid, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site, 'Site ' || split_part(split_part(url, '/', 3), ':', 1) AS name FROM spage GROUP BY 2, 3),
    s AS (SELECT page_id AS id, url, (SELECT name FROM o WHERE site = split_part(url, '/', 1) || '//' || split_part(url, '/', 3)) AS name FROM spage),
    q AS (SELECT spage.url, min(page_id) AS page_id, any_value(name) AS name FROM spage JOIN s ON s.id = spage.page_id WHERE length(html) >= 200 GROUP BY 1),
    p AS (SELECT p.page_id, q.url, q.name, {full_text('html')} AS text, {TITLE_SQL} AS title, {H1_SQL} AS h1, {META_SQL} AS m FROM q JOIN spage p ON q.page_id = p.page_id),
    r AS (SELECT page_id, url, name, text, title, h1, CASE WHEN length(m) > 30 THEN m END AS meta FROM p), {described_sql('r', 'name')},
    t AS (SELECT page_id, url, coalesce({job_title_sql('h1', 'title', 'name')}, 'Volunteer at ' || name) AS title FROM r WHERE length(text) >= 50 OR meta IS NOT NULL)
    SELECT s.id, CASE WHEN length(t.title) > 5 THEN t.title ELSE 'Old ' || s.id END AS title, CASE WHEN length(d.description) > 50 THEN d.description ELSE 'old text' END AS description
    FROM s LEFT JOIN t ON s.url = t.url LEFT JOIN described d ON t.page_id = d.page_id""")
def _(t):
    return listings.redescribe_jobs(site_children(t, schemas.VOLUNTEER_OPPORTUNITIES), site_org(t), t.spage).select("id", "title", "description")


@query("merge_directories", "rich", "org", sql=f"""
    WITH w AS ({OWN_SITE_SQL}), d AS ({DESCRIBED_SQL}), g AS ({GEO_SQL}),
    e AS (SELECT w.page_id AS record_id, 'Farm ' || w.page_id AS name, website, 'directory' AS source, latitude FROM w JOIN d ON w.page_id = d.page_id JOIN g ON w.page_id = g.page_id
        WHERE latitude IS NOT NULL OR website <> '' OR length(described) > 30
        UNION ALL SELECT id, name, coalesce(website, ''), 'api', CASE WHEN id % 2 = 0 AND latitude <> 0 THEN latitude ELSE 12.5 END FROM org),
    base AS (SELECT * FROM org WHERE has_jobs),
    f AS (SELECT * FROM e WHERE lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM base)
        AND rtrim(lower(trim(website)), '/') NOT IN (SELECT rtrim(lower(trim(website)), '/') FROM base WHERE website <> '')
        QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY record_id, source) = 1)
    SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY record_id, lower(name)) AS id, name, website, source, latitude FROM f""")
def _(t):
    from bindings.texts import api_payloads
    # every page's first off-site link leads to the page of that address
    targets = t.rich.select("page_id", F.col("url"), "html")
    listing = t.rich.select("page_id", "url", F.concat(F.lit('<a href="'), F.col("url"), F.lit('">Farm '), F.col("page_id").cast("string"), F.lit("</a>")).alias("html"))
    listed = catalogue.listing_records(listing, targets, "example", "directory", "Eco Village")
    payloads = api_payloads(t).withColumnRenamed("payload_id", "record_id")
    base = t.org.where("has_jobs")
    base = H.evolve_schema(base.select(*[c for c in base.columns if c in {f.name for f in schemas.ORGANIZATIONS.fields}]), schemas.ORGANIZATIONS)
    return catalogue.merge_directories(listed, payloads, base, "api").added.select("id", "name", "website", "source", "latitude")


FILL_SQL = f"""
    WITH {ref_sql('long', 'close')},
    o AS (SELECT id, lower(name) AS name FROM product),
    u1 AS (SELECT k, arg_max(url, pos) AS url FROM ref GROUP BY k), u2 AS (SELECT k, min(pos) AS pos, arg_min(url, pos) AS url FROM ref GROUP BY k),
    n AS (SELECT DISTINCT name FROM o),
    e AS (SELECT n.name, u1.url FROM n JOIN u1 ON n.name = u1.k),
    c AS (SELECT n.name, arg_min(url, pos) AS url FROM n JOIN u2 ON (contains(k, n.name) OR contains(n.name, k)) AND length(k) > 5 AND length(n.name) > 5
        WHERE n.name NOT IN (SELECT name FROM e) GROUP BY n.name),
    f AS (SELECT n.name, u2.url, pos, 1.0 - CAST(levenshtein(n.name, k) AS DOUBLE) / greatest(length(n.name), length(k), 1) AS score FROM n, u2
        WHERE n.name NOT IN (SELECT name FROM e) AND n.name NOT IN (SELECT name FROM c)),
    g AS (SELECT name, url FROM f WHERE score > 0.6 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, pos) = 1),
    m AS (SELECT * FROM e UNION ALL SELECT * FROM c UNION ALL SELECT * FROM g)
    SELECT p.id, CASE WHEN p.brand <> 'Brand#1' THEN 'http://has.example' ELSE m.url END AS website FROM product p LEFT JOIN m ON lower(p.name) = m.name"""


@query("fill_websites", "product", sql=FILL_SQL)
def _(t):
    org = t.product.select("id", "name", "brand", F.when(F.col("brand") != "Brand#1", "http://has.example").alias("website"), F.col("brand").alias("source"))
    return catalogue.fill_websites(org, ref(t, "long", "close"), "Brand#1").select("id", "website")


@query("enrich_descriptions", "spage", "ledger", sql=f"""
    WITH o AS (SELECT min(page_id) AS id, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site, 'Site ' || split_part(split_part(url, '/', 3), ':', 1) AS name FROM spage GROUP BY 2, 3),
    t AS (SELECT *, name || ' is an intentional community' AS old FROM o WHERE id NOT IN (SELECT id FROM ledger)),
    u AS (SELECT DISTINCT split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site, url FROM spage),
    l AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) AS pos FROM u),
    k AS (SELECT rtrim(url, '/') AS key, min(page_id) AS page_id FROM spage GROUP BY 1),
    y AS (SELECT key, {full_text('html', K.SKIP_TAGS_FRAME)} AS text FROM k JOIN spage ON k.page_id = spage.page_id),
    x AS (SELECT key, {squeezed("regexp_replace(" + squeezed('text') + ", 'https?://" + chr(92) + "S+', '', 'g')")} AS text
        FROM y WHERE length(text) > 80 AND NOT {any_word('text', K.LOW_QUALITY_PHRASES)}),
    m AS (SELECT t.id, pos, text FROM t JOIN l ON t.site = l.site JOIN x ON rtrim(l.url, '/') = x.key WHERE text <> ''),
    b AS (SELECT * FROM m UNION ALL SELECT t.id, 0, text FROM t JOIN x ON rtrim(t.site, '/') = x.key WHERE text <> '' AND t.id NOT IN (SELECT id FROM m)),
    r AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY pos, text) - 1 AS rn FROM b),
    f AS (SELECT id, arg_min(text, rn) AS first, sum(length(text) + 1) - 1 AS n, count(*) AS texts FROM r GROUP BY id),
    p AS (SELECT id, rn // 3 AS part, string_agg(text, ' ' ORDER BY rn) AS whole FROM r GROUP BY 1, 2)
    SELECT p.id, part, (texts + 2) // 3 AS n_parts, CASE WHEN part = 0 AND NOT starts_with(lower(first), lower(name)) THEN name || '. ' || whole ELSE whole END AS description
    FROM p JOIN f ON p.id = f.id JOIN t ON t.id = p.id WHERE n >= 120""")
def _(t):
    org = site_org(t).withColumn("description", F.concat("name", F.lit(" is an intentional community")))
    listed = t.spage.select(urls.origin("url").alias("o"), "url").distinct()
    # of every site an index and sitemaps of twenty pages each
    leaf = list_pages(listed, ["o"], [F.col("url")], F.col("url"), 20).withColumn("at", F.concat("o", F.lit("/map"), F.col("page").cast("string"), F.lit(".xml")))
    locs = F.array_join(F.transform("items", lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))), "")
    index = leaf.groupBy("o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "at"))), lambda x: F.concat(
        F.lit("<sitemap><loc>"), x["at"], F.lit("</loc></sitemap>"))), "").alias("l"))
    docs = leaf.select(F.col("at").alias("url"), F.concat(F.lit("<urlset>"), locs, F.lit("</urlset>")).alias("body")).unionByName(
        index.select(F.concat("o", F.lit("/map.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), "l", F.lit("</sitemapindex>")).alias("body"))).unionByName(
        index.select(F.concat("o", F.lit("/robots.txt")).alias("url"), F.concat(F.lit("Sitemap: "), "o", F.lit("/map.xml")).alias("body")))
    made = catalogue.enrich_descriptions(org, t.spage, docs, t.ledger, "is an intentional community", part_pages=3)
    return made.select("id", F.col("part").cast("long").alias("part"), F.col("n_parts").cast("long").alias("n_parts"), "description")


@query("clean_catalogue", "org", sql="""
    WITH k AS (SELECT id, description, nullif(directory_url, '') AS directory_url, coalesce(nullif(website, ''), nullif(direct_website, ''), nullif(directory_url, '')) AS website FROM org
        WHERE NOT (name LIKE 'Customer#0000001%' AND coalesce(website, '') = '') AND trim(name) <> ''),
    r AS (SELECT id, CASE WHEN trim(website) LIKE 'http%' AND website <> 'http://dir.example/7' THEN trim(website) END AS website, directory_url FROM k),
    w AS (SELECT min(id) AS id, directory_url AS url FROM r WHERE coalesce(website, '') = '' AND directory_url <> ''
        AND directory_url NOT IN (SELECT website FROM r WHERE website <> '') GROUP BY directory_url)
    SELECT r.id, coalesce(w.url, r.website) AS website FROM r LEFT JOIN w ON r.id = w.id""")
def _(t):
    return catalogue.clean_catalogue(t.org, "Customer#0000001", ["http://dir.example/7"]).organizations.select("id", "website")


@query("repair_descriptions", "org", sql="""
    WITH f AS (SELECT name, id AS pos, '<p>Map text of ' || name || '</p>' AS popup FROM org WHERE has_jobs)
    SELECT o.id, CASE WHEN (o.description IS NULL OR o.description = '') AND f.name IS NOT NULL THEN 'Map text of ' || f.name ELSE o.description END AS description,
        coalesce(f.popup, o.popup_html) AS popup_html FROM org o LEFT JOIN f ON o.name = f.name""")
def _(t):
    mapped = F.when(F.col("has_jobs"), F.concat(F.lit("<p>Map text of "), "name", F.lit("</p>")))
    features = t.org.select("name", F.col("id").alias("pos"), mapped.alias("popup")).where(F.col("popup").isNotNull())
    return catalogue.repair_descriptions(t.org, features).select("id", "description", "popup_html")


@query("build_vector_index", "org", sql="""
    WITH r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM org WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
    SELECT id, pos, pos // 500 AS chunk, 88 AS n FROM r""")
def _(t):
    index = catalogue.build_vector_index(t.org, S.hashed_words(64), chunk=500)
    return index.chunks.select("id", "pos", "chunk", F.length("e").alias("n"))


@query("publish", "org", "evt", sql="""
    SELECT 'organizations' AS table_name, id, 'INSERT INTO organizations (id, name) VALUES (' || id || ', ''' || replace(name, '''', '''''') || ''') ON CONFLICT(id) DO UPDATE SET name=excluded.name;' AS statement FROM org
    UNION ALL SELECT 'events', id, 'INSERT INTO events (id, organization_id, title, is_online) VALUES (' || id || ', ' || organization_id || ', ''' || title || ''', ' || CAST(is_online AS INTEGER) || ');' FROM evt""")
def _(t):
    return catalogue.publish({"organizations": t.org.select("id", "name"), "events": t.evt.select("id", "organization_id", "title", "is_online")})


@query("search_view", "org", sql="""
    WITH k AS (SELECT id, balance AS score FROM org WHERE balance > 0), r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS total FROM k)
    SELECT o.id, r.rank, CAST(floor(5 + 94 * (1 - CAST(rank - 1 AS DOUBLE) / (total - 1)) + 0.5) AS INTEGER) AS pct FROM org o JOIN r ON o.id = r.id WHERE o.has_jobs AND o.has_events""")
def _(t):
    results = t.org.where(F.col("balance") > 0).select("id", F.col("balance").alias("score"), F.lit(0).alias("rank"))
    return catalogue.search_view(results, t.org, jobs=True, events=True).rows.select("id", "rank", "pct")


# --- files written and read back ---------------------------------------------------------------

@query("read_json_array", "product", sql="SELECT id, name, size FROM product")
def _(t):
    base = _scratch(t)
    # JSON arrays of up to a hundred records: half of them a line of a file, half a whole file each
    arrays = t.product.groupBy(F.expr("id div 100").alias("b")).agg(F.to_json(F.collect_list(F.struct("id", "name", "size"))).alias("value"))
    arrays.where("b % 2 = 0").select("value").write.text(f"{base}/lines")
    arrays.where("b % 2 = 1").repartition("b").write.partitionBy("b").text(f"{base}/files")
    record = StructType.fromDDL("id bigint, name string, size int")
    lines = tables.read_json(t.spark, f"{base}/lines", record, one_per_line=True)
    return lines.unionByName(tables.read_json(t.spark, f"{base}/files", record).select("id", "name", "size"))


@query("read_geojson", "org", sql="SELECT id, name, coalesce(country, '') AS country, latitude, longitude, has_jobs AS \"hasJobs\" FROM org WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    base = _scratch(t)
    # even ids as FeatureCollections, odd ones as a feature per line
    files.write_feature_collections(t.org.where("id % 2 = 0"), BASE, f"{base}/map", 100)
    files.write_geojson(t.org.where("id % 2 = 1"), BASE, f"{base}/lines")
    columns = ["id", "name", "country", "latitude", "longitude", "hasJobs"]
    return tables.read_geojson(t.spark, f"{base}/map").select(*columns).unionByName(tables.read_geojson_lines(t.spark, f"{base}/lines").select(*columns))


@query("read_vector_chunks", "vec", sql="""
    SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, CAST(len(embedding) AS INTEGER) AS dim, true AS close FROM vec""")
def _(t):
    base = _scratch(t)
    vec = t.vec.select("id", "embedding", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    # even ids through chunk documents, odd ones through chunk folders with a record per line
    files.write_chunk_files(vec, f"{base}/chunks", 64)
    files.write_vector_chunks(vec, f"{base}/lines", "given", 64)
    documents = tables.read_vector_chunks(t.spark, f"{base}/chunks").where("id % 2 = 0").select("id", "pos", F.col("embedding").alias("restored"))
    lines = tables.read_vector_lines(t.spark, f"{base}/lines/data").where("id % 2 = 1").select("id", "pos", F.col("embedding").alias("restored"))
    back = documents.unionByName(lines).crossJoin(F.broadcast(vector_range(vec)))  # one row
    far = F.array_max(F.zip_with(F.col("embedding").cast("array<double>"), F.col("restored"), lambda a, b: F.abs(a - b)))
    return back.join(t.vec, "id").select("id", "pos", F.size("restored").alias("dim"), (far <= (F.col("hi") - F.col("lo")) / 255).alias("close"))


@query("full_refresh", "product", sql="SELECT id, name FROM product WHERE size > 20")
def _(t):
    base = _scratch(t)
    H.refresh(t.product.select("id", "name"), f"{base}/table")
    H.refresh(t.product.where(F.col("size") > 20).select("id", "name"), f"{base}/table")
    return t.spark.read.parquet(f"{base}/table")


@query("export_subject_data", "evt", sql="SELECT id, title, start_date FROM evt WHERE organization_id = 7")
def _(t):
    base = _scratch(t)
    mine = t.evt.where(F.col("organization_id") == 7).select("id", "title", "start_date")
    privacy.export_csv(mine, f"{base}/csv", "start_date")
    return t.spark.read.options(**files.CLOCKS).csv(f"{base}/csv", header=True, schema="id bigint, title string, start_date timestamp_ntz")


@query("write_json", "evt", sql="SELECT id, title, start_date, description FROM evt")
def _(t):
    base = _scratch(t)
    files.write_table(t.evt.select("id", "title", "start_date", "description"), "json", f"{base}/json")
    return t.spark.read.options(**files.CLOCKS).json(f"{base}/json", schema="id bigint, title string, start_date timestamp_ntz, description string")


@query("write_csv", "evt", sql="SELECT id, title, start_date, description FROM evt")
def _(t):
    base = _scratch(t)
    files.write_table(t.evt.select("id", "title", "start_date", "description"), "csv", f"{base}/csv")
    return t.spark.read.options(**files.CLOCKS).option("escape", "\\").csv(
        f"{base}/csv", header=True, schema="id bigint, title string, start_date timestamp_ntz, description string")


# --- streams -----------------------------------------------------------------------------------

@query("calendar_stream", "evt", sql="""
    SELECT date_trunc('day', start_date) AS window_start, event_type, count(*) AS n FROM evt GROUP BY 1, 2
    HAVING date_trunc('day', start_date) + INTERVAL 1 DAY <= (SELECT max(start_date) FROM evt) - INTERVAL 1 DAY""")
def _(t):
    """The days that the watermark, a day behind the last event, has closed."""
    base = _scratch(t)
    t.evt.select("start_date", "event_type").write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema("start_date timestamp_ntz, event_type string").parquet(f"{base}/in")
    ingest.land_event_counts(stream, f"{base}/out", f"{base}/ckpt", "1 day", "1 day").awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


@query("write_icalendar", "evt", "org", sql=f"""
    WITH v AS ({ICALENDAR_SQL}), l AS (SELECT unnest(string_split(vevent, chr(13) || chr(10))) AS line FROM v
        UNION ALL SELECT unnest(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//Farms//Events//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'X-WR-CALNAME:Farms', 'X-WR-TIMEZONE:UTC', 'END:VCALENDAR']))
    SELECT line, count(*) AS n FROM l GROUP BY line""")
def _(t):
    base = _scratch(t)
    files.write_icalendar(calendar_entries(t), f"{base}/feed", "Farms")
    return t.spark.read.option("lineSep", "\r\n").text(f"{base}/feed").groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("write_sql", "org", sql="""
    SELECT 'DELETE FROM organizations;' AS statement UNION ALL
    SELECT 'INSERT INTO organizations (id, name, has_jobs) VALUES (' || id || ', ''' || replace(name, '''', '''''') || ''', ' || CAST(CAST(has_jobs AS INTEGER) AS VARCHAR) || ');' FROM org""")
def _(t):
    base = _scratch(t)
    files.write_sql(t.org.select("id", "name", "has_jobs"), "organizations", f"{base}/dump", "refresh")
    return t.spark.read.text(f"{base}/dump").select(F.col("value").alias("statement"))


@query("ingest_submissions", "org", sql="""
    WITH s AS (SELECT id, name, has_jobs, CASE WHEN coalesce(length(trim(description)), 0) < 20 THEN 'description' WHEN latitude IS NULL THEN 'coordinates' END AS reason FROM org)
    SELECT name, coalesce(reason, CASE WHEN has_jobs THEN 'duplicate_name' END, 'accepted') AS outcome FROM s""")
def _(t):
    base = _scratch(t)
    t.org.select(*[f.name for f in schemas.SUBMISSIONS.fields]).write.json(f"{base}/in")
    known = t.org.where("has_jobs")
    ingest.ingest_submissions(ingest.read_submissions(t.spark, f"{base}/in"), lambda: known, f"{base}/ok", f"{base}/no", f"{base}/ckpt", NOW).awaitTermination()
    ok = t.spark.read.parquet(f"{base}/ok").select("name", F.lit("accepted").alias("outcome"))
    return ok.unionByName(t.spark.read.parquet(f"{base}/no").select("name", F.col("reason").alias("outcome")))


@query("extract_pages_stream", "rich", sql=f"SELECT page_id, length({simple_text('html')}) AS n FROM rich")
def _(t):
    from meadowlark.functions.extract import text_simple
    base = _scratch(t)
    t.rich.write.parquet(f"{base}/in")
    ingest.extract_pages_stream(ingest.read_new_pages(t.spark, f"{base}/in"),
                                lambda p: p.select("page_id", F.length(text_simple("html")).cast("long").alias("n")), f"{base}/out", f"{base}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("page_id", "n")


