"""Scans, filters, joins, aggregates, ranking, sets, mutations and privacy on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindings.registry import query
from meadowlark import constants as K
from meadowlark import schemas
from meadowlark.functions import text as T
from meadowlark.operators import aggregates as A
from meadowlark.operators import filters as B
from meadowlark.operators import joins as C
from meadowlark.operators import mutations as H
from meadowlark.operators import privacy as L
from meadowlark.operators import ranking as E
from meadowlark.operators import sets as G
from meadowlark.session import ensure_checkpoint_dir
from meadowlark.sources import gazetteer as Z
from meadowlark.sources import tables as S

NOW = "2024-01-10 12:00:00"


def words(ws):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ws)


# --- sources -----------------------------------------------------------------------------

@query("scan_table", sql="SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    return S.read_table(t.spark, f"{t.sf_dir}/customer.parquet", cols=["c_custkey", "c_name", "c_acctbal"])


@query("read_pages", sql="SELECT page_id, url, length(html) AS html_length FROM pages")
def _(t):
    return S.read_pages(t.spark, f"{t.sf_dir}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("html_length"))


@query("evolve_schema", sql="SELECT event_id AS id, event_type, CAST(NULL AS VARCHAR) AS title, "
                            "CAST(NULL AS BOOLEAN) AS is_online FROM events")
def _(t):
    base = t.raw("events").select(F.col("event_id").alias("id"), "event_type")
    return H.evolve_schema(base, schemas.EVENTS).select("id", "event_type", "title", "is_online")


PATHS = ["jobs", "events", "about/volunteer"]


@query("candidate_urls", "org", sql=f"""
    SELECT id, p.pos - 1 AS path_pos, rtrim(CASE WHEN trim(website) LIKE 'http%' THEN trim(website)
        ELSE 'https://' || trim(website) END, '/') || '/' || p.path AS candidate_url
    FROM org, (SELECT unnest([{words(PATHS)}]) AS path, unnest([1, 2, 3]) AS pos) p
    WHERE website <> ''""")
def _(t):
    sites = t.org.where(~T.is_blank("website")).select("id", "website")
    return C.candidate_urls(sites, PATHS).select("id", "path_pos", "candidate_url")


_CODES = [code for _, code, _ in K.COUNTRIES]
_CONTINENTS = [continent for continent, _, _ in K.COUNTRIES]
_VALUES = [(continent, code, name) for continent, code, names in K.COUNTRIES for name in (code.lower(), *names)]


def in_the_world(t):
    """Organizations in a country of the built-in table, by their id."""
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("id") % len(_CODES) + 1).cast("int"))
    return t.org.select("id", code.alias("country"))


@query("lookup_literals", "place", sql=f"""
    WITH v AS (SELECT unnest([{words([v[0] for v in _VALUES])}]) AS continent, unnest([{words([v[1] for v in _VALUES])}]) AS code, unnest([{words([v[2] for v in _VALUES])}]) AS name)
    SELECT name AS place, code AS resolved, false AS is_continent, code AS allowed FROM v WHERE name <> 'antarctica'
    UNION SELECT lower(continent), continent, true, upper(name) FROM v UNION SELECT lower(continent), continent, true, upper(continent) FROM v
    UNION SELECT lower(name) AS place, code AS resolved, false AS is_continent, upper(code) AS allowed FROM place
    UNION SELECT lower(continent), continent, true, upper(name) FROM place""")
def _(t):
    return Z.gazetteer(t.spark, t.place).drop("short")


# --- filters -----------------------------------------------------------------------------

@query("project_features", "org", sql="""
    SELECT id, name, latitude, longitude, coalesce(description, '') AS description, coalesce(source, '') AS source,
        coalesce(country, '') AS country, coalesce(city, '') AS city, coalesce(region, '') AS region,
        coalesce(address, '') AS address, coalesce(postal_code, '') AS "postalCode", coalesce(website, '') AS website,
        coalesce(email, '') AS email, coalesce(phone, '') AS phone, coalesce(organization_type, '') AS "organizationType",
        coalesce(accepts_volunteers, false) AS "acceptsVolunteers", accepts_visitors AS "acceptsVisitors",
        accepts_shortterm AS "acceptsShortterm", accepts_longterm AS "acceptsLongterm", has_jobs AS "hasJobs",
        has_stays AS "hasStays", has_events AS "hasEvents" FROM org""")
def _(t):
    return B.project_features(t.org)


@query("geo_not_null", "org", sql="SELECT id, latitude, longitude FROM org WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def _(t):
    return B.has_geo(t.org).select("id", "latitude", "longitude")


@query("flag_filters", "org", sql="""
    SELECT id, source FROM org WHERE source = 'BUILDING' AND accepts_volunteers = true AND has_stays = false""")
def _(t):
    return B.filter_flags(t.org, source="BUILDING", accepts_volunteers=True, has_stays=False).select("id", "source")


@query("text_search", "org", sql="SELECT id, name FROM org WHERE name ILIKE '%7_1%' OR description ILIKE '%7_1%' OR country ILIKE '%7_1%'")
def _(t):
    return B.text_search(t.org, "7_1", ["name", "description", "country"]).select("id", "name")


@query("event_format", "evt", sql="SELECT id, 'remote' AS fmt FROM evt WHERE is_online UNION ALL SELECT id, 'in_person' FROM evt WHERE is_in_person")
def _(t):
    parts = [B.event_format(t.evt, f).select("id", F.lit(f).alias("fmt")) for f in ("remote", "in_person")]
    return parts[0].unionByName(parts[1])


@query("upcoming", "evt", sql=f"SELECT id, start_date FROM evt WHERE start_date >= TIMESTAMP '{NOW}'")
def _(t):
    return B.upcoming(t.evt, NOW).select("id", "start_date")


@query("period_filter", "job", sql="""
    SELECT id, start_date, 'month' AS span FROM job WHERE start_date >= TIMESTAMP '1997-12-01' AND start_date < TIMESTAMP '1998-01-01'
    UNION ALL SELECT id, start_date, 'year' FROM job WHERE start_date >= TIMESTAMP '1999-01-01' AND start_date < TIMESTAMP '2000-01-01'""")
def _(t):
    a = B.in_period(t.job, 1997, 12).select("id", "start_date", F.lit("month").alias("span"))
    return a.unionByName(B.in_period(t.job, 1999).select("id", "start_date", F.lit("year").alias("span")))


@query("toggle_filters", "org", "evt", sql="""
    SELECT id FROM org WHERE has_jobs AND has_events AND id IN (SELECT organization_id FROM evt)""")
def _(t):
    base = t.evt.select(F.col("organization_id").alias("id"))
    return B.toggles(t.org, base, jobs=True, events=True).select("id")


@query("id_in", "org", "evt", sql="SELECT id, name FROM org WHERE id IN (SELECT organization_id FROM evt WHERE title = 'purchase')")
def _(t):
    return B.by_ids(t.org, t.evt.where(F.col("title") == "purchase").select("organization_id")).select("id", "name")


@query("by_id", "job", sql="SELECT id, title, role FROM job WHERE organization_id = 42")
def _(t):
    return B.children(t.job, 42).select("id", "title", "role")


@query("any_field_contains", "org", sql="""
    SELECT id FROM org WHERE contains(lower(name), '_1') OR contains(lower(country), '_1') OR contains(lower(description), '_1')""")
def _(t):
    return B.contains_any(t.org, " _1 ", ["name", "country", "description"]).select("id")


@query("drop_low_quality_rows", "org", sql="""
    SELECT id, name, website FROM org
    WHERE NOT (name LIKE 'Customer#0000001%' AND (website IS NULL OR website = '')) AND trim(name) <> ''""")
def _(t):
    return B.drop_low_quality(t.org, "Customer#0000001").select("id", "name", "website")


@query("pending_work", "org", sql="""
    SELECT id, website FROM org WHERE website IS NOT NULL AND website <> '' AND last_scrape_attempt IS NULL
        AND being_processed_since IS NULL ORDER BY id LIMIT 50 OFFSET 10""")
def _(t):
    return B.pending(t.org, "last_scrape_attempt", "being_processed_since", 50, 10).select("id", "website")


@query("needs_description", "org", sql="""
    SELECT id, description FROM org
    WHERE (description IS NULL OR description = '' OR description = name OR contains(description, 'furniture community'))
        AND (website <> '' OR direct_website <> '' OR directory_url <> '')""")
def _(t):
    return B.needs_description(t.org, ["furniture community"]).select("id", "description")


@query("url_blacklist", sql="""
    WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
        lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
    SELECT page_id, url FROM u WHERE NOT (host = 'example.net' OR host LIKE '%.example.net') AND NOT path LIKE '/fr/%'""")
def _(t):
    return B.allowed_urls(t.page, "url", ["example.net"], ["/fr/"]).select("page_id", "url")


_JT = "(?i)" + "|".join(f"(?:{p})" for p in K.JUNK_TITLES)
_JD = "(?i)" + "|".join(f"(?:{p})" for p in K.JUNK_DESCRIPTIONS)


@query("junk_events", "note", sql=f"""
    WITH e AS (SELECT id, trim(split_part(text, chr(10), 1)) AS title, trim(text) AS description FROM note)
    SELECT id, (title = '' AND description = '') OR regexp_matches(title, '{_JT}') OR regexp_matches(description, '{_JD}')
        OR (len(list_filter(string_split_regex(title, '\\s+'), lambda w: w <> '')) <= 2 AND length(description) < 50) AS junk FROM e""")
def _(t):
    from meadowlark.functions.extract import is_junk_event
    title = F.element_at(F.split("text", "\n", 2), 1)
    return t.note.select("id", is_junk_event(title, F.col("text"), F.lit(None)).alias("junk"))


@query("low_quality_text", "rich", sql=f"""
    SELECT page_id, list_bool_or([contains(lower(html), w) FOR w IN [{words(K.LOW_QUALITY_PHRASES)}]]) AS low_quality FROM rich""")
def _(t):
    from meadowlark.functions.extract import low_quality
    return t.rich.select("page_id", low_quality("html").alias("low_quality"))


_SUB = f"""
    WITH m AS (SELECT id, trim(name) AS n, trim(description) AS d, trim(country) AS c, latitude, longitude,
        len(list_filter([{words(K.SUBMISSION_KEYWORDS)}], lambda k:
            contains(lower(concat_ws(' ', trim(name), trim(description), coalesce(organization_type, ''))), k))) AS hits FROM org)
"""


@query("validate_submission", "org", sql=_SUB + """
    SELECT id, CASE WHEN coalesce(length(n), 0) < 2 THEN 'name' WHEN coalesce(length(d), 0) < 20 THEN 'description'
        WHEN coalesce(c, '') = '' THEN 'country' WHEN latitude IS NULL OR longitude IS NULL THEN 'coordinates'
        WHEN hits = 0 THEN 'keywords' END AS reason FROM m""")
def _(t):
    return B.validate(t.org).select("id", "reason")


@query("keyword_hits", "note", sql=f"""
    SELECT id, array_to_string(list_filter([{words(K.SUBMISSION_KEYWORDS)}], lambda k: contains(lower(text), k)), ',') AS hits FROM note""")
def _(t):
    return t.note.select("id", F.array_join(T.keyword_hits("text", K.SUBMISSION_KEYWORDS), ",").alias("hits"))


@query("location_filter", "org", sql=f"""
    WITH w AS (SELECT id, [{words(_CODES)}][id % {len(_CODES)} + 1] AS country, [{words(_CONTINENTS)}][id % {len(_CODES)} + 1] AS continent FROM org)
    SELECT id, country, 'world ' || continent AS kind FROM w WHERE continent IN ('Africa', 'Oceania', 'North America')
    UNION ALL SELECT id, country, 'senegal' FROM w WHERE country = 'SN'
    UNION ALL
    SELECT id, country, 'continent' AS kind FROM org WHERE region = 'EUROPE'
    UNION ALL SELECT id, country, 'country' FROM org WHERE country = 'NATION_7'
    UNION ALL SELECT id, country, 'unknown' FROM org WHERE country = 'ATLANTIS'""")
def _(t):
    g = Z.from_countries(t.place)
    parts = [B.filter_location(t.org, p, g).select("id", "country", F.lit(k).alias("kind"))
             for p, k in (("Europe", "continent"), ("nation_7", "country"), ("Atlantis", "unknown"))]
    world, built = in_the_world(t), Z.gazetteer(t.spark)
    parts += [B.filter_location(world, p, built).select("id", "country", F.lit(k).alias("kind")) for p, k in (
        ("Africa", "world Africa"), ("oceania", "world Oceania"), ("North America", "world North America"), ("Senegal", "senegal"))]
    return G.union_all(*parts)


@query("not_like", "org", sql="SELECT id, directory_url FROM org WHERE directory_url NOT LIKE '%example/1%'")
def _(t):
    return B.not_like(t.org, "directory_url", "%example/1%").select("id", "directory_url")


@query("stale_leases", "org", sql=f"SELECT id FROM org WHERE being_processed_since < TIMESTAMP '{NOW}' - INTERVAL 20 MINUTE")
def _(t):
    return B.stale(t.org, "being_processed_since", NOW, 20).select("id")


# --- joins -------------------------------------------------------------------------------

@query("jobs_detailed", "job", "org", sql="""
    SELECT j.id, j.title, j.role, o.id AS org_id, o.name AS org_name, o.country AS org_country FROM job j JOIN org o ON j.organization_id = o.id
    WHERE j.title ILIKE '%urg%' OR j.description ILIKE '%urg%' OR j.role ILIKE '%urg%' OR o.name ILIKE '%urg%' OR o.country ILIKE '%urg%'
    ORDER BY j.id LIMIT 100 OFFSET 20""")
def _(t):
    return C.jobs_detailed(t.job, t.org, "urg", 20, 100).select(
        "id", "title", "role", F.col("organization_id").alias("org_id"), "org_name", "org_country")


@query("stays_detailed", "stay", "host", sql="""
    SELECT s.id, s.line, s.title, s.stay_type, s.price, s.part, h.id AS org_id, h.name AS org_name, h.country AS org_country
    FROM stay s JOIN host h ON s.organization_id = h.id
    WHERE s.title ILIKE '%1%' OR s.description ILIKE '%1%' OR s.stay_type ILIKE '%1%' OR h.name ILIKE '%1%' OR h.country ILIKE '%1%'
    ORDER BY s.id, s.line, s.part, s.organization_id, s.price LIMIT 100""")
def _(t):
    return C.stays_detailed(t.stay, t.host, "1", order=("id", "line", "part", "organization_id", "price")).select(
        "id", "line", "title", "stay_type", "price", "part", F.col("organization_id").alias("org_id"), "org_name", "org_country")


EVENTS_SQL = """
    SELECT e.id, e.title, e.description, e.start_date, e.is_online, e.is_in_person, o.id AS org_id, o.name AS org_name,
        o.website AS org_website, o.country AS org_country, o.city AS org_city, o.latitude AS org_latitude, o.longitude AS org_longitude
    FROM evt e JOIN org o ON e.organization_id = o.id
    WHERE e.is_online AND e.start_date >= TIMESTAMP '2024-01-01' AND e.start_date < TIMESTAMP '2024-02-01'
        AND (e.title ILIKE '%c%' OR e.description ILIKE '%c%' OR o.name ILIKE '%c%' OR o.country ILIKE '%c%')
    ORDER BY e.start_date NULLS FIRST, e.id LIMIT 50 OFFSET 20"""


@query("events_detailed", "evt", "org", sql=EVENTS_SQL)
def events_page(t):
    return C.events_detailed(t.evt, t.org, "remote", "c", year=2024, month=1, skip=20, limit=50).select(
        "id", "title", "description", "start_date", "is_online", "is_in_person", F.col("organization_id").alias("org_id"),
        "org_name", "org_website", "org_country", "org_city", "org_latitude", "org_longitude")


@query("parent_with_children", "org", "job", "evt", sql="""
    WITH c AS (SELECT organization_id AS o, 'job' AS kind, id, title FROM job UNION ALL SELECT organization_id, 'stay', id, title FROM evt),
    r AS (SELECT *, (row_number() OVER (PARTITION BY o ORDER BY kind, id, title) - 1) // 10 AS page, count(*) OVER (PARTITION BY o) AS n FROM c)
    SELECT org.id, org.name, coalesce(r.page, 0) AS page, max(coalesce(n, 0)) AS n_children,
        coalesce(string_agg(CASE WHEN kind = 'job' THEN r.id || ':' || r.title END, ',' ORDER BY r.id, r.title), '') AS jobs,
        coalesce(string_agg(CASE WHEN kind = 'stay' THEN r.id || ':' || r.title END, ',' ORDER BY r.id, r.title), '') AS stays
    FROM org LEFT JOIN r ON org.id = r.o GROUP BY 1, 2, 3""")
def _(t):
    def shown(c):
        return F.array_join(F.transform(c, lambda x: F.concat(x["child_id"].cast("string"), F.lit(":"), x["title"])), ",").alias(c)
    return C.org_profile(t.org, t.job, t.evt, page_size=10).select("id", "name", "page", "n_children", shown("jobs"), shown("stays"))


@query("parents_having_child", "org", "job", sql="""
    SELECT DISTINCT o.id, o.name FROM org o JOIN job j ON j.organization_id = o.id
    WHERE o.website <> '' AND o.being_processed_since IS NULL AND coalesce(o.jobs_rescraped, 0) = 0""")
def _(t):
    return C.parents_pending(t.org, t.job, "jobs_rescraped", "being_processed_since").select("id", "name")


@query("child_work_items", "stay", "host", sql="""
    SELECT s.id, s.line, s.part, s.price, s.booking_url, h.name AS org_name, h.website AS org_website FROM stay s JOIN host h ON s.organization_id = h.id
    WHERE s.booking_url <> '' AND s.being_processed_since IS NULL AND coalesce(s.rescraped, 0) = 0""")
def _(t):
    return C.stay_work(t.stay, t.host).select("id", "line", "part", "price", "booking_url", "org_name", "org_website")


@query("resume_anti", "doc", "ledger", sql="SELECT id, lang FROM doc WHERE id NOT IN (SELECT id FROM ledger)")
def _(t):
    return C.remaining(t.doc, t.ledger).select("id", "lang")


@query("new_records", "org", sql="""
    WITH inc AS (SELECT c_custkey AS id, ' ' || upper(c_name) AS name, 'https://new' || (c_custkey % 800) || '.example.com/' AS website FROM customer
        UNION ALL SELECT c_custkey + 10000000, 'Fresh ' || (c_custkey // 3), 'HTTPS://site' || (c_custkey % 900) || '.example.com' FROM customer),
    f AS (SELECT *, lower(trim(name)) AS n FROM inc
        WHERE lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM org)
        AND rtrim(lower(trim(website)), '/') NOT IN (SELECT rtrim(lower(trim(website)), '/') FROM org WHERE website <> ''))
    SELECT id, name, website FROM f QUALIFY row_number() OVER (PARTITION BY n ORDER BY id) = 1""")
def _(t):
    c = t.raw("customer")
    a = c.selectExpr("c_custkey AS id", "concat(' ', upper(c_name)) AS name", "concat('https://new', c_custkey % 800, '.example.com/') AS website")
    b = c.selectExpr("c_custkey + 10000000 AS id", "concat('Fresh ', c_custkey div 3) AS name", "concat('HTTPS://site', c_custkey % 900, '.example.com') AS website")
    return C.new_records(a.unionByName(b), t.org, [F.col("id")]).select("id", "name", "website")


@query("duplicate_name_check", "org", sql="SELECT s_suppkey AS id, upper(replace(s_name, 'Supplier', 'Customer')) AS name FROM supplier "
                                          "WHERE lower(replace(s_name, 'Supplier', 'Customer')) IN (SELECT lower(name) FROM org)")
def _(t):
    sub = t.raw("supplier").selectExpr("s_suppkey AS id", "upper(replace(s_name, 'Supplier', 'Customer')) AS name")
    return C.name_conflicts(sub, t.org)


@query("lookup_by_name", "product", sql="""
    WITH ref AS (SELECT name, arg_max(brand, id) AS found FROM product GROUP BY name)
    SELECT p.id, p.name, r.found FROM product p LEFT JOIN ref r ON p.name = r.name""")
def _(t):
    return C.lookup_by_name(t.product, t.product, "brand", "id").select("id", "name", "found")


@query("propagate_by_url", "evt", sql="""
    WITH rep AS (SELECT event_url, min(id) AS first_id, min(title) AS first_title FROM evt WHERE event_url <> '' GROUP BY event_url)
    SELECT e.id, e.event_url, r.first_id, upper(r.first_title) AS found FROM evt e LEFT JOIN rep r ON e.event_url = r.event_url""")
def _(t):
    rep = A.representatives(t.evt, "event_url", ("id", "title"))
    results = rep.select("event_url", F.col("id").alias("first_id"), F.upper("title").alias("found"))
    return C.propagate(t.evt, results, "event_url").select("id", "event_url", "first_id", "found")


@query("first_matching_page", "spage", sql=f"""
    WITH site AS (SELECT DISTINCT split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS website FROM spage),
    path AS (SELECT unnest([{words(K.JOB_PATHS)}]) AS path, unnest(range({len(K.JOB_PATHS)})) AS path_pos)
    SELECT s.website, p.page_id, p.url, path_pos FROM site s, path JOIN spage p ON p.url = s.website || '/' || path.path
    WHERE length(p.html) > 500 AND list_bool_or([contains(lower(p.html), w) FOR w IN [{words(K.JOB_PAGE_KEYWORDS)}]])
    QUALIFY row_number() OVER (PARTITION BY s.website ORDER BY path_pos, page_id) = 1""")
def _(t):
    from meadowlark.functions.urls import origin
    sites = t.spage.select(origin("url").alias("website")).distinct()
    return C.discover_page(sites, t.spage, K.JOB_PATHS, C.page_passes("html", K.JOB_PAGE_KEYWORDS), key="website").select(
        "website", "page_id", "url", F.col("path_pos").cast("long").alias("path_pos"))


@query("nearby", "org", sql="""
    WITH d AS (SELECT id, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(10.0 - latitude) / 2), 2)
        + cos(radians(latitude)) * cos(radians(10.0)) * pow(sin(radians(20.0 - longitude) / 2), 2)))) AS distance_km FROM org)
    SELECT id, round(distance_km, 4) AS distance_km FROM d WHERE distance_km <= 2500 ORDER BY d.distance_km, id LIMIT 20""")
def _(t):
    return C.nearby(t.org, 10.0, 20.0, 2500, 20).select("id", F.round("distance_km", 4).alias("distance_km"))


@query("nearby_points", "org", "host", sql="""
    WITH d AS (SELECT h.id AS point_id, o.id, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(h.latitude - o.latitude) / 2), 2)
        + cos(radians(o.latitude)) * cos(radians(h.latitude)) * pow(sin(radians(h.longitude - o.longitude) / 2), 2)))) AS distance_km FROM org o, host h)
    SELECT point_id, id, round(distance_km, 4) AS distance_km FROM d WHERE distance_km <= 2500""")
def _(t):
    return C.nearby_points(t.org, t.host.withColumnRenamed("id", "point_id"), 2500).withColumn("distance_km", C.rounded("distance_km", 4))


# --- aggregates --------------------------------------------------------------------------

@query("count_all", "org", "job", sql="SELECT 'org' AS name, count(*) AS n FROM org UNION ALL SELECT 'job', count(*) FROM job")
def _(t):
    return A.totals(org=t.org, job=t.job)


@query("count_by", "org", sql="SELECT source, count(*) AS n FROM org GROUP BY source")
def _(t):
    return A.count_by(t.org, "source")


_FEATS = ", ".join(f"CAST(count_if({f}) AS BIGINT) AS {f}" for f in A.FEATURES)


@query("feature_counts", "org", sql=f"SELECT {_FEATS} FROM org")
def _(t):
    return A.feature_counts(t.org)


@query("statistics", "org", "job", sql=f"""
    WITH f AS (SELECT {_FEATS} FROM org)
    SELECT 'total_organizations' AS section, '' AS key, count(*) AS value FROM org
    UNION ALL SELECT 'total_opportunities', '', count(*) FROM job
    UNION ALL SELECT 'by_source', coalesce(source, 'null'), count(*) FROM org GROUP BY source
    UNION ALL SELECT 'by_country', coalesce(country, 'null'), count(*) FROM org GROUP BY country
    UNION ALL SELECT 'feature_counts', name, value FROM (UNPIVOT f ON {', '.join(A.FEATURES)} INTO NAME name VALUE value)""")
def _(t):
    return A.statistics(t.org, t.job)


@query("count_distinct", "evt", sql="SELECT count(DISTINCT organization_id) AS n FROM evt")
def _(t):
    return A.distinct_parents(t.evt)


@query("duplicates_having", "org", sql="SELECT website, count(DISTINCT id) AS n FROM org WHERE website <> '' GROUP BY website HAVING count(DISTINCT id) > 1")
def _(t):
    return A.duplicates(t.org, "website")


@query("representative_min", "evt", sql="SELECT event_url, min(id) AS id, min(title) AS title, min(description) AS description FROM evt "
                                        "WHERE event_url <> '' GROUP BY event_url")
def _(t):
    return A.representatives(t.evt, "event_url")


@query("min_max", "evt", sql="SELECT min(start_date) AS oldest, max(start_date) AS newest FROM evt")
def _(t):
    return A.min_max(t.evt, "start_date")


@query("vector_range", "vec", sql="SELECT CAST(min(list_min(embedding)) AS DOUBLE) AS lo, CAST(max(list_max(embedding)) AS DOUBLE) AS hi FROM vec")
def _(t):
    return A.vector_range(t.vec)


@query("group_to_list", "evt", sql="""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_url ORDER BY start_date, id) AS rn, count(*) OVER (PARTITION BY event_url) AS n FROM evt)
    SELECT event_url, (rn - 1) // 25 AS page, max(n) AS n_items, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS ids FROM r GROUP BY 1, 2""")
def _(t):
    pages = A.group_list(t.evt.select("id", "event_url", "start_date"), "event_url", [F.col("start_date"), F.col("id")], F.col("id").cast("string"), 25)
    return pages.select("event_url", "page", "n_items", F.array_join("items", ",").alias("ids"))


@query("value_counts", "doc", sql="SELECT lang, count(*) AS n FROM doc GROUP BY lang")
def _(t):
    return A.value_counts(t.doc, "lang")


_COV = ["description", "website", "email", "phone", "source"]


@query("coverage", "org", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} <> '') AS BIGINT) AS filled, count(*) - CAST(count_if({c} <> '') AS BIGINT) AS missing, "
    f"round(100.0 * CAST(count_if({c} <> '') AS BIGINT) / count(*), 1) AS percent FROM org" for c in _COV))
def _(t):
    return A.coverage(t.org, _COV)


@query("progress_counts", "org", "job", "stay", sql="""
    SELECT 'jobs_done' AS name, count(DISTINCT j.organization_id) AS n FROM job j JOIN org o ON j.organization_id = o.id WHERE o.jobs_rescraped = 1
    UNION ALL SELECT 'jobs_skills', CAST(count_if(skills_needed <> '') AS BIGINT) FROM job
    UNION ALL SELECT 'jobs_commitment', CAST(count_if(commitment <> '') AS BIGINT) FROM job
    UNION ALL SELECT 'jobs_email', CAST(count_if(application_email <> '') AS BIGINT) FROM job
    UNION ALL SELECT 'stays_priced', CAST(count_if(being_processed_since IS NULL AND price_info IS NOT NULL) AS BIGINT) FROM stay
    UNION ALL SELECT 'stays_typed', CAST(count_if(stay_type <> 'accommodation') AS BIGINT) FROM stay""")
def _(t):
    return A.progress(t.org, t.job, t.stay)


@query("merge_by_location", "org", sql="""
    WITH m AS (SELECT id, name, round(CAST(id % 300 AS DOUBLE) / 7, 4) AS lat, round(CAST(id % 100 AS DOUBLE) / 3, 4) AS lng, source,
        directory_url, city, CASE WHEN name LIKE '%5' THEN 1 ELSE 0 END AS g FROM org)
    SELECT arg_min(id, g * 1000000000 + id) AS id, arg_min(name, g * 1000000000 + id) AS name, lat, lng,
        coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources,
        coalesce(string_agg(DISTINCT directory_url, ',' ORDER BY directory_url), '') AS source_urls, coalesce(string_agg(DISTINCT city, ',' ORDER BY city), '') AS tags,
        count(DISTINCT id) AS n_merged FROM m GROUP BY lat, lng""")
def _(t):
    m = t.org.selectExpr("id", "name", "CAST(id % 300 AS DOUBLE) / 7 AS lat", "CAST(id % 100 AS DOUBLE) / 3 AS lng", "array_compact(array(source)) AS sources",
                         "array_compact(array(directory_url)) AS source_urls", "array_compact(array(city)) AS tags")
    merged = A.merge_by_location(m, F.col("name").endswith("5"))
    return merged.withColumns({c: F.array_join(c, ",") for c in ("sources", "source_urls", "tags")})


@query("distribution", "org", sql="SELECT country, count(*) AS n FROM org GROUP BY country ORDER BY n DESC, country LIMIT 20")
def _(t):
    return A.distribution(t.org, "country", 20)


@query("bounding_box", "org", sql="""
    SELECT min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east,
        (min(latitude) + max(latitude)) / 2 AS center_lat, (min(longitude) + max(longitude)) / 2 AS center_lon FROM org""")
def _(t):
    return A.bounds(t.org)


@query("surrogate_ids", "org", "host", sql="""
    SELECT (SELECT max(id) FROM org) + row_number() OVER (ORDER BY name) AS id, name, country FROM host""")
def _(t):
    return A.assign_ids(t.host.select("name", "country"), t.org, [F.col("name")])


@query("privacy_stats", "evt", sql=f"""
    SELECT count(*) AS total, min(start_date) AS oldest, max(start_date) AS newest,
        CAST(count_if(start_date < TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY) AS BIGINT) AS over_age FROM evt""")
def _(t):
    return A.retention_stats(t.evt, "2024-04-10 00:00:00", "start_date")


# --- ranking -----------------------------------------------------------------------------

@query("rank_results", "org", sql="SELECT id, balance, row_number() OVER (ORDER BY balance DESC, id) AS rank FROM org QUALIFY rank <= 200")
def _(t):
    return E.rank_results(t.org.select("id", "balance"), 200, "balance").withColumn("rank", F.col("rank").cast("long"))


@query("rank_percent", "org", sql="""
    WITH r AS (SELECT id, row_number() OVER (ORDER BY balance DESC, id) AS rank, count(*) OVER () AS total FROM org)
    SELECT id, rank, total, CAST(floor(5 + 94 * (1 - CAST(rank - 1 AS DOUBLE) / (total - 1)) + 0.5) AS INTEGER) AS pct FROM r""")
def _(t):
    return E.rank_percent(t.org.select("id", "balance"), [F.col("balance").desc(), F.col("id")]).select("id", "rank", "total", "pct")


@query("first_per_key", "doc", sql="""
    WITH k AS (SELECT id, text, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS key FROM doc)
    SELECT id FROM k WHERE key = '' UNION ALL
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key ORDER BY id) AS rn FROM k WHERE key <> '') WHERE rn = 1""")
def _(t):
    return E.dedupe_first(t.doc, "text", [F.col("id")]).select("id")


@query("top_n_per_day", "evt", sql="""
    WITH d AS (SELECT id, title, CAST(start_date AS DATE) AS day, start_date, row_number() OVER (PARTITION BY CAST(start_date AS DATE) ORDER BY start_date, id) AS slot,
        count(*) OVER (PARTITION BY CAST(start_date AS DATE)) AS n FROM evt WHERE start_date >= TIMESTAMP '2024-01-01' AND start_date < TIMESTAMP '2024-02-01')
    SELECT id, title, day, slot, greatest(n - 3, 0) AS more, CASE WHEN date_part('hour', start_date) = 0 AND date_part('minute', start_date) = 0
        AND floor(date_part('second', start_date)) = 0 THEN '' ELSE strftime(start_date, '%-I:%M %p') END AS clock FROM d WHERE slot <= 3""")
def _(t):
    return E.calendar_month(t.evt, 2024, 1).select("id", "title", "day", F.col("slot").cast("long").alias("slot"), "more", "clock")


@query("chunk_assign", "vec", sql="""
    SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, (row_number() OVER (ORDER BY id) - 1) // 64 AS chunk,
        (row_number() OVER (ORDER BY id) - 1) // 64 * 64 AS "offset" FROM vec""")
def _(t):
    return E.assign_chunks(t.vec.select("id"), 64)


@query("unique_claim", "org", sql="""
    WITH w AS (SELECT id, trim(directory_url) AS url FROM org WHERE coalesce(website, '') = '' AND directory_url <> ''
        AND trim(directory_url) NOT IN (SELECT website FROM org WHERE website <> '')),
    c AS (SELECT url, min(id) AS id FROM w GROUP BY url)
    SELECT o.id, coalesce(c.url, o.website) AS website FROM org o LEFT JOIN c ON o.id = c.id""")
def _(t):
    return E.fill_unique(t.org).select("id", "website")


@query("rerank_cap", "org", sql="""
    WITH r AS (SELECT id, source, balance, row_number() OVER (PARTITION BY source ORDER BY balance DESC, id) AS rr FROM org WHERE source IS NOT NULL),
    s AS (SELECT *, CASE WHEN rr <= 30 THEN CAST((id * 7919) % 1000 AS DOUBLE) ELSE balance END AS score FROM r WHERE rr <= 60)
    SELECT id, source, rr AS retrieval_rank, score, row_number() OVER (PARTITION BY source ORDER BY (rr > 30), score DESC, rr) AS rank FROM s""")
def _(t):
    from meadowlark.scale import top_per
    got = top_per(t.org.where(F.col("source").isNotNull()).select("id", "source", "balance"), ["source"],
                  [F.col("balance").desc(), F.col("id")], 60, "retrieval_rank")
    return E.tiered_rank(got, 30, ((F.col("id") * 7919) % 1000).cast("double"), F.col("balance"), query="source").select(
        "id", "source", F.col("retrieval_rank").cast("long").alias("retrieval_rank"), "score", F.col("rank").cast("long").alias("rank"))


# --- order, sets -------------------------------------------------------------------------

@query("paginate", "job", sql="SELECT id, title FROM job ORDER BY id LIMIT 100 OFFSET 200")
def _(t):
    return E.paginate(t.job, 200, 100).select("id", "title")


@query("order_start", "evt", sql="SELECT id, start_date FROM evt ORDER BY start_date NULLS FIRST, id")
def _(t):
    return E.order_by_start(t.evt).select("id", "start_date")


@query("top_k", "org", sql="SELECT id, balance FROM org ORDER BY balance DESC, id LIMIT 25")
def _(t):
    return E.top_k(t.org.select("id", "balance"), 25, "balance")


@query("priority_order", "org", sql="""
    SELECT id, description FROM org ORDER BY CASE WHEN description IS NULL OR description = '' OR description LIKE '%furniture%' THEN 0 ELSE 1 END, id""")
def _(t):
    poor = T.is_blank("description") | F.col("description").like("%furniture%")
    return E.order_by_priority(t.org, poor).select("id", "description")


@query("order_desc", "evt", sql="SELECT id, start_date FROM evt ORDER BY start_date DESC, id")
def _(t):
    return E.newest_first(t.evt, "start_date").select("id", "start_date")


@query("union_all", "org", "host", sql="SELECT id, name, source FROM org UNION ALL SELECT id, name, NULL FROM host")
def _(t):
    return G.union_all(t.org.select("id", "name", "source"), t.host.select("id", "name"))


@query("except_ids", "org", "evt", sql="SELECT id FROM org WHERE id NOT IN (SELECT organization_id FROM evt)")
def _(t):
    return G.except_ids(t.org, t.evt.select(F.col("organization_id").alias("id"))).select("id")


@query("intersect_tokens", "product", sql="""
    WITH w AS (SELECT id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(name), '[^a-z]', ' ', 'g'), ' +'), lambda x: x <> '')) AS a,
        list_distinct(list_filter(string_split_regex(regexp_replace(lower('red ' || brand || ' bolt ring'), '[^a-z]', ' ', 'g'), ' +'), lambda x: x <> '')) AS b FROM product)
    SELECT id, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared FROM w""")
def _(t):
    other = F.concat(F.lit("red "), F.col("brand"), F.lit(" bolt ring"))
    return t.product.select("id", F.array_join(F.array_sort(G.token_overlap("name", other)), ",").alias("shared"))


@query("distinct_values", "org", sql="SELECT DISTINCT website FROM org WHERE website <> ''")
def _(t):
    return G.distinct_values(t.org, "website")


# --- mutations ---------------------------------------------------------------------------

@query("upsert", "org", "evt", sql="""
    WITH d AS (SELECT organization_id * 20 AS id, 'evt ' || max(title) AS name FROM evt GROUP BY organization_id)
    SELECT id, name FROM d UNION ALL SELECT id, name FROM org WHERE id NOT IN (SELECT id FROM d)""")
def _(t):
    delta = t.evt.groupBy((F.col("organization_id") * 20).alias("id")).agg(F.concat(F.lit("evt "), F.max("title")).alias("name"))
    return H.upsert(t.org.select("id", "name"), delta)


@query("upsert_buckets", "org", "evt", sql="""
    WITH d AS (SELECT organization_id * 20 AS id, max(title) AS name FROM evt GROUP BY organization_id)
    SELECT id, name FROM d UNION ALL SELECT id, name FROM org WHERE id NOT IN (SELECT id FROM d)""")
def _(t):
    path = f"{ensure_checkpoint_dir(t.spark)}/buckets-{uuid.uuid4().hex}"
    H.write_buckets(t.org.select("id", "name"), path, buckets=32)
    # every event is a row of the delta; the last title of an organization stays
    delta = t.evt.select((F.col("organization_id") * 20).alias("id"), F.col("title").alias("name"))
    H.upsert_buckets(t.spark, path, delta, order=[F.col("name")])
    return H.read_buckets(t.spark, path)


@query("replace_by_parent", "job", "evt", sql="""
    SELECT organization_id, id, title FROM evt UNION ALL
    SELECT organization_id, id, title FROM job WHERE organization_id NOT IN (SELECT organization_id FROM evt)""")
def _(t):
    cols = ["organization_id", "id", "title"]
    return H.replace_children(t.job.select(cols), t.evt.select(cols)).select(cols)


@query("conditional_update", "org", "product", sql="""
    WITH d AS (SELECT id, name, brand FROM product)
    SELECT o.id, CASE WHEN (o.description IS NULL OR o.description = '') AND d.name <> '' THEN d.name ELSE o.description END AS description,
        CASE WHEN o.city = 'City 5' AND d.brand <> '' THEN d.brand ELSE o.city END AS city FROM org o LEFT JOIN d ON o.id = d.id""")
def _(t):
    delta = t.product.select("id", F.col("name").alias("description"), F.col("brand").alias("city"))
    return H.update_if(t.org.select("id", "description", "city"), delta, "id",
                       {"description": T.is_blank("description"), "city": F.col("city") == "City 5"})


@query("coalesce_fallback", "org", sql="SELECT id, coalesce(nullif(website, ''), nullif(direct_website, ''), nullif(directory_url, '')) AS website FROM org")
def _(t):
    return H.fill_website(t.org).select("id", "website")


@query("null_out", "org", sql="""
    SELECT id, CASE WHEN directory_url IN ('http://dir.example/1', 'http://dir.example/2') OR directory_url = 'http://dir.example/' || (id % 100)
        THEN NULL ELSE directory_url END AS directory_url FROM org""")
def _(t):
    df = t.org.withColumn("other", F.concat(F.lit("http://dir.example/"), (F.col("id") % 100).cast("string")))
    return H.null_out(df, "directory_url", ["http://dir.example/1", "http://dir.example/2"], "other").select("id", "directory_url")


@query("precedence_merge", "org", "product", sql="""
    WITH a AS (SELECT id, city, email FROM org), b AS (SELECT id, brand AS city, name AS email FROM product),
    c AS (SELECT id, CASE WHEN size < 10 THEN name END AS city FROM product),
    k AS (SELECT id FROM a UNION SELECT id FROM b)
    SELECT k.id, coalesce(nullif(c.city, ''), nullif(a.city, ''), nullif(b.city, '')) AS city, coalesce(nullif(a.email, ''), nullif(b.email, '')) AS email
    FROM k LEFT JOIN a ON k.id = a.id LEFT JOIN b ON k.id = b.id LEFT JOIN c ON k.id = c.id""")
def _(t):
    a = t.org.select("id", "city", "email")
    b = t.product.select("id", F.col("brand").alias("city"), F.col("name").alias("email"))
    c = t.product.select("id", F.when(F.col("size") < 10, F.col("name")).alias("city"))
    return H.merge_sources([a, b, c], ["fill", "fill", "override"], "id")


@query("set_flags", "org", "job", "stay", "evt", sql=f"""
    SELECT id, id IN (SELECT organization_id FROM job) AS has_jobs, id IN (SELECT organization_id FROM stay) AS has_stays,
        id IN (SELECT organization_id FROM evt) AS has_events, TIMESTAMP '{NOW}' AS last_scrape_attempt FROM org""")
def _(t):
    return H.derive_flags(t.org, t.job, t.stay, t.evt, NOW).select("id", "has_jobs", "has_stays", "has_events", "last_scrape_attempt")


@query("append", "org", "host", sql="""
    SELECT id, name, country, has_jobs, accepts_visitors FROM org UNION ALL SELECT id, name, country, false, false FROM host""")
def _(t):
    cols = ["id", "name", "country", "has_jobs", "accepts_visitors"]
    return H.append(t.org.select(cols), t.host.select("id", "name", "country")).select(cols)


@query("improve_description", "org", "doc", sql="""
    WITH n AS (SELECT o.id, o.name, o.description AS old, regexp_replace(d.text, '\\s+', ' ', 'g') AS new FROM org o JOIN doc d ON o.id = d.id)
    SELECT id, CASE WHEN length(new) >= 120 AND (coalesce(length(old), 0) <= length(new) OR coalesce(contains(old, 'community farm'), false))
        THEN CASE WHEN coalesce(contains(old, 'community farm'), false) AND NOT starts_with(lower(new), lower(name)) THEN name || '. ' || new ELSE new END
        ELSE old END AS description FROM n""")
def _(t):
    both = t.org.join(t.doc.select("id", F.regexp_replace("text", r"\s+", " ").alias("new")), "id")
    return both.select("id", H.better_description("description", "new", "name", "community farm").alias("description"))


@query("release_leases", "org", sql=f"""
    SELECT id, CASE WHEN being_processed_since < TIMESTAMP '{NOW}' - INTERVAL 20 MINUTE THEN NULL ELSE being_processed_since END AS being_processed_since FROM org""")
def _(t):
    return H.release(t.org, "being_processed_since", NOW, 20).select("id", "being_processed_since")


# --- privacy -----------------------------------------------------------------------------

_IP = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"


@query("anonymize_ip", "doc", sql=rf"""
    WITH ips AS (SELECT id, unnest(regexp_extract_all(text, '{_IP}', 1)) AS ip FROM doc)
    SELECT id, ip, CASE WHEN ip IN ('127.0.0.1', '0.0.0.0') THEN ip ELSE regexp_replace(ip, '\.[^.]*$', '.0') END AS masked FROM ips""")
def _(t):
    ips = t.doc.select("id", F.explode(F.regexp_extract_all("text", F.lit(_IP), 1)).alias("ip"))
    return ips.withColumn("masked", L.anonymize_ip("ip"))


@query("purge_old", "evt", sql="SELECT id, start_date FROM evt WHERE start_date >= TIMESTAMP '2024-07-15 00:00:00' - INTERVAL 180 DAY")
def _(t):
    return L.purge(t.evt, "start_date", "2024-07-15 00:00:00").select("id", "start_date")


@query("purge_counts", "evt", sql="""
    SELECT CAST(count_if(start_date < TIMESTAMP '2024-07-15 00:00:00' - INTERVAL 180 DAY) AS BIGINT) AS purged, count(*) AS total FROM evt""")
def _(t):
    return L.purge_counts(t.evt, "start_date", "2024-07-15 00:00:00")


@query("erase_subject", "evt", "ledger", sql="SELECT id FROM evt WHERE organization_id NOT IN (SELECT id FROM ledger)")
def _(t):
    return L.erase(t.evt, "organization_id", t.ledger.select(F.col("id").alias("organization_id"))).select("id")


@query("erase_report", "evt", "ledger", sql="SELECT id AS organization_id, id IN (SELECT organization_id FROM evt) AS erased FROM ledger")
def _(t):
    return L.erased_any(t.evt, "organization_id", t.ledger.select(F.col("id").alias("organization_id")))


@query("erase_all", "evt", sql="SELECT count(*) AS erased FROM evt")
def _(t):
    return L.erase_all(t.evt).report
