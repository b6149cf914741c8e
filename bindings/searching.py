"""Vectors, search, name matching and published texts on the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.relational import NOW, words
from bindings.roles import PRODUCT_NAME
from meadowlark import constants as K
from meadowlark.functions import text as T
from meadowlark.functions import vectors as V
from meadowlark.operators import matching as M
from meadowlark.operators import search as S
from meadowlark.sinks import files, render
from meadowlark.sources import gazetteer as Z

BASE = "https://catalogue.example"


def label_queries(t):
    """One query per label: the mean vector of its members."""
    parts = t.vec.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))


Q_SQL = """q AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY i) AS qv FROM (
        SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM vec) GROUP BY label, i) GROUP BY label),
    sc AS (SELECT query_id, id, round(list_dot_product(qv, list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS score FROM q, vec)"""


@query("vector_cross", "vec", sql=f"WITH {Q_SQL} SELECT query_id, id, round(score, 6) AS score FROM sc WHERE score >= 0.02")
def _(t):
    return S.cosine_above(label_queries(t), t.vec, 0.02).withColumn("score", F.round("score", 6))


@query("cosine_topk", "vec", sql=f"""
    WITH {Q_SQL} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 200""")
def cosine_topk(t):
    return S.cosine_topk(label_queries(t), t.vec, 200).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("embed_text", "org", sql="SELECT id, name || '. ' || coalesce(description, '') AS text FROM org")
def _(t):
    return t.org.select("id", S.embed_text().alias("text"))


@query("search_text", "org", sql="""
    SELECT id, concat_ws(' ', nullif(name, ''), nullif(organization_type, ''), nullif(description, ''), nullif(country, ''), nullif(city, '')) AS text FROM org""")
def _(t):
    return t.org.select("id", S.search_text().alias("text"))


@query("encode", "org", sql="SELECT id, CAST(1 AS DOUBLE) AS norm2, 64 AS dim FROM org")
def _(t):
    coded = S.encode(t.org.select("id", S.search_text().alias("text")), "text", S.hashed_words(64))
    norm = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    return coded.select("id", F.round(norm, 3).alias("norm2"), F.size("embedding").alias("dim"))


@query("l2_normalize", "vec", sql="""
    WITH d AS (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM vec)
    SELECT id, unnest(list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6))) AS x, unnest(range(len(v))) AS i FROM d""")
def _(t):
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    return t.vec.select("id", F.posexplode(V.l2_normalize(scaled)).alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("quantize", "vec", sql="""
    SELECT id, array_to_string(list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) / 2 * 255) AS INTEGER)), ',') AS codes FROM vec""")
def _(t):
    return t.vec.select("id", F.array_join(V.quantize("embedding").cast("array<string>"), ",").alias("codes"))


@query("dequantize", "vec", sql="""
    SELECT id, round(list_sum(list_transform(embedding, lambda x: floor((CAST(x AS DOUBLE) + 1) / 2 * 255) * 2 / 255 - 1)), 6) AS total FROM vec""")
def _(t):
    back = V.dequantize(V.quantize("embedding"))
    return t.vec.select("id", F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("pack_f32", "vec", sql="""
    SELECT id, CAST(ceil(len(embedding) * 4 / 3.0) * 4 AS INTEGER) AS n, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT)), ',') AS millionths,
        floor(log2(abs(CAST(embedding[1] AS DOUBLE)))) AS exponent FROM vec""")
def _(t):
    packed = t.vec.select("id", V.pack_f32("embedding").alias("packed"))
    back = packed.select("id", F.length("packed").alias("n"), F.unbase64("packed").alias("raw"), V.unpack_f32("packed").cast("array<double>").alias("v"))
    # the exponent bits of the first value, read from its third and fourth byte
    byte = lambda i: F.conv(F.hex(F.substring("raw", i, 1)), 16, 10).cast("int")
    exponent = (byte(4) % 128 * 2 + F.floor(byte(3) / 128) - 127).cast("double")
    return back.select("id", "n", F.array_join(F.transform("v", lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").alias("millionths"), exponent.alias("exponent"))


@query("index_header", "vec", sql="""
    SELECT 'hashed' AS model, CAST(max(len(embedding)) AS INTEGER) AS dim, count(*) AS count, CAST(ceil(count(*) / 64.0) AS BIGINT) AS num_chunks,
        CAST(min(list_min(embedding)) AS DOUBLE) AS lo, CAST(max(list_max(embedding)) AS DOUBLE) AS hi FROM vec""")
def _(t):
    h = S.index_header(t.vec, "hashed", 64)
    return h.select("model", "dim", "count", "num_chunks", F.get("range", F.lit(0)).alias("lo"), F.get("range", F.lit(1)).alias("hi"))


@query("write_vector_chunks", "vec", sql="""
    WITH s AS (SELECT CAST(min(list_min(embedding)) AS DOUBLE) AS lo, CAST(max(list_max(embedding)) AS DOUBLE) AS hi FROM vec),
    r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, embedding AS v FROM vec)
    SELECT id, pos, pos // 64 AS chunk, pos // 64 * 64 AS "offset", array_to_string(list_transform(v, lambda x: CAST(round((CAST(x AS DOUBLE) - lo) / (hi - lo) * 255) AS INTEGER)), ',') AS codes FROM r, s""")
def _(t):
    vec = t.vec.select("id", "embedding", (F.col("id") / 10).alias("lat"), (F.col("id") / 5).alias("lon"))
    chunks = files.vector_chunks(vec, 64)
    return chunks.select("pos", "chunk", "offset", "id", F.array_join(V.unpack_codes("e").cast("array<string>"), ",").alias("codes"))


def place_queries(t):
    """Query texts naming every country and continent of the tables, in several phrasings."""
    return t.place.select(F.inline(F.array(
        F.struct(F.concat(F.lit("organic farm "), "name").alias("text")),
        F.struct(F.concat(F.lit("quiet garden in "), F.initcap(F.lower("continent"))).alias("text")),
        F.struct(F.concat(F.lit("stay near the "), F.lower("name"), F.lit(" river")).alias("text")),
    ))).distinct()


# organizations somewhere in the built-in table of countries, by their id
_NAMED = [(code, names[0]) for _, code, names in K.COUNTRIES if re.fullmatch("[a-z]{3,}( [a-z]{3,})?", names[0]) and names[0] != "antarctica"]


@query("query_location", "place", "org", sql=f"""
    WITH c AS (SELECT unnest([{words([c for c, _ in _NAMED])}]) AS code, unnest([{words([n for _, n in _NAMED])}]) AS name, unnest(range({len(_NAMED)})) AS i),
    q AS (SELECT DISTINCT 'farm ' || c.name AS text, 'farm' AS cleaned, c.code AS place FROM c JOIN org ON org.id % {len(_NAMED)} = c.i UNION SELECT DISTINCT 'organic farm ' || name AS text, 'organic farm' AS cleaned, name AS place FROM place
        UNION SELECT 'quiet garden in ' || list_aggregate(list_transform(string_split(continent, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '),
            'quiet garden', continent FROM place
        UNION SELECT 'stay near the ' || lower(name) || ' river', 'stay near the ' || lower(name) || ' river', NULL FROM place)
    SELECT * FROM q""")
def _(t):
    name = F.element_at(F.array(*[F.lit(n) for _, n in _NAMED]), (F.col("id") % len(_NAMED) + 1).cast("int"))
    asked = place_queries(t).unionByName(t.org.select(F.concat(F.lit("farm "), name).alias("text")).distinct())
    return S.query_location(asked, Z.gazetteer(t.spark, t.place))


@query("stop_word_place", "place", sql=f"""
    WITH w AS (SELECT unnest([{words(K.PLACE_STOP_WORDS)}]) AS w), q AS (SELECT 'living in ' || w AS text, '' AS place FROM w, place UNION
        SELECT 'farms in Old' || lower(replace(continent, ' ', '')) || ' ', 'Old' || lower(replace(continent, ' ', '')) FROM place)
    SELECT DISTINCT text, place FROM q""")
def _(t):
    stops = t.place.select(F.explode(F.array(*[F.lit(w) for w in K.PLACE_STOP_WORDS])).alias("w"))
    a = stops.select(F.concat(F.lit("living in "), "w").alias("text"))
    b = t.place.select(F.concat(F.lit("farms in Old"), F.lower(F.replace("continent", F.lit(" "), F.lit(""))), F.lit(" ")).alias("text"))
    return a.unionByName(b).distinct().select("text", S.stop_word_place("text").alias("place"))


def search_queries(t):
    region = t.raw("region").select(F.col("r_regionkey").cast("long").alias("query_id"),
                                    F.concat(F.lit("community farm in "), "r_name").alias("text"))
    return region.join(label_queries(t), "query_id")


@query("search", "vec", "org", sql=f"""
    WITH {Q_SQL},
    qq AS (SELECT q.query_id, 'community farm in ' || r_name AS text, r_name AS place FROM q JOIN region ON q.query_id = r_regionkey),
    c AS (SELECT sc.query_id, sc.score, qq.text AS query_text, org.*, row_number() OVER (PARTITION BY sc.query_id ORDER BY sc.score DESC, sc.id) AS rk
        FROM sc JOIN qq ON sc.query_id = qq.query_id JOIN org ON sc.id = org.id AND org.region = qq.place QUALIFY rk <= 1000),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rr FROM c QUALIFY rr <= 60),
    w AS (SELECT *, list_filter(string_split_regex(lower(query_text), '\\s+'), lambda x: length(x) > 2) AS ws,
        lower(concat_ws(' ', nullif(name, ''), nullif(organization_type, ''), nullif(description, ''), nullif(country, ''), nullif(city, ''))) AS st FROM r),
    s AS (SELECT *, CASE WHEN rr <= 30 THEN round(1 / (1 + exp(-(4.0 * len(list_filter(ws, lambda x: contains(st, x))) / len(ws) - 2.0))), 9) ELSE score END AS final FROM w)
    SELECT query_id, id, name, country, round(final, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY (rr > 30), final DESC, rr) AS rank,
        coalesce(description, '') AS description FROM s QUALIFY rank <= 20""")
def _(t):
    hits = S.search(search_queries(t), t.vec, t.org, Z.from_countries(t.place), top_n=20)
    return hits.select("query_id", "id", "name", "country", "score", F.col("rank").cast("long").alias("rank"), "description")


def keyword_queries(t):
    """One query per market segment, with a place and a feature word each."""
    return t.raw("customer").select(F.lower("c_mktsegment").alias("s")).distinct().select(
        (F.length("s") * 1000 + F.ascii("s")).cast("long").alias("query_id"), F.concat("s", F.lit(" volunteers stay nation_1")).alias("text"))


_KW_SQL = """kq AS (SELECT DISTINCT CAST(length(c_mktsegment) * 1000 + ascii(lower(c_mktsegment)) AS BIGINT) AS query_id,
        lower(c_mktsegment) || ' volunteers stay nation_1' AS text FROM customer),
    ko AS (SELECT *, lower(coalesce(name, '')) AS n, lower(coalesce(description, '')) AS d, lower(coalesce(country, '')) AS c FROM org),
    kp AS (SELECT query_id, id, latitude, longitude, CASE WHEN contains(n || ' ' || d || ' ' || c, text) THEN 10 ELSE 0 END
        + list_sum(list_transform(list_filter(string_split(text, ' '), lambda w: length(w) > 2),
            lambda w: 3 * CAST(contains(n, w) AS INTEGER) + CAST(contains(d, w) AS INTEGER) + 2 * CAST(contains(c, w) AS INTEGER)))
        + CASE WHEN contains(text, 'volunteer') AND has_jobs THEN 2 ELSE 0 END + CASE WHEN contains(text, 'stay') AND has_stays THEN 2 ELSE 0 END
        + CASE WHEN contains(text, 'event') AND has_events THEN 2 ELSE 0 END + CASE WHEN contains(text, 'job') AND has_jobs THEN 2 ELSE 0 END AS points FROM kq, ko),
    kr AS (SELECT query_id, id, latitude, longitude, points / 20.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, id) AS rank FROM kp WHERE points > 0)"""


@query("keyword_search", "org", sql=f"WITH {_KW_SQL} SELECT * FROM kr WHERE rank <= 200")
def keyword_search(t):
    return S.keyword_search(keyword_queries(t), t.org, 200).withColumn("rank", F.col("rank").cast("long"))


@query("search_with_fallback", "vec", "org", sql=f"""
    WITH {Q_SQL}, {_KW_SQL},
    vr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 50)
    SELECT query_id, vr.id, round(vr.score, 6) AS score, rank FROM vr JOIN org ON vr.id = org.id
    UNION ALL SELECT query_id, id, round(score, 6), rank FROM kr WHERE rank <= 50""")
def _(t):
    asked = label_queries(t).select("query_id", F.lit(None).cast("string").alias("text"), "embedding").unionByName(
        keyword_queries(t).withColumn("embedding", F.lit(None).cast("array<double>")))
    return S.search_any(asked, t.org, t.vec, 50).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- matching ---------------------------------------------------------------------------------

REF = {
    "exact": (f"upper({PRODUCT_NAME})", "p_partkey"),
    "long": (f"concat({PRODUCT_NAME}, ' ', lower(p_type), ' ', p_size)", "p_partkey * 2"),
    "short": ("split_part(p_name, ' ', 2)", "p_partkey * 2 + 1"),
    "close": (f"concat(substr({PRODUCT_NAME}, 2), p_size % 7, 's')", "p_partkey"),
    "token": (f"concat(p_brand, ' ', split_part({PRODUCT_NAME}, ' ', 1), ' ', lower(p_type))", "p_partkey"),
}


def ref(t, *kinds):
    out = None
    for k in kinds:
        name, pos = REF[k]
        part = t.raw("part").selectExpr(f"{name} AS name", f"CAST({pos} AS BIGINT) AS pos", f"concat('http://ref.example/', {pos}) AS url")
        out = part if out is None else out.unionByName(part)
    return out


def ref_sql(*kinds):
    return "ref AS (" + " UNION ALL ".join(
        f"SELECT lower({REF[k][0]}) AS k, {REF[k][1]} AS pos, 'http://ref.example/' || ({REF[k][1]}) AS url FROM part" for k in kinds) + ")"


@query("match_exact_ci", "product", sql=f"""
    WITH {ref_sql('exact')}, r AS (SELECT k, arg_max(url, pos) AS match_url FROM ref GROUP BY k)
    SELECT p.id, r.match_url FROM product p LEFT JOIN r ON lower(p.name) = r.k""")
def _(t):
    return M.match_exact(t.product, ref(t, "exact")).select("id", "match_url")


@query("match_contains", "product", sql=f"""
    WITH {ref_sql('long', 'short')}, n AS (SELECT DISTINCT lower(name) AS name FROM product),
    u AS (SELECT k, min(pos) AS pos, arg_min(url, pos) AS url FROM ref GROUP BY k),
    m AS (SELECT n.name, arg_min(u.url, u.pos) AS match_url FROM n JOIN u ON contains(u.k, n.name) OR contains(n.name, u.k) GROUP BY n.name)
    SELECT p.id, m.match_url FROM product p LEFT JOIN m ON lower(p.name) = m.name""")
def _(t):
    return M.match_contains(t.product, ref(t, "long", "short")).select("id", "match_url")


@query("passage_containment", "doc", "passage", sql="SELECT d.id AS doc_id, p.id AS passage_id FROM doc d JOIN passage p ON contains(d.text, p.text) WHERE length(p.text) > 0")
def _(t):
    docs = t.doc.select(F.col("id").alias("doc_id"), F.col("text").alias("doc_text"))
    passages = t.passage.select(F.col("id").alias("passage_id"), F.col("text").alias("passage_text"))
    return M.passages_in(docs, passages, "doc_id", "doc_text", "passage_id", "passage_text")


_LEV = f"""
    WITH {ref_sql('close')}, n AS (SELECT DISTINCT lower(name) AS name FROM product),
    u AS (SELECT k, min(pos) AS pos, arg_min(url, pos) AS url FROM ref GROUP BY k),
    s AS (SELECT n.name, u.pos, u.url, 1.0 - CAST(levenshtein(n.name, u.k) AS DOUBLE) / greatest(length(n.name), length(u.k), 1) AS score FROM n, u),
    m AS (SELECT name, url AS match_url, score FROM s WHERE score > 0.6 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, pos) = 1)
    SELECT p.id, m.match_url, round(m.score, 6) AS match_score FROM product p LEFT JOIN m ON lower(p.name) = m.name"""


@query("match_fuzzy", "product", sql=_LEV)
def match_fuzzy(t):
    return M.match_fuzzy(t.product, ref(t, "close")).select("id", "match_url", F.round("match_score", 6).alias("match_score"))


@query("match_fuzzy_ratio")
def _(t):
    return M.match_fuzzy(t.product, ref(t, "close"), metric="ratio").select("id", "match_url", F.round("match_score", 6).alias("match_score"))


@query("match_tokens", "product", sql=f"""
    WITH {ref_sql('token')}, n AS (SELECT DISTINCT lower(name) AS name FROM product),
    nw AS (SELECT name, list_distinct(list_filter(string_split_regex(regexp_replace(name, '[^a-z]', ' ', 'g'), ' +'), lambda w: w <> '')) AS ws,
        list_filter(string_split_regex(name, '\\s+'), lambda w: length(w) > 4) AS ls FROM n),
    uw AS (SELECT k, min(pos) AS pos, arg_min(url, pos) AS url, list_distinct(list_filter(string_split_regex(regexp_replace(k, '[^a-z]', ' ', 'g'), ' +'), lambda w: w <> '')) AS ws FROM ref GROUP BY k),
    m AS (SELECT name, arg_min(url, pos) AS match_url FROM nw, uw WHERE len(nw.ws) > 0 AND (len(list_intersect(nw.ws, uw.ws)) >= least(2, len(nw.ws))
        OR len(list_filter(nw.ls, lambda w: contains(k, w))) > 0) GROUP BY name)
    SELECT p.id, m.match_url FROM product p LEFT JOIN m ON lower(p.name) = m.name""")
def _(t):
    return M.match_tokens(t.product, ref(t, "token")).select("id", "match_url")


@query("match_slug_page", "org", sql="""
    SELECT id, 'https://directory.example/project/' || replace(lower(name), '#', '') || '/' AS match_url FROM org WHERE id % 3 <> 2 AND name NOT LIKE '%404%'""")
def _(t):
    pages = t.org.select(
        F.concat(F.lit("https://directory.example/project/"), T.slugify("name"), F.lit("/")).alias("url"),
        F.concat(F.lit('<meta property="og:title"><title>'), F.when(F.col("id") % 3 == 2, "Page not found").otherwise(F.col("name")), F.lit("</title>")).alias("html"))
    return M.match_slug_page(t.org, pages, "https://directory.example/project/")


# --- published texts ------------------------------------------------------------------------------

def _fill_sql(template, *values):
    parts = template.split("{}")
    out = f"'{parts[0]}'"
    for v, tail in zip(values, parts[1:]):
        out += f" || {v} || '{tail}'"
    return out


def _badge_sql(cond, *style):
    return f"CASE WHEN {cond} THEN '{K.POPUP_BADGE.format(*style)}' END"


POPUP_SQL = f"""
    SELECT id, coalesce(nullif(popup_html, ''), concat_ws(' ', '<strong>' || name || '</strong><br>', CASE WHEN length(description) > 10 THEN {_fill_sql(K.POPUP_DESCRIPTION, 'description')} END,
        nullif(badges, '') || '<br>', {_fill_sql(K.POPUP_ADDRESS, "nullif(address, '')")}, {_fill_sql(K.POPUP_PLACE, "nullif(place, '')")}, {_fill_sql(K.POPUP_LINKS, "nullif(reach, '')")})) AS popup
    FROM (SELECT *, concat_ws(' ', {_badge_sql('accepts_volunteers', '#ffc107', 'black', 'Volunteer')}, {_badge_sql('accepts_visitors AND accepts_shortterm', '#17a2b8', 'white', 'Short-term')},
        {_badge_sql('accepts_visitors AND accepts_longterm', '#17a2b8', 'white', 'Long-term')}, {_badge_sql('has_jobs', '#dc3545', 'white', 'Jobs')}) AS badges,
        concat_ws(', ', nullif(city, ''), nullif(region, ''), nullif(country, '')) AS place,
        concat_ws(' | ', {_fill_sql(K.POPUP_WEBSITE, "nullif(website, '')")}, {_fill_sql(K.POPUP_EMAIL, "nullif(email, '')")}, nullif(phone, '')) AS reach FROM org)"""


@query("popup_html", "org", sql=POPUP_SQL)
def _(t):
    return t.org.select("id", render.popup_html().alias("popup"))


@query("short_popup", "org", sql=f"""
    SELECT id, '<strong>' || name || '</strong><p>' || t || '</p>'
        || coalesce('<div>' || nullif(badges, '') || '</div>', '')
        || concat_ws('', '<a href="' || nullif(website, '') || '" target="_blank">🌐 Website</a>', '<a href="mailto:' || nullif(email, '') || '">Email</a>') AS popup
    FROM (SELECT *, repeat(name || ' ', 12) AS t, concat_ws(' ', {_badge_sql('accepts_volunteers', '#ffc107', 'black', 'Volunteer')},
        {_badge_sql('accepts_visitors', '#17a2b8', 'white', 'Visitors')}, {_badge_sql('has_jobs', '#dc3545', 'white', 'Jobs')}) AS badges FROM org)""")
def _(t):
    return t.org.select("id", render.short_popup(F.expr("repeat(concat(name, ' '), 12)")).alias("popup"))


@query("to_geojson", "org", sql=f"""
    WITH p AS ({POPUP_SQL}) SELECT o.id, longitude AS lon, latitude AS lat, p.popup, coalesce(website, '') AS website, coalesce(accepts_volunteers, false) AS volunteers,
        CASE WHEN email <> '' THEN email END AS schema_email FROM org o JOIN p ON o.id = p.id WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def geojson(t):
    f = render.to_geojson(t.org, BASE)
    def get(path):
        return F.get_json_object("feature", path)
    return f.select("id", get("$.geometry.coordinates[0]").cast("double").alias("lon"), get("$.geometry.coordinates[1]").cast("double").alias("lat"),
                    get("$.properties.popup").alias("popup"), get("$.properties.website").alias("website"),
                    get("$.properties.acceptsVolunteers").cast("boolean").alias("volunteers"), get("$.properties.schemaOrg.email").alias("schema_email"))


@query("schema_org", "org", sql=f"""
    SELECT id, '{BASE}/?org=' || id AS ld_id, coalesce(nullif(website, ''), '{BASE}/?org=' || id) AS url, nullif(email, '') AS email, nullif(phone, '') AS telephone,
        CASE WHEN longitude IS NOT NULL THEN latitude END AS geo_latitude, coalesce(address, '') AS street, coalesce(city, '') AS locality FROM org""")
def _(t):
    s = t.org.select("id", render.schema_org(BASE).alias("s"))
    return s.select("id", F.col("s.@id").alias("ld_id"), "s.url", "s.email", "s.telephone", F.col("s.geo.latitude").alias("geo_latitude"),
                    F.col("s.address.streetAddress").alias("street"), F.col("s.address.addressLocality").alias("locality"))


def _ics_esc(c):
    return f"replace(replace(replace(replace(replace({c}, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(10), '\\n'), chr(13), '')"


def _ics_when(name, c):
    return (f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN timed THEN '{name}:' || strftime({c}, '%Y%m%dT%H%M%S') "
            f"ELSE '{name};VALUE=DATE:' || strftime({c}, '%Y%m%d') END END")


def _fold(c):
    return (f"CASE WHEN length({c}) > 75 THEN array_to_string(list_transform(range(CAST(ceil(length({c}) / 73.0) AS BIGINT)), "
            f"lambda i: substr({c}, i * 73 + 1, 73)), chr(13) || chr(10) || ' ') ELSE {c} END")


_ICS_LINES = ["'BEGIN:VEVENT'", "'UID:event-' || id || '@catalogue.example'", "'DTSTAMP:20240110T120000Z'", f"'SUMMARY:' || {_ics_esc('title')}",
              f"'DESCRIPTION:' || {_ics_esc('description')}", "'URL:' || coalesce(nullif(event_url, ''), nullif(registration_url, ''), nullif(website, ''))",
              f"'LOCATION:' || coalesce(nullif({_ics_esc('place')}, ''), 'TBD')", _ics_when("DTSTART", "start_date"), _ics_when("DTEND", "end_date"), "'END:VEVENT'"]


ICALENDAR_SQL = f"""SELECT id, concat_ws(chr(13) || chr(10), {', '.join(_fold(x) for x in _ICS_LINES)}) AS vevent FROM (
        SELECT evt.id, evt.title, evt.description || ' ' || evt.description || ' ' || repeat('long text, ', evt.organization_id % 12) AS description, evt.event_url, evt.registration_url, o.website,
        concat_ws(', ', nullif(evt.location, ''), nullif(o.city, ''), nullif(o.country, '')) AS place, start_date, end_date, strftime(start_date, '%H%M%S') <> '000000' AS timed
        FROM evt JOIN org o ON evt.organization_id = o.id)"""


def calendar_entries(t):
    ev = t.evt.withColumn("description", F.expr("concat(description, ' ', description, ' ', repeat('long text, ', cast(organization_id % 12 as int)))"))
    return render.icalendar_events(ev, t.org, NOW, "catalogue.example")


@query("to_icalendar", "evt", "org", sql=ICALENDAR_SQL)
def _(t):
    return calendar_entries(t).select("id", "vevent")


@query("to_sql_upserts", "org", sql="""
    SELECT id, 'INSERT INTO organizations (id, name, city, accepts_volunteers, has_jobs) VALUES (' || id || ', ''' || replace(name, '''', '''''') || ''', '
        || coalesce('''' || replace(city, '''', '''''') || '''', 'NULL') || ', ' || coalesce(CAST(CAST(accepts_volunteers AS INTEGER) AS VARCHAR), 'NULL') || ', '
        || CAST(CAST(has_jobs AS INTEGER) AS VARCHAR) || ') ON CONFLICT(id) DO UPDATE SET name=excluded.name, city=excluded.city, accepts_volunteers=excluded.accepts_volunteers, has_jobs=excluded.has_jobs;' AS statement FROM org""")
def _(t):
    return render.sql_statements(t.org.select("id", "name", "city", "accepts_volunteers", "has_jobs"), "organizations")


