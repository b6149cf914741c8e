"""The given tables in their catalogue roles.

Each role is a list of expressions that Spark and the SQL oracle both understand, so
the two sides read the same columns. ``frame`` gives the DataFrame, ``cte`` the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# role -> (tables and joins in SQL, [(expression, alias)])
# Parts have a few dozen names. A word of their own, a scattered number spelled in letters, before the kind makes every name its own.
PRODUCT_NAME = ("concat(translate(CAST(p_partkey * 48271 % 99990001 AS VARCHAR(20)), '0123456789', 'kelomatrin'), ' ', "
                "split_part(p_name, ' ', 2))")
ROLES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "org": (
        "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
        [
            ("c_custkey", "id"), ("c_name", "name"),
            ("CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN c_name WHEN c_custkey % 6 = 2 THEN ''"
             " ELSE concat(lower(c_mktsegment), ' community farm with volunteers in ', n_name) END", "description"),
            ("lower(c_mktsegment)", "organization_type"),
            ("CASE WHEN c_custkey % 9 = 0 THEN concat('<p>Stored ', c_name, '</p>') END", "popup_html"),
            ("CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN ''"
             " ELSE concat('https://site', c_custkey % 400, '.example.com/') END", "website"),
            ("CASE WHEN c_custkey % 3 <> 0 THEN concat('mail', c_custkey, '@example.org') END", "email"),
            ("CASE WHEN c_custkey % 5 = 0 THEN concat('+1 555 ', c_custkey) END", "phone"),
            ("CASE WHEN c_custkey % 2 = 0 THEN concat(c_custkey, ' Orchard Lane') ELSE '' END", "address"),
            ("CASE WHEN c_custkey % 11 <> 0 THEN concat('City ', c_custkey % 40) END", "city"),
            ("r_name", "region"), ("n_name", "country"), ("CAST(NULL AS VARCHAR(20))", "postal_code"),
            ("CASE WHEN c_custkey % 13 <> 0 THEN CAST((c_custkey * 37) % 18000 AS DOUBLE) / 100 - 90 END", "latitude"),
            ("CASE WHEN c_custkey % 13 <> 0 THEN CAST((c_custkey * 61) % 36000 AS DOUBLE) / 100 - 180 END", "longitude"),
            ("CASE WHEN c_custkey % 97 <> 0 THEN c_mktsegment END", "source"),
            ("CASE WHEN c_custkey % 10 <> 9 THEN c_acctbal > 0 END", "accepts_volunteers"),
            ("c_custkey % 2 = 0", "accepts_visitors"), ("c_custkey % 3 = 0", "accepts_shortterm"),
            ("c_custkey % 5 = 0", "accepts_longterm"), ("c_acctbal > 4000", "has_jobs"),
            ("c_custkey % 4 = 1", "has_stays"), ("c_nationkey % 2 = 0", "has_events"),
            ("concat('http://dir.example/', c_custkey % 50)", "directory_url"),
            ("CASE WHEN c_custkey % 4 = 0 THEN concat('https://own', c_custkey, '.example.net') ELSE '' END", "direct_website"),
            ("CASE WHEN c_custkey % 8 = 0 THEN CAST('2024-01-05 00:00:00' AS {ts}) END", "last_scrape_attempt"),
            ("CASE WHEN c_custkey % 17 = 0 THEN CAST('2024-01-10 11:30:00' AS {ts}) END", "being_processed_since"),
            ("CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 0 END", "jobs_rescraped"),
            ("c_acctbal", "balance"),
        ],
    ),
    "job": (
        "orders",
        [
            ("o_orderkey", "id"), ("o_custkey", "organization_id"), ("o_orderpriority", "title"),
            ("concat(o_orderpriority, ' order worth ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)))", "description"),
            ("o_orderstatus", "role"), ("o_orderdate", "start_date"), ("o_totalprice", "price"),
            ("CASE WHEN o_orderkey % 4 = 0 THEN 'carpentry' WHEN o_orderkey % 4 = 1 THEN '' END", "skills_needed"),
            ("CASE WHEN o_orderkey % 5 = 0 THEN '2 weeks' END", "commitment"),
            ("CASE WHEN o_orderkey % 6 = 0 THEN 'jobs@example.org' END", "application_email"),
            ("CASE WHEN o_orderkey % 3 <> 0 THEN concat('https://site', o_custkey % 400, '.example.com/jobs') END", "source_url"),
        ],
    ),
    "stay": (
        "lineitem JOIN supplier ON l_suppkey = s_suppkey",
        [
            ("l_orderkey", "id"), ("l_linenumber", "line"), ("l_suppkey", "organization_id"), ("s_name", "title"),
            ("concat(l_returnflag, l_linestatus, ' stay at ', s_name)", "description"), ("l_returnflag", "stay_type"),
            ("l_extendedprice", "price"), ("l_partkey", "part"), ("l_shipdate", "start_date"),
            ("CASE WHEN l_orderkey % 3 <> 0 THEN concat('https://book', l_suppkey, '.example.com/', l_returnflag) END", "booking_url"),
            ("CASE WHEN l_orderkey % 10 = 0 THEN CAST('2024-01-10 11:30:00' AS {ts}) END", "being_processed_since"),
            ("CASE WHEN l_orderkey % 4 = 0 THEN 1 END", "rescraped"),
            ("CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_extendedprice AS VARCHAR(40)) END", "price_info"),
        ],
    ),
    "host": (
        "supplier JOIN nation ON s_nationkey = n_nationkey",
        [
            ("s_suppkey", "id"), ("s_name", "name"), ("concat('https://host', s_suppkey, '.example.com')", "website"),
            ("n_name", "country"), ("concat('Town ', s_suppkey % 20)", "city"),
            ("CAST(s_suppkey AS DOUBLE) / 10", "latitude"), ("CAST(s_suppkey AS DOUBLE) / 5", "longitude"),
        ],
    ),
    "evt": (
        "events",
        [
            ("event_id", "id"), ("user_id", "organization_id"), ("event_type", "title"), ("props", "description"),
            ("event_type", "event_type"), ("ts", "start_date"),
            ("CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 HOUR END", "end_date"),
            ("CASE WHEN event_id % 4 = 0 THEN 'Main hall; north, wing' END", "location"),
            ("event_id % 2 = 0", "is_online"), ("event_id % 3 = 0", "is_in_person"),
            ("CASE WHEN event_id % 5 = 0 THEN concat('https://tickets.example/', event_id) END", "registration_url"),
            ("CASE WHEN event_id % 7 <> 0 THEN concat('https://ev.example/', event_type, '/', user_id % 90) END", "event_url"),
            ("value", "value"),
        ],
    ),
    "page": ("pages", [("page_id", "page_id"), ("url", "url"), ("html", "html")]),
    "doc": (
        "documents",
        [("doc_id", "id"), ("text", "text"), ("lang", "lang"), ("source", "source"), ("n_chars", "n_chars")],
    ),
    "vec": ("embeddings", [("vec_id", "id"), ("embedding", "embedding"), ("label", "label")]),
    "ledger": ("labels", [("doc_id", "id"), ("quality", "quality"), ("toxic", "toxic")]),
    "passage": ("benchmark", [("item_id", "id"), ("text", "text")]),
    "place": ("nation JOIN region ON n_regionkey = r_regionkey", [("n_name", "name"), ("n_name", "code"), ("r_name", "continent")]),
    "product": ("part", [("p_partkey", "id"), (PRODUCT_NAME, "name"), ("p_brand", "brand"), ("p_size", "size")]),
}

# Markup added to every page by its own id and text, so that forms, prices, dates, mail
# addresses and structured data occur among the pages.
_MARKS = (
    "CASE page_id % 12"
    " WHEN 0 THEN '<form action=\"/go\"></form><p>Book now, from $45 per night in a yurt or cabin.</p>'"
    " WHEN 1 THEN '<p>We are seeking a volunteer; apply for the position. Required skills: carpentry and gardening basics. 3 weeks. Start date: 07/11/2025</p>'"
    " WHEN 2 THEN '<script type=\"application/ld+json\">{{\"@type\":\"Event\",\"name\":\"Open day\",\"startDate\":\"2025-05-01T10:30\",\"location\":\"online\"}}</script>'"
    " WHEN 3 THEN '<iframe src=\"https://calendar.google.com/x\"></iframe><a href=\"/feed.ics\">feed</a>'"
    " WHEN 4 THEN '<meta name=\"description\" content=\"A quiet farm community near the river with a garden\"><p>Write to info@farm.example or jane@farm.example</p>'"
    " WHEN 5 THEN '<p>Join online via zoom.us/j/12345 on January 15, 2026 - January 17, 2026</p><a href=\"https://zoom.us/j/777\">call</a>'"
    " WHEN 6 THEN '<div data-lat=\"48.5\" class=\"map\" data-lng=\"-2.25\"></div><a href=\"https://facebook.com/farm\">fb</a><a href=\"https://farm.example/\">site</a>'"
    " WHEN 7 THEN '<p>Paid internship, fully remote, $20-40, reserve by mail: host@stay.example</p>'"
    " WHEN 8 THEN '<a href=\"https://tickets.example/register?e=1\">register</a><p>calendly</p>'"
    " WHEN 9 THEN '<p>404 Not Found</p><meta property=\"og:url\" content=\"https://real.example/\">'"
    " WHEN 10 THEN '<p>Find us: twitter.com/farm_one and https://shop.example/a, dormitory beds, price: 30</p>'"
    " ELSE '<p>Caf&eacute;&#8217;s &ndash; &#x2014; &bogus; &amp;lt; end. Guest house and apartment; check-in after 15.01.2026, check availability.</p>' END"
)
ROLES["rich"] = ("pages", [
    ("page_id", "page_id"), ("url", "url"),
    (f"replace(html, '</article>', concat({_MARKS}, '</article>'))", "html"),
])
_SITE_PATHS = ["volunteer", "jobs", "stay", "accommodation", "events", "calendar", "careers", "rooms", "workshops", "apply", "about/jobs"]
_AT = " ".join(f"WHEN {i} THEN '/{p}'" for i, p in enumerate(_SITE_PATHS))
_ORIGIN = "concat(split_part(url, '/', 1), '//', split_part(url, '/', 3))"
# The same pages, laid out as the sub-pages of their sites.
ROLES["spage"] = ("pages", [
    ("page_id", "page_id"), (f"concat({_ORIGIN}, CASE page_id % 13 {_AT} WHEN 11 THEN '/' ELSE '' END)", "url"),
    (ROLES["rich"][1][2][0], "html"),
])
ROLES["note"] = ("documents", [
    ("doc_id", "id"),
    ("concat(text, CASE doc_id % 6"
     " WHEN 0 THEN ' Required skills: carpentry and gardening basics. Start date: 07/11/2025'"
     " WHEN 1 THEN ' Minimum stay: two full weeks in spring. fully remote'"
     " WHEN 2 THEN ' Apprentice with salary, 3 weeks, mail jane@farm.example'"
     " WHEN 3 THEN ' Only EUR 30 per person; a yurt or a dormitory. Jan 15, 2026 - Jan 17, 2026'"
     " WHEN 4 THEN ' Volunteer intern wanted at the farm; see https://a.example/x and instagram.com/farm.one'"
     " ELSE ' Skip to Content page not found' END)", "text"),
])

# Tables whose rows are worth a core each; a single small file of them is dealt out first.
TEXT_TABLES = ("pages", "documents")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a test table, which is one small file, dealt over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


DIALECT = {"spark": {"ts": "TIMESTAMP_NTZ"}, "duckdb": {"ts": "TIMESTAMP"}}


def _select(role: str, engine: str) -> tuple[str, str]:
    tables, cols = ROLES[role]
    listed = ", ".join(f"{e.format(**DIALECT[engine])} AS {a}" for e, a in cols)
    return listed, tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """The role as a DataFrame over the parquet tables."""
    _, tables = _select(role, "spark")
    words = tables.replace("=", " = ").split()
    out, i = table(spark, sf_dir, words[0]), 1
    if words[0] in TEXT_TABLES:
        out = spread(out)
    while i < len(words):
        # JOIN <table> ON <left> = <right>
        right = table(spark, sf_dir, words[i + 1])
        out = out.join(right, out[words[i + 3]] == right[words[i + 5]])
        i += 6
    return out.selectExpr(*[f"{e.format(**DIALECT['spark'])} AS {a}" for e, a in ROLES[role][1]])


def cte(*roles: str) -> str:
    """WITH clause defining the roles for the oracle."""
    parts = []
    for role in roles:
        listed, tables = _select(role, "duckdb")
        parts.append(f"{role} AS (SELECT {listed} FROM {tables})")
    return "WITH " + ",\n".join(parts)
