"""Rows from fetched documents: sitemaps, robots files, JSON-LD blocks, REST payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions import dates
from meadowlark.functions import text as T
from meadowlark.functions.extract import strip_tags
from meadowlark.scale import rank_within, top_per

_LD_BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def sitemap_urls(docs: DataFrame, max_urls: int | None = None) -> DataFrame:
    """(url, pos, page_url): locations of urlset documents, one level through index documents.

    ``docs`` has url and body. ``url`` of the result is the document asked for. Positions count
    through the documents of an index; ``max_urls`` keeps the first ones only.
    """
    listed = docs.select("url", F.col("body").rlike("<(?:\\w+:)?sitemapindex").alias("is_index"),
                         F.posexplode(T.extract_all("body", r"(?s)<(?:\w+:)?loc>\s*([^<\s]+)\s*</(?:\w+:)?loc>", 1)).alias("i", "loc"))
    index = listed.where("is_index").select("url", F.col("i").alias("child_pos"), F.col("loc").alias("child_url"))
    leaf = listed.where(~F.col("is_index")).select(F.col("url").alias("leaf_url"), "i", F.col("loc").alias("page_url"))
    direct = leaf.select(F.col("leaf_url").alias("url"), F.lit(0).alias("child_pos"), "i", "page_url")
    nested = index.join(leaf, F.col("child_url") == F.col("leaf_url")).select("url", "child_pos", "i", "page_url")
    every, order = direct.unionByName(nested), [F.col("child_pos"), F.col("i"), F.col("page_url")]
    ranked = rank_within(every, ["url"], order) if max_urls is None else top_per(every, ["url"], order, max_urls)
    return ranked.select("url", (F.col("rank") - 1).alias("pos"), "page_url")


def robots_sitemaps(docs: DataFrame) -> DataFrame:
    return docs.select("url", F.posexplode(T.extract_all("body", r"(?i)Sitemap:\s*(\S+)", 1)).alias("pos", "sitemap_url"))


def jsonld_array(html) -> Column:
    """JSON-LD objects of a page as JSON texts, in page order; arrays and @graph are flattened,
    unreadable blocks skipped."""
    def parts(value, path):
        return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array(value))

    blocks = F.filter(F.transform(T.extract_all(html, _LD_BLOCK, 1), F.try_parse_json), lambda v: v.isNotNull())
    items = F.flatten(F.transform(blocks, lambda v: parts(v, "$")))
    return F.transform(F.flatten(F.transform(items, lambda v: parts(v, "$['@graph']"))), lambda v: F.to_json(v))


def jsonld_items(pages: DataFrame) -> DataFrame:
    """(page_id, pos, item): one row per JSON-LD object."""
    return pages.select("page_id", F.posexplode(jsonld_array("html")).alias("pos", "item"))


def is_event_item(item: Column) -> Column:
    kind = F.coalesce(F.get_json_object(item, "$['@type']"), F.lit(""))
    return F.lower(kind).contains("event") | kind.isin(K.EVENT_TYPES)


def event_item(item: Column) -> Column:
    """An event-typed object as a struct; dates stay as written."""
    def get(path):
        return F.get_json_object(item, path)

    platform = "(?i)" + "|".join(K.VIDEO_PATTERNS)
    place, mode = F.lower(F.coalesce(get("$.location"), F.lit(""))), F.coalesce(get("$.eventAttendanceMode"), F.lit(""))
    virtual = place.rlike("virtual|online")
    url = F.coalesce(get("$.url"), F.lit(""))
    return F.struct(
        F.coalesce(get("$.name"), F.lit("")).alias("title"), F.coalesce(get("$.description"), F.lit("")).alias("description"),
        F.coalesce(get("$.startDate"), get("$.start_date")).alias("start_raw"),
        F.coalesce(get("$.endDate"), get("$.end_date")).alias("end_raw"),
        (mode.endswith("OnlineEventAttendanceMode") | virtual).alias("is_online"),
        # without a stated mode an event is in person unless its location says otherwise
        (mode.endswith("OfflineEventAttendanceMode") | ((mode == "") & ~virtual)).alias("is_in_person"),
        F.when(url.rlike(platform) & url.startswith("http"), url).otherwise(F.lit("")).alias("video_url"),
        url.alias("url"))


def jsonld_events(items: DataFrame) -> DataFrame:
    """Event-typed items as typed rows."""
    rows = items.where(is_event_item(F.col("item"))).select("page_id", "pos", T.let(F.col("item"), event_item).alias("e"))
    return rows.select("page_id", "pos", "e.*", dates.parse_date("e.start_raw").alias("start_date"),
                       dates.parse_date("e.end_raw").alias("end_date"))


def api_items(payloads: DataFrame, body: str = "body", name_chars: int | None = None, max_len: int | None = None) -> DataFrame:
    """Organizations from REST payload arrays: rendered texts without tags, coordinates from
    meta or else acf, zero as missing."""
    kept = [c for c in payloads.columns if c != body]
    items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    rows = payloads.select(*kept, F.explode(items).alias("v")).select(*kept, F.to_json("v").alias("_item"))

    def get(path):
        return F.get_json_object("_item", path)

    def number(path):
        return F.nullif(get(path).try_cast("double"), F.lit(0.0))

    # a title is an object with a rendered text, or the text itself
    title = F.coalesce(get("$.title.rendered"), F.when(~get("$.title").startswith("{"), get("$.title")))
    return rows.select(
        *kept, T.prefix(T.strip(strip_tags(title)), name_chars).alias("name"),
        T.prefix(T.strip(strip_tags(F.coalesce(get("$.content.rendered"), F.lit("")))), max_len).alias("description"),
        F.coalesce(get("$.link"), F.lit("")).alias("website"),
        F.coalesce(number("$.meta.latitude"), number("$.acf.latitude")).alias("latitude"),
        F.coalesce(number("$.meta.longitude"), number("$.acf.longitude")).alias("longitude"),
    ).where(F.coalesce(F.col("name"), F.lit("")) != "")
