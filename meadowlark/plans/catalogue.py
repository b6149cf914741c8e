"""Jobs that merge, clean, enrich, index and publish the catalogue."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions import extract as X
from meadowlark.functions import text as T
from meadowlark.functions import urls
from meadowlark.operators import aggregates as A
from meadowlark.operators import filters as B
from meadowlark.operators import html as HT
from meadowlark.operators import joins as C
from meadowlark.operators import matching as M
from meadowlark.operators import mutations as H
from meadowlark.operators import ranking as E
from meadowlark.operators import search as S
from meadowlark.operators import sets as G
from meadowlark.scale import first_per, keys_of, list_pages
from meadowlark.session import durable
from meadowlark.sinks import files, render
from meadowlark.sources import web


def map_features(org: DataFrame, base_url: str, **filters) -> DataFrame:
    """The filtered map layer, one GeoJSON feature per row."""
    return render.to_geojson(B.filter_flags(B.has_geo(org), **filters), base_url)


class Merged(NamedTuple):
    organizations: DataFrame
    added: DataFrame
    by_source: DataFrame


def listing_records(listing: DataFrame, pages: DataFrame, pattern: str, source: str, kind: str,
                    name_chars: int | None = None) -> DataFrame:
    """Organizations behind the links of directory pages."""
    found = C.follow_links(listing, pages, pattern)
    read = found.select(
        T.prefix("text", name_chars).alias("name"), "target_id", X.listing_description("target_html").alias("description"),
        X.own_website("target_html", "target_url").alias("website"), X.geo_point("target_html").alias("p"),
        X.listing_email(X.text_simple("target_html")).alias("email"))
    return read.where(F.col("p.latitude").isNotNull() | (F.col("website") != "") | (F.length("description") > 30)).select(
        "name", "description", "website", "email", F.col("p.latitude").alias("latitude"), F.col("p.longitude").alias("longitude"),
        F.lit(source).alias("source"), F.lit(kind).alias("organization_type"), F.col("target_id").alias("record_id"))


def merge_directories(listed: DataFrame, payloads: DataFrame, org: DataFrame, source: str, kind: str = "Eco Village") -> Merged:
    """New organizations of listing records and REST payloads, numbered and appended.

    ``payloads`` has record_id and body; ``record_id`` orders records of equal name.
    """
    api = web.api_items(payloads).withColumn("source", F.lit(source)).withColumn("organization_type", F.lit(kind))
    every = G.union_all(listed, api)
    fresh = durable(C.new_records(every, org, [F.col("record_id"), F.col("source")]))
    added = A.assign_ids(fresh, org, [F.col("record_id"), F.lower("name")]).drop("record_id")
    everything = H.append(org, added)
    return Merged(everything, added, A.value_counts(everything, "source"))


MATCHERS = {
    "exact": lambda df, ref, threshold, metric: M.match_exact(df, ref),
    "contains": lambda df, ref, threshold, metric: M.match_contains(df, ref, longer_than=5),
    "tokens": lambda df, ref, threshold, metric: M.match_tokens(df, ref),
    "fuzzy": lambda df, ref, threshold, metric: M.match_fuzzy(df, ref, threshold, metric).drop("match_score"),
}


def fill_websites(org: DataFrame, ref: DataFrame, source: str, steps=("exact", "contains", "fuzzy"),
                  metric: str = "levenshtein", threshold: float = 0.6) -> DataFrame:
    """Websites for one source's organizations without one, by the matching steps in order. Each
    step sees only the names the ones before left open."""
    left = org.where((F.col("source") == source) & T.is_blank("website")).select("id", "name")
    found = []
    for step in steps:
        tried = durable(MATCHERS[step](left, ref, threshold, metric))
        found.append(tried.where(F.col("match_url").isNotNull()).select("id", F.col("match_url").alias("website")))
        left = tried.where(F.col("match_url").isNull()).drop("match_url")
    return H.update_if(org, G.union_all(*found), "id", {"website": T.is_blank("website")})


def site_url(directories=(), placeholder: str = "") -> Column:
    """The address to read for an organization: its own, else its directory entry. An address on a
    directory is not read when the description is already good; otherwise an own one is used."""
    any_site = urls.with_scheme(T.first_nonempty("direct_website", "website", "directory_url"))
    if not directories:
        return any_site
    listed = T.words_regex(directories)
    own = urls.with_scheme(T.first_nonempty("direct_website", "website"))
    old = F.coalesce(F.col("description"), F.lit(""))
    good = (F.length(old) > 100) & ~old.contains(placeholder)
    return T.let(any_site, lambda s: F.when(~s.rlike(listed), s).when(~good, T.let(own, lambda o: F.when(~o.rlike(listed), o))))


PART_PAGES = 20  # page texts of a site in one part of its description


def enrich_descriptions(org: DataFrame, pages: DataFrame, docs: DataFrame, ledger: DataFrame, placeholder: str,
                        max_pages: int | None = None, directories=(), part_pages: int = PART_PAGES, min_len: int = 120) -> DataFrame:
    """Richer descriptions from the sitemap pages of each site, else its home page.

    ``docs`` (url, body) holds robots files and sitemaps; organizations in the ledger are left.
    A description comes in parts (id, part, n_parts, description) of the texts of ``part_pages``
    pages each, in the sitemap's order, so that no row or task holds a whole site; joined by spaces
    they are the description. ``max_pages`` reads only the first pages of a sitemap. As one text, a
    description must have ``min_len`` characters and be as long as the old one, or replace a
    placeholder; then it is led by the name unless it starts with it.
    """
    todo = C.remaining(org, ledger).withColumn("site", site_url(directories, placeholder)).where(F.col("site").isNotNull())
    # read several times below, so the open organizations are fixed once as narrow rows
    todo = durable(todo.select("id", "name", F.col("description").alias("old"), "site", urls.origin("site").alias("origin")))
    sites = todo.select("origin").distinct()
    robots = web.robots_sitemaps(docs.where(F.col("url").endswith("/robots.txt"))).select(
        urls.origin("url").alias("origin"), F.col("pos").alias("try"), "sitemap_url")
    usual = sites.select("origin", F.lit(None).cast("int").alias("try"), F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap_url"))
    known = docs.select(F.col("url").alias("sitemap_url"))
    # the first sitemap that exists, as the robots file orders them, then the usual address
    chosen = robots.unionByName(usual).join(known, "sitemap_url", "left_semi").groupBy("origin").agg(
        F.min_by("sitemap_url", F.struct(F.col("try").isNull().alias("usual"), F.col("try").alias("at"))).alias("sitemap_url"))
    listed = web.sitemap_urls(docs, max_pages).join(chosen, F.col("url") == F.col("sitemap_url")).select(
        "origin", "pos", F.col("page_url"))
    from_map = todo.select("id", "origin").join(listed, "origin").select("id", "pos", "page_url", F.lit(False).alias("is_home"))
    home = todo.select("id", F.lit(0).alias("pos"), F.rtrim("site", F.lit("/")).alias("page_url"), F.lit(True).alias("is_home"))
    asked = durable(from_map.unionByName(home))
    keyed = pages.withColumn("_key", F.rtrim("url", F.lit("/")))
    wanted = keyed.join(keys_of(asked, F.rtrim("page_url", F.lit("/")), "_key").hint("shuffle_hash"), "_key", "left_semi")
    # of pages that differ in a closing slash only, the first is read
    one = durable(first_per(wanted.select("_key", "page_id"), ["_key"], [F.col("page_id")]))
    texts = HT.html_text(C.wanted_pages(one, keyed), "frame").select("_key", "text").where(
        (F.length("text") > 80) & ~X.low_quality("text"))
    texts = durable(texts)
    texts = texts.withColumn("text", X.drop_urls("text")).where("text <> ''")
    read = asked.withColumn("_key", F.rtrim("page_url", F.lit("/"))).join(texts, "_key").select("id", "pos", "text", "is_home")
    mapped = read.where("NOT is_home")
    only_home = read.where("is_home").join(keys_of(mapped, "id", "id"), "id", "left_anti")
    used = durable(mapped.unionByName(only_home))
    # what the whole text decides: its length and its start
    facts = used.groupBy("id").agg(F.sum(F.length("text") + 1).alias("_n"), F.min_by(
        F.struct("text"), F.struct("pos", "text")).alias("_first"))
    old, name = F.col("old"), F.col("name")
    was = F.coalesce(old.contains(placeholder), F.lit(False))
    better = (F.col("_n") > min_len) & (was | (F.coalesce(F.length(old), F.lit(0)) < F.col("_n")))
    led = was & ~F.lower("_first.text").startswith(F.lower(name))
    chosen = todo.join(facts, "id").where(better).select("id", "old", F.when(led, F.concat(name, F.lit(". "))).otherwise("").alias("_lead"))
    parts = list_pages(used.join(chosen.select("id"), "id", "left_semi"), ["id"], [F.col("pos"), F.col("text")], F.col("text"), part_pages)
    whole = F.array_join("items", " ")
    made = parts.join(chosen, "id").select(
        "id", "old", F.col("page").alias("part"), F.ceil(F.col("n_items") / part_pages).alias("n_parts"),
        F.when(F.col("page") == 0, F.concat("_lead", whole)).otherwise(whole).alias("description"))
    return made.where((F.col("n_parts") > 1) | ~F.col("description").eqNullSafe(F.col("old"))).drop("old")


class Cleaned(NamedTuple):
    organizations: DataFrame
    duplicates: DataFrame
    coverage: DataFrame


def clean_catalogue(org: DataFrame, generic_prefix: str, bad=tuple(K.PLACEHOLDER_WEBSITES)) -> Cleaned:
    """Low-quality rows out, websites filled, placeholders and doubled URLs repaired, unused
    directory addresses claimed; with what stays shared or missing."""
    kept = H.fill_website(B.drop_low_quality(org, generic_prefix).withColumn("directory_url", T.blank_to_null("directory_url")))
    for c in ("website", "direct_website"):
        kept = H.null_out(kept, c, list(bad)).withColumn(c, urls.repair_url(c))
    kept = H.null_out(kept, "direct_website", [], same_as="website")
    final = E.fill_unique(kept)
    return Cleaned(final, A.duplicates(final, "website"), A.coverage(final, ["website", "description"]))


def repair_descriptions(org: DataFrame, features: DataFrame, markers=()) -> DataFrame:
    """Pop-ups and missing or marked descriptions restored from a map file (name, popup, pos)."""
    read = features.withColumn("found", F.struct(F.col("popup").alias("popup"), X.popup_description("popup", markers).alias("text")))
    joined = C.lookup_by_name(org, read, "found", "pos")
    bad = T.is_blank("description") | F.col("description").startswith("Title:")
    for m in markers:
        bad = bad | F.col("description").contains(m)
    text, popup = T.blank_to_null(F.col("found.text")), T.blank_to_null(F.col("found.popup"))
    return joined.withColumn("popup_html", F.coalesce(popup, F.col("popup_html"))).withColumn(
        "description", F.when(bad, F.coalesce(text, F.col("description"))).otherwise(F.col("description"))).drop("found")


class VectorIndex(NamedTuple):
    vectors: DataFrame
    chunks: DataFrame
    header: DataFrame


def build_vector_index(org: DataFrame, encoder=None, model: str = "hashed", chunk: int = 3000) -> VectorIndex:
    """Vectors of the located organizations, their coded chunks and the index header."""
    texts = B.has_geo(org).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), S.embed_text().alias("text"))
    vectors = durable(S.encode(texts, "text", encoder).drop("text"))
    return VectorIndex(vectors, files.vector_chunks(vectors, chunk), S.index_header(vectors, model, chunk))


def publish(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, id, statement): upserts for organizations, plain inserts for the refreshed rest."""
    parts = [render.sql_statements(df, name, "upsert" if name == "organizations" else "refresh").select(
        F.lit(name).alias("table_name"), F.col("id").cast("long").alias("id"), "statement") for name, df in tables.items()]
    return G.union_all(*parts)


class SearchView(NamedTuple):
    rows: DataFrame
    bounds: DataFrame


def search_view(results: DataFrame, org: DataFrame, **toggles) -> SearchView:
    """A search result (id, score, rank) as percentages on the visible organizations, with bounds."""
    ranked = E.rank_percent(results.drop("rank"), [F.col("score").desc(), F.col("id")]).select("id", "score", "rank", "pct", "total")
    visible = B.toggles(org, results, **toggles).select("id", "name", "latitude", "longitude")
    return SearchView(visible.join(ranked, "id"), A.bounds(org.join(results.select("id"), "id", "left_semi")))
