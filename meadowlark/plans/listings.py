"""Jobs that find and refine listings on the pages of organizations.

Pages come as a table (page_id, url, html). Each job tests pages before joining, takes
text only of the pages it keeps, and reads every page once however many rows need it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions import dates, urls
from meadowlark.functions import extract as X
from meadowlark.functions import text as T
from meadowlark.operators import aggregates as A
from meadowlark.operators import events as E
from meadowlark.operators import filters as B
from meadowlark.operators import html as HT
from meadowlark.operators import joins as C
from meadowlark.operators import mutations as H
from meadowlark.operators.ranking import dedupe_first
from meadowlark.scale import first_per, keys_of
from meadowlark.session import durable


class Discovered(NamedTuple):
    jobs: DataFrame
    stays: DataFrame
    organizations: DataFrame


def _listing_text(found: DataFrame, pages: DataFrame, profile: str, **facts) -> DataFrame:
    """``found`` (with page_id) and the text of its pages, taken once per page and given to every
    site that has the page. ``facts`` are further columns of the page, made from html, text and url;
    bodies stay behind."""
    found = durable(found)
    read = HT.html_text(C.wanted_pages(found, pages).select("page_id", "html", F.col("url").alias("page_url")), profile)
    once = read.select("page_id", "text", *[c.alias(n) for n, c in facts.items()])
    return found.join(once, "page_id")


def _flagged(org: DataFrame, done: DataFrame, **found: DataFrame) -> DataFrame:
    """Flags of the processed organizations set from whether anything was found for them."""
    out = org.join(done.select(F.col("id").alias("_done")), F.col("id") == F.col("_done"), "left")
    for flag, rows in found.items():
        owner = keys_of(rows, "organization_id", "_owner")
        out = out.join(owner, F.col("id") == F.col("_owner"), "left").withColumn(
            flag, F.when(F.col("_done").isNotNull(), F.col("_owner").isNotNull()).otherwise(F.col(flag))).drop("_owner")
    return out


def job_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    return C.discover_page(sites, pages, K.JOB_PATHS, C.page_passes("html", K.JOB_PAGE_KEYWORDS))


def stay_pages(sites: DataFrame, pages: DataFrame) -> DataFrame:
    return C.discover_page(sites, pages, K.STAY_PATHS, C.page_passes("html", K.STAY_PAGE_KEYWORDS))


def discover_jobs_stays(org: DataFrame, pages: DataFrame, jobs: DataFrame, stays: DataFrame, now) -> Discovered:
    """First fitting job and stay page of every pending site, turned into listings."""
    todo = durable(B.allowed_urls(B.pending(org, "last_scrape_attempt", "being_processed_since"), "website",
                                  paths=K.BLOCKED_PATH_PREFIXES).select("id", "name", "website"))
    at = dates.moment(now)
    texts = _listing_text(job_pages(todo, pages).select("id", "name", "url", "page_id"), pages, "simple")
    new_jobs = durable(
        texts.select("id", F.inline(X.job_blocks("text", F.col("name"), K.JOB_FIRST_TERMS, 120)))
        .select(F.col("id").alias("organization_id"), "title", F.col("block").alias("description"), "role",
                at.alias("created_at")))
    plain = _listing_text(stay_pages(todo, pages).select("id", "name", "url", "page_id"), pages, "simple",
                          features=X.booking_features("html", "text", "page_url"))
    new_stays = durable(plain.select(
        F.col("id").alias("organization_id"), F.concat(F.lit("Stay at "), "name").alias("title"),
        F.col("text").alias("description"), F.lit("accommodation").alias("stay_type"),
        X.booking_class(F.col("features")).alias("booking_type"), F.col("features").alias("booking_analysis"),
        F.col("url").alias("booking_url"), at.alias("created_at")))
    flagged = _flagged(org, todo, has_jobs=new_jobs, has_stays=new_stays)
    done = F.col("_done").isNotNull()
    organizations = flagged.withColumn("last_scrape_attempt", F.when(done, at).otherwise(F.col("last_scrape_attempt"))).drop("_done")
    return Discovered(H.replace_children(jobs, new_jobs), stays.unionByName(new_stays, allowMissingColumns=True), organizations)


def board_jobs(org: DataFrame, pages: DataFrame) -> DataFrame:
    """The older variant: pages that speak of work, split at their headings."""
    fits = X.relevant(X.text_simple("html"), K.JOB_BOARD_TERMS, 2, 200)
    found = C.discover_page(org, pages, K.JOB_DETAIL_PATHS, fits)
    texts = _listing_text(found.select("id", "url", "page_id"), pages, "lines")
    return texts.select(F.col("id").alias("organization_id"), "url", F.inline(X.title_blocks("text")))


def board_stays(org: DataFrame, pages: DataFrame) -> DataFrame:
    """The older variant: pages that speak of lodging, one stay each."""
    fits = X.relevant(X.text_simple("html"), K.STAY_BOARD_TERMS, 2, 150)
    found = C.discover_page(org, pages, K.STAY_PATHS, fits)
    texts = _listing_text(found.select("id", "url", "page_id"), pages, "simple")
    return texts.select(F.col("id").alias("organization_id"), "url", X.stay_listing("text").alias("s")).select(
        "organization_id", "url", "s.*")


def _event_url_ok(url) -> Column:
    return B.is_allowed_url(url, K.EVENT_BLOCKED_HOSTS, K.EVENT_BLOCKED_PATHS)


def _events_of(owners: DataFrame, pages: DataFrame) -> DataFrame:
    """Events of the pages owners point to (id, page_id, order), unique by title per owner."""
    wanted = C.wanted_pages(owners, pages)
    blocks = E.event_blocks(wanted)
    mine = owners.join(blocks, "page_id").withColumn("_order", F.struct("order", "page_id", "pos"))
    return dedupe_first(mine, "title", [F.col("_order")], ["id"]).select(
        F.col("id").alias("organization_id"), "title", "description", F.lit("event").alias("event_type"),
        "start_raw", "end_raw", dates.parse_date("start_raw").alias("start_date"), dates.parse_date("end_raw").alias("end_date"),
        "is_online", "is_in_person", "registration_url", "event_url")


class DiscoveredEvents(NamedTuple):
    events: DataFrame
    organizations: DataFrame


def discover_events(org: DataFrame, pages: DataFrame, now) -> DiscoveredEvents:
    """Events on the event pages of every site; sites without any follow the event links of
    their home page."""
    sites = durable(org.where(~T.is_blank("website")).select("id", "website"))
    ok = pages.where(_event_url_ok("url"))
    direct = C.site_pages(sites, ok, K.EVENT_PATHS, F.lit(True)).select("id", "page_id", F.col("path_pos").alias("order"))
    first = durable(_events_of(durable(direct), ok))
    quiet = sites.join(keys_of(first, "organization_id", "id"), "id", "left_anti").withColumn("_base", urls.base_url("website"))
    homes = ok.select("page_id", F.rtrim("url", F.lit("/")).alias("_home"))
    home = durable(quiet.join(homes, F.col("_base") == F.col("_home")).select("id", "page_id"))
    named = C.links(C.wanted_pages(home, ok).select("page_id", "url", "html")).where(
        F.lower("href").rlike(T.words_regex(K.EVENT_LINK_WORDS)) & _event_url_ok("href"))
    target = ok.select(F.col("page_id").alias("_target"), F.col("url").alias("_to"))
    followed = home.select("id", "page_id").join(named.select("page_id", "pos", "href"), "page_id").join(
        target, F.col("href") == F.col("_to")).select("id", F.col("_target").alias("page_id"), F.col("pos").alias("order"))
    second = _events_of(durable(followed), ok)
    events = durable(first.unionByName(second))
    flagged = _flagged(org, org.select("id"), has_events=events).drop("_done")
    return DiscoveredEvents(events, flagged.withColumn("events_scraped_at", dates.moment(now)))


def refine_jobs(org: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs of unprocessed organizations, read again with attributes; parents without new rows keep theirs."""
    todo = B.allowed_urls(C.parents_pending(org, jobs, "jobs_rescraped"), "website").select("id", "name", "website")
    found = C.discover_page(todo, pages, K.JOB_DETAIL_PATHS, C.page_passes("html", K.JOB_PAGE_KEYWORDS))
    texts = _listing_text(found.select("id", "name", "url", "page_id"), pages, "full", page_email=X.contact_email("html"))
    blocks = texts.select("id", "url", "page_email", F.inline(X.job_blocks("text", F.col("name"))))
    new = blocks.select("id", "url", "page_email", "title", "role", X.lead_sentences("block").alias("description"),
                        X.job_attributes("block").alias("a")).select(
        F.col("id").alias("organization_id"), "title", "description", "role", "a.skills_needed", "a.commitment",
        "a.start_date", "a.end_date", "a.remote_options", F.col("page_email").alias("application_email"),
        F.col("url").alias("source_url"))
    return H.replace_children(jobs, durable(new))


class RefinedStays(NamedTuple):
    stays: DataFrame
    summary: DataFrame


def refine_stays(stays: DataFrame, org: DataFrame, pages: DataFrame) -> RefinedStays:
    """Price, types, booking class and title of each open stay from its booking page."""
    work = C.stay_work(stays, org).select("id", "booking_url", "org_name")
    wanted = pages.join(keys_of(work, "booking_url", "url").hint("shuffle_hash"), "url", "left_semi")
    text = HT.html_text(wanted, "full").withColumn("text", X.clean_text("text"))
    read = text.select("url", X.booking_features_fine("html", "text", "url").alias("booking_analysis"), X.price_info("text").alias("price_info"),
                       X.stay_types("text").alias("stay_type"), X.stay_title("html", F.lit("")).alias("page_title"),
                       F.col("text").alias("description"), "page_id")
    one = durable(first_per(read, ["url"], [F.col("page_id")]))
    delta = work.join(one, F.col("booking_url") == F.col("url")).select(
        "id", F.when(F.col("page_title") == "Stay at ", F.concat("page_title", "org_name")).otherwise(F.col("page_title")).alias("title"),
        "description", "stay_type", "price_info", X.booking_class(F.col("booking_analysis")).alias("booking_type"),
        "booking_analysis", F.lit(1).alias("rescraped"))
    always = {c: F.lit(True) for c in ("title", "description", "stay_type", "price_info", "booking_type", "booking_analysis", "rescraped")}
    refined = H.update_if(stays, delta, "id", always)
    return RefinedStays(refined, A.value_counts(refined, "booking_type"))


def refine_events(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Typed dates from stored texts; then dates, flags and links found on each event page, given
    to every event of the page."""
    typed = events.withColumn("start_date", F.coalesce("start_date", dates.parse_date("start_raw"))).withColumn(
        "end_date", F.coalesce("end_date", dates.parse_date("end_raw")))
    asked = A.representatives(typed, "event_url", ("id",)).where(B.is_allowed_url("event_url", ("facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com")))
    wanted = pages.join(asked.select(F.col("event_url").alias("url")).hint("shuffle_hash"), "url", "left_semi")
    read = E.resolve_event_dates(wanted).join(wanted.select("page_id", "url"), "page_id")
    one = first_per(read, ["url"], [F.col("page_id")]).select(
        F.col("url").alias("event_url"), F.col("start_date").alias("_start"), F.col("end_date").alias("_end"),
        F.col("is_online").alias("_online"), F.col("is_in_person").alias("_person"), F.col("video_url").alias("_video"))
    return C.propagate(typed, durable(one), "event_url").select(
        *[c for c in typed.columns if c not in ("start_date", "end_date", "is_online", "is_in_person", "registration_url")],
        F.coalesce("start_date", "_start").alias("start_date"), F.coalesce("end_date", "_end").alias("end_date"),
        F.coalesce("_online", "is_online").alias("is_online"), F.coalesce("_person", "is_in_person").alias("is_in_person"),
        F.coalesce(T.blank_to_null("registration_url"), T.blank_to_null("_video")).alias("registration_url"))


def redescribe_jobs(jobs: DataFrame, org: DataFrame, pages: DataFrame) -> DataFrame:
    """Better titles and descriptions from the source page, one reading per URL, applied to all its jobs."""
    open_ = B.not_like(jobs.where(~T.is_blank("source_url")), "source_url", "%expireddomains%")
    named = C.with_parent(open_, org, ("name",))
    first = first_per(named, ["source_url"], [F.col("id")]).select("source_url", "org_name")
    fit = pages.where((F.length("html") >= 200) & B.is_allowed_url("url")).select("page_id", "url")
    met = durable(first_per(first.join(fit, F.col("source_url") == F.col("url")), ["source_url"], [F.col("page_id")]).drop("url"))
    bodies = pages.select("page_id", "html").join(met.hint("shuffle_hash"), "page_id")
    text = HT.html_text(bodies.select("source_url", "org_name", "html"), "full")
    parts = text.select("source_url", "org_name", "text", X.page_title("html").alias("page_title"), X.page_h1("html").alias("h1"),
                        X.meta_description("html").alias("meta"))
    made = parts.where((F.length("text") >= 50) | F.col("meta").isNotNull()).select(
        "source_url", X.job_title("h1", "page_title", "org_name").alias("_title"),
        X.job_description("text", "page_title", "org_name", "meta").alias("_description"))
    out = C.propagate(jobs, durable(made), "source_url")
    return out.select(*[c for c in jobs.columns if c not in ("title", "description")],
                      F.when(F.length("_title") > 5, F.col("_title")).otherwise(F.col("title")).alias("title"),
                      F.when(F.length("_description") > 50, F.col("_description")).otherwise(F.col("description")).alias("description"))
