"""Events on pages: listings, dates and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions import extract as X
from meadowlark.functions import text as T
from meadowlark.operators.ranking import dedupe_first
from meadowlark.scale import first_per
from meadowlark.sources import web

_FIELDS = ("title", "description", "start_raw", "end_raw", "is_online", "is_in_person", "registration_url", "event_url")


# --- containers ------------------------------------------------------------------------

def _closed_pieces(html: Column, tags: str) -> Column:
    """The markup cut after every end tag of ``tags``; what no end tag closes is left away. One pass."""
    end = rf"</(?:{tags})>"
    return F.filter(T.extract_all(html, rf"(?is).*?(?:{end}|\z)"), lambda p: p.rlike(rf"(?i){end}$"))


def marked_containers(html: Column) -> Column:
    """Of every piece that an end tag closes, what follows the first start tag with an event word in class or id."""
    tags = K.EVENT_MARKED_TAGS
    start = rf"<(?:{tags})[^>]*?(?:class|id)=[\"'][^\"']*(?:{K.EVENT_MARKS})[^\"']*[\"'][^>]*>"
    marked = F.filter(_closed_pieces(html, tags), lambda p: p.rlike(rf"(?is){start}"))
    return F.transform(marked, lambda p: F.regexp_extract(p, rf"(?is){start}(.*)</(?:{tags})>$", 1))


def _until_closed(html: Column, states: int, reach) -> Column:
    """Containers from a start tag to the first end tag after something was found in them.

    One fold over the pieces: outside a container it looks for a start tag and goes on behind it;
    ``reach(markup, state)`` tells how far the search is after a piece (0 to ``states``, which is
    found). Only piece numbers are carried, so a container that opens early costs nothing.
    """
    tags = K.EVENT_DATED_TAGS
    start = rf"(?is)^.*?<(?:{tags})[^>]*>(.*)$"

    def fold(pieces):
        seen = F.transform(pieces, lambda p, i: T.let(F.when(p.rlike(start), F.regexp_extract(p, start, 1)), lambda rest: F.struct(
            i.alias("i"), rest.isNotNull().alias("opens"), reach(rest, F.lit(0)).alias("fresh"),
            F.array(*[reach(p, F.lit(k)) for k in range(states)]).alias("later"))))
        none = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("state"), F.array().cast("array<struct<a: int, b: int>>").alias("found"))

        def step(acc, x):
            at = F.when(acc["at"] >= 0, acc["at"]).when(x["opens"], x["i"]).otherwise(-1)
            state = F.when(acc["at"] >= 0, F.get(x["later"], acc["state"])).when(x["opens"], x["fresh"]).otherwise(0)
            return T.let(F.struct(at.alias("at"), state.alias("state")), lambda now: F.when(
                now["state"] == states, F.struct(F.lit(-1).alias("at"), F.lit(0).alias("state"), F.concat(
                    acc["found"], F.array(F.struct(now["at"].alias("a"), x["i"].alias("b")))).alias("found"))).otherwise(
                F.struct(now["at"].alias("at"), now["state"].alias("state"), acc["found"].alias("found"))))

        ranges = F.aggregate(seen, none, step, lambda acc: acc["found"])
        return F.transform(ranges, lambda r: F.regexp_replace(F.concat(
            F.regexp_extract(F.get(pieces, r["a"]), start, 1), F.array_join(F.slice(pieces, r["a"] + 2, r["b"] - r["a"]), "")),
            rf"(?i)</(?:{tags})>$", ""))

    return T.let(_closed_pieces(html, tags), fold)


def dated_containers(html: Column) -> Column:
    """Containers up to the end tag after the first date in them."""
    return F.array_distinct(_until_closed(html, 1, lambda m, _: F.coalesce(m.rlike(rf"(?i){K.EVENT_BLOCK_DATE}"), F.lit(False)).cast("int")))


def timed_containers(html: Column) -> Column:
    """Containers up to the end tag after the first ``<time>`` element in them."""
    def reach(m, state):
        opened = F.when(state == 1, m).otherwise(F.regexp_extract(m, r"(?is)^.*?<time[^>]*>(.*)$", 1))
        closes = opened.rlike(r"(?i)</time>")
        return F.when(F.coalesce(closes, F.lit(False)), 2).when(F.coalesce((state == 1) | m.rlike(r"(?i)<time[^>]*>"), F.lit(False)), 1).otherwise(0)

    return _until_closed(html, 2, reach)


# --- listings --------------------------------------------------------------------------

def _block_event(block: Column, url: Column, title_chars: int | None, max_len: int | None) -> Column:
    """One listing from the markup of its container."""
    heading = X.text_simple(T.extract(block, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"))

    def listing(text):
        lead = T.prefix(F.get(F.split(text, r"[.!?]\s+", 2), F.lit(0)), title_chars)
        return T.let(X.event_dates(text), lambda found: F.struct(
            F.coalesce(T.blank_to_null(heading), lead).alias("title"), T.prefix(text, max_len).alias("description"),
            F.get(found, F.lit(0)).alias("start_raw"), F.get(found, F.lit(1)).alias("end_raw"),
            text.rlike(K.BLOCK_ONLINE).alias("is_online"), text.rlike(K.BLOCK_IN_PERSON).alias("is_in_person"),
            X.registration_link(block, url).alias("registration_url"), url.alias("event_url"), F.length(text).alias("n")))

    return T.let(X.text_simple(block), listing)


def _worth_keeping(e: Column) -> Column:
    return (e["n"] >= 20) & ~X.is_junk_event(e["title"], e["description"], e["start_raw"])


def _calendar_event(html: Column, url: Column, text: Column, kind: Column, feed: Column, max_len: int | None) -> Column:
    """The whole page as one listing, when it is a calendar without listings."""
    shown = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    embedded = F.concat(F.lit("Embedded "), kind, F.lit(" calendar detected. "), T.prefix(text, max_len),
                        F.coalesce(F.concat(F.lit(" Feed: "), feed), F.lit("")))
    return F.struct(
        F.when(kind.isNotNull(), F.concat(F.lit("Calendar ("), shown, F.lit(")"))).otherwise("Events & Programs").alias("title"),
        F.coalesce(embedded, T.prefix(text, max_len)).alias("description"),
        F.lit(None).cast("string").alias("start_raw"), F.lit(None).cast("string").alias("end_raw"),
        text.rlike(K.BLOCK_ONLINE).alias("is_online"), text.rlike(K.BLOCK_IN_PERSON).alias("is_in_person"),
        feed.alias("registration_url"), url.alias("event_url"), F.length(text).alias("n"))


def _structured_event(item: Column) -> Column:
    e = web.event_item(item)
    return T.let(e, lambda x: F.struct(
        *[x[f].alias(f) for f in _FIELDS[:6]], F.lit(None).cast("string").alias("registration_url"),
        x["url"].alias("event_url"), F.length(x["description"]).alias("n")))


def event_listings(html: Column, url: Column, title_chars: int | None = None, max_len: int | None = None) -> Column:
    """array of listings of one page: structured data, then marked containers, dated ones if
    there are fewer than two, timed ones if still so; a page without any is taken whole when
    it is a calendar. Junk is dropped. Titles without a heading and descriptions may be cut."""
    found = T.let(marked_containers(html), lambda x: F.when(F.size(x) < 2, F.concat(x, dated_containers(html))).otherwise(x))
    found = T.let(found, lambda x: F.when(F.size(x) < 2, F.concat(x, timed_containers(html))).otherwise(x))
    blocks = F.filter(F.transform(found, lambda b: _block_event(b, url, title_chars, max_len)), _worth_keeping)
    items = F.transform(F.filter(web.jsonld_array(html), web.is_event_item), _structured_event)
    whole = T.let(X.text_simple(html), lambda text: F.when(
        (F.size(T.extract_all(text, K.DATE_MENTION, 1)) >= 3) | text.rlike(K.EVENT_PAGE_WORDS),
        T.let(X.calendar_system(html), lambda kind: T.let(
            X.calendar_feed(html, url), lambda feed: _calendar_event(html, url, text, kind, feed, max_len)))))
    calendars = F.filter(F.array(whole), lambda e: e.isNotNull() & _worth_keeping(e))
    return T.let(F.concat(items, blocks), lambda every: F.when(F.size(every) > 0, every).otherwise(calendars))


def event_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, listing fields), titles unique per page. Everything is found inside the row
    of its page, so pages are read once and only listings are shuffled."""
    rows = pages.select("page_id", F.posexplode(event_listings(F.col("html"), F.col("url"))).alias("pos", "e"))
    listed = rows.select("page_id", "pos", *[F.col(f"e.{f}").alias(f) for f in _FIELDS])
    return dedupe_first(listed, "title", [F.col("pos")], ["page_id"])


def resolve_event_dates(pages: DataFrame) -> DataFrame:
    """(page_id, start_date, end_date, online flags, video_url): structured data, then meta tags,
    then dated phrases of 2024 or later; a start at midnight takes the first clock time."""
    first = first_per(web.jsonld_events(web.jsonld_items(pages)), ["page_id"], [F.col("pos")]).select(
        F.col("page_id").alias("_page"), F.col("start_date").alias("_start"), F.col("end_date").alias("_end"),
        F.col("is_online").alias("_online"), F.col("is_in_person").alias("_person"), F.col("video_url").alias("_video"))
    text = F.col("_text")
    own = pages.select("page_id", "html", X.text_simple("html").alias("_text")).select(
        "page_id", X.page_start_date("html", text).alias("start2"), X.page_end_date("html").alias("end2"),
                       X.video_link("html", text).alias("video2"), X.is_online(text).alias("online2"),
                       X.is_in_person(text).alias("person2"), text)
    both = own.join(first, F.col("page_id") == F.col("_page"), "left")
    start = F.coalesce("_start", "start2")
    known = F.col("_page").isNotNull()
    return both.select(
        "page_id", X.with_clock(start, F.col("_text")).alias("start_date"), F.coalesce("_end", "end2").alias("end_date"),
        F.when(known, F.col("_online")).otherwise(F.col("online2")).alias("is_online"),
        F.when(known, F.col("_person")).otherwise(F.col("person2")).alias("is_in_person"),
        T.first_nonempty("_video", "video2").alias("video_url"))

