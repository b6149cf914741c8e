"""Column functions that read facts out of page text and markup.

All of them are built from native expressions, so a page body is scanned inside
the JVM and never copied per pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions import dates, urls
from meadowlark.functions.text import (
    any_of, blank_to_null, col, extract, extract_all, first_fitting, first_match, html_unescape, let, mentions,
    prefix, score_terms, squeeze, strip, words_regex,
)

# --- markup ------------------------------------------------------------------------


def text_simple(html, skip: Sequence[str] = tuple(K.SKIP_TAGS_SIMPLE)) -> Column:
    """Visible text by expressions only: comments, skipped elements and tags removed."""
    tags = "|".join(skip)
    out = F.regexp_replace(col(html), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?is)<(?:{tags})\b[^>]*>.*?</(?:{tags})\s*>", " ")
    return squeeze(html_unescape(F.regexp_replace(out, r"(?s)<[^>]+>", " ")))


def strip_tags(c, by: str = "") -> Column:
    return F.regexp_replace(col(c), r"(?s)<[^>]+>", by)


def page_title(html) -> Column:
    return blank_to_null(squeeze(html_unescape(extract(html, r"(?is)<title[^>]*>(.*?)</title>"))))


def page_h1(html) -> Column:
    return blank_to_null(squeeze(html_unescape(strip_tags(extract(html, r"(?is)<h1[^>]*>(.*?)</h1>")))))


def meta_description(html) -> Column:
    """The description meta tags of a page when long enough (over 30 characters)."""
    named = squeeze(extract(html, r"(?i)<meta\s+name=[\"']description[\"']\s+content=[\"']([^\"']{20,})[\"']"))
    graph = squeeze(extract(html, r"(?i)<meta\s+property=[\"']og:description[\"']\s+content=[\"']([^\"']{20,})[\"']"))
    return F.coalesce(F.when(F.length(named) > 30, named), F.when(F.length(graph) > 30, graph))


def long_paragraph(html, min_len: int = 50, max_len: int | None = None) -> Column:
    paragraphs = F.transform(extract_all(html, r"(?s)<p[^>]*>(.*?)</p>", 1), lambda p: strip(strip_tags(p)))
    return prefix(F.get(F.filter(paragraphs, lambda p: F.length(p) > min_len), F.lit(0)), max_len)


def listing_description(html, max_len: int | None = None) -> Column:
    """Description of a directory entry: either meta tag, else its first long paragraph, else ''."""
    tags = [strip(extract(html, p)) for p in
            (r'og:description"[^>]*content="([^"]+)"', r'name="description"[^>]*content="([^"]+)"')]
    return F.coalesce(*[F.when(F.length(t) > 30, prefix(t, max_len)) for t in tags], long_paragraph(html, max_len=max_len), F.lit(""))


def hrefs(html) -> Column:
    return extract_all(html, r"href=[\"']([^\"']+)[\"']", 1)


def anchors(html) -> Column:
    """array<struct<text, href>> of the anchors with text, in page order."""
    found = extract_all(html, r"(?is)(<a\s[^>]*?href=[\"'][^\"']+[\"'][^>]*>.*?</a>)", 1)
    pairs = F.transform(
        found,
        lambda a: F.struct(
            squeeze(html_unescape(strip_tags(F.regexp_extract(a, r"(?is)^<a\s[^>]*>(.*)</a>$", 1)))).alias("text"),
            html_unescape(F.regexp_extract(a, r"(?is)href=[\"']([^\"']+)[\"']", 1)).alias("href"),
        ),
    )
    return F.filter(pairs, lambda p: p["text"] != "")


def is_page_link(href: Column) -> Column:
    return ~href.rlike(f"^(?:{words_regex(K.LINK_SKIP_PREFIXES)})")


def geo_point(html) -> Column:
    """struct<latitude, longitude> of the first coordinate pattern, NULL if none."""
    points = []
    for p in K.GEO_PATTERNS:
        lat, lon = F.regexp_extract(col(html), p, 1), F.regexp_extract(col(html), p, 2)
        points.append(F.when(lat != "", F.struct(
            lat.try_cast("double").alias("latitude"), lon.try_cast("double").alias("longitude"))))
    return F.coalesce(*points)


def own_website(html, url) -> Column:
    """og:url, else the first off-site link that is not a social network, else ''."""
    site = urls.host(url)
    outside = F.filter(
        anchors(html),
        lambda a: a["href"].startswith("http") & ~a["href"].contains(site)
        & ~a["href"].rlike(words_regex(K.SOCIAL_WORDS)),
    )
    return F.coalesce(extract(html, r'og:url"[^>]*content="([^"]+)"'), F.get(outside, F.lit(0))["href"], F.lit(""))


def popup_description(html, markers: Sequence[str] = ()) -> Column:
    """First paragraph of a pop-up, else the text after its heading; marked texts are refused."""
    def usable(c):
        text = squeeze(strip_tags(c, " "))
        bad = any_of([text.startswith("Title:")] + [text.contains(m) for m in markers])
        return F.when((text != "") & ~bad, text)

    inner = extract(html, r"(?s)<p>(.*?)</p>")
    after = extract(html, r"(?s)</strong>(.*?)(?:<br>|<span|<div|<a|<small|$)")
    return F.coalesce(usable(inner), usable(after), F.lit(""))


# --- contacts -----------------------------------------------------------------------

def emails(c) -> Column:
    return F.array_distinct(extract_all(c, K.EMAIL))


def contact_email(html) -> Column:
    """First personal mailbox, else the first mailbox at all."""
    generic = f"^(?:{words_regex(K.GENERIC_MAILBOXES)})"

    def pick(found):
        personal = F.filter(found, lambda e: ~F.lower(e).rlike(generic))
        return F.coalesce(F.get(personal, F.lit(0)), F.get(found, F.lit(0)))

    return let(extract_all(html, K.EMAIL), pick)


def listing_email(text) -> Column:
    first = extract(text, K.EMAIL, 0)
    return F.when(first.isNotNull() & ~first.rlike(words_regex(K.EMAIL_NOISE)), first).otherwise(F.lit(""))


def _first(items, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def page_urls(c, limit: int | None = None) -> Column:
    return _first(extract_all(c, K.PAGE_URL), limit)


def social_handles(c, per_network: int | None = None, limit: int | None = None) -> Column:
    found = [_first(F.array_distinct(extract_all(c, p, 1)), per_network) for p in K.SOCIAL_HANDLES]
    return _first(F.array_distinct(F.concat(*found)), limit)


# --- cleaning -----------------------------------------------------------------------

def clean_text(c) -> Column:
    """Link markers, boilerplate phrases and leading separators removed."""
    out = F.regexp_replace(col(c), r"\[LINK:[^\]]+\]", "")
    for phrase in K.NAV_PHRASES:
        out = F.regexp_replace(out, f"(?i)(?:{phrase})", "")
    return strip(F.regexp_replace(squeeze(out), r"^[|·–—\s]+", ""))


def drop_urls(c, max_len: int | None = None) -> Column:
    out = squeeze(F.regexp_replace(squeeze(c), r"https?://\S+", ""))
    return out if max_len is None else prefix(out, max_len)


def strip_markdown(c) -> Column:
    out = F.regexp_replace(col(c), r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"#+\s*", "")
    out = F.regexp_replace(out, r"[\*_]{1,3}", "")
    return squeeze(F.regexp_replace(out, r"(?m)^[\*\-]\s+", ""))


def markdown_block(c, max_len: int | None = None) -> Column:
    """First block between headings that speaks of a community, else the whole text if over 60 characters."""
    def best(body):
        blocks = F.transform(F.split(body, r"\n#{1,3}\s+"), strip_markdown)
        topical = F.get(F.filter(blocks, lambda b: mentions(b, K.COMMUNITY_WORDS)), F.lit(0))
        long_whole = let(strip_markdown(body), lambda whole: F.when(F.length(whole) > 60, whole))
        return prefix(F.coalesce(topical, long_whole), max_len)

    after = F.element_at(F.split(col(c), "Markdown Content:", 2), -1)
    return F.when(col(c).contains("Markdown Content:"), let(strip(after), best))


def low_quality(c) -> Column:
    return F.coalesce(mentions(c, K.LOW_QUALITY_PHRASES), F.lit(False)) | col(c).isNull() | (col(c) == "")


def relevant(c, terms: Sequence[str], at_least: int = 2, min_len: int = 200) -> Column:
    return (score_terms(c, terms) >= at_least) & (F.length(col(c)) > min_len)


# --- jobs ---------------------------------------------------------------------------

def job_role(c) -> Column:
    low = F.lower(col(c))
    return (
        F.when(low.contains("intern"), "internship")
        .when(low.contains("apprentice"), "apprenticeship")
        .when(low.rlike(words_regex(K.PAID_WORDS)), "paid_job")
        .otherwise("volunteer")
    )


def skills(c, max_len: int | None = None) -> Column:
    found = first_fitting(c, K.SKILLS_PATTERNS, 1, lambda x: (F.length(x) > 10) & (F.length(x) < 300),
                          lambda x: F.rtrim(strip(x), F.lit(",.;:")))
    return prefix(found, max_len)


def commitment(c, max_len: int | None = None) -> Column:
    return prefix(first_fitting(c, K.COMMITMENT_PATTERNS, 0, lambda x: (F.length(x) > 3) & (F.length(x) < 200), strip), max_len)


def remote(c) -> Column:
    return any_of([col(c).rlike(p) for p in K.REMOTE_PATTERNS])


def job_attributes(text, html=None) -> Column:
    return F.struct(
        skills(text).alias("skills_needed"),
        commitment(text).alias("commitment"),
        dates.parse_date(extract(text, K.START_DATE)).alias("start_date"),
        dates.parse_date(extract(text, K.END_DATE)).alias("end_date"),
        remote(text).alias("remote_options"),
        contact_email(text if html is None else html).alias("application_email"),
    )


def _cut_suffix(c) -> Column:
    return strip(F.regexp_replace(squeeze(c), r"\s*[|–—-]\s*.*$", ""))


def job_title(h1, title, org_name) -> Column:
    """First usable of heading and page title, suffixes cut; else a generic one."""
    titles = F.array(_cut_suffix(h1), F.regexp_replace(_cut_suffix(title), r"(?i)^Home\s*[-|]\s*", ""))

    def good(t):
        words = F.split(t, r"\s+")
        capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        return (
            t.isNotNull() & (F.length(t) > 5) & (F.length(t) < 80)
            & ~mentions(t, K.TITLE_JUNK) & (F.lower(t) != F.lower(col(org_name)))
            & ~((F.size(words) > 8) & (capitals > F.size(words) * 0.7))
        )

    return F.coalesce(F.get(F.filter(titles, good), F.lit(0)), F.concat(F.lit("Volunteer at "), col(org_name)))


def _first_sentence(c, fallback=None, max_len: int | None = None) -> Column:
    first = prefix(F.get(F.split(col(c), r"[.!?]\s+", 2), F.lit(0)), max_len)
    cleaned = clean_text(first)
    return cleaned if fallback is None else F.when(F.length(cleaned) < 5, fallback).otherwise(cleaned)


def _listing(block, org_name, role, title_chars: int | None) -> Column:
    return F.struct(
        _first_sentence(block, F.concat(F.lit("Opportunity at "), col(org_name)), title_chars).alias("title"),
        block.alias("block"), role.alias("role"),
    )


def job_blocks(text, org_name, terms: Sequence[str] = tuple(K.JOB_TERMS), min_len: int = 100,
               title_chars: int | None = None) -> Column:
    """array<struct<title, block, role>>: text parts before capitals headings that speak of
    jobs; without any, the whole page if it does."""
    def blocks(body):
        parts = F.transform(F.split(body, K.CAPS_HEADING_SPLIT), strip)
        hits = F.filter(parts, lambda b: (F.length(b) >= min_len) & (score_terms(b, terms) >= 2))
        whole = F.array(_listing(body, org_name, F.lit("volunteer"), title_chars))
        fits = (F.length(body) > 300) & (score_terms(body, terms) >= 3)
        return let(F.transform(hits, lambda b: _listing(b, org_name, job_role(b), title_chars)),
                   lambda found: F.when((F.size(found) == 0) & fits, whole).otherwise(found))

    # a page under 200 characters has no listing
    return let(F.when(F.length(col(text)) >= 200, clean_text(text)).otherwise(F.lit("")), blocks)


def _is_title_line(line: Column) -> Column:
    upper = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    title = line.rlike(r"\p{Lu}") & ~line.rlike(r"(?<!\p{L})\p{Ll}") & ~line.rlike(r"\p{L}\p{Lu}")
    return (F.length(line) < 100) & (upper | title | line.endswith(":"))


def title_blocks(text, title_chars: int | None = None, max_len: int | None = None) -> Column:
    """array<struct<title, description>>: a short heading line starts a listing. Needs text
    with its line breaks; without any listing, the whole text is one."""
    lines = F.filter(F.transform(F.split(col(text), r"\n"), strip), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.when(_is_title_line(x), F.concat(F.lit("\u0001"), x)).otherwise(x))
    def listings(pieces):
        # the piece before the first heading belongs to no listing
        headed = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.filter(F.transform(headed, lambda p: F.struct(
            prefix(F.get(F.split(p, r"\n", 2), F.lit(0)), title_chars).alias("title"),
            prefix(strip(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"\n", " ")), max_len).alias("description"),
        )), lambda x: F.length(x["description"]) > 50)

    whole = F.array(F.struct(
        prefix(F.get(F.split(col(text), r"\. ", 2), F.lit(0)), title_chars).alias("title"),
        prefix(col(text), max_len).alias("description"),
    ))
    return let(listings(F.split(F.array_join(marked, "\n"), "\u0001")), lambda kept: F.when(
        (F.size(kept) == 0) & (F.length(col(text)) > 200), whole).otherwise(kept))


# --- sentences ------------------------------------------------------------------------

def sentences(c) -> Column:
    return F.transform(F.split(col(c), r"(?<=[.!?])\s+"), strip)


def _is_prose(s: Column, skip: Sequence[str]) -> Column:
    """A sentence that is neither navigation, a name list nor a domain."""
    words = F.split(s, r"\s+")
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (
        (F.length(s) >= 25) & ~mentions(s, skip)
        & ~((capitals > F.size(words) * 0.7) & (F.size(words) > 5))
        & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) <= 2)
        & ~s.rlike(r"(?i)^[\w\s\-]+\.(com|org|net|de|io|uk|co)\b")
        & ~s.rlike(r"^(Home|About|Contact|Blog|Events|Gallery|Shop)\s+")
    )


def lead_sentences(c, keep: int | None = None, max_len: int | None = None, start: int | None = None) -> Column:
    """The first ``keep`` prose sentences (None: all); else one with a topic word; else the text, or its
    first ``start`` characters. ``max_len`` cuts the result."""
    def choose(body):
        every = sentences(body)
        lead = F.array_join(_first(F.filter(every, lambda s: _is_prose(s, K.SENTENCE_SKIP)), keep), " ")
        topical = F.get(F.filter(every, lambda s: (F.length(s) > 40) & mentions(s, K.SENTENCE_FALLBACK)), F.lit(0))
        chosen = let(lead, lambda x: F.when(F.length(x) >= 50, x).otherwise(F.coalesce(topical, x)))
        return let(chosen, lambda x: prefix(F.when(F.length(x) >= 50, x).otherwise(prefix(body, start)), max_len))

    return let(strip(F.regexp_replace(clean_text(c), r"^[—–\-|·\s]+", "")), choose)


def _sentence_score(s: Column) -> Column:
    return (3 * score_terms(s, K.SENTENCE_HIGH) + 2 * score_terms(s, K.SENTENCE_MEDIUM)
            + score_terms(s, K.SENTENCE_LOW))


def best_sentences(c, scan: int | None = None, keep: int | None = None) -> Column:
    """The best sentences by keyword class and earliness, best first.

    The bonus for the k-th accepted sentence is max(0, 5-k), so the first five prose
    sentences always score and later ones only through keywords; acceptance stops at
    ``scan``, and the ``keep`` best stay (None: no end to either). That needs no running
    state: filter by position, then rank.
    """
    prose = F.filter(sentences(c), lambda s: _is_prose(s, K.SENTENCE_SKIP + K.SENTENCE_SKIP_EXTRA)
                     & ~s.rlike("^(Transition Group|Community Growing|Other food|Nature Community)"))
    scored = F.transform(prose, lambda s, i: F.struct(_sentence_score(s).alias("base"), i.alias("i"), s.alias("s")))
    accepted = _first(F.filter(scored, lambda x: (x["i"] < 5) | (x["base"] > 0)), scan)
    ranked = F.array_sort(F.transform(accepted, lambda x, k: F.struct(
        (-(x["base"] + F.greatest(F.lit(0), 5 - k))).alias("order"), k.alias("k"), x["s"].alias("s"))))
    return F.array_join(F.transform(_first(ranked, keep), lambda x: x["s"]), " ")


def _cut_at_sentence(c, limit: int | None, ellipsis: bool, near: int = 0) -> Column:
    """Cut to a length, back to the last full sentence if that keeps over 100 characters. Texts more than
    ``near`` below the limit stay whole, and all do without a limit."""
    if limit is None:
        return col(c)

    def cut(text):
        rest = F.concat(text, F.lit("...")) if ellipsis else text
        return let(F.regexp_extract(text, r"(?s)^(.*\.) ", 1),
                   lambda whole: F.when(F.length(whole) > 101, whole).otherwise(rest))

    return F.when(F.length(col(c)) > limit - near, let(prefix(c, limit), cut)).otherwise(col(c))


def _drop_lead(c: Column, lead: Column) -> Column:
    """Without a leading title or name and the separators after it."""
    return let(c, lambda b: F.when(
        b.startswith(lead), F.ltrim(F.substr(b, F.length(lead) + 1), F.lit(" —|-–·"))).otherwise(b))


def job_description(text, title, org_name, meta, limit: int | None = None, scan: int | None = None,
                    keep: int | None = None) -> Column:
    """A good meta description, else the best sentences, else any topical sentence; of ``limit`` characters at most."""
    def from_text(m):
        def from_best(body):
            topical = F.get(F.filter(sentences(body), lambda s: (F.length(s) > 40)
                                     & mentions(s, K.SENTENCE_HIGH + K.SENTENCE_MEDIUM)), F.lit(0))
            return let(best_sentences(body, scan, keep), lambda best: (
                F.when(F.length(best) > 50, _cut_at_sentence(best, limit, True))
                .otherwise(F.coalesce(prefix(topical, limit), F.when(F.length(m) > 50, prefix(m, limit))))))

        body = squeeze(text)
        for lead in (F.coalesce(squeeze(title), F.lit("")), col(org_name)):
            body = _drop_lead(body, lead)
        return let(strip(F.regexp_replace(body, r"^[—–\-|·\s]+", "")), from_best)

    def choose(m):
        clean_meta = F.coalesce((F.length(m) > 80) & ~mentions(m, K.META_JUNK), F.lit(False))
        return (
            F.when(clean_meta, _cut_at_sentence(m, limit, False, 50))
            .when(F.coalesce(col(text), F.lit("")) == "", F.when(F.length(m) > 50, m))
            .otherwise(from_text(m))
        )

    return let(col(meta), choose)


# --- stays ----------------------------------------------------------------------------

def price_info(c, amounts: int | None = None) -> Column:
    """First price phrase, else the first ``amounts`` amounts (None: all)."""
    phrase = first_fitting(c, K.PRICE_PATTERNS, 0, lambda x: F.length(x) < 200, strip)
    listed = blank_to_null(F.array_join(_first(extract_all(c, K.AMOUNT, 1), amounts), ", "))
    return F.coalesce(phrase, listed)


def stay_types(c) -> Column:
    def named(low):
        return F.array(*[F.when(low.rlike(words_regex(words)), F.lit(name)) for name, words in K.STAY_TYPE_WORDS])

    joined = let(F.lower(col(c)), lambda low: F.array_join(named(low), ", "))
    return F.coalesce(blank_to_null(joined), F.lit("accommodation"))


def booking_features(html, text, url=None, links: int | None = None) -> Column:
    low = F.lower(col(html))
    outside = F.filter(F.transform(hrefs(html), F.lower), lambda h: h.rlike(words_regex(K.BOOKING_HOSTS)))
    return F.struct(
        (F.lit(None).cast("string") if url is None else col(url)).alias("url"),
        low.rlike(r"<form\b").alias("has_form"),
        low.rlike(r"<iframe\b").alias("has_iframe"),
        col(html).rlike(K.EMAIL).alias("has_email"),
        col(html).rlike(K.PHONE).alias("has_phone"),
        low.rlike(words_regex(K.BOOKING_CALENDARS)).alias("has_calendar"),
        _first(outside, links).alias("external_links"),
        score_terms(text, K.BOOKING_KEYWORDS).alias("booking_keywords"),
    )


def booking_features_fine(html, text, url=None) -> Column:
    """The second pass: more keywords and hosts; contacts and calendars must stand in the visible
    text, links in anchors."""
    low, page = F.lower(col(text)), F.lower(col(html))
    linked = F.transform(anchors(html), lambda a: F.lower(a["href"]))
    return F.struct(
        (F.lit(None).cast("string") if url is None else col(url)).alias("url"),
        page.rlike(r"<form\b").alias("has_form"),
        page.rlike(r"<iframe\b").alias("has_iframe"),
        low.rlike(K.EMAIL).alias("has_email"),
        low.rlike(K.PHONE).alias("has_phone"),
        low.rlike(words_regex(K.BOOKING_CALENDARS_FINE)).alias("has_calendar"),
        F.filter(linked, lambda h: h.rlike(words_regex(K.BOOKING_HOSTS_FINE))).alias("external_links"),
        score_terms(text, K.BOOKING_KEYWORDS_FINE).alias("booking_keywords"),
    )


def booking_class(f: Column) -> Column:
    return (
        F.when(f["has_form"] & (f["booking_keywords"] >= 2), "direct_form")
        .when(f["has_iframe"] | (F.size(f["external_links"]) > 0), "external_widget")
        .when(f["has_calendar"], "calendar_tool")
        .when((f["has_email"] | f["has_phone"]) & (f["booking_keywords"] >= 1), "email_phone")
        .otherwise("unknown")
    )


def stay_listing(text, title_chars: int | None = None, max_len: int | None = None) -> Column:
    return F.struct(
        prefix(F.get(F.split(col(text), r"\. ", 2), F.lit(0)), title_chars).alias("title"),
        prefix(col(text), max_len).alias("description"), F.lit("accommodation").alias("stay_type"),
    )


def stay_title(html, org_name) -> Column:
    cut = strip(F.regexp_replace(strip(extract(html, r"(?i)<title[^>]*>([^<]+)</title>")), r"\s*[|–—-]\s*.*$", ""))
    return F.when((F.length(cut) > 5) & (F.length(cut) < 100), cut).otherwise(
        F.concat(F.lit("Stay at "), col(org_name)))


# --- events ---------------------------------------------------------------------------

def is_junk_event(title, description, start) -> Column:
    t = strip(F.coalesce(col(title), F.lit("")))
    d = strip(F.coalesce(col(description), F.lit("")))
    few_words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= 2
    return (
        ((t == "") & (d == ""))
        | t.rlike("(?i)" + "|".join(f"(?:{p})" for p in K.JUNK_TITLES))
        | d.rlike("(?i)" + "|".join(f"(?:{p})" for p in K.JUNK_DESCRIPTIONS))
        | (few_words & (F.length(d) < 50) & col(start).isNull())
    )


def event_dates(c, keep: int | None = None) -> Column:
    """The distinct dates, by pattern order then position; the first is the start, the second the end."""
    found = F.concat(*[extract_all(c, p, 1) for p in K.EVENT_DATE_PATTERNS])
    kept = F.filter(F.transform(found, strip), lambda d: F.length(d) > 5)
    return _first(F.array_distinct(kept), keep)


def calendar_feed(html, url) -> Column:
    href = extract(html, r"(?i)href=[\"']([^\"']+\.ics)[\"']")
    return F.when(href.isNotNull(), urls.resolve(url, href))


def calendar_system(html) -> Column:
    low = F.lower(col(html))
    return (
        F.when(low.rlike(r"href=[\"'][^\"']+\.ics[\"']"), "ics_feed")
        .when(low.contains("calendar.google.com") | low.contains("google.com/calendar"), "google_embed")
        .when(low.contains("eventbrite"), "eventbrite")
        .when(low.contains("meetup.com"), "meetup")
        .when(low.contains("outlook.office365.com") | low.contains("outlook.live.com"), "outlook")
    )


def is_online(c) -> Column:
    return mentions(c, K.ONLINE_WORDS)


def is_in_person(c) -> Column:
    return mentions(c, K.IN_PERSON_WORDS)


def _https(c: Column) -> Column:
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))


def video_link(html, text) -> Column:
    """First link to a meeting platform, else the first such address in the text, else ''."""
    any_platform = "(?i)" + "|".join(K.VIDEO_PATTERNS)
    linked = F.get(F.filter(hrefs(html), lambda h: h.rlike(any_platform)), F.lit(0))
    written = first_match(text, [f"(?i){p}" for p in K.VIDEO_PATTERNS])
    return F.coalesce(_https(linked), _https(written), F.lit(""))


def registration_link(html, url) -> Column:
    linked = extract_all(html, r"(?is)<a\s[^>]*?href=[\"']([^\"']+)[\"']", 1)
    usable = F.filter(linked, is_page_link)
    full = F.transform(usable, lambda h: urls.resolve(url, h))
    return F.get(F.filter(full, lambda h: h.rlike(K.BLOCK_REGISTER)), F.lit(0))


def page_start_date(html, text) -> Column:
    """Start from meta tags, else from the first dated phrase of 2024 or later."""
    metas = _meta_dates(html, ("og:start_date", "article:published_time", "event:start_time"))
    written = F.transform(F.array(*[F.regexp_extract(col(text), p, 1) for p in K.PAGE_DATE_PATTERNS]), dates.parse_date)
    return F.coalesce(F.get(metas, F.lit(0)), F.get(F.filter(written, lambda w: F.year(w) >= 2024), F.lit(0)))


def _meta_dates(html, names: Sequence[str]) -> Column:
    raw = F.array(*[F.regexp_extract(
        col(html), rf"(?i)<meta\s+(?:property|name)=[\"']{p}[\"']\s+content=[\"']([^\"']+)[\"']", 1) for p in names])
    return F.filter(F.transform(raw, dates.parse_date), lambda d: d.isNotNull())


def page_end_date(html) -> Column:
    return F.get(_meta_dates(html, ("og:end_date", "event:end_time")), F.lit(0))


def with_clock(start, text) -> Column:
    """A start at midnight takes the first clock time of the text."""
    timed = let(dates.first_clock(text), lambda minutes: F.when(
        minutes.isNull(), col(start)).otherwise(col(start) + F.make_dt_interval(mins=minutes)))
    return F.when(dates.has_clock(start), col(start)).otherwise(timed)
