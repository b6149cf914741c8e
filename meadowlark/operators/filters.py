"""Row selection and projection. Predicates stay plain so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions import dates, urls
from meadowlark.functions import text as T
from meadowlark.scale import keys_of

FLAGS = ("accepts_volunteers", "accepts_visitors", "accepts_shortterm", "accepts_longterm",
         "has_jobs", "has_stays", "has_events")


def project_features(org: DataFrame) -> DataFrame:
    """Map-layer properties: missing texts as '', flags as booleans, camel-case names."""
    camel = {
        "accepts_volunteers": "acceptsVolunteers", "accepts_visitors": "acceptsVisitors",
        "accepts_shortterm": "acceptsShortterm", "accepts_longterm": "acceptsLongterm",
        "has_jobs": "hasJobs", "has_stays": "hasStays", "has_events": "hasEvents",
    }
    texts = {"description": "description", "source": "source", "country": "country", "city": "city",
             "region": "region", "address": "address", "postal_code": "postalCode", "website": "website",
             "email": "email", "phone": "phone", "organization_type": "organizationType"}
    return org.select(
        "id", "name", "latitude", "longitude",
        *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in texts.items()],
        *[T.truthy(c).alias(a) for c, a in camel.items()],
    )


def has_geo(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def filter_flags(df: DataFrame, source: str | None = None, **flags: bool) -> DataFrame:
    """Conjunction of the given conditions; a NULL flag matches neither value."""
    unknown = set(flags) - set(FLAGS)
    if unknown:
        raise ValueError(f"unknown flags: {sorted(unknown)}")
    if source is not None:
        df = df.where(F.col("source") == source)
    for name, wanted in flags.items():
        df = df.where(F.col(name) == F.lit(bool(wanted)))
    return df


def text_search(df: DataFrame, q: str, cols: Sequence) -> DataFrame:
    """Case-insensitive containment in any column; % and _ in the query are wildcards."""
    return df.where(T.any_of([T.contains_ci(c, q) for c in cols]))


def event_format(df: DataFrame, fmt: str | None) -> DataFrame:
    if fmt == "remote":
        return df.where(F.col("is_online"))
    if fmt == "in_person":
        return df.where(F.col("is_in_person"))
    return df


def upcoming(df: DataFrame, now, col: str = "start_date") -> DataFrame:
    return df.where(F.col(col) >= dates.moment(now))


def in_period(df: DataFrame, year: int | None, month: int | None = None, col: str = "start_date") -> DataFrame:
    """A year, or a month of it; a month without a year means nothing."""
    if year is None:
        return df
    lo, hi = dates.month_bounds(year, month)
    return df.where((F.col(col) >= lo) & (F.col(col) < hi))


def toggles(df: DataFrame, base: DataFrame | None = None, jobs=False, stays=False, events=False) -> DataFrame:
    """AND of the enabled toggles, over all rows or over the ids of a current result."""
    if base is not None:
        df = df.join(keys_of(base, "id", "id"), "id", "left_semi")
    for on, flag in ((jobs, "has_jobs"), (stays, "has_stays"), (events, "has_events")):
        if on:
            df = df.where(F.col(flag))
    return df


def by_ids(df: DataFrame, ids: Sequence[int] | DataFrame, key: str = "id") -> DataFrame:
    if isinstance(ids, DataFrame):
        return df.join(keys_of(ids, ids.columns[0], key), key, "left_semi")
    return df.where(F.col(key).isin(list(ids)))


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == value)


def children(df: DataFrame, org_id) -> DataFrame:
    return by_id(df, org_id, "organization_id")


def contains_any(df: DataFrame, q: str, cols: Sequence[str]) -> DataFrame:
    """Plain substring, no wildcards, in any column."""
    needle = q.strip().lower()
    return df.where(T.any_of([F.lower(F.col(c)).contains(needle) for c in cols]))


def drop_low_quality(df: DataFrame, generic_prefix: str) -> DataFrame:
    """Without blank names, and without generic names that have no website."""
    generic = F.col("name").startswith(generic_prefix) & T.is_blank("website")
    return df.where(~F.coalesce(generic, F.lit(False)) & (F.coalesce(T.strip("name"), F.lit("")) != ""))


def pending(df: DataFrame, done_col: str, lease_col: str | None = None, n: int | None = None,
            offset: int = 0) -> DataFrame:
    """Rows with a website that are neither done (NULL or false/0 counts as not done) nor claimed;
    by id when only some are wanted."""
    done = F.col(done_col)
    boolean = dict(df.dtypes)[done_col] in ("boolean", "int", "bigint")
    open_ = done.isNull() | (~done.cast("boolean")) if boolean else done.isNull()
    out = df.where(~T.is_blank("website") & open_)
    if lease_col is not None:
        out = out.where(F.col(lease_col).isNull())
    if n is None and not offset:
        return out
    out = out.orderBy("id")
    if offset:
        out = out.offset(offset)
    return out if n is None else out.limit(n)


def needs_description(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Description repeats the name, is missing or holds a marker, and some URL can be read."""
    text = F.col("description")
    poor = T.is_blank(text) | (text == F.col("name")) | T.any_of([text.contains(m) for m in markers])
    usable = T.any_of([~T.is_blank(c) for c in ("website", "direct_website", "directory_url")])
    return df.where(poor & usable)


def is_allowed_url(url, hosts: Sequence[str] = tuple(K.BLOCKED_HOSTS), paths: Sequence[str] = ()) -> Column:
    full = urls.with_scheme(url)
    ok = full.isNotNull() & ~urls.on_host(urls.host(full), hosts)
    return ok & ~urls.below(F.lower(urls.path(full)), paths) if paths else ok


def allowed_urls(df: DataFrame, col: str = "url", hosts=tuple(K.BLOCKED_HOSTS), paths=()) -> DataFrame:
    """Without rows whose URL is on a blocked host (or a sub-domain) or under a blocked path."""
    return df.where(is_allowed_url(col, hosts, paths))


def validate(sub: DataFrame) -> DataFrame:
    """Submissions with ``reason`` (NULL when accepted) and the ``matched`` keywords."""
    name, text = T.strip("name"), T.strip("description")
    whole = F.concat_ws(" ", name, text, F.coalesce(F.col("organization_type"), F.lit("")))
    matched = T.keyword_hits(whole, K.SUBMISSION_KEYWORDS)
    reason = (
        F.when(F.coalesce(F.length(name), F.lit(0)) < 2, "name")
        .when(F.coalesce(F.length(text), F.lit(0)) < 20, "description")
        .when(F.coalesce(T.strip("country"), F.lit("")) == "", "country")
        .when(F.col("latitude").isNull() | F.col("longitude").isNull(), "coordinates")
        .when(F.size("matched") == 0, "keywords")
    )
    return sub.withColumn("matched", matched).withColumn("reason", reason)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNull()).drop("reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNotNull())


def filter_location(df: DataFrame, place: str, gazetteer: DataFrame, col: str = "country") -> DataFrame:
    """Rows in a continent or country. The gazetteer maps a lower-case place to the upper-case
    country values it allows; a place it does not know stands for itself."""
    key = place.strip().lower()
    known = F.col("place") == key
    values = gazetteer.where(known).select(F.col("allowed").alias("_allowed"))
    unknown = gazetteer.agg(F.count_if(known).alias("n")).where(F.col("n") == 0).select(
        F.lit(key.upper()).alias("_allowed"))
    return df.join(values.unionByName(unknown), F.upper(F.trim(F.col(col))) == F.col("_allowed"), "left_semi")


def not_like(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.where(~F.col(col).like(pattern))


def stale(df: DataFrame, col: str, now, minutes: int) -> DataFrame:
    return df.where(is_stale(col, now, minutes))


def is_stale(col: str, now, minutes: int) -> Column:
    return F.col(col) < dates.moment(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
