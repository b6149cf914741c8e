"""Rows rendered as published text: pop-ups, JSON-LD, calendar entries, SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark import constants as K
from meadowlark.functions import dates
from meadowlark.functions import text as T


def _fill(template: str, *values: Column) -> Column:
    """The template with its {} places filled."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:]):
        out += [value, F.lit(tail)]
    return F.concat(*out)


def _badge(back: str, fore: str, text: str) -> Column:
    return F.lit(K.POPUP_BADGE.format(back, fore, text))


def popup_html(address_chars: int | None = None) -> Column:
    """The pop-up of an organization: stored markup if any, else built from its fields."""
    visitors = T.truthy("accepts_visitors")
    badges = F.concat_ws(
        " ",
        F.when(T.truthy("accepts_volunteers"), _badge("#ffc107", "black", "Volunteer")),
        F.when(visitors & T.truthy("accepts_shortterm"), _badge("#17a2b8", "white", "Short-term")),
        F.when(visitors & T.truthy("accepts_longterm"), _badge("#17a2b8", "white", "Long-term")),
        F.when(T.truthy("has_jobs"), _badge("#dc3545", "white", "Jobs")),
    )
    place = T.join_nonempty(", ", "city", "region", "country")
    site, mail = T.blank_to_null("website"), T.blank_to_null("email")
    reach = F.concat_ws(" | ", _fill(K.POPUP_WEBSITE, site), _fill(K.POPUP_EMAIL, mail), T.blank_to_null("phone"))
    built = F.concat_ws(
        " ",
        F.concat(F.lit("<strong>"), F.col("name"), F.lit("</strong><br>")),
        F.when(F.length("description") > 10, _fill(K.POPUP_DESCRIPTION, F.col("description"))),
        F.when(badges != "", F.concat(badges, F.lit("<br>"))),
        _fill(K.POPUP_ADDRESS, T.prefix(T.blank_to_null("address"), address_chars)),
        F.when(place != "", _fill(K.POPUP_PLACE, place)),
        F.when(reach != "", _fill(K.POPUP_LINKS, reach)),
    )
    return F.coalesce(T.blank_to_null("popup_html"), built)


def short_popup(description: Column, max_len: int | None = None) -> Column:
    """The compact pop-up written after a description was refreshed; a longer text than ``max_len`` ends in dots."""
    text = description if max_len is None else F.when(
        F.length(description) > max_len, F.concat(T.prefix(description, max_len), F.lit("..."))).otherwise(description)
    badges = F.concat_ws(" ", F.when(T.truthy("accepts_volunteers"), _badge("#ffc107", "black", "Volunteer")),
                         F.when(T.truthy("accepts_visitors"), _badge("#17a2b8", "white", "Visitors")),
                         F.when(T.truthy("has_jobs"), _badge("#dc3545", "white", "Jobs")))
    site, mail = T.blank_to_null("website"), T.blank_to_null("email")
    return F.concat(
        F.lit("<strong>"), F.col("name"), F.lit("</strong><p>"), text, F.lit("</p>"),
        F.when(badges != "", F.concat(F.lit("<div>"), badges, F.lit("</div>"))).otherwise(F.lit("")),
        F.concat_ws("", _fill('<a href="{}" target="_blank">🌐 Website</a>', site),
                    _fill('<a href="mailto:{}">Email</a>', mail)))


def schema_org(base_url: str) -> Column:
    """JSON-LD Organization as a struct; absent parts are NULL, so to_json leaves them out."""
    own = F.concat(F.lit(f"{base_url}/?org="), F.col("id").cast("string"))
    parts = T.join_nonempty("", "address", "city", "region", "postal_code", "country")

    def text(c):
        return F.coalesce(F.col(c), F.lit(""))

    return F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), own.alias("@id"),
        F.col("name").alias("name"), text("description").alias("description"),
        F.coalesce(T.blank_to_null("website"), own).alias("url"),
        F.struct(F.lit("PropertyValue").alias("@type"), F.lit("ID").alias("propertyID"),
                 F.col("id").cast("string").alias("value")).alias("identifier"),
        T.blank_to_null("email").alias("email"), T.blank_to_null("phone").alias("telephone"),
        F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct(
            F.lit("GeoCoordinates").alias("@type"), F.col("latitude").alias("latitude"),
            F.col("longitude").alias("longitude"))).alias("geo"),
        F.when(parts != "", F.struct(
            F.lit("PostalAddress").alias("@type"), text("address").alias("streetAddress"),
            text("city").alias("addressLocality"), text("region").alias("addressRegion"),
            text("postal_code").alias("postalCode"), text("country").alias("addressCountry"))).alias("address"),
    )


def feature(base_url: str) -> Column:
    """A GeoJSON feature as a struct; coordinates are longitude, latitude."""
    def text(c):
        return F.coalesce(F.col(c), F.lit(""))

    texts = [("description", "description"), ("source", "source"), ("country", "country"), ("city", "city"),
             ("region", "region"), ("address", "address"), ("postal_code", "postalCode"), ("website", "website"),
             ("email", "email"), ("phone", "phone"), ("organization_type", "organizationType")]
    flags = [("accepts_volunteers", "acceptsVolunteers"), ("accepts_visitors", "acceptsVisitors"),
             ("accepts_shortterm", "acceptsShortterm"), ("accepts_longterm", "acceptsLongterm"),
             ("has_jobs", "hasJobs"), ("has_stays", "hasStays"), ("has_events", "hasEvents")]
    properties = F.struct(
        F.col("id").alias("id"), F.col("name").alias("name"), popup_html().alias("popup"),
        *[text(c).alias(a) for c, a in texts], *[T.truthy(c).alias(a) for c, a in flags],
        schema_org(base_url).alias("schemaOrg"))
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        properties.alias("properties"))


def to_geojson(org: DataFrame, base_url: str) -> DataFrame:
    """(id, feature): one JSON feature per organization that has coordinates."""
    located = org.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return located.select("id", F.to_json(feature(base_url)).alias("feature"))


def fold_line(c) -> Column:
    """A calendar line over 75 characters in slices of 73, continued after a space."""
    line = T.col(c)
    return F.when(F.length(line) > 75, F.regexp_replace(line, r"(?s)(.{73})(?=.)", "$1\r\n ")).otherwise(line)


def icalendar_events(events: DataFrame, org: DataFrame, stamp, host: str, default_title: str = "Event",
                     now=None) -> DataFrame:
    """(id, start_date, vevent): one calendar entry per event, by start when read in order."""
    picked = events if now is None else events.where(F.col("start_date") >= dates.moment(now))
    parent = org.select(F.col("id").alias("_org"), F.col("website").alias("org_website"),
                        F.col("country").alias("org_country"), F.col("city").alias("org_city"))
    e = picked.join(parent, F.col("organization_id") == F.col("_org"))
    timed = dates.has_clock("start_date")
    description = T.ics_escape("description")
    url = T.first_nonempty("event_url", "registration_url", "org_website")
    place = T.first_nonempty(T.ics_escape(T.join_nonempty(", ", "location", "org_city", "org_country")), F.lit("TBD"))

    def when_line(name, c):
        day = F.concat(F.lit(f"{name};VALUE=DATE:"), dates.ics_date(c))
        return F.when(F.col("start_date").isNotNull() & F.col(c).isNotNull(),
                      F.when(timed, F.concat(F.lit(f"{name}:"), dates.ics_datetime(c))).otherwise(day))

    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:event-"), F.col("id").cast("string"), F.lit(f"@{host}")),
        F.concat(F.lit("DTSTAMP:"), F.concat(dates.ics_datetime(dates.moment(stamp)), F.lit("Z"))),
        F.concat(F.lit("SUMMARY:"), T.ics_escape(T.first_nonempty("title", F.lit(default_title)))),
        F.when(description != "", F.concat(F.lit("DESCRIPTION:"), description)),
        F.when(url != "", F.concat(F.lit("URL:"), url)),
        F.concat(F.lit("LOCATION:"), place),
        when_line("DTSTART", "start_date"), when_line("DTEND", "end_date"),
        F.lit("END:VEVENT"),
    ]
    return e.select("id", "start_date", F.concat_ws("\r\n", *[fold_line(x) for x in lines]).alias("vevent"))


CALENDAR_HEAD = ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//{}//Events//EN", "CALSCALE:GREGORIAN",
                 "METHOD:PUBLISH", "X-WR-CALNAME:{}", "X-WR-TIMEZONE:UTC")


def sql_literal(df: DataFrame, c: str) -> Column:
    """A column value as an SQL literal; booleans are stored as 0 and 1."""
    kind = dict(df.dtypes)[c]
    value = F.col(f"`{c}`")
    if kind == "boolean":
        return F.coalesce(value.cast("int").cast("string"), F.lit("NULL"))
    if kind in ("bigint", "int", "smallint", "tinyint", "double", "float") or kind.startswith("decimal"):
        return F.coalesce(value.cast("string"), F.lit("NULL"))
    if kind.startswith(("struct", "array", "map")):
        return T.sql_quote(F.to_json(value))
    return T.sql_quote(value.cast("string"))


def sql_statements(df: DataFrame, table: str, mode: str = "upsert", key: str = "id",
                   cols: Sequence[str] | None = None) -> DataFrame:
    """(key, statement): one INSERT per row; 'upsert' updates on conflict, 'refresh' plainly inserts."""
    cols = list(cols or df.columns)
    values = F.concat_ws(", ", *[sql_literal(df, c) for c in cols])
    tail = ";"
    if mode == "upsert":
        sets = ", ".join(f"{c}=excluded.{c}" for c in cols if c != key)
        tail = f" ON CONFLICT({key}) DO UPDATE SET {sets};"
    head = f"INSERT INTO {table} ({', '.join(cols)}) VALUES ("
    return df.select(F.col(key), F.concat(F.lit(head), values, F.lit(")" + tail)).alias("statement"))
