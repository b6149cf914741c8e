"""Explicit schemas of the catalogue and of the file formats around it.

The module attributes (``schemas.EVENTS`` and so on) are StructTypes, parsed on first
use because parsing DDL needs a running session.
"""

from functools import cache

from pyspark.sql.types import StructType

_DDL = {}

_DDL["ORGANIZATIONS"] = (
    "id BIGINT NOT NULL, name STRING NOT NULL, description STRING, organization_type STRING, popup_html STRING,"
    " website STRING, email STRING, phone STRING, address STRING, city STRING, region STRING, country STRING,"
    " postal_code STRING, latitude DOUBLE, longitude DOUBLE, location STRING, source STRING,"
    " accepts_volunteers BOOLEAN, accepts_visitors BOOLEAN, accepts_shortterm BOOLEAN, accepts_longterm BOOLEAN,"
    " has_jobs BOOLEAN, has_stays BOOLEAN, has_events BOOLEAN, last_updated TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ,"
    " directory_url STRING, direct_website STRING, last_scrape_attempt TIMESTAMP_NTZ,"
    " being_processed_since TIMESTAMP_NTZ, events_scraped_at TIMESTAMP_NTZ, jobs_rescraped INT,"
    " jobs_being_processed_since TIMESTAMP_NTZ"
)
_DDL["VOLUNTEER_OPPORTUNITIES"] = (
    "id BIGINT NOT NULL, organization_id BIGINT NOT NULL, title STRING NOT NULL, description STRING NOT NULL,"
    " role STRING, skills_needed STRING, start_date TIMESTAMP_NTZ, end_date TIMESTAMP_NTZ, commitment STRING,"
    " remote_options BOOLEAN, application_email STRING, source_url STRING, created_at TIMESTAMP_NTZ"
)
_DDL["STAYS"] = (
    "id BIGINT NOT NULL, organization_id BIGINT NOT NULL, title STRING, description STRING, stay_type STRING,"
    " price_info STRING, booking_type STRING, booking_analysis STRUCT<url: STRING, has_form: BOOLEAN,"
    " has_iframe: BOOLEAN, has_email: BOOLEAN, has_phone: BOOLEAN, has_calendar: BOOLEAN,"
    " external_links: ARRAY<STRING>, booking_keywords: INT>, booking_url STRING, created_at TIMESTAMP_NTZ,"
    " rescraped INT, being_processed_since TIMESTAMP_NTZ"
)
_DDL["EVENTS"] = (
    "id BIGINT NOT NULL, organization_id BIGINT NOT NULL, title STRING, description STRING, event_type STRING,"
    " start_date TIMESTAMP_NTZ, end_date TIMESTAMP_NTZ, location STRING, is_online BOOLEAN, is_in_person BOOLEAN,"
    " registration_url STRING, event_url STRING, created_at TIMESTAMP_NTZ"
)
_DDL["MASTER"] = (
    "id BIGINT, name STRING, lat DOUBLE, lng DOUBLE, category STRING, sources ARRAY<STRING>,"
    " source_urls ARRAY<STRING>, country STRING, city STRING, description STRING, url STRING, tags ARRAY<STRING>"
)
_DDL["SUBMISSIONS"] = (
    "name STRING, description STRING, organization_type STRING, website STRING, email STRING, phone STRING,"
    " address STRING, city STRING, region STRING, country STRING, postal_code STRING, latitude DOUBLE,"
    " longitude DOUBLE, accepts_volunteers BOOLEAN, accepts_visitors BOOLEAN, accepts_shortterm BOOLEAN,"
    " accepts_longterm BOOLEAN, has_jobs BOOLEAN, has_stays BOOLEAN, has_events BOOLEAN"
)
_DDL["PAGES"] = "page_id BIGINT, url STRING, html STRING"
_DDL["IP_ENRICHMENTS"] = "ip STRING, enriched_at TIMESTAMP_NTZ"
_DDL["LEDGER"] = "done_ids ARRAY<BIGINT>, stats STRUCT<enriched: BIGINT, errors: BIGINT, skipped: BIGINT>"
_DDL["FEATURE"] = (
    "type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, properties STRUCT<id: BIGINT,"
    " name: STRING, description: STRING, popup: STRING, source: STRING, country: STRING, city: STRING,"
    " region: STRING, address: STRING, website: STRING, email: STRING, phone: STRING,"
    " acceptsVolunteers: BOOLEAN, acceptsVisitors: BOOLEAN, acceptsShortterm: BOOLEAN,"
    " acceptsLongterm: BOOLEAN, hasJobs: BOOLEAN, hasStays: BOOLEAN, hasEvents: BOOLEAN>"
)
_DDL["VECTOR_CHUNK"] = (
    "dim INT, count INT, offset BIGINT, range ARRAY<DOUBLE>,"
    " data ARRAY<STRUCT<id: BIGINT, lat: DOUBLE, lon: DOUBLE, e: STRING>>"
)
_DDL["VECTOR_HEADER"] = "model STRING, dim INT, count BIGINT, num_chunks BIGINT, range ARRAY<DOUBLE>"


@cache
def _parsed(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def __getattr__(name: str) -> StructType:
    if name in _DDL:
        return _parsed(name)
    raise AttributeError(name)
