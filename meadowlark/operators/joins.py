"""Joins of parents, children, pages and lookups.

Join strategies are left to adaptive execution, which knows real sizes at run time
and splits skewed partitions of the child side; only fixed literal tables are hinted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadowlark.functions import extract as X
from meadowlark.functions import text as T
from meadowlark.functions import urls
from meadowlark.operators import filters
from meadowlark.scale import first_per, keys_of, list_pages
from meadowlark.session import durable

_PARENT = ("name", "website", "country", "city", "latitude", "longitude")


def with_parent(child: DataFrame, org: DataFrame, fields: Sequence[str] = _PARENT) -> DataFrame:
    """Children with their organization's fields, prefixed ``org_``; orphans vanish."""
    parent = org.select(F.col("id").alias("_org_id"), *[F.col(f).alias(f"org_{f}") for f in fields])
    return child.join(parent, F.col("organization_id") == F.col("_org_id")).drop("_org_id")


def nest_parent(df: DataFrame, fields: Sequence[str] = _PARENT) -> DataFrame:
    """The parent fields gathered in one struct."""
    nested = F.struct(F.col("organization_id").alias("id"), *[F.col(f"org_{f}").alias(f) for f in fields])
    return df.select(*[c for c in df.columns if not c.startswith("org_") and c != "organization_id"],
                     nested.alias("organization"))


def page_of(df: DataFrame, skip: int, limit: int | None, order: Sequence) -> DataFrame:
    out = df.orderBy(*order)
    if skip:
        out = out.offset(skip)
    return out if limit is None else out.limit(limit)


def jobs_detailed(jobs: DataFrame, org: DataFrame, search: str | None = None, skip: int = 0,
                  limit: int | None = 100, order: Sequence = ("id",)) -> DataFrame:
    joined = with_parent(jobs, org)
    if search:
        joined = filters.text_search(joined, search, ["title", "description", "role", "org_name", "org_country"])
    return page_of(joined, skip, limit, order)


def stays_detailed(stays: DataFrame, org: DataFrame, search: str | None = None, skip: int = 0,
                   limit: int | None = 100, order: Sequence = ("id",)) -> DataFrame:
    joined = with_parent(stays, org)
    if search:
        joined = filters.text_search(joined, search, ["title", "description", "stay_type", "org_name", "org_country"])
    return page_of(joined, skip, limit, order)


def events_detailed(events: DataFrame, org: DataFrame, fmt: str | None = None, search: str | None = None,
                    now=None, year: int | None = None, month: int | None = None, skip: int = 0,
                    limit: int | None = 100) -> DataFrame:
    """Events with their organization: format, upcoming (``now`` given) and period filters run
    on the events before the join; by start when dated, always with id as tie-break."""
    picked = filters.in_period(filters.event_format(events, fmt), year, month)
    if now is not None:
        picked = filters.upcoming(picked, now)
    joined = with_parent(picked, org)
    if search:
        joined = filters.text_search(joined, search, ["title", "description", "org_name", "org_country"])
    dated = now is not None or year is not None
    order = [F.col("start_date").asc_nulls_first(), F.col("id")] if dated else [F.col("id")]
    return page_of(joined, skip, limit, order)


def org_profile(org: DataFrame, jobs: DataFrame, stays: DataFrame, page_size: int = 1000) -> DataFrame:
    """Organizations with their jobs and stays lists, in pages of bounded length.

    Both child tables go through one list build; an organization without children keeps one
    row with empty lists.
    """
    child = (
        jobs.select("organization_id", F.lit("job").alias("kind"), F.col("id").alias("child_id"), "title")
        .unionByName(stays.select("organization_id", F.lit("stay").alias("kind"), F.col("id").alias("child_id"), "title"))
    )
    lists = list_pages(child, ["organization_id"], [F.col("kind"), F.col("child_id"), F.col("title")],
                       F.struct("kind", "child_id", "title"), page_size)
    def only(kind):
        empty = F.array().cast("array<struct<kind:string,child_id:bigint,title:string>>")
        return F.coalesce(F.filter("items", lambda x: x["kind"] == kind), empty)
    return (
        org.join(lists, org["id"] == lists["organization_id"], "left")
        .select(*[org[c] for c in org.columns], F.coalesce("page", F.lit(0)).alias("page"),
                F.coalesce("n_items", F.lit(0)).alias("n_children"),
                only("job").alias("jobs"), only("stay").alias("stays"))
    )


def parents_pending(org: DataFrame, jobs: DataFrame, done_col: str, lease_col: str | None = None) -> DataFrame:
    """Unprocessed organizations that have a child."""
    kids = keys_of(jobs, "organization_id", "id")
    return filters.pending(org, done_col, lease_col).join(kids, "id", "left_semi")


def stay_work(stays: DataFrame, org: DataFrame) -> DataFrame:
    """Stays with a booking URL still to refine, with the names needed for it."""
    todo = stays.where(~T.is_blank("booking_url") & F.col("being_processed_since").isNull()
                       & (F.coalesce(F.col("rescraped"), F.lit(0)) == 0))
    return with_parent(todo, org, ("name", "website"))


def remaining(df: DataFrame, ledger: DataFrame, key: str = "id", done: str = "id") -> DataFrame:
    return df.join(keys_of(ledger, done, key), key, "left_anti")


def new_records(incoming: DataFrame, existing: DataFrame, order: Sequence) -> DataFrame:
    """Incoming rows whose name and URL are unknown, first per name."""
    in_name, in_url = T.norm_key("name"), T.norm_url_key("website")
    names = keys_of(existing, T.norm_key("name"), "_n")
    sites = keys_of(existing, T.blank_to_null(T.norm_url_key("website")), "_u")
    fresh = (
        incoming.withColumn("_name", in_name).withColumn("_url", F.coalesce(in_url, F.lit("")))
        .join(names, F.col("_name") == F.col("_n"), "left_anti")
        .join(sites, F.col("_url") == F.col("_u"), "left_anti")
    )
    return first_per(fresh, ["_name"], order).drop("_name", "_url")


def name_conflicts(sub: DataFrame, org: DataFrame) -> DataFrame:
    known = keys_of(org, F.lower("name"), "_known")
    return sub.join(known, F.lower(T.strip("name")) == F.col("_known"), "left_semi")


def without_conflicts(sub: DataFrame, org: DataFrame) -> DataFrame:
    known = keys_of(org, F.lower("name"), "_known")
    return sub.join(known, F.lower(T.strip("name")) == F.col("_known"), "left_anti")


def lookup_by_name(df: DataFrame, ref: DataFrame, value: str, pos: str, key: str = "name",
                   out: str = "found") -> DataFrame:
    """Exact-name lookup; the last entry of a name wins."""
    last = ref.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.col(value), F.col(pos)).alias(out))
    return df.join(last, F.col(key) == F.col("_key"), "left").drop("_key")


def propagate(df: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results found once per key, given to every row that shares it."""
    renamed = results.withColumnRenamed(key, "_key")
    return df.join(renamed, F.col(key) == F.col("_key"), "left").drop("_key")


def candidate_urls(sites: DataFrame, paths: Sequence[str], site: str = "website") -> DataFrame:
    """One row per site and path, in path order, from 0."""
    base = urls.base_url(site)
    listed = F.array(*[F.lit(p) for p in paths])
    return sites.select("*", F.posexplode(listed).alias("path_pos", "_path")).withColumn(
        "candidate_url", F.concat(base, F.lit("/"), F.col("_path"))).drop("_path")


def pages_at(pages: DataFrame, paths: Sequence[str], max_checks: int | None = None) -> DataFrame:
    """Pages that lie at one of the paths below some base: adds ``base`` and ``path_pos``.

    The path list is matched against each page address, so sites never have to be multiplied
    by paths: the later join is one row per fitting page.
    """
    tried = list(paths if max_checks is None else paths[:max_checks])
    listed = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit("/" + p).alias("tail")) for i, p in enumerate(tried)])
    fits = F.filter(listed, lambda x: F.col("url").endswith(x["tail"]))
    return (
        pages.select("*", F.explode(fits).alias("_fit"))
        .withColumn("path_pos", F.col("_fit.pos"))
        .withColumn("base", F.substr("url", F.lit(1), F.length("url") - F.length("_fit.tail")))
        .drop("_fit")
    )


def site_pages(sites: DataFrame, pages: DataFrame, paths: Sequence[str], passes: Column,
               max_checks: int | None = None, site: str = "website") -> DataFrame:
    """Every site with (page_id, url, path_pos) of its pages at the paths, where the page passes.
    Pages are tested before the join, so only addresses of passing ones are shuffled."""
    found = pages_at(pages.where(passes).select("page_id", "url"), paths, max_checks)
    return sites.withColumn("_base", urls.base_url(site)).join(found, F.col("_base") == F.col("base")).drop("_base", "base")


def discover_page(sites: DataFrame, pages: DataFrame, paths: Sequence[str], passes: Column, key: str = "id",
                  max_checks: int | None = None, site: str = "website") -> DataFrame:
    """Per site, (page_id, url, path_pos) of the page at the first path that passes. ``max_checks``
    tries only the first paths. Bodies are attached later, by ``wanted_pages``."""
    return first_per(site_pages(sites, pages, paths, passes, max_checks, site), [key],
                     [F.col("path_pos"), F.col("page_id")])


def wanted_pages(found: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that are named by ``page_id`` in ``found``, once each. The ids are the side that
    is built into a hash table, so bodies are neither sorted nor multiplied."""
    ids = keys_of(found, "page_id", "page_id").hint("shuffle_hash")
    return pages.join(ids, "page_id", "left_semi")


def page_passes(html, words: Sequence[str], min_len: int = 500) -> Column:
    return (F.length(T.col(html)) > min_len) & T.mentions(html, words)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, text, href) of the content links of each page, resolved."""
    listed = F.filter(X.anchors("html"), lambda a: X.is_page_link(a["href"]))
    return (
        pages.select("page_id", "url", F.posexplode(listed).alias("pos", "a"))
        .select("page_id", "url", "pos", F.col("a.text").alias("text"),
                urls.resolve(F.col("url"), F.col("a.href")).alias("href"))
    )


def follow_links(listing: DataFrame, pages: DataFrame, pattern: str) -> DataFrame:
    """Detail pages behind the listing links whose address contains a pattern; first text per link."""
    wanted = links(listing).where(F.col("href").contains(pattern))
    once = first_per(wanted, ["href"], [F.col("page_id"), F.col("pos")])
    target = pages.select(F.col("page_id").alias("target_id"), F.col("url").alias("target_url"),
                          F.col("html").alias("target_html"))
    return once.join(target, once["href"] == target["target_url"])


EARTH_KM = 6371.0088


def _half_width(lat: Column, reach: Column) -> Column:
    """Degrees of longitude that a circle of ``reach`` degrees reaches on either side; all if a pole is in it."""
    wide = F.degrees(F.asin(F.least(F.sin(F.radians(reach)) / F.cos(F.radians(lat)), F.lit(1.0)))) + 1e-9
    return F.when(F.abs(lat) + reach >= 90, F.lit(180.0)).otherwise(wide)


def nearby(df: DataFrame, lat: float, lon: float, radius_km: float, limit: int = 20) -> DataFrame:
    """Rows within a radius, nearest first. Bounds of latitude and longitude prune the scan
    before the great-circle distance is computed; a box across the date line is two ranges."""
    reach = math.degrees(radius_km / EARTH_KM) + 1e-9
    near = df.where(F.col("latitude").between(lat - reach, lat + reach))
    if abs(lat) + reach < 90:
        half = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) + 1e-9
        ranges = [F.col("longitude").between(max(a, -180.0), min(b, 180.0))
                  for shift in (-360, 0, 360) for a, b in [(lon - half + shift, lon + half + shift)] if b >= -180 and a <= 180]
        near = near.where(T.any_of(ranges))
    return (
        near.withColumn("distance_km", haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)))
        .where(F.col("distance_km") <= radius_km)
        .orderBy("distance_km", "id").limit(limit)
    )


PIECE = 1 << 14  # places, and looks of points, that meet in one piece of a cell


def nearby_points(df: DataFrame, points: DataFrame, radius_km: float, key: str = "id", point_key: str = "point_id") -> DataFrame:
    """(point_key, key, distance_km): all rows of ``df`` (latitude, longitude) within a radius of each
    row of ``points``.

    The globe is cut into bands of latitude as high as the radius, and a band into cells about as
    wide as the circles that reach into it, fewer towards the poles. A place lies in one cell; a
    point looks into the cells that its circle reaches in its own band and the two beside it,
    around the date line, two or three a band. A latitude beyond a pole is the place that its sine
    and cosine give.

    Cells meet in an equi-join. Large radii make few cells and crowds full ones, so each is cut into
    pieces of at most about ``PIECE`` places and looks, every two of which meet in one task: tasks and
    what they hold are bounded, pairs are as many as the circles hold. Sines and cosines are taken once a
    row, the arc only of pairs that are near.
    """
    height = math.degrees(radius_km / EARTH_KM) + 1e-9
    bands = max(1, math.ceil(180 / height))

    def cells(band: Column) -> Column:
        """How many cells a band has: its circles reach as far as those at its edge nearer to a pole."""
        edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
        return F.greatest(F.floor(180.0 / _half_width(F.least(edge, F.lit(90.0)), F.lit(height))), F.lit(1))

    lat, lon = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    around = F.pmod(lat + 90, F.lit(360.0))
    beyond = ~lat.between(-90, 90) & (around > 180)  # on the other side of the pole
    north = F.when(lat.between(-90, 90), lat).when(beyond, 270 - around).otherwise(around - 90)
    turned = F.pmod(lon + F.when(beyond, 0).otherwise(180), F.lit(360.0))
    band = F.least(F.greatest(F.floor((F.col("_north") + 90) / height), F.lit(0)), F.lit(bands - 1))
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()

    def located(rows: DataFrame, name: str) -> DataFrame:
        half = [f(x / 2).alias(c) for x, f, c in ((F.radians(lat), F.sin, "_s"), (F.radians(lat), F.cos, "_c"), (F.radians(lon), F.sin, "_u"), (F.radians(lon), F.cos, "_v"))]
        return rows.where(known).select(F.col(name), north.alias("_north"), turned.alias("_turned"), *half, F.cos(F.radians(lat)).alias("_w"))

    angles = ("_s", "_c", "_u", "_v", "_w")
    placed = located(df, key).withColumn("_band", band)
    placed = placed.withColumn("_cell", F.least(F.floor(F.col("_turned") * cells(F.col("_band")) / 360), cells(F.col("_band")) - 1)).drop("_north", "_turned")
    asked = located(points, point_key).withColumn("_band", F.explode(F.sequence(band - 1, band + 1)))
    asked = asked.where(F.col("_band").between(0, bands - 1)).withColumn("_n", cells(F.col("_band"))).withColumn(
        "_half", _half_width(F.col("_north"), F.lit(height)))
    first = F.floor((F.col("_turned") - F.col("_half")) * F.col("_n") / 360)
    last = F.least(F.floor((F.col("_turned") + F.col("_half")) * F.col("_n") / 360), first + F.col("_n") - 1)
    looks = asked.withColumn("_cell", F.explode(F.sequence(first, last))).withColumn("_cell", F.pmod(F.col("_cell"), F.col("_n"))).drop("_north", "_turned", "_n", "_half")

    mine, theirs, tasks = _in_pieces(placed, looks, ["_band", "_cell"], key, point_key)
    cut = ("_band", "_cell", "_mine", "_theirs")
    mine = mine.select(*[F.col(c).alias(f"{c}1") for c in cut], *[F.col(c).alias(f"_p{i}") for i, c in enumerate((key, *angles))])
    theirs = theirs.select(*cut, F.col(point_key).alias("_point"), *angles)
    mine, theirs = mine.repartition(tasks, *[f"{c}1" for c in cut]), theirs.repartition(tasks, *cut)
    same = T.all_of([F.col(f"{c}1") == F.col(c) for c in cut])
    # sin of half the difference of two angles, from sines and cosines of their halves
    dlat = F.col("_s") * F.col("_p2") - F.col("_c") * F.col("_p1")
    dlon = F.col("_u") * F.col("_p4") - F.col("_v") * F.col("_p3")
    hav = dlat * dlat + F.col("_w") * F.col("_p5") * (dlon * dlon)
    km = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.greatest(hav, F.lit(0.0)), F.lit(1.0))))
    # only of pairs at the very edge the arc is needed to tell
    edge = math.sin(radius_km / EARTH_KM / 2) ** 2 if radius_km < math.pi * EARTH_KM else 2.0
    inside = (hav <= edge * (1 - 1e-9) - 1e-14) | ((hav <= edge * (1 + 1e-9) + 1e-14) & (km <= radius_km))
    met = theirs.join(mine.hint("merge"), same & inside)
    return met.select(F.col("_point").alias(point_key), F.col("_p0").alias(key), km.alias("distance_km"))


def _in_pieces(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with the pieces (``_mine``, ``_theirs``) of a key's rows, of which every two meet once, and
    a number of tasks for them. Only keys of more than ``PIECE`` rows have pieces, so their list is small."""
    spark = left.sparkSession
    rows = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r")), on)
    parts = [F.ceil(F.col(c) / PIECE).cast("int").alias(n) for c, n in (("_l", "_nl"), ("_r", "_nr"))]
    sizes = durable(rows.select(*on, "_l", "_r", *parts))
    pieces, pairs, n = sizes.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (
        F.col("_nl").cast("double") * F.col("_nr"), F.col("_l").cast("double") * F.col("_r"), F.col("_l").cast("double") + F.col("_r"))]).first()
    large = sizes.where("_nl > 1 OR _nr > 1").select(*on, "_nl", "_nr")
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, pairs / PIECE ** 2, n / (1 << 20))

    def cut(df: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        many = df.join(F.broadcast(large), on, "left").withColumns({n_own: F.coalesce(n_own, F.lit(1)), n_other: F.coalesce(n_other, F.lit(1))})
        dealt = F.pmod(F.xxhash64(key, "_s", "_u"), F.col(n_own)).cast("int")
        return many.withColumn(own, dealt).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop(n_own, n_other)

    return (cut(left, left_key, "_mine", "_nl", "_theirs", "_nr"), cut(right, right_key, "_theirs", "_nr", "_mine", "_nl"),
            int(max(1, min(pieces, wanted))))


def rounded(value, places: int) -> Column:
    """``F.round`` of a number of moderate size, with decimal arithmetic only where the digit is in doubt."""
    x, scale = F.col(value) if isinstance(value, str) else value, 10.0 ** places
    y = x * scale
    sure = (F.abs(y) < 1e9) & (F.abs(y - F.floor(y) - 0.5) > 1e-6)
    return F.when(sure, F.floor(y + 0.5) / scale).otherwise(F.round(x, places))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))

