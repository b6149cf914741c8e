"""Writers read back, streams replayed."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from meadowlark import schemas
from meadowlark.operators import mutations as H
from meadowlark.operators import search as S
from meadowlark.operators.html import html_text
from meadowlark.plans import catalogue, listings
from meadowlark.sinks import files, render
from meadowlark.sources import tables
from meadowlark.streaming import ingest


def _org(spark, n=5):
    base = spark.range(1, n + 1).select(
        "id", F.concat(F.lit("Org "), F.col("id").cast("string")).alias("name"), F.lit("a farm community in the hills").alias("description"),
        F.lit("FR").alias("country"), (F.col("id") * 1.5).alias("latitude"), (F.col("id") * 2.5).alias("longitude"))
    return H.evolve_schema(base, schemas.ORGANIZATIONS)


def test_geojson_shapes(spark, tmp_path):
    org = _org(spark)
    files.write_geojson(org, "https://c.example", str(tmp_path / "lines"))
    back = tables.read_geojson_lines(spark, str(tmp_path / "lines"))
    assert {(r["id"], r["latitude"], r["longitude"]) for r in back.collect()} == {(i, i * 1.5, i * 2.5) for i in range(1, 6)}
    features = ",".join(r["feature"] for r in render.to_geojson(org, "https://c.example").collect())
    (tmp_path / "fc.json").write_text('{"type": "FeatureCollection", "features": [' + features + "]}")
    (tmp_path / "bare.json").write_text("[" + features + "]")
    for name in ("fc.json", "bare.json"):
        assert sorted(r["id"] for r in tables.read_geojson(spark, str(tmp_path / name)).collect()) == [1, 2, 3, 4, 5]


def test_schema_org_leaves_absent_parts_out(spark):
    bare = H.evolve_schema(spark.createDataFrame([(1, "A")], "id bigint, name string"), schemas.ORGANIZATIONS)
    text = bare.select(F.to_json(render.schema_org("https://c.example")).alias("j")).first()["j"]
    assert '"email"' not in text and '"geo"' not in text and '"address"' not in text and '"url":"https://c.example/?org=1"' in text


def test_icalendar(spark, tmp_path):
    org = _org(spark)
    ev = H.evolve_schema(spark.createDataFrame(
        [(1, 1, None, datetime(2024, 5, 1), datetime(2024, 5, 2)), (2, 1, "B", datetime(2024, 5, 1, 9, 30), None)],
        "id bigint, organization_id bigint, title string, start_date timestamp_ntz, end_date timestamp_ntz"), schemas.EVENTS)
    bare = org.withColumn("country", F.lit(None).cast("string"))
    got = {r["id"]: r["vevent"] for r in render.icalendar_events(ev, bare, "2024-01-01 00:00:00", "c.example").collect()}
    assert "DTSTART;VALUE=DATE:20240501\r\nDTEND;VALUE=DATE:20240502" in got[1] and "SUMMARY:Event" in got[1] and "LOCATION:TBD" in got[1]
    assert "DTSTART:20240501T093000" in got[2] and "DTEND" not in got[2]
    files.write_icalendar(render.icalendar_events(ev, org, "2024-01-01 00:00:00", "c.example"), str(tmp_path / "cal"), "Events")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "cal").glob("part-*")))
    assert text.startswith("BEGIN:VCALENDAR\r\n") and text.rstrip().endswith("END:VCALENDAR") and text.count("BEGIN:VEVENT") == 2


def test_sql_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's", True, None)], "id bigint, name string, flag boolean, n int")
    files.write_sql(df, "t", str(tmp_path / "up"))
    up = spark.read.text(str(tmp_path / "up")).first()["value"]
    assert up == ("INSERT INTO t (id, name, flag, n) VALUES (1, 'it''s', 1, NULL) ON CONFLICT(id) DO UPDATE SET "
                  "name=excluded.name, flag=excluded.flag, n=excluded.n;")
    files.write_sql(df, "t", str(tmp_path / "re"), "refresh")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "re")).collect()]
    assert lines[0] == "DELETE FROM t;" and len(lines) == 2


def test_vector_chunks_cover_the_input(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(130, 8)).astype(np.float32)
    vec = spark.createDataFrame([(i, v.tolist(), 0.0, 0.0) for i, v in enumerate(data)], "id long, embedding array<float>, lat double, lon double")
    files.write_vector_chunks(vec, str(tmp_path), "m", 50)
    back = tables.read_vector_lines(spark, str(tmp_path / "data")).orderBy("pos").collect()
    assert [r["id"] for r in back] == list(range(130))
    assert max(r["pos"] // 50 for r in back) == 2
    step = (data.max() - data.min()) / 255
    assert max(np.abs(np.array(r["embedding"]) - data[r["id"]]).max() for r in back) <= step
    head = spark.read.json(str(tmp_path / "index")).first()
    assert head["count"] == 130 and head["num_chunks"] == 3 and head["dim"] == 8


def test_csv_keeps_microseconds(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 1, 1, 1, 123456))], "id long, t timestamp_ntz")
    files.write_table(df, "csv", str(tmp_path / "c"))
    assert spark.read.options(**files.CLOCKS).csv(str(tmp_path / "c"), header=True, schema="id long, t timestamp_ntz").first() == df.first()


def _submission(name, text="a permaculture farm in the hills"):
    return (name, text, "FR", 1.0, 2.0)


def test_submissions_each_land_once(spark, tmp_path):
    cols = "name string, description string, country string, latitude double, longitude double"
    known = spark.createDataFrame([("Old Farm",)], "name string")
    def send(rows):
        spark.createDataFrame(rows, cols).write.mode("append").json(str(tmp_path / "in"))
    def run(ckpt="ckpt"):
        ingest.ingest_submissions(ingest.read_submissions(spark, str(tmp_path / "in")), lambda: known, str(tmp_path / "ok"),
                                  str(tmp_path / "no"), str(tmp_path / ckpt), "2024-01-01 00:00:00").awaitTermination()
    send([_submission("New"), _submission("new "), _submission("old farm"), _submission("Bad", "x")])
    run()
    send([_submission("NEW"), _submission("Third")])
    run()
    ok = sorted(r["name"].strip().lower() for r in spark.read.parquet(str(tmp_path / "ok")).collect())
    assert ok == ["new", "third"]
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "no")).collect()) == [
        "description", "duplicate_name", "duplicate_name", "duplicate_name"]
    run()  # nothing new: nothing changes
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2


def test_a_batch_of_submissions_reads_only_itself(spark, tmp_path):
    """Taken names are state: neither the organizations nor landed batches are read again, and a replay lands the same rows."""
    import shutil
    cols = "name string, description string, country string, latitude double, longitude double"
    reads = []

    def known():
        reads.append(1)
        return spark.createDataFrame([("Old Farm",), (None,)], "name string")

    def run():
        ingest.ingest_submissions(ingest.read_submissions(spark, str(tmp_path / "in")), known, str(tmp_path / "ok"),
                                  str(tmp_path / "no"), str(tmp_path / "ck"), "2024-01-01 00:00:00").awaitTermination()
    first = [_submission("New"), _submission("Old Farm"), _submission("new"), _submission(None), _submission("", "x"), *[_submission("Hot")] * 50]
    spark.createDataFrame(first, cols).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()
    landed = sorted((r["name"], r["latitude"], r["source"]) for r in spark.read.parquet(str(tmp_path / "ok")).collect())
    assert [x[0].lower() for x in landed] == ["hot", "new"] and {x[2] for x in landed} == {"user_submitted"}
    assert spark.read.parquet(str(tmp_path / "no")).count() == len(first) - 2
    shutil.rmtree(tmp_path / "ok")  # what landed is not needed to decide
    spark.createDataFrame([_submission("hot "), _submission("OLD FARM"), _submission("Later")], cols).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["Later"]
    # the batch again, as after a failure between landing and commit
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["Later"]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_pages_are_extracted_once(spark, tmp_path):
    def add(i):
        spark.createDataFrame([(i, f"u{i}", f"<p>page {i}</p>")], "page_id bigint, url string, html string").write.mode("append").parquet(str(tmp_path / "in"))
    def run():
        ingest.extract_pages_stream(ingest.read_new_pages(spark, str(tmp_path / "in")), lambda p: html_text(p, "simple").select("page_id", "text"),
                                    str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    add(1)
    run()
    add(2)
    run()
    run()
    assert sorted((r["page_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "page 1"), (2, "page 2")]


def test_event_counts_stream(spark, tmp_path):
    spark.createDataFrame([(datetime(2024, 1, 1, 5), "a"), (datetime(2024, 1, 1, 6), "a"), (datetime(2024, 1, 9), "b")],
                          "start_date timestamp_ntz, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("start_date timestamp_ntz, event_type string").parquet(str(tmp_path / "in"))
    q = (ingest.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.sql("SELECT * FROM counts").collect()}
    assert got == {(datetime(2024, 1, 1), "a"): 2, (datetime(2024, 1, 9), "b"): 1}


# --- composite plans ------------------------------------------------------------------------------

def _site(spark, pages):
    org = H.evolve_schema(spark.createDataFrame([(1, "Farm", "https://a.org"), (2, "Quiet", "https://b.org")],
                                                "id bigint, name string, website string"), schemas.ORGANIZATIONS)
    return org, spark.createDataFrame(pages, "page_id bigint, url string, html string")


FILLER = "<p>We are looking for a volunteer who wants this position on the farm and likes the garden work all year long.</p>" * 8


def test_discover_jobs_stays(spark):
    org, pages = _site(spark, [(1, "https://a.org/volunteer", FILLER), (2, "https://a.org/stay", "<form></form>book now per night " + "x " * 400)])
    old = H.evolve_schema(spark.createDataFrame([(9, 1, "old", "d"), (10, 2, "kept", "d")], "id bigint, organization_id bigint, title string, description string"),
                          schemas.VOLUNTEER_OPPORTUNITIES)
    got = listings.discover_jobs_stays(org, pages, old, H.evolve_schema(spark.range(0), schemas.STAYS), "2024-01-01 00:00:00")
    titles = {(r["organization_id"], r["title"]) for r in got.jobs.collect()}
    assert (2, "kept") in titles and (1, "old") not in titles and any(o == 1 for o, _ in titles)
    assert [(r["organization_id"], r["booking_type"]) for r in got.stays.collect()] == [(1, "direct_form")]
    flags = {r["id"]: (r["has_jobs"], r["has_stays"], r["last_scrape_attempt"]) for r in got.organizations.collect()}
    assert flags == {1: (True, True, datetime(2024, 1, 1)), 2: (False, False, datetime(2024, 1, 1))}


def test_discover_events_falls_back_to_home_links(spark):
    card = '<div class="event-card"><h3>{}</h3> January 15, 2026 at the farm location with all of us</div>'
    org, pages = _site(spark, [(1, "https://a.org/events", card.format("Spring work week")), (2, "https://b.org/", '<a href="/our-event-page">Our event</a>'),
                               (3, "https://b.org/our-event-page", card.format("Autumn harvest days"))])
    got = listings.discover_events(org, pages, "2024-01-01 00:00:00")
    assert {(r["organization_id"], r["title"], r["start_date"]) for r in got.events.collect()} == {
        (1, "Spring work week", datetime(2026, 1, 15)), (2, "Autumn harvest days", datetime(2026, 1, 15))}
    assert all(r["has_events"] for r in got.organizations.collect())


def test_refine_events_applies_to_all_of_the_url(spark):
    _, pages = _site(spark, [(1, "https://a.org/e", '<meta property="event:start_time" content="2025-03-01T18:00"><a href="https://zoom.us/j/1">x</a> online')])
    ev = H.evolve_schema(spark.createDataFrame([(1, 1, "https://a.org/e", None), (2, 1, "https://a.org/e", "July 11, 2021"), (3, 1, "https://c.org", None)],
                                               "id bigint, organization_id bigint, event_url string, start_raw string"), schemas.EVENTS).withColumn(
        "end_raw", F.lit(None).cast("string"))
    got = {r["id"]: (r["start_date"], r["registration_url"]) for r in listings.refine_events(ev, pages).collect()}
    assert got == {1: (datetime(2025, 3, 1, 18), "https://zoom.us/j/1"), 2: (datetime(2021, 7, 11), "https://zoom.us/j/1"), 3: (None, None)}


def test_enrich_descriptions_prefers_the_sitemap(spark):
    prose = "This is our long story about the land and the people who live on it together. "
    org, pages = _site(spark, [(1, "https://a.org/about", f"<p>{prose * 3}</p>"), (2, "https://a.org", "<p>home</p>" * 60), (3, "https://b.org", f"<p>Quiet place. {prose * 3}</p>")])
    docs = spark.createDataFrame([("https://a.org/robots.txt", "Sitemap: https://a.org/m.xml"), ("https://a.org/m.xml", "<urlset><url><loc>https://a.org/about</loc></url></urlset>")],
                                 "url string, body string")
    ledger = spark.createDataFrame([], "id bigint")
    got = {r["id"]: r["description"] for r in catalogue.enrich_descriptions(org, pages, docs, ledger, "placeholder").collect()}
    assert got[1].startswith("This is our long story") and got[2].startswith("Quiet place.")
    assert catalogue.enrich_descriptions(org, pages, docs, org.select("id"), "placeholder").count() == 0
    # a site on a directory is not read
    away = catalogue.enrich_descriptions(org, pages, docs, ledger, "placeholder", directories=["b.org"])
    assert [r["id"] for r in away.collect()] == [1]


def test_fill_websites_by_other_steps(spark):
    org = spark.createDataFrame([(1, "Green Valley Farm", "", "s"), (2, "Sun", None, "s"), (3, "Sun", "http://has", "s"), (4, "Sun", "", "other")],
                                "id long, name string, website string, source string")
    ref = spark.createDataFrame([("the valley of green", 0, "u0"), ("sun", 1, "u1")], "name string, pos long, url string")
    got = {r["id"]: r["website"] for r in catalogue.fill_websites(org, ref, "s", steps=("exact", "tokens")).collect()}
    assert got == {1: "u0", 2: "u1", 3: "http://has", 4: ""}


def test_merge_directories_numbers_new_rows(spark):
    org = _org(spark)
    listed = spark.createDataFrame([("org 1", "d", "", 7), ("Brand New", "d", "https://n.org", 8)], "name string, description string, website string, record_id bigint")
    payloads = spark.createDataFrame([(9, '[{"title":{"rendered":"<b>Api</b>"},"content":{"rendered":"x"},"link":"https://api.org","meta":{"latitude":"0"},"acf":{"latitude":"4.5"}},{"title":"Plain","link":"https://p.org"}]')],
                                     "record_id bigint, body string")
    got = catalogue.merge_directories(listed, payloads, org, "api")
    assert [(r["id"], r["name"], r["latitude"]) for r in got.added.orderBy("id").collect()] == [(6, "Brand New", None), (7, "Api", 4.5), (8, "Plain", None)]
    assert got.organizations.count() == 8 and got.organizations.where("has_jobs = false").count() == 3


def test_vector_index_of_located_organizations(spark):
    index = catalogue.build_vector_index(_org(spark), S.hashed_words(16), chunk=2)
    assert index.header.first()["num_chunks"] == 3 and index.chunks.agg(F.max("chunk")).first()[0] == 2


def test_refine_jobs_replaces_only_found_parents(spark):
    org, pages = _site(spark, [(1, "https://a.org/participate", FILLER + "<p>Required skills: carpentry and gardening. Mail jane@a.org</p>")])
    old = H.evolve_schema(spark.createDataFrame([(9, 1, "old", "d"), (10, 2, "kept", "d")], "id bigint, organization_id bigint, title string, description string"),
                          schemas.VOLUNTEER_OPPORTUNITIES)
    got = listings.refine_jobs(org, old, pages).collect()
    assert sorted(r["organization_id"] for r in got) == [1, 2] and {r["title"] for r in got} >= {"kept"}
    new = next(r for r in got if r["organization_id"] == 1)
    assert new["skills_needed"] == "carpentry and gardening" and new["application_email"] == "jane@a.org"


def test_refine_stays_reads_the_booking_page(spark):
    org, pages = _site(spark, [(1, "https://a.org/book", "<title>Yurt stay | Farm</title><form></form><p>book now, $45 per night in a yurt</p>")])
    stays = H.evolve_schema(spark.createDataFrame([(1, 1, "https://a.org/book"), (2, 2, "https://gone.org")], "id bigint, organization_id bigint, booking_url string"),
                            schemas.STAYS)
    got = listings.refine_stays(stays, org, pages)
    rows = {r["id"]: (r["title"], r["price_info"], r["stay_type"], r["booking_type"], r["rescraped"]) for r in got.stays.collect()}
    assert rows == {1: ("Yurt stay", "$45 per night", "glamping", "direct_form", 1), 2: (None, None, None, None, None)}
    assert {(r["booking_type"], r["n"]) for r in got.summary.collect()} == {("direct_form", 1), (None, 1)}


def test_redescribe_jobs_shares_one_reading(spark):
    meta = "A calm place in the hills where guests join in the daily garden work and share their meals together."
    org, pages = _site(spark, [(1, "https://a.org/j", f'<meta name="description" content="{meta}"><title>Garden helper - Farm</title>' + FILLER)])
    jobs = H.evolve_schema(spark.createDataFrame([(1, 1, "https://a.org/j", "old"), (2, 2, "https://a.org/j", "old"), (3, 1, "https://expireddomains.x", "old")],
                                                 "id bigint, organization_id bigint, source_url string, title string"), schemas.VOLUNTEER_OPPORTUNITIES)
    got = {r["id"]: (r["title"], r["description"]) for r in listings.redescribe_jobs(jobs, org, pages).collect()}
    assert got == {1: ("Garden helper", meta), 2: ("Garden helper", meta), 3: ("old", None)}


def test_board_variants(spark):
    body = "<h2>Garden Helper</h2><p>We have a volunteer place with work exchange in the garden for the whole summer season.</p>" * 3
    lodging = "<p>Stay with us in the guest room. Book your stay per night, check-in after noon. " + "Quiet place. " * 12 + "</p>"
    org, pages = _site(spark, [(1, "https://a.org/volunteer", body), (2, "https://b.org/rooms", lodging)])
    jobs = listings.board_jobs(org, pages).collect()
    assert {r["organization_id"] for r in jobs} == {1} and {r["title"] for r in jobs} == {"Garden Helper"}
    assert [(r["organization_id"], r["title"]) for r in listings.board_stays(org, pages).collect()] == [(2, "Stay with us in the guest room")]


def test_json_files_are_read_in_splits(spark, tmp_path):
    """Arrays, objects one after the other and collections, cut at any place: in strings, after escapes, between braces."""
    import json
    import random

    from meadowlark.sources.json_splits import json_objects
    rng = random.Random(2)
    odd = ["}", "{", '"', "\\", "\\\\", "}{", "[]", "é", "\n", 'a"}b', ""]

    def thing(depth=0):
        return {rng.choice("abc{}"): thing(depth + 1) if depth < 3 and rng.random() < .4 else rng.choice([*odd, 1, None, [{"q": "}"}], {}]) for _ in range(rng.randint(0, 3))}
    records = [{"id": i, "text": "".join(rng.choice(odd) for _ in range(rng.randint(0, 9))), "more": thing()} for i in range(120)]
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "one.json").write_text(json.dumps(records))
    (tmp_path / "array" / "two.json").write_text(json.dumps(records, indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "array" / "none.json").write_text("[]")
    (tmp_path / "array" / "empty.json").write_text("")
    (tmp_path / "array" / "loose.json").write_text("\n".join(map(json.dumps, records[:7])))
    (tmp_path / "map").mkdir()
    (tmp_path / "map" / "one.json").write_text(json.dumps({"type": "FeatureCollection", "features": records, "crs": {"x": 1}}))
    want = sorted(json.dumps(r, sort_keys=True) for r in records)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64m", "997", "37"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = sorted(json.dumps(json.loads(r["value"]), sort_keys=True) for r in json_objects(spark, str(tmp_path / "array")).collect())
            assert got == sorted(2 * want + [json.dumps(r, sort_keys=True) for r in records[:7]])
            inner = [json.loads(r["value"]) for r in json_objects(spark, str(tmp_path / "map"), "features").collect()]
            assert sorted(json.dumps(r, sort_keys=True) for r in inner if "id" in r) == want
            if size == "997":
                assert json_objects(spark, str(tmp_path / "array")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    read = tables.read_json(spark, str(tmp_path / "array"), "id int, text string")
    assert read.count() == 247 and sorted(r["text"] for r in read.where("id = 5").collect()) == sorted([records[5]["text"]] * 3)


def test_names_of_a_group_are_taken_one_by_one(spark, tmp_path, monkeypatch):
    """All names in one group of the state: known ones, repeated ones and those of a later batch."""
    monkeypatch.setattr(ingest, "NAME_GROUPS", 1)
    cols = [f.name for f in schemas.SUBMISSIONS.fields]

    def send(batch, names):
        rows = [{"name": n, "description": f"an organic farm and ecovillage community {batch} {i}", "country": "Spain", "latitude": 1.0, "longitude": 2.0} for i, n in enumerate(names)]
        spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schemas.SUBMISSIONS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        known = spark.createDataFrame([("Old Farm",), (None,), ("old farm",), ("other",)], "name string")
        ingest.ingest_submissions(ingest.read_submissions(spark, str(tmp_path / "in")), lambda: known, str(tmp_path / "ok"),
                                  str(tmp_path / "no"), str(tmp_path / "ckpt"), datetime(2024, 1, 10)).awaitTermination()
        return sorted(r["name"].lower() for r in spark.read.parquet(str(tmp_path / "ok")).collect())

    assert send(1, ["old farm", "New", " new ", "Third"]) == ["new", "third"]
    assert send(2, ["third", "OTHER", "Fourth", "new"]) == ["fourth", "new", "third"]
    assert spark.read.parquet(str(tmp_path / "no")).count() == 5


def test_bodies_cross_in_small_batches(spark):
    from meadowlark.operators import html as HT

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        pages = spark.range(600).select(F.concat(F.lit("<p>a "), "id", F.lit("</p><script>x</script>")).alias("html"))
        assert {r["text"] for r in HT.html_text(pages).collect()} == {f"a {i}" for i in range(600)}
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= HT.BATCH_PAGES
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
