"""Golden values of the column functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meadowlark.functions import dates, urls
from meadowlark.functions import extract as X
from meadowlark.functions import text as T
from meadowlark.functions import vectors as V
from meadowlark.operators import privacy
from meadowlark.operators.search import stop_word_place
from meadowlark.sinks import render


@pytest.mark.parametrize("raw,slug", [("O'Hara  Eco-Village (UK)", "ohara-eco-village-uk"), ("  A -- b ", "a-b")])
def test_slugify(one, raw, slug):
    assert one(T.slugify("s"), s=raw) == slug


@pytest.mark.parametrize("raw,fixed", [("http://x/yhttp://x/y", "http://x/y"), ("www.a.org", None), (" https://a.org ", "https://a.org")])
def test_repair_url(one, raw, fixed):
    assert one(urls.repair_url("s"), s=raw) == fixed


def test_ics_escape(one):
    assert one(T.ics_escape("s"), s="a,b;c") == "a" + chr(92) + ",b" + chr(92) + ";c"
    assert one(T.ics_escape("s"), s="x\\y\r\nz") == "x\\\\y\\nz"


@pytest.mark.parametrize("raw,parsed", [
    ("2024-05-01T10:30", datetime(2024, 5, 1, 10, 30)), ("2024-05-01T10:30:15Z", datetime(2024, 5, 1, 10, 30, 15)),
    ("2024-05-01", datetime(2024, 5, 1)), ("July 11, 2021", datetime(2021, 7, 11)), ("jul 11 2021", datetime(2021, 7, 11)),
    ("11 July 2021", datetime(2021, 7, 11)), ("07/11/2021", datetime(2021, 7, 11)), ("25/12/2021", datetime(2021, 12, 25)),
    ("15.01.2026", datetime(2026, 1, 15)), ("15-01-2026", datetime(2026, 1, 15)), ("Sunday, July 11, 2021", datetime(2021, 7, 11)),
    ("July 11, 2021 2:00 pm", datetime(2021, 7, 11, 14)), ("July 11, 2021 at 2:00 PM", datetime(2021, 7, 11, 14)),
    ("next week", None), ("2024-13-45", None), ("", None),
])
def test_parse_date(one, raw, parsed):
    assert one(dates.parse_date("s"), s=raw) == parsed


@pytest.mark.parametrize("raw,minutes", [("doors at 2:30 PM", 870), ("from 7pm", 1140), ("14:05 sharp", 845), ("12 am", 0), ("none", None)])
def test_first_clock(one, raw, minutes):
    assert one(dates.first_clock("s"), s=raw) == minutes


@pytest.mark.parametrize("text,mail", [("info@a.org jane@a.org", "jane@a.org"), ("info@a.org", "info@a.org"), ("none", None)])
def test_contact_email(one, text, mail):
    assert one(X.contact_email("s"), s=text) == mail


@pytest.mark.parametrize("text,role", [
    ("paid internship", "internship"), ("apprentice, salary", "apprenticeship"), ("full time", "paid_job"),
    ("help us", "volunteer"), ("internal note", "internship"),
])
def test_job_role(one, text, role):
    assert one(X.job_role("s"), s=text) == role


@pytest.mark.parametrize("text,price", [("€45 per night", "€45 per night"), ("rooms $20-40", "$20-40"), ("we take EUR 30", "EUR 30"), ("free", None)])
def test_price_info(one, text, price):
    assert one(X.price_info("s"), s=text) == price


@pytest.mark.parametrize("text,types", [("a yurt and a cabin", "glamping, cabin"), ("beds", "accommodation")])
def test_stay_types(one, text, types):
    assert one(X.stay_types("s"), s=text) == types


@pytest.mark.parametrize("html,kind", [
    ("<form></form> book now per night", "direct_form"), ("<iframe></iframe>", "external_widget"), ("calendly", "calendar_tool"),
    ("a@b.org reserve", "email_phone"), ("a@b.org", "unknown"), ("<a href='https://airbnb.com/x'>x</a>", "external_widget"),
])
def test_booking_class(one, html, kind):
    assert one(X.booking_class(X.booking_features("h", "h")), h=html) == kind


def test_calendar_system(one):
    assert one(X.calendar_system("h"), h='meetup.com <a href="/x.ics">') == "ics_feed"
    assert one(X.calendar_system("h"), h="eventbrite") == "eventbrite"
    assert one(X.calendar_feed("h", F.lit("https://a.org/e/")), h='<a href="/x.ics">') == "https://a.org/x.ics"


def test_event_dates(one):
    assert one(X.event_dates("s"), s="Jan 15, 2026 - Jan 17, 2026") == ["Jan 15, 2026", "Jan 17, 2026"]


def test_job_attributes(one):
    text = "Required skills: carpentry and gardening. Minimum stay: three full weeks. Start date: 07/11/2025 work from home a@b.org"
    a = one(X.job_attributes("s"), s=text)
    assert a["skills_needed"] == "carpentry and gardening"
    assert a["commitment"] == "Minimum stay: three full weeks"
    assert a["start_date"] == datetime(2025, 7, 11) and a["remote_options"] and a["application_email"] == "a@b.org"


def test_job_blocks(one):
    filler = "We are looking for a volunteer who wants this position on the farm and likes the garden work all year long. "
    text = "Intro words. " + "GARDEN HELPER NEEDED " + filler + "KITCHEN HELPER NEEDED " + filler
    got = one(X.job_blocks("s", F.lit("Farm")), s=text)
    assert [g["role"] for g in got] == ["volunteer", "volunteer"] and all("HELPER NEEDED" in g["title"] for g in got)
    whole = one(X.job_blocks("s", F.lit("Farm"), min_len=10_000), s=filler * 4 + "apply")
    assert len(whole) == 1
    assert one(X.job_blocks("s", F.lit("Farm")), s="short volunteer position") == []


def test_title_blocks(one):
    long = "this is a long description of the work that has to be done here every day"
    text = f"preface\nGARDENER\n{long}\nmore text\nCook:\n{long}"
    assert one(X.title_blocks("s"), s=text) == [("GARDENER", f"{long} more text"), ("Cook:", long)]


def test_job_title(one):
    e = X.job_title("h", "t", F.lit("Farm"))
    assert one(e, h="Garden helper | Farm", t="x") == "Garden helper"
    assert one(e, h="Cookie policy", t="Home helper wanted - Farm") == "Home helper wanted"
    assert one(e, h=None or "", t="") == "Volunteer at Farm"


def test_best_sentences_bonus_and_scan(one):
    plain = [f"plain sentence number {i} without any of those words." for i in range(8)]
    late = "we are seeking a volunteer to help with permaculture."
    best = one(X.best_sentences("s", scan=15, keep=4), s=" ".join(plain + [late]))
    # the late sentence outscores the early bonus; after five accepted, plain ones drop out
    assert best.startswith(late) and "number 0" in best and "number 3" not in best


def test_lead_sentences(one):
    text = "Menu toggle navigation stuff here for all. The garden lies behind the old stone house. It feeds thirty people. All year long they work on it together."
    assert one(X.lead_sentences("s"), s=text).startswith("The garden lies behind")


def test_job_description_prefers_meta(one):
    meta = "A calm place in the hills where guests join in the daily garden work and share their meals together."
    e = X.job_description("s", F.lit("T"), F.lit("Farm"), "m")
    assert one(e, s="text", m=meta) == meta
    assert one(e, s="T Farm — We need help in the garden and with the animals all summer long. ", m="").startswith("We need help")


def test_clean_text(one):
    assert one(X.clean_text("s"), s="| Skip to Content  Hello [LINK:/x] world All rights reserved") == "Hello world"


def test_markdown_block(one):
    md = "Title: x\nMarkdown Content:\n## About\nNothing here\n## Who\nWe are a **community** [site](http://a)"
    assert one(X.markdown_block("s"), s=md) == "Who We are a community site"
    assert one(X.markdown_block("s"), s="no marker") is None


def test_popup_description(one):
    e = X.popup_description("h", ["Network"])
    assert one(e, h="<strong>N</strong><p>Title: x</p>tail") == ""
    assert one(e, h="<p>Title: x</p><strong>N</strong> tail<br>more") == "tail"
    assert one(e, h="<p>Good <b>text</b></p>") == "Good text"
    assert one(e, h="<p>Network page</p>") == ""


def test_geo_and_website(one):
    p = one(X.geo_point("h"), h='<i data-lat="48.5" x data-lng="-2.25">')
    assert (p["latitude"], p["longitude"]) == (48.5, -2.25)
    html = '<a href="https://facebook.com/x">f</a><a href="https://me.org/">own</a><a href="https://site.org">s</a>'
    assert one(X.own_website("h", F.lit("https://me.org/p")), h=html) == "https://site.org"


def test_video_link(one):
    assert one(X.video_link("h", "h"), h='see <a href="zoom.us/j/99">x</a>') == "https://zoom.us/j/99"
    assert one(X.video_link("h", F.lit("call youtu.be/abc now")), h="") == "https://youtu.be/abc"


@pytest.mark.parametrize("base,rel,full", [
    ("https://a.org/x/y", "/z", "https://a.org/z"), ("https://a.org/x/y", "z", "https://a.org/x/z"),
    ("https://a.org/x/", "z", "https://a.org/x/z"), ("https://a.org/x", "//b.org", "https://b.org"), ("https://a.org", "http://c", "http://c"),
])
def test_resolve(one, base, rel, full):
    assert one(urls.resolve("b", "r"), b=base, r=rel) == full


@pytest.mark.parametrize("ip,masked", [("8.8.8.8", "8.8.8.0"), ("127.0.0.1", "127.0.0.1"), ("2001:db8::1", "2001:db8::1"), ("8.8.8.0", "8.8.8.0")])
def test_anonymize(one, ip, masked):
    assert one(privacy.anonymize_ip("i"), i=ip) == masked


def test_quantize_round_trip(one):
    assert one(V.quantize("v"), v=[-1.0, 0.0, 1.0]) == [0, 127, 255]
    back = one(V.dequantize(V.quantize("v")), v=[-0.3, 0.01, 0.77])
    assert all(abs(a - b) <= 2 / 255 for a, b in zip(back, [-0.3, 0.01, 0.77]))
    assert one(V.unpack_codes(V.pack_codes("v")), v=[0, 7, 255]) == [0, 7, 255]


def test_fold_line(one):
    folded = one(render.fold_line("s"), s="x" * 80)
    assert folded == "x" * 73 + "\r\n " + "x" * 7
    assert one(render.fold_line("s"), s="y" * 75) == "y" * 75


def test_stop_word_place(one):
    assert one(stop_word_place("s"), s="living in Peace") == ""
    assert one(stop_word_place("s"), s="farms in Costa Rica") == "Costa Rica"
