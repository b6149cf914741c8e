"""Golden rows, invariants and brute-force comparisons of the operators."""

import random
from datetime import datetime
from difflib import SequenceMatcher
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadowlark import schemas
from meadowlark.functions import extract as X
from meadowlark.functions import text as T
from meadowlark.operators import aggregates as A
from meadowlark.operators import filters as B
from meadowlark.operators import joins as C
from meadowlark.operators import matching as M
from meadowlark.operators import mutations as H
from meadowlark.operators import privacy as L
from meadowlark.operators import ranking as E
from meadowlark.operators import search as S
from meadowlark.operators.events import event_blocks
from meadowlark.operators.html import html_text, visible_text
from meadowlark.scale import list_pages, meet_in_blocks, number_rows, rank_within
from meadowlark.sources import gazetteer as Z
from meadowlark.sources import web


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_flags(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, has_jobs boolean")
    assert rows(B.filter_flags(df, has_jobs=True).select("id")) == [(1,)]
    assert rows(B.filter_flags(df, has_jobs=False).select("id")) == [(2,)]
    with pytest.raises(ValueError):
        B.filter_flags(df, nonsense=True)


def test_text_search_wildcards_and_nulls(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "xyz")], "id int, a string, b string")
    assert rows(B.text_search(df, "a%c", ["a", "b"]).select("id")) == [(1,)]


def test_period_rollover(spark):
    df = spark.createDataFrame([(1, datetime(2025, 12, 31, 23, 59, 59)), (2, datetime(2026, 1, 1))], "id int, start_date timestamp_ntz")
    assert rows(B.in_period(df, 2025, 12).select("id")) == [(1,)]
    assert B.in_period(df, None, 5).count() == 2


def test_upcoming_is_typed(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 10, 9))], "id int, start_date timestamp_ntz")
    assert B.upcoming(df, "2024-01-10 12:00:00").count() == 0


def test_blocked_hosts(spark):
    df = spark.createDataFrame([("https://www.facebook.com/a",), ("https://m.facebook.com/a",), ("https://fox.com",), ("x.com/a",), (None,)], "url string")
    assert rows(B.allowed_urls(df)) == [("https://fox.com",)]


def test_validate(spark):
    base = dict(name="Zed", description="x" * 25 + " permaculture", organization_type=None, country="FR", latitude=0.0, longitude=1.0)
    cases = [base, {**base, "description": "x" * 19}, {**base, "description": "y" * 30}, {**base, "name": " a "}, {**base, "country": " "},
             {**base, "latitude": None}]
    df = spark.createDataFrame([tuple(c.values()) for c in cases],
                               "name string, description string, organization_type string, country string, latitude double, longitude double")
    v = B.validate(df)
    assert [r["reason"] for r in v.collect()] == [None, "description", "keywords", "name", "country", "coordinates"]
    assert B.accepted(v).count() + B.rejected(v).count() == df.count()


def test_location_filter(spark):
    org = spark.createDataFrame([(1, "FR"), (2, "france "), (3, "BR"), (4, "XX")], "id int, country string")
    g = Z.gazetteer(spark)
    assert rows(B.filter_location(org, "Europe", g).select("id")) == [(1,), (2,)]
    assert rows(B.filter_location(org, "Brazil", g).select("id")) == [(3,)]
    assert rows(B.filter_location(org, "xx", g).select("id")) == [(4,)]


def test_query_location(spark):
    texts = ["permaculture in Brazil", "organic farm Costa Rica", "eco village in Europe", "farm South Africa", "just do it", "farm US", "garden"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")
    got = {r["text"]: (r["cleaned"], r["place"]) for r in S.query_location(q, Z.gazetteer(spark)).collect()}
    assert got == {
        "permaculture in Brazil": ("permaculture", "BR"), "organic farm Costa Rica": ("organic farm", "CR"),
        "eco village in Europe": ("eco village", "Europe"), "farm South Africa": ("farm", "ZA"),
        "just do it": ("just do it", None), "farm US": ("farm", "US"), "garden": ("garden", None),
    }


def test_new_records(spark):
    existing = spark.createDataFrame([("green valley", "https://a.org")], "name string, website string")
    incoming = spark.createDataFrame([(1, " Green Valley ", ""), (2, "New", "https://A.org/"), (3, "Other", ""), (4, "other", None)],
                                     "id int, name string, website string")
    assert rows(C.new_records(incoming, existing, [F.col("id")]).select("id")) == [(3,)]


def test_lookup_last_wins_and_propagate(spark):
    ref = spark.createDataFrame([("a", "first", 1), ("a", "last", 2)], "name string, v string, pos int")
    df = spark.createDataFrame([("a",), ("b",)], "name string")
    assert rows(C.lookup_by_name(df, ref, "v", "pos").fillna("-")) == [("a", "last"), ("b", "-")]


def test_discover_page_takes_first_path(spark):
    sites = spark.createDataFrame([(1, "https://a.org/"), (2, "b.org")], "id int, website string")
    good = "volunteer " + "x" * 600
    pages = spark.createDataFrame([(1, "https://a.org/jobs", good), (2, "https://a.org/volunteer", "x" * 600), (3, "https://a.org/careers", good),
                                   (4, "https://b.org/participate", good)], "page_id int, url string, html string")
    paths = ["volunteer", "jobs", "careers", "a", "b", "c", "participate"]
    got = C.discover_page(sites, pages, paths, C.page_passes("html", ["volunteer"]), max_checks=6).select("id", "page_id")
    assert rows(got) == [(1, 1)]
    assert rows(C.discover_page(sites, pages, paths, C.page_passes("html", ["volunteer"]), max_checks=None).select("id", "page_id")) == [(1, 1), (2, 4)]
    # the same pages come out of the candidate list itself
    cands = C.candidate_urls(sites, paths)
    assert cands.count() == 14 and cands.where("candidate_url = 'https://b.org/participate'").count() == 1


def test_merge_by_location(spark):
    df = spark.createDataFrame([(1, "Project #1", 48.12341, 2.0, ["a"]), (2, "Real Name", 48.12339, 2.0, ["b"]), (3, "Far", 1.0, 1.0, None)],
                               "id int, name string, lat double, lng double, sources array<string>")
    got = {r["id"]: (r["name"], r["sources"], r["n_merged"]) for r in A.merge_by_location(df, F.col("name").startswith("Project #")).collect()}
    assert got == {2: ("Real Name", ["a", "b"], 2), 3: ("Far", [], 1)}


def test_group_null_is_kept(spark):
    df = spark.createDataFrame([(None,), ("a",), (None,)], "source string")
    assert sorted(((r[0] or "", r[1]) for r in A.count_by(df, "source").collect())) == [("", 2), ("a", 1)]


@pytest.mark.parametrize("n,expected", [(3, [99, 52, 5]), (1, [99])])
def test_rank_percent(spark, n, expected):
    df = spark.createDataFrame([(i, float(-i)) for i in range(n)], "id int, score double")
    assert [r["pct"] for r in E.rank_percent(df, [F.col("score").desc()]).orderBy("rank").collect()] == expected


def test_dedupe_keeps_blanks_and_is_idempotent(spark):
    df = spark.createDataFrame([(0, "A "), (1, "a"), (2, ""), (3, ""), (4, None)], "id int, title string")
    once = E.dedupe_first(df, "title", [F.col("id")])
    assert rows(once.select("id")) == [(0,), (2,), (3,), (4,)]
    assert rows(E.dedupe_first(once, "title", [F.col("id")]).select("id")) == rows(once.select("id"))


def test_calendar_top_three(spark):
    df = spark.createDataFrame([(i, datetime(2024, 5, 1, i)) for i in range(5)], "id int, start_date timestamp_ntz")
    got = E.calendar_month(df, 2024, 5).orderBy("slot").collect()
    assert [r["id"] for r in got] == [0, 1, 2] and {r["more"] for r in got} == {2}
    assert [r["clock"] for r in got] == ["", "1:00 AM", "2:00 AM"]


def test_unique_claim(spark):
    df = spark.createDataFrame([(1, "", "u"), (2, None, "u"), (3, "", "taken"), (4, "taken", "z")], "id int, website string, directory_url string")
    got = {r["id"]: r["website"] for r in E.fill_unique(df).collect()}
    assert got[1] == "u" and not got[2] and not got[3] and got[4] == "taken"


def test_upsert_idempotent(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    delta = spark.createDataFrame([(2, "new"), (3, "new")], "id int, v string")
    once = H.upsert(base, delta)
    assert rows(once) == [(1, "old"), (2, "new"), (3, "new")] == rows(H.upsert(once, delta))


def test_replace_children(spark):
    old = spark.createDataFrame([(1, "o1"), (2, "o2")], "organization_id int, v string")
    new = spark.createDataFrame([(1, "n1")], "organization_id int, v string")
    assert rows(H.replace_children(old, new)) == [(1, "n1"), (2, "o2")]


def test_fill_website_counts_blank_as_missing(spark):
    df = spark.createDataFrame([("", None, "http://d")], "website string, direct_website string, directory_url string")
    assert H.fill_website(df).first()["website"] == "http://d"


def test_merge_sources_policies(spark):
    a = spark.createDataFrame([(1, "a", None), (2, None, "x")], "id int, c string, n string")
    b = spark.createDataFrame([(1, "b", "y"), (2, "b", "y")], "id int, c string, n string")
    c = spark.createDataFrame([(1, "c")], "id int, c string")
    assert rows(H.merge_sources([a, b, c], ["fill", "fill", "override"], "id")) == [(1, "c", "y"), (2, "b", "x")]


def test_release_and_stale(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 11, 0)), (2, datetime(2024, 1, 1, 11, 50)), (3, None)], "id int, lease timestamp_ntz")
    assert rows(B.stale(df, "lease", "2024-01-01 12:00:00", 30).select("id")) == [(1,)]
    assert H.release(df, "lease", "2024-01-01 12:00:00", 30).where("lease is null").count() == 2


def test_purge_boundary(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2023, 12, 31, 23, 59, 59))], "id int, t timestamp_ntz")
    assert rows(L.purge(df, "t", "2024-06-29 00:00:00", 180).select("id")) == [(1,)]


def test_evolve_schema_adds_only(spark):
    df = spark.createDataFrame([(1, "x")], "id bigint, extra string")
    out = H.evolve_schema(df, schemas.EVENTS)
    assert out.columns[:2] == ["id", "extra"] and set(schemas.EVENTS.fieldNames()) <= set(out.columns)


def test_pages_partition_the_order(spark):
    df = spark.range(57)
    seen = [r["id"] for skip in range(0, 60, 20) for r in E.paginate(df, skip, 20).collect()]
    assert seen == list(range(57))


def test_numbering_with_hot_key(spark):
    """Numbers, ranks and list pages are exact although one key holds most rows."""
    random.seed(3)
    data = [(i, "hot" if i % 3 else f"k{i % 40}", random.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, key string, score double").repartition(7)
    order = [F.col("score").desc(), F.col("id")]
    expected = sorted(data, key=lambda r: (-r[2], r[0]))
    assert [r["id"] for r in number_rows(df, order).orderBy("pos").collect()] == [r[0] for r in expected]
    ranked = {r["id"]: r["rank"] for r in rank_within(df, ["key"], order).collect()}
    counts, truth = {}, {}
    for r in expected:
        counts[r[1]] = counts.get(r[1], 0) + 1
        truth[r[0]] = counts[r[1]]
    assert ranked == truth
    pages = list_pages(df, ["key"], order, F.col("id"), 50).collect()
    assert max(len(p["items"]) for p in pages) <= 50
    joined = {}
    for p in sorted(pages, key=lambda p: (p["key"], p["page"])):
        joined.setdefault(p["key"], []).extend(p["items"])
    assert all(ids == [r[0] for r in expected if r[1] == k] for k, ids in joined.items()) and len(joined) == len(counts)


def test_assign_ids_follow_the_maximum(spark):
    existing = spark.createDataFrame([(7,), (41,)], "id long")
    new = spark.createDataFrame([("b",), ("a",)], "name string")
    assert rows(A.assign_ids(new, existing, [F.col("name")]).select("id", "name")) == [(42, "a"), (43, "b")]


# --- matching against brute force -----------------------------------------------------------------

def _names(n, seed):
    rng = random.Random(seed)
    words = ["garden", "farm", "eco", "green", "valley", "river", "stone", "haven", "community", "land", "sun", "oak"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "s", " co", "!"]) for _ in range(n)]


@pytest.fixture(scope="module")
def names(spark):
    mine, theirs = _names(60, 1), _names(80, 2)
    df = spark.createDataFrame(list(enumerate(mine)), "id long, name string")
    ref = spark.createDataFrame([(n, i, f"u{i}") for i, n in enumerate(theirs)], "name string, pos long, url string")
    return mine, theirs, df, ref


@pytest.mark.parametrize("longer_than", [0, 5])
def test_match_contains_brute(names, longer_than):
    mine, theirs, df, ref = names
    got = {r["id"]: r["match_url"] for r in M.match_contains(df, ref, longer_than=longer_than).collect()}
    for i, n in enumerate(mine):
        hit = next((f"u{p}" for p, k in enumerate(theirs) if len(n) > longer_than and len(k) > longer_than and (n in k or k in n)), None)
        assert got[i] == hit, (n, got[i], hit)


def test_match_tokens_brute(names):
    import re
    mine, theirs, df, ref = names
    got = {r["id"]: r["match_url"] for r in M.match_tokens(df, ref).collect()}
    for i, n in enumerate(mine):
        nw = set(re.sub("[^a-z]", " ", n).split())
        hit = None
        for p, k in enumerate(theirs):
            kw = set(re.sub("[^a-z]", " ", k).split())
            if nw and (len(nw & kw) >= min(2, len(nw)) or any(w in k for w in n.split() if len(w) > 4)):
                hit = f"u{p}"
                break
        assert got[i] == hit, (n, got[i], hit)


@pytest.mark.parametrize("metric", ["ratio", "levenshtein"])
def test_match_fuzzy_brute(names, metric):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, cb in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (ca != cb))
        return 1.0 - row[-1] / max(len(a), len(b), 1)

    score = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if metric == "ratio" else lev
    mine, theirs, df, ref = names
    got = {r["id"]: (r["match_url"], r["match_score"]) for r in M.match_fuzzy(df, ref, metric=metric).collect()}
    for i, n in enumerate(mine):
        best, at = 0, None
        for p, k in enumerate(theirs):
            s = score(n, k)
            if s > best:
                best, at = s, p
        if best > 0.6:
            assert got[i][0] == f"u{at}" and abs(got[i][1] - best) < 1e-12, (n, got[i], at, best)
        else:
            assert got[i] == (None, None)


def test_fuzzy_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, "abcde")], "id long, name string")
    ref = spark.createDataFrame([("abcxy", 0, "u")], "name string, pos long, url string")
    assert M.match_fuzzy(df, ref).first()["match_url"] is None


def test_fuzzy_blocks_agree(names, monkeypatch):
    mine, theirs, df, ref = names
    whole = {r["id"]: r["match_url"] for r in M.match_fuzzy(df, ref, metric="ratio").collect()}
    monkeypatch.setattr(M, "meet_in_blocks", partial(meet_in_blocks, rows=7))
    assert {r["id"]: r["match_url"] for r in M.match_fuzzy(df, ref, metric="ratio").collect()} == whole


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, cb in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (ca != cb))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.85, 0.3])
def test_similar_pairs_lose_none(spark, threshold):
    rng = random.Random(int(threshold * 100))
    some = [["".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(90)] for _ in range(2)]
    names, refs = ({*x, "", "a", "farm at the river bend", "the farm by the river bends"} for x in some)
    got = M.similar_pairs(spark.createDataFrame([(n,) for n in names], "_name string"),
                          spark.createDataFrame([(n,) for n in refs], "_ref string"), threshold)
    want = {(a, b, e) for a in names for b in refs if 1.0 - (e := _edits(a, b)) / max(len(a), len(b), 1) > threshold}
    assert sorted(tuple(r) for r in got.select("_name", "_ref", "edits").collect()) == sorted(want)


@pytest.mark.parametrize("filtered", [1 << 20, 0])
def test_names_meet_by_what_is_left_of_them(spark, monkeypatch, filtered):
    """Names that share a word are not compared for it, and none is lost, with a filter and without."""
    rng = random.Random(11)
    codes = ["".join(rng.choice("kelomatrin") for _ in range(rng.choice([2, 5, 6, 7, 8]))) for _ in range(150)]
    mine = [*(f"{c} almond" for c in codes), "aaaaaaaaaaaa", "é b", ""]
    theirs = [*(f"{c[1:]} almond{len(c) % 3}s" for c in codes), *(f"{c[:3]}x{c[3:]} almond" for c in codes[:40]), "aaaaaaaaaaa", "é bc", ""]
    monkeypatch.setattr(M, "CHEAP", 0)
    monkeypatch.setattr(M, "FILTERED", filtered)
    monkeypatch.setattr(M, "SPARSE", 0)
    cut, compared, meetings = [], [], M._meetings

    def remainders(text, keeps, held=None, real=M.P.remainders):
        cut.append((text, held is not None))
        return real(text, keeps, held)

    def counted(*args, **kind):
        met = meetings(*args, **kind)
        compared.append(met.count())
        return met

    monkeypatch.setattr(M.P, "remainders", remainders)
    monkeypatch.setattr(M, "_meetings", counted)
    df = spark.createDataFrame(list(enumerate(mine)), "id long, name string")
    ref = spark.createDataFrame([(n, i, f"u{i}") for i, n in enumerate(theirs)], "name string, pos long, url string")
    got = {r["id"]: (r["match_url"], r["match_score"]) for r in M.match_fuzzy(df, ref, metric="ratio").collect()}
    for i, n in enumerate(mine):
        score, at = max(((SequenceMatcher(None, n, k).ratio(), -p) for p, k in enumerate(theirs)))
        assert got[i] == ((f"u{-at}", score) if score > 0.6 else (None, None)), n
    assert ("_name", False) in cut and ("_ref", filtered > 0) in cut
    assert compared[0] < 20  # of 29,000 pairs; those of other lengths meet by what is left


def test_names_of_few_edits_meet_without_segments(spark, monkeypatch):
    """Names that share a word meet by what is left of them, not by a segment of that word."""
    rng = random.Random(12)
    codes = sorted({"".join(rng.choice("kelomatrin") for _ in range(8)) for _ in range(120)})
    mine, theirs = [f"{c} almond" for c in codes], [f"{c[1:]} almond{len(c) % 7}\U0001f600" for c in codes]
    met = []
    for name, value in (("CHEAP", 0), ("EASY", 0), ("STEEP", 1)):
        monkeypatch.setattr(M, name, value)
    monkeypatch.setattr(M, "_meetings", lambda *args, real=M._meetings, **kind: met.append(args[2]) or real(*args, **kind))
    df = spark.createDataFrame(list(enumerate(mine)), "id long, name string")
    ref = spark.createDataFrame([(n, i, f"u{i}") for i, n in enumerate(theirs)], "name string, pos long, url string")
    got = {r["id"]: (r["match_url"], r["match_score"]) for r in M.match_fuzzy(df, ref).collect()}
    for i, n in enumerate(mine):
        score, at = max((1.0 - _edits(n, k) / max(len(n), len(k)), -p) for p, k in enumerate(theirs))
        assert got[i] == (f"u{-at}", score), n
    assert not met


@pytest.mark.parametrize("metric", ["ratio", "levenshtein"])
def test_small_steps_lose_none(spark, monkeypatch, metric):
    """Lengths meet at the step where they share fewer letters than before, with letters that one table has not."""
    rng = random.Random(13)
    mine, theirs = ([*{"".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(70)}] for letters in ("abcx", "abcéy"))
    for name, value in (("CHEAP", 0), ("EASY", 0), ("STEEP", 1), ("SPARSE", 0), ("FILTERED", 1)):
        monkeypatch.setattr(M, name, value)
    monkeypatch.setattr(M, "SURE", (0.9, 0.8, 0.7))
    monkeypatch.setattr(M, "LOOSE", 1 << 20)
    df = spark.createDataFrame(list(enumerate(mine)), "id long, name string")
    ref = spark.createDataFrame([(n, i, f"u{i}") for i, n in enumerate(theirs)], "name string, pos long, url string")
    score = {"ratio": lambda a, b: SequenceMatcher(None, a, b).ratio(), "levenshtein": lambda a, b: 1.0 - _edits(a, b) / max(len(a), len(b), 1)}[metric]
    got = {r["id"]: (r["match_url"], r["match_score"]) for r in M.match_fuzzy(df, ref, metric=metric).collect()}
    for i, n in enumerate(mine):
        best, at = max((score(n, k), -p) for p, k in enumerate(theirs))
        assert got[i] == ((f"u{-at}", best) if best > 0.6 else (None, None)), n


def test_letters_of_one_table_are_never_kept(spark):
    """Letters that the names have nowhere are taken out of the references first, not in every way."""
    rng = random.Random(15)
    codes = sorted({"".join(rng.choice("kelomatrin") for _ in range(8)) for _ in range(200)})
    names = spark.createDataFrame([(f"{c} almond",) for c in codes], "_name string")
    refs = spark.createDataFrame([(f"{c[1:]} almond3s",) for c in codes], "_ref string")
    bare = M._without("_ref", M._letters(refs, "_ref") - M._letters(names, "_name"))
    asked, held = M._Lengths(names.withColumn("k", F.col("_name")), "_name", "k"), M._Lengths(refs.withColumn("k", bare), "_ref", "k")
    plan = M._Plan(asked, held, 0.85, M._kept_by_letters, 0, None)
    assert plan.keys == [15 * len(codes), len(codes)] and plan.all_settled()  # of 16 letters 14 are kept, in 120 ways
    assert not M._Plan(asked, held, 0.84, M._kept_by_letters, 0, 0.85).met.any()  # nothing new to meet


def test_remainders_are_subsequences(spark):
    from itertools import combinations

    names = ["abcab", "aaaa", "kelo ring", "é€😀x", None, ""]
    rows_ = [(i, n, [len(n) - k for k in (0, 1, 2) if len(n) > k] if n else None) for i, n in enumerate(names)]
    got = {r["id"]: r["h"] for r in spark.createDataFrame(rows_, "id int, t string, k array<int>").select("id", M.P.remainders("t", "k").alias("h")).collect()}
    for i, n, keeps in rows_:
        want = {"".join(c) for k in keeps or () for c in combinations(n, k)}
        assert len(got[i]) == len(set(got[i])) == len(want)


def test_segments_keep_most_pairs_apart(spark):
    rng = random.Random(8)
    names = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(20)),) for _ in range(400)], "_name string")
    refs = names.withColumnRenamed("_name", "_ref")
    assert M.similar_pairs(names, refs, 0.85).count() == 400
    cut = M._segments(refs, "_ref", 0.6).groupBy("_ref" if False else "long").count()
    assert cut.agg({"count": "max"}).first()[0] == 8  # seven edits at most


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {kind: plan.count(f"{kind} [") for kind in ("SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")}


def test_cut_names_are_not_sent_through_the_driver(names):
    mine, theirs, df, ref = names
    plan = _joins(M.similar_pairs(df.select(F.col("name").alias("_name")), ref.select(F.col("name").alias("_ref")), 0.75))
    # broadcast are only the lengths that names have
    assert plan == {"SortMergeJoin": 2, "BroadcastHashJoin": 2, "BroadcastNestedLoopJoin": 0, "CartesianProduct": 0}
    assert _joins(M.match_fuzzy(df, ref))["BroadcastHashJoin"] == 0


def test_words_are_not_sent_through_the_driver(names):
    mine, theirs, df, ref = names
    plan = _joins(M.match_tokens(df, ref))
    assert plan["SortMergeJoin"] and not plan["BroadcastHashJoin"]


def test_segments_meet_at_possible_places_only(spark):
    """Names that share their last word, but not within the edits, are no candidates."""
    rng = random.Random(4)
    codes = ["".join(rng.choice("kelomatrin") for _ in range(8)) for _ in range(200)]
    names = spark.createDataFrame([(f"{c} almond",) for c in codes], "_name string")
    refs = spark.createDataFrame([(f"{c[1:]} almond3s",) for c in codes], "_ref string")
    cut, known = M._segments(refs, "_ref", 0.75), refs.select(F.char_length("_ref").alias("size")).distinct()
    probe = M._pieces_for(names, "_name", 0.75, 0, known)
    met = probe.join(cut.withColumnRenamed("nth", "_nth"), ["size", "slot", "piece"]).select("short", "long").distinct().count()
    assert 200 <= met < 2000  # of 40,000
    assert M.similar_pairs(names, refs, 0.75).count() >= 200


def test_names_of_many_edits_meet(spark):
    a = "a very long name of a farm by the river that has more than fifty characters"
    b = a.replace("river", "stream").replace("fifty", "some forty").replace("very", "quite")
    got = M.similar_pairs(spark.createDataFrame([(a,)], "_name string"), spark.createDataFrame([(b,)], "_ref string"), 0.6).collect()
    assert [tuple(r) for r in got] == [(a, b, _edits(a, b))]


def test_only_names_without_a_like_partner_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    codes = ["".join(rng.choice("kelomatrin") for _ in range(9)) for _ in range(60)]
    df = spark.createDataFrame([*((i, f"{c} almond") for i, c in enumerate(codes)), (60, "abcde")], "id long, name string")
    ref = spark.createDataFrame([*((f"{c[1:]} almond3s", i, f"u{i}") for i, c in enumerate(codes)), ("abcdxyz", 60, "u60")], "name string, pos long, url string")
    asked = []

    def met(left, *rest, **options):
        asked.extend(r["_name"] for r in left.select("_name").distinct().collect())
        return meet_in_blocks(left, *rest, **options)

    monkeypatch.setattr(M, "meet_in_blocks", met)
    got = {r["id"]: r["match_url"] for r in M.match_fuzzy(df, ref, metric="ratio").collect()}
    assert asked == ["abcde"]
    assert got == {i: f"u{i}" for i in range(61)}


def test_two_common_words_are_not_paired_with_each_other(spark):
    """A name of many words looks up each word but its commonest once, not every pair of them."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "wab zzz"), (3, "the wab"), (4, None), (5, "")], "id long, name string")
    ref = spark.createDataFrame([("zzz", 0, "u0"), ("the waa", 1, "u1"), ("wac the wab", 2, "u2"), (None, 3, "u3")], "name string, pos long, url string")
    assert rows(M.match_tokens(df, ref, long_word=9).select("id", "match_url")) == [(1, "u2"), (2, None), (3, "u2"), (4, None), (5, None)]


def test_passages_brute(spark):
    rng = random.Random(5)
    docs = ["".join(rng.choice("abc d\né") for _ in range(400)) for _ in range(30)]
    passages = [d[i:i + 40] for i, d in enumerate(docs[:10])] + ["zzzzzzzzzzzzzzzzzzz", "ab c", "zq", docs[3][5:14], docs[3][7:16]]
    got = M.passages_in(spark.createDataFrame(list(enumerate(docs)), "d long, dt string"),
                        spark.createDataFrame(list(enumerate(passages)), "p long, pt string"), "d", "dt", "p", "pt")
    assert rows(got) == sorted((i, j) for i, d in enumerate(docs) for j, p in enumerate(passages) if p in d)


def test_contained_texts_of_every_length(spark):
    rng = random.Random(6)
    docs = ["".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(60)] + ["x" * 3000, "日本" * 500]
    short = {d[a: a + n] for d in docs for n in (1, 2, 5, 7, 8, 9, 11, 12, 23, 24, 60, 71, 72, 200) for a in [rng.randint(0, 60)]} | {"", "zz", "日本日" * 40}
    got = M.contained_pairs(spark.createDataFrame([(s,) for s in short] + [(None,)], "s string"),
                            spark.createDataFrame([*enumerate(docs), (999, None)], "d long, dt string").repartition(4), "s", "d", "dt")
    assert rows(got.select("d", "s")) == sorted((i, s) for i, d in enumerate(docs) for s in short if s and s in d)
    none = M.contained_pairs(spark.createDataFrame([("",)], "s string"), spark.createDataFrame([(1, "a")], "d long, dt string"), "s", "d", "dt")
    assert none.collect() == []


# --- search ---------------------------------------------------------------------------------------

def test_cosine_topk_brute_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    corpus = rng.normal(size=(300, 16)).astype(np.float32)
    corpus[50:80] = corpus[50]  # ties
    queries = rng.normal(size=(5, 16))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<float>").repartition(6)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    scores = np.round(queries @ corpus.astype(np.float64).T, 9)
    truth = sorted((qi, rank + 1, int(i)) for qi in range(5)
                   for rank, i in enumerate(sorted(range(300), key=lambda i: (-scores[qi][i], i))[:20]))
    assert rows(S.cosine_topk(q, c, 20).select("query_id", "rank", "id")) == truth
    monkeypatch.setattr(S, "CELL_ROWS", 7)
    assert rows(S.cosine_topk(q, c, 20).select("query_id", "rank", "id")) == truth
    monkeypatch.setattr(S, "CELLS", 1)
    assert rows(S.cosine_topk(q, c, 20).select("query_id", "rank", "id")) == truth
    above = rows(S.cosine_above(q, c, 4.0).select("query_id", "id"))
    assert above == sorted((qi, i) for qi in range(5) for i in range(300) if scores[qi][i] >= 4.0)


def test_far_cells_are_not_visited(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 8)) * 30
    corpus = np.concatenate([m + rng.normal(size=(50, 8)) for m in middles])
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)] + [(5000, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middles)], "query_id long, embedding array<double>")
    got = S.cosine_topk(q, c, 10)
    scores = np.round(middles @ corpus.T, 9)
    assert rows(got.select("query_id", "id")) == sorted(
        (qi, int(i)) for qi in range(20) for i in sorted(range(1000), key=lambda i: (-scores[qi][i], i))[:10])
    cells = S._Cells(q, c, "query_id", "id", "embedding", "embedding", None, None)
    kth = spark.createDataFrame([(qi, float(np.sort(scores[qi])[-10])) for qi in range(20)], "qid long, score double")
    visited = cells.bounds(10).count() + cells.bounds(10, kth).count()
    assert visited < 0.5 * 20 * cells.side.select("cell").distinct().count()
    assert S.cosine_topk(q, c.limit(0), 3).count() == 0 and S.cosine_topk(q.limit(0), c, 3).count() == 0


def test_keyword_search_points(spark):
    org = spark.createDataFrame([(1, "Organic Farm Co", "an organic farm", "US", 0.0, 0.0, False, False, False), (2, "X", "y", "z", 0.0, 0.0, True, True, True)],
                                "id long, name string, description string, country string, latitude double, longitude double,"
                                " has_jobs boolean, has_stays boolean, has_events boolean")
    asked = spark.createDataFrame([(1, "organic farm"), (2, "job"), (3, None), (4, "")], "query_id long, text string")
    got = rows(S.keyword_search(asked.where("query_id < 4"), org).select("query_id", "id", "score", "rank"))
    assert got == [(1, 1, 0.9, 1), (2, 2, 0.1, 1)]
    assert S.keyword_search(asked.limit(0), org).count() == 0 and S.keyword_search(asked, org.limit(0)).count() == 0


@pytest.mark.parametrize("often", [0, 4, 1000])
def test_keyword_search_brute(spark, often):
    rng = random.Random(4)
    words = ["farm", "farms", "eco", "ecofarm", "river", "bend", "job", "stay", "é"]

    def some(n):
        return rng.choice([None, "", *([" ".join(rng.choice(words) for _ in range(rng.randint(1, n)))] * 6)])
    org = [(i, some(3), some(6), some(1), float(i), 0.0, rng.random() < .5, rng.random() < .3, rng.choice([True, False, None])) for i in range(60)]
    asked = [(i, some(4)) for i in range(25)] + [(90, "Farm farm FARM"), (91, "events"), (92, "farm"), (93, "farm")]
    df = spark.createDataFrame(org, "id long, name string, description string, country string, latitude double, longitude double,"
                               " has_jobs boolean, has_stays boolean, has_events boolean").repartition(3)
    for k in (3, 100):
        want = []
        for qid, text in asked:
            text = (text or "").lower()
            found = []
            for i, name, about, country, *_, jobs, stays, events in org:
                name, about, country = ((x or "").lower() for x in (name, about, country))
                p = 10 * bool(text and text in " ".join([name, about, country]))
                p += sum(3 * (w in name) + (w in about) + 2 * (w in country) for w in text.split() if len(w) > 2)
                p += sum(2 for w, flag in (("volunteer", jobs), ("stay", stays), ("event", events), ("job", jobs)) if w in text and flag)
                found += [(-p, i)] if p and text else []
            want += [(qid, i, -p / 20, r + 1) for r, (p, i) in enumerate(sorted(found)[:k])]
        got = S.keyword_search(spark.createDataFrame(asked, "query_id long, text string"), df, k, often)
        assert rows(got.select("query_id", "id", "score", "rank")) == sorted(want)


def test_search_filters_before_retrieval(spark):
    n = 40
    org = spark.createDataFrame([(i, f"Org {i}", "d", "BR" if i % 2 else "FR", "c", 0.0, 0.0, "t", True, True, True, True, True) for i in range(n)],
                                "id long, name string, description string, country string, city string, latitude double, longitude double,"
                                " organization_type string, accepts_volunteers boolean, accepts_shortterm boolean, accepts_longterm boolean,"
                                " accepts_visitors boolean, has_jobs boolean")
    corpus = spark.createDataFrame([(i, [1.0 - i / 100, 0.0]) for i in range(n)], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, "farm in Brazil", [1.0, 0.0])], "query_id long, text string, embedding array<double>")
    got = S.search(q, corpus, org, Z.gazetteer(spark), top_n=2).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2] and {r["country"] for r in got} == {"BR"}
    # with a cut of 1 the best row is French, so filtering after the cut leaves nothing
    assert S.search(q, corpus, org, Z.gazetteer(spark), top_n=2, retrieve_with_place=1, prefilter=False).count() == 0
    pre = S.search(q, corpus, org, Z.gazetteer(spark), top_n=2, retrieve_with_place=2)
    assert rows(pre.select("id")) == [(1,), (3,)]


# --- pages ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("html,text", [
    ('<p>A</p><img class="social-icon"><p>B</p>', "A B"), ('<input id="menu-toggle">A', "A"),
    ('<div class="sidebar"><div>in</div>still in</div>out', "out"), ("<ul><li class=legal>a<li>b</ul>", "b"),
    ("<p class=copyright>a<p>b", "b"), ("<nav><p>x</nav>y</nav>z", "y z"), ("a</div>b<br/>c", "a b c"),
    ("<div role=search><b>q</div>r", "r"), ("&eacute;&#8217;&ndash; &bogus;", "é’– &bogus;"), ("<form>f<p>g</form>h", "h"),
])
def test_hidden_parts_end_with_their_element(html, text):
    assert visible_text(html, "full") == text


def test_references_are_decoded_once(one):
    text = "a &eacute;&#233;&#xE9;&nbsp;&euro;&amp;lt; &bogus; &amp &#0; &#x110000; &#128512;& &apos;"
    assert one(T.html_unescape("s"), s=text) == "a ééé €&lt; &bogus; &amp &#0; &#x110000; \U0001f600& '"
    assert one(T.html_unescape("s"), s="plain") == "plain" and one(T.html_unescape("s"), s="") == ""


def test_visible_text_profiles(spark):
    html = '<div class="sidebar">no</div><header>head</header><p>yes <b>bold</b> &amp; more</p><script>x</script><footer>foot</footer></nav>'
    assert visible_text(html, "full") == "yes bold & more"
    assert visible_text(html, "simple") == "no head yes bold & more foot"
    df = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id int, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text(df, "frame").collect()} == {1: "no yes bold & more", 2: None}


def test_jsonld(spark):
    html = ('<script type="application/ld+json">{"@graph":[{"@type":["Event"],"name":"A","startDate":"2025-05-01","location":{"@type":"VirtualLocation"}},'
            '{"@type":"Person"}]}</script><script type="application/ld+json">{broken</script>')
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    items = web.jsonld_items(df)
    assert items.count() == 2
    got = web.jsonld_events(items).collect()
    assert len(got) == 1 and got[0]["title"] == "A" and got[0]["is_online"] and got[0]["start_date"] == datetime(2025, 5, 1)


def test_event_blocks_tiers(spark):
    ld = '<script type="application/ld+json">{"@type":"Event","name":"Open day","startDate":"2025-05-01"}</script>'
    card = '<div class="event-card"><h3>Spring work week</h3> January 15, 2026 at the farm location <a href="/rsvp">go</a></div>'
    pages = spark.createDataFrame([
        (1, "https://a.org/e", ld + card), (2, "https://a.org/f", "<p>our calendar is here</p><a href='x.ics'>f</a>"),
        (3, "https://a.org/g", "<p>zzz</p>"), (4, "https://a.org/h", card + '<div class="event-card"><h3>Spring work week</h3> again and again, online</div>'),
    ], "page_id int, url string, html string")
    got = rows(event_blocks(pages).select("page_id", "title", "registration_url"))
    assert got == [(1, "Open day", None), (1, "Spring work week", "https://a.org/rsvp"), (2, "Calendar (Ics Feed)", "https://a.org/x.ics"),
                   (4, "Spring work week", "https://a.org/rsvp")] or [g[:2] for g in got] == [
        (1, "Open day"), (1, "Spring work week"), (2, "Calendar (Ics Feed)"), (4, "Spring work week")]


def test_sitemaps_one_level(spark):
    docs = spark.createDataFrame([
        ("i", "<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>s2</loc></sitemap></sitemapindex>"),
        ("s1", "<urlset><url><loc>a</loc></url><url><loc>b</loc></url><url><loc>c</loc></url></urlset>"),
        ("s2", "<urlset><url><loc>d</loc></url><url><loc>e</loc></url></urlset>")], "url string, body string")
    got = rows(web.sitemap_urls(docs).where("url = 'i'").select("pos", "page_url"))
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert rows(web.sitemap_urls(docs, 4).where("url = 'i'").select("pos", "page_url")) == got[:4]


def test_nearby_crosses_the_date_line(spark):
    df = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 0.0, 0.0), (4, 89.9, 10.0)], "id int, latitude double, longitude double")
    assert rows(C.nearby(df, 0.0, 180.0, 50).select("id")) == [(1,), (2,)]


def test_keyword_hits(one):
    assert one(T.keyword_hits("s", ["permaculture", "farm", "yoga"]), s="A permaculture farm") == ["permaculture", "farm"]


# --- event containers -----------------------------------------------------------------------------

def test_event_containers_equal_the_patterns(spark):
    """One pass over the markup finds what patterns over whole containers find."""
    import re

    from meadowlark import constants as K
    from meadowlark.operators import events as EV
    marked = (rf"(?is)<(?:{K.EVENT_MARKED_TAGS})[^>]*?(?:class|id)=[\"'][^\"']*(?:{K.EVENT_MARKS})[^\"']*[\"'][^>]*>(.*?)</(?:{K.EVENT_MARKED_TAGS})>")
    dated = rf"(?is)<(?:{K.EVENT_DATED_TAGS})[^>]*>(.*?{K.EVENT_BLOCK_DATE}.*?)</(?:{K.EVENT_DATED_TAGS})>"
    timed = rf"(?is)<(?:{K.EVENT_DATED_TAGS})[^>]*>(.*?<time[^>]*>.*?</time>.*?)</(?:{K.EVENT_DATED_TAGS})>"
    rng = random.Random(12)
    bits = ["<div>", "</div>", "<li class='event'>", "</LI>", "<tr id=\"row\">", "</tr>", "<section>", "</section>", "<time>", "</time>", " x ", "May 5, 2026",
            "<p>", "June 12 24", "<time datetime=q>", "<article class=\"post\">", "</article>", "é\n"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", "no markup", "</div>", "<div class='item'></div>"]
    html = F.col("html")
    got = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select(
        "i", EV.marked_containers(html).alias("m"), EV.dated_containers(html).alias("d"), EV.timed_containers(html).alias("t")).collect()
    for r in got:
        page = pages[r["i"]]
        assert r["m"] == re.findall(marked, page), page
        assert r["d"] == list(dict.fromkeys(re.findall(dated, page))), page
        assert r["t"] == re.findall(timed, page), page


def test_event_containers_take_one_pass(spark):
    """A page of megabytes without dates, of containers that open and never hold one."""
    import time
    page = "<div><section>" * 40_000 + "<div>text</div>" * 40_000
    df = spark.createDataFrame([(1, "https://a.org", page)], "page_id int, url string, html string")
    start = time.time()
    assert event_blocks(df).collect() is not None
    assert time.time() - start < 60


def test_upsert_keeps_one_row_per_key(spark):
    base = spark.createDataFrame([(1, "old", 0), (2, "stays", 0)], "id int, name string, at int")
    delta = spark.createDataFrame([(1, "x", 1), (1, "y", 3), (1, "z", 2), (3, None, 1), (3, None, 1), (None, "q", 1)], "id int, name string, at int")
    got = sorted((tuple(r) for r in H.upsert(base, delta, order=[F.col("at")]).collect()), key=repr)
    assert got == sorted([(1, "y", 3), (2, "stays", 0), (3, None, 1), (None, "q", 1)], key=repr)
    assert H.upsert(base, delta.limit(0)).count() == 2


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    import os
    path = str(tmp_path / "table")
    H.write_buckets(spark.range(1000).select("id", F.lit("old").alias("name")), path, buckets=16)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    delta = spark.createDataFrame([(5, "a"), (5, "b"), (2000, "new")], "id long, name string")
    H.upsert_buckets(spark, path, delta)
    got = {r["id"]: r["name"] for r in H.read_buckets(spark, path).collect()}
    assert len(got) == 1001 and got[5] == "b" and got[2000] == "new" and got[6] == "old"
    kept = before & files()
    assert len({os.path.dirname(f) for f in kept}) >= 14
    H.upsert_buckets(spark, path, delta)  # again: the same table
    assert H.read_buckets(spark, path).count() == 1001


def test_nothing_is_cut_unless_asked(one):
    words = " ".join(f"Sentence number {i} tells of gardens and volunteers here." for i in range(40))
    assert one(T.prefix("s", None), s=words) == words and one(T.prefix("s", 5), s=words) == words[:5]
    assert one(X.lead_sentences("s"), s=words).count("Sentence") == 40 and one(X.lead_sentences("s", keep=3), s=words).count("Sentence") == 3
    assert one(X.best_sentences("s", keep=4), s=words).count("Sentence") == 4 and one(X.best_sentences("s"), s=words).count("Sentence") == 40
    assert one(X.stay_listing("s"), s=words)["description"] == words
    assert one(X.price_info("s"), s=" ".join(f"$ {i}" for i in range(20, 31))).count(",") == 10
    assert one(X.event_dates("s"), s="May 5, 2025 and June 6, 2025 and July 7, 2025") == ["May 5, 2025", "June 6, 2025", "July 7, 2025"]
    long_meta = "A quiet farm community. " * 40
    whole = one(X.job_description("s", F.lit("t"), F.lit("o"), F.lit(long_meta)), s="x")
    assert whole == long_meta and len(one(X.job_description("s", F.lit("t"), F.lit("o"), F.lit(long_meta), limit=500), s="x")) <= 500


@pytest.mark.parametrize("radius", [30.0, 900.0, 9000.0])
def test_nearby_points_brute(spark, radius):
    import math
    rng = random.Random(int(radius))

    def place():
        return rng.choice([(rng.uniform(-90, 90), rng.uniform(-180, 180)), (rng.uniform(88, 90), rng.uniform(-180, 180)), (rng.uniform(-0.3, 0.3), rng.choice([179.9, -179.9, 180.0, -180.0])),
                           (10 + rng.uniform(-.2, .2), 20 + rng.uniform(-.2, .2)), (90.0, 0.0), (-90.0, 50.0)])
    spots, points = [place() for _ in range(250)], [place() for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(999, None, 1.0)], "id int, latitude double, longitude double").repartition(3)
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(999, 1.0, None)], "point_id int, latitude double, longitude double")

    def km(a, b):
        (p, q), (r, t) = ((math.radians(x) for x in y) for y in (a, b))
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((t - q) / 2) ** 2)))
    got = C.nearby_points(df, asked, radius).collect()
    assert sorted((r["point_id"], r["id"]) for r in got) == sorted((j, i) for j, q in enumerate(points) for i, p in enumerate(spots) if km(p, q) <= radius)
    for j, q in list(enumerate(points))[:12]:
        near = C.nearby(df, *q, radius, 1000).collect()
        assert sorted(r["id"] for r in near) == [i for i, p in enumerate(spots) if km(p, q) <= radius]


def test_nearby_points_beyond_poles_and_in_pieces(spark, monkeypatch):
    """Latitudes beyond a pole are the places that the SQL's sines and cosines give; crowded cells meet in pieces."""
    import math
    monkeypatch.setattr(C, "PIECE", 16)
    rng = random.Random(14)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(10 + rng.uniform(-2, 2), 20 + rng.uniform(-2, 2)) for _ in range(60)] + [(10.0, 20.0)] * 5
    points = [(i * 23.7 - 700, i * 47.4) for i in range(70)] + [(10.0, 20.0), (370.0, 380.0), (170.0, 200.0), (90.0, 0.0)] * 8
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id int, latitude double, longitude double").repartition(3)
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id int, latitude double, longitude double")

    def km(a, b):
        (p, q), (r, t) = ((math.radians(x) for x in y) for y in (a, b))
        return 2 * 6371.0088 * math.asin(math.sqrt(max(0.0, min(1.0, math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((t - q) / 2) ** 2))))
    for radius in (2500.0, 21000.0):
        got = {(r["point_id"], r["id"]): r["distance_km"] for r in C.nearby_points(df, asked, radius).collect()}
        want = {(j, i): d for j, q in enumerate(points) for i, p in enumerate(spots) if (d := km(p, q)) <= radius}
        # at the place itself and opposite of it the formula has few digits
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < (1e-6 if 1 < want[x] < 19000 else 1e-3) for x in want)
        assert C.nearby_points(df, asked, radius).count() == len(want)
    mine, theirs, tasks = C._in_pieces(*(x.withColumn("k", F.lit(1)).withColumnsRenamed({"latitude": "_s", "longitude": "_u"}) for x in (df, asked)), ["k"], "id", "point_id")
    assert tasks > 20 and mine.groupBy("_mine", "_theirs").count().agg({"count": "max"}).first()[0] < 60  # of 215


def test_rounded_is_round(spark):
    values = [0.0, 1.00005, 2.00015, 0.99995, 1234.56785, 1234.56784999, 19999.99995, 2500.0, 1e12 + 0.33335, float("nan"), -1.00005, None] + [random.Random(i).uniform(0, 2e4) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [repr(r[0]) == repr(r[1]) for r in df.select(C.rounded("v", 4), F.round("v", 4)).collect()] == [True] * len(values)


def test_list_pages_of_small_and_large_keys(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, "a", "a", "a", "b", "c"]), rng.randint(0, 10**6), i) for i in range(400)] + [("lone", 1, 1)]
    df = spark.createDataFrame(data, "k string, o int, i int").repartition(5)
    for size, large in ((7, 100), (100, 100_000), (1000, 0)):
        for order in ([F.col("o"), F.col("i")], [F.col("o").desc(), F.col("i")]):
            got = {(r["k"], r["page"]): (r["n_items"], r["items"]) for r in list_pages(df, ["k"], order, F.col("i"), size, large).collect()}
            for k in {x[0] for x in data}:
                own = [x[2] for x in sorted((x for x in data if x[0] == k), key=lambda x: (x[1] if order[0]._jc.toString().find("DESC") < 0 else -x[1], x[2]))]
                pages = [own[a: a + size] for a in range(0, len(own), size)]
                assert [got[k, p] for p in range(len(pages))] == [(len(own), p) for p in pages]
