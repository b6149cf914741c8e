"""Spelling variants, decontamination and divergence against plain Python and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from meadowlark.llm import bloom, decontamination, divergence, spelling
from meadowlark.llm.queries import ORACLE, QUERIES, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, " ", "\n", "É ÀB 漢字x é1", "İK ß", "a" * 5000, "x1y" * 2000, "ÿ×÷", "̀abcdefg", "tab\tbed"]


def same_as_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows and sorted(rows, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_decontamination", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    same_as_sql(spark, name)


# spelling


def plain_words(rows, least_length, least_count, noise):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= least_length
    return {w: c for w, c in n.items() if c >= max(least_count, 1)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n, ratio):
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v.encode()), default=None)
        out[w] = (len(near), best if best and n[best] >= ratio * n[w] else None)
    return out


def test_tokens_are_changed_and_counted(spark):
    rnd = random.Random(3)
    stems = ["garden", "Gärten", "ÉCOLEÀ", "sevenoaks", "x", "aaaaaa", "×÷×÷×÷", "wörterbüch"]
    rows = [(rnd.choice([i, None, 7]), " ".join(rnd.choice(stems) for _ in range(rnd.randint(0, 30)))) for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "l" * 70_000 + " " + "garden " * 50_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, WORD int").repartition(5)
    for least, noise in ((6, 199), (1, 3), (6, 2)):
        got = {r["word"]: r["n"] for r in spelling.word_counts(df, least_length=least, least_count=2, noise=noise).collect()}
        assert got == plain_words(rows, least, 2, noise)


def test_pairs_forms_and_roots_equal_brute_force(spark):
    rnd = random.Random(11)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))) for _ in range(700)} | {"aaaaaaa", "aaaaaaaa", "a", "ab", "b"}
    n = {w: rnd.choice([5, 5, 25, 130, 700, 3500]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    want = plain_variants(n, 5)
    got = {r["word"]: r for r in spelling.variants(df).collect()}
    assert set(got) == words
    for w, (n_near, form) in want.items():
        root = w
        while want[root][1]:
            root = want[root][1]
        r = got[w]
        assert (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) == (n[w], n_near, form, n.get(form), root)
    assert any(r["form"] and got[r["form"]]["form"] for r in got.values())


def test_one_frequent_half_gives_no_square_of_pairs(spark):
    rnd = random.Random(2)
    tails = {"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3000)}
    words = spark.createDataFrame([("common" + t, 5) for t in tails], "word string, n long")
    plan = spelling.near_pairs(words)
    want = sum(one_edit(a, b) for ts in _buckets(tails) for i, a in enumerate(ts) for b in ts[:i])
    assert plan.count() >= want
    m = spelling.F.char_length("word")
    keys = words.select(spelling.F.explode(spelling._keys(spelling.F.col("word"), m, 0)).alias("k")).groupBy("k.kept").count()
    assert keys.agg({"count": "max"}).first()[0] < 100


def _buckets(tails):
    out = defaultdict(list)
    for t in sorted(tails):
        out[t[:3]].append(t)
    return out.values()


def test_no_words_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).collect() == []
    only = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(only)).collect() == []


def test_crc_equals_the_library():
    texts = [f"{'ab' * n}é{n}" for n in range(60)]
    raw = "".join(texts).encode()
    data = np.frombuffer(raw, np.uint8)
    end = np.cumsum([len(t.encode()) for t in texts])
    begin = np.concatenate([[0], end[:-1]])
    state = np.array([zlib.crc32(b"%d:" % i) for i in range(60)], np.uint32)
    assert spelling.crc_of(data, begin, end, state).tolist() == [zlib.crc32(f"{i}:{t}".encode()) for i, t in enumerate(texts)]


# decontamination


def plain_leaks(docs, items, window=10):
    wanted = defaultdict(set)
    for key, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wanted[tuple(w[i: i + size])].add(key)
    out = []
    for key, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in wanted}:
            for i in range(len(w) - size + 1):
                here = tuple(w[i: i + size])
                if here in wanted:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in wanted[here] if x is not None}
        out.append((key, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return out


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, n_words string").repartition(4)
    i = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, row int").repartition(2)
    got = decontamination.decontaminate(d, i, **kw).collect()
    for r in got:
        assert sum(s["stop"] - s["begin"] for s in r["spans"]) == r["n_hit"] and r["n_items"] == len(r["items"])
        assert all(a["stop"] < b["begin"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got), key=repr)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = ["a", "B", "c", "ñu", "5", "the"]

    def some(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, some(rnd.choice([0, 1, 2, 3, 4, 7, 9, 10, 11, 12, 30]) if i > 8 else 12)) for i in range(40)]
    items = [x for x in items if len(x[1].split()) not in (1, 2, 3)] + [(41, None), (None, some(14)), (2, items[2][1]), (42, "zebra"), (43, "Zebra crossing")]
    docs = [(i, some(rnd.randint(0, 40))) for i in range(150)] + [(i, t) for i, t in enumerate(ODD)]
    docs += [(7, "x, " + (rnd.choice(items)[1] or "q").upper().replace(" ", "--") + " y") if rnd.random() < .9 else (None, "zebra") for _ in range(60)]
    docs += [(900, some(4000) + " zebra " + some(3000)), (901, "a " * 30_000), (900, items[3][1])]
    for kw in ({}, {"window": 4, "shingle": 2}):
        want = sorted(plain_leaks(docs, [x for x in items if x[1] is None or len(x[1].split()) != 4 or not kw],
                                  **{k: v for k, v in kw.items() if k == "window"}), key=repr)
        assert leaks(spark, docs, [x for x in items if x[1] is None or len(x[1].split()) != 4 or not kw], **kw) == want


def test_nothing_to_find(spark):
    docs = [(1, "one two three"), (None, None)]
    clean = sorted([(1, 3, 0, (), False), (None, 0, 0, (), False)], key=repr)
    assert leaks(spark, docs, []) == clean
    assert leaks(spark, docs, [(5, None), (6, "-- !!")]) == clean
    assert leaks(spark, docs, [(5, "one two three four five six seven eight nine ten eleven")]) == clean
    assert leaks(spark, [], [(5, "one two three")]) == []


def test_words_of_equal_hash_are_compared(spark, monkeypatch):
    docs, items = [(1, "q w e r t y u i o p a s"), (2, "b " * 20)], [(1, "z x c v b n m k j h g f"), (2, "w e r t y u i o p a")]
    parts = bloom.n_bits(1)
    assert parts == bloom.LEAST_BITS
    cells = np.full(parts // 64, ~np.uint64(0))
    assert len(bloom.maybe(cells, np.arange(50, dtype=np.uint64))) == 50
    assert leaks(spark, docs, items) == sorted(plain_leaks(docs, items), key=repr)
    found = spark.createDataFrame([(1, [(5, 0, 0, "q w e r t")]), (2, [(5, 3, 1, "a z x c v b")])],
                                  "row long, candidates array<struct<hash: long, start: long, before: int, words: string>>")
    prefix = spark.createDataFrame([(5, 0, 5, "z x c v b"), (5, 2, 5, "z x c v b")], "hash long, offset int, size int, window string")
    assert [tuple(r) for r in decontamination.matches(found, prefix).collect()] == [(2, 4, 5, "z x c v b")]


def test_filter_never_loses(spark):
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    frame = spark.createDataFrame(pa.table({"h": h.view(np.int64)}).to_pandas()).repartition(6)
    cells = bloom.build(frame, len(h))
    assert len(bloom.maybe(cells, h)) == len(h)
    assert len(bloom.maybe(cells, rnd.integers(0, 1 << 63, 20000).astype(np.uint64))) < 400


# divergence


def plain_audit(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(found)
        in_docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        of_lang = Counter()
        for s in sources:
            of_lang.update(counts[lang, s])

        def p(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        prob = {s: {t: p(counts[lang, s], t) for t in kept} for s in sources}
        q = {t: p(of_lang, t) for t in kept}
        for s in sources:
            pairs = [(sum(f(prob[s][t], prob[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(prob[s][t], q[t]), t) for t in kept if counts[lang, s][t] and prob[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for i, (v, x) in enumerate(sorted(found, key=lambda y: (-y[0], y[1].encode()))[:most]):
                    out.append((lang, s, part, x, v, i + 1))
    return sorted(out)


def test_audit_equals_plain_python(spark):
    rnd = random.Random(4)
    vocabulary = ["Alpha", "beta", "gamma1delta", "É", "漢字", "x", "_y-", "zeta\x00eta", "İi"]
    rows = [(rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "a", "a", "b", "é", None]),
             " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12)))) for _ in range(300)]
    rows += [("en", "empty", None), ("en", "empty", ""), ("lone", "a", "x y"), ("two", "a", "x"), ("two", "b", None), ("de", "q", "wort " * 9)]
    rows += [("en", "a", t) for t in ODD]
    df = spark.createDataFrame([(s, t, la, 1) for la, s, t in rows], "source string, text string, lang string, N int").repartition(5)
    for least, top in ((10, 10), (2, 3)):
        got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"])
                     for r in divergence.audit(df, least, top).collect())
        assert got == plain_audit(rows, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_small_holdings_are_merged(monkeypatch):
    rows = [("en", "a", "x y x"), ("en", "b", "x"), ("en", "a", "y")] * 5
    parts = [divergence.slice_counts(*[pa.array([r[i]]) for i in range(3)]) for r in rows]
    whole = divergence.slice_counts(*[pa.array([r[i] for r in rows]) for i in range(3)])
    key = [("lang", "ascending"), ("source", "ascending"), ("term", "ascending")]
    assert divergence.merge(parts).sort_by(key).to_pylist() == divergence.merge([whole]).sort_by(key).to_pylist()


def test_long_division_is_exact():
    rnd = random.Random(8)
    pairs = [(rnd.randint(0, t), t) for t in (rnd.randint(1, 9 * 10**15) for _ in range(2000))] + [(5, 5), (0, 1)]
    got = divergence.probability(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs]))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in pairs]


def test_digest_of_no_items(spark):
    row = next(r for r in QUERIES["op12_decontamination"](spark, SF).collect() if not r["n_items"])
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert table(spark, SF, "documents").count() == QUERIES["op12_decontamination"](spark, SF).count()
