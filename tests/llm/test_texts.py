"""Quality rules, the classifier, near duplicates and mixing against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from meadowlark.llm import jaccard_join, mixing, quality_classifier, quality_rules, words
from meadowlark.llm.components import components
from meadowlark.llm.queries import ORACLE, QUERIES, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n\n", None, "one", "é ü", "a\n\na\nb\n a", "x\r\nx\r\nx", "#tag $5 100% a|b <i>", "a b c d e a b c d e f",
       "w " * 40_000, "\x0bq\x0cq\x1cq", "long" * 30_000, "ends ", " starts", "a\nb c d e f g h i j"]


def texts(n=300, seed=5):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "é", "x%", "#", "to", "farm", "\n", "\n", "  ", "\t"]
    return ODD + [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def facts(text):
    text = text or ""
    found = WORD.findall(text)
    grams = Counter(tuple(found[i: i + 5]) for i in range(len(found) - 4))
    covered = {k for i in range(len(found) - 4) if grams[tuple(found[i: i + 5])] > 1 for k in range(i, i + 5)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_base_facts_equal_plain_python(spark):
    rows = [(i, t, "mine") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, LLR string").repartition(4)
    for r in quality_rules.judge(df, np.zeros(16)).collect():
        exp = facts(rows[r["doc_id"]][1])
        assert tuple(r[c] for c in list(quality_rules.RESULTS)[:5]) == exp
        assert r["base_failed"] == (exp[0] < 10 or 100 * exp[4] > 20 * exp[0])


def test_ratio_is_the_mean_over_hashed_ngrams(spark):
    rows = [(1, "good words go here " * 5), (2, "bad%% words&& go##"), (3, None), (3, "good words"), (None, "good words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    got = quality_rules.quality_rules(df, ids, buckets=64).collect()

    def grams(t):
        h, at = words.word_hashes(*words.utf8(pa.array([t or ""])))
        pairs, _ = words.windows(h, at, 2)
        return [int(x) >> 58 for x in [*h, *pairs]]

    raw, target = Counter(g for _, t in rows for g in grams(t)), Counter(grams(rows[0][1]))
    share = sum(target.values()) / sum(raw.values())
    for r, (_, t) in zip(got, rows):
        g = grams(t)
        exp = sum(math.log((target[x] + 10) / (raw[x] * share + 10)) for x in g) / max(1, len(g))
        assert r["llr"] == pytest.approx(exp, abs=1e-12)
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_rules.THRESHOLD)


def test_quality_rules_of_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.quality_rules(nothing, spark.createDataFrame([], "i long")).count() == 0
    one = spark.createDataFrame([(1, "w " * 20)], "doc_id long, text string")
    assert quality_rules.quality_rules(one, spark.createDataFrame([], "i long")).first()["llr"] == 0


def test_quality_queries_part_good_from_bad(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op1_quality_rules"](spark, sf).collect() if not r["base_failed"]}
    assert len(kept) > 800
    assert np.mean([kept[i] == (labels[i] == 1) for i in labels if i in kept]) > 0.98
    rows = QUERIES["op6_quality_classifier"](spark, sf).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len(rows) == 1000 and np.mean([a == b for a, b in held]) > 0.97


def test_classifier_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(100))] + [(None, "no id", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    none = spark.createDataFrame([], "doc_id long, y double")
    blank = quality_classifier.score(df, quality_classifier.fit(df, none))
    assert {r["score"] for r in blank.collect()} == {0.5} and blank.count() == len(rows)
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(40)] + [(None, 1.0), (3, None), (4, 1.0)], "doc_id long, y double")
    model = quality_classifier.fit(df, labels)
    other = quality_classifier.fit(df.repartition(7), labels)
    assert (model.weights == other.weights).all()  # whatever the partitions
    assert quality_classifier.score(df.limit(0), model).count() == 0
    only_good = quality_classifier.fit(df, labels.where("y = 1"))
    assert quality_classifier.score(df, only_good).where("predicted = 1").count() == len(rows)


def test_isotonic_is_monotone_and_pools():
    x, y = quality_classifier.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all() and len(x) < 5


def exact_classes(rows, threshold=0.8):
    """(class id, links) of every row, by comparing all pairs of texts."""
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while up[a] != a:
            a = up[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                up[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    return [(doc, min((x for x in ids[find(i)] if x is not None), default=None), links[i]) for i, (doc, _) in enumerate(rows)]


def near_texts(seed=2):
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows, shared = [], fresh(60)
    for _ in range(25):  # groups of near copies, at all distances
        base = fresh(rnd.choice([6, 40, 120, 400]))
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 9])):
                copy[rnd.randrange(len(copy))] = fresh(1)[0]
            rows.append(" ".join(copy))
    big = fresh(200)
    for _ in range(330):  # one group beyond a block
        copy = list(big)
        copy[rnd.randrange(200)] = fresh(1)[0]
        rows.append("\n".join(copy))
    rows += [" ".join(shared + fresh(n)) for n in range(0, 60, 3)]  # a passage that many share
    rows += ["", None, " ", "a b", "a b", "a  b", "a b c", "same text of six words here"] + ["same text of six words here"] * 40
    return [(i, t) for i, t in enumerate(rows)]


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_texts()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sid string, n int").repartition(5)
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(df).drop("key").collect())
    assert got == sorted(exact_classes(rows))
    kept = [r["doc_id"] for r in jaccard_join.one_per_class(df).collect()]
    assert sorted(kept) == sorted({c for _, c, _ in got})


def test_near_duplicates_with_odd_ids(spark):
    rows = [(1, "p q r s t u"), (1, "p q r s t u"), (1, "other words of this text here"), (None, "p q r s t u"), (None, "alone with no id at all"),
            (None, "alone with no id at all"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, jaccard_join.near_duplicates(df).drop("key").collect())) == sorted(
        f"Row(doc_id={a}, class_id={b}, n_links={c})" for a, b, c in exact_classes(rows))
    kept = sorted(map(str, (tuple(r) for r in jaccard_join.one_per_class(df).collect())))
    assert kept == sorted(map(str, [rows[0], rows[2], rows[6], rows[4]]))
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0
    assert jaccard_join.one_per_class(df.limit(0)).count() == 0


def test_pruning_needs_what_the_posterior_says():
    for n, m in jaccard_join.least_matches():
        below = sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m))
        assert below < jaccard_join.TOLERANCE <= below + math.comb(n + 1, m) * 0.8**m * 0.2 ** (n + 1 - m)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1400)] + [(5000, i) for i in range(5001, 5300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    up = {x: x for e in edges for x in e}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mix_equals_sql(spark, tmp_path):
    import pandas as pd

    rnd = random.Random(4)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([1, 5, 80, 900]))), rnd.choice(["a", "a", "a", "b", "c", "Z", "é"]))
            for i in range(400)] + [(401, None, None), (402, "x y", None), (403, "", "void"), (404, None, "void"), (None, "n", "a")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    exp = con.execute(ORACLE["op3_source_mix"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, exp))
    sources = {r["source"]: (r["source_size"], r["target"]) for r in mixing.mix(df).collect()}
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * sum(s for s, _ in sources.values()))
    assert all(t <= 2 * s for s, t in sources.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_rows_follow_their_copies(spark):
    rows = [(i % 50, f"w {'x ' * (i % 7)}", "ab"[i % 2], i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(3)
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = mixing.mixed(df)
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in out.collect())
    assert got == +copies and out.columns == df.columns


def test_source_targets_reshare_what_is_above_the_limit(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    left = 1.5 * 2010 - 20
    assert got["a"] == 20
    assert got["b"] == pytest.approx(left * 2 / 3) and got["c"] == pytest.approx(left / 3)


def test_kept_and_pruned_nodes_of_a_bucket_meet(spark):
    """A pivot p, a node that survives against it and one that does not, which are near each other:
    all nodes that share a bucket are compared or end in one component."""
    rnd = np.random.default_rng(5)
    sets, names = [], []
    for t in range(120):
        p = rnd.integers(0, 2**63, 100).astype(np.uint64)
        for name, (gone, new) in (("p", (0, 0)), ("a", (11, 11)), ("b", (26, 26))):
            base = sets[-1] if name == "b" else p
            own = np.concatenate([base[gone if name != "b" else 15:], rnd.integers(0, 2**63, new if name != "b" else 15).astype(np.uint64)])
            sets.append(np.sort(own))
            names.append((t, name))
    sigs = jaccard_join.signatures(sets)
    order = rnd.permutation(len(sets))
    nodes = spark.createDataFrame([(int(order[i]), sigs[i].tobytes()) for i in range(len(sets))], "node long, sig binary")
    got = {r["node"]: r["root"] for r in components(jaccard_join.candidate_edges(nodes)).collect()}
    width = jaccard_join.ROWS
    for t in range(120):
        three = [3 * t + k for k in range(3)]
        for i in three:
            for j in three:
                share = (sigs[i].reshape(-1, width) == sigs[j].reshape(-1, width)).all(1).any()
                if i < j and share and jaccard_join.survivors(sigs[i:i + 1], sigs[j:j + 1])[0]:
                    assert got[int(order[i])] == got[int(order[j])]


def test_words_that_defeat_polynomial_hashes_are_not_copies(spark):
    letters = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    pair = [f"xxxxxxxx{t}xxxxxxxx q" for t in (letters, letters.translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert sorted(r["class_id"] for r in jaccard_join.near_duplicates(df).collect()) == [0, 1]


def plain_statistics(text):
    """The statistics of a text, one after the other, by plain Python."""
    text = text or ""
    raw, found = text.encode(), [w.encode() for w in WORD.findall(text)]
    n, some = len(found), max(len(found), 1)
    classes = [range(65, 91), range(48, 58), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#*$%&<>", b"!", b"|", range(128, 256)]
    length = [len(w) for w in found]
    mean = sum(length) / some
    spread = math.sqrt(sum((x - mean) ** 2 for x in length) / some)
    grams = Counter(tuple(found[i: i + 5]) for i in range(n - 4))
    counts = Counter(found)
    share = lambda flags: sum(flags) / some
    return [math.sqrt(sum(b in c for b in raw) / max(len(raw), 1)) for c in classes] + [
        math.log1p(n), math.log1p(mean), math.log1p(spread), math.sqrt(raw.count(b"\n") / some),
        share([a == b for a, b in zip(found, found[1:])]), share([counts[w] > 1 for w in found]), share([grams[tuple(found[i: i + 5])] > 1 for i in range(n - 4)]),
        share([w[0] in classes[0] for w in found]), share([w[-1] in classes[2] for w in found]), share([w[0] in classes[2] for w in found]),
        share([x <= 3 for x in length]), share([x > 16 for x in length])]


def test_classifier_equals_a_plain_fit(spark):
    """Random Fourier ridge, cross-fitted and calibrated by the min-max formula of isotonic regression, in plain numpy."""
    Q = quality_classifier
    docs = [(i, t) for i, t in enumerate(texts(260, seed=9))]
    rnd = random.Random(1)
    labels = [(i, float((len(t or "") % 7 < 3) ^ (rnd.random() < .2))) for i, t in docs if i % 5]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    given = spark.createDataFrame(labels, "doc_id long, y double")
    model = Q.fit(df, given)
    x = np.array([plain_statistics(t) for _, t in docs])
    assert Q.statistics(pa.array([t for _, t in docs])) == pytest.approx(x, abs=1e-9)
    x = x.astype(np.float32).astype(float)
    folds = {r["doc_id"]: r["f"] for r in given.selectExpr("doc_id", "cast(xxhash64(doc_id) % 2 != 0 as int) as f").collect()}
    key, y = np.array([i for i, _ in labels]), np.array([v for _, v in labels])
    fold = np.array([folds[i] for i in key])
    own = x[key]
    centre, width = own.mean(0), np.maximum(own.std(0), 1e-3)
    rng = np.random.default_rng(Q.SEED)
    directions, phases = rng.standard_normal((x.shape[1], Q.FEATURES)) * np.sqrt(2 * Q.GAMMA), rng.uniform(0, 2 * np.pi, Q.FEATURES)
    z = np.cos(np.clip((x - centre) / width, -8, 8) @ directions + phases)
    z = np.concatenate([z, np.ones((len(z), 1))], 1)

    def ridge(rows):
        a = np.concatenate([z[key[rows]], np.eye(z.shape[1])])  # least squares with one row for each weight
        return np.linalg.lstsq(a, np.concatenate([y[rows], np.zeros(z.shape[1])]), rcond=None)[0]
    every = ridge(np.arange(len(key)))
    assert model.weights == pytest.approx(every, abs=0.02)  # cosines are rounded
    raw = np.empty(len(key))
    for f in (0, 1):
        raw[fold == f] = z[key[fold == f]] @ ridge(np.flatnonzero(fold != f))
    bins = np.clip((raw + 1) * Q.BINS / 3, 0, Q.BINS - 1).astype(int)
    at = np.unique(bins)
    n, good = np.array([(bins == b).sum() for b in at]), np.array([y[bins == b].sum() for b in at])
    best = [max(min(good[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    pools = [[i for i in range(len(at)) if abs(best[i] - v) < 1e-12] for v in sorted(set(np.round(best, 12)))]
    centres = [((at[p] + 0.5) * 3 / Q.BINS - 1) @ n[p] / n[p].sum() for p in pools]
    shares = np.maximum.accumulate([(good[p].sum() + 0.5) / (n[p].sum() + 1) for p in pools])
    want = np.interp(z @ every, centres, shares)
    got = {r["doc_id"]: r["score"] for r in Q.score(df, model).collect()}
    assert np.mean(np.abs(np.array([got[i] for i, _ in docs]) - want) < 0.05) > 0.9  # a rounded cosine may move a row to the next bin
    assert np.corrcoef([got[i] for i, _ in docs], want)[0, 1] > 0.97
