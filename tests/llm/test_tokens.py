"""Byte BPE, token shards and token counts against the tokenizer libraries."""

import base64
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from meadowlark.llm import byte_bpe, spans, token_counts, token_files
from meadowlark.llm.batches import scratch
from meadowlark.llm.spans import SpanCache

RANKS = P.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "b", "th", "er", " ", "  ", "   ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "'s", "'ll", "'", "1", "23", "é",
            "日本", "😀", "\u0301", "!", "...", "the", "\r", "\u180e", "x" * 300, "<|endoftext|>", "\0", "²", "ᾳ", "𐐀"]
TEXTS = ["", " ", "  \n ", "plain words, with 'quotes' it's", "a" * 20_000, "ab" * 2000 + " " + "x y " * 30_000, "\0 \0", "tail ", "\n\n x"]


def texts(n=1500, seed=3):
    rnd = random.Random(seed)
    return TEXTS + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return tokenizer


def split(ids, at):
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_bpe_equals_library_and_round_trips(reference):
    bpe = byte_bpe.bpe_of(open(RANKS, "rb").read(), P.PATTERN)
    for text, ids in zip(texts(), split(*bpe.encode(pa.array(texts())))):
        assert ids == reference.encode_ordinary(text)
        assert bpe.decode(np.array(ids, np.int32))[0].tobytes() == text.encode()


def test_shards_tokenizer_equals_library(library):
    encoder = token_files._encoder(open(P.path("byte_bpe_50k.json"), "rb").read())
    for text, ids in zip(texts(), split(*encoder.texts(pa.array(texts())))):
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_bpe_forgets_spans_without_changing_ids(reference):
    bpe = byte_bpe.Bpe(open(RANKS, "rb").read(), P.PATTERN)
    bpe.cache = SpanCache(bpe._whole, 5)
    for text in texts(200):
        assert split(*bpe.encode(pa.array([text, None, text]))) == [reference.encode_ordinary(text), [], reference.encode_ordinary(text)]


def test_equal_hashes_do_not_mix_spans(monkeypatch, reference):
    bpe = byte_bpe.Bpe(open(RANKS, "rb").read(), P.PATTERN)
    monkeypatch.setattr(spans.W, "span_hashes", lambda data, begin, end: np.full(len(begin), 7, np.uint64))
    text = "some words, and others that collide with them"
    assert split(*bpe.encode(pa.array([text]))) == [reference.encode_ordinary(text)]


def thue_morse():
    """Two texts that polynomial hashes modulo 2**64 cannot tell apart."""
    letters = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    return [f"xxxxxxxx{t}xxxxxxxx" for t in (letters, letters.translate(str.maketrans("ab", "ba")))]


def test_texts_that_defeat_polynomial_hashes(reference, library):
    pair = thue_morse()
    data, at = spans.W.utf8(pa.array(pair))
    assert len(set(spans.W.word_hashes(data, at)[0].tolist())) == 1 + (pair[0] != pair[1])
    bpe = byte_bpe.bpe_of(open(RANKS, "rb").read(), P.PATTERN)
    ids = split(*bpe.encode(pa.array(pair)))
    assert [bpe.decode(np.array(x, np.int32))[0].tobytes().decode() for x in ids] == pair
    encoder = token_files._encoder(open(P.path("byte_bpe_50k.json"), "rb").read())
    assert split(*encoder.texts(pa.array(pair))) == [library.encode(t, add_special_tokens=False).ids for t in pair]


def test_long_spans_never_hang_on_hashes(monkeypatch, reference):
    bpe = byte_bpe.Bpe(open(RANKS, "rb").read(), P.PATTERN)
    monkeypatch.setattr(spans.W, "span_hashes", lambda data, begin, end: np.full(len(begin), 7, np.uint64))
    monkeypatch.setattr(spans, "MOST_LONG", 2)
    for text in ("abcdefgh" + "q" * 40 + "ijklmnop", "abcdefgh" + "z" * 40 + "ijklmnop", "abcdefgh" + "z" * 4000 + "ijklmnop") * 2:
        assert split(*bpe.encode(pa.array([text + " x", text]))) == [reference.encode_ordinary(text + " x"), reference.encode_ordinary(text)]


def test_special_strings_are_what_the_library_makes_of_them(library):
    encoder = token_files._encoder(open(P.path("byte_bpe_50k.json"), "rb").read())
    some = ["a <|endoftext|> b", "<|endoftext|>", " x<|endoftext|>", "no <|endoftext| here", None, "<|endoftext|>" * 3 + " q " * 30]
    assert split(*encoder.texts(pa.array(some))) == [library.encode(t or "", add_special_tokens=False).ids for t in some]
    assert 50256 in library.encode(some[0], add_special_tokens=False).ids


def test_unknown_id_is_an_error():
    bpe = byte_bpe.bpe_of(open(RANKS, "rb").read(), P.PATTERN)
    with pytest.raises(ValueError):
        bpe.decode(np.array([10**6]))


def test_long_text_is_tokenized_in_spans(monkeypatch):
    seen = []
    cache = SpanCache(lambda xs: spans.coded([seen.append(x) or np.frombuffer(x.encode(), np.uint8) for x in xs]))
    monkeypatch.setattr(spans, "AT_ONCE", 1000)
    text = "word, " * 50_000 + "end"
    ids, at = cache.texts(pa.array([text]))
    assert bytes(ids.astype(np.uint8)).decode() == text and at.tolist() == [0, len(text)]
    assert sorted(set(seen)) == [" end", " word", ",", "word"]


def test_bpe_frames(spark, reference):
    rows = [(1, "a b"), (1, "a b"), (None, None), (3, ""), (4, "naïve \U0001f600"), (5, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "old", "kept") for i, t in rows], "doc_id long, text string, ids string, `we.ird` string")
    out = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert [r["ids"] for r in out] == [reference.encode_ordinary(t or "") for _, t in rows]
    assert [bytes(r["bytes"]).decode() for r in out] == [t or "" for _, t in rows]
    assert out[0]["we.ird"] == "kept"
    both = byte_bpe.encode_and_decode(df, RANKS, P.PATTERN)
    assert both.columns == [*df.columns, "bytes"] and [tuple(r) for r in both.collect()] == [tuple(r) for r in out]
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(nothing, RANKS, P.PATTERN).count() == 0
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert bytes(byte_bpe.decode(nulls, RANKS, P.PATTERN).first()["bytes"]) == b""


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [7, 7, 9], list(range(0, 10**6, 997)), [2**40, 2**40 + 1], list(range(2000))])
def test_elias_fano(values):
    coded = token_files.EliasFano.of(np.array(values, np.uint64))
    again, end = token_files.EliasFano.load(memoryview(coded.dump()), 0)
    assert end == len(coded.dump())
    assert again.values().tolist() == values
    assert [again.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        again.select(len(values))


def test_elias_fano_random_and_small():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(0, 3000, 20_000))
    coded = token_files.EliasFano.of(values)
    assert (coded.values() == values).all()
    assert all(coded.select(int(i)) == values[i] for i in rng.integers(0, len(values), 500))
    assert len(coded.dump()) < 8 * len(values) / 4


def test_shard_opens_single_documents():
    ids = [np.array(x, np.uint32) for x in ([1, 2], [], [70_000], [3])]
    shard = token_files.Shard(token_files.pack_shard([None, -5, 0, 9], ids))
    assert [shard.doc(i).tolist() for i in range(4)] == [x.tolist() for x in ids]
    assert shard.doc_ids() == [None, -5, 0, 9]


def test_documents_of_a_shard_are_selected(monkeypatch):
    monkeypatch.setattr(token_files.EliasFano, "values", None)  # expands all boundaries
    ids = [np.arange(i % 5, dtype=np.uint32) for i in range(700)]
    image = token_files.pack_shard([None, None, *range(-7, 691)], ids)
    batch = pa.RecordBatch.from_pydict({"start": [40], "image": [image]})
    got = [r for b in token_files._documents([batch]) for r in b.to_pylist()]
    starts = 40 + np.cumsum([0, *map(len, ids)])
    assert [r["doc_id"] for r in got] == [None, None, *range(-7, 691)]
    assert [(r["start"], r["n_tokens"], r["ids"]) for r in got] == [(s, len(x), x.astype("<u4").tobytes()) for s, x in zip(starts, ids)]


@pytest.mark.parametrize("shard_ids", [7, 1 << 22])
def test_token_files(spark, library, shard_ids):
    rows = [(i, t) for i, t in enumerate(texts(120))] + [(3, "again"), (3, "again"), (None, "no id"), (-2, None), (10**12, "far")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(3)
    path = scratch(spark, "shards")
    token_files.write_token_files(df, path, P.path("byte_bpe_50k.json"), end_id=2, shard_ids=shard_ids)
    got = token_files.read_token_files(spark, path).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(got, key=lambda r: (key(r), r["start"]))
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at, expected = 0, {}
    for i, t in rows:
        expected.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    for r in got:
        ids = list(struct.unpack(f"<{r['n_tokens']}I", r["ids"]))
        assert r["start"] == at and ids in expected[r["doc_id"]]
        expected[r["doc_id"]].remove(ids)
        at += len(ids)


def test_token_files_of_nothing(spark):
    path = scratch(spark, "shards")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, P.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


def test_op4_and_op5_over_the_table(spark, library, reference):
    import hashlib

    from meadowlark.llm.queries import QUERIES, table

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    at = 0
    for r in sorted(QUERIES["op4_token_files"](spark, sf).collect()):
        ids = [*library.encode(docs[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert tuple(r) == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = QUERIES["op5_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = reference.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def counts_of(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, tokens long")


def test_rollups_take_signed_batches_once(spark):
    ledger = scratch(spark, "ledger")
    old = counts_of(spark, [("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, None, "v1", 2), ("b", "fr", "v1", None)])
    assert token_counts.commit(token_counts.signed(old, 1), ledger, "b1")
    assert not token_counts.commit(token_counts.signed(old, 1), ledger, "b1")
    before, after = counts_of(spark, [("a", "en", "v1", 7)]), counts_of(spark, [("a", "en", "v2", 9)])
    assert token_counts.commit(token_counts.revised(before, after), ledger, "b2")
    assert token_counts.commit(token_counts.signed(counts_of(spark, [(None, None, "v1", 2)]), -1), ledger, "b3")
    got = {tuple(r) for r in token_counts.totals(spark, ledger).select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()}
    assert got == {("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 9), ("b", "fr", "v1", 1, 0)}
    with pytest.raises(ValueError):
        token_counts.commit(token_counts.signed(old, 1), ledger, "../x")


def test_a_half_written_batch_is_replaced(spark):
    ledger = scratch(spark, "ledger")
    rows = counts_of(spark, [("a", "en", "v1", 5)])
    token_counts.commit(token_counts.signed(rows, 1), ledger, "b1")
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/batch=b1/_SUCCESS")
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, False)
    assert token_counts.commit(token_counts.signed(rows, 1), ledger, "b1")
    assert token_counts.totals(spark, ledger).first()["n_tokens"] == 5


def test_op8_over_the_table(spark, reference):
    from meadowlark.llm.queries import QUERIES, table

    sf = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for r in table(spark, sf, "documents").collect():
        name, coder = ("byte_bpe_50k", reference) if r["lang"] == "en" else ("byte_bpe_multi_50k", multi)
        n, t = expected.get((r["source"], r["lang"], name), (0, 0))
        expected[r["source"], r["lang"], name] = n + 1, t + len(coder.encode_ordinary(r["text"] or ""))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op8_token_counts"](spark, sf).collect()}
    assert got == expected


def test_ledger_without_batches_is_empty(spark):
    ledger = scratch(spark, "ledger")
    assert token_counts.totals(spark, ledger).collect() == [] and not token_counts.compact(spark, ledger)


def test_snapshots_hold_the_batches_before_them(spark):
    ledger = scratch(spark, "ledger")

    def rows(*r):
        return spark.createDataFrame(list(r), "source string, lang string, tokenizer string, tokens long")
    seen = {}
    for i in range(6):
        token_counts.commit(token_counts.signed(rows(("a", None, "v", i), ("b", "en", "v", 10)), 1), ledger, f"b{i}")
        if i % 2:
            assert token_counts.compact(spark, ledger) and not token_counts.compact(spark, ledger)
        seen[i] = sorted(map(str, token_counts.totals(spark, ledger).collect()))
        assert seen[i] == sorted(map(str, [Row for Row in token_counts._sums(spark.read.schema(token_counts._SCHEMA).parquet(
            *[f"{ledger}/batch=b{j}" for j in range(i + 1)])).collect()]))
    assert token_counts._snapshot(spark, ledger) == (3, [f"b{i}" for i in range(6)])
    # a batch that the snapshot holds is not read again, and not committed again
    assert not token_counts.commit(token_counts.signed(rows(("a", None, "v", 9)), 1), ledger, "b0")
    paths = [f.rsplit("/", 2)[1] for f in token_counts._current(spark, ledger)[0].inputFiles()]
    assert set(paths) == {"_totals-3"}
    # a snapshot that never became whole does not count
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/_totals-3/_SUCCESS")
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, False)
    assert sorted(map(str, token_counts.totals(spark, ledger).collect())) == seen[5]
    # a folder that is not whole is not read
    rows(("zz", "en", "v", 1)).write.parquet(f"{ledger}/batch=half")
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/batch=half/_SUCCESS")
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, False)
    assert sorted(map(str, token_counts.totals(spark, ledger).collect())) == seen[5]


def test_two_writers_of_a_batch_count_once(spark):
    from concurrent.futures import ThreadPoolExecutor
    ledger = scratch(spark, "ledger")
    rows = spark.createDataFrame([("a", "en", "v", 7)], "source string, lang string, tokenizer string, tokens long")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: token_counts.commit(token_counts.signed(rows, 1), ledger, "same"), range(4)))
    assert any(done)
    assert [tuple(r) for r in token_counts.totals(spark, ledger).collect()] == [("a", "en", "v", 1, 7)]
