"""The five stages one after the other, each against what its input asks for."""

import base64
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from meadowlark.llm import jaccard_join, mixing, quality_classifier, quality_rules
from meadowlark.llm.batches import written
from meadowlark.llm.queries import quality_model, table, trusted_ids
from tests.llm.test_texts import exact_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, written(stage(spark, docs, SF), "step")))
        docs = out[-1][2]
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_and_columns(steps):
    assert [n for n, _, _ in steps] == ["quality classifier", "quality rules", "near duplicates", "source mix", "byte BPE"]
    assert all(tuple(out.columns) == corpus_pipeline.COLUMNS for _, _, out in steps[:-1])


def test_classifier_and_rules_keep_what_they_judge_good(spark, steps):
    _, docs, out = steps[0]
    scored = quality_classifier.score(docs, quality_model(spark, docs, SF))
    assert Counter(rows(out)) == Counter(rows(scored.where("predicted = 1")))
    _, docs, out = steps[1]
    assert Counter(rows(out)) == Counter(rows(quality_rules.quality_rules(docs, trusted_ids(spark, SF)).where("kept")))


def test_near_duplicates_leave_one_of_each_class(steps):
    _, docs, out = steps[2]
    classes = exact_classes(rows(docs))
    assert sorted(i for i, _ in rows(out)) == sorted({c for _, c, _ in classes}) and len(classes) > len(rows(out))


def test_mix_takes_every_document_as_often_as_asked(steps):
    _, docs, out = steps[3]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert Counter(i for i, _ in rows(out)) == Counter({i: n for i, n in copies.items() if n})


def test_ids_are_those_of_the_library(steps):
    _, docs, out = steps[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((i, tuple(coder.encode_ordinary(t))) for i, t in rows(docs))
    got = out.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expected
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_run_is_the_stages_in_turn(spark, steps):
    ran = corpus_pipeline.run(spark, SF)
    assert Counter(map(str, ran.collect())) == Counter(map(str, steps[-1][2].collect()))


def test_odd_rows_pass_every_stage(spark):
    odd = [(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", None), (2, "word " * 30_000, "en", "s", 3),
           (3, "twelve words that are not in any other text of this small table", "en", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "old", 0.5) for r in odd + odd[1:3]], schema + ", ids string, Score double")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    # null and empty texts of one id are the same row
    assert jaccard_join.one_per_class(docs).count() == len({(r[0], r[1] or "") for r in odd}) == 4
