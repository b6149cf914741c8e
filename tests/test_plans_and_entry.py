"""The contract of the entry module, oracle agreement on small data, and plan shapes."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# the whole list runs with tools/check.py; here one query per kind keeps the suite short
SAMPLE = ["events_detailed", "statistics", "parent_with_children", "rank_percent", "first_per_key", "top_n_per_day", "unique_claim", "upsert", "precedence_merge",
          "cosine_topk", "search", "keyword_search", "match_contains", "match_fuzzy", "match_tokens", "job_attributes", "price_info", "booking_class", "best_sentences",
          "to_icalendar", "fill_websites", "clean_catalogue", "merge_by_location", "sitemap_urls"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_agrees(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = entry.entry(spark)
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00), LessThan(ts,2024-02-01T00:00)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in text
    assert "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["top_n_per_day", "first_per_key", "cosine_topk", "first_matching_page"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["vector_cross", "cosine_topk", "match_contains", "match_tokens", "match_fuzzy", "passage_containment", "new_records", "search"])
def test_no_cross_joins(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


@pytest.mark.parametrize("name", ["discover_jobs_stays", "discover_events", "refine_jobs", "refine_stays", "refine_events", "redescribe_jobs", "first_matching_page"])
def test_page_bodies_are_not_sorted(spark, name, monkeypatch):
    """No sort or window of a page job carries html."""
    from meadowlark import session
    plans = []
    checkpointed = session.DataFrame.checkpoint
    monkeypatch.setattr(session.DataFrame, "checkpoint", lambda df, eager=True: plans.append(plan(df)) or checkpointed(df, eager))
    plans.append(plan(QUERIES[name](spark, SF)))
    assert len(plans) > 0
    for text in plans:
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if re.search(r"[-\s]Sort \[|Window \[", line):
                below = next((x for x in lines[i + 1:] if re.search(r"Project \[|FileScan|Exchange|Join", x)), "")
                assert "html#" not in line and not ("Project [" in below and re.search(r"[\[ ]html#", below)), (name, line, below)
