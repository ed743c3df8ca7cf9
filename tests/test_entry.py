"""The catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from recallspark.operators import lexical
from recallspark.plans import catalogue

TABLES = "documents embeddings benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(df):
    return sorted(tuple("NULL" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, sf_dir, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    fix = lambda d: d.assign(**{c: d[c].map(lambda v: float(v)) for c in d.columns if d[c].dtype.kind == "f"})
    ints = [c for c in got.columns if got[c].dtype.kind in "iuf" and want[c].dtype.kind in "iu"]
    for c in ints:
        want[c] = want[c].astype("float64") if got[c].dtype.kind == "f" else want[c]
    nullable = [c for c in want.columns if str(want[c].dtype) == "Int64"]
    for c in nullable:
        want[c] = want[c].astype("float64") if got[c].dtype.kind == "f" else want[c].astype("int64")
    assert canon(fix(got)) == canon(fix(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{here}/recallspark"):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert ".llm" not in open(f"{folder}/{f}").read()


@pytest.mark.parametrize("name", ["interesting_questions", "variant_selection", "compare_reports", "worked_examples"])
def test_gold_and_hits_are_found_once(spark, sf_dir, monkeypatch, name):
    calls = []
    for step in ("_gold", "_run"):
        real = getattr(catalogue, step)
        monkeypatch.setattr(catalogue, step, lambda *a, step=step, real=real: calls.append((step, *a[2:])) or real(*a))
    catalogue.QUERIES[name](spark, sf_dir)
    assert ("_gold",) in calls and len(calls) == len(set(calls))


@pytest.mark.parametrize("name", ["missed_outcomes", "no_gold_guard", "retrieval_metrics", "stage_breakdown", "single_branch_gold", "literal_fallback", "hybrid_search", "qa_token_f1"])
def test_no_postings_are_formed_and_no_step_is_repeated(spark, sf_dir, monkeypatch, name):
    formed, calls = [], []
    flat = lexical._flat
    monkeypatch.setattr(lexical, "_flat", lambda docs: formed.append(docs) or flat(docs))
    for step in ("_gold", "_run", "_vector_run"):
        real = getattr(catalogue, step)
        monkeypatch.setattr(catalogue, step, lambda *a, step=step, real=real: calls.append((step, *a[2:])) or real(*a))
    catalogue.QUERIES[name](spark, sf_dir)
    assert not formed and len(calls) == len(set(calls))
