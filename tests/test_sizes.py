"""What shows in larger tables alone: long keys, joins that must not be broadcast, work that is done once."""

import inspect
import os
import re
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  fills the registry
from changelens.functions import lazy, letters
from changelens.functions import values as V
from changelens.operators import changes, evaluate, replay_run, retrieve, symbols
from changelens.plans import catalogue
from changelens.sources import store
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
KEYS = ("l_suppkey", "s_suppkey")


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with suppliers' keys as a larger copy has them."""
    to = str(tmp_path_factory.mktemp("far"))
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM read_parquet('{SF}/{name}')")
        columns = [r[0] for r in con.execute("DESCRIBE t").fetchall()]
        moved = ", ".join(f"{c} + 99990 AS {c}" if c in KEYS else c for c in columns)
        con.execute(f"COPY (SELECT {moved} FROM t) TO '{to}/{name}'")
    return to


def test_references_to_long_numbers_stay_whole(spark, far):
    assert compare(catalogue.QUERIES["article_references"](spark, far), connect(far), catalogue.ORACLES["article_references"]) is None


@pytest.mark.parametrize("name, most", [("ir_metrics", 2), ("patch_metrics", 3), ("ablation_matrix", 2)])
def test_cases_are_dealt_out_once(spark, name, most):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= most and "Expand" not in plan and "Join" not in plan


@pytest.mark.parametrize("name, most", [("evidence_of_source", 4), ("hybrid_merge", 6)])
def test_sources_of_a_place_are_taken_as_they_come(spark, name, most):
    """Lists of more than 128 places in a task would be sorted once for its part and once for the whole."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and len(re.findall(r"\bSort \[", plan)) <= most


def test_candidates_that_arrive_together_are_one_place(spark):
    ddl = "query_id long, provider_idx int, cand_idx long, source string, path string, symbol string, line_start int, content_hash string, normalized_score double, stale boolean, verified_state string"
    rows = [(1, 0, 0, "rag", "b", None, 1, "h", 0.5, False, "x"), (1, 0, 0, "rag", "b", None, 2, "g", 0.5, True, None), (1, 0, 0, "term_dictionary", "b", "", 3, None, 1.0, True, "w"), (1, 1, 0, "rag", "b", None, 4, "h", 0.75, False, "v")]
    got = [{tuple(r) for r in retrieve.merge(spark.createDataFrame(some, ddl).repartition(4)).select("dedup_key", "symbol", "n_sources", "final_score", "stale", "verified_state", "sources", "strongest").collect()} for some in (rows, rows[::-1])]
    assert got == [{("b::line:0", None, 2, 0.3625, False, "w", "term_dictionary,rag", 1.0)}] * 2


def test_nulls_are_equal_to_none(spark):
    rows = lambda c, *r: spark.createDataFrame(list(r), f"case_id long, {c} string")
    got = evaluate.patch(rows("key", (1, None), (1, "a"), (None, "a")), rows("key", (1, None), (1, "a"), (None, "b")), rows("path", (2, None), (2, "x")), rows("path", (2, None), (2, "x")))
    assert {tuple(r) for r in got.collect()} == {(1, 0.5, 1.0, 0.0, 1.0), (2, 1.0, 0.5, 0.5, 1 / 3), (None, 1.0, 1.0, 0.0, 1.0)}


def test_a_text_that_a_batch_holds_twice_is_read_once():
    read = []
    fields = pa.struct([("n", pa.int64())])
    got = lazy.by_text(pa.array(["a", None, "bb", "a", ""]), lambda t: read.append(t) or [(k,) for k in range(len(t))], fields)
    assert got.to_pylist() == [[{"n": 0}], None, [{"n": 0}, {"n": 1}], [{"n": 0}], []] and read == ["a", "bb", ""]
    assert lazy.by_text(pa.array([None, None], pa.string()), lambda t: [], fields).to_pylist() == [None, None]


def test_texts_that_differ_in_their_numbers_alone_are_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(lazy, "OFTEN", 2)
    shapes = ("제{0}조의{1}제{0}항 중 \"{2}원\"을 “{1}{2}원”으로 하고, 같은 조 제{1}항을 삭제한다. 제{2}조를 다음과 같이 한다.\n본문 {0}", "{0}제{1}２조 중 {0}를 {2}로 한다.{1}", "{0}", "없음")
    texts = [s.format(k, k * 10**9, f"00{k}") for k in range(5) for s in shapes] + [None, "", "제1조를 삭제한다"]
    got = lazy.by_wording(pa.array(texts), lambda t: read.append(t) or changes._edits(t), changes._EDIT).to_pylist()
    assert got == [None if t is None else changes.edits_of(t) for t in texts] and len(read) == len(shapes) + 2
    assert [tuple(e.values()) for e in got[1]] == [("제0２조", "replace", "0", "000")]
    assert lazy.by_wording(pa.array([], pa.string()), changes._edits, changes._EDIT).to_pylist() == []


def test_tables_of_cases_are_not_broadcast(spark):
    """Small files of many cases: Spark would take their size for that of their rows."""
    one = lambda rows, ddl: store.scratch(spark.createDataFrame(rows, ddl), "t")
    cases = one([(1, None, True, "passed")], "case_id long, failure_kind string, git_apply boolean, golden_status string")
    files = "case_id long, path string"
    edits = files + ", before string, after string"
    m = replay_run.metrics(
        cases, one([(1, "a", "in_scope")], files + ", scope string"), one([(1, "a", 1)], files + ", rank int"), one([(1, "a", "x", "y", "exact")], edits + ", match_mode string"),
        one([(1, "a", "x", "y")], edits), one([(1, "a")], files), one([(1, True)], "case_id long, ok boolean"),
    )
    assert [r.passed for r in m.collect()] == [True] and "BroadcastExchange" not in m._jdf.queryExecution().executedPlan().toString()


def test_files_are_parsed_once(spark):
    files = spark.createDataFrame([("a/A.java", "package a;\npublic class A { static final int K1 = 1; }"), ("a/B.java", "package a;\npublic class B { int x = A.K1; }")], "path string, text string")
    edges = symbols.link(symbols.harvest(files)[0], files)
    assert "_java" not in edges._jdf.queryExecution().executedPlan().toString()
    assert ("java:a.B", "const:a.A.K1", "uses_constant") in {tuple(r) for r in edges.collect()}


def test_texts_that_all_differ_are_read_side_by_side():
    """Calls of functions grow with the kinds of values, not with the texts."""
    read = inspect.getclosurevars(V._typed).nonlocals["f"]
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    def of(texts):
        calls[0] = 0
        sys.setprofile(count)
        try:
            return read(pa.array(texts)), calls[0]
        finally:
            sys.setprofile(None)

    text = "{0}만원과 {0}원, 2.{0}%에서 {0}분의 3까지 9시간, 2024년 3월 1일과 2024-03-0{1}, 만 15세"
    few, many = ([text.format(k, k % 9) for k in range(n)] for n in (10, 2000))
    of(few)
    assert of(many)[1] < 2 * of(few)[1]


ODD_TEXTS = {
    "1억5,000만원 2천원, 3천만 4만원, 1,,2원, ,3원, 2 천 7만 원": {"money": "50000000,40000,12,3,20070000"},
    "12.5%, 1. 퍼센트, .5프로, 1.2.3%": {"rate": "0.125,0.05,0.023"},
    "100분의 50분의 3분의 2, 0분의 1, 1,000분의 7.5": {"rate": "0.5,0.666667,0.0075"},
    "3분의 1 뒤 5%": {"rate": "0.05,0.333333"},
    "0.0001%, 99999999999999999999원, 9007199254740993원": {"rate": "1e-06", "money": "1e+20,9007199254740992"},
    "0.0001%, 20%": {"rate": "1e-06,0.2"},
    "3개월 뒤 15일 이내 1,052시간, 7일부터 1시간": {"duration": "52,15,3"},
    "만 65세, 20세 \t이상, 1세 이상, 165세 미만, 7세": {"age": "65,20,65"},
    "2026년 1월1일, 12026년 13월 111일, 2026-03-05, 2026-03-055, 12026-03-05, 2027년": {"date": "2026-01-01,2026-13,2026-03-05,2027"},
    "２４시간\x00일 이상": {},
    "20": {},
    "%": {},
    "": {},
}


def test_odd_texts_are_read_alike_in_runs_of_any_length(spark, monkeypatch):
    for size in (1, 50, 1 << 19):
        monkeypatch.setattr(letters, "SIDE_BY_SIDE", size)
        texts = [*ODD_TEXTS, None, *ODD_TEXTS]
        got = V.side_by_side(pa.array(texts), V._read).to_pylist()
        assert got[: len(ODD_TEXTS)] == got[len(ODD_TEXTS) + 1 :] and got[len(ODD_TEXTS)] is None
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[F.array_join(V.said(F.col("t"), k), ",").alias(k) for k in V.KINDS], *[F.array_join(V._of(F.col("t"), k)["value"], ",").alias(f"{k}_too") for k in V.KINDS])
    for r in df.collect():
        assert r.t is None and not any(r) or [(r[k], r[f"{k}_too"]) for k in V.KINDS] == [(ODD_TEXTS[r.t].get(k, ""),) * 2 for k in V.KINDS], r


def test_plain_numbers_are_number_keys(spark):
    v = np.array([0, 1, 10, 2500, 2.5, 0.06, 0.1, 0.01, 0.001, 1 / 3, 0.9999995, 0.09999995, 123456.5, 999989.5, 1.2345645, 99999.95, 2.0**52, 4503599627370495.5])
    key = {r.v: r.k for r in spark.createDataFrame([(float(x),) for x in v], "v double").select("v", V.number_key(F.col("v")).alias("k")).collect()}
    assert V.plain_numbers(v).to_pylist() == [key[x] for x in v[:-1]] + [None]
    assert V.plain_numbers(np.array([1e-4, 2.0**53, 1e6 + 0.5, np.inf, np.nan])).null_count == 5
