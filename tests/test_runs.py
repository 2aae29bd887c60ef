"""Searches whose sources fail, caches, the log, revisions and the replay from end to end."""

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from changelens.operators import replay_run, retrieve, revisions
from changelens.schemas import CANDIDATES
from changelens.sources import sinks, store

ROW = "CAST({q} AS BIGINT) AS query_id, CAST({k} AS BIGINT) AS cand_idx, '{s}' AS source, '{p}' AS path, CAST(NULL AS STRING) AS symbol, 1 AS line_start, CAST(NULL AS STRING) AS content_hash, {v}D AS normalized_score, false AS stale, CAST(NULL AS STRING) AS verified_state"


def found(spark, *rows):
    return spark.sql(" UNION ALL ".join("SELECT " + ROW.format(q=q, k=k, s=s, p=p, v=v) for k, (q, s, p, v) in enumerate(rows)))


def late(batches):
    for k, b in enumerate(batches):
        if k == 9:
            raise ValueError("gone")
        yield b


# ------------------------------------------------------------------------------------------ search
def test_a_source_that_fails_late_takes_nothing_from_others(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    many = lambda d: found(spark, (1, "term_dictionary", "t.java", 0.5)).crossJoin(spark.range(200)).drop("id").coalesce(1)
    broken = lambda d: many(d).mapInArrow(late, many(d).schema)
    rag = lambda d: found(spark, (1, "rag", "a.java", 0.9), (1, "rag", "b.java", 0.8), (2, "rag", "c.java", 0.7))
    alone, _ = retrieve.search(q, {"rag": rag})
    got, status = retrieve.search(q, {"term_dictionary": broken, "rag": rag, "code_graph": None})
    rows = lambda d: sorted((r.query_id, r.path, r.final_score, r["rank"]) for r in d.collect())
    assert rows(got) == rows(alone) and len(rows(got)) == 3
    how = {r.source: (r.status, r.candidates) for r in status.collect()}
    assert how == {"term_dictionary": ("error", 0), "rag": ("success", 3), "code_graph": ("disabled", 0)}
    assert "PythonException" in status.where("status = 'error'").first().message
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_disabled_is_empty_and_all_failing_an_error(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    got, status = retrieve.search(q, {"rag": None})
    assert got.count() == 0 and "final_score" in got.columns and status.first().status == "disabled"
    with pytest.raises(RuntimeError):
        retrieve.search(q, {"rag": lambda d: d.select("nothing")})


def test_faults_of_the_program_are_not_hidden(spark):
    with pytest.raises(TypeError):
        retrieve.search(spark.createDataFrame([(1,)], "query_id long"), {"rag": lambda d: len(3)})


def test_stages_that_fail_leave_what_came_before(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    rag = lambda d: found(spark, (1, "rag", "a.java", 0.9))
    deltas = lambda m: m.select("query_id", "dedup_key", F.raise_error(F.lit("no history")).cast("double").alias("delta"))
    got, status = retrieve.search(q, {"rag": rag}, deltas=deltas)
    assert got.count() == 1 and {r.source: r.status for r in status.collect()} == {"rag": "success", "rerank": "error"}


def test_graph_brings_neighbours_of_the_best(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    nodes = spark.createDataFrame([("n1", "k", "A", "a.java", None), ("n2", "k", "B", "b.xml", None)], "id string, kind string, name string, path string, container string")
    edges = spark.createDataFrame([("n1", "n2", "service_to_mapper")], "src string, dst string, kind string")
    got, status = retrieve.search(q, {"rag": lambda d: found(spark, (1, "rag", "a.java", 0.9))}, graph=(nodes, edges))
    assert [(r.path, r.sources) for r in got.orderBy("rank").collect()] == [("a.java", "rag"), ("b.xml", "code_graph")]
    assert {r.source for r in status.collect()} == {"rag", "graph"}


# ------------------------------------------------------------------------------------------ caches
def files_of(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]


def test_cache_is_built_once_and_again_when_damaged(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.range(10).write.parquet(src)
    cache, calls = store.Cache(spark, f"{tmp_path}/cache"), []

    def build():
        calls.append(1)
        return spark.read.parquet(src).withColumn("twice", F.col("id") * 2)

    for _ in range(3):
        assert cache.table("t", {"src": src}, build).agg(F.sum("twice")).first()[0] == 90
    assert len(calls) == 1
    cache.table("t", {"src": src}, build, k=2)
    cache.table("t", {"src": src}, build, version="2")
    assert len(calls) == 3 and len(set(cache.built)) == 3
    whole = f"{tmp_path}/cache/{cache.built[0]}"
    os.remove(files_of(whole)[0])
    assert cache.table("t", {"src": src}, build).count() == 10 and len(calls) == 4
    with open(f"{whole}/note.json", "w") as f:
        f.write("{")
    assert cache.table("t", {"src": src}, build).count() == 10 and len(calls) == 5
    spark.range(1).write.mode("append").parquet(src)
    assert cache.table("t", {"src": src}, build).count() == 11 and len(calls) == 6
    assert not [n for n in os.listdir(f"{tmp_path}/cache") if n.startswith(".")]


def test_second_read_needs_no_source(spark, tmp_path):
    """What is kept is read even if the sources' content can't be any more."""
    src = f"{tmp_path}/src"
    spark.range(10).write.parquet(src)
    cache = store.Cache(spark, f"{tmp_path}/cache")
    cache.table("t", {"src": src}, lambda: spark.read.parquet(src))
    for f in files_of(src):
        size, at = os.path.getsize(f), os.stat(f).st_mtime
        with open(f, "wb") as out:
            out.write(b"x" * size)
        os.utime(f, (at, at))
    assert cache.table("t", {"src": src}, lambda: spark.read.parquet(src)).count() == 10


def test_empty_tables_are_not_kept(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.range(3).write.parquet(src)
    cache = store.Cache(spark, f"{tmp_path}/cache")
    for _ in range(2):
        got = cache.table("t", {"src": src}, lambda: spark.read.parquet(src).where("id > 9"))
        assert got.count() == 0 and got.columns == ["id"]
    assert len(cache.built) == 2 and cache.folder.names() == []


def test_keys_do_not_run_together():
    assert store.key_of("a", "bc") != store.key_of("ab", "c") and re.fullmatch("[0-9a-f]{16}", store.key_of("a"))


# ------------------------------------------------------------------------------------------ the log
def test_log_grows_and_refuses(spark, tmp_path):
    log = store.Log(spark, f"{tmp_path}/log", ("k",))
    rows = lambda *ks: spark.createDataFrame([(k, f"v{k}") for k in ks], "k long, v string")
    assert log.version() == 0 and log.append(rows(1, 2)) == 1 and log.append(rows(3)) == 2
    with pytest.raises(store.Refused):
        log.append(rows(9, 3))
    with pytest.raises(store.Refused):
        log.append(rows(8, 8))
    with pytest.raises(store.Refused):
        log.append(spark.range(1))
    assert sorted(r.k for r in log.read().collect()) == [1, 2, 3] and sorted(r.k for r in log.read(1).collect()) == [1, 2]
    assert [r.k for r in log.read(after=1).collect()] == [3] and log.verify() == [] and log.append(rows()) == 3


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    log = store.Log(spark, f"{tmp_path}/log")
    log.append(spark.range(5))
    monkeypatch.setattr(store.Folder, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        log.append(spark.range(100))
    monkeypatch.undo()
    assert log.version() == 1 and log.read().count() == 5 and len(log.leftovers()) == 1
    assert log.append(spark.range(2)) == 2 and log.read().count() == 7


def test_two_that_commit_at_once_both_stay(spark, tmp_path, monkeypatch):
    a, b = store.Log(spark, f"{tmp_path}/log"), store.Log(spark, f"{tmp_path}/log")
    put, once = store.Folder.put, []

    def slow(self, name, text):
        put(self, name, text)
        if not once:
            once.append(1)
            b.append(spark.range(2))

    monkeypatch.setattr(store.Folder, "put", slow)
    assert a.append(spark.range(5)) == 2 and a.read().count() == 7 and a.verify() == []


def test_tampering_is_told(spark, tmp_path):
    log = store.Log(spark, f"{tmp_path}/log")
    for k in range(3):
        log.append(spark.range(k + 1))
    spark.range(2).selectExpr("id + 5 AS id").write.mode("overwrite").parquet(f"{tmp_path}/log/{log.note(2)['folder']}")
    assert log.verify() == [(2, "changed")]
    shutil.rmtree(f"{tmp_path}/log/{log.note(1)['folder']}")
    assert (1, "missing") in log.verify()
    first = f"{tmp_path}/log/notes/000000000001.json"
    text = open(first).read()
    open(first, "w").write(text.replace('"rows": 1', '"rows": 2'))
    crc = f"{tmp_path}/log/notes/.000000000001.json.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert (2, "broken chain") in log.verify()


def test_numbers_of_a_group_that_fills_many_ranges(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 10 > 1, "a").alias("g"), (F.col("id") % 50).alias("o"), "id")
    got = store.numbered(df, ["g"], ["o", "id"], parts=7)
    want = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.g), r.o, r.id)):
        want[r.id] = want.get(("n", r.g), 0) + 1
        want["n", r.g] = want[r.id]
    assert {r.id: r.n for r in got.collect()} == {k: v for k, v in want.items() if not isinstance(k, tuple)}
    assert store.numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_event_names_past_four_digits(spark):
    ev = spark.range(10_002).selectExpr("TIMESTAMP'2026-01-02 03:04:05' AS occurred_at", "id AS ord")
    names = {r.ord: r.event_id for r in sinks.event_ids(ev).where("ord IN (0, 9998, 10001)").collect()}
    assert names == {0: "F-20260102-0001", 9998: "F-20260102-9999", 10001: "F-20260102-10002"}


# ------------------------------------------------------------------------------------------ revisions and replay
VERSIONS = [("r", "a", 1, "a1"), ("r", "a", 5, "a5"), ("r", "b", 2, "b2"), ("r", "b", 4, None), ("s", "a", 1, "other"), ("r", "c", 9, "c9")]


def test_files_at_a_revision(spark):
    v = spark.createDataFrame(VERSIONS, "repo string, path string, position int, content string")
    asked = spark.createDataFrame([(k, "r", p, at) for k, (p, at) in enumerate([("a", 0), ("a", 1), ("a", 4), ("a", 5), ("b", 3), ("b", 4), ("b", 8), ("c", 8), ("d", 8)])], "case_id int, repo string, path string, position int")
    got = {r.case_id: r.content for r in revisions.at_revision(v, asked).collect()}
    assert got == {1: "a1", 2: "a1", 3: "a5", 4: "b2"}
    trees = revisions.snapshot(v, spark.createDataFrame([("r", k) for k in (1, 3, 5)], "repo string, revision int"))
    assert sorted((r.revision, r.path, r.content) for r in trees.collect()) == [(1, "a", "a1"), (3, "a", "a1"), (3, "b", "b2"), (5, "a", "a5")]


def test_replay_from_end_to_end(spark, tmp_path):
    """The tree at the base revision is searched, not what came later; a second run reads the cached index."""
    versions = [("r", "A.java", 1, "int limit = 150000;"), ("r", "B.java", 1, "int other = 70000;"), ("r", "B.java", 2, "int other = 150000;"), ("r", "C.java", 2, "int x = 150000;")]
    path = f"{tmp_path}/versions"
    spark.createDataFrame(versions, "repo string, path string, position int, content string").write.parquet(path)
    cases = spark.createDataFrame([("one", "r", 1, "법", "제1조", "15만원", "25만원"), ("two", "r", 2, "법", None, "15만원", ""), ("none", "r", 1, "법", None, "말", "글")], "case_id string, repo string, revision int, law_name string, article string, before_text string, after_text string")
    cache, told = store.Cache(spark, f"{tmp_path}/cache"), {}

    def draft(d):
        told.update({r.case_id: (r.law, list(r.snippets)) for r in d.collect()})
        return d.select("case_id", F.lit("diff").alias("diff_text"))

    found_, drafts, status = replay_run.run(cases, path, draft, cache)
    got = {}
    for r in sorted(found_.collect(), key=lambda r: (r.case_id, r["rank"])):
        got.setdefault(r.case_id, []).append(r.path)
    assert got == {"one": ["A.java"], "two": ["A.java", "B.java", "C.java"]} and drafts.count() == 3
    assert told["one"] == ("[법령] 법 제1조\n\n[개정 전]\n15만원\n\n[개정 후]\n25만원", ["// A.java\nint limit = 150000;"])
    assert told["two"][1][1] == "// B.java\nint other = 150000;" and told["none"][1] == [] and "(내용 없음)" in told["two"][0]
    assert {r.source: r.status for r in status.collect()} == {"rag": "disabled", "constant_match": "success"}
    replay_run.run(cases, path, draft, cache)
    assert len(cache.built) == 1


def test_metrics_of_a_replay(spark):
    cases = spark.createDataFrame([("a", None, True, "passed"), ("b", None, None, None), ("c", "timeout", None, None)], "case_id string, failure_kind string, git_apply boolean, golden_status string")
    scoped = spark.createDataFrame([("a", "x", "in_scope"), ("a", "y", "excluded"), ("b", "x", "in_scope"), ("b", "z", "in_scope")], "case_id string, path string, scope string")
    found_ = spark.createDataFrame([("a", "q", 1), ("a", "x", 2), ("b", "z", 1)], "case_id string, path string, rank int")
    rep = "case_id string, path string, before string, after string, match_mode string"
    expected = spark.createDataFrame([("a", "x", "1", "2", "exact"), ("b", "x", "1  2", "3", "normalized_text")], rep)
    made = spark.createDataFrame([("a", "./x", "1", "2", "exact"), ("b", "x", "1 2", "3", "exact")], rep)
    touched = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "w")], "case_id string, path string")
    checks = spark.createDataFrame([("a", True), ("b", True), ("b", False)], "case_id string, ok boolean")
    m = {r.case_id: r for r in replay_run.metrics(cases, scoped, found_, expected, made, touched, checks).collect()}
    a, b, c = m["a"], m["b"], m["c"]
    assert (a.recall_1, a.recall_3, a.primary_rank, a.replacement_rate, a.file_coverage, a.unnecessary_rate, a.jaccard, a.fixture_ok, a.passed) == (0, 1, 2, 1, 1, 0, 0.5, True, True)
    assert (b.recall_1, b.primary_rank, b.replacement_rate, b.file_coverage, b.unnecessary_rate, b.fixture_ok, b.passed) == (0.5, 1, 1, 0.5, 0.5, False, False)
    assert (c.recall_10, c.primary_rank, c.replacement_rate, c.passed) == (1, None, 1, False)


def test_candidates_schema_is_complete(spark):
    assert set(spark.createDataFrame([], CANDIDATES).columns) >= set(found(spark, (1, "rag", "a", 1.0)).columns)


def test_dictionary_parts_are_read_one_after_the_other(spark, monkeypatch):
    """A dictionary of several automata finds what one finds."""
    from changelens.operators import index

    texts = spark.createDataFrame([(k, f"term{k} and term{k + 1}x") for k in range(30)], "id long, text string")
    terms = spark.createDataFrame([(f"term{k}",) for k in range(40)], "term string")
    one = {tuple(r) for r in index.contained(texts, terms, "id").collect()}
    monkeypatch.setattr(index, "PART_LETTERS", 30)
    assert {tuple(r) for r in index.contained(texts, terms, "id").collect()} == one and len(one) >= 60


def test_references_within_longer_names(spark):
    from changelens.operators import symbols

    files = spark.createDataFrame([
        ("a/K.java", "package p; public class K { static final int MAX = 1; }"),
        ("a/U.java", "package q; public class U { int x = myK.MAXIMUM; }"),
        ("a/V.java", "package q; public class V { /* K.MAX */ int x = 2; }"),
        ("m/M.xml", "<mapper namespace='n.M'><select id='get'>select 1</select></mapper>"),
        ("a/W.java", 'package q; public class W { String s = "xn.M.getAll"; }'),
    ], "path string, text string")
    nodes, _ = symbols.harvest(files)
    got = {(r.src, r.dst, r.kind) for r in symbols.link(nodes, files).collect() if r.kind != "contains"}
    assert got == {("java:q.U", "const:p.K.MAX", "uses_constant"), ("java:q.W", "mybatis:n.M.get", "service_to_mapper")}
