"""Operators on small fixtures: order-dependent rules, limits, and what single queries don't show."""

import random

import pytest
from pyspark.sql import functions as F

from changelens.functions import text as T
from changelens.functions import vectors
from changelens.operators import changes, chunk, collect, evaluate, events, index, knn, replay, retrieve, symbols
from changelens.sources import files as source_files
from changelens.sources import sinks
from changelens.streaming import collect_stream

CAND = "query_id long, provider_idx int, cand_idx long, source string, path string, symbol string, line_start int, content_hash string, normalized_score double, stale boolean, verified_state string"


def merged(spark, rows):
    return {r.dedup_key: r for r in retrieve.merge(spark.createDataFrame(rows, CAND)).collect()}


def test_merge_scores(spark):
    m = merged(
        spark,
        [
            (1, 0, 0, "rag", "a.java", "x", None, None, 0.4, False, None),
            (1, 0, 1, "rag", "a.java", "x", None, None, 0.8, True, None),
            (1, 1, 0, "term_dictionary", "a.java", "x", None, None, 0.5, False, "approved"),
            (1, 1, 1, "rag", "b.java", None, 27, None, 1.0, True, None),
            (1, 2, 0, "unheard_of", "c.java", None, None, None, 1.0, False, None),
        ],
    )
    a, b, c = m["a.java::symbol:x"], m["b.java::line:20"], m["c.java::line:0"]
    assert (a.final_score, a.n_sources, a.stale, a.verified_state, a.sources) == (0.27, 2, False, "approved", "rag,term_dictionary")
    assert (b.final_score, b.stale) == (0.0, True) and c.final_score == 0.0


def test_merge_keeps_other_hashes_apart_unless_the_first_has_none(spark):
    rows = [(1, 0, k, "rag", "a", "s", None, h, 0.5, False, None) for k, h in enumerate(["h1", "h2", None, "h1"])]
    assert set(merged(spark, rows)) == {"a::symbol:s", "a::symbol:s::hash:h2"}
    rows = [(1, 0, k, "rag", "a", "s", None, h, 0.5, False, None) for k, h in enumerate([None, "h2", "h3"])]
    assert set(merged(spark, rows)) == {"a::symbol:s"}


def test_rank_needs_a_positive_k(spark):
    with pytest.raises(ValueError):
        retrieve.rank(spark.createDataFrame([], "query_id long, final_score double, path string, dedup_key string"), 0)


def test_providers_fail_alone_but_not_all_together(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    good = lambda df: df.selectExpr("query_id", "'rag' AS source")
    bad = lambda df: df.select("no_such_column")
    got, rows = retrieve.ask(q, {"rag": good, "terms": bad, "graph": None})
    status = {r[0]: r[1:3] for r in rows}
    assert got.count() == 1 and status == {"rag": ("success", 1), "graph": ("disabled", 0), "terms": ("error", 0)}
    with pytest.raises(RuntimeError):
        retrieve.ask(q, {"terms": bad})


def test_graph_stops_after_two_steps_and_twenty_nodes(spark):
    nodes = spark.createDataFrame([(f"n{i}", "k", f"n{i}", "p", None) for i in range(40)], "id string, kind string, name string, path string, container string")
    edges = [("n0", f"n{i}", "contains") for i in range(1, 30)] + [("n1", "n35", "contains"), ("n35", "n36", "contains")]
    e = spark.createDataFrame(edges, "src string, dst string, kind string")
    s = spark.createDataFrame([(1, "n0")], "query_id long, id string")
    assert retrieve.neighbours(s, nodes, e, depth=9, most=100).where("id = 'n35'").count() == 1
    assert retrieve.neighbours(s, nodes, e, depth=9, most=100).where("id = 'n36'").count() == 0
    assert retrieve.neighbours(s, nodes, e, depth=2).count() == 20


def test_knn_blocks_agree_with_one_block(spark, monkeypatch):
    r = random.Random(1)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(6)], i % 5) for i in range(300)], "id long, v array<double>, f long")
    q = v.where("id % 20 = 0")
    one = sorted(map(tuple, knn.top_k(q, v, 4).collect()))
    groups = sorted(map(tuple, knn.best_by_group(q, v, "f").collect()))
    monkeypatch.setattr(knn, "BLOCK", 17)
    assert sorted(map(tuple, knn.top_k(q, v, 4).collect())) == one
    assert sorted(map(tuple, knn.best_by_group(q, v, "f").collect())) == groups
    assert all(row[3] == 1 or row[2] <= 1 for row in one) and len(one) == 15 * 4


def test_vector_arithmetic(spark):
    df = spark.sql("SELECT array(1.0D, 2.0D) AS a, array(3.0D, -1.0D) AS b")
    got = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.squared_distance(F.col("a"), F.col("b")), vectors.norm(F.col("a")), F.round(vectors.cosine(F.col("a"), F.col("b")), 6)).first()
    assert tuple(got) == (1.0, 13.0, 5**0.5, 0.141421)


def test_decision_state_by_time_then_arrival(spark):
    d = spark.createDataFrame([(1, "verified", None, 5), (1, "stale", None, 7), (1, "rejected", "2026-01-01 00:00:00", 1), (2, "verified", None, 1), (2, "revoked", None, 2)], "mapping_id long, decision string, created_at string, seq long")
    d = d.selectExpr("mapping_id", "decision", "'other' AS reason_code", "CAST(created_at AS TIMESTAMP) AS created_at", "seq")
    assert {r.mapping_id: r.state for r in events.state(d).collect()} == {1: "rejected", 2: "revoked"}


def test_backfill_is_idempotent(spark):
    d = spark.createDataFrame([], "mapping_id long, decision string, reason_code string, reason_text string, actor string, created_at timestamp, seq long")
    m = spark.createDataFrame([(1, True), (2, False)], "mapping_id long, verified boolean")
    once = events.backfill(m, d)
    assert once.count() == 1 and events.backfill(m, once).count() == 1
    assert events.contexts(once).first().legacy


def test_automaton_agrees_with_search(spark, monkeypatch):
    r = random.Random(3)
    terms = sorted({"".join(r.choice("ab ") for _ in range(r.randint(1, 5))) for _ in range(60)} - {""})
    texts = [(i, "".join(r.choice("ab c") for _ in range(60))) for i in range(40)] + [(99, None), (98, "")]
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    d = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((i, x) for i, s in texts for x in terms if s and x in s)
    assert sorted(map(tuple, index.contained(d, t, "doc_id").collect())) == want
    monkeypatch.setattr(index, "PART_LETTERS", 40)
    assert sorted(map(tuple, index.contained(d, t, "doc_id").collect())) == want


def test_constants_on_lines(spark):
    text = "limit 150000L; v1.0 x12345\n\nrate=0.15,0.15 and 1_000_000 in 2024\nworks 52 hours, 9 times"
    got = [(r.value_key, r.line_no) for r in index.constants(spark.createDataFrame([("p", text)], "path string, text string")).collect()]
    assert sorted(got) == [("0.15", 3), ("1000000", 3), ("150000", 1), ("52", 4), ("9", 4)]


def test_chunks_of_source_kinds():
    assert chunk.chunks_of("x.java", "no methods") == ["no methods"]
    java = "class A { public void a() { if (x) { y(); } } int z; public int b() { return 1; } }"
    assert chunk.chunks_of("x.java", java) == ["public void a() { if (x) { y(); } }", "public int b() { return 1; }"]
    assert chunk.chunks_of("x.kt", "fun a() = 1\nfun b() { c() }") == ["fun a() = 1", "fun b() { c() }"]
    assert chunk.chunks_of("x.xfdl", "<a/>") == ["<a/>"]


def test_paragraphs_agree_with_a_loop(spark):
    def slow(text):
        out, buf = [], ""
        for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
            if len(buf) + 2 * bool(buf) + len(p) <= 900:
                buf = f"{buf}\n\n{p}" if buf else p
                continue
            out += [buf] * bool(buf)
            while len(p) > 900:
                out.append(p[:900])
                p = p[900:]
            buf = p
        return [c for c in out + [buf] if len(c) >= 40]

    r = random.Random(5)
    docs = [(i, "\n\n".join("x" * r.choice([1, 30, 39, 40, 400, 898, 899, 900, 901, 1800, 1801, 2500]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    got = {}
    for row in chunk.paragraphs(spark.createDataFrame(docs, "path long, text string")).orderBy("path", "chunk").collect():
        got.setdefault(row.path, []).append(row.text)
    assert got == {i: slow(t) for i, t in docs if slow(t)}


def test_broken_source_raises_and_braces_in_texts_do_not_count():
    with pytest.raises(ValueError):
        symbols.java_nodes("A.java", "class A { void f() { }")
    nodes = symbols.java_nodes("src/A.java", 'package p; class A { String s = "}{"; /* } */ void f() { new Runnable() { public void run() { } }; } static final int[] K = {1}; }')
    assert [n["id"] for n in nodes] == ["java:p.A", "java:p.A#f", "const:p.A.K"]


def test_collect_twice_adds_nothing(spark):
    items = spark.createDataFrame([("a", "20260101", 2), ("a", "20260101", 1), ("b", "20260102", 3)], "law_id string, promulgation_date string, ord long")
    new = collect.only_new(items, items.limit(0), ["law_id", "promulgation_date"])
    assert sorted((r.law_id, r.ord) for r in new.collect()) == [("a", 1), ("b", 3)]
    assert collect.only_new(items, new, ["law_id", "promulgation_date"]).count() == 0


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "prediction string, label string, confidence double")
    assert evaluate.macro_f1(none).first()[0] == 0.0 and tuple(evaluate.confidence_rates(none).first()) == (0.0, 0.0, 0.0)
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "case_id long, path string, rank int")
    r = evaluate.retrieval(ranked, spark.createDataFrame([(1, "b"), (1, "b"), (2, "x")], "case_id long, path string"), (1, 5)).orderBy("case_id").collect()
    assert (r[0].hit_1, r[0].recall_5, r[0].reciprocal_rank, r[0].precision_5) == (0, 0.5, 0.5, 0.5)
    assert (r[1].hit_5, r[1].recall_5, r[1].reciprocal_rank) == (0, 0.0, 0.0)


def test_diff_similarity_and_keys(spark):
    df = spark.createDataFrame([("a\n b ", "a\nb"), ("a", None), ("x\ny", "x\nz")], "a string, b string")
    assert [r[0] for r in df.select(replay.diff_similarity("a", "b")).collect()] == [1.0, 0.0, 0.5]
    g = spark.createDataFrame([(1, "./p", "a  b", "c")], "case_id long, path string, before string, after string")
    assert {r.key for r in replay.generated_keys(g).collect()} == {"p\0a  b\0c", "p\0a b\0c"}


def test_redaction_of_nested_values():
    got = T.redact_value({"Token": "x", "a": ["password: hunter2, ok", {"api_key": 1}], "n": 3})
    assert got == {"Token": "[REDACTED]", "a": ["password=[REDACTED], ok", {"api_key": "[REDACTED]"}], "n": 3}


def test_amendment_parser_limits():
    assert changes.edits_of("") == [] and changes.edits_of(None) == []
    long = "가" * 200_000 + "제1조를 삭제한다"
    assert [e["article_ref"] for e in changes.edits_of(long)] == ["제1조"] and changes.edits_of(long, 20_000) == []
    assert [(e["article_ref"], e["kind"]) for e in changes.edits_of("제3조 중 가를 나. 제4조를 삭제한다. 같은 항을 다음과  같이 신설한다")] == [("제4조", "delete"), ("제4조", "insert")]
    assert changes.edits_of("제1조 중 " + "가를 나 " * 50_000) == []


def test_source_tree(spark, tmp_path):
    for name, body in {"src/A.java": "클래스".encode("cp949"), "src/b.sql": b"\xef\xbb\xbfselect 1", "target/C.java": b"x", "notes.md": b"x", "src/bad.xml": b"\xff\xfe\xff"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body)
    got = {r.path: r.text for r in source_files.texts(source_files.listing(spark, str(tmp_path))).collect()}
    assert set(got) == {"src/A.java", "src/b.sql", "src/bad.xml"}
    assert got["src/A.java"] == "클래스" and got["src/b.sql"] == "select 1"
    f = source_files.listing(spark, str(tmp_path))
    m = f.selectExpr("path", "sha2(content, 256) AS sha256", "length AS size")
    m = m.unionByName(spark.createDataFrame([("gone", "0", 1)], "path string, sha256 string, size long")).selectExpr("path", "IF(path = 'src/b.sql', '0', sha256) AS sha256", "size")
    assert {r.path: r.status for r in source_files.verify(m, f).collect()} == {"src/A.java": "ok", "src/b.sql": "changed", "src/bad.xml": "ok", "gone": "missing"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    sinks.by_source(df, f"{tmp_path}/t")
    sinks.by_source(spark.createDataFrame([("a", 9)], "source string, n int"), f"{tmp_path}/t")
    assert sorted((r.source, r.n) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 9), ("b", 2)]
    ev = spark.sql("SELECT TIMESTAMP'2026-01-02 03:04:05' AS occurred_at, 2 AS ord UNION ALL SELECT TIMESTAMP'2026-01-02 03:04:05', 1")
    assert sorted(r.event_id for r in sinks.event_ids(ev).collect()) == ["F-20260102-0001", "F-20260102-0002"]
    art = spark.createDataFrame([("metadata_only", "diff_body", "secret"), ("metadata_only", "metric", "1")], "privacy_mode string, artifact_kind string, body string")
    man = sinks.report(df, art, f"{tmp_path}/r")
    assert man.count() >= 2 and spark.read.json(f"{tmp_path}/r/artifacts").count() == 1


def test_collection_stream(spark, tmp_path):
    land, table, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    row = lambda i, d, o: (i, "n", d, d, "law", "tax", o)
    spark.createDataFrame([row("a", "20260101", 1), row("a", "20260101", 2)], collect_stream.ITEMS).write.json(land)
    collect_stream.collect(spark, land, table, mark).awaitTermination()
    spark.createDataFrame([row("a", "20260101", 3), row("b", "20260102", 4)], collect_stream.ITEMS).write.mode("append").json(land)
    collect_stream.collect(spark, land, table, mark).awaitTermination()
    got = spark.read.parquet(table)
    assert sorted((r.law_id, r.ord) for r in got.collect()) == [("a", 1), ("b", 4)]
    assert collect_stream.high_water(got, "x").first()[0] == "20260102"
