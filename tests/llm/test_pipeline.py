"""The pipeline against its stages done one by one in plain Python."""

import re

import pytest

import corpus_pipeline
from changelens.llm import packing, pii, queries, simhash, toxicity
from tests.llm.test_dedup import slow_components, slow_print
from tests.llm.test_similar import brute, roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few documents of every kind, with odd rows."""
    r = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(f"ba ko li ne {i} su ta re mi fa so la {i % 3}. " * 3 for i in range(30))]
        + [(100, None, None, None, None), (101, "", "", "", 0), (102, "zwack ko. Li ne", "en", "s", 15), (103, "zwack li. Su", "en", "s", 1)]
        + [(200 + i, "same  text\nhere again", "en", "hot", 20) for i in range(15)]
        + [(300, "mail me@host.example.org or +1 (829) 555-7292", "en", "s", 44)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(102, 1, 1), (103, 1, 1)], "doc_id long, quality int, toxic int")
    d = tmp_path_factory.mktemp("sf")
    r.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return str(d), r


def test_stages_take_effect(spark, small):
    d, docs = small
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{d}/labels.parquet")).collect() if r.predicted}
    rows = {i: t for i, t in rows.items() if i not in bad}
    seen = {}
    for i in sorted(rows):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    rows = {i: rows[i] for i in seen.values()}
    ids = list(rows)
    close = slow_components(ids, [slow_print(rows[i]) for i in ids])
    low = roots(ids, brute(list(rows.items())) | set(zip(close, ids)))
    kept = {i for i in ids if low[i] == i}
    rows = {i: t for i, t in rows.items() if i in kept}
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        at = stage(spark, at, d)
        assert at.columns == columns, name
        at.write.mode("overwrite").parquet(f"{d}/stage{k}")
        at = spark.read.parquet(f"{d}/stage{k}")
    got = {r.doc_id: r for r in at.collect()}
    assert set(got) == set(rows)
    assert got[300].text == "mail <EMAIL> or <PHONE>" and got[300].n_chars == len(got[300].text)
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(rows)
    t = packing.tokens(*packing.default_paths())
    want = sorted((i, len(t.whole.encode(r.text or "", add_special_tokens=False).ids) + 1) for i, r in got.items())
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert sorted(total.items()) == want


def test_names_and_schemas(spark):
    q = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in q) == list(range(1, 11))
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    want = {
        "op1": "doc_id bigint, held_out boolean, score double, predicted int, sentences array<struct<start:bigint,end:bigint,score:double>>",
        "op4": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op5": "doc_id bigint, fingerprint string, component_id bigint",
        "op6": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
        "op7": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op9": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    }
    for k, f in q.items():
        df = f(spark, SF)
        if k.split("_")[0] in want:
            assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == want[k.split("_")[0]]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fingerprint_digits(spark):
    rows = queries.op5_simhash(spark, SF).limit(20).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r.fingerprint == f"{simhash.fingerprint(text[r.doc_id]):016x}"


def test_pii_kinds_are_listed():
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_queries_equal_their_sql(spark):
    from tests.oracle import compare, connect

    con = connect(SF)
    for name, sql in queries.oracle_sql().items():
        assert compare(queries.queries()[name](spark, SF), con, sql) is None, name
