"""Operators on texts, sources and cases that are made of whole tables, so that SQL can say what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import text as T
from changelens.functions import values as V
from changelens.operators import changes, chunk, evaluate, index, listings, providers, replay, retrieve, symbols
from changelens.plans.catalogue import query, table
from changelens.plans.retrieval_queries import _CTE, candidates
from changelens.sources import feeds


def s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# --------------------------------------------------------------------------- legal texts made of orders and lines
_L = "l_orderkey * 10 + l_linenumber AS id, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS won, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t, l_partkey % 28 + 1 AS day, l_suppkey % 12 + 1 AS month, l_partkey % 900 + 2 AS hours"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "l_linenumber AS n", "CAST(l_quantity AS BIGINT) AS q", "CAST(round(l_extendedprice) AS BIGINT) AS won", "CAST(round(l_discount * 100) AS BIGINT) AS d", "CAST(round(l_tax * 100) AS BIGINT) AS t", "l_partkey % 28 + 1 AS day", "l_suppkey % 12 + 1 AS month", "l_partkey % 900 + 2 AS hours")


def _say(*parts) -> F.Column:
    return F.concat(*[F.lit(p[1:]) if p.startswith("'") else s(p) for p in parts])


_NUM = "CASE WHEN {0} = 0 THEN '0' ELSE rtrim(rtrim(printf('%.6f', {0} / 100.0), '0'), '.') END"


@query(f"""WITH x AS (SELECT {_L} FROM lineitem)
SELECT id, concat_ws(',', CAST(q * 10000 AS VARCHAR), CAST(won AS VARCHAR), CAST(q * 100000000 + n * 10000000 AS VARCHAR)) AS money, concat_ws(',', {_NUM.format('d')}, {_NUM.format('t')}) AS rate,
  CASE WHEN hours <= 999 THEN CAST(hours AS VARCHAR) ELSE '' END AS duration, concat('2024-', lpad(CAST(month AS VARCHAR), 2, '0'), '-', lpad(CAST(day AS VARCHAR), 2, '0')) AS date, CAST(10 + day AS VARCHAR) AS age FROM x""")
def typed_line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, rates, durations, dates and ages in a text made of every order line."""
    text = _say("q", "'만원과 ", "won", "'원, ", "q", "'억 ", "n", "'천만원의 ", "d", "'%에서 100분의 ", "t", "'까지 주 ", "hours", "'시간, 2024년 ", "month", "'월 ", "day", "'일부터 만 ")
    x = _lines(spark, sf_dir).withColumn("t_", F.concat(text, s(F.col("day") + 10), F.lit("세")))
    return x.select("id", *[F.array_join(V.said(F.col("t_"), k), ",").alias(k) for k in ("money", "rate", "duration", "date", "age")])


_PAIR = f"""WITH x AS (SELECT {_L} FROM lineitem), p AS (SELECT id, n, q, d, t, day, CASE n WHEN 1 THEN concat('연 ', q, '만원') WHEN 2 THEN concat(d, '%') WHEN 3 THEN concat('2024년 ', month, '월 1일') WHEN 4 THEN '같은 문구' WHEN 5 THEN concat('제', q, '조') WHEN 6 THEN concat(q, '만원') ELSE concat(q + 1, '개월') END AS before_text,
  CASE n WHEN 1 THEN concat('연 ', q + day, '만원') WHEN 2 THEN concat(t, '%') WHEN 3 THEN concat('2025년 ', month, '월 1일') WHEN 4 THEN '같은 문구' WHEN 5 THEN concat('제', q, '조를 신설한다') WHEN 6 THEN concat(q + day, '만원 이상') ELSE concat(q + 2, '개월') END AS after_text FROM x)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    pick = lambda *c: F.when(n == 1, c[0]).when(n == 2, c[1]).when(n == 3, c[2]).when(n == 4, c[3]).when(n == 5, c[4]).when(n == 6, c[5]).otherwise(c[6])
    more = _lines(spark, sf_dir).withColumns({"q1": F.col("q") + 1, "q2": F.col("q") + 2, "qd": F.col("q") + F.col("day")})
    return more.select(
        F.col("id").alias("change_id"), "n",
        pick(_say("'연 ", "q", "'만원"), _say("d", "'%"), _say("'2024년 ", "month", "'월 1일"), F.lit("같은 문구"), _say("'제", "q", "'조"), _say("q", "'만원"), _say("q1", "'개월")).alias("before_text"),
        pick(_say("'연 ", "qd", "'만원"), _say("t", "'%"), _say("'2025년 ", "month", "'월 1일"), F.lit("같은 문구"), _say("'제", "q", "'조를 신설한다"), _say("qd", "'만원 이상"), _say("q2", "'개월")).alias("after_text"),
    )


@query(_PAIR + """ SELECT id AS change_id, CASE WHEN before_text = after_text THEN 'no_code_impact' WHEN n = 5 THEN 'structural_change' WHEN n = 6 THEN 'condition_change' WHEN n = 2 THEN 'rate_change' WHEN n = 3 THEN 'date_change' WHEN n IN (1, 7) AND (n = 1 OR q + 2 <= 99) THEN 'value_change' ELSE 'unknown' END AS primary_type,
  CASE WHEN before_text = after_text THEN 0.99 WHEN n = 5 THEN 0.72 WHEN n = 6 THEN 0.78 WHEN n = 2 THEN 0.96 WHEN n = 3 THEN 0.95 WHEN n = 1 THEN 0.96 WHEN n = 7 AND q + 2 <= 99 THEN 0.88 ELSE 0.2 END AS confidence, n IN (5, 6) AND before_text <> after_text AS ambiguous FROM p""")
def classified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of texts made of every order line, classified by rules."""
    c = changes.classify(changes.normalise(_pairs(spark, sf_dir)))
    return c.select("change_id", "rule.primary_type", F.col("rule.confidence").cast("double").alias("confidence"), "rule.ambiguous")


@query(_PAIR + """, v AS (SELECT id, CASE n WHEN 2 THEN concat(CASE WHEN d = 0 THEN '0' ELSE rtrim(rtrim(printf('%.6f', d / 100.0), '0'), '.') END, '>', CASE WHEN t = 0 THEN '0' ELSE rtrim(rtrim(printf('%.6f', t / 100.0), '0'), '.') END)
  WHEN 3 THEN regexp_replace(before_text || '>' || after_text, '(\\d+)년 (\\d+)월 1일>(\\d+)년 (\\d+)월 1일', '\\1') WHEN 1 THEN concat(q * 10000, '>', (q + day) * 10000) WHEN 6 THEN concat(q * 10000, '>', (q + day) * 10000) WHEN 7 THEN concat(q + 1, '>', q + 2) END AS delta, n, before_text, after_text FROM p)
SELECT id AS change_id, CASE WHEN n = 3 THEN concat('2024-', lpad(regexp_extract(before_text, '년 (\\d+)월', 1), 2, '0'), '-01>2025-', lpad(regexp_extract(before_text, '년 (\\d+)월', 1), 2, '0'), '-01') ELSE delta END AS delta FROM v WHERE delta IS NOT NULL AND before_text <> after_text""")
def line_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that differs in each pair."""
    n = changes.normalise(_pairs(spark, sf_dir)).withColumn("x", changes.first_delta(None)).where("x IS NOT NULL")
    return n.select("change_id", F.concat("x.before.value", F.lit(">"), "x.after.value").alias("delta"))


@query(_PAIR + """, w AS (SELECT id, string_split(before_text, ' ') AS b, string_split(after_text, ' ') AS a FROM p)
SELECT id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS added, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS removed FROM w""")
def line_text_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a pair of texts adds and removes."""
    d = _pairs(spark, sf_dir).select(F.col("change_id").alias("id"), changes.text_delta("before_text", "after_text").alias("d"))
    return d.select("id", F.array_join("d.added", ",").alias("added"), F.array_join("d.removed", ",").alias("removed"))


@query(f"""WITH x AS (SELECT {_L} FROM lineitem) SELECT id, 0 AS pos, concat('제', q, '조의', n, '제', day, '항') AS article_ref, 'replace' AS kind, concat(won, '원') AS before_fragment, concat(won + 1, '원') AS after_fragment FROM x
UNION ALL SELECT id, 1, concat('제', q, '조의', n, '제', month, '항'), 'delete', '', '' FROM x UNION ALL SELECT id, 2, concat('제', day, '조'), CASE WHEN n % 2 = 0 THEN 'rewrite' ELSE 'insert' END, '', concat('본문 ', hours) FROM x""")
def amended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of an amendment made of every order line."""
    x = _lines(spark, sf_dir).withColumn("more", F.col("won") + 1)
    text = F.concat(
        _say("'제", "q", "'조의", "n", "'제", "day", '\'항 중 "', "won", '\'원"을 "', "more", '\'원"으로 하고, 같은 조 제', "month", "'항을 삭제한다. 제", "day"),
        F.when(F.col("n") % 2 == 0, "조를 다음과 같이 한다.\n본문 ").otherwise("조를 다음과 같이 신설한다.\n본문 "), s("hours"),
    )
    e = x.select("id", changes.parse_amendment(text).alias("e"))
    return e.select("id", F.posexplode("e").alias("pos", "x")).select("id", "pos", "x.*")


# --------------------------------------------------------------------------- details and listings
_LINES_OF = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"


@query(f"SELECT doc_id, array_to_string({_LINES_OF}, chr(10)) AS amendment_text, array_to_string({_LINES_OF}[:1], chr(10)) AS reason_text, '' AS before_text, array_to_string({_LINES_OF}, chr(10)) AS after_text, false AS amendment_parsed FROM documents")
def law_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendment and reason of landed details, whose lists may be nested."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    nested = F.col("doc_id") % 2 == 0
    part = lambda a, b, v: F.concat(F.lit(f'"{a}":{{"{b}":'), F.when(nested, F.concat(F.lit("["), F.to_json(v), F.lit("]"))).otherwise(F.to_json(v)), F.lit("}"))
    first = F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, 1)
    body = F.concat(F.lit('{"법령":{'), part("개정문", "개정문내용", lines), F.lit(","), part("제개정이유", "제개정이유내용", first), F.lit("}}"))
    d = feeds.law_details(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")))
    return d.select("doc_id", "amendment_text", "reason_text", "before_text", "after_text", "amendment_parsed")


_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""SELECT page_id, CASE WHEN length(u) < 50 THEN trim(u || chr(10) || chr(10) || coalesce(html, ''), {_STRIP}) ELSE u END AS after_text FROM (SELECT page_id, html, trim(coalesce(url, '')) AS u FROM pages)""")
def rule_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of landed rules; a short one is followed by its attachment's."""
    body = F.to_json(F.struct(F.struct(F.trim(F.coalesce("url", F.lit(""))).alias("조문내용"), F.lit("x").alias("규칙명")).alias("AdmRulService")))
    return feeds.rule_details(table(spark, sf_dir, "pages").select("page_id", body.alias("body"), F.col("html").alias("attachment"))).select("page_id", "after_text")


_CHANGES = "o_orderkey AS id, concat('법 ', o_custkey, CASE o_orderkey % 3 WHEN 0 THEN ' 시행령' WHEN 1 THEN ' 시행규칙' ELSE '' END) AS law_name, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'hr' ELSE 'tax' END AS domain, CASE WHEN o_orderkey % 11 = 0 THEN '고시' ELSE 'law' END AS source"


@query(f"""WITH c AS (SELECT {_CHANGES} FROM orders) SELECT id, law_name, domain, CASE WHEN source <> 'law' THEN source WHEN law_name LIKE '%시행규칙' THEN '시행규칙' WHEN law_name LIKE '%시행령' THEN '시행령' ELSE '법률' END AS tier FROM c WHERE domain = 'hr'""")
def changes_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one domain, newest first, with their tier."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat('법 ', o_custkey, CASE o_orderkey % 3 WHEN 0 THEN ' 시행령' WHEN 1 THEN ' 시행규칙' ELSE '' END) AS law_name", "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'hr' ELSE 'tax' END AS domain", "CASE WHEN o_orderkey % 11 = 0 THEN '고시' ELSE 'law' END AS source", "date_format(o_orderdate, 'yyyyMMdd') AS promulgation_date")
    return listings.changes(o, "hr").select("id", "law_name", "domain", "tier")


@query("SELECT doc_id AS case_id FROM documents WHERE lang = 'de' OR source = 'src1'")
def cases_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with one of some tags."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.array(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("tags"))
    return listings.cases(d, tags=["de", "src1"]).select("case_id")


@query("""SELECT l_orderkey AS change_id, l_linenumber AS id, l_quantity > 25 AS verified, l_discount AS confidence, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity > 25 DESC, l_discount DESC, l_linenumber) AS INTEGER) AS place
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def mappings_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of each change's article, verified ones first."""
    ch = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), F.lit("L").alias("law_id"), s("o_orderkey").alias("article_no"))
    m = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("L:"), s("l_orderkey")).alias("article_id"), F.col("l_linenumber").alias("id"), s("l_partkey").alias("path"), F.lit("").alias("symbol"), F.col("l_discount").alias("confidence"), (F.col("l_quantity") > 25).alias("verified"))
    return listings.mappings(ch, m).select("change_id", "id", "verified", "confidence", "place")


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("proposal_id"), F.col("o_custkey").alias("law_change_id"), F.col("o_orderstatus").alias("approval_status"), F.lit("passed").alias("golden_status"), F.lit("m").alias("model_used"), F.col("o_orderpriority").alias("diff"), F.lit("ok").alias("golden_output"))


@query("SELECT o_orderkey AS proposal_id, o_custkey AS law_change_id, o_orderstatus AS approval_status, 'passed' AS golden_status, 'm' AS model_used, false AS content_exposed FROM orders")
def drafts_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts without what they hold."""
    return listings.drafts(_proposals(spark, sf_dir), False)


@query("SELECT o_orderkey AS proposal_id, o_custkey AS law_change_id, o_orderstatus AS approval_status, 'passed' AS golden_status, 'm' AS model_used, true AS content_exposed, o_orderpriority AS diff, 'ok' AS golden_output FROM orders")
def drafts_exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.drafts(_proposals(spark, sf_dir), True)


@query("SELECT doc_id, concat('sha256:', sha256(coalesce(text, ''))) AS query_hash, CASE WHEN coalesce(source, '') <> '' AND coalesce(lang, '') <> '' THEN substr(sha256(concat(source, chr(0), lang, chr(0), doc_id, chr(0), 'v1')), 1, 16) END AS index_key FROM documents")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of queries and of indexes."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", listings.query_hash(F.coalesce("text", F.lit(""))).alias("query_hash"), listings.index_key(F.col("source"), F.col("lang"), s("doc_id"), F.lit("v1")).alias("index_key"))


@query("SELECT page_id, CASE WHEN contains(url, '/de/') THEN 0 WHEN contains(url, '/en/') OR contains(url, 'm.') THEN 1 ELSE 2 END AS rank FROM pages WHERE url IS NOT NULL")
def work_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are worked on first."""
    p = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", "url")
    return listings.work_order(p, [["/de/"], ["/en/", "m."]], "url").select("page_id", "rank")


# --------------------------------------------------------------------------- evidence
_SHOWN = _CTE.replace("round(l_discount * 10, 3) AS normalized_score", "round(l_discount * 10, 3) AS normalized_score, l_extendedprice AS raw_score")


@query(_SHOWN + """, b AS (SELECT query_id, dedup_key, normalized_score, raw_score AS score, cand_idx AS term FROM c WHERE source = 'rag' QUALIFY row_number() OVER (PARTITION BY query_id, dedup_key ORDER BY normalized_score DESC, provider_idx, cand_idx, raw_score DESC) = 1)
SELECT b.query_id, path, symbol, score, normalized_score, CAST(term AS VARCHAR) AS term FROM b JOIN g USING (query_id, dedup_key)""")
def evidence_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one source has to show for every merged place."""
    c = candidates(spark, sf_dir, "l_extendedprice AS raw_score").withColumn("matched_terms", F.array(s("cand_idx"))).withColumn("matched_values", F.array().cast("array<string>"))
    shown = retrieve.shown_by(retrieve.merge(c, evidence=True), "rag")
    return shown.select("query_id", "path", "symbol", "score", "normalized_score", F.col("matched_terms")[0].alias("term"))


@query(_CTE + "SELECT query_id, base_key, count(DISTINCT content_hash) AS hashes FROM c WHERE dedup_key <> base_key GROUP BY ALL")
def place_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose candidates disagree about their content."""
    return retrieve.hash_conflicts(candidates(spark, sf_dir))


# --------------------------------------------------------------------------- sources made of suppliers, customers and parts
def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each nation with a method for each of its suppliers and a constant; a mapper for each region with a
    statement for each nation, which the nation's class calls; a test for each nation."""
    sup, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    methods = sup.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  public int get"), s("s_suppkey"), F.lit("(int x) { if (x > 0) { return x; } return K1; }")))), "\n").alias("body"))
    nat = n.join(methods, n.n_nationkey == methods.s_nationkey, "left").select("n_nationkey", "n_regionkey", F.coalesce("body", F.lit("")).alias("body"))
    k, reg = s("n_nationkey"), s("n_regionkey")
    java = nat.select(F.concat(F.lit("src/N"), k, F.lit(".java")).alias("path"), F.concat(F.lit("package geo;\n// class Old { }\npublic class N"), k, F.lit(" {\n  static final int LIMIT_"), k, F.lit(" = 1;\n  private R"), reg, F.lit("Mapper r"), reg, F.lit("Mapper;\n  void load() { r"), reg, F.lit("Mapper.pick"), k, F.lit("(); }\n"), "body", F.lit("\n}\n")).alias("text"))
    xml = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<select id='pick"), s("n_nationkey"), F.lit("' x=\"1\">select 1</select>")))), "\n").alias("body")).select(F.concat(F.lit("map/R"), s("n_regionkey"), F.lit(".xml")).alias("path"), F.concat(F.lit('<mapper namespace="geo.R'), s("n_regionkey"), F.lit('Mapper">'), "body", F.lit("<!-- <select id='no'/> --></mapper>")).alias("text"))
    test = n.select(F.concat(F.lit("test/N"), s("n_nationkey"), F.lit("Test.java")).alias("path"), F.concat(F.lit("class N"), s("n_nationkey"), F.lit("Test { @Test void works() { new N"), s("n_nationkey"), F.lit("().load(); } }")).alias("text"))
    sql = r.select(F.concat(F.lit("q"), s("r_regionkey"), F.lit(".sql")).alias("path"), F.concat(F.lit("-- x\nselect a from region_"), s("r_regionkey"), F.lit(";\ncreate table t"), s("r_regionkey"), F.lit(" (a int)")).alias("text"))
    return java.unionByName(xml).unionByName(test).unionByName(sql)


_NODES_SQL = """SELECT concat('java:geo.N', n_nationkey) AS id, 'java_class' AS kind, 'geo' AS container FROM nation UNION ALL SELECT concat('const:geo.N', n_nationkey, '.LIMIT_', n_nationkey), 'constant', concat('geo.N', n_nationkey) FROM nation
UNION ALL SELECT concat('java:geo.N', n_nationkey, '#load'), 'java_method', concat('geo.N', n_nationkey) FROM nation UNION ALL SELECT concat('java:geo.N', s_nationkey, '#get', s_suppkey), 'java_method', concat('geo.N', s_nationkey) FROM supplier
UNION ALL SELECT concat('mybatis:geo.R', n_regionkey, 'Mapper.pick', n_nationkey), 'mybatis_statement', concat('geo.R', n_regionkey, 'Mapper') FROM nation UNION ALL SELECT concat('java:N', n_nationkey, 'Test'), 'java_class', NULL FROM nation
UNION ALL SELECT concat('test:N', n_nationkey, 'Test#works'), 'test_method', concat('N', n_nationkey, 'Test') FROM nation UNION ALL SELECT concat('sql:q', r_regionkey, '.sql#select:region_', r_regionkey), 'sql_statement', concat('region_', r_regionkey) FROM region
UNION ALL SELECT concat('sql:q', r_regionkey, '.sql#create_table:t', r_regionkey), 'sql_statement', concat('t', r_regionkey) FROM region"""


@query(_NODES_SQL)
def table_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a source tree made of nations, regions and suppliers."""
    return symbols.harvest(_tree(spark, sf_dir))[0].select("id", "kind", "container")


_EDGES_SQL = """SELECT concat('java:geo.N', n_nationkey) AS src, concat('java:geo.N', n_nationkey, '#load') AS dst, 'contains' AS kind FROM nation UNION ALL SELECT concat('java:geo.N', n_nationkey), concat('const:geo.N', n_nationkey, '.LIMIT_', n_nationkey), 'contains' FROM nation
UNION ALL SELECT concat('java:geo.N', s_nationkey), concat('java:geo.N', s_nationkey, '#get', s_suppkey), 'contains' FROM supplier UNION ALL SELECT concat('java:N', n_nationkey, 'Test'), concat('test:N', n_nationkey, 'Test#works'), 'contains' FROM nation
UNION ALL SELECT concat('java:geo.N', n_nationkey), concat('mybatis:geo.R', n_regionkey, 'Mapper.pick', n_nationkey), 'service_to_mapper' FROM nation
UNION ALL SELECT concat('test:N', n_nationkey, 'Test#works'), concat('java:geo.N', n_nationkey), 'test_to_service' FROM nation UNION ALL SELECT concat('test:N', n_nationkey, 'Test#works'), concat('java:geo.N', n_nationkey, '#load'), 'test_to_service' FROM nation"""


@query(_EDGES_SQL)
def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the symbols of that tree."""
    f = _tree(spark, sf_dir)
    return symbols.link(symbols.harvest(f)[0], f)


@query("""SELECT concat('src/N', s_nationkey, '.java') AS path, concat('public int get', s_suppkey, '(int x) { if (x > 0) { return x; } return K1; }') AS text, concat('get', s_suppkey) AS symbol FROM supplier
UNION ALL SELECT concat('q', r_regionkey, '.sql'), concat('-- x', chr(10), 'select a from region_', r_regionkey), '' FROM region UNION ALL SELECT concat('q', r_regionkey, '.sql'), concat('create table t', r_regionkey, ' (a int)'), concat('t', r_regionkey) FROM region
UNION ALL SELECT concat('map/R', n_regionkey, '.xml'), concat('[select id=pick', n_nationkey, ']', chr(10), '<select id=''pick', n_nationkey, ''' x="1">select 1</select>'), '' FROM nation
UNION ALL SELECT concat('test/N', n_nationkey, 'Test.java'), concat('class N', n_nationkey, 'Test { @Test void works() { new N', n_nationkey, '().load(); } }'), 'works' FROM nation""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of that tree, and the symbol that each declares."""
    f = _tree(spark, sf_dir).where("NOT startswith(path, 'src/') OR contains(text, 'public int get')")
    return chunk.source_chunks(f).select("path", "text", chunk.symbol(F.col("path"), F.col("text")).alias("symbol"))


_CODED = "c_custkey, concat('a', lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0')) AS code, CASE c_custkey % 3 WHEN 0 THEN '자녀세액공제 금액' WHEN 1 THEN '월세 공제액' ELSE '기부금 한도액' END AS label"


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration with a comment for each customer."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('a', lpad(CAST(c_custkey % 1000 AS STRING), 4, '0')) AS code", "CASE c_custkey % 3 WHEN 0 THEN '자녀세액공제 금액' WHEN 1 THEN '월세 공제액' ELSE '기부금 한도액' END AS label")
    return c.select(F.concat(F.lit("vo/C"), F.lpad(s("c_custkey"), 9, "0"), F.lit(".java")).alias("path"), F.concat(F.lit("class C {\n  private Long "), "code", F.lit("; // "), "label", F.lit("\n}")).alias("text"))


@query(f"""WITH x AS (SELECT {_CODED} FROM customer), g AS (SELECT code, label, count(*) AS n, min(c_custkey) AS f FROM x GROUP BY ALL) SELECT code, string_agg(label, '|' ORDER BY n DESC, f) AS labels FROM g GROUP BY code""")
def table_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of codes, commonest first, from a source file for each customer."""
    got = index.labels(index.harvest_terms(_coded(spark, sf_dir)))
    return got.select("code", F.array_join("labels", "|").alias("labels"))


@query(f"""WITH x AS (SELECT {_CODED} FROM customer), r AS (SELECT code, concat('vo/C', lpad(CAST(c_custkey AS VARCHAR), 9, '0'), '.java') AS path, CAST(row_number() OVER (PARTITION BY code ORDER BY c_custkey) AS INTEGER) AS ord FROM x) SELECT * FROM r WHERE ord <= 12""")
def table_code_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in which a code stands."""
    return index.code_places(_coded(spark, sf_dir))


@query("""WITH t AS (SELECT DISTINCT p_brand AS term FROM part), p AS (SELECT p_partkey AS id, concat(p_name, ' ', p_brand, ' ', p_type) AS text FROM part) SELECT id, term FROM p JOIN t ON contains(text, term)""")
def parts_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that the text of a part holds."""
    p = table(spark, sf_dir, "part")
    texts = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return index.contained(texts, p.select(F.col("p_brand").alias("term")).distinct(), "id")


# --------------------------------------------------------------------------- replays made of orders
_RUN = "o_orderkey AS case_id, CASE WHEN o_orderkey % 9 = 0 THEN 'TIMEOUT' END AS failure_kind, o_custkey % 10 <> 0 AS fixture_ok, CASE WHEN o_custkey % 4 = 0 THEN 0.5 ELSE 1.0 END AS replacement_rate, 1.0 AS file_coverage, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.0 END AS unnecessary_rate, 0.75 AS jaccard, CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS git_apply, CASE o_orderkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'skipped' ELSE NULL END AS golden_status"
_PASSED = "failure_kind IS NULL AND fixture_ok AND replacement_rate >= 1 AND coalesce(git_apply, true) AS passed"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changelens.plans.retrieval_queries import _split

    r = table(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _split(_RUN)])
    return r.withColumns({c: F.col(c).cast("double") for c in ("replacement_rate", "file_coverage", "unnecessary_rate", "jaccard")})


@query(f"SELECT case_id, {_PASSED} FROM (SELECT {_RUN} FROM orders)")
def replayed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each replay passed."""
    return evaluate.verdict(_runs(spark, sf_dir)).select("case_id", "passed")


@query(f"""WITH r AS (SELECT *, {_PASSED} FROM (SELECT {_RUN} FROM orders)) SELECT count(*) AS case_count, count(*) FILTER (passed) AS passed_count, round(avg(CAST(passed AS INTEGER)), 6) AS pass_rate, round(avg(replacement_rate), 6) AS replacement_rate, 1.0 AS file_coverage,
  round(avg(unnecessary_rate), 6) AS unnecessary_rate, 0.75 AS jaccard, count(*) FILTER (git_apply) AS git_apply_ok_count, count(*) FILTER (golden_status = 'passed') AS golden_passed_count FROM r""")
def replayed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All replays in one line."""
    return replay.summary(evaluate.verdict(_runs(spark, sf_dir)))


@query("""SELECT o_orderkey AS case_id, CASE WHEN o_custkey % 3 = 0 THEN 2 WHEN o_custkey % 3 = 1 THEN 1 END AS rank FROM orders""")
def answers_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of each case that is an answer, by path or by its own name."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 3).alias("k"))
    files = F.array(F.struct(F.lit("src\\a/One.java").alias("path"), F.lit(1).alias("rank")), F.struct(F.lit("b/Two.java").alias("path"), F.lit(2).alias("rank")))
    ranked = o.select("case_id", F.explode(files).alias("x")).select("case_id", "x.*")
    answers = o.select("case_id", F.when(F.col("k") == 0, "Two.java").when(F.col("k") == 1, "src/a/One.java").otherwise("None.java").alias("answer"))
    return providers.answer_rank(ranked, answers)


@query("""SELECT event_type AS status, count(*) AS cases, round(avg(value), 6) AS avg_latency, max(value) AS max_latency, count(*) FILTER (user_id % 10 = 0) AS failures, round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM events GROUP BY event_type""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of each status with their times, failures and metrics."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.col("value").alias("latency"), F.when(F.col("user_id") % 10 == 0, "E1").alias("error_code"), F.when(F.col("event_id") % 4 == 0, 1.0).otherwise(0.0).alias("recall"))
    return evaluate.run_summary(e, ["recall"], by=["status"])


@query("SELECT doc_id, rtrim(regexp_replace(concat('./', source, '//', lang), '^\\./', ''), '/') AS path FROM (SELECT doc_id, coalesce(source, 's') AS source, coalesce(lang, 'l') AS lang FROM documents)".replace("concat('./', source, '//', lang)", "concat('./', source, '/', lang)"))
def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made comparable."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("./"), F.coalesce("source", F.lit("s")), F.lit("//x/../"), F.coalesce("lang", F.lit("l")))
    return d.select("doc_id", T.clean_path(raw).alias("path"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class of constants for each nation and, for each customer, a class whose text holds its nation's constant and its
    segment's statement as parts of longer names."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    k = s("n_nationkey")
    limits = n.select(F.concat(F.lit("src/N"), k, F.lit(".java")).alias("path"), F.concat(F.lit("package geo;\npublic class N"), k, F.lit(" {\n  static final int LIMIT_"), k, F.lit(" = 1;\n}\n")).alias("text"))
    stmts = c.select("c_mktsegment").distinct().select(F.concat(F.lit("map/"), "c_mktsegment", F.lit(".xml")).alias("path"), F.concat(F.lit("<mapper namespace='seg."), "c_mktsegment", F.lit("'><select id='pick'>select 1</select></mapper>")).alias("text"))
    own, nat = s("c_custkey"), s("c_nationkey")
    users = c.select(F.concat(F.lit("app/C"), own, F.lit(".java")).alias("path"), F.concat(F.lit("package app;\npublic class C"), own, F.lit(" { int a = xN"), nat, F.lit(".LIMIT_"), nat, F.lit("y; // N0.LIMIT_0\n  void run() { the"), "c_mktsegment", F.lit(".picked(1); }\n}\n")).alias("text"))
    return limits.unionByName(stmts).unionByName(users)


@query("""SELECT concat('java:app.C', c_custkey) AS src, concat('const:geo.N', c_nationkey, '.LIMIT_', c_nationkey) AS dst, 'uses_constant' AS kind FROM customer
UNION ALL SELECT concat('java:app.C', c_custkey), concat('mybatis:seg.', c_mktsegment, '.pick'), 'service_to_mapper' FROM customer""")
def partial_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to constants and statements that a class for each customer names within longer names."""
    files = _users(spark, sf_dir)
    return symbols.link(symbols.harvest(files)[0], files).where("kind IN ('uses_constant', 'service_to_mapper')")
