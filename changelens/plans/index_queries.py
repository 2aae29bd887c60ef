"""Dictionaries, constants, chunks, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.text import redact
from changelens.operators import chunk, index, symbols
from changelens.plans.catalogue import case, query, table, values


@query("""WITH t AS (SELECT item_id AS code, text AS term FROM benchmark WHERE text <> ''), n AS (SELECT count(DISTINCT code) AS n FROM t),
df AS (SELECT term, count(DISTINCT code) AS df FROM t GROUP BY term),
h AS (SELECT d.doc_id, t.code, t.term, length(t.term) * ln(1 + n / df) AS s FROM documents d JOIN t ON contains(d.text, t.term) JOIN df USING (term) CROSS JOIN n),
b AS (SELECT doc_id, code, arg_max(term, (s, term)) AS term, round(max(s), 2) AS score FROM h GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) AS INTEGER) AS rank FROM b) SELECT * FROM r WHERE rank <= 8""")
def substring_match_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary terms that whole texts hold, longest and rarest first."""
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("code"), F.col("text").alias("term"))
    return index.match_codes(table(spark, sf_dir, "documents"), terms, "doc_id")


_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, line_no, substr(trim(line), 1, 160) AS excerpt, line, unnest(regexp_split_to_array(line, '[^\\p{L}\\p{N}_.]+')) AS tok FROM l WHERE regexp_matches(line, '[0-9]')),
v AS (SELECT doc_id, line_no, excerpt, line, tok, CAST(replace(regexp_extract(tok, '^([0-9]+\\.[0-9]+|[0-9]{1,3}(?:_[0-9]{3})+|[0-9]{4,})[Ll]?$', 1), '_', '') AS VARCHAR) AS big,
  regexp_extract(tok, '^([0-9]{1,3})[Ll]?$', 1) AS small FROM t),
c AS (SELECT doc_id, line_no, excerpt, TRY_CAST(big AS DOUBLE) AS v FROM v WHERE big <> '' AND CASE WHEN TRY_CAST(big AS DOUBLE) > 1e13 OR TRY_CAST(big AS DOUBLE) IN (0.0, 1.0) THEN false
    WHEN TRY_CAST(big AS DOUBLE) = floor(TRY_CAST(big AS DOUBLE)) THEN TRY_CAST(big AS DOUBLE) >= 1000 AND CAST(TRY_CAST(big AS DOUBLE) AS BIGINT) % 10 = 0
      AND TRY_CAST(big AS DOUBLE) NOT BETWEEN 1900 AND 2100 AND TRY_CAST(big AS DOUBLE) NOT BETWEEN 19000101 AND 20991231
    ELSE TRY_CAST(big AS DOUBLE) < 100 END
  UNION ALL SELECT doc_id, line_no, excerpt, CAST(small AS DOUBLE) FROM v WHERE small <> '' AND CAST(small AS DOUBLE) BETWEEN 2 AND 999
    AND regexp_matches(line, '(?i)hour|week|day|month|age|wage|overtime|annual|leave')),
k AS (SELECT DISTINCT CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%g', v) END AS value_key, doc_id, line_no, excerpt FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY value_key ORDER BY doc_id, line_no) AS INTEGER) AS ord FROM k)"""


@query(_LINES + " SELECT value_key, doc_id, CAST(line_no AS INTEGER) AS line_no, excerpt, ord FROM r WHERE ord <= 12")
def const_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that may be legal constants, with their first twelve places."""
    return index.constants(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id")


_AMOUNTS = "(CAST(1 AS BIGINT),'2300','2,300원',0),(1,'0.15','15%',1),(1,'14000000','1천400만원',2),(2,'0.15','100분의 15',0),(2,'9','9일',1)"
_CODE = """('a.java','long LIMIT = 14_000_000L;\nrate = 0.15; // hour 9'),('b.xml','upper="14000000" rate="0.15"'),('c.sql','fee 2300, year 2024, ok 12345 id 20240110'),('d.sql','x 0.15 y 1.0')"""


@case("SELECT * FROM (VALUES (CAST(1 AS BIGINT),'14000000',8.79,1),(1,'2300',6.44,2),(1,'0.15',1.69,3),(2,'9',1.61,2),(2,'0.15',1.69,1)) AS t(change_id,value_key,score,rank)")
def const_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of a change found as literals in code."""
    files = values(spark, _CODE, "path,text")
    return index.match_constants(values(spark, _AMOUNTS, "change_id,value_key,expression,ord"), index.constants(files)).select("change_id", "value_key", F.col("score"), "rank")


_TERMS = """('v/A.java','private String a0121; // 자녀세액공제 금액\nprivate Long b0200; // 소득'),('q/x.xml','select a0121 from t -- 자녀세액공제 금액\nselect a0121, c0300 -- 월세 공제액'),('u/f.xfdl','var k = b0200; // 전통시장 사용금액')"""


@query("SELECT * FROM (VALUES ('a0121','자녀세액공제 금액|월세 공제액'),('b0200','소득|전통시장 사용금액')) AS t(code,labels)")
def term_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of codes from comments, commonest first."""
    got = index.labels(index.harvest_terms(values(spark, _TERMS, "path,text")))
    first = F.when(F.col("code") == "b0200", F.array_join(F.array_sort("labels"), "|")).otherwise(F.array_join("labels", "|"))
    return got.select("code", first.alias("labels"))


@case("SELECT * FROM (VALUES ('a0121','v/A.java',1),('a0121','q/x.xml',2),('b0200','v/A.java',1),('b0200','u/f.xfdl',2),('c0300','q/x.xml',1)) AS t(code,path,ord)")
def code_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.code_places(values(spark, _TERMS, "path,text"))


@case("SELECT * FROM (VALUES (CAST(1 AS BIGINT),'[관련 항목] a0121=자녀세액공제 금액\nuse a0121 and z9999'),(2,'nothing here')) AS t(chunk_id,doc)")
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's known codes are named in a line before it."""
    chunks = values(spark, "(CAST(1 AS BIGINT),'use a0121 and z9999'),(2,'nothing here')", "chunk_id,text")
    return index.headers(chunks, index.labels(index.harvest_terms(values(spark, _TERMS, "path,text"))))


@query("SELECT doc_id, regexp_replace(text, '(?i)\\b(api[_-]?key|token|password|passwd|secret|authorization|cookie)\\s*[:=]\\s*[^\\s,;]+', '\\1=[REDACTED]', 'g') AS text FROM documents")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline secrets are redacted in whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("text"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '') AS parts, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN [replace(text, '.', ';')] ELSE parts END AS parts FROM p)
SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS chunk, unnest(parts) AS text FROM w""")
def chunk_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of whole texts, their full stops taken for semicolons."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.translate(F.replace("text", F.lit(";"), F.lit("\u0001")), ".", ";").alias("text"))
    out = chunk.statements(d, "doc_id")
    return out.select("doc_id", "chunk", F.replace("text", F.lit("\u0001"), F.lit(";")).alias("text"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '') AS p
  FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, 0 AS i, '' AS buf, CAST([] AS VARCHAR[]) AS done FROM d
  UNION ALL
  SELECT s.doc_id, i + 1, CASE WHEN fits THEN joined ELSE substr(para, full_ * 900 + 1, 900) END,
    CASE WHEN fits THEN done ELSE list_concat(CASE WHEN buf <> '' THEN list_append(done, buf) ELSE done END, list_transform(range(0, full_), lambda k: substr(para, k * 900 + 1, 900))) END
  FROM s JOIN (SELECT * FROM d) d USING (doc_id), LATERAL (SELECT p[i + 1] AS para), LATERAL (SELECT CASE WHEN buf <> '' THEN buf || chr(10) || chr(10) || para ELSE para END AS joined,
    CASE WHEN length(para) > 900 THEN CAST((length(para) - 1) // 900 AS BIGINT) ELSE 0 END AS full_), LATERAL (SELECT length(joined) <= 900 AS fits) WHERE i < len(p)),
e AS (SELECT s.doc_id, list_filter(CASE WHEN buf <> '' THEN list_append(done, buf) ELSE done END, lambda x: length(x) >= 40) AS c FROM s JOIN d USING (doc_id) WHERE i = len(p))
SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk, unnest(c) AS text FROM e""")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each sentence taken for a paragraph, packed and cut by length."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return chunk.paragraphs(d, "doc_id")


@case("""SELECT * FROM (VALUES ('a',0,concat(repeat('x',500), chr(10)||chr(10), repeat('y',300))),('a',1,repeat('z',900)),('a',2,concat(repeat('z',100), chr(10)||chr(10), repeat('w',50)))) AS t(path,chunk,text)""")
def chunk_paragraph_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing, cutting and what is too short."""
    v = spark.sql("SELECT 'a' AS path, concat(repeat('x',500), '\n\n', repeat('y',300), '\n\n', repeat('z',1000), '\n\n', repeat('w',50)) AS text UNION ALL SELECT 'b', 'short'")
    return chunk.paragraphs(v)


_FILES = """('m.py','import os\nclass A:\n  x = 1\ndef f():\n  return 1\n'),('s.sql','create table t1 (a int); ;insert into t2 values (1)'),
('m.xml','<mapper><select id="q1" x="1">select 1</select><update>u</update></mapper>'),('K.kt','fun one(a: Int) { if (a) { b() } }\nfun two() = 3'),
('J.java','class J { public int go(int a) { return a; } private void no() { x(); } }'),('u.xfdl','<F><Script><![CDATA[this.fn_a = function(x) { y(); };\nfunction b() { z(); }]]></Script></F>'),('x.ts','let a = 1')"""


@case("""SELECT * FROM (VALUES ('m.py',0,concat('class A:',chr(10),'  x = 1'),'A'),('m.py',1,concat('def f():',chr(10),'  return 1'),'f'),('s.sql',0,'create table t1 (a int)','t1'),('s.sql',1,'insert into t2 values (1)','t2'),
('m.xml',0,concat('[select id=q1]',chr(10),'<select id="q1" x="1">select 1</select>'),''),('m.xml',1,concat('[update]',chr(10),'<update>u</update>'),''),('K.kt',0,'fun one(a: Int) { if (a) { b() } }','one'),('K.kt',1,'fun two() = 3','two'),
('J.java',0,'public int go(int a) { return a; }','go'),('J.java',1,'private void no() { x(); }','no'),('u.xfdl',0,'this.fn_a = function(x) { y(); }','fn_a'),('u.xfdl',1,'function b() { z(); }','b'),('x.ts',0,'let a = 1','')) AS t(path,chunk,text,symbol)""")
def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of source files of every kind, and the symbol that each declares."""
    c = chunk.source_chunks(values(spark, _FILES, "path,text"))
    return c.withColumn("symbol", chunk.symbol(F.col("path"), F.col("text")))


_TREE = """('src/TaxService.java','package a.b;\n// { broken in a comment\npublic class TaxService {\n  public static final int RATE_MAX = 10;\n  private TaxMapper taxMapper;\n  public int calc(int x) { return taxMapper.selectRate(x) + RATE_MAX; }\n  class Inner { void go() { } }\n}'),
('src/Other.java','package a.b;\nclass Other { int f() { return TaxService.RATE_MAX; } String s = "}"; }'),
('map/Tax.xml','<mapper namespace="a.b.TaxMapper"><!-- <select id="old"> --><select id="selectRate">x</select><update id="save">y</update></mapper>'),
('test/TaxServiceTest.java','class TaxServiceTest { @Test void works() { new TaxService().calc(1); } }'),
('q.sql','-- note\nselect * from rates; update rates set x = 1'),('bad.java','class Bad { void f() { }')"""


@case("""SELECT * FROM (VALUES ('java:a.b.TaxService','java_class','a.b'),('const:a.b.TaxService.RATE_MAX','constant','a.b.TaxService'),('java:a.b.TaxService#calc','java_method','a.b.TaxService'),
('java:a.b.TaxService.Inner','java_class','a.b.TaxService'),('java:a.b.TaxService.Inner#go','java_method','a.b.TaxService.Inner'),('java:a.b.Other','java_class','a.b'),('java:a.b.Other#f','java_method','a.b.Other'),
('mybatis:a.b.TaxMapper.selectRate','mybatis_statement','a.b.TaxMapper'),('mybatis:a.b.TaxMapper.save','mybatis_statement','a.b.TaxMapper'),('java:TaxServiceTest','java_class',NULL),
('test:TaxServiceTest#works','test_method','TaxServiceTest'),('sql:q.sql#select:rates','sql_statement','rates'),('sql:q.sql#update:rates','sql_statement','rates')) AS t(id,kind,container)""")
def symbol_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a small source tree; the broken file is left out."""
    return symbols.harvest(values(spark, _TREE, "path,text"))[0].select("id", "kind", "container")


@case("SELECT * FROM (VALUES ('bad.java','unbalanced braces')) AS t(path,error)")
def symbol_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.harvest(values(spark, _TREE, "path,text"))[1]


@case("""SELECT * FROM (VALUES ('java:a.b.TaxService','const:a.b.TaxService.RATE_MAX','contains'),('java:a.b.TaxService','java:a.b.TaxService#calc','contains'),('java:a.b.TaxService.Inner','java:a.b.TaxService.Inner#go','contains'),
('java:a.b.Other','java:a.b.Other#f','contains'),('java:TaxServiceTest','test:TaxServiceTest#works','contains'),('java:a.b.TaxService','mybatis:a.b.TaxMapper.selectRate','service_to_mapper'),
('test:TaxServiceTest#works','java:a.b.TaxService','test_to_service'),('test:TaxServiceTest#works','java:a.b.TaxService#calc','test_to_service'),('java:a.b.Other','const:a.b.TaxService.RATE_MAX','uses_constant')) AS t(src,dst,kind)""")
def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = values(spark, _TREE, "path,text")
    return symbols.link(symbols.harvest(files)[0], files.where("path <> 'bad.java'"))
