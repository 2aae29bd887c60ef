"""Providers, drafts and what is read for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import drafts
from changelens.operators import events, index, knn, providers, retrieve
from changelens.plans.catalogue import case, query, table, values


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, round(1 - list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - x.v[i]) * (q.v[i] - x.v[i]))), 4) AS score FROM e q JOIN e x ON q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s)
SELECT query_id, concat('doc/', CAST(id AS VARCHAR)) AS path, round(0.15 * greatest(0.0, least(1.0, score)), 6) AS final_score FROM r WHERE n <= 8""")
def rag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits as scored candidates."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    hits = knn.top_k(v.where("id % 20 = 0"), v, 8).select("query_id", F.concat(F.lit("doc/"), F.col("id").cast("string")).alias("path"), F.lit(None).cast("string").alias("symbol"), "score", "rank")
    c = providers.rag(hits).withColumn("provider_idx", F.lit(0))
    return retrieve.merge(c).select("query_id", "path", "final_score")


_FILES = "('a/TaxVO.java','private int a0121; class TaxVO {}'),('a/Use1.java','TaxVO v;'),('b/Use2.java','new TaxVO()'),('q/x_2024.xml','a0121 150000'),('q/x.xml','a0121 150000'),('q/x_2026.xml','a0121')"


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),'term_dictionary','a/TaxVO.java',0.8),(1,'term_dictionary','q/x.xml',0.8),(1,'term_dictionary','q/x_2026.xml',0.8),
(1,'constant_match','q/x.xml',0.9),(1,'constant_match','q/x_2024.xml',0.9),(1,'verified_mapping','q/x.xml',1.0),(1,'verified_mapping','gone.xml',0.0)) AS t(query_id,source,path,score)""")
def provider_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary, constant and verified sources at their best files."""
    files = values(spark, _FILES, "path,text")
    d = providers.dictionary(spark.createDataFrame([(1, "a0121", 10.0, 1)], "query_id long, code string, score double, rank int"), index.code_places(files))
    inv = index.constants(files.where("path NOT LIKE '%2026%'"))
    c = providers.constants(spark.createDataFrame([(1, "150000", 6.0, 1)], "query_id long, value_key string, score double, rank int"), inv)
    v = providers.verified(spark.createDataFrame([(1, "q/x.xml", None), (1, "gone.xml", None)], "query_id long, path string, symbol string"), files)
    return d.unionByName(c).unionByName(v).select("query_id", "source", "path", F.col("normalized_score").alias("score"))


@case("""SELECT * FROM (VALUES ('q/x.xml',1),('a/TaxVO.java',2),('a/Use1.java',3),('b/Use2.java',4)) AS t(path,ord)""")
def draft_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read for a draft, in order: mapped, using, declaring."""
    files = values(spark, _FILES, "path,text")
    m = spark.createDataFrame([("q/x.xml", "a0121", 1), ("a/TaxVO.java", None, 2)], "path string, symbol string, ord int")
    return providers.snippets(m, files, index.code_places(files)).select("path", "ord")


@case("""SELECT * FROM (VALUES ('TaxVO','a/TaxVO.java',1),('TaxVO','a/Use1.java',2),('TaxVO','b/Use2.java',3)) AS t(name,path,ord)""")
def class_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.usages(values(spark, _FILES, "path,text"), values(spark, "('TaxVO'),('Nothing')", "name"))


@case("""SELECT * FROM (VALUES ('p1::symbol:s','verified'),('p1::symbol:s','rejected'),('p1::line:0','rejected')) AS t(dedup_key,state)""")
def fixture_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures with a symbol reach that symbol, those without the whole file."""
    c = spark.createDataFrame([(1, "p1", "s", None), (1, "p1", None, 3), (1, "p2", "s", None)], "query_id long, path string, symbol string, line_start int")
    f = spark.createDataFrame([("p1", "s", "verified"), ("p1", None, "rejected")], "path string, symbol string, state string")
    return providers.fixture_contexts(c, f).select("dedup_key", "state")


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),2),(2,1),(3,NULL)) AS t(case_id,rank)""")
def answer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer by path or file name."""
    r = spark.createDataFrame([(1, "a/b.java", 1), (1, "c\\d.java", 2), (2, "x/d.java", 1), (3, "y.java", 1)], "case_id long, path string, rank int")
    a = values(spark, "(CAST(1 AS BIGINT),'c/d.java'),(2,'other/d.java'),(3,'z.java')", "case_id,answer")
    return providers.answer_rank(r, a)


@case("SELECT * FROM (VALUES ('a.java','x = 1','x = 2')) AS t(path,before,after)")
def performed_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = values(spark, "('./a.java','x = 1','x = 2','exact'),('b.java','y','z','exact'),('c.java','m','n','exact')", "path,before,after,match_mode")
    b = values(spark, "('a.java','int x = 1;'),('b.java','y'),('c.java','m')", "path,content")
    a = values(spark, "('a.java','int x = 2;'),('b.java','y'),('c.java','m n')", "path,content")
    return providers.performed(e, b, a)


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),'제8조 100원','제8조 200원','제8조 중 100원을 200원으로 한다.','why'),(2,'old','new',NULL,NULL),(3,'b','a','kept','r')) AS t(id,before_text,after_text,amendment_text,reason_text)""")
def reparsed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows are parsed anew; doing it twice changes nothing more."""
    c = spark.createDataFrame([(1, "제8조 중 100원을 200원으로 한다.", "why", None, None, "law"), (2, "old", "new", None, None, "고시"), (3, "b", "a", "kept", "r", "law")], "id long, before_text string, after_text string, amendment_text string, reason_text string, source string")
    return providers.reparse(providers.reparse(c)).drop("source")


@case("""SELECT * FROM (VALUES ('verified','golden_test_confirmed',true),('verified','wrong_module',false),('rejected','wrong_module',true),('stale','file_missing',true),('revoked',NULL,true),('revoked','other',true),('unheard','other',false)) AS t(decision,reason,valid)""")
def reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons that a decision may carry."""
    rows = values(spark, "('verified','golden_test_confirmed'),('verified','wrong_module'),('rejected','wrong_module'),('stale','file_missing'),('revoked',NULL),('revoked','other'),('unheard','other')", "decision,reason")
    return rows.withColumn("valid", events.valid_reason(F.col("decision"), F.col("reason")))


_ANSWER = "'<think>no</think>@@@FILE: a.java\n@@@SEARCH\nint x = 1;\n@@@REPLACE\nint x = 2;\n@@@END\n@@@FILE: a.java\n@@@SEARCH\nmissing\n@@@REPLACE\nz\n@@@END'"


@case("SELECT * FROM (VALUES ('a.java','int x = 1;','int x = 2;'),('a.java','missing','z')) AS t(file,search,replace)")
def edit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = values(spark, f"({_ANSWER})", "t").select(F.explode(drafts.edit_blocks(drafts.without_reasoning(F.col("t")))).alias("e"))
    return a.select("e.file", "e.search", "e.replace")


@case("SELECT concat('--- a/a.java',chr(10),'+++ b/a.java',chr(10),'@@ -1,3 +1,3 @@',chr(10),' class A {',chr(10),'-int x = 1;',chr(10),'+int x = 2;',chr(10),' }') AS diff, 1 AS applied, 1 AS failed, true AS round_trip")
def draft_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit blocks as a unified diff that applies to the file."""
    v = values(spark, f"('a.java','class A {{\nint x = 1;\n}}',{_ANSWER})", "p,o,a")
    return v.select(drafts.draft_diff("p", "o", "a").alias("d")).select("d.*")


@case("""SELECT * FROM (VALUES (1,'{"a": 1}'),(2,'{"b":2}'),(3,'{"c":3}'),(4,NULL)) AS t(id,j)""")
def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(1, 'text ```json\n{"a": 1}\n``` more'), (2, ' {"b":2} '), (3, 'so: {"c":3} ok'), (4, "none")], "id int, t string")
    return v.select("id", F.trim(drafts.answer_json(F.col("t"))).alias("j"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, regexp_full_match(concat('v', CAST(event_id AS VARCHAR), '.', event_type), '[A-Za-z0-9]+([._-][A-Za-z0-9]+)*') AS good, length(props) // 2 + 10 > 20 AS long FROM events")
def event_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with their zone, valid versions, prompts beyond a window."""
    return table(spark, sf_dir, "events").select(
        "event_id", drafts.iso_time(F.col("ts")).alias("iso"), drafts.valid_version(F.concat(F.lit("v"), F.col("event_id").cast("string"), F.lit("."), "event_type")).alias("good"), drafts.overflows(F.col("props"), 10, 20).alias("long")
    )
