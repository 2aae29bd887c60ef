"""Amendment texts and what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import text as T
from changelens.functions import values as V
from changelens.operators import changes
from changelens.plans.catalogue import case, query, values

_TYPED = """(CAST(1 AS BIGINT),'2억원과 1억2천만원, 1천500만원, 7천만원, 15만원, 150,000원'),(2,'15% 또는 100분의 6, 0.5퍼센트'),(3,'주 52시간, 15일의 휴가와 3개월, 1월 1일부터'),(4,'만 65세 또는 20세 이상'),
(5,'2026년 1월 1일부터 2026-03-05까지, 2027년'),(6,'1억5,000만원 2천원'),(7,'1000분의 1, 3분의 1')"""


def _typed(spark: SparkSession) -> DataFrame:
    return values(spark, _TYPED, "id,t")


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),'money','200000000,120000000,15000000,70000000,150000,150000'),(2,'rate','0.15,0.005,0.06'),(3,'duration','52,15,3'),(4,'age','65,20'),
(5,'date','2026-01-01,2026-03-05,2027'),(6,'money','50000000'),(7,'rate','0.001,0.333333')) AS t(id,kind,found)""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts, rates, durations, ages and dates of legal texts."""
    kinds = {"money": V.money, "rate": V.rates, "duration": V.durations, "age": V.ages, "date": V.dates}
    arr = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_join(F.transform(f(F.col("t")), lambda x: x["value"]), ",").alias("found")) for k, f in kinds.items()])
    return _typed(spark).select("id", F.explode(arr).alias("x")).select("id", "x.kind", "x.found").where("found <> ''")


@case("SELECT * FROM (VALUES (0.06,'0.06'),(14000000.0,'14000000'),(0.1234567,'0.123457'),(2.5,'2.5'),(0.00001,'1e-05'),(1234567.5,'1.23457e+06')) AS t(v,k)")
def number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql("SELECT CAST(v AS DOUBLE) AS v FROM (VALUES (0.06),(14000000.0),(0.1234567),(2.5),(0.00001),(1234567.5)) AS t(v)")
    return v.select("v", V.number_key(F.col("v")).alias("k"))


_CASES = """(CAST(1 AS BIGINT),'연 15만원','연 25만원'),(2,'같은 문구','같은 문구'),(3,'100분의 6','100분의 7'),(4,'2025년 1월 1일','2026년 1월 1일'),(5,'15만원','20만원 이상'),(6,'제5조','제5조를 신설한다'),(7,'3개월','6개월'),(8,'가나다','라마바')"""


def _cases(spark: SparkSession) -> DataFrame:
    return changes.classify(changes.normalise(values(spark, _CASES, "change_id,before_text,after_text")))


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),'value_change',0.96,'money',false,''),(2,'no_code_impact',0.99,'identical',false,''),(3,'rate_change',0.96,'rate',false,''),(4,'date_change',0.95,'date',false,''),
(5,'condition_change',0.78,'comparison',true,'value_change'),(6,'structural_change',0.72,'structural',true,''),(7,'value_change',0.88,'value',false,''),(8,'unknown',0.2,'unknown',true,'')) AS t(change_id,primary_type,confidence,signal,ambiguous,secondary_type)""")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that holds decides."""
    return _cases(spark).select("change_id", "rule.primary_type", F.col("rule.confidence").cast("double").alias("confidence"), "rule.signal", "rule.ambiguous", "rule.secondary_type")


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),'value_change',0.96,'rule'),(2,'no_code_impact',0.99,'rule'),(3,'rate_change',0.96,'rule'),(4,'date_change',0.95,'rule'),(5,'condition_change',0.9,'hybrid'),
(6,'structural_change',0.8,'hybrid'),(7,'value_change',0.88,'rule'),(8,'unknown',0.2,'fallback')) AS t(change_id,primary_type,confidence,source)""")
def classify_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure rules stand; a model is asked for the rest, within limits."""
    model = values(spark, "(CAST(5 AS BIGINT),'condition_change',0.9D),(6,'value_change',0.9D),(8,'value_change',1.5D)", "change_id,answer_type,answer_confidence")
    return changes.settle(_cases(spark), model).select("change_id", "primary_type", F.col("confidence").cast("double").alias("confidence"), "source")


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),'150000>250000'),(3,'0.06>0.07'),(4,'2025-01-01>2026-01-01'),(5,'150000>200000'),(7,'3>6')) AS t(change_id,delta)""")
def value_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values paired by place; the first delta by kind."""
    d = changes.first_delta(_cases(spark))
    return _cases(spark).withColumn("d", d).where("d IS NOT NULL").select("change_id", F.concat("d.before.value", F.lit(">"), "d.after.value").alias("delta"))


_AMEND = """(CAST(1 AS BIGINT),'제59조의2제1항 중 "15만원"을 "25만원"으로 하고, 같은 조 제2항을 삭제한다.'),(2,'제5조제1항을 다음과 같이 한다.\n본문 내용\n제6조를 삭제한다.'),(3,'제7조에 제3항을 신설한다.'),(4,'제8조 중 100원을 200원으로 한다.'),(5,'없음')"""


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),0,'제59조의2제1항','replace','15만원','25만원'),(1,1,'제59조의2제2항','delete','',''),(2,0,'제5조제1항','rewrite','','본문 내용'),(2,1,'제6조','delete','',''),
(3,0,'제7조','insert','','제3항'),(4,0,'제8조','replace','100원','200원')) AS t(id,pos,article_ref,kind,before_fragment,after_fragment)""")
def amendment_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of amendment texts, places resolved."""
    e = values(spark, _AMEND, "id,t").select("id", changes.parse_amendment("t").alias("e"))
    return e.select("id", F.posexplode("e").alias("pos", "x")).select("id", "pos", "x.*")


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),concat('제59조의2제1항 15만원',chr(10),'제59조의2제2항'),'제59조의2제1항 25만원'),(2,'제6조','제5조제1항 본문 내용'),(3,'','제7조 제3항'),(4,'제8조 100원','제8조 200원'),(5,'','없음')) AS t(id,before,after)""")
def amendment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after derived from the edits."""
    e = values(spark, _AMEND, "id,t").select("id", "t", changes.parse_amendment("t").alias("e"))
    return e.select("id", changes.derive(F.col("e"), F.col("t")).alias("x")).select("id", "x.before", "x.after")


@case("SELECT * FROM (VALUES (CAST(1 AS BIGINT),'25만원','15만원'),(2,'a','a'),(3,'새','')) AS t(id,added,removed)")
def text_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens added and removed; a token that moved is both."""
    v = values(spark, "(CAST(1 AS BIGINT),'연 15만원 한도','연 25만원 한도'),(2,'a b c','b c a'),(3,'가 나','가 새 나')", "id,b,a")
    d = v.select("id", changes.text_delta("b", "a").alias("d"))
    return d.select("id", F.array_join("d.added", ",").alias("added"), F.array_join("d.removed", ",").alias("removed"))


@case("""SELECT * FROM (VALUES ('./a//b/x.java','a/b/x.java','a/b/x.java','a/b/x.java::symbol:run'),('a\\b/../c','a/c','a/b/../c','a/c::line:20'),('/etc/x',NULL,'etc/x',NULL),('../x',NULL,'../x',NULL)) AS t(raw,strict,loose,k)""")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made comparable, and the key of a place."""
    v = spark.createDataFrame([("./a//b/x.java", " run ", 3), ("a\\b/../c", None, 27), ("/etc/x", None, 1), ("../x", None, 1)], "raw string, symbol string, line int")
    c = v.withColumn("strict", T.clean_path(F.col("raw")))
    return c.select("raw", "strict", T.loose_path(F.col("raw")).alias("loose"), T.place_key(F.col("strict"), F.col("symbol"), F.col("line")).alias("k"))


@query("""SELECT doc_id, concat('sha256:', sha256(concat('before', chr(0), text, chr(0), 'after', chr(0), source, chr(0)))) AS source_hash FROM documents WHERE text IS NOT NULL""")
def change_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of text pairs."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    return d.select("doc_id", T.sha(F.concat(F.lit("before\0"), "text", F.lit("\0after\0"), "source", F.lit("\0"))).alias("source_hash"))
