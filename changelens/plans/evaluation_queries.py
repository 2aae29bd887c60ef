"""Metrics over labels, rankings, patches and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.functions.text import loose_path
from changelens.operators import evaluate, replay
from changelens.plans.catalogue import case, parts, query, table, values

_RULE = "CASE WHEN n_chars < 500 THEN '0' WHEN n_chars % 9 = 0 THEN 'odd' ELSE '1' END"
_CONF = "(doc_id % 100) / 100.0"
_PRED = f"WITH p AS (SELECT d.doc_id, {_RULE} AS prediction, CAST(quality AS VARCHAR) AS label, {_CONF} AS confidence FROM documents d JOIN labels USING (doc_id))"
_CLASSES = _PRED + """, c AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
s AS (SELECT class, (SELECT count(*) FROM p WHERE label = class AND prediction = class) AS tp, (SELECT count(*) FROM p WHERE label <> class AND prediction = class) AS fp,
  (SELECT count(*) FROM p WHERE label = class AND prediction <> class) AS fn FROM c),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM s),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").selectExpr("doc_id", f"{_RULE} AS prediction", "CAST(quality AS STRING) AS label", f"CAST({_CONF} AS DOUBLE) AS confidence")


@query(_CLASSES + " SELECT class, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def clf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    r = lambda c: F.round(c, 9).alias(c)
    return evaluate.per_class(predictions(spark, sf_dir)).select("class", "tp", "fp", "fn", r("precision"), r("recall"), r("f1"))


@query(_CLASSES + " SELECT round(avg(f1), 9) AS macro_f1 FROM f WHERE tp + fn > 0")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f1(predictions(spark, sf_dir)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(_PRED + """ SELECT round(avg(CAST(prediction = label AS INT)), 9) AS accuracy, round(avg(CAST(confidence < 0.5 AS INT)), 9) AS low_confidence_rate,
  round(avg(CAST(confidence >= 0.8 AND prediction <> label AS INT)), 9) AS high_confidence_wrong_rate FROM p""")
def confidence_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.confidence_rates(predictions(spark, sf_dir))
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


# --------------------------------------------------------------------------- retrieval metrics
_RANKED = """WITH x AS (SELECT l_orderkey AS case_id, concat('p', CAST(l_partkey % 40 AS VARCHAR)) AS path, min(l_linenumber) AS o FROM lineitem GROUP BY ALL),
r AS (SELECT case_id, path, row_number() OVER (PARTITION BY case_id ORDER BY o, path) AS rank FROM x),
w AS (SELECT o_orderkey AS case_id, concat('p', CAST(o_custkey % 40 AS VARCHAR)) AS path FROM orders
  UNION ALL SELECT o_orderkey, concat('p', CAST((o_custkey + 1) % 40 AS VARCHAR)) FROM orders),
c AS (SELECT DISTINCT case_id FROM (SELECT case_id FROM r UNION ALL SELECT case_id FROM w)),
n AS (SELECT c.case_id, (SELECT count(*) FROM w WHERE w.case_id = c.case_id) AS n_relevant FROM c),
g AS (SELECT r.case_id, r.rank, w.path IS NOT NULL AS good FROM r LEFT JOIN (SELECT DISTINCT * FROM w) w USING (case_id, path)),
m AS (SELECT n.case_id, any_value(n_relevant) AS n_relevant, coalesce(1.0 / min(rank) FILTER (good), 0.0) AS reciprocal_rank, """ + ", ".join(
    f"count(*) FILTER (good AND rank <= {k}) AS h{k}, count(*) FILTER (rank <= {k}) AS g{k}" for k in (1, 3, 5)
) + """ FROM n LEFT JOIN g USING (case_id) GROUP BY n.case_id)"""
_PER_CASE = _RANKED + " SELECT case_id, round(reciprocal_rank, 6) AS reciprocal_rank, " + ", ".join(
    f"CASE WHEN n_relevant = 0 OR h{k} > 0 THEN 1 ELSE 0 END AS hit_{k}, CASE WHEN n_relevant = 0 THEN 1.0 ELSE h{k} / n_relevant END AS recall_{k}, round(coalesce(h{k} / nullif(g{k}, 0), 0.0), 6) AS precision_{k}" for k in (1, 3, 5)
) + " FROM m"


def _rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem")
    x = evaluate.by_case(l.select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 40).alias("p"), "l_linenumber"), parts(l)).groupBy("case_id", F.concat(F.lit("p"), F.col("p").cast("string")).alias("path")).agg(F.min("l_linenumber").alias("o"))
    r = x.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("o", "path"))).drop("o")
    o = table(spark, sf_dir, "orders")
    p = lambda c: F.concat(F.lit("p"), (c % 40).cast("string"))
    w = o.select(F.col("o_orderkey").alias("case_id"), F.explode(F.array(p(F.col("o_custkey")), p(F.col("o_custkey") + 1))).alias("path"))
    return r, w


@query(_PER_CASE)
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, recall, precision and reciprocal rank of every case."""
    m = evaluate.retrieval(*_rankings(spark, sf_dir), ks=(1, 3, 5), parts=parts(table(spark, sf_dir, "lineitem")))
    r = [c for c in m.columns if c.startswith("precision") or c == "reciprocal_rank"]
    return m.select("case_id", *[F.round(c, 6).alias(c) if c in r else F.col(c) for c in m.columns if c != "case_id"])


@query(f"WITH pc AS ({_PER_CASE}) SELECT count(*) AS cases, round(avg(reciprocal_rank), 4) AS mrr, round(avg(recall_1), 4) AS recall_1, round(avg(recall_5), 4) AS recall_5, round(avg(precision_5), 4) AS precision_5 FROM pc")
def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summary(ir_metrics(spark, sf_dir), digits=4)
    return s.select("cases", F.col("reciprocal_rank").alias("mrr"), "recall_1", "recall_5", "precision_5")


#: The weight of each source and the source that an experiment leaves out.
WEIGHTS = {1: 0.15, 2: 0.2, 3: 0.25}
EXPERIMENTS = {"all": 0, "no_rag": 1, "no_terms": 2, "no_constants": 3}


def _total(scores: list) -> F.Column:
    """The sum of those that are there; null if none is."""
    return F.when(F.coalesce(*scores).isNotNull(), sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0)))


@query("""WITH c AS (SELECT l_suppkey AS q, l_partkey AS p, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS s, max(l_discount) AS v FROM lineitem GROUP BY ALL),
e AS (SELECT * FROM (VALUES ('all',0),('no_rag',1),('no_terms',2),('no_constants',3)) AS t(experiment, off)),
b AS (SELECT experiment, q, p, round(sum(CASE s WHEN 1 THEN 0.15 WHEN 2 THEN 0.2 ELSE 0.25 END * v), 6) AS score FROM c JOIN e ON s <> off GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment, q ORDER BY score DESC, p) AS n FROM b)
SELECT experiment, count(*) AS places, count(DISTINCT q) AS queries, CAST(sum(CASE WHEN p % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS test_files FROM r WHERE n <= 5 GROUP BY experiment""")
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments that leave out a source each, run as one plan: a row joins the experiments that use it."""
    l = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    # dealt out by query once; a place is one row with the best of each source until the experiments are told apart
    c = l.select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("p"), source.alias("s"), F.col("l_discount").alias("v")).repartition(parts(l), "q")
    c = c.groupBy("q", "p").agg(*[F.max(F.when(F.col("s") == k, w * F.col("v"))).alias(f"s{k}") for k, w in WEIGHTS.items()])
    names = [F.struct(F.lit(n).alias("experiment"), _total([F.col(f"s{k}") for k in WEIGHTS if k != o]).alias("score")) for n, o in EXPERIMENTS.items()]
    b = c.select("q", "p", F.explode(F.array(*names)).alias("e")).where("e.score IS NOT NULL").select("e.experiment", "q", "p", F.round("e.score", 6).alias("score"))
    w = Window.partitionBy("experiment", "q").orderBy(F.desc("score"), "p")
    top = b.withColumn("n", F.row_number().over(w)).where("n <= 5")
    return top.groupBy("experiment").agg(F.count("*").alias("places"), F.count_distinct("q").alias("queries"), F.sum(F.when(F.col("p") % 5 == 0, 1).otherwise(0)).alias("test_files"))


# --------------------------------------------------------------------------- patches and replays
@query("""WITH e AS (SELECT l_orderkey AS c, concat('k', CAST(l_partkey % 5 AS VARCHAR)) AS key FROM lineitem),
g AS (SELECT DISTINCT l_orderkey AS c, concat('k', CAST(l_suppkey % 5 AS VARCHAR)) AS key FROM lineitem),
rel AS (SELECT DISTINCT l_orderkey AS c, concat('f', CAST(l_partkey % 9 AS VARCHAR)) AS path FROM lineitem WHERE l_linestatus = 'F'),
pat AS (SELECT DISTINCT l_orderkey AS c, concat('f', CAST(l_suppkey % 9 AS VARCHAR)) AS path FROM lineitem WHERE l_returnflag <> 'N'),
ids AS (SELECT c FROM e UNION SELECT c FROM g UNION SELECT c FROM rel UNION SELECT c FROM pat),
a AS (SELECT e.c, avg(CASE WHEN g.key IS NULL THEN 0 ELSE 1 END) AS v FROM e LEFT JOIN g USING (c, key) GROUP BY e.c),
b AS (SELECT rel.c, avg(CASE WHEN pat.path IS NULL THEN 0 ELSE 1 END) AS v FROM rel LEFT JOIN pat USING (c, path) GROUP BY rel.c),
n AS (SELECT pat.c, avg(CASE WHEN rel.path IS NULL THEN 1 ELSE 0 END) AS v FROM pat LEFT JOIN rel USING (c, path) GROUP BY pat.c),
j AS (SELECT coalesce(rel.c, pat.c) AS c, count(*) FILTER (rel.path IS NOT NULL AND pat.path IS NOT NULL) / count(*) AS v FROM rel FULL JOIN pat ON rel.c = pat.c AND rel.path = pat.path GROUP BY 1)
SELECT ids.c AS case_id, round(coalesce(a.v, 1.0), 6) AS replacement_rate, round(coalesce(b.v, 1.0), 6) AS file_coverage, round(coalesce(n.v, 0.0), 6) AS unnecessary_rate, round(coalesce(j.v, 1.0), 6) AS jaccard
FROM ids LEFT JOIN a ON a.c = ids.c LEFT JOIN b ON b.c = ids.c LEFT JOIN n ON n.c = ids.c LEFT JOIN j ON j.c = ids.c""")
def patch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement rate, coverage, needless files and Jaccard of every case."""
    l = table(spark, sf_dir, "lineitem")
    key = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    e = l.select(F.col("l_orderkey").alias("case_id"), key("k", "l_partkey", 5).alias("key"))
    g = l.select(F.col("l_orderkey").alias("case_id"), key("k", "l_suppkey", 5).alias("key"))
    rel = l.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("case_id"), key("f", "l_partkey", 9).alias("path")).distinct()
    pat = l.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("case_id"), key("f", "l_suppkey", 9).alias("path")).distinct()
    m = evaluate.patch(e, g, rel, pat, parts(l))
    return m.select("case_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "case_id"])


@query("""WITH p AS (SELECT page_id, rtrim(regexp_replace(url, '^https?://', ''), '/') AS path FROM pages)
SELECT page_id AS case_id, path, CASE WHEN path LIKE 'm.%' AND contains(path, '/de/') THEN 'excluded' WHEN regexp_matches(path, '^[^/]+/(en|de)(/|$)') THEN 'in_scope' ELSE 'out_of_scope' END AS scope FROM p""")
def scope_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in, out of, or taken out of a case's scope; each page brings its own scope lines."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("case_id"), F.regexp_replace("url", "^https?://", "").alias("path"))
    host = F.regexp_extract("path", "^([^/]+)", 1)
    spec = F.array(
        F.struct(F.lit("relevant").alias("kind"), F.concat(host, F.lit("/en/")).alias("spec")),
        F.struct(F.lit("relevant").alias("kind"), F.concat(F.lit("./"), host, F.lit("/de")).alias("spec")),
        F.struct(F.lit("excluded").alias("kind"), F.when(F.startswith("path", F.lit("m.")), F.concat(host, F.lit("//de/"))).otherwise(F.lit("nowhere")).alias("spec")),
    )
    scopes = p.select("case_id", F.explode(spec).alias("x")).select("case_id", "x.*")
    return replay.in_scope(p, scopes)


@case("""SELECT * FROM (VALUES ('src/a.java','M',7,1),('src/한.java','A',3,0),('new/b.sql','R100',1,1),('bin/x.png','M',0,0),('gone.txt','D',0,0)) AS t(path,status,added,removed)""")
def answer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of a version-control diff joined by path."""
    from changelens.sources import feeds

    raw = spark.createDataFrame([("M\0src/a.java\0A\0src/한.java\0R100\0old/b.sql\0new/b.sql\0M\0bin/x.png\0D\0gone.txt\0", "7\t1\tsrc/a.java\0003\t0\tsrc/한.java\0001\t1\t\0old/b.sql\0new/b.sql\0-\t-\tbin/x.png\0")], "s string, n string")
    s = raw.select(F.explode(feeds.name_status("s")).alias("x")).select("x.status", "x.path")
    n = raw.select(F.explode(feeds.num_stat("n")).alias("x")).select("x.path", "x.added", "x.removed")
    return replay.answer_diff(s, n)


@case("""SELECT * FROM (VALUES ('a.java',true,true,false,true),('b.java',true,true,true,false),('c.java',false,false,false,false),('d.java',true,false,false,false),('e.java',true,true,false,true)) AS t(path,path_exists,found_after,found_before,ok)""")
def replacement_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fixture's replacements agree with the answer."""
    e = values(spark, "('k','./a.java','x = 1','x = 2','exact'),('k','b.java','y','z','exact'),('k','c.java','q','r','exact'),('k','d.java','q',' ','exact'),('k','e.java','m  =  1','m = \n 2','normalized_text')", "case_id,path,before,after,match_mode")
    f = values(spark, "('k','a.java','int x = 2;'),('k','b.java','y z'),('k','d.java','text'),('k','e.java','int m =   2;')", "case_id,path,content")
    return replay.check_replacements(e, f).drop("case_id")


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),true),(2,false),(3,false),(4,true),(5,false),(6,false)) AS t(case_id,passed)""")
def replay_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.verdict(_replays(spark)).select("case_id", "passed")


def _replays(spark: SparkSession) -> DataFrame:
    rows = [(1, None, True, 1.0, 1.0, 0.0, 1.0, True, "passed"), (2, "TIMEOUT", True, 1.0, 1.0, 0.0, 1.0, None, None), (3, None, False, 1.0, 1.0, 0.0, 1.0, None, None), (4, None, True, 1.0, 1.0, 0.5, 0.5, None, "skipped"), (5, None, True, 0.5, 1.0, 0.0, 1.0, True, "passed"), (6, None, True, 1.0, 1.0, 0.0, 1.0, True, "failed")]
    return spark.createDataFrame(rows, "case_id long, failure_kind string, fixture_ok boolean, replacement_rate double, file_coverage double, unnecessary_rate double, jaccard double, git_apply boolean, golden_status string")


@case("SELECT CAST(6 AS BIGINT) AS case_count, CAST(2 AS BIGINT) AS passed_count, 0.333333 AS pass_rate, 0.916667 AS replacement_rate, 1.0 AS file_coverage, 0.083333 AS unnecessary_rate, 0.916667 AS jaccard, CAST(3 AS BIGINT) AS git_apply_ok_count, CAST(2 AS BIGINT) AS golden_passed_count")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.summary(evaluate.verdict(_replays(spark)))


@query("""WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'redacted' ELSE 'metadata_only' END AS m,
  CASE event_type WHEN 'view' THEN 'metric' WHEN 'click' THEN 'diff_body' WHEN 'purchase' THEN 'file_path' WHEN 'error' THEN 'golden_output' ELSE 'unlisted' END AS k FROM events)
SELECT m AS privacy_mode, k AS artifact_kind, count(*) AS n FROM a WHERE k = 'metric' OR (m = 'full' AND k <> 'unlisted') OR (m = 'redacted' AND k = 'file_path') GROUP BY ALL""")
def privacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that their privacy mode lets out."""
    a = table(spark, sf_dir, "events").selectExpr(
        "CASE event_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'redacted' ELSE 'metadata_only' END AS privacy_mode",
        "CASE event_type WHEN 'view' THEN 'metric' WHEN 'click' THEN 'diff_body' WHEN 'purchase' THEN 'file_path' WHEN 'error' THEN 'golden_output' ELSE 'unlisted' END AS artifact_kind",
    )
    return replay.allowed(a).groupBy("privacy_mode", "artifact_kind").agg(F.count("*").alias("n"))


@case("SELECT 'metadata_only' AS privacy_mode")
def strictest_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.strictest(values(spark, "('full'),('metadata_only'),('redacted')", "privacy_mode"))


@case("SELECT * FROM (VALUES ('a',''),('b','change_type,timeout'),('c','overlap,duplicate'),('c','duplicate')) AS t(case_id,errors)")
def case_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that an evaluation case breaks."""
    from changelens.sources import feeds

    rows = [("a", "value_change", 600, ["x"], ["y"], [1, 3]), ("b", "nonsense", 9999, [], [], []), ("c", "rate_change", 1, ["x"], ["x"], [5]), ("c", "rate_change", 1, ["x"], ["z"], [5])]
    return feeds.validate(spark.createDataFrame(rows, "case_id string, change_type string, timeout_seconds int, relevant_files array<string>, forbidden_files array<string>, top_k array<int>"))


@case("SELECT * FROM (VALUES ('L1','소득세법','20260101'),('L2','법인세법','20260201')) AS t(law_id,law_name,promulgation_date)")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed responses, a list or one item alone."""
    from changelens.sources import feeds

    one = '{"LawSearch":{"law":{"법령ID":"L1","법령명한글":"소득세법","공포일자":"20260101"}}}'
    many = '{"LawSearch":{"law":[{"법령ID":"L2","법령명한글":"법인세법","공포일자":"20260201"}]}}'
    raw = spark.createDataFrame([(0, one), (1, many), (2, '{"LawSearch":{}}')], "query_ord int, body string")
    return feeds.law_items(raw).select("law_id", "law_name", "promulgation_date")


@query("SELECT url, rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '/+', '/', 'g'), '/') AS loose FROM pages")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", F.regexp_replace("url", "^https?://", "").alias("raw"))
    return p.select("url", loose_path(F.col("raw")).alias("loose"))
