"""Candidates, neighbours, graph expansion and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators import knn, retrieve
from changelens.plans.catalogue import case, query, table, values
from changelens.schemas import CHANGE_TYPES

# --------------------------------------------------------------------------- candidates from order lines
CANDIDATE_COLUMNS = """
  l_suppkey AS query_id,
  CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INT) AS provider_idx,
  l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS cand_idx,
  CASE l_returnflag WHEN 'A' THEN 'rag' WHEN 'N' THEN 'term_dictionary' ELSE 'constant_match' END AS source,
  concat('part/', CAST(l_partkey % 200 AS STRING), '.java') AS path,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('m', CAST(l_partkey % 7 AS STRING)) END AS symbol,
  l_linenumber * 4 AS line_start,
  CASE WHEN l_linestatus = 'F' AND l_linenumber <= 2 THEN concat('h', CAST(l_partkey % 2 AS STRING)) END AS content_hash,
  round(l_discount * 10, 3) AS normalized_score,
  l_linestatus = 'O' AS stale,
  CASE WHEN l_linenumber = 3 THEN 'approved' END AS verified_state
"""


def candidates(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[c.strip() for c in _split(CANDIDATE_COLUMNS)], *more)


def _split(text: str) -> list[str]:
    """Columns of a select list, by commas outside brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:k])
            at = k + 1
    return out + [text[at:]]


_CTE = (
    "WITH c0 AS (SELECT " + CANDIDATE_COLUMNS.replace("STRING", "VARCHAR") + """ FROM lineitem),
c1 AS (SELECT *, CASE WHEN coalesce(symbol, '') <> '' THEN concat(path, '::symbol:', symbol)
        ELSE concat(path, '::line:', CAST(CAST(floor(line_start / 10) AS INTEGER) * 10 AS VARCHAR)) END AS base_key FROM c0),
f AS (SELECT query_id, base_key, first(content_hash ORDER BY provider_idx, cand_idx) AS first_hash FROM c1 GROUP BY ALL),
c AS (SELECT c1.*, CASE WHEN first_hash IS NOT NULL AND content_hash IS NOT NULL AND first_hash <> content_hash
        THEN concat(c1.base_key, '::hash:', content_hash) ELSE c1.base_key END AS dedup_key FROM c1 JOIN f USING (query_id, base_key)),
s AS (SELECT query_id, dedup_key, source, max(normalized_score) AS best FROM c GROUP BY ALL),
w AS (SELECT query_id, dedup_key, count(*) AS n_sources, max(best) AS strongest,
        sum(round(CASE source WHEN 'rag' THEN 0.15 WHEN 'term_dictionary' THEN 0.20 ELSE 0.25 END * best, 12)) AS score,
        string_agg(source, ',' ORDER BY best DESC, source) AS sources FROM s GROUP BY ALL),
g AS (SELECT query_id, dedup_key, first(path ORDER BY provider_idx, cand_idx) AS path, first(symbol ORDER BY provider_idx, cand_idx) AS symbol,
        bool_and(stale) AS stale, first(verified_state ORDER BY provider_idx, cand_idx) FILTER (verified_state IS NOT NULL) AS verified_state FROM c GROUP BY ALL),
m AS (SELECT g.*, n_sources, strongest, sources, round(greatest(0.0, least(1.0, score
        + CASE WHEN n_sources >= 3 THEN 0.10 WHEN n_sources >= 2 THEN 0.05 ELSE 0.0 END
        - CASE WHEN stale THEN 0.5 ELSE 0.0 END)), 6) AS final_score FROM g JOIN w USING (query_id, dedup_key)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, path, dedup_key) AS INTEGER) AS rank FROM m)
"""
)


@query(_CTE + "SELECT query_id, dedup_key, path, symbol, final_score, n_sources, stale, verified_state, sources, strongest, rank FROM r WHERE rank <= 10")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three sources merged by place, scored and ranked for every query."""
    return retrieve.rank(retrieve.merge(candidates(spark, sf_dir)), 10)


_CONTEXTS = """(SELECT DISTINCT l_suppkey AS query_id, concat('part/', CAST(l_partkey % 200 AS VARCHAR), '.java::symbol:m', CAST(l_partkey % 7 AS VARCHAR)) AS dedup_key,
  concat('A', CAST(l_suppkey % 3 AS VARCHAR)) AS query_article_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'value_change' WHEN 1 THEN 'condition_change' WHEN 2 THEN 'rate' ELSE '' END AS query_change_type,
  concat('A', CAST(l_orderkey % 3 AS VARCHAR)) AS article_id,
  CASE l_orderkey % 5 WHEN 0 THEN 'value_change' WHEN 1 THEN 'rate_change' WHEN 2 THEN 'new_field' WHEN 3 THEN 'rate' ELSE 'condition_change' END AS change_type,
  CASE l_linenumber WHEN 1 THEN 'verified' WHEN 2 THEN 'rejected' WHEN 3 THEN 'stale' WHEN 4 THEN 'revoked' ELSE 'verified' END AS state,
  l_orderkey % 4 AS rejection_count, l_orderkey % 2 = 0 AS golden_confirmed, l_partkey % 2 = 0 AS historical_match,
  l_linenumber = 5 AS legacy, l_linestatus = 'O' AS merge_stale FROM lineitem)"""
_DELTA = f"""
WITH x AS (SELECT *, CASE WHEN query_article_id <> article_id OR query_change_type = '' THEN 'unrelated'
      WHEN query_change_type = change_type THEN 'exact'
      WHEN query_change_type IN ('value_change','rate_change','table_change') AND change_type IN ('value_change','rate_change','table_change') THEN 'compatible'
      WHEN query_change_type IN ('condition_change','new_field') AND change_type IN ('condition_change','new_field') THEN 'compatible'
      ELSE 'unrelated' END AS reuse FROM {_CONTEXTS}),
a AS (SELECT query_id, dedup_key,
      sum(CASE WHEN state = 'verified' THEN CASE reuse WHEN 'exact' THEN 35 ELSE 20 END + CASE WHEN golden_confirmed THEN 5 ELSE 0 END
        + CASE WHEN historical_match THEN 5 ELSE 0 END - CASE WHEN legacy THEN 15 ELSE 0 END ELSE 0 END) AS up,
      sum(CASE WHEN state = 'rejected' AND reuse = 'exact' THEN -30 ELSE 0 END) AS down,
      max(CASE WHEN state = 'rejected' AND reuse = 'exact' THEN rejection_count ELSE 0 END) AS times,
      bool_or(state = 'stale') AS was, bool_or(merge_stale) AS done FROM x WHERE reuse <> 'unrelated' GROUP BY ALL)
SELECT query_id, dedup_key, round(greatest(-50, least(45, up + CASE WHEN times >= 2 THEN least(down, -50) ELSE down END
  + CASE WHEN was AND NOT done THEN -50 ELSE 0 END)) / 100.0, 6) AS delta FROM a"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = spark.sql("SELECT * FROM " + _CONTEXTS.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    return retrieve.rerank_delta(ctx, CHANGE_TYPES)


@query(_DELTA)
def rerank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a place's decision history adds to or takes from its score."""
    return _deltas(spark, sf_dir)


@query(
    _CTE + f", d AS ({_DELTA}), q AS (SELECT m.query_id, m.dedup_key, path, round(greatest(0.0, least(1.0, final_score + coalesce(delta, 0.0))), 6) AS final_score "
    "FROM m LEFT JOIN d USING (query_id, dedup_key)), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, path, dedup_key) AS INTEGER) AS rank FROM q) "
    "SELECT query_id, dedup_key, final_score, rank FROM z WHERE rank <= 5"
)
def reranked_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge, rerank by history, then cut: the cut stands after the rerank."""
    merged = retrieve.merge(candidates(spark, sf_dir))
    return retrieve.rank(retrieve.rerank(merged, _deltas(spark, sf_dir)), 5).select("query_id", "dedup_key", "final_score", "rank")


# --------------------------------------------------------------------------- vectors
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


_PAIRS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
p AS (SELECT q.vec_id AS query_id, x.vec_id AS id, x.label, q.v AS a, x.v AS b FROM e q JOIN e x ON q.vec_id % 20 = 0)"""


@query(
    _PAIRS + ", s AS (SELECT query_id, id, round(1 - list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i]))), 4) AS score FROM p), "
    "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 8"
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest vectors of every query, its own row among them."""
    v = _vectors(spark, sf_dir)
    return knn.top_k(v.where("id % 20 = 0"), v, 8)


@query(
    _PAIRS + ", s AS (SELECT query_id, label, round(max(list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))), 6) AS score FROM p GROUP BY ALL) "
    "SELECT query_id, label, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS INTEGER) AS rank FROM s"
)
def file_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (labels) ranked by their best chunk."""
    v = _vectors(spark, sf_dir)
    return knn.best_by_group(v.where("id % 20 = 0"), v, "label")


# --------------------------------------------------------------------------- graph
_NODES = """('java:a.S','java_class','S','src/S.java','a'),('java:a.S#run','java_method','run','src/S.java','a.S'),('java:a.S#calc','java_method','calc','src/S.java','a.S'),
('mybatis:a.M.sel','mybatis_statement','sel','src/M.xml','a.M'),('mybatis:a.M.upd','mybatis_statement','upd','target/M.xml','a.M'),('java:a.T','java_class','T','src/T.java','a'),
('java:a.T#x','java_method','x','src/T.java','a.T'),('const:a.T.K','constant','K','src/T.java','a.T')"""
_EDGES = """('java:a.S','java:a.S#run','contains'),('java:a.S','java:a.S#calc','contains'),('java:a.S','mybatis:a.M.sel','service_to_mapper'),('java:a.S','mybatis:a.M.upd','service_to_mapper'),
('mybatis:a.M.sel','java:a.T','contains'),('java:a.T','java:a.T#x','contains'),('java:a.T','const:a.T.K','uses_constant'),('java:a.S#run','java:a.S','contains')"""


@case("""SELECT * FROM (VALUES
 (CAST(1 AS BIGINT),'java:a.S#calc','contains',1,'java:a.S -[contains]-> java:a.S#calc'),
 (1,'java:a.S#run','contains',1,'java:a.S -[contains]-> java:a.S#run'),
 (1,'mybatis:a.M.sel','service_to_mapper',1,'java:a.S -[service_to_mapper]-> mybatis:a.M.sel'),
 (1,'java:a.T','contains',2,'java:a.S -[service_to_mapper]-> mybatis:a.M.sel -[contains]-> java:a.T'),
 (2,'java:a.S','contains',1,'java:a.S#run -[contains]-> java:a.S'),
 (2,'java:a.S#calc','contains',2,'java:a.S#run -[contains]-> java:a.S -[contains]-> java:a.S#calc'),
 (2,'mybatis:a.M.sel','service_to_mapper',2,'java:a.S#run -[contains]-> java:a.S -[service_to_mapper]-> mybatis:a.M.sel')) AS t(query_id,id,edge_kind,depth,via)""")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps from two seeds; built files are left out and not passed through."""
    nodes, edges = values(spark, _NODES, "id,kind,name,path,container"), values(spark, _EDGES, "src,dst,kind")
    seeds = values(spark, "(CAST(1 AS BIGINT),'java:a.S'),(2,'java:a.S#run')", "query_id,id")
    return retrieve.neighbours(seeds, nodes, edges, depth=2)


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages WHERE html IS NOT NULL),
e AS (SELECT DISTINCT concat('p', CAST(page_id AS VARCHAR)) AS src, dst FROM l),
b AS (SELECT dst, min(src) AS src FROM e GROUP BY dst),
one AS (SELECT src AS seed, dst FROM e),
r AS (SELECT seed, dst, row_number() OVER (PARTITION BY seed ORDER BY concat(seed, ' -[contains]-> ', dst)) AS n FROM one)
SELECT CAST(substr(seed, 2) AS BIGINT) AS query_id, dst AS id, concat(seed, ' -[contains]-> ', dst) AS via FROM r WHERE n <= 20""")
def page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links as a graph; every page is a seed and gets its first twenty neighbours."""
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    links = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("dst")).withColumn("kind", F.lit("contains"))
    ends = links.select(F.col("dst").alias("id")).distinct()
    nodes = ends.select("id", F.lit("page").alias("kind"), F.col("id").alias("name"), F.lit("web").alias("path"), F.lit(None).cast("string").alias("container"))
    seeds = p.select(F.col("page_id").alias("query_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id")).distinct()
    return retrieve.neighbours(seeds, nodes, links, depth=1).select("query_id", "id", "via")


@case("""SELECT * FROM (VALUES (CAST(1 AS BIGINT),'src/M.xml',0.0375,2),(1,'src/S.java',0.15,1),(1,'src/S.java',0.03,3),(1,'src/S.java',0.03,4)) AS t(query_id,path,final_score,rank)""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best places seed the graph; what it reaches is merged with them."""
    nodes, edges = values(spark, _NODES, "id,kind,name,path,container"), values(spark, _EDGES, "src,dst,kind")
    c = spark.createDataFrame([(1, 0, 0, "rag", "src/S.java", "S", None, None, 1.0, False, None)], "query_id long, provider_idx int, cand_idx long, source string, path string, symbol string, line_start int, content_hash string, normalized_score double, stale boolean, verified_state string")
    first = retrieve.rank(retrieve.merge(c), 10)
    hits = retrieve.neighbours(retrieve.seeds(first, nodes), nodes, edges, depth=1)
    again = retrieve.merge(c.unionByName(retrieve.graph_candidates(hits, nodes)))
    return retrieve.rank(again, 10).select("query_id", "path", "final_score", "rank")


@case("SELECT * FROM (VALUES ('src/AVO.java',1),('sql/tax.xml',2),('sql/tax_2026.xml',3),('sql/tax_2024.xml',4)) AS t(path,rank)")
def location_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations, then current files, then the newest year."""
    from pyspark.sql import Window

    p = values(spark, "('sql/tax_2024.xml'),('sql/tax.xml'),('src/AVO.java'),('sql/tax_2026.xml')", "path")
    return p.withColumn("rank", F.row_number().over(Window.orderBy(*retrieve.location_order(F.col("path")))))
