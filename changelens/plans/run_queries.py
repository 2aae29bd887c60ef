"""Searches, replays, caches, logs and revisions, run over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators import index, replay_run, retrieve, revisions
from changelens.plans.catalogue import ORACLES, query, table
from changelens.plans.index_queries import const_inventory  # noqa: F401  registers the SQL that cached_inventory shares
from changelens.plans.retrieval_queries import _CTE, candidates
from changelens.sources import landed_feed, store
from changelens.streaming import collect_stream


def _fails(batches):
    """A source that fails while it runs, in its tenth batch or after its last."""
    for k, b in enumerate(batches):
        if k == 9:
            raise ValueError("the source is gone")
        yield b
    raise ValueError("the source is gone")


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = candidates(spark, sf_dir).drop("provider_idx")
    of = lambda name: lambda q: every.where(F.col("source") == name).join(q, "query_id", "left_semi")
    broken = lambda q: of("constant_match")(q).mapInArrow(_fails, every.schema)
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"))
    return retrieve.search(asked, {"rag": of("rag"), "term_dictionary": of("term_dictionary"), "constant_match": broken, "code_graph": None}, 10)


@query(_CTE.replace("FROM lineitem)", "FROM lineitem WHERE l_returnflag <> 'R')", 1) + " SELECT query_id, dedup_key, final_score, sources, rank FROM r WHERE rank <= 10")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of every supplier's candidates in which one source fails while it runs and one is off."""
    return _searched(spark, sf_dir)[0].select("query_id", "dedup_key", "final_score", "sources", "rank")


@query("""SELECT 'rag' AS source, 'success' AS status, count(*) FILTER (l_returnflag = 'A') AS candidates FROM lineitem UNION ALL SELECT 'term_dictionary', 'success', count(*) FILTER (l_returnflag = 'N') FROM lineitem
UNION ALL SELECT 'constant_match', 'error', 0 UNION ALL SELECT 'code_graph', 'disabled', 0""")
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of that search fared."""
    return _searched(spark, sf_dir)[1].select("source", "status", "candidates")


# --------------------------------------------------------------------------- revisions and replays
_VERSIONS = """v AS (SELECT concat('part/', p_partkey, '.java') AS path, 1 AS pos, p_size * 1000 + 10000 AS val FROM part
  UNION ALL SELECT concat('part/', p_partkey, '.java'), 2, p_size * 1000 + 20000 FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT concat('part/', p_partkey, '.java'), 3, -1 FROM part WHERE p_partkey % 10 = 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three versions of a file for each part; the last of every tenth deletes it."""
    p = table(spark, sf_dir, "part")
    path, text = F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".java")), lambda v: F.concat(F.lit("int limit = "), v.cast("string"), F.lit(";\n"))
    one = p.select(path.alias("path"), F.lit(1).alias("position"), text(F.col("p_size") * 1000 + 10000).alias("content"))
    two = p.where("p_partkey % 2 = 1").select(path.alias("path"), F.lit(2).alias("position"), text(F.col("p_size") * 1000 + 20000).alias("content"))
    gone = p.where("p_partkey % 10 = 0").select(path.alias("path"), F.lit(3).alias("position"), F.lit(None).cast("string").alias("content"))
    return one.unionByName(two).unionByName(gone).withColumn("repo", F.lit("parts"))


@query(f"""WITH {_VERSIONS}, q AS (SELECT l_orderkey AS case_id, l_linenumber % 4 AS r, concat('part/', l_partkey, '.java') AS path FROM lineitem GROUP BY ALL),
x AS (SELECT case_id, r, q.path, max(pos) AS pos, arg_max(val, pos) AS val FROM q JOIN v ON v.path = q.path AND pos <= r GROUP BY ALL)
SELECT case_id, r AS revision, path, pos AS position, concat('int limit = ', val, ';', chr(10)) AS content FROM x WHERE val >= 0""")
def files_at_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of every order line as it was at the line's revision."""
    asked = table(spark, sf_dir, "lineitem").select(F.struct(F.col("l_orderkey").alias("c"), (F.col("l_linenumber") % 4).alias("r")).alias("case_id"), F.lit("parts").alias("repo"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".java")).alias("path"), (F.col("l_linenumber") % 4).alias("position"))
    got = revisions.at_revision(_versions(spark, sf_dir), asked)
    return got.select(F.col("case_id.c").alias("case_id"), F.col("case_id.r").alias("revision"), "path", "position", "content")


@query(f"""WITH {_VERSIONS}, rev AS (SELECT unnest([1, 2, 3]) AS r), t AS (SELECT r, path, arg_max(val, pos) AS val FROM rev JOIN v ON pos <= r GROUP BY ALL),
b AS (SELECT r, val, path, row_number() OVER (PARTITION BY r, val ORDER BY path) AS n FROM t WHERE val >= 0 QUALIFY n <= 3),
c AS (SELECT o_orderkey AS case_id, 1 + o_orderkey % 3 AS r, concat('part/', p_partkey, '.java') AS wanted, p_size * 1000 + 10000 AS val FROM orders JOIN part ON p_partkey = o_orderkey % 200 + 1),
f AS (SELECT c.case_id, min(CASE WHEN path = wanted THEN n END) AS primary_rank, bool_or(path = wanted AND n = 1) AS first FROM c LEFT JOIN b ON b.r = c.r AND b.val = c.val GROUP BY c.case_id, wanted)
SELECT case_id, CAST(coalesce(primary_rank <= 1, false) AS INTEGER) AS recall_1, CAST(coalesce(primary_rank <= 3, false) AS INTEGER) AS recall_3, CAST(primary_rank AS INTEGER) AS primary_rank,
  CAST(coalesce(first, false) AS INTEGER) AS file_coverage, CAST(coalesce(first, false) AND case_id % 2 = 0 AS INTEGER) AS replacement_rate, coalesce(first, false) AND case_id % 2 = 0 AND case_id % 5 <> 0 AS passed FROM f""")
def replay_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay of every order: a part's limit is amended, files that hold it are searched for in the tree of the order's
    revision, the best is drafted, and the draft is judged."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    key, value = F.col("o_orderkey"), F.col("p_size") * 1000 + 10000
    c = o.join(p, p.p_partkey == key % 200 + 1).select(
        key.alias("case_id"), F.lit("parts").alias("repo"), (1 + key % 3).cast("int").alias("revision"), F.lit("법").alias("law_name"), F.lit("제1조").alias("article"),
        F.concat(F.lit("한도는 "), value.cast("string"), F.lit("원")).alias("before_text"), F.concat(F.lit("한도는 "), (value + 1).cast("string"), F.lit("원")).alias("after_text"),
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("wanted"), value.cast("string").alias("old"), (value + 1).cast("string").alias("new"),
    )
    c = store.scratch(c, "cases")
    root = f"{store.shared(spark)}/replay-{uuid.uuid4().hex}"
    _versions(spark, sf_dir).write.parquet(f"{root}/versions")
    first = lambda d: d.select("case_id", F.regexp_extract(F.get("snippets", F.lit(0)), r"^// (\S+)", 1).alias("diff_text"))
    found, drafts, _ = replay_run.run(c, f"{root}/versions", first, store.Cache(spark, f"{root}/cache"))
    touched = store.scratch(drafts.where("diff_text <> ''").select("case_id", F.col("diff_text").alias("path")), "touched")  # drafted once
    scoped = c.select("case_id", F.col("wanted").alias("path"), F.lit("in_scope").alias("scope"))
    expected = c.select("case_id", F.col("wanted").alias("path"), F.col("old").alias("before"), F.col("new").alias("after"), F.lit("exact").alias("match_mode"))
    generated = touched.join(c.select("case_id", F.col("old").alias("before"), F.col("new").alias("after")).hint("merge"), "case_id").where("case_id % 2 = 0")
    states = c.select("case_id", F.lit(None).cast("string").alias("failure_kind"), F.lit(True).alias("git_apply"), F.when(F.col("case_id") % 5 == 0, "failed").otherwise("passed").alias("golden_status"))
    m = replay_run.metrics(states, scoped, found, expected, generated, touched, c.select("case_id", F.lit(True).alias("ok")))
    whole = [F.col(x).cast("int").alias(x) for x in ("recall_1", "recall_3", "primary_rank", "file_coverage", "replacement_rate")]
    return m.select("case_id", *whole, "passed")


# --------------------------------------------------------------------------- caches and logs
def cached_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constants of all documents, built once and read from the cache the second time."""
    cache = store.Cache(spark, f"{store.shared(spark)}/cache-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for _ in range(2):
        out = cache.table("constants", {"documents": f"{sf_dir}/documents.parquet"}, lambda: index.constants(docs, "doc_id"))
    if len(cache.built) > 1 and not out.isEmpty():
        raise RuntimeError("the cache was not used")
    return out.select("value_key", "doc_id", "line_no", "excerpt", "ord")


query(ORACLES["const_inventory"])(cached_inventory)


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id % 3 < 2")
def log_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events committed to a log in three parts, read as of the second."""
    e = table(spark, sf_dir, "events")
    log = store.Log(spark, f"{store.shared(spark)}/log-{uuid.uuid4().hex}", ("event_id",))
    for k in range(3):
        log.append(e.where(F.col("user_id") % 3 == k))
    return log.read(2).select("event_id", "user_id", "event_type")


@query("SELECT event_id, concat('F-', strftime(ts, '%Y%m%d'), '-', printf('%04d', row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id))) AS name FROM events")
def daily_event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for every event with its number within the day."""
    from changelens.sources.sinks import event_ids

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("own"), "ts")
    return event_ids(e, "ts", "own").select(F.col("own").alias("event_id"), F.col("event_id").alias("name"))


# --------------------------------------------------------------------------- feeds and streams
def _landed(spark: SparkSession, sf_dir: str) -> str:
    """A folder of pages of a feed: a page for each document, a query for each tenth of them; every ninth page is broken."""
    folder = f"{store.shared(spark)}/feed-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents")
    item = F.struct(F.col("doc_id").cast("string").alias("법령ID"), F.col("source").alias("법령일련번호"), F.substring("text", 1, 40).alias("법령명한글"), F.lit("20260101").alias("공포일자"))
    body = F.when(F.col("doc_id") % 9 == 0, "<html>busy</html>").otherwise(F.to_json(F.struct(F.struct(F.when(F.col("doc_id") % 2 == 0, F.array(item)).otherwise(F.array(item, item)).alias("law")).alias("LawSearch"))))
    pages = d.select((F.col("doc_id") % 10).alias("q"), F.col("doc_id").alias("p"), body.alias("body"))

    def land(batches):
        """Each page becomes a file of its own, as a fetcher would leave it."""
        import os

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(root)
        for b in batches:
            for q, p, text in zip(*(b.column(c).to_pylist() for c in ("q", "p", "body")), strict=True):
                with where.open_output_stream(os.path.join(root, f"{q}-{p}.json")) as out:
                    out.write(text.encode())
            yield b.select(["p"])

    pages.mapInArrow(land, "p long").count()
    return folder


@query("""SELECT CAST(doc_id AS VARCHAR) AS law_id, coalesce(source, '') AS law_mst, coalesce(substring(text, 1, 40), '') AS law_name, pos FROM documents, unnest(CASE WHEN doc_id % 2 = 0 THEN [0] ELSE [0, 1] END) AS t(pos) WHERE doc_id % 9 <> 0""")
def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a landed feed of a page for each document, read by the feed's own data source."""
    items, _ = landed_feed.feed(spark, _landed(spark, sf_dir))
    return items.select("law_id", "law_mst", "law_name", F.col("ord.pos").alias("pos"))


@query("SELECT doc_id % 10 AS query_ord, doc_id AS page, 'a page of markup' AS error FROM documents WHERE doc_id % 9 = 0")
def feed_bad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of that feed that hold no answer."""
    return landed_feed.feed(spark, _landed(spark, sf_dir))[1]


@query("""SELECT CAST(l_linenumber AS VARCHAR) AS law_id, strftime(l_shipdate, '%Y%m01') AS promulgation_date, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY ALL""")
def collected_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines landed as items in two deliveries, of which the second brings the first once more, collected as a stream."""
    root = f"{store.shared(spark)}/stream-{uuid.uuid4().hex}"
    l = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    items = l.select(text("l_linenumber").alias("law_id"), F.lit("n").alias("law_name"), F.date_format("l_shipdate", "yyyyMM01").alias("promulgation_date"), F.lit(None).cast("string").alias("effective_date"), F.lit("law").alias("source"), F.lit("tax").alias("domain"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    one = items.join(items.where("law_id < '4'").select("law_id", "promulgation_date").distinct(), ["law_id", "promulgation_date"], "left_semi").select(*items.columns)
    for part in (one, items):
        part.write.mode("append").json(f"{root}/in")
        collect_stream.collect(spark, f"{root}/in", f"{root}/out", f"{root}/mark").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("law_id", "promulgation_date", "ord")
