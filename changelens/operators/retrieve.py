"""Candidates of many queries at once: merge, graph expansion, reranking by history, ranking."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.text import place_key
from changelens.schemas import CANDIDATES, EXCLUDED_DIRS
from changelens.sources.store import scratch

#: What a source's best evidence weighs, what an edge's kind scores, depth and breadth.
WEIGHTS = {"verified_mapping": 0.35, "constant_match": 0.25, "term_dictionary": 0.20, "rag": 0.15, "code_graph": 0.05, "historical_commit": 0.10}
EDGE_SCORES = {"service_to_mapper": 0.75, "uses_constant": 0.70, "test_to_service": 0.65, "contains": 0.60}
EDGE_KINDS = ("contains", "service_to_mapper")
MAX_DEPTH, MAX_NEIGHBOURS, SEEDS = 2, 20, 3
#: A provider takes queries and returns candidates; see ``schemas.CANDIDATES``.
Provider = Callable[[DataFrame], DataFrame]


def lookup(name: Column, table: dict[str, float]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[name], F.lit(0.0))


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def union_providers(queries: DataFrame, providers: list[Provider]) -> DataFrame:
    """Candidates of all providers, each row with its provider's place in the list."""
    out = None
    for k, p in enumerate(providers):
        got = p(queries).withColumn("provider_idx", F.lit(k))
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


#: What ends one source or stage and not the search: faults of planning and of running, not of the program.
FAULTS = (PySparkException, Py4JError)
STATUS = "source string, status string, candidates long, seconds double, message string"


def ask(queries: DataFrame, enabled: dict[str, Provider | None]) -> tuple[DataFrame, list[tuple]]:
    """(candidates of all sources that ran, a row of ``STATUS`` for each source).

    Each source is a job of its own, whose candidates are written before the next is asked, so one that fails, be it
    in the last of its tasks, takes nothing from the others.  All failing is an error; none enabled, an empty table.
    """
    spark, rows, good = queries.sparkSession, [], []
    for name, provider in enabled.items():
        if provider is None:
            rows.append((name, "disabled", 0, 0.0, ""))
            continue
        began = time.monotonic()
        try:
            got = scratch(provider(queries), f"source-{name}")
            n = got.count()
        except FAULTS as e:
            rows.append((name, "error", 0, time.monotonic() - began, f"{type(e).__name__}: {str(e).strip().splitlines()[0][:200] if str(e).strip() else ''}"))
            continue
        rows.append((name, "success", n, time.monotonic() - began, ""))
        good.append(lambda _, g=got: g)
    if not good and any(p is not None for p in enabled.values()):
        raise RuntimeError("all enabled providers failed")
    return (union_providers(queries, good) if good else spark.createDataFrame([], CANDIDATES)), rows


#: What a source has to show for a candidate.
EVIDENCE = {"raw_score": "double", "matched_terms": "array<string>", "matched_values": "array<string>"}


def _placed(candidates: DataFrame) -> DataFrame:
    """Candidates combined by query, place, source and hash, each with its place's key.

    Later steps group by what this step has dealt out by query and place, so they need no shuffle of their own.
    """
    named = F.coalesce("verified_state", F.lit("")) != ""
    shown = [F.col(c) if c in candidates.columns else F.lit(None).cast(t).alias(c) for c, t in EVIDENCE.items()]
    c = candidates.withColumn("base_key", place_key(F.col("path"), F.col("symbol"), F.col("line_start")))
    # a place with very many candidates is one row for each source and hash before anything else
    c = c.groupBy("query_id", "base_key", "source", "content_hash").agg(
        # of the best score, what arrived first
        F.max(F.struct("normalized_score", (-F.col("provider_idx")).alias("p"), (-F.col("cand_idx")).alias("c"), F.struct(*shown).alias("shown"))).alias("top"),
        F.min(F.struct("provider_idx", "cand_idx", "path", "symbol")).alias("first"),
        F.bool_and(F.coalesce("stale", F.lit(False))).alias("stale"),
        F.min(F.when(named, F.struct("provider_idx", "cand_idx", "verified_state"))).alias("named"),
    )
    first = F.min(F.struct("first.provider_idx", "first.cand_idx", "content_hash")).over(Window.partitionBy("query_id", "base_key"))["content_hash"]
    c = c.withColumn("first_hash", first)
    other = F.col("first_hash").isNotNull() & (F.col("first_hash") != "") & F.col("content_hash").isNotNull() & (F.col("content_hash") != "") & (F.col("first_hash") != F.col("content_hash"))
    return c.withColumn("other", other).withColumn("dedup_key", F.when(other, F.concat("base_key", F.lit("::hash:"), "content_hash")).otherwise(F.col("base_key")))


def hash_conflicts(candidates: DataFrame) -> DataFrame:
    """``query_id, base_key, hashes``: places whose candidates disagree about their content."""
    c = _placed(candidates).where("other")
    return c.groupBy("query_id", "base_key").agg(F.count_distinct("content_hash").alias("hashes"))


def shown_by(merged: DataFrame, source: str) -> DataFrame:
    """What one source has to show for merged candidates (with their evidence): a row for each that it supports."""
    e = merged.select("query_id", "path", "symbol", F.explode("evidence").alias("e")).where(F.col("e.source") == source)
    return e.select("query_id", "path", "symbol", F.col("e.raw_score").alias("score"), "e.normalized_score", "e.matched_terms", "e.matched_values")


def merge(candidates: DataFrame, evidence: bool = False) -> DataFrame:
    """One row per query and place.

    A source counts once, with its best evidence; sources add up by weight; two sources add 0.05, three
    0.10; a place whose candidates are all stale loses 0.50.  Rows arrive by (provider_idx, cand_idx).
    Where the first hash that arrives for a place is there, candidates with another hash are a place of
    their own.  ``evidence``: also what each source has to show, its best candidate's, by score.
    """
    by_source = _placed(candidates).groupBy("query_id", "base_key", "dedup_key", "source").agg(
        F.max("top").alias("top"), F.min("first").alias("first"), F.bool_and("stale").alias("stale"), F.min("named").alias("named")
    )
    # sources come sorted by place: a window takes them as they come, where grouping them in lists would sort them twice more
    sources = Window.partitionBy("query_id", "base_key", "dedup_key").orderBy("source")
    of_all = sources.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, count = F.col("top.normalized_score"), F.count("*").over(of_all)
    score = F.sum(F.round(lookup(F.col("source"), WEIGHTS) * best, 12)).over(of_all)
    bonus = F.when(count >= 3, 0.10).when(count >= 2, 0.05).otherwise(0.0)
    merged = by_source.select(
        "query_id", "dedup_key", F.min("first").over(of_all).alias("place"), F.row_number().over(sources).alias("nth"),
        F.round(clamp(score + bonus - F.when(F.bool_and("stale").over(of_all), 0.5).otherwise(0.0)), 6).alias("final_score"),
        count.alias("n_sources"),
        F.bool_and("stale").over(of_all).alias("stale"),
        F.min("named").over(of_all)["verified_state"].alias("verified_state"),
        F.array_sort(F.collect_list(F.struct((-best).alias("neg"), "source", F.col("top.shown").alias("shown"))).over(of_all)).alias("ev"),
    ).where("nth = 1")
    return merged.select(
        "query_id", "dedup_key", F.col("place.path").alias("path"), F.col("place.symbol").alias("symbol"), "final_score", "n_sources", "stale", "verified_state",
        F.array_join(F.transform("ev", lambda e: e["source"]), ",").alias("sources"), (-F.col("ev")[0]["neg"]).alias("strongest"),
        *([F.transform("ev", lambda e: F.struct(e["source"].alias("source"), (-e["neg"]).alias("normalized_score"), *[e["shown"][c].alias(c) for c in EVIDENCE])).alias("evidence")] if evidence else []),
    )


def rank(merged: DataFrame, k: int = 10) -> DataFrame:
    """1-based contiguous ranks by score, then path, then key; the k best of each query."""
    if k < 1:
        raise ValueError("k must be positive")
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "path", "dedup_key")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reuse_class(query_article: Column, query_type: Column, article: Column, change_type: Column, known: tuple[str, ...]) -> Column:
    """How far a decision's context carries over: exact, compatible or unrelated."""
    q, t = F.trim(F.coalesce(query_type, F.lit(""))), F.trim(F.coalesce(change_type, F.lit("")))
    same_article = (F.coalesce(query_article, F.lit("")) != "") & (F.coalesce(article, F.lit("")) != "") & (query_article == article)
    #: Kinds of change whose decisions carry over to one another.
    groups = (("value_change", "rate_change", "table_change"), ("condition_change", "new_field"))
    near = F.lit(False)
    for g in groups:
        near = near | (q.isin(*g) & t.isin(*g))
    both_known = q.isin(*known) & t.isin(*known)
    return F.when(~same_article | (q == "") | (t == ""), "unrelated").when(q == t, "exact").when(both_known & near, "compatible").otherwise("unrelated")


def rerank_delta(contexts: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """``query_id, dedup_key, delta`` from contexts with the query's article and type, and whether the
    merge already took off for staleness."""
    reuse = reuse_class(F.col("query_article_id"), F.col("query_change_type"), F.col("article_id"), F.col("change_type"), known)
    c = contexts.withColumn("reuse", reuse).where(F.col("reuse") != "unrelated")
    cents = lambda b, v: F.when(b, v).otherwise(0)  # noqa: E731  hundredths, so sums don't depend on order
    boost = F.when(F.col("reuse") == "exact", 35).otherwise(20) + cents(F.col("golden_confirmed"), 5) + cents(F.col("historical_match"), 5) - cents(F.col("legacy"), 15)
    rejected = (F.col("state") == "rejected") & (F.col("reuse") == "exact")
    agg = c.groupBy("query_id", "dedup_key").agg(
        F.sum(F.when(F.col("state") == "verified", boost).otherwise(0)).alias("up"),
        F.sum(F.when(rejected, -30).otherwise(0)).alias("down"),
        F.max(F.when(rejected, F.col("rejection_count")).otherwise(0)).alias("times"),
        F.bool_or(F.col("state") == "stale").alias("was_stale"),
        F.bool_or("merge_stale").alias("merge_stale"),
    )
    down = F.when(F.col("times") >= 2, F.least(F.col("down"), F.lit(-50))).otherwise(F.col("down"))
    stale = F.when(F.col("was_stale") & ~F.col("merge_stale"), -50).otherwise(0)
    return agg.select("query_id", "dedup_key", F.round(F.greatest(F.lit(-50), F.least(F.lit(45), F.col("up") + down + stale)) / 100.0, 6).alias("delta"))


def rerank(merged: DataFrame, deltas: DataFrame) -> DataFrame:
    """Scores moved by their history's delta, kept within 0 and 1."""
    moved = merged.join(deltas, ["query_id", "dedup_key"], "left")
    return moved.withColumn("final_score", F.round(clamp(F.col("final_score") + F.coalesce("delta", F.lit(0.0))), 6)).drop("delta")


def _stage(name: str, before: DataFrame, run: Callable[[], DataFrame], rows: list[tuple]) -> DataFrame:
    """A stage's written result; where it fails, what came before it.  Either way a row of ``STATUS``."""
    began = time.monotonic()
    try:
        out = scratch(run(), name)
    except FAULTS as e:
        rows.append((name, "error", 0, time.monotonic() - began, type(e).__name__))
        return before
    rows.append((name, "success", out.count(), time.monotonic() - began, ""))
    return out


def search(
    queries: DataFrame, enabled: dict[str, Provider | None], k: int = 10, graph: tuple[DataFrame, DataFrame] | None = None, deltas: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(ranked candidates with their evidence, a table of ``STATUS``: how each source and stage fared).

    Sources are asked and merged; the best places seed the graph ``(nodes, edges)``, and what it reaches is merged
    with them; ``deltas`` says what each place's history moves; only then are places ranked and cut at ``k``.
    """
    found, rows = ask(queries, enabled)
    merged = merge(found, evidence=True)

    def expanded() -> DataFrame:
        nodes, edges = graph
        hits = neighbours(seeds(rank(merged, SEEDS), nodes), nodes, edges)
        return merge(found.unionByName(graph_candidates(hits, nodes), allowMissingColumns=True), evidence=True)

    if graph is not None:
        merged = _stage("graph", merged, expanded, rows)
    if deltas is not None:
        merged = _stage("rerank", merged, lambda m=merged: rerank(m, deltas(m)), rows)
    return rank(merged, k), queries.sparkSession.createDataFrame(rows, STATUS)


def excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def seeds(merged_ranked: DataFrame, nodes: DataFrame, top: int = SEEDS) -> DataFrame:
    """``query_id, id``: nodes of the best places; those of the symbol's name, or else all of the path."""
    best = merged_ranked.where(F.col("rank") <= top).select("query_id", "path", "symbol")
    met = best.join(nodes.select("id", "name", "path"), "path").withColumn("named", F.col("name").eqNullSafe(F.col("symbol")))
    w = Window.partitionBy("query_id", "path", "symbol")
    return met.withColumn("any", F.max("named").over(w)).where(F.col("named") | ~F.col("any")).select("query_id", "id").distinct()


def neighbours(seeds_df: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = EDGE_KINDS, depth: int = 1, most: int = MAX_NEIGHBOURS) -> DataFrame:
    """``query_id, id, edge_kind, depth, via``: nodes reached along edges of the kinds, nearest first.

    Directed, each node once, seeds left out, two steps at most, nodes under excluded folders neither
    reported nor passed through.  Order within a depth: the path walked.
    """
    steps = min(depth, MAX_DEPTH)
    e = edges.where(F.col("kind").isin(*kinds)).select("src", "dst", "kind").distinct()
    ok = nodes.where(~excluded(F.col("path"))).select(F.col("id").alias("dst"))
    front = seeds_df.select("query_id", F.col("id").alias("at"), F.col("id").alias("via"))
    seen, out = seeds_df.select("query_id", "id"), None
    first = Window.partitionBy("query_id", "dst").orderBy("via", "kind")
    for d in range(1, steps + 1):
        step = front.join(e, front["at"] == e["src"]).select("query_id", "dst", "kind", F.concat("via", F.lit(" -["), "kind", F.lit("]-> "), "dst").alias("via"))
        step = step.join(seen.withColumnRenamed("id", "dst"), ["query_id", "dst"], "left_anti")
        step = step.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").join(ok, "dst", "left_semi")
        own = step.select("query_id", F.col("dst").alias("id"), F.col("kind").alias("edge_kind"), F.lit(d).alias("depth"), "via")
        out = own if out is None else out.unionByName(own)
        seen = seen.unionByName(own.select("query_id", "id"))
        front = own.select("query_id", F.col("id").alias("at"), "via")
    if out is None:
        raise ValueError("depth must be positive")
    w = Window.partitionBy("query_id").orderBy("depth", "via")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def graph_candidates(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits as candidates of the code graph, scored by the kind of their last edge."""
    place = nodes.select("id", "path", F.col("name").alias("symbol"))
    return hits.join(place, "id").select(
        "query_id", F.lit(99).alias("provider_idx"), F.xxhash64("via").alias("cand_idx"), F.lit("code_graph").alias("source"), "path", "symbol",
        F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("string").alias("content_hash"), lookup(F.col("edge_kind"), EDGE_SCORES).alias("normalized_score"),
        F.lit(False).alias("stale"), F.lit(None).cast("string").alias("verified_state"),
    )


def location_order(path: Column) -> list[Column]:
    """Declarations first, then files without a year, then the newest year, then the name."""
    year = F.coalesce(F.nullif(F.regexp_extract(F.lower(path), r"_(\d{4})\.", 1), F.lit("")).cast("int"), F.lit(9999))
    return [F.when(F.endswith(F.lower(path), F.lit(".java")), 0).otherwise(1), -year, path]
