"""The replay of past changes from end to end: index of the tree at the base revision, search, draft, metrics.

The index (constants and terms of each tree) is a cached table keyed by what it was made from, so cases that share a
revision, and later runs, don't read the tree again.  No verified mapping is a source, and no history reranks: a replay
may not look ahead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions import values
from changelens.functions.text import loose_path
from changelens.operators import evaluate, index, providers, replay, retrieve, revisions
from changelens.sources.store import Cache, scratch

#: Cut-offs of the recall, and what a draft is told, and where a side has no text.
RECALL_AT = (1, 3, 5, 10)
NO_TEXT = "(내용 없음)"
TITLES = ("[법령] ", "\n\n[개정 전]\n", "\n\n[개정 후]\n")


def query_text(law_name="law_name", article="article", before="before_text", after="after_text"):
    """What is searched for: name, article and both texts, those that are there."""
    parts = [F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in (law_name, article, before, after)]
    return F.concat_ws(" ", *parts)


def law_diff(law_name="law_name", article="article", before="before_text", after="after_text"):
    """What a draft is told of the change."""
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NO_TEXT))
    head = F.concat_ws(" ", *[F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in (law_name, article)])
    told = (head, said(before), said(after))
    return F.concat(*[x for title, text in zip(TITLES, told, strict=True) for x in (F.lit(title), text)])


def constants_of_trees(trees: DataFrame) -> DataFrame:
    """``repo, revision, value_key, path``: files that hold a constant, in each tree (``repo, revision, path, content``)."""
    key = F.to_json(F.struct("repo", "revision", "path"))
    rows = trees.select(key.alias("file"), F.col("content").alias("text"))
    found = index.every_constant(rows, "file").select("value_key", "file").distinct()
    at = F.from_json("file", trees.select("repo", "revision", "path").schema.simpleString())
    return found.select("value_key", at.alias("x")).select("x.repo", "x.revision", "value_key", "x.path")


def constant_source(cases: DataFrame, inventory: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A source of files that hold an amount or a rate of the case's text, in the case's own tree."""

    def find(queries: DataFrame) -> DataFrame:
        q = queries.join(cases.select(F.col("case_id").alias("query_id"), "repo", "revision").hint("merge"), "query_id")
        said = F.concat(values.said(F.col("text"), "money"), values.said(F.col("text"), "rate"))
        wanted = q.select("query_id", "repo", "revision", F.posexplode(said).alias("ord", "value_key")).groupBy("query_id", "repo", "revision", "value_key").agg(F.min("ord").alias("rank"))
        files = inventory.groupBy("repo", "revision", "value_key").agg(F.count_distinct("path").alias("files"))
        total = inventory.groupBy("repo", "revision").agg(F.count_distinct("path").alias("total"))
        digits = F.greatest(F.length(F.regexp_replace(F.replace("value_key", F.lit("."), F.lit("")), "^0+", "")), F.lit(1))
        scored = wanted.join(files, ["repo", "revision", "value_key"]).join(total, ["repo", "revision"]).withColumn("score", F.round(digits * F.log(1 + F.col("total") / F.col("files")), 2))
        return providers.constants(scored, inventory, ("repo", "revision"))

    return find


def retrieved(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """``case_id, path, rank``: ranked files, each at its best place alone, numbered anew."""
    best = ranked.withColumn("path", loose_path(F.col("path"))).where("path <> ''").groupBy(F.col("query_id").alias("case_id"), "path").agg(F.min("rank").alias("at"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("at"))).select("case_id", "path", "rank")


def metrics(cases: DataFrame, scoped: DataFrame, found: DataFrame, expected: DataFrame, generated: DataFrame, touched: DataFrame, checks: DataFrame) -> DataFrame:
    """Per case what a replay is judged by.

    ``cases``: case_id, failure_kind, git_apply, golden_status; ``scoped``: case_id, path, scope; ``found``: case_id, path,
    rank; ``expected``, ``generated``: case_id, path, before, after (and match_mode); ``touched``: case_id, path of the
    draft; ``checks``: case_id, ok.  A file that the fixture takes out of scope is never needless.
    """
    wanted = scoped.where("scope = 'in_scope'").select("case_id", "path").distinct()
    spared = scoped.where("scope IN ('in_scope', 'excluded')").select("case_id", "path").distinct()
    keys = expected.select("case_id", replay.replacement_key(F.col("path"), F.col("before"), F.col("after"), F.col("match_mode")).alias("key"))
    made = replay.generated_keys(generated)
    files = touched.select("case_id", loose_path(F.col("path")).alias("path")).distinct()
    own = evaluate.patch(keys, made, wanted, files).drop("unnecessary_rate")
    needless = evaluate.patch(keys, made, spared, files).select("case_id", "unnecessary_rate")
    hit = wanted.join(found.hint("merge"), ["case_id", "path"], "left")
    recall = hit.groupBy("case_id").agg(*[F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_{k}") for k in RECALL_AT], F.min("rank").alias("primary_rank"))
    sound = checks.groupBy("case_id").agg(F.bool_and("ok").alias("sound"))
    out = cases.select("case_id", "failure_kind", "git_apply", "golden_status")
    for part in (own, needless, recall, sound):
        out = out.join(part.hint("merge"), "case_id", "left")
    full = {"replacement_rate": 1.0, "file_coverage": 1.0, "jaccard": 1.0, "unnecessary_rate": 0.0} | {f"recall_{k}": 1.0 for k in RECALL_AT}
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in full.items()}).withColumn("fixture_ok", F.coalesce("sound", F.lit(True))).drop("sound")
    return evaluate.verdict(out)


def run(cases: DataFrame, versions_path: str, draft: Callable[[DataFrame], DataFrame], cache: Cache, rag: retrieve.Provider | None = None, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``case_id, path, rank``; what the draft returned; how each source fared).

    ``cases``: case_id, repo, revision, law_name, article, before_text, after_text; ``versions_path``: a table of repo,
    path, position, content; ``draft`` takes ``case_id, law, snippets`` (array, best first) and returns ``case_id,
    diff_text``; its faults are the caller's.
    """
    spark = cases.sparkSession
    versions = spark.read.parquet(versions_path)
    wanted = cases.select("repo", "revision").distinct()
    marks = wanted.agg(F.sum(F.xxhash64("repo", "revision").cast("decimal(38,0)")), F.count("*")).first()
    inventory = cache.table("replay-constants", {"versions": versions_path}, lambda: constants_of_trees(revisions.snapshot(versions, wanted)), trees=[str(x) for x in marks])
    queries = scratch(cases.select(F.col("case_id").alias("query_id"), query_text().alias("text")), "queries")
    ranked, status = retrieve.search(queries, {"rag": rag, "constant_match": constant_source(cases, inventory)}, k)
    paths = scratch(retrieved(ranked, cases), "retrieved")
    asked = paths.join(cases.select("case_id", "repo", F.col("revision").alias("position")).hint("merge"), "case_id")
    texts = revisions.at_revision(versions, asked.select(F.struct("case_id", "rank").alias("case_id"), "repo", "path", "position"))
    shown = texts.groupBy("case_id.case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("case_id.rank", F.concat(F.lit("// "), "path", F.lit("\n"), "content").alias("s")))), lambda x: x["s"]).alias("snippets")
    )  # k files a case at most
    told = cases.select("case_id", law_diff().alias("law")).join(shown.hint("merge"), "case_id", "left")
    return paths, draft(told.withColumn("snippets", F.coalesce("snippets", F.array().cast("array<string>")))), status
