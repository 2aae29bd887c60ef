"""Candidate sources: vector hits, dictionary codes, constants, verified mappings; and what is read for a draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.text import place_key
from changelens.operators import index
from changelens.operators.retrieve import clamp, location_order


def _candidate(df: DataFrame, source: str, score: Column, path: str = "path", symbol: str = "symbol", order: Column | None = None, stale: Column | None = None, state: Column | None = None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        "query_id", (order if order is not None else F.lit(0)).cast("long").alias("cand_idx"), F.lit(source).alias("source"), F.col(path).alias("path"), F.col(symbol).cast("string").alias("symbol"),
        none("int").alias("line_start"), none("string").alias("content_hash"), score.alias("normalized_score"), (stale if stale is not None else F.lit(False)).alias("stale"), (state if state is not None else none("string")).alias("verified_state"),
    )


def rag(hits: DataFrame) -> DataFrame:
    """``query_id, path, symbol, score, rank``: similarity kept within 0 and 1."""
    return _candidate(hits, "rag", clamp(F.col("score")), order=F.col("rank"))


def _top_places(matches: DataFrame, places: DataFrame, key: str, within: tuple[str, ...] = (), k: int = 3) -> DataFrame:
    """Each match at the first files of its key, which are found for each key before they meet the queries."""
    w = Window.partitionBy(*within, key).orderBy(*location_order(F.col("path")))
    first = places.select(*within, key, "path").distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return matches.join(first, [*within, key])


def dictionary(matches: DataFrame, places: DataFrame) -> DataFrame:
    """Codes matched (``query_id, code, score, rank``) at their three best files."""
    score = F.round(F.least(F.lit(0.99), 0.7 + F.col("score") / 100), 3)
    return _candidate(_top_places(matches, places, "code"), "term_dictionary", score, symbol="code", order=F.col("rank") * 10 + F.col("place"))


def constants(matches: DataFrame, inventory: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Values matched (``query_id, value_key, score, rank``) at their three best files; ``within``: columns of both that
    name the tree to look in."""
    score = F.round(F.least(F.lit(0.99), 0.75 + F.col("score") / 40), 3)
    return _candidate(_top_places(matches, inventory, "value_key", within), "constant_match", score, symbol="value_key", order=F.col("rank") * 10 + F.col("place"))


def verified(mappings: DataFrame, files: DataFrame) -> DataFrame:
    """Verified mappings of a query; one whose file is gone is stale and scores nothing."""
    there = mappings.join(files.select(F.col("path").alias("p"), F.lit(True).alias("there")).distinct(), F.col("path") == F.col("p"), "left")
    ok = F.col("there").isNotNull()
    return _candidate(there, "verified_mapping", F.when(ok, 1.0).otherwise(0.0), stale=~ok, state=F.lit("approved"))


def fixture_contexts(candidates: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Decision fixtures at candidates' places: the path agrees, and the symbol, where the fixture has one."""
    c = candidates.select("query_id", place_key(F.col("path"), F.col("symbol"), F.col("line_start")).alias("dedup_key"), F.col("path").alias("cp"), F.col("symbol").alias("cs")).distinct()
    return c.join(fixtures, (F.col("cp") == F.col("path")) & (F.col("symbol").isNull() | (F.col("symbol") == F.col("cs")))).drop("cp", "cs", "path", "symbol")


def usages(files: DataFrame, classes: DataFrame, most: int = 5) -> DataFrame:
    """``name, path, ord``: the first files that hold a class's name."""
    src = files.where(F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)).isin(".java", ".kt", ".py"))
    found = index.contained(src, classes.select(F.col("name").alias("term")), "path").withColumnRenamed("term", "name")
    w = Window.partitionBy("name").orderBy("path")
    return found.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most)


def snippets(mappings: DataFrame, files: DataFrame, places: DataFrame) -> DataFrame:
    """``path, snippet, ord``: mapped files, then three usages of each class, then declarations of codes; the
    first mention of a path wins.  ``mappings``: path, symbol, ord, and change_id, if there are several changes."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    if "change_id" not in mappings.columns:
        return snippets(mappings.withColumn("change_id", F.lit(0)), files, places).drop("change_id")
    own = mappings.select("change_id", "path", F.struct(F.lit(0).alias("k"), "ord", F.lit(0).alias("n")).alias("at"), F.lit("").alias("why"))
    named = mappings.select("change_id", stem.alias("name"), F.col("ord").alias("o"))
    used = usages(files, named, 3).join(named, "name").select("change_id", "path", F.struct(F.lit(1).alias("k"), F.col("o").alias("ord"), F.col("ord").alias("n")).alias("at"), F.concat(F.lit(" [usage: "), "name", F.lit("]")).alias("why"))
    codes = mappings.where(F.col("symbol").rlike("^[a-z][0-9]{4}$")).select("change_id", F.col("symbol").alias("code"), F.col("ord").alias("o"))
    vo = places.where(F.endswith("path", F.lit(".java"))).join(codes, "code").select("change_id", "path", F.struct(F.lit(2).alias("k"), F.col("o").alias("ord"), F.col("ord").alias("n")).alias("at"), F.concat(F.lit(" [declares: "), "code", F.lit("]")).alias("why"))
    every = own.unionByName(used).unionByName(vo)
    first = every.groupBy("change_id", "path").agg(F.min(F.struct("at", "why")).alias("f"))
    got = first.join(files.select("path", "text"), "path")
    order = F.row_number().over(Window.partitionBy("change_id").orderBy("f.at"))
    return got.select("change_id", "path", F.concat(F.lit("// "), "path", F.col("f.why"), F.lit("\n"), "text").alias("snippet"), order.alias("ord"))


def answer_rank(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """``case_id, rank``: the first file that is an answer by path or by its own name; null if none."""
    base = lambda c: F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), r"([^/]+)$", 1)
    slash = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    # an equal path has an equal name, so one equi-join on the name finds both
    a = answers.select("case_id", base(F.col("answer")).alias("b")).distinct()
    hit = ranked.select("case_id", base(slash(F.col("path"))).alias("b"), "rank").join(a, ["case_id", "b"])
    best = hit.groupBy("case_id").agg(F.min("rank").alias("rank"))
    return answers.select("case_id").distinct().join(best, "case_id", "left")


def performed(expected: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Expected replacements that a draft made: the old was there, is gone, and the new is there."""
    from changelens.functions.text import holds, loose_path

    e = expected.withColumn("path", loose_path(F.col("path")))
    j = e.join(before.select(F.col("path"), F.col("content").alias("b")), "path").join(after.select("path", F.col("content").alias("a")), "path")
    m = F.col("match_mode")
    ok = (F.col("a") != F.col("b")) & holds(F.col("b"), F.col("before"), m) & holds(F.col("a"), F.col("after"), m) & ~holds(F.col("a"), F.col("before"), m)
    return j.where(ok).select("path", "before", "after")


def reparse(changes: DataFrame) -> DataFrame:
    """Rows whose amendment stands where the text before should be are parsed anew, once."""
    from changelens.operators.changes import derive, parse_amendment

    old = F.col("amendment_text").isNull() & (F.col("source") == "law") & (F.coalesce("before_text", F.lit("")) != "")
    todo, rest = changes.where(old), changes.where(~F.coalesce(old, F.lit(False)))
    parsed = todo.withColumn("d", derive(parse_amendment("before_text"), F.col("before_text")))
    new = parsed.withColumn("amendment_text", F.col("before_text")).withColumn("reason_text", F.col("after_text")).withColumn("before_text", F.col("d.before")).withColumn("after_text", F.col("d.after")).drop("d")
    return rest.unionByName(new.select(*changes.columns))
