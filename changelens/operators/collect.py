"""Incremental collection: filter, first-wins, anti-join, roll-up; keyed writes as table transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.text import article_label, law_tier
from changelens.operators.evaluate import first_wins

#: Fixed values.
TIERS = ("", " 시행령", " 시행규칙")
#: Queries of a registry at most.
MOST_QUERIES = 1000


def whitelist(laws: DataFrame, decrees: bool = True) -> DataFrame:
    """``name``: every law with each tier's ending."""
    ends = F.array(*[F.lit(t) for t in (TIERS if decrees else TIERS[:1])])
    return laws.select(F.explode(F.transform(ends, lambda t: F.concat("name", t))).alias("name"))


def changed_since(feed: DataFrame, since: str, names: DataFrame) -> DataFrame:
    """Feed items promulgated at ``since`` or later whose name is on the list; the first of each law stays.

    Dates are YYYYMMDD texts and compare as such; ``ord`` is the order of arrival.
    """
    kept = feed.where(F.col("promulgation_date") >= since).join(names.withColumnRenamed("name", "n"), F.trim("law_name") == F.col("n"), "left_semi")
    return first_wins(kept, ["law_id"], "ord")


def effective_from(feed: DataFrame, start: str, names: DataFrame) -> DataFrame:
    """By effective date; the first of each law and date."""
    kept = feed.where(F.col("effective_date") >= start).join(names.withColumnRenamed("name", "n"), F.trim("law_name") == F.col("n"), "left_semi")
    return first_wins(kept, ["law_id", "effective_date"], "ord")


def admin_rules(rules: DataFrame, queries: DataFrame, since: str) -> DataFrame:
    """Rules whose name holds a query, issued at ``since`` or later; the first of each id by query, then arrival.

    Queries are a short list of a registry; they become one array, so no rule row is multiplied.
    """
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries")
    asked = [r.query for r in queries.orderBy("query_ord").select("query").collect()]
    found = rules.where((F.coalesce("rule_id", F.lit("")) != "") & (F.col("issued") >= since))
    pos = F.array_position(F.transform(F.array(*[F.lit(q) for q in asked]), lambda q: F.contains(F.trim("rule_name"), q)), F.lit(True)) if asked else F.lit(0)
    found = found.withColumn("query_ord", pos).where("query_ord > 0").withColumn("at", F.struct("query_ord", "ord"))
    kind = F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("행정규칙"))
    return first_wins(found, ["rule_id"], "at").withColumn("source", kind).drop("at")


def three_tier(refs: DataFrame) -> DataFrame:
    """``law_article, decree[], rule[]``: distinct references in order of arrival.

    ``refs``: article_no, article_branch, tier, law_name, no, branch, ord.
    """
    r = refs.select(
        article_label(F.col("article_no"), F.col("article_branch")).alias("law_article"), "tier", "ord",
        F.trim(F.concat_ws(" ", "law_name", article_label(F.col("no"), F.col("branch")))).alias("ref"),
    )
    one = r.groupBy("law_article", "tier", "ref").agg(F.min("ord").alias("first"))
    listed = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct("first", "ref")))), lambda x: x["ref"]).alias(t)
    return one.groupBy("law_article").agg(listed("decree"), listed("rule"))


def only_new(items: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key is not stored yet, each key once; nulls in a key are equal."""
    known, met = stored.select(*[F.col(k).alias(f"{k}_known") for k in keys]).distinct(), F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"{k}_known"))
    return first_wins(items.join(known, met, "left_anti"), keys, "ord")


def counts(items: DataFrame) -> DataFrame:
    """How many items of each tier and of each domain."""
    t = items.withColumn("tier", law_tier(F.col("law_name"), F.col("source")))
    both = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("name")) for c in ("tier", "domain")])
    return t.select(F.explode(both).alias("x")).groupBy("x.dimension", "x.name").agg(F.count("*").alias("n"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that no new row replaces, and the new rows: the same result however often it runs."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_source(stored: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """All rows of a source that comes anew are replaced."""
    return upsert(stored, new, [source])


def delete_source(stored: DataFrame, gone: DataFrame, source: str = "source") -> DataFrame:
    return stored.join(gone.select(source).distinct(), source, "left_anti")


def pending(work: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Work left: what is not done, and the last done item again, since it may be half done."""
    last = done.agg(F.max_by(key, "ord").alias(key))
    finished = done.select(key).distinct().join(last, key, "left_anti")
    return work.join(finished, key, "left_anti")


def select_mappings(mappings: DataFrame, threshold: float) -> DataFrame:
    """An article's verified mappings; where it has none, those at the threshold or above."""
    w = Window.partitionBy("article_id")
    m = mappings.withColumn("any", F.max(F.col("verified")).over(w))
    return m.where(F.when(F.col("any"), F.col("verified")).otherwise(F.col("confidence") >= threshold)).drop("any")
