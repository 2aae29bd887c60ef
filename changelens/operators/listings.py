"""What is listed and shown: changes, cases, mappings, drafts, work in order, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import law_tier

#: Letters of a text that a listing shows.
PREVIEW = 200


def changes(rows: DataFrame, domain: str | None = None) -> DataFrame:
    """Collected changes, newest first, with the tier that their name tells; of one domain if asked for."""
    kept = rows if domain is None else rows.where(F.col("domain") == domain)
    shown = kept.withColumn("tier", law_tier(F.coalesce("law_name", F.lit("")), F.coalesce("source", F.lit("law")))).withColumn("domain", F.coalesce("domain", F.lit("tax")))
    return shown.orderBy(F.desc("promulgation_date"), "id")


def preview(text: Column, most: int = PREVIEW) -> Column:
    """The beginning of a text, marked where it goes on."""
    return F.concat(F.substring(text, 1, most), F.when(F.length(text) > most, F.lit("…")).otherwise(F.lit("")))


def cases(rows: DataFrame, ids: list | None = None, tags: list[str] | None = None) -> DataFrame:
    """Cases with one of the ids, if there are any, and one of the tags, if there are any."""
    kept = rows.where(F.col("case_id").isin(ids)) if ids else rows
    return kept.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else kept


def mappings(changes_: DataFrame, known: DataFrame, verified_only: bool = False) -> DataFrame:
    """``change_id, id, path, symbol, confidence, verified, place`` of each change's article: verified ones first, then
    by confidence."""
    from pyspark.sql import Window

    article = F.concat_ws(":", "law_id", "article_no")
    m = known.where("verified") if verified_only else known
    met = changes_.select("change_id", article.alias("article_id")).join(m, "article_id")
    w = Window.partitionBy("change_id").orderBy(F.desc("verified"), F.desc("confidence"), "id")
    return met.withColumn("place", F.row_number().over(w)).select("change_id", "id", "path", "symbol", "confidence", "verified", "place")


def drafts(proposals: DataFrame, exposed: bool) -> DataFrame:
    """Proposals; their contents only where the setting lets them out."""
    plain = proposals.select("proposal_id", "law_change_id", "approval_status", "golden_status", "model_used", F.lit(exposed).alias("content_exposed"), *(["diff", "golden_output"] if exposed else []))
    return plain


def work_order(files: DataFrame, first: list[list[str]], path: str = "path") -> DataFrame:
    """``place``: files under the first list of path parts come first, then those of the next, then the rest; by path.

    ``place`` counts within a rank, so that no task holds all files.
    """
    from pyspark.sql import Window

    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    rank = F.lit(len(first))
    for k in range(len(first) - 1, -1, -1):
        hit = F.lit(False)
        for part in first[k]:
            hit = hit | F.contains(p, F.lit(part))
        rank = F.when(hit, k).otherwise(rank)
    return files.withColumn("rank", rank).withColumn("place", F.row_number().over(Window.partitionBy("rank", F.substring(F.sha2(path, 256), 1, 2)).orderBy(path)))


def query_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def index_key(*parts: Column) -> Column:
    """A key of sixteen digits for what is named by all parts; null where one is missing or empty."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & (F.coalesce(p, F.lit("")) != "")
    return F.when(whole, F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16))
