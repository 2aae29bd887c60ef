"""Landed feeds, registries, evaluation sets and version-control listings as tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from changelens.functions.lazy import vectorised

ITEM = "struct<`법령ID`:string,`법령일련번호`:string,`법령명한글`:string,`공포일자`:string,`시행일자`:string>"


def law_items(raw: DataFrame) -> DataFrame:
    """Items of landed responses ``body``; one item alone may stand where a list is meant."""
    many = F.from_json("body", f"struct<LawSearch:struct<law:array<{ITEM}>>>")["LawSearch"]["law"]
    one = F.from_json("body", f"struct<LawSearch:struct<law:{ITEM}>>")["LawSearch"]["law"]
    items = F.when(F.get_json_object("body", "$.LawSearch.law[0]").isNotNull(), many).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{ITEM}>"))
    text = lambda c: F.coalesce(F.col(f"i.`{c}`"), F.lit(""))
    return raw.select("query_ord", F.posexplode(items).alias("pos", "i")).select(
        text("법령ID").alias("law_id"), text("법령일련번호").alias("law_mst"), text("법령명한글").alias("law_name"), text("공포일자").alias("promulgation_date"),
        text("시행일자").alias("effective_date"), F.lit("law").alias("source"), F.struct("query_ord", "pos").alias("ord"),
    )


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(domains, items) of a registry file; an empty registry is an error."""
    body = spark.read.option("wholetext", "true").text(path)
    domain = "struct<label:string,laws:array<string>,admin_rule_queries:array<string>,db_items:array<struct<law_id:string,article_pattern:string,item_label:string,db_hint:string,guidance:string>>>"
    rows = body.select(F.explode(F.from_json("value", f"map<string,{domain}>")).alias("key", "d"))
    if rows.isEmpty():
        raise ValueError("the registry names no domain")
    items = rows.select("key", F.posexplode("d.db_items").alias("ord", "i")).select("key", "i.*", "ord")
    return rows.select("key", "d.label", "d.laws", "d.admin_rule_queries"), items


@vectorised("string")
def collected_text(body: pd.Series, keys: pd.Series) -> pd.Series:
    """Texts below any of the comma-separated keys of nested JSON, in order, whole."""

    def walk(node, inside, wanted, out):
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, inside or k in wanted, wanted, out)
        elif isinstance(node, list):
            for v in node:
                walk(v, inside, wanted, out)
        elif inside and isinstance(node, str) and node.strip():
            out.append(node.strip())

    def one(b, k):
        out: list[str] = []
        try:
            walk(json.loads(b), False, set((k or "").split(",")), out)
        except (TypeError, ValueError):
            return ""
        return "\n".join(out)

    return pd.Series([one(b, k) for b, k in zip(body, keys)])


#: Where a law's detail holds its amendment and its reason, and a rule's its text.
AMENDMENT, REASON = ("개정문", "개정문내용"), ("제개정이유", "제개정이유내용")
RULE_TEXTS = ("조문내용", "부칙", "개정문내용", "제개정이유내용")
#: Fixed value: a rule's text of fewer letters is followed by that of its attachment.
SHORT_TEXT = 50


def _content(body: Column, outer: str, inner: str) -> Column:
    """Lines that aren't blank of a list, or of the first list in it."""
    at = f"$.법령.{outer}.{inner}"
    flat = F.from_json(F.get_json_object(body, at), "array<string>")
    nested = F.from_json(F.get_json_object(body, at + "[0]"), "array<string>")
    is_list = F.startswith(F.trim(F.get_json_object(body, at)), F.lit("["))
    is_nested = F.startswith(F.ltrim(F.coalesce(F.get_json_object(body, at + "[0]"), F.lit(""))), F.lit("[")) & F.startswith(F.regexp_replace(F.get_json_object(body, at), r"\s", ""), F.lit("[["))
    lines = F.when(is_nested, nested).when(is_list, flat)
    return F.coalesce(F.array_join(F.filter(lines, lambda s: F.trim(s) != ""), "\n"), F.lit(""))


def law_details(raw: DataFrame) -> DataFrame:
    """Landed details ``body`` -> the columns of ``raw`` and ``article_no, amendment_text, reason_text, before_text,
    after_text, amendment_parsed``; before and after come from the amendment's edits."""
    from changelens.functions.text import article_number
    from changelens.operators.changes import derive, parse_amendment

    own = [c for c in raw.columns if c != "body"]
    d = raw.select(*own, _content(F.col("body"), *AMENDMENT).alias("amendment_text"), _content(F.col("body"), *REASON).alias("reason_text"))
    d = d.withColumn("edits", parse_amendment("amendment_text"))
    d = d.withColumn("derived", derive(F.col("edits"), F.col("amendment_text")))
    return d.select(*own, article_number(F.col("amendment_text")).alias("article_no"), "amendment_text", "reason_text", F.col("derived.before").alias("before_text"), F.col("derived.after").alias("after_text"), (F.size("edits") > 0).alias("amendment_parsed"))


def rule_details(raw: DataFrame) -> DataFrame:
    """Landed rules ``body, attachment`` -> their whole text as what is after; a short one with its attachment's text,
    which whoever lands the rule has taken from the file."""
    from changelens.functions.text import article_number

    own = [c for c in raw.columns if c not in ("body", "attachment")]
    text = collected_text("body", F.lit(",".join(RULE_TEXTS)))
    d = raw.select(*own, "attachment", text.alias("text"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    whole = F.when(F.length("text") < SHORT_TEXT, strip(F.concat("text", F.lit("\n\n"), F.coalesce("attachment", F.lit(""))))).otherwise(F.col("text"))
    return d.select(*own, article_number(whole).alias("article_no"), whole.alias("after_text"), F.lit("").alias("before_text"), F.lit("").alias("amendment_text"), F.lit("").alias("reason_text"), F.lit(False).alias("amendment_parsed"))


#: What an evaluation case must satisfy: a name and a SQL condition for each rule.
CASE_RULES = {
    "case_id": "case_id IS NOT NULL AND case_id <> ''",
    "change_type": "change_type IN ('value_change','rate_change','date_change','condition_change','structural_change','table_change','new_field','no_code_impact','unknown')",
    "timeout": "timeout_seconds BETWEEN 1 AND 3600",
    "overlap": "NOT arrays_overlap(relevant_files, forbidden_files)",
    "top_k": "forall(top_k, k -> k > 0)",
}


def validate(cases: DataFrame) -> DataFrame:
    """``case_id, errors``: every rule that a case breaks; all are told at once, repeated ids too."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in CASE_RULES.items()]))
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("duplicate").alias("twice"))
    return cases.select("case_id", failed.alias("failed")).join(twice, "case_id", "left").select("case_id", F.array_join(F.array_compact(F.concat("failed", F.array("twice"))), ",").alias("errors"))


@vectorised("array<struct<status:string,path:string>>")
def name_status(output: pd.Series) -> pd.Series:
    """Entries of a NUL-separated listing; renames and copies count under their new path."""

    def one(s):
        t, out = [x for x in (s or "").split("\0") if x], []
        it = iter(t)
        for status in it:
            path = next(it)
            if status[0] in "RC":
                path = next(it)
            out.append({"status": status, "path": path})
        return out

    return output.map(one)


@vectorised("array<struct<path:string,added:int,removed:int>>")
def num_stat(output: pd.Series) -> pd.Series:
    """Counts of a NUL-separated listing; binary files count none."""

    def one(s):
        it, out = iter([x for x in (s or "").split("\0") if x]), []
        for entry in it:
            added, removed, path = entry.split("\t", 2)
            if not path:
                next(it)
                path = next(it)
            out.append({"path": path, "added": int(added) if added.isdigit() else 0, "removed": int(removed) if removed.isdigit() else 0})
        return out

    return output.map(one)
