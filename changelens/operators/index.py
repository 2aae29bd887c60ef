"""Dictionaries harvested from text: constants by value, terms by code, and their matching."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.values import is_law_constant, number_key
from changelens.sources.store import scratch

#: Fixed values.
MAX_PLACES, EXCERPT, TERM_LETTERS = 12, 160, 3
NUMBER = r"^(\d+\.\d+|\d{1,3}(?:_\d{3})+|\d{4,})[Ll]?$"
SMALL = r"^(\d{1,3})[Ll]?$"
UNIT_WORDS = r"(?i)시간|주당|연차|휴가|휴직|일수|개월|나이|연령|임금|수당|연장|야간|근로|hour|week|day|month|age|wage|overtime|annual|leave"


def lines(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``<key>, line_no (from 1), line``."""
    flat = F.regexp_replace(text, r"\r\n?", "\n")
    return texts.select(key, F.posexplode(F.split(flat, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def every_constant(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``value_key, <key>, line_no, excerpt``: all places of numbers that may be legal constants.

    A literal stands alone: no letter, digit, underscore or dot touches it, so it is a whole run of such
    characters.  Small whole numbers count only in lines that name a unit.  A value counts once a line.
    """
    l = lines(texts, key, text).where(F.col("line").rlike(r"\d"))
    runs = F.split("line", r"[^\p{L}\p{N}_.]+")
    number = lambda t, p: F.replace(F.regexp_extract(t, p, 1), F.lit("_"), F.lit("")).cast("double")
    big = F.filter(F.transform(F.filter(runs, lambda t: t.rlike(NUMBER)), lambda t: number(t, NUMBER)), is_law_constant)
    small = F.filter(F.transform(F.filter(runs, lambda t: t.rlike(SMALL)), lambda t: number(t, SMALL)), lambda v: v.between(2, 999))
    found = F.concat(big, F.when(F.col("line").rlike(UNIT_WORDS), small).otherwise(F.array().cast("array<double>")))
    rows = l.select(key, "line_no", F.substring(F.trim("line"), 1, EXCERPT).alias("excerpt"), F.explode(F.array_distinct(found)).alias("v"))
    return rows.select(number_key(F.col("v")).alias("value_key"), key, "line_no", "excerpt").distinct()


def constants(texts: DataFrame, key: str = "path", text: str = "text", most: int = MAX_PLACES) -> DataFrame:
    """``value_key, <key>, line_no, excerpt, ord``: of each value its first places (see ``every_constant``)."""
    rows = every_constant(texts, key, text)
    w = Window.partitionBy("value_key").orderBy(key, "line_no")
    return rows.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most)


def match_constants(amounts: DataFrame, inventory: DataFrame, key: str = "path", k: int = 8) -> DataFrame:
    """``change_id, value_key, expression, score, files, rank`` of ``(change_id, value_key, expression, ord)``.

    A value scores its digits times the log of one plus files over its files; ties keep the text's order.
    """
    n = inventory.select(key).distinct().count()
    per = inventory.groupBy("value_key").agg(F.count_distinct(key).alias("files"))
    digits = F.greatest(F.length(F.regexp_replace(F.replace("value_key", F.lit("."), F.lit("")), "^0+", "")), F.lit(1))
    m = amounts.join(per, "value_key").withColumn("score", F.round(digits * F.log(1 + F.lit(float(n or 1)) / F.col("files")), 2))
    w = Window.partitionBy("change_id").orderBy(F.desc("score"), "ord")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def document_frequency(terms: DataFrame) -> DataFrame:
    """``term, df``: codes that have the term."""
    return terms.groupBy("term").agg(F.count_distinct("code").alias("df"))


#: Letters of dictionary in one automaton; a larger dictionary is searched in parts, one pass each.
PART_LETTERS = 8_000_000


def _finder(terms: list[str]):
    """All terms found in a text."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return lambda text: {t for _, t in a.iter(text)}


def contained(texts: DataFrame, terms: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``<key>, term`` for every distinct term that a text holds as a substring.

    Linear in the text whatever the dictionary's size: an automaton is broadcast for each part of the
    dictionary of at most PART_LETTERS letters, and its size is checked by a sum before it is built.  Where there are
    several, the hits of each are written and its broadcast is released before the next is read.
    """
    spark = texts.sparkSession
    t = terms.select("term").where(F.length("term") > 0).distinct()
    total = t.agg(F.sum(F.length("term"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_LETTERS))
    kind, out = texts.schema[key].dataType.simpleString(), None
    for p in range(parts):
        words = spark.sparkContext.broadcast([r.term for r in t.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p).collect()])

        def run(batches, words=words):
            find = _finder(words.value)
            for b in batches:
                at, hit = [], []
                for k, s in enumerate(b.column(text).to_pylist()):
                    own = sorted(find(s)) if s and words.value else []
                    at += [k] * len(own)
                    hit += own
                yield pa.record_batch([b.column(key).take(pa.array(at, pa.int64())), pa.array(hit, pa.string())], names=[key, "term"])

        got = texts.select(key, text).mapInArrow(run, f"{key} {kind}, term string")
        if parts > 1:
            got = scratch(got, "contained")
            words.unpersist()
        out = got if out is None else out.unionByName(got)
    return out


def match_codes(texts: DataFrame, terms: DataFrame, key: str, k: int = 8) -> DataFrame:
    """``<key>, code, term, score, rank``: each code's best term in a text, length times the log of one plus
    codes over the term's codes; ties go to the smaller code.  ``terms``: code, term."""
    n = max(1, terms.select("code").distinct().count())
    df = document_frequency(terms)
    hits = contained(texts, terms, key).join(terms.select("code", "term").distinct(), "term").join(df, "term")
    s = F.length("term") * F.log(1 + F.lit(float(n)) / F.col("df"))
    best = hits.groupBy(key, "code").agg(F.max_by("term", F.struct(s.alias("s"), F.col("term"))).alias("term"), F.round(F.max(s), 2).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "code")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def labels(rows: DataFrame) -> DataFrame:
    """``code, labels``: labels by how often they stand with the code, ties by where they first do.
    ``rows``: code, label, ord."""
    c = rows.groupBy("code", "label").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    held = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "label")))
    return c.groupBy("code").agg(F.transform(held, lambda x: x["label"]).alias("labels"))


def clean_label(label):
    """A comment's text without markup, tabs and edge marks."""
    s = F.regexp_replace(label, r"<!--|-->|!--", " ")
    s = F.regexp_replace(s, r"[<\t].*$", "")
    return F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r"^[ \t\r\n*/\-_]+|[ \t\r\n*/\-_]+$", "")


def harvest_terms(files: DataFrame) -> DataFrame:
    """``code, label, ord`` of the labelled lines of ``path, text``: code before a comment, label within."""
    l = lines(files).where(F.col("line").rlike("[가-힣]")).withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)))
    java = r"private\s+\w[\w<>\[\]]*\s+([a-z][0-9]{4})\b.*?//\s*(.+)$"
    js, sql = r"^(.*?)//\s*(.+)$", r"^(.*?)--\s*(.+)$"
    code = lambda p: F.regexp_extract(F.regexp_extract("line", p, 1), r"\b[a-z][0-9]{4}\b", 0)
    found = l.select(
        "path",
        "line_no",
        F.when(F.col("ext") == ".java", F.regexp_extract("line", java, 1)).when(F.col("ext") == ".xfdl", code(js)).otherwise(code(sql)).alias("code"),
        clean_label(F.when(F.col("ext") == ".java", F.regexp_extract("line", java, 2)).when(F.col("ext") == ".xfdl", F.regexp_extract("line", js, 2)).otherwise(F.regexp_extract("line", sql, 2))).alias("label"),
    ).where((F.col("code") != "") & F.col("label").rlike("[가-힣]"))
    return found.select("code", "label", F.struct("path", "line_no").alias("ord"))


def label_terms(labelled: DataFrame) -> DataFrame:
    """``code, term``: runs of at least three Hangul letters in the labels."""
    return labelled.select("code", F.explode(F.split("label", "[^가-힣]+")).alias("term")).where(F.length("term") >= TERM_LETTERS).distinct()


def code_places(files: DataFrame, most: int = MAX_PLACES) -> DataFrame:
    """``code, path, ord``: files in which a code stands, declarations first, the first ones kept."""
    found = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([a-z][0-9]{4})\b"), F.lit(1)))).alias("code"))
    w = Window.partitionBy("code").orderBy(F.when(F.endswith(F.lower("path"), F.lit(".java")), 0).otherwise(1), "path")
    return found.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most)


def distinct_labels(labels_col, k: int = 2):
    """At most k labels, the most Hangul first; one that shares more than 0.6 of its letters with a chosen one
    is passed over, unless nothing would be chosen."""
    hangul = lambda s: F.regexp_extract_all(s, F.lit("([가-힣])"), F.lit(1))
    ranked = F.transform(
        F.array_sort(
            F.transform(F.filter(labels_col, lambda s: s.rlike("[가-힣]")), lambda s: F.struct((-F.size(hangul(s))).alias("h"), (-F.length(s)).alias("n"), s.alias("s")))
        ),
        lambda x: x["s"],
    )
    near = lambda s, c: F.size(F.array_intersect(hangul(s), hangul(c))) / F.greatest(F.lit(1), F.size(F.array_distinct(hangul(s)))) > 0.6
    chosen = F.aggregate(
        ranked, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) >= k) | F.exists(acc, lambda c: near(s, c)), acc).otherwise(F.concat(acc, F.array(s)))
    )
    return F.when(F.size(chosen) == 0, F.slice(ranked, 1, 1)).otherwise(chosen)


def headers(chunks: DataFrame, labelled: DataFrame, most: int = 60) -> DataFrame:
    """``chunk_id, doc``: a line that names the chunk's known codes in first-seen order leads it."""
    seen = chunks.select("chunk_id", F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([a-z][0-9]{4})\b"), F.lit(1)))).alias("pos", "code"))
    named = seen.join(labelled.select("code", F.array_join(distinct_labels(F.col("labels")), " / ").alias("label")), "code")
    w = Window.partitionBy("chunk_id").orderBy("pos")
    top = named.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    terms = top.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("code", F.lit("="), "label").alias("t")))), lambda x: x["t"]), "; ").alias("terms"))
    return chunks.join(terms, "chunk_id", "left").select("chunk_id", F.when(F.col("terms").isNull(), F.col("text")).otherwise(F.concat(F.lit("[관련 항목] "), "terms", F.lit("\n"), "text")).alias("doc"))
