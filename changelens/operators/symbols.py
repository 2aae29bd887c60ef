"""Symbols of source files and the edges between them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import tokens
from changelens.functions.lazy import vectorised
from changelens.operators import index
from changelens.sources.store import scratch

NODE = "array<struct<id:string,kind:string,name:string,container:string>>"


def java_nodes(path: str, text: str) -> list[dict]:
    """Types, methods and constants by one walk over the tokens, with a stack of what is open.

    What stands before a brace or semicolon tells what it opens or ends.  Methods within methods are no
    symbols of their own.  Braces that don't match raise.
    """
    read = tokens.read(text)
    package = ""
    for k, t in enumerate(read):
        if t == "package" and ";" in read[k:]:
            package = "".join(read[k + 1 : read.index(";", k)])
            break
        if t in ("{", "}"):
            break
    scope: list[tuple[str, str]] = []
    out, head = [], []
    for t in read:
        if t not in ("{", "}", ";"):
            head.append(t)
            continue
        owner = next((n for k, n in reversed(scope) if k == "type"), None)
        constant = tokens.declared_constant(head) if owner else None
        if constant:
            out.append({"id": f"const:{owner}.{constant}", "kind": "constant", "name": str(constant), "container": owner})
        if t == "}":
            if not scope:
                raise ValueError("unbalanced braces")
            scope.pop()
        elif t == "{":
            kind, name = "block", ""
            a_type = tokens.declared_type(head)
            method = tokens.declared_method(head) if owner and not a_type else None
            if a_type:
                parent = owner or package or None
                kind, name = "type", f"{parent}.{a_type}" if parent else str(a_type)
                out.append({"id": f"java:{name}", "kind": "java_class", "name": str(a_type), "container": parent})
            elif method and not any(k == "method" for k, _ in scope):
                kind = "method"
                test = "test" in path.lower() or any(x == "@" and y == "Test" for x, y in zip(head, head[1:]))
                out.append({"id": f"{'test' if test else 'java'}:{owner}#{method}", "kind": "test_method" if test else "java_method", "name": str(method), "container": owner})
            scope.append((kind, name))
        head = []
    if scope:
        raise ValueError("unbalanced braces")
    return out


@vectorised(f"struct<nodes:{NODE},error:string>")
def _java(path: pd.Series, text: pd.Series) -> pd.DataFrame:
    nodes, errors = [], []
    for p, t in zip(path, text):
        try:
            nodes.append(java_nodes(p or "", t or ""))
            errors.append(None)
        except ValueError as e:  # one broken file doesn't end the harvest; it is counted
            nodes.append([])
            errors.append(str(e))
    return pd.DataFrame({"nodes": nodes, "error": errors})


def _first(nodes: DataFrame) -> DataFrame:
    """The first node of each id, by path and place."""
    return nodes.groupBy("id").agg(F.min_by(F.struct("kind", "name", "path", "container"), F.struct("path", "pos")).alias("n")).select("id", "n.*")


def _attribute(tag, name: str):
    """An attribute's value in a tag, whichever its quotes; empty if it isn't there."""
    given = F.regexp_extract(tag, rf"(?i)(?<![\w-]){name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    return F.substring(given, F.lit(2), F.length(given) - 2)


def _tags(body, *names: str):
    """The opening tags of the given elements, in order."""
    every = F.regexp_extract_all(body, F.lit(r"<\s*[A-Za-z][^>]*>"), F.lit(0))
    return F.filter(every, lambda t: F.lower(F.regexp_extract(t, r"[A-Za-z][\w.-]*", 0)).isin(*names))


def _mapped(xml: DataFrame) -> DataFrame:
    body = F.regexp_replace("text", r"(?s)<!--.*?-->", " ")
    x = xml.select("path", body.alias("body")).select("path", "body", F.try_element_at(F.filter(F.transform(_tags(F.col("body"), "mapper"), lambda t: _attribute(t, "namespace")), lambda v: v != ""), F.lit(1)).alias("ns")).where("ns IS NOT NULL")
    named = x.select("path", "ns", F.posexplode(_tags(F.col("body"), "select", "insert", "update", "delete")).alias("pos", "tag")).withColumn("name", _attribute(F.col("tag"), "id")).where("name <> ''")
    return named.select(F.concat(F.lit("mybatis:"), "ns", F.lit("."), "name").alias("id"), F.lit("mybatis_statement").alias("kind"), "name", "path", F.col("ns").alias("container"), "pos")


def _statements(sql: DataFrame) -> DataFrame:
    """A statement by its verb, the first that begins a line, and the first table named after a word that leads one."""
    plain = F.regexp_replace("text", r"(?s)--[^\n]*|/\*.*?\*/", " ")
    s = sql.select("path", F.posexplode(F.split(plain, ";")).alias("pos", "s"))
    words = lambda c: F.filter(F.split(c, r"[\s\"'`(]+"), lambda w: w != "")
    begun = F.transform(F.split("s", "\n"), lambda l: F.transform(F.slice(words(l), 1, 2), F.lower))
    verb = F.transform(begun, lambda w: F.when(F.try_element_at(w, F.lit(1)).isin("select", "insert", "update", "delete"), w[0]).when(F.try_element_at(w, F.lit(1)).isin("create", "alter") & (F.try_element_at(w, F.lit(2)) == "table"), F.concat(w[0], F.lit("_table"))))
    every = words(F.col("s"))
    after = F.arrays_zip(every.alias("a"), F.slice(every, 2, F.greatest(F.size(every), F.lit(1))).alias("b"))
    led = F.filter(after, lambda x: F.lower(x["a"]).isin("from", "into", "update", "table", "join") & x["b"].rlike(r"^[\w.]"))
    t = F.lower(F.regexp_extract(F.try_element_at(led, F.lit(1))["b"], r"^[\w.]+", 0))
    sn = s.select("path", "pos", F.try_element_at(F.filter(verb, lambda v: v.isNotNull()), F.lit(1)).alias("verb"), t.alias("t")).where("verb IS NOT NULL AND t <> ''")
    return sn.select(F.concat(F.lit("sql:"), "path", F.lit("#"), "verb", F.lit(":"), "t").alias("id"), F.lit("sql_statement").alias("kind"), F.concat("verb", F.lit(" "), "t").alias("name"), "path", F.col("t").alias("container"), "pos")


def _spread(files: DataFrame) -> DataFrame:
    """Files dealt out before they are read: a small table may lie in one part, and what it says be long to read."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def harvest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, text`` -> (nodes, skipped ``path, error``)."""
    f = files.withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)))
    java = _spread(f.where("ext = '.java'")).withColumn("r", _java("path", "text"))
    # an inner explode would infer a filter that parses each file once more before it is dealt out
    jn = java.select("path", F.posexplode_outer("r.nodes").alias("pos", "n")).where("n IS NOT NULL").select("n.id", "n.kind", "n.name", "path", "n.container", "pos")
    skipped = java.where("r.error IS NOT NULL").select("path", "r.error")
    return _first(jn.unionByName(_mapped(f.where("ext = '.xml'"))).unionByName(_statements(f.where("ext = '.sql'")))), skipped


def _body(path: str | None, text: str | None) -> str:
    """A file's text without comments and, in Java, as it is read by who calls others."""
    p, t = (path or "").lower(), text or ""
    if p.endswith(".java"):
        return tokens.blanked(t, literals=False)
    return re.sub(r"(?s)<!--.*?-->", " ", t) if p.endswith(".xml") else re.sub(r"(?s)--[^\n]*|/\*.*?\*/", " ", t)


@vectorised("string")
def _bodies(path: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_body(p, t) for p, t in zip(path, text)])


@vectorised("array<struct<kind:string,name:string>>")
def _references(body: pd.Series) -> pd.Series:
    """What a body mentions as whole identifiers: words, words in lower case, and calls."""
    out = []
    for t in body:
        words = set(re.findall(r"\w+", t))
        refs = [("word", w) for w in words] + [("lower", w) for w in {w.lower() for w in words}]
        refs += [("call", c) for c in set(re.findall(r"\.(\w+)\s*\(", t))]
        out.append([{"kind": k, "name": n} for k, n in sorted(refs)])
    return pd.Series(out)


def link(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``src, dst, kind`` between nodes that exist, by what files mention.

    No file meets every symbol.  What a symbol may be mentioned as is one table of names; whole identifiers are joined on
    it once, dotted names are found as parts of bodies by the automaton of ``index.contained``, whatever stands before or
    after them, and conditions on a symbol in a file are folded over its mentions there: a mapped statement by its dotted
    name, or by a call of its name beside its mapper; a class by its name, then its methods that are called; a
    constant by its dotted name, or alone if no other has its name.
    """
    last = lambda c: F.regexp_extract(c, r"([^.]+)$", 1)
    fqn = F.expr("substring(id, 6)")
    mention = lambda kind, name, role: F.struct(F.lit(kind).alias("k"), name.alias("n"), F.lit(role).alias("role"))
    dotted = lambda role: (mention("dotted", F.concat_ws(".", "container", "name"), role), mention("dotted", F.concat_ws(".", last(F.col("container")), "name"), role))
    none = F.lit(None).cast("string")

    def targets(rows, subject, method, *mentions):
        return rows.select(subject.alias("subject"), F.col("path").alias("home"), F.col("container").alias("owner"), method.alias("method"), F.explode(F.array(*mentions)).alias("m")).select("subject", "home", "owner", "method", "m.*")

    nodes = scratch(nodes, "nodes")  # files are parsed once, not once for each kind
    classes = nodes.where("kind = 'java_class'")
    constants = nodes.where("kind = 'constant'")
    lone = constants.groupBy("name").count().where("count = 1").select("name")
    wanted = (
        targets(nodes.where("kind = 'mybatis_statement'"), F.col("id"), none, *dotted("full"), mention("call", F.col("name"), "call"), mention("lower", F.lower(last(F.col("container"))), "mapper"))
        .unionByName(targets(classes, F.col("id"), none, mention("word", F.col("name"), "class")))
        .unionByName(targets(nodes.where("kind = 'java_method'"), F.concat(F.lit("java:"), "container"), F.col("id"), mention("call", F.col("name"), "method")))
        .unionByName(targets(constants, F.col("id"), none, *dotted("qualified")))
        .unionByName(targets(constants.join(lone, "name"), F.col("id"), none, mention("word", F.col("name"), "bare")))
        .distinct()
    )
    bodies = scratch(_spread(files).select(F.col("path").alias("at"), _bodies("path", "text").alias("text")), "bodies")
    refs = bodies.select("at", F.explode(_references("text")).alias("r")).select("at", F.col("r.kind").alias("k"), F.col("r.name").alias("n"))
    parts = index.contained(bodies, wanted.where("k = 'dotted'").select(F.col("n").alias("term")), "at")
    refs = refs.unionByName(parts.select("at", F.lit("dotted").alias("k"), F.col("term").alias("n")))
    met = refs.join(wanted, ["k", "n"]).groupBy("at", "subject").agg(F.collect_set("role").alias("roles"), F.collect_set("method").alias("methods"), F.max("home").alias("home"), F.max("owner").alias("owner"))
    has = lambda r: F.array_contains("roles", r)
    elsewhere = F.col("at") != F.col("home")
    edge = lambda when, dst, kind, src: F.when(when, F.array(F.struct(dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(src).alias("from_kind")))).otherwise(F.array())
    of_test = has("class") & elsewhere
    edges = F.concat(
        edge(elsewhere & (has("full") | (has("call") & has("mapper"))), F.col("subject"), "service_to_mapper", "owner"),
        edge(of_test, F.col("subject"), "test_to_service", "test"),
        F.when(of_test, F.transform("methods", lambda m: F.struct(m.alias("dst"), F.lit("test_to_service").alias("kind"), F.lit("test").alias("from_kind")))).otherwise(F.array()),
        edge(has("qualified") | (has("bare") & F.endswith(F.lower("at"), F.lit(".java"))), F.col("subject"), "uses_constant", "owner"),
    )
    found = met.select("at", "home", "owner", F.explode(edges).alias("e")).select("at", "home", "owner", "e.*")
    top = classes.join(classes.select(fqn.alias("container")), "container", "left_anti").select(F.col("path").alias("at"), F.col("id").alias("src"))
    other = nodes.where(F.col("kind").isin("mybatis_statement", "sql_statement")).select(F.col("path").alias("at"), F.col("id").alias("src")).join(top.select("at"), "at", "left_anti")
    tests = nodes.where("kind = 'test_method'").select(F.col("path").alias("at"), F.col("id").alias("src"), F.lit("test").alias("from_kind"))
    sources = top.unionByName(other).withColumn("from_kind", F.lit("owner")).unionByName(tests)
    joined = found.join(sources, ["at", "from_kind"])
    joined = joined.join(tests.select(F.col("at").alias("home"), F.lit(True).alias("home_tests")).distinct(), "home", "left")
    own_constant = (F.col("kind") == "uses_constant") & (F.col("src") == F.concat(F.lit("java:"), "owner"))
    of_tests = (F.col("kind") == "test_to_service") & F.coalesce("home_tests", F.lit(False))
    joined = joined.where(~own_constant & ~of_tests).select("src", "dst", "kind")
    members = nodes.where(F.col("kind").isin("java_method", "test_method", "constant"))
    contains = members.join(classes.select(F.col("id").alias("src"), fqn.alias("container")), "container").select("src", F.col("id").alias("dst"), F.lit("contains").alias("kind"))
    return contains.unionByName(joined).distinct()
