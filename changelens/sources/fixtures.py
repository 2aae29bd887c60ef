"""Replay fixtures from JSON lines and YAML: records with their lines, every broken rule as a row, sources resolved.

Files are parsed in tasks, each alone; a record that can't be read is a fault of its line and ends nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions.lazy import vectorised

#: Version and kind of source that are known, programs that a golden command may start, time that it may take.
VERSION, SOURCE_TYPE, PROGRAMS, TIMEOUT = "1", "local_git", ("mvn", "gradle", "./gradlew", "pytest"), 1800
#: Letters of a revision, and of the name of an environment variable (capitals first).
REVISION, VARIABLE = "^[0-9A-Za-z_./-]+$", "^[A-Z][A-Z0-9_]*$"
FIXTURE = (
    "case_id string, schema_version string, repository struct<source_type:string,path:string,path_env:string,base_commit:string,answer_commit:string>, "
    "scope struct<relevant_paths:array<string>,excluded_paths:array<string>>, execution struct<privacy_mode:string,golden_command:string,timeout_seconds:int>"
)
#: What a fixture must satisfy: a name and a SQL condition for each rule; null counts as broken.
RULES = {
    "case_id": "trim(case_id) <> ''",
    "schema_version": f"coalesce(schema_version, '{VERSION}') = '{VERSION}'",
    "source_type": f"coalesce(repository.source_type, '{SOURCE_TYPE}') = '{SOURCE_TYPE}'",
    "path_or_env": "(coalesce(repository.path, '') = '') <> (coalesce(repository.path_env, '') = '')",
    "path_env": f"coalesce(repository.path_env, '') = '' OR repository.path_env RLIKE '{VARIABLE}'",
    "base_commit": f"repository.base_commit RLIKE '{REVISION}' AND NOT startswith(repository.base_commit, '-')",
    "answer_commit": f"repository.answer_commit RLIKE '{REVISION}' AND NOT startswith(repository.answer_commit, '-')",
    "golden_command": "coalesce(trim(execution.golden_command), '') = '' OR split(trim(execution.golden_command), ' ')[0] IN (" + ", ".join(f"'{p}'" for p in PROGRAMS) + ")",
    "timeout": f"coalesce(execution.timeout_seconds, {TIMEOUT}) BETWEEN 1 AND {TIMEOUT * 2}",
}


def _lines(text: str) -> Iterator[tuple[int, object, str | None]]:
    for k, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                yield k, json.loads(line), None
            except ValueError:
                yield k, None, "not JSON"


def _nodes(text: str) -> Iterator[tuple[int, object, str | None]]:
    """Cases of a YAML document: under ``cases``, a list, or one alone.  Only plain values are built."""
    import yaml

    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
        whole = yaml.safe_load(text)
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        yield (mark.line + 1 if mark else 1), None, "not YAML"
        return
    if isinstance(whole, dict) and "cases" in whole:
        root, whole = next(v for k, v in root.value if k.value == "cases"), whole["cases"]
    elif isinstance(whole, dict):
        yield root.start_mark.line + 1, whole, None
        return
    if not isinstance(whole, list):
        yield 1, None, "no cases"
        return
    for node, value in zip(root.value, whole, strict=True):
        yield node.start_mark.line + 1, value, None


@vectorised("array<struct<line:int,body:string,fault:string>>")
def _records(file: pd.Series, text: pd.Series) -> pd.Series:
    out = []
    for f, t in zip(file, text):
        read = _nodes if (f or "").lower().endswith((".yaml", ".yml")) else _lines
        rows = []
        for line, value, fault in read((t or "").removeprefix("﻿")):
            fault = fault or (None if isinstance(value, dict) else "not a record")
            rows.append({"line": line, "body": None if fault else json.dumps(value, ensure_ascii=False, default=str), "fault": fault})
        out.append(rows)
    return pd.Series(out)


def load(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, text`` -> (fixtures that break no rule: ``file, line`` and FIXTURE, with defaults filled in; faults: ``file,
    line, case_id, rule``, a row for every rule that a record breaks).

    Of several records with one id all are faults (``duplicate``).  Scopes may be missing.
    """
    r = files.select("file", F.explode(_records("file", "text")).alias("r")).select("file", "r.line", "r.body", "r.fault")
    rows = r.select("file", "line", "fault", F.from_json("body", FIXTURE).alias("x")).select("file", "line", "fault", "x.*")
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in RULES.items()]))
    twice = rows.where("fault IS NULL AND trim(case_id) <> ''").groupBy("case_id").count().where("count > 1").select("case_id", F.array(F.lit("duplicate")).alias("twice"))
    judged = rows.join(twice, "case_id", "left").withColumn("rules", F.when(F.col("fault").isNotNull(), F.array("fault")).otherwise(F.concat(broken, F.coalesce("twice", F.array().cast("array<string>")))))
    faults = judged.select("file", "line", "case_id", F.explode("rules").alias("rule"))
    good = judged.where(F.size("rules") == 0).withColumns({
        "schema_version": F.coalesce("schema_version", F.lit(VERSION)),
        "repository": F.col("repository").withField("source_type", F.coalesce("repository.source_type", F.lit(SOURCE_TYPE))),
        "execution": F.struct(F.col("execution.privacy_mode").alias("privacy_mode"), F.col("execution.golden_command").alias("golden_command"), F.coalesce("execution.timeout_seconds", F.lit(TIMEOUT)).alias("timeout_seconds")),
    })
    return good.select("file", "line", "case_id", "schema_version", "repository", "scope", "execution"), faults


def resolved(fixtures: DataFrame, environment: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(fixtures with the ``root`` that they name, by path or by a variable of ``environment``; ``case_id, variable`` of
    those whose variable isn't there).  Values of variables are no part of a fixture and aren't written anywhere."""
    known = F.create_map(*[F.lit(x) for kv in environment.items() for x in kv]) if environment else F.create_map().cast("map<string,string>")
    own = F.nullif(F.coalesce("repository.path", F.lit("")), F.lit(""))
    named = fixtures.withColumn("root", F.coalesce(own, known[F.col("repository.path_env")]))
    return named.where("root IS NOT NULL"), named.where("root IS NULL").select("case_id", F.col("repository.path_env").alias("variable"))
