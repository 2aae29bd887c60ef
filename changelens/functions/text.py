"""Keys, hashes, paths and cleaning of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which a secret may stand; in texts their parts may be parted by a hyphen or nothing as well.
SECRET_KEYS = ("api_key", "token", "password", "passwd", "secret", "authorization", "cookie")
#: What stands between a name and its value, and what a value ends before (or a blank).
SEPARATORS, ENDS = ":=", ",;"
HIDDEN = "[REDACTED]"
CODE = r"\b[a-z][0-9]{4}\b"


def _named_values(keys: tuple[str, ...]) -> str:
    """A pattern of values that a text gives to any of the names."""
    names = "|".join("[_-]?".join(k.split("_")) for k in keys)
    return rf"(?i)\b({names})\s*[{SEPARATORS}]\s*[^\s{ENDS}]+"


def redact(text: Column, keys: tuple[str, ...] = SECRET_KEYS) -> Column:
    """Inline secrets keep their name and lose their value."""
    return F.regexp_replace(text, _named_values(keys), f"$1={HIDDEN}")


def redact_value(value, keys: tuple[str, ...] = SECRET_KEYS):
    """The same for nested data: fields with a secret name go whole, texts are redacted."""
    within = lambda v: redact_value(v, keys)
    match value:
        case dict():
            return {str(k): HIDDEN if str(k).lower() in keys else within(v) for k, v in value.items()}
        case list() | tuple():
            return list(map(within, value))
        case str():
            return re.sub(_named_values(keys), rf"\1={HIDDEN}", value)
    return value


def sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def change_hash(before: Column, after: Column) -> Column:
    nul = F.lit("\0")
    return sha(F.concat(F.lit("before"), nul, before, nul, F.lit("after"), nul, after))


def clean_path(path: Column) -> Column:
    """A relative path with forward slashes, without empty and dot parts; null where it is empty,
    absolute or leads out of its root."""
    raw = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.lit(-1) * F.size(acc), F.lit(-1))) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    out = F.when(F.size(folded) == 0, F.lit(".")).otherwise(F.array_join(folded, "/"))
    return F.when((raw != "") & ~F.startswith(raw, F.lit("/")) & ~(out == "..") & ~F.startswith(out, F.lit("../")), out)


def loose_path(path: Column) -> Column:
    """A path for comparing: forward slashes, no empty or dot parts; parent parts stay."""
    raw = F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.array_join(F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != ".")), "/")


def under(path: Column, spec: Column) -> Column:
    """The path is the spec, or lies below it as a folder."""
    return (path != "") & (spec != "") & ((path == spec) | F.startswith(path, F.concat(spec, F.lit("/"))))


def place_key(path: Column, symbol: Column, line: Column) -> Column:
    """One key for a candidate's place: its symbol, or else its ten lines."""
    bucket = F.floor(F.coalesce(line, F.lit(1)) / 10) * 10
    return F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(path, F.lit("::symbol:"), F.trim(symbol))).otherwise(
        F.concat(path, F.lit("::line:"), bucket.cast("string"))
    )


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def holds(source: Column, needle: Column, mode: Column) -> Column:
    """The needle is in the source, exactly or up to white space; a blank needle never is."""
    return (F.trim(needle) != "") & F.when(mode == "normalized_text", F.contains(squeeze(source), squeeze(needle))).otherwise(F.contains(source, needle))


def law_tier(name: Column, source: Column) -> Column:
    """Statute, decree or rule by the name's ending; other kinds are told by their source."""
    return (
        F.when((source != "") & (source != "law"), source)
        .when(F.endswith(name, F.lit("시행규칙")), "시행규칙")
        .when(F.endswith(name, F.lit("시행령")), "시행령")
        .otherwise("법률")
    )


def article_number(text: Column) -> Column:
    return F.regexp_extract(text, r"제\d+조(?:의\d+)?(?:제\d+항)?", 0)


def article_label(number: Column, branch: Column) -> Column:
    n, b = number.try_cast("int"), F.coalesce(branch.try_cast("int"), F.lit(0))
    return F.when(n.isNull(), "").when(b != 0, F.concat(F.lit("제"), n, F.lit("조의"), b)).otherwise(F.concat(F.lit("제"), n, F.lit("조")))
