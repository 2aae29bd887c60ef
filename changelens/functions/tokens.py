"""Tokens of languages whose blocks are braces, and what is declared in them."""

from __future__ import annotations

import re

_LEXEME = re.compile(r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[\w$]+)|(?P<mark>[^\s\w$])", re.S)

#: Reserved words of the Java language that are neither a type nor a modifier of a member.
RESERVED = frozenset({
    "assert", "break", "case", "catch", "class", "const", "continue", "do", "else", "enum", "extends", "finally", "for", "goto", "if", "implements", "import",
    "instanceof", "interface", "new", "package", "return", "super", "switch", "synchronized", "this", "throw", "throws", "try", "while",
})
TYPES = frozenset({"class", "interface", "enum"})
#: Modifiers that lead a chunk.
JAVA_MODIFIERS = frozenset({"public", "protected", "private", "static", "final", "abstract", "synchronized"})
KOTLIN_MODIFIERS = frozenset({"public", "protected", "private", "internal", "abstract", "open", "override", "inline", "suspend"})


class Token(str):
    """A word or mark with its place."""

    start: int
    end: int

    @property
    def is_word(self) -> bool:
        return self[0].isalnum() or self[0] in "_$"


def read(text: str) -> list[Token]:
    """Words and marks; comments and literals are left out."""
    out = []
    for m in _LEXEME.finditer(text):
        if m.lastgroup in ("word", "mark"):
            t = Token(m[0])
            t.start, t.end = m.span()
            out.append(t)
    return out


def blanked(text: str, literals: bool = True) -> str:
    """Comments, and literals if asked for, as blanks of the same length."""
    return _LEXEME.sub(lambda m: " " * len(m[0]) if m.lastgroup == "skip" or literals and m.lastgroup == "text" else m[0], text)


def _opens(head: list[Token], close: int, pair: str = "()") -> int:
    """Where the bracket opens that closes at ``close``; -1 if it doesn't."""
    depth = 0
    for k in range(close, -1, -1):
        depth += (head[k] == pair[1]) - (head[k] == pair[0])
        if depth == 0:
            return k
    return -1


def _type_word(head: list[Token], at: int) -> Token | None:
    """The word of the type that ends at ``at``, before its arguments and dimensions."""
    while at > 0 and head[at] == "]" and head[at - 1] == "[":
        at -= 2
    if at >= 0 and head[at] == ">":
        at = _opens(head, at, "<>") - 1
    return head[at] if at >= 0 and head[at].is_word else None


def declared_type(head: list[Token]) -> Token | None:
    """The name of the type that the tokens before a brace declare."""
    return next((n for k, n in zip(head, head[1:]) if k in TYPES and n.is_word), None)


def declared_method(head: list[Token]) -> Token | None:
    """The name of the method that they declare: a type, a name and brackets, then at most what it throws."""
    end = len(head)
    if "throws" in head:
        at = len(head) - 1 - head[::-1].index("throws")
        if at + 1 < len(head) and all(t.is_word or t in ",.<>" for t in head[at + 1 :]):
            end = at
    if not end or head[end - 1] != ")":
        return None
    at = _opens(head, end - 1) - 1
    if at < 1 or not head[at].is_word or head[at] in RESERVED:
        return None
    of = _type_word(head, at - 1)
    return None if of is None or of in RESERVED else head[at]


def declared_constant(statement: list[Token]) -> Token | None:
    """The upper-case name that a statement declares static and final."""
    for k in range(len(statement) - 3):
        if {statement[k], statement[k + 1]} != {"static", "final"}:
            continue
        end = next((j for j in range(k + 2, len(statement)) if statement[j] == "="), len(statement))
        name = statement[end - 1]
        if end - 1 > k + 2 and name.is_word and name[0].isalpha() and name == name.upper() and name.isascii() and "$" not in name and _type_word(statement, end - 2) is not None:
            return name
    return None


def java_heads(tokens: list[Token]) -> list[int]:
    """Where methods begin that have a modifier, a type of one piece, a name, brackets and a body."""
    out, k, n = [], 0, len(tokens)
    while k < n:
        if tokens[k] not in JAVA_MODIFIERS:
            k += 1
            continue
        first = k
        while k < n and tokens[k] in JAVA_MODIFIERS:
            k += 1
        at = k
        while at < n and (tokens[at].is_word or tokens[at] in "<>[]") and (at == k or tokens[at].start == tokens[at - 1].end):
            at += 1
        if at == k or at + 1 >= n or not tokens[at].is_word or tokens[at + 1] != "(":
            continue
        at = next((j for j in range(at + 2, n) if tokens[j] == ")"), n) + 1
        if at < n and tokens[at] == "throws":
            at += 1
            while at < n and (tokens[at].is_word or tokens[at] == ","):
                at += 1
        if at < n and tokens[at] == "{":
            out.append(tokens[first].start)
            k = at
    return out


def kotlin_heads(tokens: list[Token]) -> list[int]:
    """Where named functions begin, modifiers included."""
    out = []
    for k in range(len(tokens) - 2):
        if tokens[k] == "fun" and tokens[k + 1].is_word and tokens[k + 2] in "(<":
            while k and tokens[k - 1] in KOTLIN_MODIFIERS:
                k -= 1
            out.append(tokens[k].start)
    return out


def script_heads(tokens: list[Token]) -> list[int]:
    """Where functions begin that are named, or assigned to a member of ``this``."""
    out = []
    for k, t in enumerate(tokens):
        if t != "function" or ")" not in tokens[k:]:
            continue
        if k + 2 < len(tokens) and tokens[k + 1].is_word and tokens[k + 2] == "(":
            out.append(t.start)
        elif k >= 4 and tokens[k - 4 : k - 2] == ["this", "."] and tokens[k - 1] == "=" and k + 1 < len(tokens) and tokens[k + 1] == "(":
            out.append(tokens[k - 4].start)
    return out
