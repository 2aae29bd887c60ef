"""Chat formatting: transcripts are parsed by a hidden Markov model and rendered as canonical turns.

A hidden state is a role, whether the line begins a turn of it or goes on, and how the transcript is marked
throughout: every turn, only some, or none, which the path as a whole decides.  A line shows a speaker
marker's class, whether a blank line or the transcript's start stands before it, how long it is and how
it ends.  Counts of lines whose states are known, smoothed, give start, transition and emission
probabilities; Viterbi recovers the likeliest states, also where markers are missing or a line only
looks like one.  Lines are then joined to turns and rendered.

A conversation of any length is one chain.  It is held in parts; a part of many tells the best score
from every state before it to every state at its end (a matrix of fixed size), these are folded along the
conversation, and each part is then decoded between the two states that the best path has at its ends.
So the result doesn't depend on where parts begin.  The model learns from conversations outside the
held-out fold, and every line is held against its true state.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from difflib import get_close_matches
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm._util import materialise, released, tune
from changelens.llm.sampling import first_by_hash

ROLES = ("system", "user", "assistant")
#: States of a kind of transcript: begins a turn of role r: 2r; goes on in it: 2r + 1.
OF_KIND = 2 * len(ROLES)
KINDS = MARKED, UNMARKED, SOME = range(3)
STATES = OF_KIND * len(KINDS)
#: Turn numbers in one part of a conversation, so that no task holds an unbounded one; parts fitted; folds.
SEGMENT, FIT_CONVERSATIONS = 256, 400
FOLDS, HELD = 5, 0
STYLES = 9

_MARKERS = (
    ("system", re.compile(r"\s*(?:#+\s*|\[|<)?(?:system|instructions?|context)(?:\]|>|\s*:|\s*$)\s*", re.I)),
    ("user", re.compile(r"\s*(?:#+\s*|\[|<)?(?:user|human|customer|me)(?:\]|>|\s*:|\s*$)\s*", re.I)),
    ("assistant", re.compile(r"\s*(?:#+\s*|\[|<)?(?:assistant|ai|bot|agent|model)(?:\]|>|\s*:|\s*$)\s*", re.I)),
    ("question", re.compile(r"\s*Q\s*[:.]\s*")),
    ("answer", re.compile(r"\s*A\s*[:.]\s*")),
    ("other", re.compile(r"\s*[^\W\d_]{1,20}\s*:\s+")),
)
CLASSES = 1 + len(_MARKERS)
SIZES = (CLASSES, 3, 4, 3)


#: Names of roles, and how like one of them a misspelt name must be.
_NAMED = {"system": 1, "instructions": 1, "context": 1, "user": 2, "human": 2, "customer": 2, "assistant": 3, "agent": 3, "model": 3}
LIKE = 0.8


@lru_cache(4096)
def _like(word: str) -> int:
    """The class of the role that a misspelt name means; 0 for none."""
    near = get_close_matches(word.lower(), _NAMED, 1, LIKE)
    return _NAMED[near[0]] if near else 0


def marker(line: str) -> tuple[int, str]:
    """(class of the line's speaker marker, what follows it); class 0 and the whole line without one."""
    for k, (_, p) in enumerate(_MARKERS, 1):
        m = p.match(line)
        if m:
            meant = _like(m[0].strip().rstrip(": ")) if k == len(_MARKERS) else 0
            return meant or k, line[m.end() :]
    return 0, line


def lines_of(text: str, goes_on: bool = False) -> tuple[list[str], np.ndarray]:
    """Lines that aren't blank, and the features of each.  ``goes_on``: the text isn't a transcript's beginning."""
    out, feats, gap = [], [], 0 if goes_on else 2
    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            gap = max(gap, 1)
            continue
        n = len(line)
        end = line[-1]
        out.append(line)
        feats.append((marker(line)[0], gap, 0 if n < 20 else 1 if n < 80 else 2 if n < 250 else 3, 1 if end == "?" else 2 if end in ".!" else 0))
        gap = 0
    return out, np.array(feats, np.int64).reshape(-1, len(SIZES))


class Model:
    """Log probabilities from counts; one of each is added."""

    def __init__(self, start: np.ndarray, trans: np.ndarray, emit: list[np.ndarray]):
        log = lambda c: np.log((c + 0.5) / (c + 0.5).sum(-1, keepdims=True))
        self.start, self.trans = log(start), log(trans)
        self.start[1::2] = -1e9  # a transcript doesn't begin inside a turn
        for t in range(STATES):
            for f in range(STATES):  # one kind throughout, and inside a role only after that role
                if f // OF_KIND != t // OF_KIND or t % 2 and f // 2 != t // 2:
                    self.trans[f, t] = -1e9
        self.emit = [log(e) for e in emit]

    def emitted(self, feats: np.ndarray) -> np.ndarray:
        return sum(m[:, feats[:, k]].T for k, m in enumerate(self.emit))

    def viterbi(self, feats: np.ndarray, enter: int | None = None, leave: int | None = None) -> list[int]:
        """The best path; ``enter``: the state before the first line, ``leave``: the last line's state, if known."""
        if not len(feats):
            return []
        e = self.emitted(feats)
        best, back = (self.start if enter is None else self.trans[enter]) + e[0], []
        for t in range(1, len(e)):
            s = best[:, None] + self.trans
            back.append(s.argmax(0))
            best = s.max(0) + e[t]
        path = [int(best.argmax()) if leave is None else leave]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def across(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best score, first state) of the paths from each state before the lines (the last row: from the transcript's
        start) to each state at their end."""
        e = self.emitted(feats)
        best = np.concatenate([self.trans, self.start[None]]) + e[0]
        first = np.broadcast_to(np.arange(STATES), best.shape)
        for t in range(1, len(e)):
            s = best[:, :, None] + self.trans
            by = s.argmax(1)
            best = np.take_along_axis(s, by[:, None], 1)[:, 0] + e[t]
            first = np.take_along_axis(first, by, 1)
        return best, first


def turns_of(lines: list[str], feats: np.ndarray, states: list[int]) -> list[tuple[str, str, bool]]:
    """(role, text, whether it begins here) of the turns in lines whose states are known."""
    turns: list[tuple[str, list[str], bool]] = []
    for line, f, state in zip(lines, feats, states):
        role = ROLES[state % OF_KIND // 2]
        if state % 2 == 0:
            kind = f[0]
            body = marker(line)[1] if kind and kind != CLASSES - 1 else line
            turns.append((role, [body] if body else [], True))
        elif not turns:
            turns.append((role, [line], False))
        else:
            turns[-1][1].append(line)
    return [(r, "\n".join(b), begins) for r, b, begins in turns]


def parse(text: str, model: Model) -> list[tuple[str, str]]:
    """(role, text) of the turns of one whole transcript."""
    lines, feats = lines_of(text)
    return [(r, t) for r, t, _ in turns_of(lines, feats, model.viterbi(feats))]


def _escaped(text: str) -> str:
    return text.replace("<|", "<\\|")


def render_part(turns: list[tuple[str, str, bool]], ends: bool) -> str:
    """A part of the canonical form: a turn that began before goes on, one that goes on after isn't closed.  Parts
    rendered one after the other are the whole."""
    out = []
    for k, (role, text, begins) in enumerate(turns):
        out.append(f"<|im_start|>{role}\n{_escaped(text)}" if begins else "\n" + _escaped(text))
        if ends or k < len(turns) - 1:
            out.append("<|im_end|>\n")
    return "".join(out)


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form; marks within a text are escaped, so rendering can be undone."""
    return render_part([(r, t, True) for r, t in turns], True)


# ------------------------------------------------------------------- transcripts of known turns
_NAMES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System\n", "### Human\n", "### Assistant\n"),
    ("System: ", "Q: ", "A: "),
    ("[system] ", "[user] ", "[assistant] "),
    ("<system> ", "<human> ", "<bot> "),
    ("", "", ""),
    ("System: ", "User: ", "Assistant: "),
    ("Sytem: ", "Usr: ", "Asistant: "),
    ("System: ", "User: ", "Assistant: "),
)
#: Styles without markers but for the first turn; with one turn's marker in four lost; with blank lines within turns.
BARE, LOSSY, LOOSE = 5, 6, 8


def transcribe(turns: list[tuple[str | None, str | None]], style: int, at: int = 0) -> tuple[str, list[int]]:
    """A transcript in one of the styles, and the state of each of its lines that isn't blank.

    In odd styles turns are parted by a blank line.  ``at``: how many turns of the conversation stand before; if
    there are any, the text begins with what parts turns.  A missing or unknown role is taken for a user's.
    """
    style %= STYLES
    first = OF_KIND * (UNMARKED if style == BARE else SOME if style == LOSSY else MARKED)
    gap = "\n\n" if style % 2 else "\n"
    out, states = [], []
    for k, (role, text) in enumerate(turns, at):
        r = ROLES.index(role) if role in ROLES else 1
        name = _NAMES[style][r]
        if style == BARE and k == 0:
            name = _NAMES[0][r]
        if style == LOSSY and k and zlib.crc32(f"{k}:{len(text or '')}".encode()) % 4 == 0:
            name = ""
        own = [x for x in (name + (text or "")).split("\n") if x.strip()]
        if not own:
            own = [_NAMES[0][r]]
        out.append(("\n\n" if style == LOOSE else "\n").join(own))
        states += [first + 2 * r] + [first + 2 * r + 1] * (len(own) - 1)
    return (gap if at else "") + gap.join(out), states


def segments(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, turns, at, parts``: SEGMENT turn numbers at most in a part, by turn, then role and text; how
    many turns stand before, and how many parts there are.

    Repeated rows count once, so a turn that is repeated however often stays one.  A null turn counts
    as -1, in part -1.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = conversations.select("conv_id", turn.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    held = rows.groupBy("conv_id", F.floor(turn / SEGMENT).alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return held.transform(_placed)


def _placed(held: DataFrame) -> DataFrame:
    """Adds ``at`` and ``parts``; the sizes of a conversation's parts are folded without its turns."""
    size = materialise(held, "parts")
    w = Window.partitionBy("cid").orderBy("cp")
    many = size.select(F.col("conv_id").alias("cid"), F.col("part").alias("cp"), F.size("turns").cast("long").alias("n"))
    several = many.groupBy("cid").agg(F.count("*").alias("parts")).where("parts > 1").withColumnRenamed("cid", "c2")
    before = many.join(several, F.col("cid").eqNullSafe(F.col("c2"))).select("cid", "cp", "parts", (F.sum("n").over(w) - F.col("n")).alias("at"))
    out = size.join(before, F.col("conv_id").eqNullSafe(F.col("cid")) & (F.col("part") == F.col("cp")), "left")
    return out.select("conv_id", "part", "turns", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("parts", F.lit(1)).alias("parts"))


def _style(conv_id) -> int:
    return int.from_bytes(hashlib.md5(str(conv_id).encode()).digest()[:4], "little") % STYLES


def transcripts(parts: DataFrame) -> DataFrame:
    """``conv_id, part, parts, at, transcript, truth``: transcripts of known turns in styles that vary by id."""

    def run(batches):
        for b in batches:
            text, truth = [], []
            for c, turns, at in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), b.column("at").to_pylist()):
                t, s = transcribe([(x["role"], x["text"]) for x in turns], _style(c), at)
                text.append(t)
                truth.append(s)
            names = ["conv_id", "part", "parts", "at"]
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(text, pa.string()), pa.array(truth, pa.list_(pa.int32()))], names=[*names, "transcript", "truth"])

    kind = parts.schema["conv_id"].dataType.simpleString()
    return parts.select("conv_id", "part", "turns", "at", "parts").mapInArrow(released(run), f"conv_id {kind}, part long, parts long, at long, transcript string, truth array<int>")


def fold(conversations: DataFrame):
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(conversations["conv_id"].cast("string")), F.lit(FOLDS))


def _count(batches):
    start, trans = np.zeros(STATES), np.zeros((STATES, STATES))
    emit = [np.zeros((STATES, n)) for n in SIZES]
    for b in batches:
        for text, truth, at in zip(b.column("transcript").to_pylist(), b.column("truth").to_pylist(), b.column("at").to_pylist()):
            _, feats = lines_of(text, at > 0)
            s = np.array(truth, np.int64)
            if len(s) != len(feats) or not len(s):
                continue
            if not at:
                start[s[0]] += 1
            np.add.at(trans, (s[:-1], s[1:]), 1)
            for k, e in enumerate(emit):
                np.add.at(e, (s, feats[:, k]), 1)
    yield pa.record_batch([pa.array([np.concatenate([start, trans.ravel(), *[e.ravel() for e in emit]]).tobytes()], pa.binary())], names=["counts"])


def train(known: DataFrame, most: int = FIT_CONVERSATIONS) -> Model:
    """Counts of at most ``most`` parts outside the held-out fold; a vector of fixed size from each task."""
    learn = known.where(F.coalesce(fold(known) != HELD, F.lit(True)))
    sample = first_by_hash(learn, most, "conv_id", "part")
    size = STATES + STATES**2 + STATES * sum(SIZES)
    rows = sample.select("transcript", "truth", "at").mapInArrow(_count, "counts binary").collect()
    total = sum((np.frombuffer(r.counts) for r in rows), np.zeros(size))
    cut = np.cumsum([STATES, STATES**2, *[STATES * n for n in SIZES]])[:-1]
    start, trans, *emit = np.split(total, cut)
    return Model(start, trans.reshape(STATES, STATES), [e.reshape(STATES, -1) for e in emit])


ENDS = "conv_id {0}, part long, enter int, leave int, ends boolean"


def path_ends(known: DataFrame, model: Model) -> DataFrame:
    """``conv_id, part, enter, leave, ends`` of conversations of several parts: the best path's state before a part (-1
    for none) and at its end, and whether the next part begins a turn.

    A part is a matrix here; a conversation's matrices meet in one task, 5,500 bytes for SEGMENT turn numbers.
    """
    shared = known.sparkSession.sparkContext.broadcast(model)
    kind = known.schema["conv_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            held = []
            for text, at in zip(b.column("transcript").to_pylist(), b.column("at").to_pylist()):
                _, feats = lines_of(text or "", at > 0)
                held.append(b"" if not len(feats) else b"".join(np.ascontiguousarray(x, np.float64).tobytes() for x in m.across(feats)))
            yield pa.record_batch([b.column("conv_id"), b.column("part"), pa.array(held, pa.binary())], names=["conv_id", "part", "held"])

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        shape = (STATES + 1, STATES)
        best, back, firsts = None, [], []
        for h in pdf.held:
            if not len(h):
                back.append(None)
                firsts.append(None)
                continue
            score, first = np.frombuffer(h).reshape(2, *shape)
            if best is None:
                best, by = score[-1], np.full(STATES, -1)
            else:
                s = best[:, None] + score[:-1]
                by, best = s.argmax(0), s.max(0)
            back.append(by)
            firsts.append(first.astype(np.int64))
        state = -1 if best is None else int(best.argmax())
        rows, follows = [], True  # whether what follows begins a turn
        for part, by, first in zip(pdf.part[::-1], reversed(back), reversed(firsts)):
            if by is None:
                rows.append((part, state, state, follows))
                continue
            enter = int(by[state])
            rows.append((part, enter, state, follows))
            follows = bool(first[enter, state] % 2 == 0)  # row -1 is the start's
            state = enter
        out = pd.DataFrame(rows, columns=["part", "enter", "leave", "ends"])
        out.insert(0, "conv_id", pdf.conv_id.iloc[0])
        return out

    several = known.where("parts > 1").select("conv_id", "part", "transcript", "at")
    matrices = several.mapInArrow(released(run), f"conv_id {kind}, part long, held binary")
    return matrices.groupBy("conv_id").applyInPandas(folded, ENDS.format(kind))


def recover(known: DataFrame, model: Model) -> DataFrame:
    """``conv_id, part, turns array<struct<role,text,begins>>, rendered, n_lines, n_right`` of ``conv_id, part, parts, at,
    transcript`` and, if there, ``truth``.

    A turn that began in the part before is marked.  ``n_right``: lines with the true role that begin or go on as
    they should.  A null or
    blank transcript has no turns and renders as nothing.
    """
    shared = known.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("begins", pa.bool_())]))
    conv = known.schema["conv_id"].dataType.simpleString()
    truth = F.col("truth") if "truth" in known.columns else F.lit(None).cast("array<int>").alias("truth")
    rows = known.select("conv_id", "part", "parts", "at", "transcript", truth)
    ends = materialise(path_ends(known, model), "ends").withColumnsRenamed({"conv_id": "ci", "part": "cp"})
    chained = rows.where("parts > 1").join(ends, F.col("conv_id").eqNullSafe(F.col("ci")) & (F.col("part") == F.col("cp"))).drop("ci", "cp")
    whole = rows.where("parts = 1").select("*", F.lit(-1).alias("enter"), F.lit(-1).alias("leave"), F.lit(True).alias("ends"))

    def run(batches):
        m = shared.value
        for b in batches:
            turns, text, n, right = [], [], [], []
            cols = (b.column(c).to_pylist() for c in ("transcript", "truth", "at", "enter", "leave", "ends"))
            for t, true, at, enter, leave, end in zip(*cols):
                lines, feats = lines_of(t or "", at > 0)
                states = m.viterbi(feats, None if enter < 0 else enter, None if leave < 0 else leave)
                own = turns_of(lines, feats, states)
                turns.append([{"role": r, "text": x, "begins": y} for r, x, y in own])
                text.append(render_part(own, end))
                n.append(len(lines))
                right.append(sum(x % OF_KIND == y % OF_KIND for x, y in zip(states, true)) if true is not None and len(true) == len(states) else 0)
            yield pa.record_batch([b.column("conv_id"), b.column("part"), pa.array(turns, kind), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(right, pa.int64())], names=["conv_id", "part", "turns", "rendered", "n_lines", "n_right"])

    schema = f"conv_id {conv}, part long, turns array<struct<role:string,text:string,begins:boolean>>, rendered string, n_lines long, n_right long"
    return whole.unionByName(chained).mapInArrow(released(run), schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row for each part of a conversation: ``conv_id, part, held_out, n_turns, roles, rendered_sha256, n_lines, n_right``.

    All turns are transcribed in styles with and without markers, with markers lost, misspelt or among blank
    lines; the model is fitted on a bounded sample of conversations outside the held-out fold, and every transcript
    is parsed and rendered.  ``n_turns`` and ``roles`` count turns that begin in the part; ``n_right`` of ``n_lines``
    lines have their true state.  A conversation of more than SEGMENT turn numbers has several parts, whose
    renderings follow one another; the path runs through them.  Rows with a null conv_id are one conversation, never
    held out; an empty table gives an empty table; other columns are ignored.
    """
    tune(conversations.sparkSession)
    known = materialise(transcripts(segments(conversations)), "transcripts")
    got = recover(known, train(known))
    begun = F.filter("turns", lambda t: t["begins"])
    return got.select(
        "conv_id",
        "part",
        F.coalesce(fold(got) == HELD, F.lit(False)).alias("held_out"),
        F.size(begun).cast("long").alias("n_turns"),
        F.array_join(F.transform(begun, lambda t: t["role"]), ",").alias("roles"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
        "n_lines",
        "n_right",
    )
