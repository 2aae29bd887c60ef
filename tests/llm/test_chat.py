"""Transcript parsing: Viterbi against all paths, recovered turns against known ones."""

import hashlib
import itertools
import random
import zlib

import numpy as np

from changelens.llm import chat

S = chat.STATES


def talks(n=150, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ko", "li", "ne"]) for _ in range(r.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(r.randint(3, 25))).capitalize() + r.choice([".", ".", "?"])
    out = []
    for c in range(n):
        turns = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randint(1, 4)
        out += [(c, t, role, "\n".join(line() for _ in range(r.randint(1, 3)))) for t, role in enumerate(turns)]
    return out


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    m = chat.Model(r.integers(0, 9, S), r.integers(0, 9, (S, S)), [r.integers(0, 9, (S, n)) for n in chat.SIZES])
    feats = np.stack([r.integers(0, n, 4) for n in chat.SIZES], axis=1)
    e = sum(x[:, feats[:, k]].T for k, x in enumerate(m.emit))
    value = lambda p: m.start[p[0]] + e[0, p[0]] + sum(m.trans[a, b] + e[t, b] for t, (a, b) in enumerate(zip(p, p[1:]), 1))
    want = max(itertools.product(range(S), repeat=4), key=value)
    assert abs(value(want) - value(m.viterbi(feats))) < 1e-9


def test_known_ends_give_the_same_path():
    r = np.random.default_rng(4)
    m = chat.Model(r.integers(0, 9, S), r.integers(0, 9, (S, S)), [r.integers(0, 9, (S, n)) for n in chat.SIZES])
    feats = np.stack([r.integers(0, n, 40) for n in chat.SIZES], axis=1)
    want = m.viterbi(feats)
    for cut in (1, 7, 20, 39):
        score, first = m.across(feats[:cut])
        enter, leave = want[cut - 1], want[-1]
        assert m.viterbi(feats[:cut], None, enter) == want[:cut] and m.viterbi(feats[cut:], enter, leave) == want[cut:]
        assert first[-1, enter] == want[0]
        more, begins = m.across(feats[cut:])
        assert begins[enter, leave] == want[cut]
        whole, _ = m.across(feats)
        assert abs((score[-1][:, None] + more[:-1]).max() - whole[-1].max()) < 1e-9


def test_roles_come_back_in_every_style(spark):
    rows = talks(400)
    df = spark.createDataFrame([(*x, "z", "y") for x in rows], "conv_id long, turn long, role string, text string, part string, transcript string")
    known = chat.transcripts(chat.segments(df))
    model = chat.train(known)
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.recover(known, model).collect()}
    held = {c: zlib.crc32(str(c).encode()) % chat.FOLDS == chat.HELD for c in want}
    for s in range(chat.STYLES):
        for out in (True, False):
            own = [c for c in want if chat._style(c) == s and held[c] == out]
            roles = np.mean([[r for r, _ in got[c]] == [r for r, _ in want[c]] for c in own])
            if s < chat.BARE:
                assert roles == 1.0 and all(got[c] == want[c] for c in own)
            else:
                assert roles >= (0.5 if s == chat.LOSSY else 0.7), (s, roles)
    lines = right = 0
    for r in chat.format_conversations(df).collect():
        assert r.rendered_sha256 == hashlib.sha256(chat.render(got[r.conv_id]).encode()).hexdigest()
        assert r.roles == ",".join(x for x, _ in got[r.conv_id]) and r.n_turns == len(got[r.conv_id]) and r.held_out == held[r.conv_id]
        if r.held_out:
            lines, right = lines + r.n_lines, right + r.n_right
    assert right >= 0.95 * lines


def test_parts_of_a_conversation_are_one_chain(spark, monkeypatch):
    rows = [(c, t, ["user", "assistant"][t % 2] if r % 9 else "user", f"Line {t} of it.\nAnd {r} more words here?" if r % 3 else f"Only {r}.") for c in range(9) for t, r in enumerate(random.Random(c).choices(range(100), k=60))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.train(chat.transcripts(chat.segments(df)))
    whole = {r.conv_id: r for r in chat.recover(chat.transcripts(chat.segments(df)), model).collect()}
    monkeypatch.setattr(chat, "SEGMENT", 7)
    parts = {}
    for r in chat.recover(chat.transcripts(chat.segments(df)), model).collect():
        parts.setdefault(r.conv_id, {})[r.part] = r
    for c, w in whole.items():
        own = [parts[c][k] for k in sorted(parts[c])]
        assert len(own) == 9 and "".join(r.rendered for r in own) == w.rendered
        assert sum(r.n_lines for r in own) == w.n_lines and sum(r.n_right for r in own) == w.n_right


def test_a_line_that_only_looks_like_a_marker_stays_text(spark):
    rows = talks(80, 5)
    known = chat.transcripts(chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    model = chat.train(known)
    text = "User: Ba koli ne.\nNote: lili ko ba.\nAssistant: Ko ne ba li.\nLine two."
    assert chat.parse(text, model) == [("user", "Ba koli ne.\nNote: lili ko ba."), ("assistant", "Ko ne ba li.\nLine two.")]
    assert chat.parse("", model) == []


def test_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "assistant", "y " * 50_000), (2, 0, "tool", "t"), (3, 5000, "user", "late"), (3, 0, "user", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).collect()
    assert sorted((r.conv_id or -1, r.part) for r in got) == [(-1, -1), (1, 0), (2, 0), (3, 0), (3, 19)]
    assert chat.format_conversations(df.limit(0)).count() == 0
