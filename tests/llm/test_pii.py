"""Patterns against the contract's own, the network's gradient, windows, masking."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changelens.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def slow_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                out.append((k, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("ab@.-+ ()0123456789%é\n"), max_size=50))
def test_patterns(text):
    assert pii.base_spans(text) == slow_base(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "@x@y.z", "1.2.3.4.5.6.7.8", "0001.2.3.255", "4111111111111111 4111 1111 1111 1111", "+1 (829) 555-7292 +49 30 1234567", "٣.1.2.3.4", "x" * 9 + "@b"])
def test_pattern_cases(text):
    assert pii.base_spans(text) == slow_base(text)


def test_patterns_are_linear_in_runs():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@a" * 50_000, "+1" * 50_000, "1." * 50_000, "1 " * 100_000, "a." * 50_000 + "@"):
        pii.base_spans(text)


def test_gradient():
    t = pii.Tagger(seed=2)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    xs, ys = zip(*[pii.windows_of(*g) for g in pii.generate(3)])
    x, y = np.concatenate(xs), np.concatenate(ys)
    _, g = t.loss(x, y)
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = t.p[k][i]
        side = []
        for d in (1e-3, -1e-3):
            t.p[k][i] = old + d
            side.append(t.loss(x, y)[0])
        t.p[k][i] = old
        assert abs((side[0] - side[1]) / 2e-3 - g[k][i]) < 0.02 * abs(g[k][i]) + 1e-3


@pytest.fixture(scope="module")
def tagger():
    xs, ys = zip(*[pii.windows_of(*g) for g in pii.generate(1000)])
    t = pii.Tagger()
    t.fit(np.concatenate(xs).astype(np.int64), np.concatenate(ys).astype(np.int64), 10)
    return t


def test_viterbi_is_the_best_allowed_path(tagger):
    small = pii.Tagger({k: v.copy() for k, v in tagger.p.items()})
    x = pii.classes("a@b.co")[None, :4]
    emit, trans = small.emissions(x)[:, 0], small.p["trans"]
    best, path = -1e9, None
    ok = pii.allowed()
    for p in np.ndindex(*[pii.TAGS] * 4):
        if (p[0] and p[0] % 2 == 0) or not all(ok[a, b] for a, b in zip(p, p[1:])):
            continue
        v = sum(emit[i, q] for i, q in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
        if v > best:
            best, path = v, p
    assert tuple(small.viterbi(x)[0]) == path


def test_tagger_finds_what_patterns_miss_and_leaves_look_alikes(tagger):
    total = found = extra = missed_by_base = 0
    for text, spans in pii.generate(300, seed=77):
        (base, more), = pii.find(tagger, [text])
        got = set(base) | set(more)
        total, found, extra = total + len(spans), found + len(got & set(spans)), extra + len(got - set(spans))
        missed_by_base += len(set(spans) - set(base))
    assert missed_by_base > 20 and found >= 0.93 * total and extra <= 0.04 * total


def test_windows_are_reconciled_over_the_whole_text(tagger):
    span = "reach me at 263-407-8421 today "
    alone = pii.find(tagger, ["word " * 16 + span])[0][1]
    assert [("phone", 24)] == [(pii.KINDS[k], b - a + 12) for k, a, b in alone]
    for shift in range(0, 90, 7):
        text = "w" * shift + " " + "word " * 16 + span + "word " * 50 + span
        more = pii.find(tagger, [text])[0][1]
        assert [text[a:b] for _, a, b in more] == ["263-407-8421"] * 2


def test_operator(spark, tagger):
    data = [(1, "mail ab.c@mail9.example.com or +1 (829) 555-7292, 4229999743742645", 5, "z"), (2, None, 0, "z"), (2, None, 0, "z"), (None, "", 0, None), (3, "clean text", 10, "z"), (4, "7 " * 30_000, 1, "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.digest(pii.pii(docs, tagger)).collect()}
    for i, text, *_ in data:
        base = slow_base(text or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == j for b in base) for j in range(4)]
        assert set(line.split(",")) <= set(got[i].spans.split(","))
    assert pii.digest(pii.pii(docs, tagger)).count() == 6 and pii.pii(docs.limit(0), tagger).count() == 0
    out = pii.mask(docs, tagger)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text.startswith("mail <EMAIL> or <PHONE>, ") and rows[1].n_chars == len(rows[1].text)
    assert rows[3].text == "clean text" and rows[2].text is None and rows[3].n_chars == 10


def test_training_on_documents(spark):
    data = [(i, t) for i, (t, _) in enumerate(pii.generate(60, seed=5))]
    t = pii.train(spark.createDataFrame(data, "doc_id long, text string"), most=20, generated=50, epochs=1)
    assert all(np.isfinite(v).all() for v in t.p.values())
    pii.train(spark.createDataFrame([], "doc_id long, text string"), generated=20, epochs=1)


def test_added_spans_are_right(tagger):
    """On generated texts that weren't trained on: spans that the tagger adds to those of the patterns."""
    held = pii.generate(400, seed=99)
    right = wrong = missed = base_only = 0
    for (_, truth), (base, more) in zip(held, pii.find(tagger, [t for t, _ in held])):
        want = set(truth)
        right += len(want & set(more))
        wrong += len(set(more) - want)
        base_only += len(want & set(base))
        missed += len(want - set(base) - set(more))
    assert right > 0.5 * (right + missed) and wrong <= 0.1 * (right + wrong) and base_only > right
