"""Packing: exact tokens, gapless sequences, close to the best possible count."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changelens.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def test_fast_tokens_equal_the_json_file():
    t = packing.Tokens(*packing.default_paths())
    cases = []
    for c in map(chr, range(0x250)):
        cases += [f"a{c}b {c} 1{c}2{c}{c}", f"{c}x\n{c}'s {c}", f" {c}{c} !{c}a  {c}"]
    cases += ["<|endoftext|> a<|endoftext|>", "日本 　x", "   a", "a" * 5000, " " * 3000 + "x", "I'll we'VE"]
    for x in cases:
        assert t.encode(x).tolist() == t.whole.encode(x, add_special_tokens=False).ids, repr(x)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=80))
def test_fast_tokens_on_any_text(x):
    t = packing.tokens(*packing.default_paths())
    assert t.encode(x).tolist() == t.whole.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)])])
def test_cuts(n, want):
    assert packing.cuts(n) == want


def sequential(lengths, gaps=(), capacity=60):
    """Best fit, one piece after the other, longest first: how many sequences open."""
    gaps, opened = list(gaps), 0
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        else:
            opened += 1
        gaps.append((min(fit) if fit else capacity) - n)
    return opened


def one_sweep(pieces, gaps):
    """Each piece, longest first, with the smallest gap that fits and isn't taken: sizes that meet."""
    free, out = sorted(gaps), []
    for n in sorted(pieces, reverse=True):
        at = next((k for k, g in enumerate(free) if g >= n), None)
        if at is not None:
            out.append((n, free.pop(at)))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.lists(st.integers(1, 30), max_size=60), st.lists(st.integers(0, 120), max_size=4))
def test_ranges_swept_apart_equal_one_sweep(pieces, gaps, cuts):
    rows = sorted([(-n, 1) for n in pieces] + [(-g, 0) for g in gaps])
    bounds = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    met, alone = [], []
    for a, b in zip(bounds, bounds[1:]):
        own = rows[a:b]
        partner = packing.sweep(np.array([k for _, k in own], np.int32))
        met += [(-own[k][0], -own[p][0]) for k, p in enumerate(partner) if p >= 0 and own[k][1]]
        alone.append(([-x[0] for x, p in zip(own, partner) if p < 0 and x[1]], [-x[0] for x, p in zip(own, partner) if p < 0 and not x[1]]))
    for part, r0, m, q, last in packing.between([(len(x), len(y)) for x, y in alone]):
        met += [(alone[part][0][r0 + k], alone[q][1][last - k]) for k in range(m)]
    assert sorted(met) == one_sweep(pieces, gaps)


def checked(rows, capacity):
    held = {}
    for x in rows:
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in held.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= capacity
    return len(held)


def test_supersteps_are_valid_and_near_best_fit(spark):
    r = np.random.default_rng(3)
    lengths = [int(x) for x in np.r_[r.integers(1, 61, 700), np.full(300, 7), np.full(5, 60)]]
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack_pieces(parts, 60).collect()
    assert sorted((x.doc_id, x.length) for x in got) == list(enumerate(lengths))
    assert checked(got, 60) <= 1.02 * sequential(lengths) + 1


def test_many_pieces_leave_little_room(spark):
    r = np.random.default_rng(2)
    lengths = r.integers(1, 1025, 20_000)
    parts = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack_pieces(parts).collect()
    assert len(got) == len(lengths) and checked(got, 1024) <= 1.01 * lengths.sum() / 1024


@pytest.mark.parametrize("lengths", [[5], [10] * 600, [1] * 900 + [511] * 3, [300, 300, 300, 100, 100, 100] * 40], ids=["one", "equal", "short", "mixed"])
def test_supersteps_go_on_to_the_last_piece(spark, monkeypatch, lengths):
    """Few pieces are packed by supersteps too, in few of them, and as well as by a sequential best fit."""
    steps, step = [], packing._superstep
    monkeypatch.setattr(packing, "_superstep", lambda *a: steps.append(1) or step(*a))
    parts = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    got = packing.pack_pieces(parts).collect()
    assert sorted((x.doc_id, x.length) for x in got) == list(enumerate(lengths))
    assert checked(got, 1024) <= sequential(lengths, capacity=1024) and 1 <= len(steps) <= 12


def test_slots(spark):
    gaps = spark.createDataFrame([(1, 35), (2, 9), (3, 100)], "id long, size long")
    got = {}
    for r in packing.slots(gaps, 10, 4).collect():
        got.setdefault(r.id, []).append(r["size"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [10, 10, 15], 2: [9], 3: [10, 10, 10, 70]}


def test_pack(spark):
    r = np.random.default_rng(7)
    data = [(i, " ".join(["word", "éa", "x1"][k] for k in r.integers(0, 3, r.integers(0, 700))), "k") for i in range(80)]
    data += [(100, None, "k"), (101, "", "k"), (None, "a", "k"), (3, data[3][1], "k"), (200, "long text " * 3000, "k")]
    docs = spark.createDataFrame(data, "doc_id long, text string, length string")
    got = packing.pack(docs, with_ids=True).collect()
    t = packing.tokens(*packing.default_paths())
    want = []
    for i, text, _ in data:
        ids = t.whole.encode(text or "", add_special_tokens=False).ids + [2]
        want += [(i or -1, k, s, ids[s : s + n]) for k, (s, n) in enumerate(packing.cuts(len(ids)))]
    assert sorted((x.doc_id or -1, x.piece, x.start, x.ids) for x in got) == sorted(want)
    held = {}
    for x in got:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in held.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 1024
    assert len(held) <= 1.05 * sum(len(w[3]) for w in want) / 1024 + 1
    whole = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert sum(len(s.ids) for s in whole) == sum(len(w[3]) for w in want) and max(len(s.ids) for s in whole) <= 1024
    assert packing.pack(docs.limit(0)).count() == 0
