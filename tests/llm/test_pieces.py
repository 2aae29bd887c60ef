"""Encoding and decoding against the library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changelens.llm import pieces

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    return pieces.Codec(pieces.default_model()), spm.SentencePieceProcessor(model_file=pieces.default_model())


def same(both, batch):
    own, lib = both
    want = [lib.encode(t) + [2] for t in batch]
    assert own.encode(batch) == want
    assert [own.decode(i) for i in want] == [lib.decode(i) for i in want]
    for t, d in zip(batch, own.digests(batch)):
        ids = lib.encode(t) + [2]
        assert d == (
            len(ids),
            hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(lib.decode(ids).encode()).hexdigest(),
        )


def test_odd_texts(both):
    same(both, ["", " ", "  a  b ", "a\n\nb\t c", "<s> </s> <0x41> ▁x▁", "\U00012000你好﻿", "\x00a\x00", "aaaa" * 50, "a" * 3001, "ab" * 2000 + " " * 100, "1" * 400, "====" * 99, "éÉ́"])


def test_runs_and_mixes(both):
    r = random.Random(4)
    alphabet = "aeiou tnsr éßñ.,!\n-" + "аб" + "th"
    same(both, ["".join(r.choices(alphabet, k=r.randint(1, 400))) for _ in range(400)])
    same(both, ["".join(r.choices("ab", k=r.randint(1, 60))) for _ in range(400)])
    same(both, ["".join(r.choices(["er", "th", "in", "the", "▁", " "], k=200)) for _ in range(100)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_any_text(both, batch):
    same(both, batch)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=30))
def test_any_ids_decode(both, ids):
    own, lib = both
    assert own.decode(ids) == lib.decode(ids)


def test_operator(spark):
    data = [(1, "Ein Haus", 1), (2, None, 2), (2, None, 2), (None, "", 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids long")
    enc = pieces.encode(docs)
    back = sorted((r.doc_id or 0, r.text) for r in pieces.decode(enc).collect())
    assert back == [(0, ""), (1, "Ein Haus"), (2, ""), (2, "")]
    got = {r.doc_id: r for r in pieces.round_trip(docs).collect()}
    assert got[2].n_tokens == 1 and got[2].ids_sha256 == hashlib.sha256(b"2").hexdigest()
    assert pieces.round_trip(docs.limit(0)).count() == 0
