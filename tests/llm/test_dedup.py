"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from changelens.llm import exact_dedup, similar, simhash
from changelens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=160, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    base = [" ".join(word() for _ in range(r.randint(1, 90))) for _ in range(30)]
    out = [(1000, None), (1001, ""), (1002, "  \t"), (1003, None), (1004, "One two"), (1005, "oNE two"), (1006, "x" * 50_000)]
    for i in range(n):
        t = r.choice(base)
        if r.random() < 0.5:
            w = t.split(" ")
            w[r.randrange(len(w))] = word()
            t = r.choice([" ", "\n", "  "]).join(w)
        out.append((i, t))
    r.shuffle(out)
    return [(i, t, "en", "s", 0) for i, t in out]


def test_perfect_hash_is_minimal_and_byte_checked():
    d = np.array([list(hashlib.sha256(str(i).encode()).digest()) for i in range(3000)], np.uint8)
    levels, slots = exact_dedup.build_mph(d[:2000])
    assert sorted(slots) == list(range(2000))
    assert (exact_dedup.find_slots(levels, d[:2000]) == slots).all()
    bits, sizes = exact_dedup._pack(levels)
    again = exact_dedup._unpack(bits, sizes)
    assert all((a == b).all() for a, b in zip(levels, again))
    held = np.empty_like(d[:2000])
    held[slots] = d[:2000]
    got = exact_dedup.find_slots(levels, d[2000:])
    assert not (held[got[got >= 0]] == d[2000:][got >= 0]).all(axis=1).any()


def test_exact_dedup_equals_grouping(spark):
    data = rows()
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, DOCS)).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in data}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    assert len(got) == len(data)
    for x in got:
        g = groups[norm[x.doc_id]]
        assert (x.keep_id, x.group_size, x.kept) == (min(g), len(g), x.doc_id == min(g))
        assert x.text_sha256 == hashlib.sha256(norm[x.doc_id].encode()).hexdigest()


def test_exact_dedup_edge_cases(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame(
        [(None, "a", 1, "z"), (None, "a", 2, "z"), (5, "b", 3, "z"), (None, "b", 4, None), (5, "b", 3, "z")],
        "doc_id long, text string, digest long, keep_id string",
    )
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()}
    assert got == {(None, None, 2, True), (5, 5, 3, True), (None, 5, 3, False)}
    assert exact_dedup.drop_exact_duplicates(odd).columns == odd.columns


ODD = [  # a repeated id with several texts, repeated rows, null ids, clashing names
    (1, "a b c d e f g", 1, 1), (5, "unique words stand here alone today", 2, 2), (5, "a b c d e f g", 3, 3), (2, "other", 4, 4), (3, "z", 5, 5), (3, "z", 5, 5), (3, "z", 4, 9),
    (None, "a b c d e f g", 6, 6), (None, "only null ids have this", 7, 7), (None, "only null ids have this", 8, 8), (7, None, 1, 1), (8, "", 1, 1), (2**63 - 1, "largest", 1, 1), (-(2**63), "least", 1, 1),
]
ODD_SCHEMA = "doc_id long, text string, __gone long, __stay long"


def test_exact_duplicates_go_row_by_row(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    want = [(1, "a b c d e f g"), (5, "unique words stand here alone today"), (2, "other"), (3, "z"), (None, "only null ids have this"), (7, None), (2**63 - 1, "largest"), (-(2**63), "least")]
    assert got == sorted(want, key=str)
    again = exact_dedup.drop_exact_duplicates(spark.createDataFrame([(1, "a  b", 1), (1, "a b", 1), (2, "a b", 1)], "doc_id long, text string, ROW_ID long"))
    assert [x.doc_id for x in again.collect()] == [1]
    ids = {x.doc_id: x.keep_id for x in exact_dedup.exact_dedup(docs).collect()}
    assert ids[2**63 - 1] == 2**63 - 1


def test_near_duplicates_go_row_by_row(spark):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    want = [(1, "a b c d e f g"), (5, "unique words stand here alone today"), (2, "other"), (3, "z"), (None, "only null ids have this"), (7, None), (2**63 - 1, "largest"), (-(2**63), "least")]
    for drop in (simhash.drop_near_duplicates, similar.drop_similar):
        kept = drop(docs)
        assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
        assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(want, key=str)
        assert drop(docs.limit(0)).count() == 0


def slow_print(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def slow_components(ids, prints, most=4):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(x, low.get(find(i), x))
    return [low[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a b c", "ÀÉ b\x85c d e", "one two three four", "x " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def test_golay_words_two_bits_apart_share_a_key():
    for width in (23, 18):
        r = np.random.default_rng(3)
        w = np.r_[simhash._leaders()[simhash._leaders() < 1 << width], r.integers(0, 1 << width, 300)]
        own = [set(x[x >= 0].tolist()) for x in simhash.segment_keys(w, width)]
        for i in range(width):
            for j in range(i + 1):
                turned = w ^ (1 << i) ^ ((1 << j) if j < i else 0)
                for a, b in zip(own, simhash.segment_keys(turned, width)):
                    assert a & set(b.tolist())


def test_key_links_join_what_all_pairs_join():
    r = np.random.default_rng(5)
    seeds = r.integers(0, 2**63, 40, dtype=np.uint64)
    fp = [int(s) for s in seeds]
    for _ in range(500):
        x = fp[r.integers(len(fp))]
        for _ in range(r.integers(1, 6)):
            x ^= 1 << int(r.integers(64))
        fp.append(x)
    fp = np.unique(np.array(fp, np.uint64))
    at, key = simhash.keys(fp)
    a, b = simhash.key_links(key, fp[at])
    root = simhash.roots(len(fp), np.searchsorted(fp, a), np.searchsorted(fp, b))
    want = slow_components(list(range(len(fp))), [int(x) for x in fp])
    assert root.tolist() == want


def test_near_duplicates(spark):
    data = rows(120, 9)
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(data, DOCS)).collect()}
    ids, prints = [x[0] for x in data], [slow_print(x[1]) for x in data]
    assert {i: got[i].fp % 2**64 for i in ids} == dict(zip(ids, prints))
    assert [got[i].component_id for i in ids] == slow_components(ids, prints)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    stay = simhash.drop_near_duplicates(spark.createDataFrame(data, DOCS))
    assert stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in stay.collect()} == {g.component_id for g in got.values()}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 5), (5, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}


def test_contracted_links_join_the_same(spark, monkeypatch):
    from changelens.llm import components as c

    r = np.random.default_rng(4)
    pairs = r.integers(0, 400, (900, 2))
    own = c.stars(pairs)
    assert len(own) == len(set(own[:, 0])) and (own[:, 0] > own[:, 1]).all()
    assert c.stars(np.zeros((0, 2), np.int64)).shape == (0, 2)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in pairs] + [(None, 3), (5, None)], "a long, b long").repartition(3)
    got = c.contracted(links, 902).collect()
    assert len(got) <= len(own) + 2 and all(x.hi > x.lo for x in got)
    want = c.roots(400, pairs[:, 0], pairs[:, 1])
    assert (c.roots(400, np.array([x.hi for x in got]), np.array([x.lo for x in got])) == want).all()
    assert {x.node: x.root for x in components(links).collect()} == {k: int(want[k]) for k in range(400) if k in pairs[pairs[:, 0] != pairs[:, 1]]}
