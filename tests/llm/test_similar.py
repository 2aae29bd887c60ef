"""Similar documents against all pairs."""

import random
from collections import Counter

import numpy as np

from changelens.llm import similar, simhash
from tests.llm.test_dedup import slow_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def copies(seed=6, groups=14):
    """Texts, and copies of them with one word in some sixty turned: Jaccard from 0.6 to 0.95."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    out = []
    for g in range(groups):
        base = [word() for _ in range(r.randint(80, 260))]
        out.append(base)
        for _ in range(r.randint(0, 9)):
            w = list(base)
            for _ in range(r.randint(1, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = word()
            out.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    rows += [(500, None), (501, ""), (502, "one two"), (503, "One  TWO"), (504, "x " * 40_000), (505, "x " * 30_000)]
    r.shuffle(rows)
    return rows


def brute(rows, least=0.8):
    sets = {i: similar.shingles(t or "") for i, t in rows}
    ids = sorted(sets)
    links = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and both >= least * (len(sets[a]) + len(sets[b]) - both):
                links.add((a, b))
    return links


def roots(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_shingles():
    assert len(similar.shingles("")) == 0 and len(similar.shingles("a b")) == 1
    assert (similar.shingles("A b c d e") == similar.shingles(" a\nb c d e ")).all()
    assert len(similar.shingles("a b c d e f g")) == 3 and len(similar.shingles("x " * 50)) == 1


def links_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    sketched = similar.sketches(docs)
    name = {x.node: x.doc_id for x in sketched.collect()}
    return {tuple(sorted((name[x.a], name[x.b]))) for x in similar.similar_links(docs, sketched).collect()}


def test_links_are_true_and_nearly_all_found(spark):
    rows = copies()
    got, want = links_of(spark, rows), brute(rows)
    assert got <= want and len(want) > 100
    ids = [i for i, _ in rows]
    a, b = roots(ids, got), roots(ids, want)
    assert sum(a[i] == b[i] for i in ids) >= 0.98 * len(ids)


def test_pairs_at_the_threshold_share_a_key():
    r = np.random.default_rng(0)
    prints, least = [[], []], [[], []]
    for _ in range(400):
        pool = r.integers(2**63, size=333, dtype=np.uint64)
        for side, own in enumerate((pool[:300], pool[33:])):  # 267 of 333: a similarity of 0.8
            p, m = similar.sketch(own)
            prints[side].append(p)
            least[side].append(m)
    held = [[set() for _ in range(400)] for _ in range(2)]
    for side in range(2):
        at, key, _ = similar.keys(np.array(prints[side]).view(np.uint64), np.array(least[side]).view(np.uint64))
        for k, x in zip(at.tolist(), key.tolist()):
            held[side][k].add(x)
    shared = sum(bool(x & y) for x, y in zip(*held))
    d = np.bitwise_count(np.array(prints[0]).view(np.uint64) ^ np.array(prints[1]).view(np.uint64)).sum(1)
    assert shared >= 0.97 * 400 and (d <= similar.MOST_BITS).mean() >= 0.99


def family(n, seed, bits=6):
    r = np.random.default_rng(seed)
    base = r.integers(2**62, size=2, dtype=np.uint64)
    out = []
    for _ in range(n):
        x = base.copy()
        for b in r.integers(0, 64, bits):
            x[r.integers(2)] ^= np.uint64(1 << int(b))
        out.append(x)
    return np.array(out, np.uint64)


def test_one_key_tells_as_many_pairs_as_members_and_joins_all_candidates():
    for n in (3, 20, 200, 3000):
        prints = np.concatenate([family(n, 1), family(n, 2), family(1, 3)])
        ids = np.random.default_rng(4).permutation(len(prints))
        pairs, loose, open_ = similar.chosen(np.zeros(len(prints), np.uint64), ids, prints)
        assert len(pairs) <= 2 * len(prints) + 6
        where = np.argsort(ids)
        d = np.bitwise_count(prints[where[pairs[:, 0]]] ^ prints[where[pairs[:, 1]]]).sum(1)
        assert (d <= similar.MOST_BITS).all()
        every = [(int(a), int(b)) for a, b in np.concatenate([pairs, loose])]
        low = roots(range(len(prints)), every)
        assert sorted(Counter(low.values()).values()) == [1, n, n]
        if n > 20:
            assert set(open_.tolist()) >= set(ids[: 2 * n].tolist())


def test_what_a_task_tells_joins_what_it_has_chosen():
    r = np.random.default_rng(8)
    for _ in range(30):
        pairs, loose = np.unique(np.sort(r.integers(0, 30, (12, 2)), axis=1), axis=0), r.integers(0, 30, (9, 2))
        pairs, loose = pairs[pairs[:, 0] != pairs[:, 1]], loose[loose[:, 0] != loose[:, 1]]
        open_ = np.union1d(loose, r.integers(0, 30, 3))
        one, near, rest = similar.told(pairs, loose, open_)
        assert sorted(map(tuple, np.concatenate([one, near]).tolist())) == sorted(map(tuple, pairs.tolist()))
        assert set(np.concatenate([near, rest]).ravel().tolist()) == set(open_.tolist())
        before, after = np.concatenate([pairs, loose]).tolist(), np.concatenate([one, near, rest]).tolist()
        assert roots(range(30), before) == roots(range(30), after) and len(rest) <= len(open_)
    none, flat = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    assert [len(x) for x in similar.told(none, none, flat)] == [0, 0, 0]


def test_pairs_of_a_key_that_leaves_some_out_are_close_or_open():
    prints = family(60, 11, bits=12)
    ids = np.arange(60)
    pairs, loose, open_ = similar.chosen(np.zeros(60, np.uint64), ids, prints)
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(-1)
    assert (d[pairs[:, 0], pairs[:, 1]] <= similar.CLOSE).all() and set(open_.tolist()) == set(ids.tolist())
    few = family(4, 12, bits=12)
    pairs, loose, open_ = similar.chosen(np.zeros(4, np.uint64), ids[:4], few)
    d = np.bitwise_count(few[:, None] ^ few[None]).sum(-1)
    want = {(a, b) for a in range(4) for b in range(a + 1, 4) if d[a, b] <= similar.MOST_BITS}
    assert {tuple(p) for p in pairs.tolist()} == want and not len(open_)


def test_walk_joins_what_candidates_join():
    prints = np.concatenate([family(40, 5), family(25, 6), family(1, 7)])
    x, y = similar._walk(prints, similar.MOST_BITS)
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(-1) <= similar.MOST_BITS
    every = list(zip(*np.nonzero(np.triu(d, 1))))
    assert roots(range(66), list(zip(x.tolist(), y.tolist()))) == roots(range(66), every)


def stars():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for star in range(2):  # variants are 0.8 like the text of a late id, but not like each other
        hub = [word() for _ in range(400)]
        for v in range(40):
            w = list(hub)
            for k in r.sample(range(0, 390, 6), 8):
                w[k] = word()
            rows.append((100 * star + v, " ".join(w)))
        rows.append((100 * star + 90, " ".join(hub)))
    return rows


def test_stars_join(spark):
    rows = stars()
    got, true = links_of(spark, rows), brute(rows)
    assert got <= true
    ids = [i for i, _ in rows]
    a, b = roots(ids, got), roots(ids, true)
    assert sum(a[i] == b[i] for i in ids) >= 0.95 * len(ids)


def test_blocks_are_compared_whole(spark, monkeypatch):
    """Blocks of a few documents join what larger ones join."""
    rows = stars() + copies(3, 6)[:40]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    want = links_of(spark, rows)
    monkeypatch.setattr(similar, "BLOCK", 2000)
    assert roots([i for i, _ in rows], links_of(spark, rows)) == roots([i for i, _ in rows], want)
    prints = family(30, 9)
    sets = [np.unique(np.random.default_rng(k % 5).integers(1 << 60, size=50, dtype=np.uint64)) for k in range(30)]
    pairs = similar.block_links(np.full(30, 2), np.arange(30), np.arange(30), prints, sets, 0.8, 64)
    assert roots(range(30), pairs) == {k: k % 5 for k in range(30)}
    side = np.r_[np.zeros(15, int), np.ones(15, int)]
    pairs = similar.block_links(side, np.arange(30), np.arange(30), prints, sets, 0.8, 64)
    assert all(a < 15 <= b for a, b in pairs) and len(set(roots(range(30), pairs).values())) == 5


def test_a_crowded_batch_sends_on_a_few(spark, monkeypatch):
    r = random.Random(5)
    hub = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
    rows = []
    for k in range(300):
        w = list(hub)
        w[r.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(similar, "FEW", 4)
    assert set(roots(range(300), links_of(spark, rows)).values()) == {0}


def test_drop_similar(spark):
    rows = copies(9, 8)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    ids = [i for i, _ in rows]
    close = slow_components(ids, [simhash.fingerprint(t) for _, t in rows])
    want = roots(ids, brute(rows) | {(a, b) for a, b in zip(close, ids)})
    got = {r.doc_id for r in kept.collect()}
    assert {i for i in ids if want[i] == i} <= got and len(got) <= len({*want.values()}) + 1
    odd = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (3, "a b", 3)], "doc_id long, text string, node long")
    assert similar.drop_similar(odd).columns == odd.columns and [x.doc_id for x in similar.drop_similar(odd).collect()] == [3]


def test_covered_members_are_close_to_who_stands_for_them():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, (5, 2), dtype=np.uint64)
    prints = base[r.integers(0, 5, 400)]
    for _ in range(9):
        prints[np.arange(400), r.integers(0, 2, 400)] ^= np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)
    heads, lead = similar.covered(prints)
    assert set(heads) == set(lead) and (lead[heads] == heads).all() and len(heads) < 60
    assert (np.bitwise_count(prints ^ prints[lead]).sum(1) <= similar.CLOSE).all()


def test_recall_in_a_crowded_family(spark):
    """A family of texts some 0.66 alike, two and two of which are 0.85 alike: 95 % of the pairs are joined at least."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    hub, rows = [word() for _ in range(300)], []
    for k in range(200):
        w = list(hub)
        for at in r.sample(range(0, 300, 6), 13):
            w[at] = word()
        v = list(w)
        for at in r.sample(range(3, 300, 20), 4):
            v[at] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    r.shuffle(rows)
    sets = {i: similar.shingles(t) for i, t in rows}
    alike = lambda a, b: (both := len(np.intersect1d(sets[a], sets[b]))) / (len(sets[a]) + len(sets[b]) - both)
    wanted = [k for k in range(200) if alike(2 * k, 2 * k + 1) >= 0.8]
    assert len(wanted) > 150 and np.mean([alike(2 * k, 2 * k + 2) for k in range(199)]) < 0.75
    root = roots(range(400), links_of(spark, rows))
    assert sum(root[2 * k] == root[2 * k + 1] for k in wanted) >= 0.95 * len(wanted)


def test_recall_on_documents(spark):
    """Of all pairs of the table that are 0.8 alike, found by a join on shingles, 95 % are joined at least."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    own, at = {i: similar.shingles(t) for i, t in rows}, {}
    for i, s in own.items():
        for h in s.tolist():
            at.setdefault(h, []).append(i)
    shared = Counter((a, b) for ids in at.values() if len(ids) <= 400 for k, a in enumerate(ids) for b in ids[k + 1 :])
    wanted = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(own[a]) + len(own[b]) - n)]
    root = roots(sorted(own), links_of(spark, rows))
    assert wanted and sum(root[a] == root[b] for a, b in wanted) >= 0.95 * len(wanted)
