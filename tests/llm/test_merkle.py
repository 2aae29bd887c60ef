"""Merkle trees against a plain recursion: parts of any size, short runs, nulls, repeated rows, tampering."""

import random
import zlib
from hashlib import sha256

import pytest

from changelens.llm import merkle
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int, hash int"


def plain_hash(*inputs):
    return sha256("".join(inputs).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return plain_hash(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def plain_tree(nodes):
    """(root, for each leaf its (left, right) siblings by level), by folding whole levels."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes, at = [plain_hash(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def plain_proofs(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r[:5] for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[s] = own, *plain_tree([plain_leaf(*r) for r in own])
    root, tops = plain_tree([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        own, sub, paths = trees[s]
        for r, path in zip(own, paths):
            leaf = at = plain_leaf(*r)
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                at = plain_leaf(r[0], r[1].replace("\n", ""), *r[2:])
            for left, right in path + top:
                at = plain_hash(left, at, right)
            out.append((r[0], leaf, sub, root, plain_hash(*[x + y for x, y in path + top]), at, at == root))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def table(n, seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["", None, "a\nb", "\n", f"text {k}\n\n", "été\n" * 50]), r.choice([None, "en", "fr"]), r.choice([None, "", "s", "é", "web"] + ["hot"] * 5), r.choice([None, k, 0]), "x", 1, 2) for k in range(n)]
    return rows + [(None, "null\nid", "en", "hot", 3, "x", 1, 2)] * 3 + [(7, "again\n", "en", "hot", 3, "x", 1, 2)] * 40


@pytest.mark.parametrize("part", [50_000, 9])
def test_proofs(spark, monkeypatch, part):
    """Small parts make every level cross parts; copies of one row spread over several; extra columns clash with helpers'."""
    monkeypatch.setattr(merkle, "PART", part)
    monkeypatch.setattr(merkle, "TOGETHER", 3)
    rows = table(150, part)
    assert rows_of(merkle.proofs(spark.createDataFrame(rows, SCHEMA))) == sorted(plain_proofs(rows), key=repr)


def test_small_tables(spark):
    for rows in ([(1, "a\n", None, None, None, "", 0, 0)], [(k, "x", "en", "s", 1, "", 0, 0) for k in range(4)], [(k, "x", "en", str(k), 1, "", 0, 0) for k in range(5)]):
        assert rows_of(merkle.proofs(spark.createDataFrame(rows, SCHEMA))) == sorted(plain_proofs(rows), key=repr)
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    rows = [(2, "word\n" * 400_000, "en", "a", 1, "", 0, 0), (3, "", "en", "a", 1, "", 0, 0)]
    assert rows_of(merkle.proofs(spark.createDataFrame(rows, SCHEMA))) == sorted(plain_proofs(rows), key=repr)


def test_manifest(spark):
    rows = table(60, 4)
    got = {(r["kind"], r["source"]): (r["n"], r["hash"]) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    proofs = plain_proofs(rows)
    assert got["root", None] == (len(rows), proofs[0][3])
    assert {h for (kind, _), (_, h) in got.items() if kind == "source"} == {p[2] for p in proofs}
    assert got["source", "hot"][0] == sum(r[3] == "hot" for r in rows)


def test_range_in_any_cut():
    """Stacks over any cut of the leaves, merged in any grouping of neighbours, make each node once."""
    r = random.Random(5)
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 100):
        leaves = [plain_hash(str(k)) for k in range(n)]
        cuts = sorted({0, n, *(r.randrange(n + 1) for _ in range(5))})
        waiting, made = [], []
        for a, b in zip(cuts, cuts[1:]):
            stack = merkle.Range(n)
            for k in range(a, b):
                stack.push(0, k, leaves[k])
            made += stack.closed
            waiting += stack.open()
            assert len(stack.open()) <= 4 * len(stack.widths)
        last = merkle.Range(n)
        for level, k, h in sorted(waiting, key=lambda x: (x[1] * 3 ** x[0], -x[0])):
            last.push(level, k, h)
        made += last.closed
        assert not last.open() and len(made) == len({x[:2] for x in made}) == max(1, sum(merkle.widths(n)[1:]))
        assert max(made)[2] == plain_tree(leaves)[0]


def test_outside_names_all_but_own():
    for n in (1, 5, 27, 30):
        for a in range(n):
            for b in range(a + 1, n + 1):
                want, size = set(), 1
                for level, width in enumerate(merkle.widths(n)[:-1]):
                    for leaf in range(a, b):
                        run = leaf // size // 3 * 3
                        want |= {(level, k) for k in range(run, min(width, run + 3)) if k * size < a or min(n, (k + 1) * size) > b}
                    size *= 3
                assert set(merkle.outside(a, b, n)) == want


def test_tables(spark):
    df = merkle.proofs(spark.read.parquet(f"{SF}/documents.parquet"))
    assert compare(df, connect(SF), merkle.ORACLE_SQL) is None
    assert df.where("NOT verified").count() > 0 < df.where("verified").count()
