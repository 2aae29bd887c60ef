"""Contamination against a window-by-window search; spans in the original; several automata; cutting."""

import random
import re

import pytest

from changelens.llm import decontaminate
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"

DOC = "doc_id long, text string, mark string, runs int, items string"
ITEM = "item_id long, text string, window string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items, size=10):
    cut = lambda t: [m.group() for m in WORD.finditer((t or "").translate(FOLD))]
    wins = {(str("" if i is None else i), tuple(w[k : k + size])) for i, t in items if (w := cut(t)) for k in range(max(1, len(w) - size + 1))}
    out = []
    for i, t in docs:
        w, hit, who = cut(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    who.add(item)
        at, spans = [m.span() for m in WORD.finditer((t or "").translate(FOLD))], []
        for k in sorted(hit):
            if k - 1 in hit:
                spans[-1][1] = at[k][1]
            else:
                spans.append(list(at[k]))
        out.append((i, len(w), len(hit), tuple(sorted(who)), tuple(map(tuple, spans)), bool(hit)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.spans), r.contaminated) for r in df.collect()), key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1, "y") for d in docs], DOC), spark.createDataFrame([(*i, "z") for i in items], ITEM)


def made(seed):
    """Few words, so that windows meet by chance; item passages planted; nulls, repeats, letters beyond ASCII."""
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(["the", "Été", "b2", "Who", "日本"]) for _ in range(n))
    items = [(k, some(r.choice([3, 4, 6, 9]))) for k in range(8)] + [(None, "zz QQ zz"), (3, "another row of three"), (50, None), (51, "?!"), (52, "")]
    docs = [(k, some(r.choice([0, 1, 5, 40]))) for k in range(30)]
    docs += [(100, f"é, x{items[0][1].replace(' ', '--')}, y"), (101, f"{items[0][1].replace(' ', chr(9))}...{items[1][1]}"), (None, "zz qq ZZ"), (102, None), (103, "zz qq\nZZ"), (103, "zz qq\nZZ"), (104, "")]
    return docs, items


@pytest.mark.parametrize("letters", [decontaminate.LETTERS, 40])
def test_report(spark, letters):
    """With 40 letters in an automaton there are many passes, and the result is the same."""
    docs, items = made(1)
    assert rows_of(decontaminate.contamination(*frames(spark, docs, items), size=4, letters=letters)) == plain(docs, items, 4)


def test_long_texts_and_many_hits(spark):
    docs = [(1, "a b c d e " * 60_000 + "tail"), (2, "a b c d")]
    # of the long text only the first a, the last d and e, and the tail stand in no window
    got = rows_of(decontaminate.contamination(*frames(spark, docs, [(1, "b c d e a b"), (2, "c")]), size=5))
    assert got[0][1:4] == (300_001, 299_997, ("1", "2")) and got[1][1:4] == (4, 1, ("2",))


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a b")])
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert rows_of(decontaminate.contamination(docs, items.limit(0))) == [(1, 2, 0, (), (), False)]


def test_cut_and_drop(spark):
    docs, items = made(2)
    d, b = frames(spark, docs, items)
    want = {repr(x[0]): x for x in plain(docs, items, 4)}
    clean = [(i, t) for i, t in docs if not want[repr(i)][5]]
    got = decontaminate.drop_contaminated(d, b, 4)
    assert got.columns == d.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(clean, key=repr)
    after = decontaminate.cut(d, b, 4)
    assert after.columns == d.columns and after.count() == len(docs)
    for r in after.collect():
        text = dict(docs)[r.doc_id]
        for a, z in reversed(want[repr(r.doc_id)][4]):
            text = text[:a] + text[z:]
        assert r.text == text


def test_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    df = decontaminate.digest(decontaminate.contamination(docs, items))
    assert compare(df, connect(SF), decontaminate.ORACLE_SQL) is None and df.where("contaminated").count() > 0
