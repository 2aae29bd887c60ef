"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The text is cut where no piece of the vocabulary can reach across (before each run of the space
mark), and each distinct unit is encoded once.  All units of a batch lie in flat numpy arrays.  A
round finds each unit's best-ranked pair by a segmented minimum, merges its leftmost occurrences that
do not overlap, all units at once, compacts the arrays and looks up the ranks of new pairs only.  Units
without a pair are taken out.  Rounds go on until none is left.

Merging all occurrences at once equals merging them one by one as long as no piece that ranks before
the merged one begins or ends with it; where one does, only the leftmost occurrence is merged.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changelens.llm._util import texts, tune

#: Fixed values of the format: the space mark, piece kinds, the id of the end mark.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
END_ID = 2
NONE = np.iinfo(np.int32).max
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Units held in a worker's memory, and the longest that is held.
CACHE_UNITS, CACHE_CHARS = 200_000, 40


def _varint(b: bytes, i: int) -> tuple[int, int]:
    r = s = 0
    while True:
        c = b[i]
        i += 1
        r |= (c & 127) << s
        s += 7
        if c < 128:
            return r, i


def _fields(b: bytes):
    """(number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        k, i = _varint(b, i)
        kind = k & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield k >> 3, v


class Codec:
    """Vocabulary, pair table and caches of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, trainer, normal = [], {}, {}
        for k, v in _fields(raw):
            if k == 1:
                p = dict(_fields(v))
                score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                pieces.append((p[1].decode(), score, p.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normal = dict(_fields(v))
        kinds = {t for _, _, t in pieces}
        if trainer.get(3) != 2 or normal.get(2) or UNUSED in kinds or USER in kinds or BYTE not in kinds:
            raise ValueError("only BPE models with identity normalisation and byte fallback are read")
        if normal.get(3, 1) != 1 or normal.get(4, 1) or normal.get(5, 1) != 1:
            raise ValueError("a dummy prefix, escaped spaces and kept white space are expected")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in pieces if t == NORMAL):
            raise ValueError("a piece reaches across a space mark")
        self.kinds = [t for _, _, t in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.surface = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode()
            for p, _, t in pieces
        ]
        vocab = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        symbols = dict(vocab)
        for c in sorted({c for p in vocab for c in p} - set(vocab)):
            symbols[c] = len(pieces) + len(symbols) - len(vocab)
        self.base = len(pieces) + len(symbols) - len(vocab)  # beyond: a code point that no piece has
        self.chars = np.arange(0x110000, dtype=np.int32) + self.base
        for s, i in symbols.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.piece = np.full(self.base, -1, np.int32)  # id of a symbol, -1: bytes stand for it
        self.piece[list(vocab.values())] = list(vocab.values())
        self.char_of = {i: s for s, i in symbols.items() if len(s) == 1}
        order = sorted({-pieces[i][1] for i in vocab.values()})
        rank = {s: r for r, s in enumerate(order)}
        ranks = {p: rank[-pieces[i][1]] for p, i in vocab.items()}
        shared = np.bincount(list(ranks.values()), minlength=len(order)) > 1
        unsafe = {p for p in vocab if shared[ranks[p]]}
        left, right, made = [], [], []
        for p, i in vocab.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbols and b in symbols:
                    left.append(symbols[a])
                    right.append(symbols[b])
                    made.append(i)
                for x in (a, b):
                    if x in ranks and ranks[x] > ranks[p]:
                        unsafe.add(x)
        self.wide = self.base + 0x110000
        pair = np.array(left, np.int64) * self.wide + np.array(right, np.int64)
        at = np.argsort(pair)
        self.pair, self.made = np.append(pair[at], np.iinfo(np.int64).max), np.array(made, np.int32)[at]
        self.rank = np.full(self.base, NONE, np.int32)
        self.rank[list(vocab.values())] = [ranks[p] for p in vocab]
        self.unsafe = np.zeros(self.base, bool)
        self.unsafe[[vocab[p] for p in unsafe]] = True
        self.cache: tuple[dict[str, str], dict[str, int], dict[str, str]] = ({}, {}, {})  # ids, count, text of units

    # ------------------------------------------------------------------ merge rounds
    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 for none."""
        key = a.astype(np.int64) * self.wide + b
        at = np.searchsorted(self.pair, key)
        hit = self.pair[at] == key
        return np.where(hit, self.made[np.minimum(at, len(self.made) - 1)], -1)

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units (none empty) -> (flat symbols, symbols in each unit)."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        sym = self.chars[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]
        word = np.repeat(np.arange(len(units)), sizes)
        make = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        make[inner] = self._look(sym[inner], sym[inner + 1])
        done_sym, done_word = [], []
        while len(sym):
            rank = np.where(make >= 0, self.rank[make], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(word)])
            over = np.repeat(best == NONE, size)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                stay = ~over
                sym, word, make, rank = sym[stay], word[stay], make[stay], rank[stay]
                size, best = size[best != NONE], best[best != NONE]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            pick = rank == np.repeat(best, size)
            at = np.flatnonzero(pick)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # a run's pairs overlap one another
            step = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[step % 2 == 0]
            if self.unsafe[make[at]].any():
                lead = np.r_[True, word[at][1:] != word[at][:-1]]
                risky = np.zeros(word[-1] + 1, bool)
                risky[word[at][self.unsafe[make[at]]]] = True
                at = at[lead | ~risky[word[at]]]
            sym[at] = make[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            new = place[at]
            sym, word, make = sym[keep], word[keep], make[keep]
            for x in (new, new[new > 0] - 1):
                make[x] = -1
                x = x[x + 1 < len(sym)]
                x = x[word[x] == word[x + 1]]
                make[x] = self._look(sym[x], sym[x + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(units))

    def _unit_ids(self, units: list[str]):
        sym, sizes = self.merge(units)
        ids = np.where(sym < self.base, self.piece[np.minimum(sym, self.base - 1)], -1)
        plain, symbols = ids.tolist(), sym.tolist()
        at = 0
        for n in sizes.tolist():
            own = plain[at : at + n]
            if -1 in own:
                full = []
                for k, i in enumerate(own):
                    if i >= 0:
                        full.append(i)
                    else:
                        s = symbols[at + k]
                        c = chr(s - self.base) if s >= self.base else self.char_of[s]
                        full += [self.byte_id[x] for x in c.encode("utf-8", "surrogatepass")]
                own = full
            at += n
            yield own

    # ------------------------------------------------------------------ texts
    @staticmethod
    def units(text: str) -> list[str]:
        return UNIT.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, batch: list[str]) -> list[list[int]]:
        """Ids of each text, the end mark last."""
        split = [self.units(t) for t in batch]
        new = list({u for s in split for u in s})
        known = dict(zip(new, self._unit_ids(new))) if new else {}
        return [[i for u in s for i in known[u]] + [END_ID] for s in split]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes that are no UTF-8 become U+FFFD, marks without text vanish."""
        out, raw = [], bytearray()
        surface, kinds = self.surface, self.kinds
        for i in ids:
            if kinds[i] == UNKNOWN:
                raw += " ⁇ ".encode()
            else:
                raw += surface[i]
        out = raw.decode("utf-8", "replace")
        lead = next((i for i in ids if kinds[i] != CONTROL), None)
        return out[1:] if lead is not None and kinds[lead] == NORMAL and out[:1] == " " else out

    def digests(self, batch: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text) of each text.

        A unit's ids stand for whole characters, so units decode one by one; the text's first space
        is the dummy prefix and goes.
        """
        ids_of, count, text_of = self.cache
        if len(count) > CACHE_UNITS:
            for c in self.cache:
                c.clear()
        split = [self.units(t) for t in batch]
        new = list({u for s in split for u in s if u not in count})
        for u, ids in zip(new, self._unit_ids(new) if new else ()):
            ids_of[u], count[u] = " ".join(map(str, ids)), len(ids)
            text_of[u] = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        out = []
        for s in split:
            line = " ".join([*map(ids_of.__getitem__, s), str(END_ID)])
            text = "".join(map(text_of.__getitem__, s))
            out.append(
                (
                    sum(map(count.__getitem__, s)) + 1,
                    hashlib.sha256(line.encode()).hexdigest(),
                    hashlib.sha256((text[1:] if s else "").encode()).hexdigest(),
                )
            )
        for u in new:
            if len(u) > CACHE_CHARS:
                for c in self.cache:
                    del c[u]
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` of every row; null and empty texts give the end mark alone."""
    tune(docs.sparkSession)
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            ids = c.encode(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give a null text."""
    tune(encoded.sparkSession)
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            text = [None if i is None else c.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded and decoded in one pass, so that
    neither ids nor texts are shuffled or written.  One row per input row; repeats repeat."""
    tune(docs.sparkSession)
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            rows = c.digests(b.column("text").to_pylist())
            n, ids, text = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
