"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger reads windows that overlap by half.  Each window is decoded by Viterbi; of each text every
character takes its tag from the window in whose middle half it lies, so spans that cross windows come
out whole.  A span must hold a digit or an at sign.  Windows without either can only be tagged "no
personal data", so they are not computed; all others are, over the whole text.

The network is written and trained in numpy from labelled spans: those that the patterns find in a
bounded sample of documents, and generated sentences whose spans are known, among them forms that the
patterns miss (numbers side by side, other separators) and look-alikes that are not personal data.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm._util import released, texts, tune
from changelens.llm.sampling import SLICES

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
ANCHOR = re.compile("[0-9@]")
#: Documents and windows of each that are sampled for training, generated windows, training rounds.
FIT_DOCS, FIT_WINDOWS, GENERATED, EPOCHS = 300, 3, 1200, 12
#: Documents of which windows are looked for, as a multiple of those sampled.
THIN = 30
WINDOW, STRIDE, EMBED, HIDDEN, CHUNK = 80, 40, 12, 24, 512

# ------------------------------------------------------------------------------- patterns
# Equal to the leftmost non-overlapping matches of the patterns in the contract, but linear in the
# length of any run: an e-mail address is found from its at sign, a number only from its run's start.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(0 < len(p.lstrip("0") or "0") <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    if not ANCHOR.search(text):
        return []
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            out.append((0, a, m.end()))
            last = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if _ip(m[0])]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _card(m[0])]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ------------------------------------------------------------------------------- the network
_CLASS = np.full(129, 98, np.int64)
_CLASS[32:127] = np.arange(1, 96)
_CLASS[9:14] = 96
_CLASS[128] = 97
SYMBOLS, TAGS = 99, 1 + 2 * len(KINDS)  # tag 0: none; 1 + 2k: begins kind k; 2 + 2k: inside it


def classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]


def allowed() -> np.ndarray:
    """Inside a kind only after its beginning or inside."""
    a = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        a[:, 2 + 2 * k] = False
        a[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return a


def _tanh_gates(z: np.ndarray, h: int) -> np.ndarray:
    z[:, : 3 * h] *= 0.5
    np.tanh(z, out=z)
    z[:, : 3 * h] *= 0.5
    z[:, : 3 * h] += 0.5
    return z


def _by_symbol(symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of each symbol."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    out = np.zeros((SYMBOLS, rows.shape[1]), rows.dtype)
    out[s[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Tagger:
    """Embedding, two LSTM directions, a linear layer and CRF transitions."""

    def __init__(self, params: dict | None = None, seed: int = 11):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        if params is None:
            params = {"e": g(SYMBOLS, EMBED) * 3, "out": g(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
            for d in "fb":
                params |= {f"x{d}": g(EMBED, 4 * HIDDEN), f"h{d}": g(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
                params[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        self.p = params

    def _run(self, d: str, x: np.ndarray, keep: bool):
        """Hidden states of one direction; gates: in, forget, out, new."""
        p, (b, t) = self.p, x.shape
        table = p["e"] @ p["x" + d] + p["b" + d]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        hs, tape = np.empty((t, b, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = _tanh_gates(table[x[:, k]] + h @ p["h" + d], HIDDEN)
            i, f, o, n = (z[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            old_c, old_h = c, h
            c = f * c + i * n
            tc = np.tanh(c)
            h = o * tc
            hs[k] = h
            if keep:
                tape.append((k, z, old_c, old_h, tc))
        return hs, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """``(time, batch, tags)``."""
        both = np.concatenate([self._run(d, x, False)[0] for d in "fb"], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """Best tags ``(batch, time)`` under the transitions and what is allowed."""
        emit = self.emissions(x)
        trans = np.where(allowed(), self.p["trans"], -1e4).astype(np.float32)
        t, b, _ = emit.shape
        back = np.empty((t, b, TAGS), np.int8)
        start = np.where([k and k % 2 == 0 for k in range(TAGS)], -1e4, 0).astype(np.float32)
        best = emit[0] + start
        for k in range(1, t):
            s = best[:, :, None] + trans
            back[k] = s.argmax(axis=1)
            best = s.max(axis=1) + emit[k]
        tags = np.empty((b, t), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(b)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[k, rows, tags[:, k]]
        return tags

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y, and its gradient."""
        p, (b, t) = self.p, x.shape
        runs = {d: self._run(d, x, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        emit = (both @ p["out"] + p["bias"]).astype(np.float64)
        top = emit.max(axis=2, keepdims=True)
        e, m = np.exp(emit - top), np.exp(p["trans"].astype(np.float64))
        alpha, scale = np.empty((t, b, TAGS)), np.empty((t, b, 1))
        for k in range(t):
            a = e[k] if k == 0 else (alpha[k - 1] @ m) * e[k]
            scale[k] = a.sum(axis=1, keepdims=True)
            alpha[k] = a / scale[k]
        beta = np.ones((t, b, TAGS))
        d_trans = np.zeros((TAGS, TAGS))
        for k in range(t - 1, 0, -1):
            right = e[k] * beta[k] / scale[k]
            d_trans += m * (alpha[k - 1].T @ right)
            beta[k - 1] = right @ m.T
        d_emit = alpha * beta
        yt, rows = y.T, np.arange(b)
        gold = np.zeros(b)
        for k in range(t):
            gold += emit[k, rows, yt[k]]
            d_emit[k, rows, yt[k]] -= 1
            if k:
                gold += p["trans"][yt[k - 1], yt[k]]
        np.subtract.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        value = float((np.log(scale).sum(axis=(0, 2)) + top.sum(axis=(0, 2)) - gold).mean())
        d_emit = (d_emit / b).astype(np.float32)
        grad = {"trans": (d_trans / b).astype(np.float32), "bias": d_emit.sum((0, 1)), "out": np.tensordot(both, d_emit, ((0, 1), (0, 1)))}
        d_both = d_emit @ p["out"].T
        grad["e"] = np.zeros_like(p["e"])
        for j, d in enumerate("fb"):
            own = d_both[:, :, j * HIDDEN : (j + 1) * HIDDEN]
            wh, every = p["h" + d], np.empty((t, b, 4 * HIDDEN), np.float32)
            g_h, dh, dc = np.zeros_like(wh), np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
            for k, z, old_c, old_h, tc in reversed(runs[d][1]):
                i, f, o, n = (z[:, q * HIDDEN : (q + 1) * HIDDEN] for q in range(4))
                dh = dh + own[k]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * n * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], axis=1)
                dc, dh = dc * f, dz @ wh.T
                g_h += old_h.T @ dz
                every[k] = dz
            table = _by_symbol(x.T.ravel(), every.reshape(t * b, -1))
            grad |= {"h" + d: g_h, "b" + d: table.sum(0), "x" + d: p["e"].T @ table}
            grad["e"] += table @ p["x" + d].T
        return value, grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 96, rate: float = 0.012, seed: int = 5) -> float:
        """Adam over shuffled windows; returns the last epoch's mean loss."""
        r, step, value = np.random.default_rng(seed), 0, 0.0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order, total = r.permutation(len(x)), 0.0
            for s in range(0, len(x), batch):
                own = order[s : s + batch]
                value, grad = self.loss(x[own], y[own])
                total += value * len(own)
                step += 1
                lr = rate * (1 - epoch / epochs) + 5e-4
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - lr * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            value = total / max(1, len(x))
        return value


# ------------------------------------------------------------------------------- labelled spans
def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _make(kind: int, r: random.Random, word) -> str:
    if kind == 0:
        name = word() + r.choice(["", ".", "_", "-", "+"]) + r.choice([word(), _number(r, 2), ""])
        host = r.choice([word(), f"{word()}-{word()}", f"mail{r.randint(0, 9)}.{word()}", f"{word()}.{word()}"])
        return f"{name.rstrip('._-+') or 'a'}@{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
    if kind == 1:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == 2:
        d = r.choice("3456") + _number(r, r.choice([12, 14, 14, 14, 15]))
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        sep = r.choice(["", "", "", " ", "-", "."])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    a, b, c, cc = _number(r, 3), _number(r, 3), _number(r, 4), r.randint(1, 99)
    return r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{cc}.{a}.{b}.{c}", f"{a}.{b}.{c}"])


def generate(n: int, seed: int = 17) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n invented texts with their spans."""
    r = random.Random(seed)
    syllables = "th er in on an re he ti es or en ion que ció der ung ein au é ö ñ st ou wh ble ez".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    ascii_word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    odd = [
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda: str(r.randint(0, 99999)), lambda: f"{r.randint(1, 999)},{_number(r, 3)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40]))), lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)),
        lambda: f"@{ascii_word()}", lambda: f"{r.randint(1, 12)}:{r.randint(0, 59):02}", lambda: f"({r.randint(1, 99)})", lambda: f"password={_number(r, 4)}{ascii_word()}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        if r.random() < 0.8:
            text = " ".join(word() for _ in range(r.randint(1, 6))) + " "
        for _ in range(r.choice([1, 1, 1, 2])):
            if r.random() < 0.7:
                k = r.randrange(4)
                s = _make(k, r, ascii_word)
                spans.append((k, len(text), len(text) + len(s)))
                text += s
            else:
                text += r.choice(odd)()
            text += r.choice([" ", " ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(r.randint(0, 5))) + " "
        out.append((text, spans))
    return out


def windows_of(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows with an anchor, and their tags."""
    starts, x = window_grid(text)
    tag = np.zeros(len(text), np.int64)
    for k, a, b in reversed(spans):
        tag[a:b] = 2 + 2 * k
        tag[a] = 1 + 2 * k
    at = starts[:, None] + np.arange(WINDOW)
    inside = (at >= 0) & (at < len(text))
    y = np.where(inside, tag[np.clip(at, 0, max(0, len(text) - 1))], 0)
    y[(y[:, 0] > 0) & (y[:, 0] % 2 == 0), 0] -= 1  # a window that begins inside a span begins it
    return x, y


def window_grid(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window with an anchor, their classes); windows begin every STRIDE characters."""
    lead = (WINDOW - STRIDE) // 2
    hits = np.fromiter((m.start() for m in ANCHOR.finditer(text)), np.int64)
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros((0, WINDOW), np.int64)
    last = (hits + lead) // STRIDE
    ks = np.unique(np.concatenate([last, np.maximum(last - 1, 0)]))
    ks = ks[ks * STRIDE < len(text)]
    starts = ks * STRIDE - lead
    at = starts[:, None] + np.arange(WINDOW)
    inside = (at >= 0) & (at < len(text))
    return starts, np.where(inside, classes(text)[np.clip(at, 0, len(text) - 1)], 0)


def _training_windows(batches):
    """Windows of sampled documents with the tags of what the patterns find there."""
    for b in batches:
        xs, ys = [], []
        for text in b.column("text").to_pylist():
            x, y = windows_of(text, base_spans(text))
            pick = np.unique(np.linspace(0, len(x) - 1, FIT_WINDOWS).astype(int)) if len(x) else []
            xs.append(x[pick].astype(np.int8).tobytes() if len(x) else b"")
            ys.append(y[pick].astype(np.int8).tobytes() if len(x) else b"")
        yield pa.record_batch([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])


def train(docs: DataFrame, most: int = FIT_DOCS, generated: int = GENERATED, epochs: int = EPOCHS) -> Tagger:
    """Fit on ``FIT_WINDOWS`` windows of each of at most ``most`` documents and on generated spans.

    Documents are sampled by the hash of their text, and texts that are equal count once.
    """
    tune(docs.sparkSession)
    every = texts(docs).withColumn("mix", F.xxhash64("text"))
    thin = F.pmod(F.xxhash64("mix", "doc_id"), F.lit(SLICES)) < SLICES * THIN * most / max(1, docs.count())
    one = every.where(thin & F.col("text").rlike("[0-9@]")).groupBy("mix").agg(F.min("text").alias("text"))
    rows = one.orderBy("mix").limit(most).select("text").mapInArrow(_training_windows, "x binary, y binary").collect()
    xs = [np.frombuffer(r.x, np.int8).reshape(-1, WINDOW) for r in rows]
    ys = [np.frombuffer(r.y, np.int8).reshape(-1, WINDOW) for r in rows]
    for text, spans in generate(generated):
        x, y = windows_of(text, spans)
        xs.append(x)
        ys.append(y)
    t = Tagger()
    t.fit(np.concatenate(xs).astype(np.int64), np.concatenate(ys).astype(np.int64), epochs)
    return t


# ------------------------------------------------------------------------------- the operator
_TRIM = (" \t\r\n.,;:!?()<>[]\"'", " .,;:()-", " .,;:()-", " .,;:-")


def _holds(kind: int, s: str) -> bool:
    """What a span of a kind must be beside what the network says."""
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", s))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s)) and _ip(s)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 .\-]+[0-9]", s)) and _card(s)
    return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().\-]+[0-9]", s)) and 9 <= len(_digits(s)) <= 15 and (s[0] in "+(" or bool(re.search(r"[0-9][ .\-][0-9]", s)))


def spans_of_tags(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of a kind, cut at beginnings, trimmed of punctuation, completed to whole runs of letters
    and digits, that hold; of two that overlap the first stays."""
    out, at = [], np.flatnonzero(tags)
    k = last = 0
    while k < len(at):
        a = int(at[k])
        kind = (tags[a] - 1) // 2
        b = a + 1
        k += 1
        while k < len(at) and at[k] == b and tags[b] == 2 + 2 * kind:
            b += 1
            k += 1
        while a < b and text[a] in _TRIM[kind] and not (kind == 3 and text[a] == "("):
            a += 1
        while a < b and text[b - 1] in _TRIM[kind]:
            b -= 1
        while a < b < len(text) and text[b - 1].isalnum() and text[b].isalnum():  # never cuts a run
            b += 1
        while last < a < b and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        if a >= last and _holds(int(kind), text[a:b]):
            out.append((int(kind), a, b))
            last = b
    return out


def find(tagger: Tagger, batch: list[str]) -> list[tuple[list, list]]:
    """(base spans, spans that the tagger adds) of each text."""
    grids = [window_grid(t) for t in batch]
    tags: dict[int, np.ndarray] = {}
    queue, size = [], 0

    def flush():
        nonlocal queue, size
        if not queue:
            return
        got = tagger.viterbi(np.concatenate([x for _, _, x in queue]))
        at, lead = 0, (WINDOW - STRIDE) // 2
        for d, starts, x in queue:
            own = got[at : at + len(x), lead : lead + STRIDE]
            at += len(x)
            place = (starts + lead)[:, None] + np.arange(STRIDE)
            inside = place < len(batch[d])
            tags.setdefault(d, np.zeros(len(batch[d]), np.int8))[place[inside]] = own[inside]
        queue, size = [], 0

    for d, (starts, x) in enumerate(grids):
        for s in range(0, len(x), CHUNK):
            queue.append((d, starts[s : s + CHUNK], x[s : s + CHUNK]))
            size += len(x[s : s + CHUNK])
            if size >= CHUNK:
                flush()
    flush()
    out = []
    for d, text in enumerate(batch):
        base = base_spans(text)
        more = []
        if d in tags:
            taken = sorted((a, b) for _, a, b in base)
            more = [s for s in spans_of_tags(text, tags[d]) if not any(a < s[2] and s[1] < b for a, b in taken)]
        out.append((base, sorted(more)))
    return out


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``doc_id, spans array<struct<kind,start,end,base>>``, code points, ends exclusive.

    Spans come by kind, then start.  Null and empty texts have none; one row per input row.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((tagger or train(docs)).p)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        t = Tagger(shared.value)
        for b in batches:
            rows = []
            for base, more in find(t, b.column("text").to_pylist()):
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": own} for k, s, e, own in every])
            yield pa.record_batch([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, the digest of their list, and the list of all spans."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's kind in its place; spans that overlap are masked as one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data masked and ``n_chars``, if there, brought up to date.

    Rows, order of columns and types stay; a null text stays null.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((tagger or train(docs)).p)
    names, schema = docs.columns, docs.schema
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        t = Tagger(shared.value)
        for b in batches:
            own = b.column(at).to_pylist()
            new = list(own)
            for k, (base, more) in enumerate(find(t, [x or "" for x in own])):
                if base or more:
                    new[k] = masked(own[k], base + more)
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if n_at is not None:
                old = b.column(n_at).to_pylist()
                n = [len(x) if x is not y else m for x, y, m in zip(new, own, old)]
                cols[n_at] = pa.array(n, b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(released(run), schema)
