"""Personal data: base patterns, and a conditional random field for written-out forms (operator 3).

Base spans come from four patterns over whole texts. A linear-chain conditional random field over
word-shape features (the class of a token's shape, and those of its neighbours) adds spans that the
patterns miss: e-mail addresses spelled with "at" and "dot", defanged network addresses, card
numbers with other separators and phone numbers without a plus sign. It is trained from a small
labelled table (labelled_rows(), or one that is given) and decoded by Viterbi in numpy batches over
all tokens of a slice of texts, with the full lattice. Texts of more than PIECE tokens are decoded in
pieces that read CONTEXT further tokens on either side and use the tags of their own tokens only, so
that one long text is as many rows of a batch. A decoded span is kept if what it spells is valid (a well-formed address, parts
of at most 255, Luhn's sum, 8 to 15 digits) and it overlaps no base span.

Texts are read where they lie; nothing is shuffled. Memory is bounded by a slice of texts, or by some
30 bytes for each byte of a longer text. An empty table gives an empty result.

Defined results: null text counts as empty and has no spans; offsets are code points, end exclusive;
rows that repeat are treated alike; other columns are ignored, and redact() keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqrec.llm.common import bound_batches
from seqrec.llm.textbuf import buffers, release, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns, ordered."""
    out: list[tuple[int, int, int]] = []
    end = 0
    if "@" in text:
        for m in _AT.finditer(text):
            s = at = m.start()
            while s > end and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                end = m.end()
                out.append((0, s, end))
    out.extend((1, *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.group().split("."))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out.extend((3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15)
    return out


# --- word shapes -----------------------------------------------------------------------------------

#: Key words by class: fixed values.
KEYS = {
    "at": ("at", "[at]", "(at)", "{at}", "<at>"),
    "dot": ("dot", "[dot]", "(dot)", "{dot}", "<dot>", "[.]"),
    "mail": ("mail", "email", "e-mail", "mail:", "email:", "contact", "write"),
    "net": ("ip", "ip:", "host", "server", "address", "ping"),
    "card": ("card", "card:", "visa", "cc", "cc:", "credit"),
    "tel": ("tel", "tel:", "phone", "phone:", "call", "fax", "fax:", "mobile"),
}
#: A spelled address without brackets must end in one of these: fixed values.
TOP_LEVEL = frozenset("biz ca ch co com de edu es eu fr gov info io it jp net nl org ru uk us".split())
_KEY = {w: k for k, ws in KEYS.items() for w in ws}
_SIZES = (1, 2, 3, 4, 6, 9, 11, 15, 19, 999)
_FORMS = ("num", "dash", "paren", "dots", "defang", "slash", "mixed")
CLASSES = ["edge", "lower", "word", "bracket", "symbol", "mail-like", *KEYS, *(f"{f}{n}" for f in _FORMS for n in _SIZES)]
_CLASS = {c: k for k, c in enumerate(CLASSES)}


@lru_cache(maxsize=100_000)
def shape(token: str) -> int:
    """The class of a token by its shape: what kinds of characters it has, and how many digits."""
    low = token.lower()
    core = low.strip(".,;!?")
    for form in (low, core):
        if form in _KEY:
            return _CLASS[_KEY[form]]
    if "@" in token:
        return _CLASS["mail-like"]
    n = sum("0" <= c <= "9" for c in token)
    if n:
        rest = set(core) - set("0123456789")
        form = "num" if not rest else "dash" if rest == {"-"} else "paren" if rest <= set("()-") else "dots" if rest == {"."} else "defang" if rest and rest <= set(".[]()") else "slash" if rest <= set("/:") else "mixed"
        return _CLASS[f"{form}{next(s for s in _SIZES if n <= s)}"]
    if re.fullmatch("[a-z]+", token):
        return _CLASS["lower"]
    if re.search(r"[\[\](){}<>]", token):
        return _CLASS["bracket"]
    return _CLASS["word"] if re.search(r"\w", token) else _CLASS["symbol"]


def labelled_rows(n: int = 700, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (tokens, labels) of made-up sentences."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 9)))

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def email() -> list[str]:
        at, dot = r.choice(KEYS["at"]), r.choice(KEYS["dot"][:5])
        return [r.choice([word(), word() + digits(2)]), at, word(), *([dot, word()] if r.random() < 0.3 else []), dot, r.choice(["com", "org", "net", "de", "info"]) + r.choice(["", "", ".", ","])]

    def ip() -> list[str]:
        part = [str(r.randint(0, 255)) for _ in range(4)]
        if r.random() < 0.5:
            return [r.choice(["[.]", "(.)", "[dot]"]).join(part[:4]) if r.random() < 0.3 else "[.]".join(part)]
        dot = r.choice(["dot", "[.]", "[dot]"])
        return [part[0], dot, part[1], dot, part[2], dot, part[3]]

    def card() -> list[str]:
        d = digits(16)
        parts = [d[k : k + 4] for k in range(0, 16, 4)]
        return r.choice([[".".join(parts)], ["/".join(parts)], [parts[0] + ".", parts[1] + ".", parts[2] + ".", parts[3]]])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"({a}){b}-{c}"], [f"({a})", b, c], [f"0{a}", b + c], [f"1-{a}-{b}-{c}"]])

    def noise() -> list[str]:
        return r.choice([
            ["in", str(r.randint(1900, 2030))], ["page", str(r.randint(1, 999))], [f"v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}"], [f"{r.randint(0, 23)}:{digits(2)}"],
            [f"20{digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}"], [word(), "at", word()], [word(), "at", word(), word()], ["the", "dot", word()], [digits(r.choice([5, 6, 8, 12, 16, 20]))],
            [f"{digits(2)}.{digits(1)}%"], [f"({r.randint(1, 99)})"], [f"({word()})"], [f"[{word()}]"], [digits(3), word()], [f"{digits(2)}/{digits(2)}"], ["call", word()], ["card", word()], [word() + digits(2)],
            [digits(3) + "," + digits(3)], [word() + "@" + word() + ".com"], [".".join(str(r.randint(0, 255)) for _ in range(4))], ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [digits(4), digits(4), digits(4), digits(4)],
        ])

    lead = {"email": ["mail", "email", "contact"], "ip": ["ip", "host", "server", "ping"], "card": ["card", "visa", "cc"], "phone": ["call", "tel", "phone", "fax:"]}
    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    rows = []
    for _ in range(n):
        tokens, tags = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 4)):
                tokens.append(word() if r.random() < 0.7 else word().capitalize() + r.choice(["", ",", "."]))
                tags.append("O")
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.4:
                    tokens.append(r.choice(lead[kind]))
                    tags.append("O")
                part = make[kind]()
                tags += [f"B-{kind}", *[f"I-{kind}"] * (len(part) - 1)]
            else:
                part = noise()
                tags += ["O"] * len(part)
            tokens += part
        tokens.append(word() + ".")
        tags.append("O")
        rows.append((tokens, tags))
    return rows


class ChainField:
    """Weights by label: for the class of the token itself, of the one before and after; transitions."""

    def __init__(self) -> None:
        k, n = len(CLASSES), len(LABELS)
        self.own, self.before, self.after = np.zeros((k, n)), np.zeros((k, n)), np.zeros((k, n))
        self.trans = np.zeros((n, n))
        inside = np.array([x[0] == "I" for x in LABELS])
        self.bad = np.array([[inside[b] and LABELS[a][2:] != LABELS[b][2:] for b in range(n)] for a in range(n)])
        self.bad_first = inside

    def emissions(self, c: np.ndarray) -> np.ndarray:
        """c: classes with a column of context on either side."""
        return self.own[c[:, 1:-1]] + self.before[c[:, :-2]] + self.after[c[:, 2:]]

    def train(self, rows: list[tuple[list[str], list[str]]], steps: int = 80, rate: float = 0.15, decay: float = 1e-3) -> ChainField:
        """Maximum likelihood with a quadratic penalty, by Adam over the whole table."""
        m, n = max(len(t) for t, _ in rows), len(LABELS)
        c = np.zeros((len(rows), m + 2), np.int64)
        y = np.full((len(rows), m), -1)
        for k, (tokens, tags) in enumerate(rows):
            c[k, 1 : len(tokens) + 1] = [shape(t) for t in tokens]
            y[k, : len(tags)] = [LABELS.index(t) for t in tags]
        real, size = y >= 0, (y >= 0).sum(axis=1)
        at = np.arange(len(rows))
        gold = np.zeros((len(rows), m, n))
        gold[real, y[real]] = 1
        params = [self.own, self.before, self.after, self.trans]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        gold_trans = np.zeros((n, n))
        for t in range(1, m):
            np.add.at(gold_trans, (y[real[:, t], t - 1], y[real[:, t], t]), 1)
        for step in range(1, steps + 1):
            e = self.emissions(c)
            e[:, 0, self.bad_first] = -1e4
            tr = np.where(self.bad, -1e4, self.trans)
            top = tr.max()
            ex = np.exp(tr - top)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for t in range(1, m):
                hi = alpha[:, t - 1].max(axis=1, keepdims=True)
                nxt = hi + top + np.log(np.exp(alpha[:, t - 1] - hi) @ ex + 1e-300) + e[:, t]
                alpha[:, t] = np.where(real[:, t, None], nxt, alpha[:, t - 1])
            for t in range(m - 2, -1, -1):
                b = beta[:, t + 1] + e[:, t + 1]
                hi = b.max(axis=1, keepdims=True)
                beta[:, t] = np.where(real[:, t + 1, None], hi + top + np.log(np.exp(b - hi) @ ex.T + 1e-300), 0)
            last = alpha[at, size - 1]
            hi = last.max(axis=1, keepdims=True)
            z = (hi[:, 0] + np.log(np.exp(last - hi).sum(axis=1)))[:, None, None]
            post = np.exp(alpha + beta - z) * real[:, :, None]
            diff = (post - gold) / len(rows)
            grads = [np.zeros_like(p) for p in params]
            for g, cols in zip(grads, (c[:, 1:-1], c[:, :-2], c[:, 2:])):
                np.add.at(g, cols[real], diff[real])
            pair = np.zeros((n, n))
            for t in range(1, m):
                k = real[:, t]
                left = alpha[k, t - 1][:, :, None] + tr[None] + (e[k, t] + beta[k, t])[:, None, :] - z[k]
                pair += np.exp(left).sum(axis=0)
            grads[3] = (pair - gold_trans) / len(rows)
            for p, g, a, b in zip(params, grads, first, second):
                g += decay * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, c: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Viterbi over padded runs: c (runs, longest + 2) with context, size sorted from the longest."""
        e = self.emissions(c)
        e[:, 0, self.bad_first] = -1e4
        tr = np.where(self.bad, -1e4, self.trans)
        back = np.zeros(e.shape, np.int8)
        best = e[:, 0].copy()
        for t in range(1, e.shape[1]):
            a = int((size > t).sum())
            both = best[:a, :, None] + tr[None]
            back[:a, t] = both.argmax(axis=1)
            best[:a] = both.max(axis=1) + e[:a, t]
        out = np.zeros(e.shape[:2], np.int64)
        now = best.argmax(axis=1)
        for t in range(e.shape[1] - 1, -1, -1):
            a = int((size > t).sum())
            out[:a, t] = now[:a]
            if t:
                now[:a] = back[np.arange(a), t, now[:a]]
        return out


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = 1
#: Tokens to a piece, and tokens read on either side of it.
PIECE, CONTEXT = 512, 32


def _packed(word: str) -> int:
    return int.from_bytes(word.encode(), "little")


_KEY_CODES = np.sort(np.array([_packed(w) for w in _KEY if len(w) <= 8], np.uint64))
_LONG_KEYS = max(map(len, _KEY))


def _tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the tokens of texts that end at ``ends``."""
    solid = ~_SPACES[data]
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    cut = ends[(ends > 0) & (ends < len(data))]
    start[cut] = solid[cut]
    stop[cut - 1] = solid[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _classes(data: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """shape() of every token; words of a-z that are no key word are told by their bytes."""
    out = np.full(len(s), _CLASS["lower"], np.int64)
    n = t - s
    # the bytes up to the next token hold no further letters
    whole = np.add.reduceat(_LETTER[data], s, dtype=np.int64) == n
    ask = ~whole | ((n > 8) & (n <= _LONG_KEYS))
    short = np.flatnonzero(whole & (n <= 8))
    code = np.zeros(len(short), np.uint64)
    for j in range(8):
        more = n[short] > j
        code[more] |= data[s[short[more]] + j].astype(np.uint64) << np.uint64(8 * j)
    ask[short[np.isin(code, _KEY_CODES)]] = True
    raw = data.tobytes()
    for k in np.flatnonzero(ask).tolist():
        token = raw[s[k] : t[k]].decode()
        out[k] = shape(token) if len(token) <= 64 else shape.__wrapped__(token)
    return out


def _tags(field: ChainField, classes: np.ndarray, doc: np.ndarray, piece: int = PIECE, context: int = CONTEXT) -> np.ndarray:
    """The label of each token; ``doc`` says which text a token is of."""
    out = np.zeros(len(classes), np.int64)
    if not len(classes):
        return out
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    last = np.append(first[1:], len(doc))
    pieces = -(-(last - first) // piece)
    owner = np.repeat(np.arange(len(first)), pieces)
    own = first[owner] + piece * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    first, last = first[owner], last[owner]
    own_end = np.minimum(own + piece, last)
    lo, hi = np.maximum(own - context, first), np.minimum(own_end + context, last)
    order = np.argsort(lo - hi, kind="stable")
    own, own_end, lo, hi, first, last = (x[order] for x in (own, own_end, lo, hi, first, last))
    padded = np.append(classes, 0)
    k = 0
    while k < len(lo):  # blocks of pieces, bounded by cells
        longest = int(hi[k] - lo[k])
        x = slice(k, k + max(1, 200_000 // (longest + 2)))
        n = hi[x] - lo[x]
        at = lo[x, None] + np.arange(longest)[None]
        real = at < hi[x, None]
        c = np.zeros((len(n), longest + 2), np.int64)
        c[:, 1:-1] = np.where(real, padded[np.minimum(at, len(classes))], 0)
        c[:, 0] = np.where(lo[x] > first[x], padded[lo[x] - 1], 0)
        c[np.arange(len(n)), n + 1] = np.where(hi[x] < last[x], padded[hi[x]], 0)
        tags = field.decode(c, n)
        mine = (at >= own[x, None]) & (at < own_end[x, None])
        out[at[mine]] = tags[mine]
        k += len(n)
    return out


def _valid(kind: int, text: str) -> tuple[int, int] | None:
    """What is left of a decoded span after trimming, if it spells a valid item."""
    lo, hi = 0, len(text)
    if kind == 0:
        m = re.search(r"[A-Za-z0-9._%+-]+\s*[\[({<]?\s*\b(?:at|AT)\b\s*[\])}>]?\s*[A-Za-z0-9-]+(?:\s*[\[({<]?\s*\b(?:dot|DOT)\b\s*[\])}>]?\s*[A-Za-z0-9-]+)+", text)
        return m.span() if m and (m.group().rsplit(None, 1)[-1].lower() in TOP_LEVEL or re.search(r"[\[({<]", m.group())) else None
    while lo < hi and text[lo] not in "0123456789(":
        lo += 1
    while hi > lo and not text[hi - 1].isdigit():
        hi -= 1
    part = text[lo:hi]
    if not part or re.search(r"[^\x00-\x7f]", part):
        return None
    d = _digits(part)
    if kind == 1:
        parts = re.split(r"\s*(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\bdot\b)\s*", part)
        ok = len(parts) == 4 and all(p.isdigit() and _octet(p) for p in parts)
    elif kind == 2:
        ok = 16 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", part)
    else:
        ok = 8 <= len(d) <= 15 and not re.search(r"[A-Za-z]", part)
    return (lo, hi) if ok else None


def field_spans(field: ChainField, column: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """By row of the column: (kind index, start byte, end byte) of what the field finds in the text."""
    data, off = buffers(column)
    base = int(off[0])
    data, ends = data[base : int(off[-1])], off[1:] - base
    found: dict[int, list[tuple[int, int, int]]] = {}
    s, t = _tokens(data, ends)
    if not len(s):
        return found
    raw = data.tobytes()
    doc = np.searchsorted(ends, s, side="right")
    tags = _tags(field, _classes(data, s, t), doc)
    for j in np.flatnonzero(tags % 2 == 1).tolist():
        e = j
        while e + 1 < len(s) and tags[e + 1] == tags[j] + 1 and doc[e + 1] == doc[j]:
            e += 1
        lo, hi, kind = int(s[j]), int(t[e]), (int(tags[j]) - 1) // 2
        text = raw[lo:hi].decode()
        if got := _valid(kind, text):
            lo, hi = lo + len(text[: got[0]].encode()), lo + len(text[: got[1]].encode())
            shift = int(off[doc[j]]) - base
            found.setdefault(int(doc[j]), []).append((kind, lo - shift, hi - shift))
    return found


def all_spans(field: ChainField, column: pa.Array) -> Iterator[tuple[str, list, list]]:
    """(text, base spans, all spans) of each row, in code points, by kind and start."""
    extra = field_spans(field, column)
    for k, text in enumerate(column.to_pylist()):
        text = text or ""
        base = base_spans(text)
        more = []
        if k in extra:
            raw = text.encode()
            for kind, a, b in extra[k]:
                s = len(raw[:a].decode())
                e = s + len(raw[a:b].decode())
                if all(e <= x or y <= s for _, x, y in base):
                    more.append((kind, s, e))
        yield text, base, sorted(base + more) if more else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = field.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                counts, digests, spans = [], [], []
                for _, base, every in all_spans(f, batch.column(1).slice(lo, hi - lo)):
                    counts.append([sum(x[0] == k for x in base) for k in range(4)])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in every])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, _SPAN)],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )
        release()

    return run


def trained(rows: list[tuple[list[str], list[str]]] | None = None) -> ChainField:
    return ChainField().train(rows if rows is not None else labelled_rows())


def find_personal_data(docs: DataFrame, field: ChainField | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_find(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<kind: string, start: long, end: long>>")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each maximal group of overlapping spans replaced by the first one's kind."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= end:
            out += [text[end:s], f"[{KINDS[kind].upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, field: ChainField | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by [EMAIL], [IP], [CARD] or [PHONE]."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            column = batch.column(place)
            for lo, hi in slices(column):
                part = column.slice(lo, hi - lo)
                texts = [None if null else (redacted(t, spans) if spans else t) for null, (t, _, spans) in zip(part.is_null().to_pylist(), all_spans(f, part))]
                rows = batch.slice(lo, hi - lo)
                yield rows.set_column(place, rows.schema.field(place), pa.array(texts, column.type))
        release()

    return docs.mapInArrow(run, docs.schema)
