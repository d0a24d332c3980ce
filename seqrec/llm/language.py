"""Language identification with spans for mixed-language texts (operator 4).

Method: every word (a run of letters and marks) is scored for each language by the log-likelihood
of its letter trigrams; the Unicode range of its script narrows the languages to those whose
training texts use that script; Viterbi over the words of a text, with a penalty for each switch,
labels spans. The predicted language is the one whose spans hold most letters.

The model is fitted on a sample of labelled texts that is bounded by ``per_language`` documents in
expectation for each language (hash of the id below a threshold from the counts), so its tables
have a fixed size: 2^16 trigram cells for each language. Every document is labelled by whole text.
Texts are read where they lie; nothing but the bounded counts is shuffled. Texts are scored in
slices of SLICE bytes and decoded in groups of GROUP slices; a longer one is read in pieces of PIECE characters that end between words, over
which the Viterbi state is carried, and a piece is settled as soon as all paths into its successor
leave it in one state, so that memory follows the piece and not the text.

Defined results: a text that is null or has no letters gives ``und`` with score 0 and no spans, as
do all texts if there is no training text. Letters of scripts that no learned language uses belong
to no span, unless a text has no other letters: its words are then decoded by trigram scores with
all languages as candidates, so that it gets a learned language, on little evidence. Ties go to the
language that sorts first. The score is the share of the text's letters that lie in spans of the
predicted language. Other columns are ignored. Rows that repeat an id are labelled one by one. An
empty table gives an empty result. In a text longer than a slice, a word of more than PIECE
characters counts as several.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from seqrec.llm.common import bound_batches
from seqrec.llm.textbuf import release, slices

BITS = 16
#: Bytes of text that are scored at a time, slices that are decoded together, and characters to a
#: piece of a text longer than a slice.
SLICE, GROUP, PIECE = 1 << 18, 8, 1 << 17
#: Unicode ranges of scripts (first, last code point, name): fixed values.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x2C60, 0x2C7F, "latin"), (0xA720, 0xA7FF, "latin"), (0xFF21, 0xFF5A, "latin"),
    (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x1C80, 0x1C8F, "cyrillic"), (0x2DE0, 0x2DFF, "cyrillic"), (0xA640, 0xA69F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x08A0, 0x08FF, "arabic"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFF, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"), (0x0B80, 0x0BFF, "tamil"),
    (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0D80, 0x0DFF, "sinhala"),
    (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1780, 0x17FF, "khmer"), (0x1200, 0x137F, "ethiopic"),
    (0x1100, 0x11FF, "hangul"), (0xAC00, 0xD7AF, "hangul"), (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xF900, 0xFAFF, "han"), (0x20000, 0x323AF, "han"),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for _, _, s in SCRIPTS)]
_TOP = 0x32400
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """By code point: lower case, is a letter, is part of a word, script."""
    if not _TABLES:
        import unicodedata

        lower, kind, script = np.arange(_TOP, dtype=np.uint32), np.zeros(_TOP, np.uint8), np.zeros(_TOP, np.uint8)
        for c in range(_TOP):
            ch = chr(c)
            if ch.isalpha():
                kind[c] = 1
                if len(low := ch.lower()) == 1:
                    lower[c] = ord(low)
            elif c > 0x2FF and unicodedata.category(ch)[0] == "M":
                kind[c] = 2
        for a, b, s in SCRIPTS:
            script[a : b + 1] = SCRIPT_NAMES.index(s)
        _TABLES.extend([lower, kind == 1, kind > 0, script])
    return _TABLES


class Words:
    """The words of a column slice: trigram cells by letter, and each word's place and script."""

    def __init__(self, texts: list[str]) -> None:
        lower, letter, part, script = _tables()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(size)
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.where(cp < _TOP, cp, 0)
        inside = part[cp]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        begin = (self.ends - size)[(size > 0)]
        start[begin] = inside[begin]
        end[begin[1:] - 1] = inside[begin[1:] - 1]
        self.start, self.stop = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.letters = np.concatenate([np.zeros(1, np.int32), np.cumsum(letter[cp], dtype=np.int32)])
        at = np.flatnonzero(inside)
        c = lower[cp[at]].astype(np.uint64)
        n = self.stop - self.start
        self.first = np.cumsum(n) - n  # of each word among the letters
        before, after = np.empty_like(c), np.empty_like(c)
        before[1:], after[:-1] = c[:-1], c[1:]
        before[self.first], after[self.first + n - 1] = 0, 0
        h = (before * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xBF58476D1CE4E5B9) + after * np.uint64(0x94D049BB133111EB))
        self.cells = ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)
        self.script = script[cp[self.start]]
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.n_letters = self.letters[self.stop] - self.letters[self.start]


def pieces(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(place, piece) of ``text`` in pieces of at most ``most`` characters that end between words."""
    _, _, part, _ = _tables()
    at = 0
    while at < len(text):
        to = min(len(text), at + most)
        if to < len(text):
            cp = np.frombuffer(text[at : to + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            outside = np.flatnonzero(~part[np.where(cp < _TOP, cp, 0)])
            if len(outside) and outside[-1]:
                to = at + int(outside[-1])
        yield at, text[at:to]
        at = to


def _count(languages: list[str]):
    place = {v: k for k, v in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(languages), 1 << BITS), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE):
                texts, langs = batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist()
                parts = [(lang, [t for t, x in zip(texts, langs) if x == lang]) for lang in set(langs)]
                if hi - lo == 1 and len(texts[0]) > PIECE:
                    parts = ((langs[0], [t]) for _, t in pieces(texts[0], PIECE))
                for lang, part in parts:
                    w = Words(part)
                    cells[place[lang]] += np.bincount(w.cells, minlength=1 << BITS)
                    scripts[place[lang]] += np.bincount(w.script, weights=w.n_letters, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for table, sign in ((cells, 0), (scripts, -1)):
            k, c = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array((c if not sign else -1 - c).astype(np.int32)), pa.array(table[k, c])], names=["lang", "cell", "n"])

    return run


class Found:
    """What decoding needs of the words of several parts: place, script, letters and text."""

    FIELDS = ("start", "stop", "script", "n_letters", "doc", "ends", "letters")

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.chars = self.rows = 0

    def add(self, w: Words) -> None:
        base = np.concatenate([[0], w.ends])
        letters = w.letters[base[1:]] - w.letters[base[:-1]]  # by text
        self.parts.append((w.start + self.chars, w.stop + self.chars, w.script, w.n_letters, w.doc + self.rows, w.ends + self.chars, letters))
        self.chars, self.rows = self.chars + int(base[-1]), self.rows + len(w.ends)

    def join(self) -> None:
        for k, name in enumerate(self.FIELDS):
            setattr(self, name, np.concatenate([x[k] for x in self.parts]) if self.parts else np.zeros(0, np.int64))
        self.parts = []


class Model:
    def __init__(self, languages: list[str], logp: np.ndarray, allowed: np.ndarray, penalty: float) -> None:
        self.languages, self.logp, self.allowed, self.penalty = languages, logp, allowed, penalty

    def label(self, texts: list[str]) -> tuple[Found, np.ndarray]:
        """The words of ``texts`` and the language index of each, -1 where no language is possible."""
        return self.label_parts([texts])

    def label_parts(self, parts: Iterable[list[str]]) -> tuple[Found, np.ndarray]:
        """As label(), for texts that are scored one part after the other."""
        w = Found()
        scores = []
        for texts in parts:
            part = Words(texts)
            w.add(part)
            if len(part.start) and len(self.languages):
                scores.append(np.add.reduceat(self.logp[part.cells], part.first, axis=0))
        w.join()
        out = np.full(len(w.start), -1, np.int64)
        if not scores:
            return w, out
        score = np.concatenate(scores)
        scores.clear()
        can = self.allowed[w.script]
        some = self.allowed.any(axis=1)[w.script]
        if not some.all():
            lettered = w.n_letters > 0
            lost = np.zeros(len(w.ends), bool)  # texts with letters, all of them in scripts without a language
            lost[w.doc[lettered]] = True
            lost[w.doc[lettered & some]] = False
            some |= lost[w.doc]
            can[lost[w.doc]] = True
        use = np.flatnonzero(some)
        score = np.where(can[use], score[use], np.float32(-1e6))
        out[use] = _viterbi(score, w.doc[use], self.penalty)
        return w, out

    def label_long(self, text: str, most: int = PIECE) -> tuple[np.ndarray, int, list[tuple[int, int, int]]]:
        """(letters in spans of each language, letters of the text, spans (start, end, language)) of
        one text, piece by piece; the same as by label()."""
        k = max(1, len(self.languages))
        held, letters, spans = np.zeros(k), 0, []
        if not self.languages:
            return held, int(sum(Words([t]).letters[-1] for _, t in pieces(text, most))), spans
        some = self.allowed.any(axis=1)
        lost = not any((some[w.script] & (w.n_letters > 0)).any() for w in (Words([t]) for _, t in pieces(text, most)))
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(state: int) -> None:
            for start, stop, n, back in reversed(waiting):
                out = np.empty(len(back), np.int64)
                for t in range(len(back) - 1, -1, -1):
                    out[t] = state
                    state = back[t, state]
                done.append((start, stop, n, out))
            for start, stop, n, out in reversed(done):
                np.add.at(held, out, n)
                head = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
                tail = np.append(head[1:], len(out)) - 1
                for a, b in zip(head.tolist(), tail.tolist()):
                    if spans and spans[-1][2] == out[a]:
                        spans[-1] = (spans[-1][0], int(stop[b]), int(out[a]))
                    else:
                        spans.append((int(start[a]), int(stop[b]), int(out[a])))
            waiting.clear()
            done.clear()

        done: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        best = None
        for place, part in pieces(text, most):
            w = Words([part])
            letters += int(w.letters[-1])
            if not len(w.start):
                continue
            score = np.add.reduceat(self.logp[w.cells], w.first, axis=0)
            if lost:
                use = np.arange(len(score))
            else:
                use = np.flatnonzero(some[w.script])
                score = np.where(self.allowed[w.script[use]], score[use], np.float32(-1e6))
            if not len(use):
                continue
            back, best = _forward(score.astype(np.float64), best, self.penalty)
            into = np.arange(k)
            for t in range(len(back) - 1, -1, -1):
                into = back[t, into]
                if (into == into[0]).all():
                    into = into[:1]
            if waiting and (into == into[0]).all():
                settle(int(into[0]))
            waiting.append((w.start[use] + place, w.stop[use] + place, w.n_letters[use], back))
        if waiting:
            settle(int(best.argmax()))
        return held, letters, spans


def _forward(score: np.ndarray, best: np.ndarray | None, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(state before each word by its state, best scores at the end) after the scores ``best``."""
    back = np.zeros(score.shape, np.int16)
    own = np.arange(score.shape[1])
    for t, row in enumerate(score):
        if best is None:
            back[t], best = own, row.copy()
            continue
        top = int(best.argmax())
        jump = best[top] - penalty
        stay = best >= jump
        back[t] = np.where(stay, own, top)
        best = np.where(stay, best, jump) + row
    return back, best


def _viterbi(score: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels under a penalty for each switch, for the word sequences of all texts at once."""
    out = np.zeros(len(score), np.int64)
    if not len(score):
        return out
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.append(first, len(score)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    score = score.astype(np.float64)
    best = score[first].copy()
    back = np.zeros(score.shape, np.int8 if score.shape[1] < 127 else np.int16)
    own = np.arange(score.shape[1])
    for t in range(1, size[0]):
        a = active[t]
        cur = best[:a]
        top = cur.argmax(axis=1)
        jump = cur[np.arange(a), top] - penalty
        stay = cur >= jump[:, None]
        at = first[:a] + t
        back[at] = np.where(stay, own, top[:, None])
        best[:a] = np.where(stay, cur, jump[:, None]) + score[at]
    now = best.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        out[at] = now[:a]
        if t:
            now[:a] = back[at, now[:a]]
    return out


def fit(docs: DataFrame, train: Column, per_language: int = 4000, penalty: float = 12.0, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model from the labelled rows for which ``train`` holds, at most about ``per_language`` each."""
    bound_batches(docs.sparkSession)
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(n)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool), penalty)
    share = F.lit(0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * per_language / n[lang])))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("text", "lang")
    counts = sample.mapInArrow(_count(languages), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    cells, scripts = np.zeros((1 << BITS, len(languages))), np.zeros((len(SCRIPT_NAMES), len(languages)))
    plain = counts["cell"] >= 0
    for table, part, c in ((cells, counts[plain], counts["cell"][plain]), (scripts, counts[~plain], -1 - counts["cell"][~plain])):
        table[c.to_numpy(), part["lang"].to_numpy()] = part["n"].to_numpy()
    logp = np.log((cells + 0.5) / (cells.sum(axis=0) + 0.5 * (1 << BITS)))
    allowed = (scripts > 0) & (scripts >= 0.01 * scripts.sum(axis=0))
    return Model(languages, logp.astype(np.float32), allowed, penalty)


def _groups(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(first row, end, slices) of what is decoded together; no slices for one long text."""
    held: list[tuple[int, int]] = []
    for lo, hi in slices(column, SLICE):
        long = hi - lo == 1 and len(column[lo].as_py() or "") > PIECE
        if held and (long or len(held) == GROUP):
            yield held[0][0], held[-1][1], held
            held = []
        if long:
            yield lo, hi, []
        else:
            held.append((lo, hi))
    if held:
        yield held[0][0], held[-1][1], held


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _identify(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for lo, hi, parts in _groups(batch.column(1)):
                part = lambda a, b: [t or "" for t in batch.column(1)[a:b].to_pylist()]  # noqa: E731, B023
                if not parts:
                    held, letters, runs = m.label_long(part(lo, hi)[0])
                    names = m.languages[int(held.argmax())] if held.max() > 0 else "und"
                    runs = [[{"start": a, "end": b, "lang": m.languages[c]} for a, b, c in runs]]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([names]), pa.array([held.max() / max(letters, 1)]), pa.array(runs, SPANS)], names=["doc_id", "lang_pred", "score", "spans"])
                    continue
                w, label = m.label_parts(part(a, b) for a, b in parts)
                rows, k = hi - lo, max(1, len(m.languages))
                got = label >= 0
                held = np.zeros((rows, k))
                np.add.at(held, (w.doc[got], label[got]), w.n_letters[got])
                base = np.concatenate([[0], w.ends])
                letters = w.letters
                pred, most = held.argmax(axis=1), held.max(axis=1)
                names = np.array(m.languages or ["und"], dtype=object)[pred]
                names[most == 0] = "und"
                # spans: runs of labelled words with one label in one text
                i = np.flatnonzero(got)
                d, lab = w.doc[i], label[i]
                new = np.ones(len(i), bool)
                new[1:] = (d[1:] != d[:-1]) | (lab[1:] != lab[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(i)) - 1 if len(head) else head
                shift = base[d[head]]
                spans = pa.StructArray.from_arrays(
                    [pa.array((w.start[i[head]] - shift).astype(np.int64)), pa.array((w.stop[i[tail]] - shift).astype(np.int64)), pa.array(np.array(m.languages or [""], dtype=object)[lab[head]] if len(head) else [], pa.string())],
                    names=["start", "end", "lang"],
                )
                offsets = np.searchsorted(d[head], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(names, pa.string()), pa.array(most / np.maximum(letters, 1)), pa.ListArray.from_arrays(pa.array(offsets), spans)],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )
        release()

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; spans in code points, end exclusive."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_identify(shared), "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def identify_beside(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred__ and score__; rows stay where they are."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = _identify(shared)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(place)], names=["doc_id", "text"])
            at = 0
            for part in inner(iter([pair])):
                rows = batch.slice(at, part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*rows.columns, part.column(1), part.column(2)], names=[*rows.schema.names, "lang_pred__", "score__"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred__", StringType()), StructField("score__", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
