"""Encoding texts into the pieces of a SentencePiece vocabulary and back (operator 10).

Method: streaming Viterbi. The best segmentation is the one whose pieces' scores have the greatest
sum; of a BPE model, whose scores are merge ranks, that is not its own encoder's. Only the positions that a piece can still bridge (a window of the longest piece's length) are
alive; whenever the backpointers of all live positions meet at one boundary, the ids before it are
committed and their state is dropped. Where the vocabulary has no piece that joins a character
with a following blank (checked when it is loaded), every blank is such a boundary, so the ids of
blank-separated units are exact by themselves and a worker keeps those of frequent units.

Blanks are written as U+2581 and a text begins with one, as in the vocabulary. A character without
a piece, and U+2581 itself, is written as the byte pieces of its UTF-8 form, so every valid text
comes back exactly. On equal sums the longer last piece wins.

Defined results: null text gives null ids and null comes back from null; the empty text gives no
ids. No shuffle; memory is bounded by one batch of texts and the cache.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seqrec.llm.textbuf import blank_words, buffers, gather, slices

BLANK = "\u2581"
#: Stands for a U+2581 of the text; a lone surrogate, which no valid text holds.
LITERAL = "\ud800"
CACHE_UNITS = 250_000


class Vocabulary:
    """Pieces and scores of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.raw: list[bytes] = []
        self.byte_ids = [-1] * 256
        low = 0.0
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.raw.append(b"")
            else:
                self.pieces[piece] = (i, m.get_score(i))
                self.raw.append(piece.replace(BLANK, " ").encode())
                low = min(low, m.get_score(i))
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary has no piece for some byte")
        self.other = low - 10.0
        self.longest = max(map(len, self.pieces), default=1)
        self.prefixes = {p[:k]: (-1, 0.0) for p in self.pieces for k in range(1, len(p) + 1)} | self.pieces
        self.blank_cuts = not any(BLANK in p.lstrip(BLANK) for p in self.pieces)
        self.line_cuts = not any("\n" in p for p in self.pieces)


class StreamingViterbi:
    """feed() characters with U+2581 for blanks and LITERAL for U+2581; commits append to ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.ids: list[int] = []
        self.text = ""  # characters from the last committed boundary on
        self.score = [0.0]  # best sums at boundaries, index 0 is the last committed one
        self.back: list[tuple[int, object]] = [(-1, None)]
        self.done = 0  # start positions that have been extended
        self.most = 1  # greatest number of live boundaries

    def feed(self, text: str, last: bool = False) -> None:
        self.text += text
        v, pieces, prefixes = self.v, self.v.pieces, self.v.prefixes
        while self.done < len(self.text) and (last or len(self.text) - self.done >= v.longest):
            i, t = self.done, self.text
            base, n = self.score[i], len(t)
            got = pieces.get(t[i])
            self._offer(i, i + 1, base + (got[1] if got else v.other), got[0] if got else t[i])
            j = i + 2
            while j <= n and (sub := t[i:j]) in prefixes:
                if sub in pieces:
                    piece, s = pieces[sub]
                    self._offer(i, j, base + s, piece)
                j += 1
            self.done += 1
            self.most = max(self.most, len(self.score) - self.done)
            if len(self.score) == self.done + 1:
                self._commit(self.done)
            elif self.done >= 4 * v.longest:
                self._meet()
        if last and self.done:
            self._commit(self.done)

    def _offer(self, i: int, j: int, s: float, piece: object) -> None:
        while len(self.score) <= j:
            self.score.append(float("-inf"))
            self.back.append((-1, None))
        if s > self.score[j] or s == self.score[j] and i < self.back[j][0]:
            self.score[j], self.back[j] = s, (i, piece)

    def _meet(self) -> None:
        """Commit up to the boundary where the paths of all live positions meet, if there is one."""
        live = set(range(self.done, len(self.score)))
        live = {k for k in live if self.score[k] > float("-inf")}
        while len(live) > 1:
            k = max(live)
            live.remove(k)
            live.add(self.back[k][0])
        meet = live.pop()
        if meet > 0:
            self._commit(meet)

    def _commit(self, end: int) -> None:
        path, k = [], end
        while k > 0:
            k, piece = self.back[k]
            path.append(piece)
        for piece in reversed(path):
            if isinstance(piece, int):
                self.ids.append(piece)
            else:
                self.ids.extend(self.v.byte_ids[b] for b in piece.replace(LITERAL, BLANK).encode())
        self.text = self.text[end:]
        base = self.score[end]
        self.score = [s - base for s in self.score[end:]]
        self.back = [(i - end, p) for i, p in self.back[end:]]
        self.back[0] = (-1, None)
        self.done -= end


def _within_window(v: Vocabulary, text: str) -> list[int]:
    """The same for a text that lies in one window, where nothing can be dropped before its end."""
    text = text.replace(BLANK, LITERAL).replace(" ", BLANK)
    n = len(text)
    low = float("-inf")
    score, back, piece = [0.0] + [low] * n, [0] * (n + 1), [None] * (n + 1)
    get, other = v.prefixes.get, v.other
    for i, char in enumerate(text):
        base = score[i]
        got = get(char)
        if got is None or got[0] < 0:
            if base + other > score[i + 1]:
                score[i + 1], back[i + 1], piece[i + 1] = base + other, i, char
            if got is None:
                continue
        j = i + 1
        while got is not None:
            k, s = got
            if k >= 0:
                s += base
                if s > score[j]:
                    score[j] = s
                    back[j] = i
                    piece[j] = k
            j += 1
            if j > n:
                break
            got = get(text[i:j])
    out: list[int] = []
    while n:
        k = piece[n]
        if isinstance(k, int):
            out.append(k)
        else:
            out.extend(v.byte_ids[b] for b in reversed(k.replace(LITERAL, BLANK).encode()))
        n = back[n]
    out.reverse()
    return out


def segment(vocabulary: Vocabulary, text: str, chunk: int = 65536) -> list[int]:
    """Ids of ``text`` as it stands; no leading blank is added."""
    if len(text) <= 4 * vocabulary.longest:
        return _within_window(vocabulary, text)
    s = StreamingViterbi(vocabulary)
    for k in range(0, len(text), chunk):
        s.feed(text[k : k + chunk].replace(BLANK, LITERAL).replace(" ", BLANK))
    s.feed("", last=True)
    return s.ids


class Encoder:
    """Encodes and decodes whole texts; units between blanks and lines go through a cache."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.raw = pa.array(self.v.raw, pa.binary())
        self.plain: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _units(self, text: str) -> list[str]:
        if not self.v.blank_cuts:
            return [" " + text]
        if not self.v.line_cuts:
            return re.findall(" +[^ ]*", " " + text)
        return re.findall(r" +[^ \n]*|\n+|[^ \n]+", " " + text)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        units = self._units(text)
        cache = self.plain
        new = set(units).difference(cache)
        if new:
            if len(cache) > CACHE_UNITS:
                cache.clear()
                new = set(units)
            for u in new:
                cache[u] = array("I", segment(self.v, u)).tobytes()
        return b"".join(map(cache.__getitem__, units))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets by text); units between single blanks at once."""
        if not self.v.blank_cuts:
            parts = [self.encode(t or "") for t in texts.to_pylist()]
            return gather(parts, np.arange(len(parts)), np.arange(len(parts) + 1))
        words, index, offsets = blank_words(texts, lines=False)
        if len(self.words) > CACHE_UNITS:  # words that come again stay
            self.words = {w: self.words[w] for w in words if w in self.words}
        for w in words:
            if w not in self.words:
                self.words[w] = self.encode(w) if "\n" in w else array("I", segment(self.v, " " + w)).tobytes()
        parts = [self.words[w] for w in words]
        empty = words.index("") if "" in words else -1
        if empty >= 0:  # neighbouring blanks may be one piece: such texts are encoded by the other way
            index, offsets = index.astype(np.int64), offsets.astype(np.int64)
            runs = np.unique(np.searchsorted(offsets, np.flatnonzero(index == empty), side="right") - 1)
            keep = np.ones(len(index), bool)
            for k in runs.tolist():
                parts.append(self.encode(texts[k].as_py() or ""))
                index[offsets[k]] = len(parts) - 1
                keep[offsets[k] + 1 : offsets[k + 1]] = False
            count = np.concatenate([[0], np.cumsum(keep)])
            index, offsets = index[keep], count[offsets]
        return gather(parts, index, offsets)

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids; the bytes of all pieces are laid down at once."""
        pieces = self.raw.take(ids.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        data, at = buffers(pieces)
        begin, some = at[ends[:-1]], ends[1:] > ends[:-1]
        keep = np.ones(int(at[-1]), bool)
        keep[begin[some]] = False  # the blank that each begins with
        at = np.append(begin, at[-1]) - np.concatenate([[0], np.cumsum(some)])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), pa.py_buffer(data[: len(keep)][keep])])
        return pc.if_else(ids.is_valid(), texts.cast(pa.string()), pa.scalar(None, pa.string()))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode_column(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            texts, docs = batch.column(1), batch.column(0)
            for lo, hi in slices(texts, 2 << 20):
                part = texts.slice(lo, hi - lo)
                ids, off = enc.encode_column(part)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.view(np.int32)), mask=part.is_null())
                yield pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    return run


def _decode_column(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, enc.decode_column(ids)], names=["doc_id", "ids", "text"])

    return run


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) by the vocabulary at the path ``model``, which every executor has."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_encode_column(model), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) of a result of encode_texts()."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_column(model), "doc_id long, ids array<int>, text string")
