"""Packing of tokenised documents into fixed windows (operator 9).

Method: minimum bin slack. Every document is cut into whole windows and one remainder, so what is
left to pack is a multiset of lengths below the window: at most window - 1 different lengths,
however many documents there are. A plan is made from their counts alone. Each step takes the
longest length left as the window's first piece and finds, by a subset-sum dynamic program on
bitsets (bit s: the sum s can be reached; counts enter in powers of two), the multiset of other
remaining lengths that fills the window closest to its capacity; backtracking through the stored
bitsets gives the counts, and the pattern is used as often as the counts allow. So the plan's size
and time depend on the window, not on the input.

Scale: texts are read and tokenised once, where they lie; only piece rows of a few numbers are
shuffled. Pieces of a length are numbered in hash buckets with offsets from the bucket counts, so
that a length (or a source) with a third of all rows is dealt over many tasks.

Defined results: null text counts as empty, and every document has at least the closing id. Rows
that repeat a doc_id are packed separately. A null doc_id is kept as null. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seqrec.llm.common import bound_batches, materialise
from seqrec.llm.textbuf import blank_words, gather, release, slices

WINDOW = 2048
#: Words kept by a worker; a full cache keeps the words of the next slice only.
CACHE_WORDS = 300_000
#: Marks that are split off a word's end before it is looked up, if one of ALNUM is before them.
ENDS = ".,;:!?#*$%"
ALNUM = frozenset(string.ascii_letters + string.digits)
_FIRST = itemgetter(0)
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


class WordTokenizer:
    """Encodes texts word by word through a cache, with the ids of whole texts.

    Valid for tokenizers whose pre-tokeniser never joins what a blank separates (their pattern
    drops white space), as normalisation and merges then work within blank-separated words. That
    pattern must also part a letter or digit from a mark behind it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: by id: the last id of a pre-token
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[k for t, k in vocab.items() if suffix and t.endswith(suffix)]] = True

    def _learn(self, words: list[str]) -> None:
        """Encodes new words, 256 in a call with blanks between them.

        A word that ends in a letter or digit and then marks of ENDS is encoded as its two parts,
        which the pre-tokeniser parts anyway; most parts are known.
        """
        cache = self.cache
        parts: set[str] = set()
        ended = []
        for word in words:
            base = word.rstrip(ENDS)
            if base != word and base and base[-1] in ALNUM:
                ended.append((word, base, word[len(base) :]))
                parts.update(ended[-1][1:])
            else:
                parts.add(word)
        new = parts.difference(cache)
        plain = [w for w in new if w.isalpha()]
        for kind in (plain, list(new.difference(plain))):
            for k in range(0, len(kind), 256):
                part = kind[k : k + 256]
                for word, ids in zip(part, self._parts(part, kind is plain)):
                    cache[word] = ids
        for word, base, end in ended:
            cache[word] = cache[base] + cache[end]

    def _parts(self, part: list[str], plain: bool) -> list[bytes]:
        """The ids of each word of ``part``. plain: words of letters, so of one pre-token each if
        there are as many last ids as words; that saves the offsets."""
        text = " ".join(part)
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.last[ids]) + 1
        if not plain or len(cuts) != len(part) or cuts[-1] != len(ids):
            e = self.tokenizer.encode(text, add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            cuts = np.searchsorted(np.fromiter(map(_FIRST, e.offsets), np.int64, len(ids)), np.cumsum(size))
        flat, ends = ids.tobytes(), (4 * cuts).tolist()
        return [flat[s:t] for s, t in zip([0, *ends], ends)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in order, offsets by text); null counts as empty."""
        words, index, offsets = blank_words(texts, lines=True)
        if len(self.cache) > CACHE_WORDS:  # words that come again stay
            self.cache = {"": b""} | {w: self.cache[w] for w in words if w in self.cache}
        self._learn([w for w in words if w not in self.cache])
        return gather(list(map(self.cache.__getitem__, words)), index, offsets)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _cut(path: str, window: int, end_id: int):
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            texts, docs = batch.column(1), batch.column(0).to_pylist()
            for lo, hi in slices(texts, 4 << 20):
                ids, off = tok.encode(texts.slice(lo, hi - lo))
                for doc, a, b in zip(docs[lo:hi], off[:-1].tolist(), off[1:].tolist()):
                    n = b - a + 1
                    for s in range(0, n, window):
                        e = min(n, s + window)
                        crc = zlib.crc32(ids[a + s : min(b, a + e)])
                        for column, v in zip(out, (doc, s, e - s, crc if e < n else zlib.crc32(tail, crc), n)):
                            column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        release()

    return run


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of ``counts`` {length: how many} with the largest sum of at most ``capacity``.

    Bitset subset-sum with backtracked counts. Lengths that are most plentiful come first, and the
    search ends once the capacity is met exactly.
    """
    reach = 1
    steps: list[tuple[int, int, int]] = []  # bitset before, length, copies
    room = (1 << (capacity + 1)) - 1
    for length, n in sorted(counts.items(), key=lambda x: (-x[1], -x[0])):
        n = min(n, capacity // length)
        copies = 1
        while n > 0:
            take = min(copies, n)
            more = (reach | reach << (take * length)) & room
            if more != reach:
                steps.append((reach, length, take))
                reach = more
            n -= take
            copies *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    found: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= take * length
    return found


def minimum_bin_slack(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern {length: copies}, times)] that uses up ``counts`` in windows of little slack."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        pattern = fill({k: v for k, v in rest.items() if v and k <= window - first}, window - first)
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        for k, c in pattern.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        plan.append((pattern, times))
    return plan


def _plan_table(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, sequence base, copies in a sequence, offset of the first copy)."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in plan:
        offset = 0
        for length, c in sorted(pattern.items(), reverse=True):
            at = used.get(length, 0)
            table.setdefault(length, []).append((at, base, c, offset))
            used[length] = at + c * times
            offset += c * length
        base += times
    return {k: np.array(v, dtype=np.int64) for k, v in table.items()}


def _place(table):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = table.value
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for v in np.unique(length):
                t, m = rows[int(v)], length == v
                k = np.searchsorted(t[:, 0], rank[m], side="right") - 1
                inside = rank[m] - t[k, 0]
                seq[m] = t[k, 1] + inside // t[k, 2]
                off[m] = t[k, 3] + inside % t[k, 2] * int(v)
            f["sequence_id"], f["offset"] = seq, off
            f["length"] = f["length"].astype("int64")
            yield f[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    ``tokenizer`` is the path of a tokenizer file that every executor has. The ids of a text, then
    ``end_id``, are cut into pieces of ``window`` and a remainder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    pieces = materialise(docs.mapInArrow(_cut(tokenizer, window, end_id), _PIECES), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # window rows at most
    whole = counts.pop(window, 0)
    plan = minimum_bin_slack(counts, window)
    if whole:
        plan.append(({window: 1}, whole))
    table = spark.sparkContext.broadcast(_plan_table(plan))  # bounded by the window

    buckets = min(4096, max(16, max([whole, *counts.values()], default=0) // 100_000))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = pieces.groupBy("length", "bucket").count()
    before = before.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(before, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own") - 1).alias("rank"))
    ranked = ranked.withColumn("doc_id", F.col("doc_id"))
    return ranked.mapInPandas(_place(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
