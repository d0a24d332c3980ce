"""Texts and bytes as ISO media containers, indexed by their boxes (operator 8).

Writing: a text's UTF-8 bytes, filled with blanks to a positive multiple of 192, become uncompressed
8 x 8 frames of three 8-bit components (192 bytes each) in one video track: ftyp, mdat, moov. The
payload is stored as it is, so it comes back exactly.

Reading: nested boxes are walked by their sizes (32-bit, 64-bit or up to the end) and the sample
tables are decoded with NumPy: stsc and stco or co64 give each sample's chunk, stsz its size, stts
its time, stss the keyframes (all samples, without one). Codec, duration and the keyframes' byte
ranges come from these tables alone; payload bytes are only touched by payload(), which copies the
samples' ranges.

Texts and containers are handled where they lie; nothing is shuffled, and a task holds one slice of
rows at a time.

Defined results: null text counts as empty, whose payload is 192 blanks; a container that is null or
malformed has status ``invalid`` and null columns; equal texts give equal bytes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqrec.llm.textbuf import slices

SIDE, FRAME, TIMESCALE, KEY_INTERVAL = 8, 192, 25, 16
#: Boxes that hold boxes: fixed values.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
SLICE = 4 << 20


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return head + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % FRAME or (0 if data else FRAME))


def write_container(payload: bytes) -> bytes:
    """A container whose frames are ``payload``, a positive multiple of 192 bytes."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError("the payload is not a positive multiple of a frame")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")
    mdat = _box(b"mdat", payload)
    start = len(ftyp) + len(mdat) - len(payload)
    chunks = -(-n // KEY_INTERVAL)
    offsets = start + np.arange(chunks, dtype=np.int64) * KEY_INTERVAL * FRAME
    last = n - (chunks - 1) * KEY_INTERVAL
    runs = [(1, KEY_INTERVAL if chunks > 1 else last, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != KEY_INTERVAL else [])
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    large = offsets[-1] >= 1 << 32
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * KEY_INTERVAL + 1).astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes()),
    )
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 1 << 16, 256), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, mdat, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def walk(data: bytes, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box types, start and end of the body) of all boxes, in order, those in boxes too."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if hi - lo < 16:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], lo + 16
        elif size == 0:
            size = hi - lo
        if size < body - lo or lo + size > hi:
            raise ValueError("a box is larger than what holds it")
        if len(path) > 16:
            raise ValueError("boxes are nested too deep")
        yield (*path, kind), body, lo + size
        if kind in NESTED:
            yield from walk(data, body, lo + size, (*path, kind))
        lo += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    keys: np.ndarray  # indices of keyframes

    def key_ranges(self) -> list[tuple[int, int]]:
        """(start, length) in the container of each keyframe."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist()))


def _table(data: bytes, at: tuple[int, int], kind: str, columns: int = 1, skip: int = 8) -> np.ndarray:
    n = struct.unpack_from(">I", data, at[0] + skip - 4)[0]
    step = np.dtype(kind).itemsize * columns
    if at[0] + skip + n * step > at[1]:
        raise ValueError("a table is larger than its box")
    return np.frombuffer(data, kind, n * columns, at[0] + skip).astype(np.int64).reshape(-1, columns)


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    try:
        codec = data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16].decode("latin-1")
        mdhd = boxes[b"mdhd"][0]
        timescale, duration = struct.unpack_from(">IQ", data, mdhd + 20) if data[mdhd] == 1 else struct.unpack_from(">II", data, mdhd + 12)
        fixed, n = struct.unpack_from(">II", data, boxes[b"stsz"][0] + 4)
        if fixed and n * fixed > len(data):
            raise ValueError("samples are larger than the container")
        sizes = np.full(n, fixed, np.int64) if fixed else _table(data, boxes[b"stsz"], ">u4", skip=12)[:, 0]
        chunks = _table(data, boxes[b"co64"], ">u8")[:, 0] if b"co64" in boxes else _table(data, boxes[b"stco"], ">u4")[:, 0]
        runs = _table(data, boxes[b"stsc"], ">u4", 3)
        times = _table(data, boxes[b"stts"], ">u4", 2)
    except (KeyError, struct.error, IndexError) as e:
        raise ValueError(f"a table is missing or cut off: {e}") from e
    reach = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    if len(runs) and (runs[0, 0] != 1 or (reach < 0).any()) or int((reach * runs[:, 1]).sum()) != n or int(times[:, 0].sum()) != n:
        raise ValueError("the sample tables disagree")
    each = np.repeat(runs[:, 1], reach)
    first = np.cumsum(each) - each
    inside = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks - inside[np.minimum(first, max(n - 1, 0))] if n else chunks, each) + inside
    if n and (offsets.min() < 0 or int((offsets + sizes).max()) > len(data)):
        raise ValueError("a sample lies outside the container")
    deltas = np.repeat(times[:, 1], times[:, 0])
    keys = _table(data, boxes[b"stss"], ">u4")[:, 0] - 1 if b"stss" in boxes else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a keyframe is no sample")
    return Track(codec, timescale, duration, offsets, sizes, np.cumsum(deltas) - deltas, keys)


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, from its boxes; ValueError if they don't fit together."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, lo, hi in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif path[:2] == (b"moov", b"trak"):
            found[-1][path[-1]] = (lo, hi)
    return [_track(data, boxes) for boxes in found]


def payload(data: bytes, track: Track) -> bytes:
    """The bytes of all samples, in order; neighbouring ranges are copied at once."""
    if not len(track.offsets):
        return b""
    cut = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(track.offsets)]]) - 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[first].tolist(), (track.offsets[last] + track.sizes[last]).tolist()))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1), SLICE):
            raw = [(t or "").encode() for t in batch.column(1)[lo:hi].to_pylist()]
            media = pa.array([write_container(padded(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(list(map(len, raw)), pa.int64()), media], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a container."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


_INDEX = "status string, codec string, timescale long, duration long, n_samples long, keyframes array<struct<start: long, length: long>>"
_KEYS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column(1).to_pylist():
            try:
                t = tracks(data or b"")[0]
                rows.append(("ok", t.codec, t.timescale, t.duration, len(t.offsets), [{"start": a, "length": n} for a, n in t.key_ranges()]))
            except (ValueError, IndexError):
                rows.append(("invalid", None, None, None, None, None))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _KEYS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "status", "codec", "timescale", "duration", "n_samples", "keyframes"])


def index_media(media: DataFrame) -> DataFrame:
    """(doc_id, status, codec, timescale, duration, n_samples, keyframes) of the first track of each
    container in ``media`` (doc_id, media)."""
    return media.select("doc_id", "media").mapInArrow(_index, f"doc_id long, {_INDEX}")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "timescale", "duration", "keyframes"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for data in batch.column(2):
            data = data.as_py()
            t = tracks(data)[0]
            p = payload(data, t)
            ranges = np.stack([t.offsets[t.keys], t.sizes[t.keys]], axis=1).astype("<i8")
            feature = f"{t.codec.strip()};{t.duration}/{t.timescale};{len(t.offsets)};{len(t.keys)};{zlib.crc32(ranges.tobytes())}"
            keys = ",".join(f"{start}:{length}" for start, length in t.key_ranges())
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, t.codec.strip(), t.timescale, t.duration, keys))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)


def digest_media(media: DataFrame) -> DataFrame:
    """Digests of payloads and containers of a result of store_texts(), read back from the bytes, with
    codec, timescale, duration and keyframe byte ranges (start:length, comma-joined) of the first
    track. An empty table stays empty; repeated rows give repeated results."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, timescale long, duration long, keyframes string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, schema)
