"""Similarity self-join of texts on word shingles (operator 7).

Method: size-banded tiles with hashed bitmap signatures. Two sets A and B of Jaccard >= t share a
shingle among the first |A| - ceil(t|A|) + 1 of A and likewise of B, in any common order of the
shingles; here the order is by estimated document frequency (rare first), so that passages which
many documents share come last. A tile holds the sets of one size band (and of the next) that have
such a shingle in common. Inside a tile, sizes, the shingle's positions and then the bit counts of
two 512-bit parity bitmaps (|A xor B| >= bits set in bitmap A xor bitmap B) bound the overlap from
above; what is left is verified by an exact intersection of sorted arrays.

Scale: equal sets are one node. In each tile a set first meets three neighbours by size and the
tile's least id; its two closest by bit counts are verified and components found; then only pairs
between different components are listed, each in the first tile they share in a row, so a group of
m near copies costs O(m) rows in practice. No pair is capped or sampled: every pair that passes the bounds is either inside a component or verified.

Defined results: a null or word-less text has n_shingles 0 and is linked with nothing. A text with
fewer words than ``width`` has one shingle, the whole sequence. Rows that repeat a doc_id are one
document that links by any of its texts; each row returns its own n_shingles. Rows without doc_id
keep a null component. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seqrec.llm.common import bound_batches, by_ids, connected_components, materialise
from seqrec.llm.textbuf import release, shingle_sets

#: Counters of the frequency sketch. Its size is fixed, so the broadcast is 4 MB whatever the input.
SKETCH_BITS = 22
_CHUNKS = 64
_HEAD = "kind int, doc_id long, n int, k1 long, k2 long, b0 long, b1 long, b2 long, b3 long, b4 long, b5 long, b6 long, b7 long, part int, cells binary"
_SIG = [f"b{i}" for i in range(8)]


def _signature(h: np.ndarray) -> np.ndarray:
    bits = np.bincount((h >> np.uint64(40)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _heads(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int32)
        pending: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal pending, held
            if pending:
                np.add.at(cells, np.concatenate(pending), 1)
            pending, held = [], 0

        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())] + [(b, pa.int64()) for b in _SIG] + [("part", pa.int32()), ("cells", pa.binary())])
        for batch in batches:
            n, keys, sig = [], [], []
            for h in shingle_sets(batch.column(1), width):
                n.append(len(h))
                keys.append(np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64))
                sig.append(_signature(h))
                pending.append((h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32))
                held += len(h)
                if held > 500_000:
                    flush()
            rows = len(n)
            if not rows:
                continue
            keys, sig = np.stack(keys), np.stack(sig)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(rows, np.int32)), batch.column(0).cast(pa.int64()), pa.array(np.array(n, np.int32)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())]
                + [pa.array(sig[:, i].copy()) for i in range(8)]
                + [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                schema=schema,
            )
        flush()
        if cells.any():
            parts = np.minimum(cells, 255).astype(np.uint8).reshape(_CHUNKS, -1)
            none = pa.nulls(_CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(_CHUNKS, np.int32)), none, pa.nulls(_CHUNKS, pa.int32()), none, none] + [none] * 8 + [pa.array(np.arange(_CHUNKS, dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())],
                schema=schema,
            )
        release()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch parts of a partition, one row for each part seen."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(cells), np.uint8).astype(np.int64)
            total[part] = total[part] + x if part in total else x
    for part, x in total.items():
        level = np.clip(np.floor(4 * np.log2(np.maximum(x, 1))), 0, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], names=["part", "cells"])


def _levels(heads: DataFrame) -> np.ndarray:
    """Quantised estimate of every sketch cell's document frequency; 0 means one document at most."""
    sums = heads.where("kind = 1").select("part", "cells").repartition(_CHUNKS, "part").mapInArrow(_merge, "part int, cells binary")
    out = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.uint8)
    for row in sums.collect():  # _CHUNKS rows of fixed size, whatever the input
        out[row.part] = np.frombuffer(zlib.decompress(row.cells), np.uint8)
    return out.reshape(-1)


def _postings(width: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            tokens, ids, places, befores = [], [], [], []
            for doc, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width)):
                n = len(h)
                if not n:
                    continue
                rank = level[(h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                first = n - -(-percent * n // 100) + 1
                order = np.argsort(rank, kind="stable")[:first]
                token = h[order].view(np.int64)
                before = np.concatenate([[0], token[:-1]])
                alone = int(np.searchsorted(rank[order], 0, side="right"))  # no other document has these
                tokens.append(token[alone:])
                befores.append(before[alone:])
                ids.append(np.full(first - alone, doc, np.int64))
                places.append((np.int64(n) << 32) + np.arange(alone, first))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, ids, places, befores)], names=["token", "id", "place", "before"])
        release()

    return run


def _verifier(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keep], names=["a", "b", "ok"])
        release()

    return run


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, ok) of ``pairs`` (a, b), from the sets of both texts."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialise(by_ids(docs.select("doc_id", "text"), materialise(ids, "tested-ids"), "doc_id"), "texts").withColumnRenamed("doc_id", "id")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(_verifier(width, percent), "a long, b long, ok boolean")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_shingles, component_id, n_equal).

    Two documents link when 100 * |A and B| >= percent * |A or B|; component_id is the smallest
    doc_id that links reach.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    heads = materialise(docs.mapInArrow(_heads(width), _HEAD), "heads")
    rows = heads.where("kind = 0")
    reps = materialise(rows.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.count("*").alias("copies"), *(F.min(b).alias(b) for b in _SIG)), "reps")
    levels = spark.sparkContext.broadcast(_levels(heads))
    ids = reps.select("id").distinct()
    copies = rows.where("doc_id is not null").select("doc_id").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").distinct()
    distinct_docs = by_ids(docs.where("doc_id is not null and text is not null"), materialise(copies, "copies"), "doc_id", "left_anti")

    # place: the set's size (high 32 bits) and the shingle's position in the common order (low 32)
    postings = distinct_docs.mapInArrow(_postings(width, percent, levels), "token long, id long, place long, before long")
    tile = Window.partitionBy("token").orderBy(F.shiftright("place", 32), "id")
    shared = postings.select("*", F.lag("id").over(tile).alias("prev"), F.lead("id").over(tile).alias("next"))
    shared = materialise(shared.where("prev is not null or next is not null").select("token", "id", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("pos"), "before"), "shared")
    sig_a = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), *(F.col(b).alias(f"a{b}") for b in _SIG))
    sig_b = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), *(F.col(b).alias(f"b{b}") for b in _SIG))

    # a few neighbours by size and one common partner in each tile; each set tests its best two
    tile, every = Window.partitionBy("token").orderBy("n", "id"), Window.partitionBy("token")
    own = F.struct("id", "n")
    near = F.array(*(F.lag(own, k).over(tile) for k in (1, 2, 3)), F.min(own).over(every))
    edges = shared.select("id", "n", near.alias("near")).select("id", "n", F.explode("near").alias("x"))
    edges = edges.where(f"x.id <> id and 100 * least(n, x.n) >= {percent} * greatest(n, x.n)").select(F.col("x.id").alias("a"), F.col("id").alias("b")).distinct()
    edges = edges.join(sig_a, "a").join(sig_b, "b").withColumn("apart", F.expr(" + ".join(f"bit_count(a{b} ^ b{b})" for b in _SIG)))
    edges = edges.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and (na + nb - apart) / 2 >= ceil({percent} * (na + nb) / cast({100 + percent} as double))")
    order = F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))
    edges = edges.select("a", "b", order.alias("k")).where("k <= 2")
    first = _verified(materialise(edges, "edges"), distinct_docs, width, percent).where("ok").select("a", "b")
    same = rows.where("n > 0 and doc_id is not null").join(reps.select("k1", "k2", "id"), ["k1", "k2"]).groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.collect_set("id").alias("all")).where("a <> b").select("a", F.explode("all").alias("b")).where("a <> b")
    links = materialise(first.unionByName(same), "links")
    labels = materialise(connected_components(links), "labels")

    # tiles that hold more than one component
    named = shared.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    rest = named.join(mixed, "token", "left_semi").join(reps.select("id", "n", *_SIG), ["id", "n"])
    rest = materialise(rest.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(100 / percent)) + 1e-9)).cast("int")), "tiles")
    x = rest.select(*(F.col(c).alias(f"x_{c}") for c in ("id", "n", "pos", "before", "c", *_SIG)), "token", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    y = rest.select(*(F.col(c).alias(f"y_{c}") for c in ("id", "n", "pos", "before", "c", *_SIG)), "token", "band")
    need = f"ceil({percent} * (x_n + y_n) / cast({100 + percent} as double))"
    apart = " + ".join(f"bit_count(x_{b} ^ y_{b})" for b in _SIG)
    # a pair with the same shingle before this one meets in that shingle's tile too, and not here
    pairs = x.join(y, ["token", "band"]).where(
        f"x_c <> y_c and (x_n < y_n or x_n = y_n and x_id < y_id) and 100 * x_n >= {percent} * y_n and (x_before <> y_before or x_pos = 0 or y_pos = 0) "
        f"and least(x_n - x_pos, y_n - y_pos) >= {need} and (x_n + y_n - ({apart})) / 2 >= {need}"
    )
    pairs = materialise(pairs.groupBy(F.col("x_id").alias("a"), F.col("y_id").alias("b")).agg(F.min(F.expr(apart)).alias("apart")), "pairs")

    best = True
    while not pairs.isEmpty():
        now = pairs
        if best:  # one edge for each set connects most of what belongs together
            now = pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
        tested = materialise(_verified(now, distinct_docs, width, percent), "tested")
        links = links.unionByName(tested.where("ok").select("a", "b"))
        labels = materialise(connected_components(links), "labels")
        if not best:
            break
        left = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        la, lb = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        pairs = materialise(left.join(la, "a", "left").join(lb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "apart"), "pairs")
        best = False

    rep = reps.join(labels.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", "copies", F.coalesce("component", "id").alias("component"))
    out = rows.join(rep, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_equal"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose group holds a smaller doc_id. Documents without words or
    doc_id stay.

    Where doc_ids repeat, every row is judged by its own text: one row of each group stays, that of
    the smallest doc_id, then of the least hash of its text, then of all columns; rows without words
    collapse under one doc_id."""
    twice = materialise(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        joined = materialise(ngram_jaccard_join(docs, width=width, percent=percent), "groups")
        drop = materialise(joined.where("component_id <> doc_id").select("doc_id").distinct(), "drop")
        return by_ids(docs, drop, "doc_id", "left_anti").select(*docs.columns)
    content = F.xxhash64(F.to_json(F.struct(*docs.columns)))
    rows = materialise(docs.withColumns({"row__": F.monotonically_increasing_id(), "rank__": F.struct("doc_id", F.xxhash64("text"), content)}), "rows")
    named = rows.where("doc_id is not null")
    joined = ngram_jaccard_join(named, id_col="row__", width=width, percent=percent).withColumnRenamed("doc_id", "row__")
    joined = joined.join(named.select("row__", "rank__"), "row__").withColumn("empty", F.when(F.col("n_shingles") == 0, F.col("rank__.doc_id")))
    joined = materialise(joined.withColumn("group", F.when(F.col("empty").isNull(), F.col("component_id"))).select("row__", "rank__", "empty", "group"), "groups")
    stay = joined.groupBy("empty", "group").agg(F.min_by("row__", F.struct("rank__", "row__")).alias("row__")).select("row__")
    drop = materialise(joined.select("row__").join(stay, "row__", "left_anti"), "drop")
    return by_ids(rows, drop, "row__", "left_anti").select(*docs.columns)
