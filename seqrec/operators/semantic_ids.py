"""Hierarchical balanced Semantic IDs: codes from an order, from k-means, and the codec's checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from seqrec.config import ClusterConfig
from seqrec.errors import DuplicateCode, DuplicateItem, InvalidCodec, UnknownCode, UnknownItem

#: Levels whose nodes may hold more items than this are clustered where their rows lie; the method is the same.
LOCAL_ITEMS = 50_000


def codes_from_order(items: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(item_id, semantic_id): the digits of each item's place in item order, to the base branching."""
    place = F.row_number().over(Window.orderBy("item_id")) - 1
    digits = [F.floor(F.col("place") / (cfg.branching ** (cfg.depth - 1 - d))) % cfg.branching for d in range(cfg.depth)]
    return items.select("item_id", place.alias("place")).select("item_id", F.array(*(d.cast("int") for d in digits)).alias("semantic_id"))


def _uniform(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) by item, seed and step, wherever the item lies."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1342543DE82EF95) & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _nearest(x: np.ndarray, centres: np.ndarray | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(label, squared distance) of the nearest centre; the distance is taken anew, so that equal vectors have 0."""
    c = np.asarray(centres)
    label = ((c * c).sum(axis=1) / 2 - x @ c.T).argmin(axis=1)
    off = x - c[label]
    return label, np.einsum("ij,ij->i", off, off)


def _draw(ids: np.ndarray, x: np.ndarray, centres: list[np.ndarray], seed: int) -> tuple[float, int, np.ndarray] | None:
    """The next centre of k-means++ as (race, item_id, vector): the least of exponential numbers with
    the squared distances as rates is drawn with odds in proportion to them. None if no vector is left."""
    d = _nearest(x, centres)[1] if centres else np.ones(len(x))
    with np.errstate(divide="ignore"):
        race = -np.log(_uniform(ids, seed, len(centres))) / d
    i = race.argmin()
    return (float(race[i]), int(ids[i]), x[i]) if np.isfinite(race[i]) else None


def _moments(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(rows, vector sum) of each cluster and the sum of squared distances."""
    label, d = _nearest(x, centres)
    return np.bincount(label, minlength=len(centres)), (label == np.arange(len(centres))[:, None]).astype(np.float64) @ x, float(d.sum())


def _lloyd(clusters: dict[int, int], draw, moments, cfg: ClusterConfig) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By node: (centres, rows of each) of the best of several seeded runs, each over its node's rows alone.

    clusters: the number of clusters of each node. ``draw`` and ``moments`` take centres by (node,
    run) and answer by the same keys, so the runs are the same whether rows lie here or are dealt out."""
    centres = {(node, run): [] for node in clusters for run in range(cfg.restarts)}
    going = centres
    while going:  # k-means++ seeding
        drawn = draw(going)
        for key, x in drawn.items():
            centres[key].append(x)
        going = {key: centres[key] for key in drawn if len(centres[key]) < clusters[key[0]]}
    centres = {key: np.array(c) for key, c in centres.items()}
    going = centres
    for _ in range(cfg.iterations):
        still = {}
        for key, (n, total, _) in (moments(going) if going else {}).items():
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[key])
            if not np.allclose(moved, centres[key], atol=1e-9):
                still[key] = moved
        centres |= still
        going = still
    best: dict[int, tuple[float, int, np.ndarray]] = {}
    for (node, run), (n, _, cost) in sorted((moments(centres) if centres else {}).items(), key=lambda x: x[0]):
        if node not in best or cost < best[node][0] * (1 - 1e-9):
            best[node] = (cost, run, n)
    return {node: (centres[node, run], n) for node, (_, run, n) in best.items()}


def _ranks(centres: np.ndarray) -> np.ndarray:
    """The place of each centre in the order of the centres."""
    rank = np.empty(len(centres), np.int64)
    rank[np.lexsort(centres.T[::-1])] = np.arange(len(centres))
    return rank


def _balanced(ids: np.ndarray, x: np.ndarray, children: int, capacity: int, cfg: ClusterConfig) -> np.ndarray:
    """Child tokens: items in the order of their centre, distance to it and id, cut into full chunks."""
    order = np.lexsort((ids,))
    if children > 1:
        ids, x = ids[order], x[order]

        def draw(going):
            found = {key: _draw(ids, x, c, cfg.seed + key[1]) for key, c in going.items()}
            return {key: f[2] for key, f in found.items() if f}

        centres, _ = _lloyd({0: children}, draw, lambda going: {key: _moments(x, c) for key, c in going.items()}, cfg)[0]
        label, d = _nearest(x, centres)
        order = order[np.lexsort((ids, np.sqrt(d), _ranks(centres)[label]))]
    token = np.empty(len(order), np.int64)
    token[order] = np.arange(len(order)) // capacity
    return token


def _splitter(capacity: int, cfg: ClusterConfig):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["item_id"].to_numpy()
        token = _balanced(ids, x, math.ceil(len(ids) / capacity), capacity, cfg)
        pdf["semantic_id"] = [[*s, int(t)] for s, t in zip(pdf["semantic_id"], token)]
        return pdf

    return split


def codes_from_clusters(embeddings: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(item_id, semantic_id) by balanced hierarchical k-means, one level of the tree at a time.

    Nodes are packed full, so every subtree keeps to its capacity. The last level has one item to a
    child and is an order by vector. Nodes up to LOCAL_ITEMS are clustered in NumPy by groups of
    their prefix; larger ones by the same k-means over rows that stay dealt out. Draws go by item id,
    so that both give the same codes, but for the rounding of sums.
    """
    n = embeddings.count()
    if n == 0:
        raise InvalidCodec("no items to cluster")
    if embeddings.select("item_id").distinct().count() != n:
        raise DuplicateItem("item ids repeat")
    if n > cfg.capacity:
        raise InvalidCodec(f"capacity {cfg.capacity} is below {n} items")
    rows = embeddings.select("item_id", "embedding", F.array().cast("array<int>").alias("semantic_id"))
    for level in range(cfg.depth):
        capacity = cfg.branching ** (cfg.depth - level - 1)
        most = min(n, capacity * cfg.branching)
        if capacity >= most:
            rows = rows.withColumn("semantic_id", F.concat("semantic_id", F.array(F.lit(0))))
            continue
        if capacity == 1:
            order = Window.partitionBy("semantic_id").orderBy("embedding", "item_id")
            rows = rows.withColumn("semantic_id", F.concat("semantic_id", F.array((F.row_number().over(order) - 1).cast("int"))))
            continue
        if most > LOCAL_ITEMS:
            rows = _split_large(rows, capacity, cfg)
            continue

        rows = rows.groupBy("semantic_id").applyInPandas(_splitter(capacity, cfg), rows.schema)
    return rows.select("item_id", "semantic_id")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rows, item ids, vectors) of each node in each batch of (item_id, embedding, node)."""
    for batch in batches:
        if batch.num_rows:
            ids, node = batch.column("item_id").to_numpy(), batch.column("node").to_numpy()
            x = batch.column("embedding").flatten().to_numpy().astype(np.float64, copy=False).reshape(batch.num_rows, -1)
            for k in np.unique(node):
                at = np.flatnonzero(node == k)
                yield int(k), at, ids[at], x[at]


def _split_large(rows: DataFrame, capacity: int, cfg: ClusterConfig) -> DataFrame:
    """One level for large nodes, as _balanced does it: each node has its own centres, and every pass
    over the rows serves all runs of all nodes. Only centres and sums come to the driver."""
    node = F.aggregate("semantic_id", F.lit(0).cast("long"), lambda a, t: a * cfg.branching + t)
    rows = rows.withColumn("node", node)
    held = rows.select("item_id", "embedding", "node").persist()
    clusters = {r["node"]: k for r in held.groupBy("node").count().collect() if (k := math.ceil(r["count"] / capacity)) > 1}
    dim = held.select(F.size("embedding").alias("n")).first()["n"]

    def by_node(going: dict) -> dict:
        out: dict = {}
        for (k, run), c in going.items():
            out.setdefault(k, []).append((run, c))
        return out

    def draw(going: dict) -> dict:
        asked, seed = by_node(going), cfg.seed

        def run_(batches):
            best: dict = {}
            for k, _, ids, x in _parts(batches):
                for run, c in asked.get(k, ()):
                    if (f := _draw(ids, x, c, seed + run)) and ((k, run) not in best or f[:2] < best[k, run][:2]):
                        best[k, run] = f
            table = [(k, run, race, i, x.tolist()) for (k, run), (race, i, x) in best.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in table], schema=schema)

        schema = pa.schema([("node", pa.int64()), ("run", pa.int32()), ("race", pa.float64()), ("item_id", pa.int64()), ("x", pa.list_(pa.float64()))])
        found = held.mapInArrow(run_, "node long, run int, race double, item_id long, x array<double>")
        found = found.groupBy("node", "run").agg(F.min_by("x", F.struct("race", "item_id")).alias("x"))
        return {(r["node"], r["run"]): np.array(r["x"]) for r in found.collect()}

    def moments(going: dict) -> dict:
        asked = by_node(going)

        def run_(batches):
            sums: dict = {}
            for k, _, _, x in _parts(batches):
                for run, c in asked.get(k, ()):
                    m = _moments(x, c)
                    sums[k, run] = tuple(a + b for a, b in zip(sums[k, run], m)) if (k, run) in sums else m
            table = [(k, run, c, int(n[c]), total[c].tolist(), cost if c == 0 else 0.0) for (k, run), (n, total, cost) in sums.items() for c in range(len(n)) if n[c] or c == 0]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in table], schema=schema)

        schema = pa.schema([("node", pa.int64()), ("run", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64())), ("cost", pa.float64())])
        found = held.mapInArrow(run_, "node long, run int, c int, n long, total array<double>, cost double")
        found = found.groupBy("node", "run", "c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total"), F.sum("cost").alias("cost"))
        out = {key: [np.zeros(len(c), np.int64), np.zeros((len(c), dim)), 0.0] for key, c in going.items()}
        for r in found.collect():
            m = out[r["node"], r["run"]]
            m[0][r["c"]], m[1][r["c"]] = r["n"], r["total"]
            m[2] += r["cost"]
        return out

    table = {}
    for k, (centres, n) in _lloyd(clusters, draw, moments, cfg).items():
        rank = _ranks(centres)
        before = np.zeros(len(n), np.int64)
        before[np.argsort(rank)[1:]] = np.cumsum(n[np.argsort(rank)])[:-1]
        table[k] = (centres, rank, before)
    held.unpersist()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, before, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for k, at, _, x in _parts(iter([batch])):
                if k in table:
                    label, d = _nearest(x, table[k][0])
                    rank[at], before[at], far[at] = table[k][1][label], table[k][2][label], np.sqrt(d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank), pa.array(before), pa.array(far)], names=[*batch.schema.names, "rank", "before", "far"])

    schema = StructType([*rows.schema.fields, StructField("rank", LongType()), StructField("before", LongType()), StructField("far", DoubleType())])
    order = Window.partitionBy("node", "rank").orderBy("far", "item_id")
    token = F.floor((F.col("before") + F.row_number().over(order) - 1) / capacity).cast("int")
    return rows.mapInArrow(place, schema).select("item_id", "embedding", F.concat("semantic_id", F.array(token)).alias("semantic_id"))


def duplicate_codes(codec: DataFrame) -> DataFrame:
    """(semantic_id, item_ids) of codes that several items have."""
    return codec.groupBy("semantic_id").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids")).where(F.size("item_ids") > 1)


def codec_summary(codec: DataFrame) -> DataFrame:
    """One row of counts that decide whether a codec is valid."""
    return codec.agg(
        F.count("*").alias("n"),
        F.countDistinct("item_id").alias("n_items"),
        F.countDistinct("semantic_id").alias("n_codes"),
        F.coalesce(F.min(F.size("semantic_id")), F.lit(0)).alias("shortest"),
        F.coalesce(F.max(F.size("semantic_id")), F.lit(0)).alias("longest"),
        F.coalesce(F.min(F.array_min("semantic_id")), F.lit(0)).alias("least"),
    )


def validate_codec(codec: DataFrame) -> DataFrame:
    """``codec``, or an error that names what is wrong."""
    s = codec_summary(codec).first()
    if not s.n or not s.shortest or s.shortest != s.longest or s.least < 0:
        raise InvalidCodec("a codec needs codes of one length and tokens from 0")
    if s.n_items < s.n:
        raise DuplicateItem("item ids repeat")
    if s.n_codes < s.n:
        raise DuplicateCode("codes repeat")
    return codec


def encode(items: DataFrame, codec: DataFrame, strict: bool = True) -> DataFrame:
    out = items.join(codec, "item_id", "left")
    if strict:
        out = out.withColumn("semantic_id", F.coalesce("semantic_id", F.raise_error(F.lit("an item has no code")).cast("array<int>")))
    return out


def decode(codes: DataFrame, codec: DataFrame, strict: bool = True) -> DataFrame:
    out = codes.join(codec, "semantic_id", "left")
    if strict:
        out = out.withColumn("item_id", F.coalesce("item_id", F.raise_error(F.lit("no item has a code")).cast("bigint")))
    return out


def require_known(unknown: DataFrame, codes: bool = False) -> None:
    """Raises if the anti-join ``unknown`` has a row."""
    row = unknown.first()
    if row is not None:
        raise (UnknownCode if codes else UnknownItem)(str(row.asDict()))


def vocab_size(codec: DataFrame, offset: int = 3) -> DataFrame:
    """(vocab_size): greatest token + 3 for the scorer's vocabulary, + 1 for a raw index."""
    return codec.agg((F.max(F.array_max("semantic_id")) + offset).cast("bigint").alias("vocab_size"))


def synthetic_codes(spark, n: int, depth: int, vocab: int, seed: int = 0) -> DataFrame:
    """``n`` different codes in sorted order: digits of a seeded affine permutation of 0..vocab^depth-1."""
    total = vocab**depth
    if total < n:
        raise InvalidCodec("not so many different codes")
    step = next(s for s in range(total * 5 // 8 + 1 + seed % 97, 2 * total + 2) if math.gcd(s, total) == 1)
    place = (F.col("id").cast("decimal(20,0)") * F.lit(step).cast("decimal(18,0)") + F.lit(seed)) % F.lit(total).cast("decimal(18,0)")
    codes = spark.range(n).select(place.cast("bigint").alias("p"))
    return codes.select(F.array(*(F.floor(F.col("p") / vocab ** (depth - 1 - d)).cast("bigint") % vocab for d in range(depth))).cast("array<int>").alias("semantic_id")).orderBy("semantic_id")
