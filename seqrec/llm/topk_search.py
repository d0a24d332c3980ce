"""Exact top-k search by inner product (operator 1).

Method: norm-bucketed retrieval. Vectors are grouped by length (buckets of lengths within a factor;
a bucket with many vectors is dealt into hash blocks of bounded size). With the current k-th best
score theta of a query q, a block whose longest vector is l can only hold a better one at a cosine
of theta / (|q| l), the block's local threshold. Above 1 the block is skipped. A high local
threshold selects coordinate pruning: with c the threshold, a unit vector p of cosine c or more to
the unit query u has p_f within u_f c +- sqrt((1 - c^2)(1 - u_f^2)) for each coordinate f, tested on
the query's largest coordinates. A low one selects length pruning: only vectors of length
theta / |q| or more, a prefix of the block in order of length. What is left is verified by exact
integer products. Pruning keeps everything that could tie with theta, so the result is exact.

Scale: query blocks meet groups of candidate blocks in tasks of bounded size; in a task blocks come
in falling order of length with running thresholds, and at most k rows for each query leave it.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no part, as
a row without id. Rows that repeat an id count as one, with the least vector. Vectors of different
sizes are compared over their common components; one without any has score 0 with all others. The scaled components are taken as 64-bit
integers, and scores beyond 64 bits are saturated. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqrec.llm.common import materialise

QUERY_BLOCK, BLOCK, GROUP = 8192, 4096, 8
#: Ratio of the lengths in a bucket; local threshold from which coordinates are tested, and how many.
RATIO, COORDINATES_FROM, FOCUS = 1.05, 0.35, 4
_EPS = 1e-9


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    width = max(1, max(map(len, pdf["v"])))
    m = np.zeros((len(pdf), width), np.int64)
    for k, v in enumerate(pdf["v"]):
        m[k, : len(v)] = v
    return pd.DataFrame({"grp": [int(pdf["grp"].iloc[0])], "width": [width], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "mat": [m.tobytes()]})


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.mat, np.int64).reshape(len(ids), row.width)


class _Block:
    def __init__(self, ids: np.ndarray, m: np.ndarray) -> None:
        norm = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        self.ids, self.m, self.norm = ids[order], m[order], norm[order]
        self.high = float(np.abs(m).max(initial=0))
        self.f = self.m.astype(np.float64)
        self.unit = (self.f / np.maximum(self.norm, 1e-300)[:, None]).T.copy()  # by coordinate


def _products(q: np.ndarray, b: _Block, rows: slice | np.ndarray, exact: bool) -> np.ndarray:
    """Exact inner products; in floating point where every sum stays below 2^53."""
    if exact:
        return q.astype(np.float64) @ b.f[rows].T
    s = q.astype(object) @ b.m[rows].astype(object).T
    return np.clip(s, -(1 << 63), (1 << 63) - 1)


class _Best:
    """The k best of one query."""

    def __init__(self, own: int, k: int) -> None:
        self.own, self.k, self.ids, self.scores, self.theta = own, k, np.zeros(0, np.int64), np.zeros(0), -math.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self.theta) & (ids != self.own)
        ids, scores = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, scores[keep]])
        if len(ids) > 4 * self.k and scores.dtype != object:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= cut], scores[scores >= cut]
        order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
        order = order[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.theta = float(self.scores[-1])


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, blocks: list[_Block], k: int) -> list[_Best]:
    """The k best of every query over the blocks, which come in falling order of length."""
    best = [_Best(int(i), k) for i in query_ids]
    fq = queries.astype(np.float64)
    qn = np.sqrt((fq**2).sum(axis=1))
    for b in blocks:
        width = min(queries.shape[1], b.m.shape[1])
        exact = width * float(np.abs(queries).max(initial=0)) * b.high < 2**53
        if width < b.m.shape[1]:
            b = _Block(b.ids, b.m[:, :width])
        for lo in range(0, len(best), 256):
            part = best[lo : lo + 256]
            q, n = queries[lo : lo + 256, :width], qn[lo : lo + 256]
            theta = np.array([x.theta for x in part])
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(n * b.norm[0] > 0, theta / (n * b.norm[0]), np.where(theta > 0, np.inf, -np.inf))
                need = np.where(n > 0, theta / n, -np.inf)
            by_length = np.flatnonzero(~(local >= COORDINATES_FROM))
            if len(by_length):  # low local threshold: a prefix of the lengths
                m = int(np.searchsorted(-b.norm, -(need[by_length].min() * (1 - _EPS)), side="right")) if need[by_length].min() > 0 else len(b.ids)
                s = _products(q[by_length], b, slice(0, m), exact)
                for r, i in enumerate(by_length):
                    part[i].add(b.ids[:m], s[r])
            for i in np.flatnonzero((local >= COORDINATES_FROM) & (local <= 1 + _EPS)):  # high: coordinates
                m = int(np.searchsorted(-b.norm, -(need[i] * (1 - _EPS)), side="right"))
                if not m:
                    continue
                u, c = fq[lo + i, :width] / n[i], min(1.0, float(local[i]))
                ok = np.ones(m, bool)
                for f in np.argpartition(-np.abs(u), min(FOCUS, width) - 1)[:FOCUS]:
                    half = math.sqrt(max(0.0, (1 - c * c) * (1 - u[f] * u[f]))) + 1e-7
                    x = b.unit[f, :m]
                    # beyond the interval's upper end only if the end lies short of the pole
                    if u[f] < c:
                        ok &= x <= u[f] * c + half
                    if u[f] > -c:
                        ok &= x >= u[f] * c - half
                rows = np.flatnonzero(ok)
                if len(rows) > m // 2:
                    rows = slice(0, m)
                s = _products(q[i : i + 1], b, rows, exact)[0]
                part[i].add(b.ids[rows], s)
    return best


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = sorted((_Block(*_matrix(r)) for r in pdf[~pdf["is_query"]].itertuples()), key=lambda b: -b.norm[0])
        out = []
        for row in pdf[pdf["is_query"]].itertuples():
            for x in search_blocks(*_matrix(row), blocks, k):
                out.append(pd.DataFrame({"query_id": np.full(len(x.ids), x.own), "vec_id": x.ids, "score": [int(s) for s in x.scores]}))
        return pd.concat(out).astype("int64") if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each row for which
    ``queries`` (a condition on vec_id) holds with all other rows, components being floor(scale * x)."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")).where("vec_id is not null and e is not null")
    v = v.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))))
    v = v.select("vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = materialise(v.withColumn("bucket", F.when(norm > 0, F.floor(F.log(norm) / (2 * math.log(RATIO)))).otherwise(-1).cast("int")), "vectors")

    per_bucket = v.groupBy("bucket").count()  # buckets are bounded by the range of the lengths
    sizes = {r["bucket"]: r["count"] for r in per_bucket.collect()}
    total = sum(sizes.values())
    n_queries = v.where(queries).count()
    groups, query_blocks = max(1, -(-total // (BLOCK * GROUP))), max(1, -(-n_queries // QUERY_BLOCK))

    parts = per_bucket.select("bucket", F.ceil(F.col("count") / BLOCK).alias("parts"))
    blocks = v.join(F.broadcast(parts), "bucket").withColumn("grp", F.xxhash64("bucket", F.pmod(F.xxhash64("vec_id"), F.col("parts"))))
    packed = "grp long, width int, ids binary, mat binary"
    candidates = blocks.select("grp", "vec_id", "v").groupBy("grp").applyInPandas(_pack, packed)
    asked = v.where(queries).withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))).select("grp", "vec_id", "v").groupBy("grp").applyInPandas(_pack, packed)
    candidates = candidates.select(F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("grp"), F.lit(groups)).cast("int").alias("cg"), "width", "ids", "mat")
    asked = asked.select(F.lit(True).alias("is_query"), F.col("grp").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cg"), "width", "ids", "mat")
    found = candidates.unionByName(asked).groupBy("qb", "cg").applyInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
