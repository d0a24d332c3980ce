"""Ranking metrics as expressions over arrays of recommended and relevant items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _top(rec: Column, k: int) -> Column:
    return F.slice(rec, 1, k)


def recall(rec: Column, relevant: Column, k: int) -> Column:
    wanted = F.array_distinct(relevant)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(_top(rec, k), wanted)) / F.size(wanted)).otherwise(0.0)


def ndcg(rec: Column, relevant: Column, k: int) -> Column:
    """Binary gains; an item counts at its first place, its repeats still take up places."""
    top, wanted = _top(rec, k), F.array_distinct(relevant)
    gains = F.aggregate(
        F.transform(F.array_intersect(top, wanted), lambda x: 1.0 / F.log2(F.array_position(top, x).cast("double") + 1.0)),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(wanted), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i.cast("double") + 1.0))
    return F.when(F.size(wanted) > 0, gains / ideal).otherwise(0.0)


def reciprocal_rank(rec: Column, relevant: Column, k: int | None = None) -> Column:
    top = _top(rec, k) if k is not None else rec
    first = F.array_min(F.transform(F.array_intersect(top, relevant), lambda x: F.array_position(top, x)))
    return F.coalesce(1.0 / first, F.lit(0.0))


def mean_metrics(ranked: DataFrame, cutoffs: tuple[int, ...] = (10, 20), rec: str = "rec", relevant: str = "relevant") -> DataFrame:
    """(k, n_queries, recall, ndcg, mrr) over all rows, in one pass; zeros without queries."""
    if not cutoffs or min(cutoffs) < 1:
        raise ValueError("cutoffs must be positive")
    r, w = F.col(rec), F.col(relevant)
    each = ranked.select(*(m(r, w, k).alias(f"{n}{k}") for k in cutoffs for n, m in (("recall", recall), ("ndcg", ndcg), ("mrr", reciprocal_rank))))
    total = each.agg(F.count("*").alias("n"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in each.columns))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"recall{k}").alias("recall"), F.col(f"ndcg{k}").alias("ndcg"), F.col(f"mrr{k}").alias("mrr")) for k in sorted(cutoffs))))
    return total.select("n", rows.alias("m")).select("m.k", F.col("n").alias("n_queries"), "m.recall", "m.ndcg", "m.mrr")
