"""Popularity and item co-occurrence: models as tables, recommendation for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqrec.config import KnnConfig
from seqrec.functions.arrays import last, or_empty


def popularity(train: DataFrame) -> DataFrame:
    """(item_id, item_count, item_rank) by falling count, then item."""
    counts = train.groupBy(F.col("target_item_id").alias("item_id")).agg(F.count("*").alias("item_count"))
    rank = F.row_number().over(Window.orderBy(F.desc("item_count"), "item_id"))  # item cardinality
    return counts.withColumn("item_rank", rank.cast("bigint"))


def _head(model: DataFrame, n: Column | int) -> DataFrame:
    return model.where(F.col("item_rank") <= n)


def popular_unseen(queries: DataFrame, model: DataFrame, k: int, seen: str = "seen") -> DataFrame:
    """(query_id, rank, item_id): the k most popular items outside each query's ``seen``.

    Only the first k + longest seen list of the ranking can be needed, which is one array shared by
    all queries.
    """
    longest = queries.agg(F.coalesce(F.max(F.size(F.col(seen))), F.lit(0)).alias("m"))
    head = model.join(F.broadcast(longest), F.col("item_rank") <= F.col("m") + k).agg(F.sort_array(F.collect_list(F.struct("item_rank", "item_id"))).alias("head"))
    left = F.slice(F.filter("head", lambda x: ~F.array_contains(F.col(seen), x["item_id"])), 1, k)
    flat = queries.crossJoin(F.broadcast(head)).select("query_id", F.posexplode(left).alias("p", "x"))  # one row
    return flat.select("query_id", (F.col("p") + 1).cast("bigint").alias("rank"), F.col("x.item_id").alias("item_id"))


def pair_counts(train: DataFrame, history: int) -> DataFrame:
    """(source_item_id, target_item_id, pair_count): in how many examples the last ``history``
    positives hold the source, counted once for an example; without self-pairs."""
    recent = F.array_distinct(last(or_empty(F.col("positive_history_item_ids")), history))
    pairs = train.select(F.explode(recent).alias("source_item_id"), "target_item_id").where("source_item_id <> target_item_id")
    return pairs.groupBy("source_item_id", "target_item_id").agg(F.count("*").alias("pair_count"))


def neighbors(train: DataFrame, cfg: KnnConfig) -> DataFrame:
    """The first ``cfg.candidates`` targets of each source by count, popularity and item."""
    pop = popularity(train).select(F.col("item_id").alias("target_item_id"), "item_rank")
    ranked = pair_counts(train, cfg.history).join(pop, "target_item_id", "left")
    order = Window.partitionBy("source_item_id").orderBy(F.desc("pair_count"), F.coalesce("item_rank", F.lit(2**63 - 1)), "target_item_id")
    ranked = ranked.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= cfg.candidates)
    return ranked.select("source_item_id", "target_item_id", "pair_count", F.col("candidate_rank").cast("bigint").alias("candidate_rank"))


def knn_recommend(queries: DataFrame, model: DataFrame, pop: DataFrame, k: int, history: int = 50, past: str = "history") -> DataFrame:
    """(query_id, rank, item_id): candidates by the sum of pair counts over the last ``history``
    items (repeats count again), then popular items, none of them in the query's ``past``."""
    n_pop = pop.agg(F.count("*").alias("n_pop"))
    asked = queries.select("query_id", F.explode(last(F.col(past), history)).alias("source_item_id"))
    scores = asked.join(model, "source_item_id").groupBy("query_id", F.col("target_item_id").alias("item_id")).agg(F.sum("pair_count").alias("score"))
    seen = queries.select("query_id", F.explode(F.array_distinct(past)).alias("item_id"))
    scores = scores.join(seen, ["query_id", "item_id"], "left_anti").join(pop.select("item_id", "item_rank"), "item_id", "left").crossJoin(F.broadcast(n_pop))
    scores = scores.select("query_id", "item_id", F.lit(0).alias("tier"), F.col("score"), F.coalesce("item_rank", F.col("n_pop") + 1).alias("item_rank"))
    # the fallback: at most k popular items beyond the candidates of a query
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "item_rank", "item_id")
    scores = scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    taken = scores.groupBy("query_id").agg(F.collect_list("item_id").alias("taken"))
    filled = queries.join(taken, "query_id", "left").select("query_id", F.array_union(F.col(past), or_empty(F.col("taken"))).alias("seen"))
    popular = popular_unseen(filled, pop, k).select("query_id", "item_id", F.lit(1).alias("tier"), F.lit(0).cast("bigint").alias("score"), F.col("rank").alias("item_rank"))
    both = scores.unionByName(popular).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return both.where(F.col("rank") <= k).select("query_id", "rank", "item_id")


def as_lists(recommended: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries`` with the column rec, the items in order of rank (empty without any)."""
    lists = recommended.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("rec"))
    return queries.join(lists, "query_id", "left").withColumn("rec", or_empty(F.col("rec")))
