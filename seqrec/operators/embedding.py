"""Hashed-projection item embeddings from the contexts of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqrec.config import EmbeddingConfig
from seqrec.functions.arrays import bucket, last, or_empty, sign, unit


def item_universe(train: DataFrame) -> DataFrame:
    """All targets and all items of whole positive histories, once."""
    past = train.select(F.explode(or_empty(F.col("positive_history_item_ids"))).alias("item_id"))
    return train.select(F.col("target_item_id").alias("item_id")).unionByName(past).distinct()


def item_index(items: DataFrame, first: int = 0) -> DataFrame:
    """``items`` with a dense index in item order."""
    return items.withColumn("item_idx", (F.row_number().over(Window.orderBy("item_id")) - 1 + first).cast("bigint"))


def context_edges(train: DataFrame, history: int) -> DataFrame:
    """(source_item_id, target_item_id) for each of the last ``history`` positives, repeats included."""
    return train.select(F.explode(last(or_empty(F.col("positive_history_item_ids")), history)).alias("source_item_id"), "target_item_id")


def interaction_counts(train: DataFrame, history: int) -> DataFrame:
    """(item_id, target_count, source_count) for the whole universe; sources count self-edges too."""
    targets = train.groupBy(F.col("target_item_id").alias("item_id")).agg(F.count("*").alias("target_count"))
    sources = context_edges(train, history).groupBy(F.col("source_item_id").alias("item_id")).agg(F.count("*").alias("source_count"))
    out = item_universe(train).join(targets, "item_id", "left").join(sources, "item_id", "left")
    return out.select("item_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("target_count", "source_count")))


def context_projection(train: DataFrame, cfg: EmbeddingConfig) -> DataFrame:
    """(item_id, bucket, weight): signs of hashed sources summed by target and bucket, no self-edges."""
    edges = context_edges(train, cfg.history).where("source_item_id <> target_item_id")
    src = F.col("source_item_id")
    hashed = edges.select(F.col("target_item_id").alias("item_id"), bucket(src, cfg.components, cfg.seed).alias("bucket"), sign(src, cfg.seed).alias("s"))
    return hashed.groupBy("item_id", "bucket").agg(F.sum("s").alias("weight"))


def item_embeddings(train: DataFrame, cfg: EmbeddingConfig) -> DataFrame:
    """(item_idx, item_id, embedding): projection, scaled log counts and item order, of length 1."""
    dense = context_projection(train, cfg).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("w"))
    counts = item_index(interaction_counts(train, cfg.history))
    top = counts.agg(F.max(F.log1p("target_count")).alias("t"), F.max(F.log1p("source_count")).alias("s"), F.count("*").alias("n"))
    rows = counts.join(dense, "item_id", "left").crossJoin(F.broadcast(top))  # one row
    scaled = [F.when(F.col(m) > 0, F.log1p(c) / F.col(m)).otherwise(0.0) for c, m in (("target_count", "t"), ("source_count", "s"))]
    place = F.when(F.col("n") > 1, F.col("item_idx") / (F.col("n") - 1)).otherwise(0.0)
    weights = F.transform(F.sequence(F.lit(0), F.lit(cfg.components - 1)), lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0.0)))
    return rows.select("item_idx", "item_id", unit(F.concat(weights, F.array(*scaled, place))).alias("embedding"))


def vocabulary(codec: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(item_id, item_idx): encoder indices from 2 in item order, of the codec's items and, if
    training rows are given, of whole histories and targets."""
    items = codec.select("item_id")
    if train is not None:
        items = items.unionByName(train.select(F.explode(or_empty(F.col("history_item_ids"))).alias("item_id"))).unionByName(train.select(F.col("target_item_id").alias("item_id")))
    return item_index(items.distinct(), first=2)
