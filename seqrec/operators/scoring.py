"""Scorers for constrained generation.

A scorer gives every beam the logits of all raw tokens 0..vocab-1 as one array column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


class Scorer(Protocol):
    def logits(self, beams: DataFrame, step: int, vocab: int) -> DataFrame:
        """``beams`` with the column logits (array<double> of vocab numbers)."""


class HashScorer:
    """Deterministic logits from query, prefix and token; for tests and benchmarks of the decoder."""

    def logits(self, beams: DataFrame, step: int, vocab: int) -> DataFrame:
        code = F.aggregate("prefix", F.lit(7).cast("bigint"), lambda a, x: (a * 31 + x + 1) % 1009)
        each = F.transform(F.sequence(F.lit(0), F.lit(vocab - 1)), lambda t: ((F.col("query_id") * 17 + code * 13 + t * 29) % 101) / 20.0)
        return beams.withColumn("logits", each)


class CountScorer:
    """ln(alpha + how often the items behind a prefix followed the query's history).

    The pair counts are rolled up along the codes of the targets; the join meets only prefixes that
    some history item leads to.
    """

    def __init__(self, histories: DataFrame, pairs: DataFrame, codec: DataFrame, alpha: float = 0.1) -> None:
        """histories: (query_id, history); pairs: (source_item_id, target_item_id, pair_count)."""
        votes = histories.select("query_id", F.explode("history").alias("source_item_id")).join(pairs, "source_item_id")
        votes = votes.groupBy("query_id", F.col("target_item_id").alias("item_id")).agg(F.sum("pair_count").alias("n")).join(codec, "item_id")
        cut = votes.select("query_id", "n", "semantic_id", F.explode(F.sequence(F.lit(0), F.size("semantic_id") - 1)).alias("level"))
        cut = cut.select("query_id", "n", F.slice("semantic_id", F.lit(1), F.col("level")).alias("prefix"), F.col("semantic_id")[F.col("level")].alias("token"))
        cut = cut.groupBy("query_id", "prefix", "token").agg(F.sum("n").alias("n"))
        self.votes = cut.groupBy("query_id", "prefix").agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("votes"))
        self.alpha = alpha

    def logits(self, beams: DataFrame, step: int, vocab: int) -> DataFrame:
        met = beams.join(self.votes, ["query_id", "prefix"], "left")
        each = F.transform(F.sequence(F.lit(0), F.lit(vocab - 1)), lambda t: F.log(F.coalesce(F.try_element_at("votes", t), F.lit(0)) + self.alpha))
        return met.withColumn("logits", each).drop("votes")


class ArrayScorer:
    """Any NumPy model: ``score(queries, prefixes, step) -> (beams, vocab)`` in Arrow batches."""

    def __init__(self, score) -> None:
        self.score = score

    def logits(self, beams: DataFrame, step: int, vocab: int) -> DataFrame:
        score = self.score

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = np.asarray(score(f["query_id"].to_numpy(), [list(p) for p in f["prefix"]], step), dtype=np.float64)
                if got.shape != (len(f), vocab):
                    raise ValueError(f"logits of shape {got.shape} for {len(f)} beams and {vocab} tokens")
                yield f.assign(logits=list(got))

        return beams.mapInPandas(run, StructType([*beams.schema.fields, StructField("logits", ArrayType(DoubleType()))]))
