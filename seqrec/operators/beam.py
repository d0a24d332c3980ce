"""Constrained beam search for all queries at once: one join, one softmax and one top-k for a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqrec.functions.arrays import log_sum_exp
from seqrec.operators.scoring import Scorer


def beam_search(queries: DataFrame, links: DataFrame, scorer: Scorer, depth: int, vocab: int, beam: int | str, masked: bool = False, keep: int | None = None) -> DataFrame:
    """(query_id, beam_rank, semantic_id, score, log_score) of each query's best codes.

    masked: logits are normalised over a state's children only; else over the whole vocabulary,
    children being selected afterwards. Scores that are not finite never enter the top. The search
    stays inside the index, so every code is in the catalogue. Ties go to the smaller prefix. beam is
    a number for all queries or the column of ``queries`` with a number for each.
    """
    width = F.lit(beam) if isinstance(beam, int) else F.col(beam)
    beams = queries.select("query_id", width.cast("int").alias("width"), F.array().cast("array<int>").alias("prefix"), F.lit(0).cast("bigint").alias("state"), F.lit(0.0).alias("log_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("log_score", 9)), "prefix")
    for step in range(depth):
        level = links.where(F.col("level") == step)
        scored = scorer.logits(beams, step, vocab).withColumn("beam_id", F.struct("query_id", "prefix"))
        if not masked:
            scored = scored.withColumn("z", log_sum_exp(F.col("logits")))
        met = scored.join(level.select("state", "token", "next_state"), "state").withColumn("logit", F.col("logits")[F.col("token")])
        if masked:
            top = F.max("logit").over(Window.partitionBy("query_id", "prefix"))
            met = met.withColumn("top", top)
            met = met.withColumn("z", F.col("top") + F.log(F.sum(F.exp(F.col("logit") - F.col("top"))).over(Window.partitionBy("query_id", "prefix"))))
        met = met.select("query_id", "width", F.concat("prefix", F.array("token")).alias("prefix"), F.col("next_state").alias("state"), (F.col("log_score") + F.col("logit") - F.col("z")).alias("log_score"))
        met = met.where(~F.isnan("log_score") & (F.abs("log_score") < float("inf")))
        beams = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("width")).drop("r")
    rank = F.row_number().over(order).cast("bigint")
    out = beams.select("query_id", rank.alias("beam_rank"), F.col("prefix").alias("semantic_id"), F.exp(F.col("log_score") / depth).alias("score"), "log_score")
    return out.where(F.col("beam_rank") <= keep) if keep is not None else out
