"""Prefix index over Semantic IDs: states, edges and masks as tables.

One edge table serves what a trie, a compressed sparse matrix or a dense mask would: state 0 is the
root, other states are numbered by level and prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqrec.config import INVALID_STATE


def states(codes: DataFrame) -> DataFrame:
    """(state, level, prefix, is_terminal) for every prefix of the distinct ``semantic_id``s."""
    unique = codes.select("semantic_id").distinct()
    cut = unique.select("semantic_id", F.explode(F.sequence(F.lit(0), F.size("semantic_id"))).alias("level"))
    prefix = F.slice("semantic_id", F.lit(1), F.col("level"))
    rows = cut.select("level", prefix.alias("prefix"), (F.col("level") == F.size("semantic_id")).alias("end")).groupBy("level", "prefix").agg(F.max("end").alias("is_terminal"))
    return rows.withColumn("state", (F.row_number().over(Window.orderBy("level", "prefix")) - 1).cast("bigint"))  # item cardinality


def edges(nodes: DataFrame) -> DataFrame:
    """(level, state, token, next_state), level being the depth of ``state``."""
    child = nodes.where("level > 0").select((F.col("level") - 1).alias("level"), F.slice("prefix", F.lit(1), F.col("level") - 1).alias("prefix"), F.element_at("prefix", -1).alias("token"), F.col("state").alias("next_state"))
    return child.join(nodes.select("level", "prefix", "state"), ["level", "prefix"]).select("level", "state", "token", "next_state")


def allowed_tokens(links: DataFrame) -> DataFrame:
    """(state, tokens) for states with children, tokens in order."""
    return links.groupBy("state").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def next_states(asked: DataFrame, links: DataFrame) -> DataFrame:
    """``asked`` (state, token) with next_state, -1 where there is none."""
    return asked.join(links.select("state", "token", "next_state"), ["state", "token"], "left").withColumn("next_state", F.coalesce("next_state", F.lit(INVALID_STATE)))


def token_masks(nodes: DataFrame, links: DataFrame, vocab: int) -> DataFrame:
    """(state, mask): for every state an array<boolean> over the tokens 0..vocab-1."""
    tokens = nodes.select("state").join(allowed_tokens(links), "state", "left")
    mask = F.transform(F.sequence(F.lit(0), F.lit(vocab - 1)), lambda t: F.coalesce(F.array_contains("tokens", t), F.lit(False)))
    return tokens.select("state", mask.alias("mask"))


def widest(links: DataFrame) -> DataFrame:
    """(level, max_branches)."""
    return links.groupBy("level", "state").count().groupBy("level").agg(F.max("count").alias("max_branches"))


def contains(probes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``probes`` (prefix) with is_prefix and is_terminal."""
    known = nodes.select("prefix", F.lit(True).alias("is_prefix"), "is_terminal")
    return probes.join(known, "prefix", "left").select(*probes.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_prefix", "is_terminal")))


def dense_layers(depth: int, layers: int | None = None) -> int:
    """Levels that a dense lookup would serve: given, or at most two below the depth."""
    if depth < 2:
        raise ValueError("an index needs codes of two tokens at least")
    layers = min(2, depth - 1) if layers is None else layers
    if not 1 <= layers < depth:
        raise ValueError("dense layers lie between 1 and the depth")
    return layers


def not_in_index(codec: DataFrame, nodes: DataFrame) -> DataFrame:
    """Codec rows whose code is no terminal state; must be empty."""
    return codec.join(nodes.where("is_terminal").select(F.col("prefix").alias("semantic_id")), "semantic_id", "left_anti")
