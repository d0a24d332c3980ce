"""From interactions to training sequences: tiers, user filters, leave-last-two split, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqrec.config import POSITIVE, SplitConfig
from seqrec.functions.arrays import feedback, or_empty

ORDER = ("timestamp", "item_id", "rating")


def add_feedback(df: DataFrame, positive: float, neutral: float) -> DataFrame:
    if neutral > positive:
        raise ValueError("the neutral rating is above the positive one")
    return df.withColumn("feedback_id", feedback(F.col("rating"), positive, neutral))


def min_rating(df: DataFrame, least: float) -> DataFrame:
    if least < 0:
        raise ValueError("the least rating is negative")
    return df.where(F.col("rating") >= least)


def users_with(df: DataFrame, n: int, positive_only: bool = False) -> DataFrame:
    """All rows of the users with at least ``n`` (positive) interactions.

    The users are counted with partial aggregation and joined back, so no user's rows are gathered.
    """
    if n < 1:
        raise ValueError("at least one interaction must be asked for")
    counted = df.where(F.col("feedback_id") == POSITIVE) if positive_only else df
    users = counted.groupBy("user_id").count().where(F.col("count") >= n).select("user_id")
    return df.join(users, "user_id", "left_semi")


def positions(df: DataFrame) -> DataFrame:
    """Each user's interactions numbered from 0 in time; ties by item, then rating."""
    return df.withColumn("position", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("bigint"))


def examples(rated: DataFrame, cfg: SplitConfig) -> DataFrame:
    """Sequence examples with their split: a user's last positive tests, the one before validates,
    earlier ones train unless they come first of all. One shuffle by user serves every window.

    The positive history is what is positive inside the truncated history.
    """
    user = Window.partitionBy("user_id").orderBy(*ORDER)
    hit = (F.col("feedback_id") == POSITIVE).cast("int")
    past = user.rowsBetween(Window.unboundedPreceding if cfg.max_history is None else -cfg.max_history, -1)
    rows = rated.select(
        "user_id",
        "item_id",
        "timestamp",
        "feedback_id",
        (F.row_number().over(user) - 1).alias("position"),
        F.sum(hit).over(user.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum(hit).over(Window.partitionBy("user_id")).alias("total"),
        F.collect_list(F.struct("item_id", "feedback_id")).over(past).alias("history"),
    )
    rows = rows.where((F.col("feedback_id") == POSITIVE) & (F.col("total") >= max(3, cfg.min_interactions)))
    later = F.col("total") - F.col("upto")
    split = F.when(later == 0, "test").when(later == 1, "valid").when(F.col("position") > 0, "train")
    ids = F.transform("history", lambda x: x["item_id"])
    return rows.select(
        split.alias("split"),
        "user_id",
        ids.alias("history_item_ids"),
        F.transform("history", lambda x: x["feedback_id"].cast("bigint")).alias("history_feedback_ids"),
        or_empty(F.transform(F.filter("history", lambda x: x["feedback_id"] == POSITIVE), lambda x: x["item_id"])).alias("positive_history_item_ids"),
        F.col("item_id").alias("target_item_id"),
        F.col("timestamp").alias("target_timestamp"),
        F.size("history").cast("bigint").alias("history_length"),
    ).where("split is not null")


def statistics(rated: DataFrame, cfg: SplitConfig) -> DataFrame:
    """(stage, users, items, n) of the raw, positive and eligible interactions, in two passes."""
    eligible = rated.join(rated.where(F.col("feedback_id") == POSITIVE).groupBy("user_id").count().where(F.col("count") >= cfg.min_interactions).select("user_id", F.lit(True).alias("eligible")), "user_id", "left")
    stages = {"raw": F.lit(True), "positive": F.col("feedback_id") == POSITIVE, "eligible": F.col("eligible")}
    one = eligible.agg(*(f(F.when(c, F.col(v))).alias(f"{k}_{n}") for k, c in stages.items() for n, v, f in (("users", "user_id", F.countDistinct), ("items", "item_id", F.countDistinct), ("n", "user_id", F.count))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), *(F.col(f"{k}_{n}").alias(n) for n in ("users", "items", "n"))) for k in stages)))
    return one.select(rows.alias("s")).select("s.*")


def latest_history(rows: DataFrame) -> DataFrame:
    """Each user's history of the greatest target_timestamp."""
    last = F.max_by(F.struct("history_item_ids", "history_feedback_ids"), F.struct("target_timestamp", F.size("history_item_ids")))
    return rows.groupBy("user_id").agg(last.alias("h"), F.max("target_timestamp").alias("target_timestamp")).select("user_id", "target_timestamp", "h.*")
