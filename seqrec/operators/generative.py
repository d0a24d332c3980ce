"""Training inputs, recommendation by generation, its evaluation and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqrec.config import ITEM_UNKNOWN, POSITIVE
from seqrec.functions.arrays import checked_feedback, last, or_empty, padded, padding_mask, shifted, target_tokens


def coverage(targets: DataFrame, codec: DataFrame, order: tuple[str, ...] = (), known_limit: int | None = None) -> DataFrame:
    """(total, known, unknown, unknown_rate) of target_item_id; with a limit, of the rows in
    ``order`` until so many known targets have been met."""
    rows = targets.join(codec.select(F.col("item_id").alias("target_item_id"), F.lit(1).alias("hit")), "target_item_id", "left").withColumn("known", F.coalesce("hit", F.lit(0)))
    if known_limit is not None:
        upto = F.sum("known").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("met", upto - F.col("known")).where(F.col("met") < known_limit)
    n, k = F.count("*"), F.coalesce(F.sum("known"), F.lit(0))
    return rows.agg(n.alias("total"), k.cast("bigint").alias("known"), (n - k).cast("bigint").alias("unknown"), F.when(n > 0, (n - k) / n).otherwise(0.0).alias("unknown_rate"))


def encode_histories(rows: DataFrame, vocab: DataFrame, keys: list[str], history: int = 50) -> DataFrame:
    """``keys`` with encoder_ids and feedback_ids: indices of the last items (1 where unknown), in order."""
    cut = rows.select(*keys, F.arrays_zip(last(or_empty(F.col("history_item_ids")), history).alias("i"), last(or_empty(F.col("history_feedback_ids")), history).alias("f")).alias("h"))
    flat = cut.select(*keys, F.posexplode("h").alias("p", "x")).select(*keys, "p", F.col("x.i").alias("item_id"), F.col("x.f").alias("f"))
    met = flat.join(vocab, "item_id", "left").select(*keys, F.struct("p", F.coalesce("item_idx", F.lit(ITEM_UNKNOWN)).cast("bigint").alias("i"), "f").alias("s"))
    back = met.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("s"))
    out = cut.select(*keys).join(back, keys, "left")
    return out.select(*keys, or_empty(F.transform("s", lambda x: x["i"])).alias("encoder_ids"), or_empty(F.transform("s", lambda x: x["f"])).alias("feedback_ids"))


def inference_histories(rows: DataFrame, vocab: DataFrame, keys: list[str], history: int = 50) -> DataFrame:
    """As encode_histories(), for a model that is asked: without feedback every item is positive, and
    an empty or null history is one unknown, positive item."""
    ids = or_empty(F.col("history_item_ids"))
    given = F.col("history_feedback_ids") if "history_feedback_ids" in rows.columns else F.lit(None)
    positive = F.transform(ids, lambda x: F.lit(POSITIVE))
    rows = rows.select(*keys, ids.alias("history_item_ids"), F.coalesce(given.cast("array<int>"), positive).alias("history_feedback_ids"))
    same = F.when(F.size("history_item_ids") == F.size("history_feedback_ids"), F.col("history_feedback_ids")).otherwise(F.raise_error(F.lit("history and feedback differ in length")).cast("array<int>"))
    out = encode_histories(rows.withColumn("history_feedback_ids", same), vocab, keys, history)
    filled = ((c, F.when(F.size("encoder_ids") == 0, F.array(F.lit(one).cast("bigint"))).otherwise(F.col(c).cast("array<bigint>"))) for c, one in (("feedback_ids", POSITIVE), ("encoder_ids", ITEM_UNKNOWN)))
    return out.withColumns(dict(filled))


def histories_of(users: DataFrame, histories: DataFrame) -> DataFrame:
    """(query_id, history) of ``users`` (query_id); a user without a row in ``histories`` has an empty one."""
    known = histories.select("query_id", "history")
    return users.select("query_id").join(known, "query_id", "left").withColumn("history", or_empty(F.col("history")))


def serving_width(history: Column, beam: int, k: int) -> Column:
    """The beam that leaves ``k`` codes even if all distinct items of ``history`` are generated."""
    return F.greatest(F.lit(beam), F.lit(k) + F.size(F.array_distinct(or_empty(history))))


def encode_targets(rows: DataFrame, codec: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with target_tokens and decoder_input; rows whose target has no code are dropped."""
    met = rows.join(codec.select(F.col("item_id").alias("target_item_id"), "semantic_id"), "target_item_id")
    tokens = target_tokens(F.col("semantic_id"))
    return met.select(*keys, tokens.alias("target_tokens")).withColumn("decoder_input", shifted(F.col("target_tokens")))


def batches(histories: DataFrame, length: int) -> DataFrame:
    """``histories`` with item ids and feedback padded to ``length`` and the padding mask."""
    ids, fb = F.col("encoder_ids"), checked_feedback(F.col("feedback_ids"))
    same = F.when(F.size(ids) == F.size("feedback_ids"), ids).otherwise(F.raise_error(F.lit("history and feedback differ in length")))
    return histories.withColumns({"padded_ids": padded(same, length), "padded_feedback": padded(fb, length), "padding_mask": padding_mask(ids, length)})


def recommend(beams: DataFrame, codec: DataFrame, histories: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, item_id, beam_rank, semantic_id, score) and, on the same rows of beams, why
    others are left out: status is kept, invalid, history, duplicate, or unread behind the k-th kept.

    histories: (query_id, history)."""
    items = beams.join(codec, "semantic_id", "left").join(histories.select("query_id", "history"), "query_id", "left")
    seen = F.coalesce(F.array_contains("history", F.col("item_id")), F.lit(False))
    items = items.withColumn("status", F.when(F.col("item_id").isNull(), "invalid").when(seen, "history"))
    first = F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("beam_rank"))
    items = items.withColumn("status", F.coalesce("status", F.when(first > 1, "duplicate"), F.lit("kept")))
    kept = F.sum((F.col("status") == "kept").cast("int")).over(Window.partitionBy("query_id").orderBy("beam_rank"))
    items = items.withColumn("kept", kept)
    over = (F.col("kept") > k) | ((F.col("kept") == k) & (F.col("status") != "kept"))
    items = items.withColumn("status", F.when(over, "unread").otherwise(F.col("status")))
    return items.select("query_id", F.when(F.col("status") == "kept", F.col("kept")).cast("bigint").alias("rank"), "item_id", "beam_rank", "semantic_id", "score", "status")


def counters(read: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries, generated and invalid sequences, items dropped as history or duplicates,
    recommendations for a query, rate of invalid sequences."""
    n = queries.agg(F.count("*").alias("n_queries"))
    c = read.agg(F.count("*").alias("generated"), *(F.coalesce(F.sum((F.col("status") == s).cast("bigint")), F.lit(0)).alias(s) for s in ("invalid", "history", "duplicate", "kept")))
    both = c.crossJoin(F.broadcast(n))  # one row each
    return both.select("n_queries", "generated", "invalid", F.col("history").alias("history_filtered"), F.col("duplicate").alias("duplicates"), (F.col("kept") / F.greatest("n_queries", F.lit(1))).alias("avg_recommendations"), F.when(F.col("generated") > 0, F.col("invalid") / F.col("generated")).otherwise(0.0).alias("invalid_rate"))


def teacher_forcing(scored: DataFrame) -> DataFrame:
    """(examples, tokens, loss, token_accuracy, sequence_accuracy) from rows of an example's steps:
    (example_id, token, logits). Rows with token null are padding and do not count."""
    from seqrec.functions.arrays import log_sum_exp

    real = scored.where("token is not null")
    step = real.select("example_id", (log_sum_exp(F.col("logits")) - F.col("logits")[F.col("token")]).alias("ce"), (F.array_position("logits", F.array_max("logits")) - 1 == F.col("token")).cast("int").alias("hit"))
    each = step.groupBy("example_id").agg(F.sum("ce").alias("ce"), F.count("*").alias("n"), F.sum("hit").alias("hits"))
    return each.agg(F.count("*").alias("examples"), F.sum("n").alias("tokens"), (F.sum("ce") / F.sum("n")).alias("loss"), (F.sum("hits") / F.sum("n")).alias("token_accuracy"), F.avg((F.col("hits") == F.col("n")).cast("int")).alias("sequence_accuracy"))


def missing_titles(codec: DataFrame, titles: DataFrame) -> DataFrame:
    return codec.select("item_id").join(titles, "item_id", "left_anti")


def serving_table(recommended: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, rank, item_id, title, semantic_id, score): what a request would return."""
    return recommended.where("status = 'kept'").join(titles, "item_id").select("query_id", "rank", "item_id", "title", "semantic_id", F.round("score", 6).alias("score"))


def responses(served: DataFrame, model: str = "generative", decoder: str = "prefix_index") -> DataFrame:
    """(query_id, response): a JSON document for each user."""
    item = F.struct("rank", "item_id", "title", "semantic_id", "score")
    lists = served.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("items"))
    return lists.select("query_id", F.to_json(F.struct(F.col("query_id").alias("user_id"), F.lit(model).alias("model"), F.lit(decoder).alias("decoder"), "items")).alias("response"))


def latency_summary(times: DataFrame, column: str) -> DataFrame:
    """(n, mean, p50, p95, max, per_second) of latencies in milliseconds."""
    return times.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"), F.max(column).alias("max"), (1000.0 * F.count(column) / F.sum(column)).alias("per_second"))
