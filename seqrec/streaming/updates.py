"""Structured Streaming upkeep of popularity and recent histories from an interaction stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def popularity_stream(stream: DataFrame, window: str = "1 day", late: str = "2 hours", time_col: str = "event_time") -> DataFrame:
    """(window, item_id, item_count) of an interaction stream, closed by the watermark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), "item_id").agg(F.count("*").alias("item_count"))


def start_history_table(stream: DataFrame, path: str, checkpoint: str, history: int = 50) -> StreamingQuery:
    """Keeps each micro-batch's last ``history`` items of its users as Parquet under ``path``.

    Every batch writes its own folder by its number, so a batch that is run again replaces itself;
    readers take the greatest timestamps over all batches with recent_histories().
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("user_id").agg(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("timestamp", "item_id")))), 1, history).alias("recent"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_histories(table: DataFrame, history: int = 50) -> DataFrame:
    """(user_id, history_item_ids) in order of time from a table of start_history_table()."""
    all_recent = table.groupBy("user_id").agg(F.slice(F.reverse(F.sort_array(F.flatten(F.collect_list("recent")))), 1, history).alias("r"))
    return all_recent.select("user_id", F.reverse(F.transform("r", lambda x: x["item_id"])).alias("history_item_ids"))
