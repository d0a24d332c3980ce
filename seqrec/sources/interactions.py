"""Scans and sinks: ratings files, driver tables, splits, models as tables or JSON."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqrec.errors import MissingColumns

RATINGS = "userId BIGINT, movieId BIGINT, rating DOUBLE, timestamp BIGINT"
RENAMES = {"userId": "user_id", "movieId": "item_id"}
CORE = {"user_id": "bigint", "item_id": "bigint", "rating": "double", "timestamp": "bigint"}


def require_columns(df: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def normalize(ratings: DataFrame) -> DataFrame:
    """The four core columns, renamed and cast; others are dropped."""
    renamed = ratings.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in ratings.columns})
    return require_columns(renamed, list(CORE)).select(*(F.col(c).cast(t).alias(c) for c, t in CORE.items()))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return normalize(spark.read.schema(RATINGS).option("header", True).csv(path))


def read_titles(spark: SparkSession, path: str, id_col: str = "movieId", title_col: str = "title") -> DataFrame:
    """(item_id, title) of a titles file; of repeated ids the greatest line of the file wins."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, [id_col, title_col])
    rows = raw.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(title_col).alias("title"), F.monotonically_increasing_id().alias("line"))
    return rows.groupBy("item_id").agg(F.max_by("title", "line").alias("title"))


def events_as_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as interactions: item from props.k, rating from value, time in microseconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    item = F.get_json_object("props", "$.k")
    return normalize(events.select("user_id", item.alias("item_id"), F.col("value").alias("rating"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp")))


def write_splits(examples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One table partitioned by split, so that reading one split prunes the others."""
    examples.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def popularity_json(popularity: DataFrame) -> str:
    """The popularity model as a JSON document (item cardinality)."""
    row = popularity.agg(F.sort_array(F.collect_list(F.struct("item_rank", "item_id", "item_count"))).alias("items"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("n"))
    doc = row.select(F.to_json(F.struct(F.lit("popularity").alias("model"), F.col("n").alias("num_train_examples"), F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), x["item_count"].alias("count"), x["item_rank"].alias("rank"))).alias("items"))))
    return doc.first()[0]


def load_popularity_json(spark: SparkSession, text: str) -> DataFrame:
    schema = "model string, num_train_examples bigint, items array<struct<item_id: bigint, count: bigint, rank: bigint>>"
    doc = spark.range(1).select(F.from_json(F.lit(text), schema).alias("d"))
    if doc.select("d.model").first()[0] != "popularity":
        raise ValueError("not a popularity model")
    return doc.select(F.explode("d.items").alias("x")).select(F.col("x.item_id").alias("item_id"), F.col("x.count").alias("item_count"), F.col("x.rank").alias("item_rank"))


def write_codec_json(codec: DataFrame, path: str) -> None:
    """The codec as one JSON file with its version, length and mappings in item order."""
    body = codec.agg(F.sort_array(F.collect_list(F.struct("item_id", "semantic_id"))).alias("mappings"))
    doc = body.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.size(F.col("mappings")[0]["semantic_id"]).alias("semantic_id_length"), F.size("mappings").alias("num_items"), "mappings")))
    Path(path).write_text(doc.first()[0], encoding="utf-8")


def read_codec_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "schema_version int, semantic_id_length int, num_items bigint, mappings array<struct<item_id: bigint, semantic_id: array<int>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    head = doc.select("schema_version", "semantic_id_length", F.size("mappings").alias("n"), F.exists("mappings", lambda m: F.size(m["semantic_id"]) != F.col("semantic_id_length")).alias("odd")).first()
    if head is None or head.schema_version != 1 or head.odd or not head.n:
        raise ValueError("not a valid codec file")
    return doc.select(F.explode("mappings").alias("m")).select("m.item_id", "m.semantic_id")
