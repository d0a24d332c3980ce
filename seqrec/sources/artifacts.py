"""Stored models: the co-occurrence model and the prefix index, as folders of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqrec.config import KnnConfig
from seqrec.errors import InvalidArtifact
from seqrec.operators import trie

KNN_COLUMNS = ("source_item_id", "target_item_id", "pair_count", "candidate_rank")
KNN_FACTS = ("num_train_examples", "candidates", "history")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _load(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    if not _exists(spark, path):
        raise InvalidArtifact(f"no finished table at {path}")
    table = spark.read.parquet(path)
    missing = sorted(set(columns) - set(table.columns))
    if missing:
        raise InvalidArtifact(f"{path} lacks {', '.join(missing)}")
    return table.select(*columns)


def write_knn(neighbors: DataFrame, popularity: DataFrame, path: str, cfg: KnnConfig) -> None:
    """The neighbours, the ranking behind them and one row of facts, which is written last."""
    spark = neighbors.sparkSession
    neighbors.select(*KNN_COLUMNS).write.mode("overwrite").parquet(f"{path}/neighbors")
    popularity.select("item_id", "item_count", "item_rank").write.mode("overwrite").parquet(f"{path}/popularity")
    n = spark.read.parquet(f"{path}/popularity").agg(F.coalesce(F.sum("item_count"), F.lit(0)).alias("num_train_examples"))
    n.withColumns({"model": F.lit("item_knn"), "candidates": F.lit(cfg.candidates), "history": F.lit(cfg.history)}).write.mode("overwrite").parquet(f"{path}/facts")


def read_knn(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, KnnConfig]:
    """(neighbours, popularity, config) of write_knn(); anything missing or inconsistent is an error."""
    facts = _load(spark, f"{path}/facts", ("model", *KNN_FACTS)).take(2)
    if len(facts) != 1 or facts[0].model != "item_knn":
        raise InvalidArtifact("not a co-occurrence model")
    neighbors = _load(spark, f"{path}/neighbors", KNN_COLUMNS)
    popularity = _load(spark, f"{path}/popularity", ("item_id", "item_count", "item_rank"))
    most = facts[0].candidates
    if not neighbors.where(~(F.col("candidate_rank").between(1, most) & (F.col("pair_count") > 0))).isEmpty():
        raise InvalidArtifact("ranks or counts of neighbours are out of range")
    if popularity.agg(F.coalesce(F.sum("item_count"), F.lit(0))).first()[0] != facts[0].num_train_examples:
        raise InvalidArtifact("the ranking is not of the examples that the model names")
    return neighbors, popularity, KnnConfig(most, facts[0].history)


def write_index(codec: DataFrame, path: str) -> None:
    """The states and edges of ``codec``; edges are partitioned by level, as a beam reads them."""
    spark = codec.sparkSession
    trie.states(codec).write.mode("overwrite").parquet(f"{path}/states")
    nodes = spark.read.parquet(f"{path}/states")
    trie.edges(nodes).write.mode("overwrite").partitionBy("level").parquet(f"{path}/edges")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(states, edges) of write_index()."""
    nodes = _load(spark, f"{path}/states", ("level", "prefix", "is_terminal", "state"))
    return nodes, _load(spark, f"{path}/edges", ("level", "state", "token", "next_state"))


def check_index(nodes: DataFrame, links: DataFrame, codec: DataFrame) -> None:
    """Raises unless the index has every code of ``codec``, no other, and one edge to each state but the root."""
    ends = nodes.where("is_terminal").select(F.col("prefix").alias("semantic_id"))
    if not trie.not_in_index(codec, nodes).isEmpty():
        raise InvalidArtifact("the index lacks a code of the codec")
    if not ends.join(codec, "semantic_id", "left_anti").isEmpty():
        raise InvalidArtifact("the index has a code that the codec lacks")
    inner = nodes.where("level > 0").select(F.col("state").alias("next_state"))
    odd = inner.join(links.groupBy("next_state").agg(F.count("*").alias("n")), "next_state", "full").where("n is null or n <> 1")
    if not odd.isEmpty() or not links.join(inner, "next_state", "left_anti").isEmpty():
        raise InvalidArtifact("states and edges of the index do not fit")


def load_or_build_index(codec: DataFrame, path: str, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stored index of ``codec``, which is built and stored if absent; a stored one must fit."""
    spark = codec.sparkSession
    if rebuild or not (_exists(spark, f"{path}/states") and _exists(spark, f"{path}/edges")):
        write_index(codec, path)
    nodes, links = read_index(spark, path)
    check_index(nodes, links, codec)
    return nodes, links
