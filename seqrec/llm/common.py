"""Shared helpers of the training-data operators: scratch tables, components, semi-joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, a laptop) a private one is made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        global _LOCAL
        if _LOCAL is None:
            _LOCAL = "file://" + tempfile.mkdtemp(prefix="seqrec-")
        base = _LOCAL
    return base.rstrip("/")


_LOCAL: str | None = None


def materialise(df: DataFrame, tag: str, distinct: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. distinct: its values hardly
    repeat, so no dictionaries of them are made.

    The returned frame has no lineage beyond that table, so a lost executor costs a reread only.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/seqrec/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", str(not distinct).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqrec_path = path
    return out


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about BATCH_BYTES in this session, unless it asks for smaller ones.

    A batch is held several times, by the executor and by each worker; a longer row is one batch.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release_heaps(spark: SparkSession) -> None:
    """Has executors collect their garbage, so that their JVMs return unused heap to the system.

    A heap that grew in shuffles else stays as large, beside the Python workers of the next stage.
    A task for each core, as tasks are dealt to all free cores at once. Results don't depend on it.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def discard(df: DataFrame | None) -> None:
    """Delete a table made by materialise() that nothing needs any more."""
    path = getattr(df, "_seqrec_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Up to so many ids (8 bytes each, about 64 MB in a hash relation) a semi-join may be broadcast.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi- or anti-join of wide ``rows`` with a one-column ``ids``, which must be cheap to count.

    The ids are broadcast if they were counted and are few; else both sides are shuffled.
    """
    few = ids.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star steps over the edge table, each pair of steps written to
    the shared folder, until the edges form stars. DataFrame operations only; a hub's neighbours
    are reduced to their minimum before the shuffle, and the join with that minimum is an ordinary
    equi-join that adaptive execution can split. Null ends and self-loops are ignored, except that
    a node with only a self-loop is its own component. An empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u").distinct()
    cur = materialise(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        stats = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if stats == before or not stats[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cur.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the edges of large-star run from each node to something smaller; small-star joins what they reach
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        nxt = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        discard(cur)
        cur, before = nxt, stats
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return out.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
