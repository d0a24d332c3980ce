import pytest
from pyspark.sql import functions as F

from seqrec import serving
from seqrec.config import KnnConfig
from seqrec.errors import InvalidArtifact
from seqrec.operators import baselines, beam, generative, trie
from seqrec.operators.scoring import HashScorer
from seqrec.sources import artifacts

TRAIN = "target_item_id long, positive_history_item_ids array<long>"


def test_knn_round_trip(spark, tmp_path):
    train = spark.createDataFrame([(2, [1]), (3, [1, 2]), (2, [3, 1]), (1, [])], TRAIN)
    cfg = KnnConfig(candidates=2, history=5)
    model, pop = baselines.neighbors(train, cfg), baselines.popularity(train)
    artifacts.write_knn(model, pop, str(tmp_path), cfg)
    got, ranking, read = artifacts.read_knn(spark, str(tmp_path))
    assert read == cfg and sorted(got.collect()) == sorted(model.select(*artifacts.KNN_COLUMNS).collect())
    assert sorted(ranking.collect()) == sorted(pop.select("item_id", "item_count", "item_rank").collect())
    model.drop("pair_count").write.mode("overwrite").parquet(f"{tmp_path}/neighbors")
    with pytest.raises(InvalidArtifact, match="pair_count"):
        artifacts.read_knn(spark, str(tmp_path))
    model.withColumn("candidate_rank", F.col("candidate_rank") + 2).write.mode("overwrite").parquet(f"{tmp_path}/neighbors")
    with pytest.raises(InvalidArtifact, match="out of range"):
        artifacts.read_knn(spark, str(tmp_path))
    with pytest.raises(InvalidArtifact):
        artifacts.read_knn(spark, f"{tmp_path}/nowhere")


def test_index_is_loaded_or_built(spark, tmp_path):
    codec = spark.createDataFrame([(1, [0, 1]), (2, [0, 2]), (3, [1, 0])], "item_id long, semantic_id array<int>")
    nodes, links = artifacts.load_or_build_index(codec, str(tmp_path))
    want = trie.states(codec)
    assert sorted(nodes.collect()) == sorted(want.select(*nodes.columns).collect())
    assert sorted(links.collect()) == sorted(trie.edges(want).collect())
    again = artifacts.load_or_build_index(codec, str(tmp_path))
    assert sorted(again[1].collect()) == sorted(links.collect())
    for other in (codec.where("item_id < 3"), codec.unionByName(codec.select(F.lit(9).cast("long").alias("item_id"), F.array(F.lit(4), F.lit(4)).alias("semantic_id")))):
        with pytest.raises(InvalidArtifact):
            artifacts.load_or_build_index(other, str(tmp_path))
    with pytest.raises(InvalidArtifact, match="do not fit"):
        artifacts.check_index(nodes, links.where("next_state <> 1"), codec)


def test_inference_histories(spark):
    vocab = spark.createDataFrame([(10, 2), (20, 3)], "item_id long, item_idx long")
    rows = spark.createDataFrame([(1, [10, 99, 20], None), (2, [], []), (3, None, None), (4, [10, 20], [1, 2])], "user_id long, history_item_ids array<long>, history_feedback_ids array<int>")
    got = {r.user_id: (r.encoder_ids, r.feedback_ids) for r in generative.inference_histories(rows, vocab, ["user_id"], 2).collect()}
    assert got == {1: ([1, 3], [3, 3]), 2: ([1], [3]), 3: ([1], [3]), 4: ([2, 3], [1, 2])}
    with pytest.raises(Exception, match="differ in length"):
        generative.inference_histories(rows.withColumn("history_feedback_ids", F.array(F.lit(1))), vocab, ["user_id"]).collect()


def test_widened_beam_leaves_k_items(spark):
    """A user who has seen the best codes still gets k items; an unknown user has an empty history."""
    codec = spark.createDataFrame([(i, [i // 4, i % 4]) for i in range(16)], "item_id long, semantic_id array<int>")
    links = trie.edges(trie.states(codec))
    users = spark.createDataFrame([(1,), (2,)], "query_id long")
    best = beam.beam_search(users, links, HashScorer(), 2, 4, 16).where("query_id = 1 and beam_rank <= 6").join(codec, "semantic_id")
    seen = best.groupBy("query_id").agg(F.collect_list("item_id").alias("history"))
    asked = generative.histories_of(users, seen)
    assert {r.query_id: len(r.history) for r in asked.collect()} == {1: 6, 2: 0}
    asked = asked.withColumn("width", generative.serving_width(F.col("history"), 3, 4))
    assert {r.query_id: r.width for r in asked.collect()} == {1: 10, 2: 4}
    beams = beam.beam_search(asked, links, HashScorer(), 2, 4, "width")
    kept = generative.recommend(beams, codec, asked, 4).where("status = 'kept'").groupBy("query_id").count()
    assert {r.query_id: r["count"] for r in kept.collect()} == {1: 4, 2: 4}


def test_lookup_refuses_and_falls_back(spark):
    rows = [(7, 1, 5, "T", [0, 1], 0.5), (0, 1, 6, "U", [0, 2], 0.4)]
    served = spark.createDataFrame(rows, "query_id long, rank long, item_id long, title string, semantic_id array<int>, score double")
    get = serving.lookup(served, most=2, anyone=0)
    assert [i["item_id"] for i in get(7, 2)["items"]] == [5] and [i["item_id"] for i in get(8, 2)["items"]] == [6]
    with pytest.raises(ValueError, match="at most 2"):
        get(7, 3)
