import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrec.config import ClusterConfig, EmbeddingConfig, KnnConfig
from seqrec.errors import DuplicateCode, InvalidCodec
from seqrec.functions import arrays, ranking
from seqrec.operators import baselines, beam, embedding, generative, semantic_ids, trie
from seqrec.operators.scoring import ArrayScorer
from seqrec.sources import interactions


def train(spark, rows):
    return spark.createDataFrame([(h, h, t) for h, t in rows], "history_item_ids array<long>, positive_history_item_ids array<long>, target_item_id long")


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def test_popularity(spark):
    model = baselines.popularity(train(spark, [([], t) for t in (20, 10, 20, 30, 10, 20, 10)]))
    assert [tuple(r) for r in model.orderBy("item_rank").collect()] == [(10, 3, 1), (20, 3, 2), (30, 1, 3)]
    asked = spark.createDataFrame([(1, [10])], "query_id long, seen array<long>")
    assert lists(baselines.popular_unseen(asked, model, 2)) == {1: [20, 30]}
    back = interactions.load_popularity_json(spark, interactions.popularity_json(model))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, model.collect()))
    with pytest.raises(ValueError):
        interactions.load_popularity_json(spark, '{"model": "other", "items": []}')


def neighbors(df):
    out = {}
    for r in df.orderBy("source_item_id", "candidate_rank").collect():
        out.setdefault(r.source_item_id, {})[r.target_item_id] = r.pair_count
    return out


def test_neighbors(spark):
    rows = train(spark, [([1, 2], 10), ([1], 10), ([2], 20), ([1, 3], 20)])
    got = neighbors(baselines.neighbors(rows, KnnConfig(20, 50)))
    assert got[1] == {10: 2, 20: 1} and got[2] == {10: 1, 20: 1}
    rows = train(spark, [([1, 2, 3], 10), ([1, 1], 20)])
    assert neighbors(baselines.neighbors(rows, KnnConfig(20, 1))) == {1: {20: 1}, 3: {10: 1}}


def test_knn_scores_and_fallback(spark):
    model = spark.createDataFrame([(1, 10, 3, 1), (1, 20, 1, 2), (2, 20, 5, 1), (2, 30, 1, 2)], "source_item_id long, target_item_id long, pair_count long, candidate_rank long")
    pop = spark.createDataFrame([(10, 2, 1), (20, 1, 2)], "item_id long, item_count long, item_rank long")
    asked = spark.createDataFrame([(1, [1, 2]), (2, [10]), (3, [2, 2, 1])], "query_id long, history array<long>")
    got = lists(baselines.knn_recommend(asked, model, pop, 3))
    assert got == {1: [20, 10, 30], 2: [20], 3: [20, 10, 30]}


@pytest.mark.parametrize(
    "metric, rec, rel, k, want",
    [
        (ranking.recall, [1, 1, 3], [1, 2], 3, 0.5),
        (ranking.recall, [1], [], 3, 0.0),
        (ranking.ndcg, [3, 2, 1], [1, 2], 3, (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))),
        (ranking.ndcg, [1, 1, 2], [1, 2], 3, (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))),
        (ranking.reciprocal_rank, [4, 5, 2], [2], None, 1 / 3),
        (ranking.reciprocal_rank, [4, 5, 2], [2], 2, 0.0),
    ],
)
def test_metrics(spark, metric, rec, rel, k, want):
    df = spark.createDataFrame([(rec, rel)], "rec array<long>, relevant array<long>")
    assert df.select(metric(F.col("rec"), F.col("relevant"), k)).first()[0] == pytest.approx(want)


def test_mean_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3], [2]), ([3, 4, 5], [6])], "rec array<long>, relevant array<long>")
    r = ranking.mean_metrics(df, (2,)).first()
    assert (r.recall, r.ndcg, r.mrr) == pytest.approx((0.5, 1 / math.log2(3) / 2, 0.25))
    r = ranking.mean_metrics(df.limit(0), (2,)).first()
    assert (r.n_queries, r.recall) == (0, 0.0)


def test_embedding(spark):
    rows = train(spark, [([1, 2], 3), ([2, 3], 4), ([4], 5)])
    assert embedding.context_edges(rows, 50).count() == 5
    assert embedding.context_edges(train(spark, [([1, 2, 3], 4)]), 1).count() == 1
    got = embedding.item_embeddings(rows, EmbeddingConfig(components=2)).orderBy("item_idx").collect()
    assert [r.item_id for r in got] == [1, 2, 3, 4, 5]
    assert all(len(r.embedding) == 5 and np.linalg.norm(r.embedding) == pytest.approx(1) or not any(r.embedding) for r in got)


def test_hash_is_that_of_unsigned_words(spark):
    ids = [0, 1, 7, 123456789, 10**12]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    got = [tuple(r) for r in df.select("i", arrays.bucket(F.col("i"), 33, 42), arrays.sign(F.col("i"), 42)).orderBy("i").collect()]
    want = [(i, ((i * 11400714819323198485 + 42 + 0x9E3779B1) % 2**64) % 33, 1.0 if ((i * 14029467366897019727 + 42 + 0x85EBCA6B) % 2**64) & 1 == 0 else -1.0) for i in ids]
    assert got == want


@pytest.mark.parametrize("same", [False, True])
def test_clusters(spark, same):
    points = [(k, [1.0, 1.0] if same else [float(k % 2), float(k // 2)]) for k in range(4)]
    df = spark.createDataFrame(points, "item_id long, embedding array<double>")
    codes = [tuple(r.semantic_id) for r in semantic_ids.codes_from_clusters(df, ClusterConfig(2, 2, restarts=2)).collect()]
    assert len(set(codes)) == 4 and all(len(c) == 2 and set(c) <= {0, 1} for c in codes)
    with pytest.raises(InvalidCodec):
        semantic_ids.codes_from_clusters(df, ClusterConfig(1, 2))


def test_clusters_are_those_of_each_node_at_every_size(spark, monkeypatch):
    """Blobs in blobs, 5 levels at branching 3: levels of several nodes give the same codes dealt out as locally."""
    rng = np.random.default_rng(5)
    tops = rng.normal(size=(3, 4)) * 50
    points = [(i, [float(v) for v in tops[i % 3] + rng.normal(size=4) * (1 + i % 2)]) for i in range(200)]
    df = spark.createDataFrame(points, "item_id long, embedding array<double>").repartition(3)
    cfg = ClusterConfig(5, 3, restarts=3, iterations=20)
    codes = lambda: {r.item_id: tuple(r.semantic_id) for r in semantic_ids.codes_from_clusters(df, cfg).collect()}
    local = codes()
    monkeypatch.setattr(semantic_ids, "LOCAL_ITEMS", 20)
    assert codes() == local and len(set(local.values())) == 200


def codec(spark, rows):
    return spark.createDataFrame(list(rows.items()), "item_id long, semantic_id array<int>")


def test_codec(spark, tmp_path):
    good = codec(spark, {2959: [12, 4, 81, 7], 4993: [12, 5, 10, 3]})
    semantic_ids.validate_codec(good)
    interactions.write_codec_json(good, str(tmp_path / "c.json"))
    assert sorted(map(tuple, [(r.item_id, tuple(r.semantic_id)) for r in interactions.read_codec_json(spark, str(tmp_path / "c.json")).collect()])) == [(2959, (12, 4, 81, 7)), (4993, (12, 5, 10, 3))]
    bad = codec(spark, {1: [1, 2, 3], 2: [1, 2, 3], 3: [3, 2, 1]})
    assert [(r.semantic_id, r.item_ids) for r in semantic_ids.duplicate_codes(bad).collect()] == [([1, 2, 3], [1, 2])]
    with pytest.raises(DuplicateCode):
        semantic_ids.validate_codec(bad)
    with pytest.raises(InvalidCodec):
        semantic_ids.validate_codec(codec(spark, {1: [1, 2], 2: [1]}))


def test_trie(spark):
    nodes = trie.states(codec(spark, {1: [1, 2, 3], 2: [1, 2, 4], 3: [1, 5, 6], 4: [7, 8]}))
    links = trie.edges(nodes)
    prefix = {r.state: tuple(r.prefix) for r in nodes.collect()}
    allowed = {prefix[r.state]: r.tokens for r in trie.allowed_tokens(links).collect()}
    assert allowed == {(): [1, 7], (1,): [2, 5], (1, 2): [3, 4], (1, 5): [6], (7,): [8]}
    asked = spark.createDataFrame([(0, 1), (0, 9), (99, 1)], "state long, token int")
    assert {(r.state, r.token): r.next_state >= 0 for r in trie.next_states(asked, links).collect()} == {(0, 1): True, (0, 9): False, (99, 1): False}
    probes = spark.createDataFrame([([1, 2],), ([7, 8],), ([8],)], "prefix array<int>")
    assert {tuple(r.prefix): (r.is_prefix, r.is_terminal) for r in trie.contains(probes, nodes).collect()} == {(1, 2): (True, False), (7, 8): (True, True), (8,): (False, False)}
    assert trie.not_in_index(codec(spark, {1: [1, 2, 9]}), nodes).count() == 1
    with pytest.raises(ValueError):
        trie.dense_layers(1)


def test_beams_stay_in_catalogue(spark):
    items = codec(spark, {1: [1, 2, 3], 2: [1, 2, 4], 3: [5, 6, 7]})
    boost = {0: [1], 1: [2], 2: [4, 3]}

    def score(queries, prefixes, step):
        x = np.zeros((len(prefixes), 10))
        x[:, 9] = 20.0  # never allowed
        for k, t in enumerate(boost[step]):
            x[:, t] = 5.0 - k
        return x

    asked = spark.createDataFrame([(1,)], "query_id long")
    links = trie.edges(trie.states(items))
    for masked in (False, True):
        got = beam.beam_search(asked, links, ArrayScorer(score), 3, 10, 3, masked).orderBy("beam_rank").collect()
        assert [r.semantic_id for r in got] == [[1, 2, 4], [1, 2, 3], [5, 6, 7]]
    # by hand: masked softmax of the best path
    want = -math.log(1 + math.exp(-5)) - 0 - math.log(1 + math.exp(-1))
    assert got[0].log_score == pytest.approx(want)


def test_recommend_counts(spark):
    beams = spark.createDataFrame([(1, 1, [0, 1], 0.9), (1, 2, [9, 9], 0.8), (1, 3, [1, 2], 0.7), (1, 4, [2, 3], 0.6), (1, 5, [2, 4], 0.5)], "query_id long, beam_rank long, semantic_id array<int>, score double")
    items = codec(spark, {20: [0, 1], 30: [1, 2], 40: [2, 3], 50: [2, 4]})
    past = spark.createDataFrame([(1, [20])], "query_id long, history array<long>")
    got = generative.recommend(beams, items, past, 2)
    assert [(r.beam_rank, r.status) for r in got.orderBy("beam_rank").collect()] == [(1, "history"), (2, "invalid"), (3, "kept"), (4, "kept"), (5, "unread")]
    c = generative.counters(got, past).first()
    assert (c.generated, c.invalid, c.history_filtered, c.avg_recommendations) == (5, 1, 1, 2.0)


def test_coverage(spark):
    targets = spark.createDataFrame([(k, t) for k, t in enumerate((999, 20, 998, 30, 40))], "k long, target_item_id long")
    items = codec(spark, {20: [0], 30: [1], 40: [2]})
    r = generative.coverage(targets, items, ("k",), known_limit=2).first()
    assert (r.total, r.known, r.unknown) == (4, 2, 2)
    r = generative.coverage(targets.where("target_item_id <> 998"), items).first()
    assert (r.total, r.known, r.unknown_rate) == (4, 3, 0.25)


def test_padding(spark):
    df = spark.createDataFrame([([5], [3]), ([5, 6], [3, 3])], "encoder_ids array<long>, feedback_ids array<long>")
    got = generative.batches(df, 4).orderBy(F.size("encoder_ids")).collect()
    assert [r.padding_mask for r in got] == [[False, True, True, True], [False, False, True, True]]
    assert [r.padded_feedback for r in got] == [[3, 0, 0, 0], [3, 3, 0, 0]]
    target = spark.createDataFrame([([0, 1, 2],)], "s array<int>").select(arrays.target_tokens(F.col("s")).alias("t")).select("t", arrays.shifted(F.col("t")).alias("d")).first()
    assert (target.t, target.d) == ([2, 3, 4], [1, 2, 3])
