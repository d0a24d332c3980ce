"""The query catalogue over the driver's tables; oracles.py has the SQL under the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqrec.config import POSITIVE, ClusterConfig, EmbeddingConfig, KnnConfig, SplitConfig
from seqrec.functions import arrays as A, ranking
from seqrec.operators import baselines, beam, embedding, generative, semantic_ids, sequences, trie
from seqrec.operators.scoring import CountScorer, HashScorer
from seqrec.sources.interactions import events_as_ratings

SPLIT = SplitConfig(min_interactions=5, max_history=50, positive=40.0, neutral=15.0)
KNN = KnnConfig(candidates=20, history=50)
EMBED = EmbeddingConfig(components=8, history=50, seed=42)
CODES = ClusterConfig(depth=3, branching=5)
BEAM, TOP = 10, 5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return sequences.add_feedback(events_as_ratings(spark, d), SPLIT.positive, SPLIT.neutral)


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return sequences.examples(_rated(spark, d), SPLIT)


def _split(spark: SparkSession, d: str, name: str) -> DataFrame:
    return _examples(spark, d).where(F.col("split") == name).drop("split")


def _text(df: DataFrame) -> DataFrame:
    """Array columns as text."""
    return df.select(*(A.joined(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


def _part_codec(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the items that events name, from their order."""
    return semantic_ids.codes_from_order(events_as_ratings(spark, d).select("item_id").distinct(), CODES)


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = trie.states(_part_codec(spark, d))
    return nodes, trie.edges(nodes)


def _queries(spark: SparkSession, d: str, history: str = "history_item_ids") -> DataFrame:
    test = _split(spark, d, "test")
    return test.select(F.col("user_id").alias("query_id"), F.col(history).alias("history"), F.array("target_item_id").alias("relevant"))


@query
def normalize_interactions(spark: SparkSession, d: str) -> DataFrame:
    return events_as_ratings(spark, d)


@query
def feedback_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d)


@query
def filter_min_rating(spark: SparkSession, d: str) -> DataFrame:
    return sequences.min_rating(events_as_ratings(spark, d), 40.0)


@query
def users_min_interactions(spark: SparkSession, d: str) -> DataFrame:
    return sequences.users_with(events_as_ratings(spark, d), 65)


@query
def users_min_positive(spark: SparkSession, d: str) -> DataFrame:
    return sequences.users_with(_rated(spark, d), 28, positive_only=True)


@query
def sort_interactions_rank(spark: SparkSession, d: str) -> DataFrame:
    return sequences.positions(events_as_ratings(spark, d))


@query
def split_train(spark: SparkSession, d: str) -> DataFrame:
    return _text(_split(spark, d, "train"))


@query
def split_valid(spark: SparkSession, d: str) -> DataFrame:
    return _text(_split(spark, d, "valid"))


@query
def split_test(spark: SparkSession, d: str) -> DataFrame:
    return _text(_split(spark, d, "test"))


@query
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum("history_length").alias("history_items"))


@query
def preprocess_stats(spark: SparkSession, d: str) -> DataFrame:
    return sequences.statistics(_rated(spark, d), SPLIT)


@query
def popularity_rank(spark: SparkSession, d: str) -> DataFrame:
    return baselines.popularity(_split(spark, d, "train"))


@query
def popularity_topk(spark: SparkSession, d: str) -> DataFrame:
    return baselines.popular_unseen(_queries(spark, d), baselines.popularity(_split(spark, d, "train")), 20, seen="history")


def _metrics(rec: DataFrame, asked: DataFrame, cutoffs: tuple[int, ...] = (10, 20)) -> DataFrame:
    m = ranking.mean_metrics(baselines.as_lists(rec, asked), cutoffs)
    return m.select(F.col("k").cast("bigint").alias("k"), "n_queries", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")))


@query
def popularity_metrics(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d)
    return _metrics(baselines.popular_unseen(asked, baselines.popularity(_split(spark, d, "train")), 20, seen="history"), asked)


@query
def cooccur_pairs(spark: SparkSession, d: str) -> DataFrame:
    return baselines.pair_counts(_split(spark, d, "train"), KNN.history)


@query
def knn_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return baselines.neighbors(_split(spark, d, "train"), KNN)


def _knn(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    asked, train = _queries(spark, d, "positive_history_item_ids"), _split(spark, d, "train")
    return baselines.knn_recommend(asked, baselines.neighbors(train, KNN), baselines.popularity(train), k, KNN.history), asked


@query
def knn_recommend(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, 20)[0]


@query
def knn_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(*_knn(spark, d, 20))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the last 12 items as a ranking (with repeats), its positives before them as relevant."""
    rows = _split(spark, d, "valid")
    return rows.select("user_id", A.last(F.col("history_item_ids"), 12).alias("rec"), A.last(F.col("positive_history_item_ids"), 6).alias("relevant"))


@query
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).select("user_id", F.round(ranking.recall(F.col("rec"), F.col("relevant"), 10), 6).alias("recall"))


@query
def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).select("user_id", F.round(ranking.ndcg(F.col("rec"), F.col("relevant"), 10), 6).alias("ndcg"))


@query
def mrr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).select("user_id", F.round(ranking.reciprocal_rank(F.col("rec"), F.col("relevant"), 10), 6).alias("mrr"))


@query
def metrics_multi_relevant(spark: SparkSession, d: str) -> DataFrame:
    m = ranking.mean_metrics(_listed(spark, d), (5, 10))
    return m.select(F.col("k").cast("bigint").alias("k"), "n_queries", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")))


@query
def item_universe(spark: SparkSession, d: str) -> DataFrame:
    return embedding.item_index(embedding.item_universe(_split(spark, d, "train")))


@query
def item_vocab(spark: SparkSession, d: str) -> DataFrame:
    return embedding.vocabulary(_part_codec(spark, d), _split(spark, d, "train"))


@query
def target_coverage(spark: SparkSession, d: str) -> DataFrame:
    return generative.coverage(_split(spark, d, "test"), _part_codec(spark, d)).withColumn("unknown_rate", F.round("unknown_rate", 6))


@query
def target_coverage_limited(spark: SparkSession, d: str) -> DataFrame:
    return generative.coverage(_split(spark, d, "test"), _part_codec(spark, d), order=("user_id",), known_limit=9).withColumn("unknown_rate", F.round("unknown_rate", 6))


@query
def hash_bucket_sign(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", A.bucket(i, 32, 42).cast("bigint").alias("bucket"), A.sign(i, 42).alias("sign"))


@query
def item_source_target_counts(spark: SparkSession, d: str) -> DataFrame:
    return embedding.interaction_counts(_split(spark, d, "train"), EMBED.history)


@query
def context_projection(spark: SparkSession, d: str) -> DataFrame:
    return embedding.context_projection(_split(spark, d, "train"), EMBED).select("item_id", F.col("bucket").cast("bigint").alias("bucket"), "weight")


@query
def item_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = embedding.item_embeddings(_split(spark, d, "train"), EMBED)
    return rows.select("item_idx", "item_id", F.posexplode("embedding").alias("component", "x")).select("item_idx", "item_id", F.col("component").cast("bigint").alias("component"), (F.round("x", 6) + 0.0).alias("x"))


@query
def encode_history(spark: SparkSession, d: str) -> DataFrame:
    rows = _split(spark, d, "test")
    return _text(generative.encode_histories(rows, embedding.vocabulary(_part_codec(spark, d)), ["user_id"], history=10))


@query
def inference_history(spark: SparkSession, d: str) -> DataFrame:
    """The positives alone, without feedback: some users have none."""
    rows = _split(spark, d, "test").select("user_id", F.col("positive_history_item_ids").alias("history_item_ids"))
    return _text(generative.inference_histories(rows, embedding.vocabulary(_part_codec(spark, d)), ["user_id"], history=10))


@query
def encode_target(spark: SparkSession, d: str) -> DataFrame:
    return _text(generative.encode_targets(_split(spark, d, "test"), _part_codec(spark, d), ["user_id"]))


@query
def decoder_input_shift(spark: SparkSession, d: str) -> DataFrame:
    codes = _part_codec(spark, d)
    return _text(codes.select("item_id", A.shifted(A.target_tokens(F.col("semantic_id"))).alias("decoder_input")))


@query
def pad_history(spark: SparkSession, d: str) -> DataFrame:
    rows = generative.encode_histories(_split(spark, d, "train"), embedding.vocabulary(_part_codec(spark, d)), ["user_id", "target_timestamp"], SPLIT.max_history)
    out = generative.batches(rows, SPLIT.max_history).withColumn("padding_mask", F.transform("padding_mask", lambda x: x.cast("int")))
    return _text(out.select("user_id", "target_timestamp", "padded_ids", "padded_feedback", "padding_mask"))


@query
def semantic_ids_from_order(spark: SparkSession, d: str) -> DataFrame:
    return _text(_part_codec(spark, d))


@query
def semantic_ids_kmeans(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    depth = next(k for k in range(1, 20) if 16**k >= n)
    return semantic_ids.codes_from_clusters(rows, ClusterConfig(depth=depth, branching=16, restarts=2, iterations=30))


@query
def codec_encode(spark: SparkSession, d: str) -> DataFrame:
    items = _split(spark, d, "test").select("user_id", F.col("target_item_id").alias("item_id"))
    return _text(semantic_ids.encode(items, _part_codec(spark, d), strict=False))


@query
def codec_decode(spark: SparkSession, d: str) -> DataFrame:
    codes = _part_codec(spark, d).select("semantic_id")
    return _text(semantic_ids.decode(codes, _part_codec(spark, d), strict=False)).withColumn("item_id", F.coalesce("item_id", F.lit(-1)))


@query
def codec_duplicates(spark: SparkSession, d: str) -> DataFrame:
    short = _part_codec(spark, d).select("item_id", F.slice("semantic_id", 1, 2).alias("semantic_id"))
    return _text(semantic_ids.duplicate_codes(short))


@query
def codec_validate(spark: SparkSession, d: str) -> DataFrame:
    s = semantic_ids.codec_summary(_part_codec(spark, d))
    return s.select(*(F.col(c).cast("bigint").alias(c) for c in s.columns))


@query
def semantic_vocab_size(spark: SparkSession, d: str) -> DataFrame:
    return semantic_ids.vocab_size(_part_codec(spark, d))


@query
def trie_states(spark: SparkSession, d: str) -> DataFrame:
    return _text(_index(spark, d)[0]).withColumn("level", F.col("level").cast("bigint"))


@query
def trie_edges(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)[1].select(F.col("level").cast("bigint").alias("level"), "state", F.col("token").cast("bigint").alias("token"), "next_state")


@query
def allowed_next_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _text(trie.allowed_tokens(_index(spark, d)[1]))


@query
def batch_next_state(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = _index(spark, d)
    asked = nodes.select("state", F.explode(F.sequence(F.lit(0), F.lit(CODES.branching))).alias("token"))
    return trie.next_states(asked, links).withColumn("token", F.col("token").cast("bigint"))


@query
def allowed_token_mask(spark: SparkSession, d: str) -> DataFrame:
    masks = trie.token_masks(*_index(spark, d), vocab=CODES.branching)
    return _text(masks.withColumn("mask", F.transform("mask", lambda x: x.cast("int"))))


@query
def layer_max_branches(spark: SparkSession, d: str) -> DataFrame:
    return trie.widest(_index(spark, d)[1]).select(F.col("level").cast("bigint").alias("level"), "max_branches")


@query
def index_contains(spark: SparkSession, d: str) -> DataFrame:
    probes = _part_codec(spark, d).select("item_id", F.explode(F.array(F.slice("semantic_id", 1, 2), F.col("semantic_id"))).alias("prefix"))
    return _text(trie.contains(probes, _index(spark, d)[0]))


@query
def mask_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Rows in which masks from edges and from codes differ: none, so the count is 0 by level."""
    nodes, links = _index(spark, d)
    from_edges = links.join(nodes.select("state", "prefix"), "state").select("prefix", "token")
    from_codes = _part_codec(spark, d).select("semantic_id", F.explode(F.sequence(F.lit(0), F.lit(CODES.depth - 1))).alias("level"))
    from_codes = from_codes.select(F.slice("semantic_id", F.lit(1), F.col("level")).alias("prefix"), F.col("semantic_id")[F.col("level")].alias("token")).distinct()
    both = from_edges.withColumn("a", F.lit(1)).join(from_codes.withColumn("b", F.lit(1)), ["prefix", "token"], "full")
    return both.groupBy(F.size("prefix").cast("bigint").alias("level")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("a").isNull() | F.col("b").isNull(), 1).otherwise(0)).alias("differences"))


@query
def synthetic_semantic_ids(spark: SparkSession, d: str) -> DataFrame:
    return _text(semantic_ids.synthetic_codes(spark, 500, 4, 7, seed=3))


@query
def log_softmax(spark: SparkSession, d: str) -> DataFrame:
    users = _queries(spark, d).select("query_id", F.array().cast("array<int>").alias("prefix"))
    scored = HashScorer().logits(users, 0, CODES.branching)
    return scored.select("query_id", F.posexplode(A.log_softmax(F.col("logits"))).alias("token", "x")).select("query_id", F.col("token").cast("bigint").alias("token"), F.round("x", 6).alias("log_p"))


def _beams(spark: SparkSession, d: str, masked: bool, scorer: HashScorer | CountScorer | None = None) -> DataFrame:
    links = _index(spark, d)[1]
    return beam.beam_search(_queries(spark, d).select("query_id"), links, scorer or HashScorer(), CODES.depth, CODES.branching, BEAM, masked)


def _shown(beams: DataFrame) -> DataFrame:
    return _text(beams.select("query_id", "beam_rank", "semantic_id", F.round("log_score", 6).alias("log_score")))


@query
def beam_search_full_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_beams(spark, d, masked=False))


@query
def beam_search_masked_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_beams(spark, d, masked=True))


def _generated(spark: SparkSession, d: str) -> DataFrame:
    return generative.recommend(_beams(spark, d, masked=False), _part_codec(spark, d), _queries(spark, d), TOP)


@query
def generative_recommend(spark: SparkSession, d: str) -> DataFrame:
    return _generated(spark, d).select("query_id", "beam_rank", F.coalesce("item_id", F.lit(-1)).alias("item_id"), "status")


@query
def generative_ranking_eval(spark: SparkSession, d: str) -> DataFrame:
    kept = _generated(spark, d).where("status = 'kept'").select("query_id", "rank", "item_id")
    return _metrics(kept, _queries(spark, d), (2, TOP))


@query
def generation_counters(spark: SparkSession, d: str) -> DataFrame:
    c = generative.counters(_generated(spark, d), _queries(spark, d))
    return c.withColumns({x: F.round(x, 6) for x in ("avg_recommendations", "invalid_rate")})


@query
def count_scorer_recommend(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d)
    scorer = CountScorer(asked, baselines.pair_counts(_split(spark, d, "train"), KNN.history), _part_codec(spark, d))
    found = generative.recommend(_beams(spark, d, False, scorer), _part_codec(spark, d), asked, TOP)
    return found.where("status = 'kept'").select("query_id", "rank", "item_id", F.round("score", 6).alias("score"))


@query
def teacher_forcing_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = generative.encode_targets(_split(spark, d, "test"), _part_codec(spark, d), ["user_id"])
    steps = rows.select(F.col("user_id").alias("query_id"), "target_tokens", F.posexplode("target_tokens").alias("step", "t"))
    steps = steps.withColumn("prefix", F.transform(F.slice("target_tokens", F.lit(1), F.col("step")), lambda x: x - 2))
    scored = HashScorer().logits(steps, 0, CODES.branching).select(F.col("query_id").alias("example_id"), (F.col("t") - 2).alias("token"), "logits")
    m = generative.teacher_forcing(scored)
    return m.select("examples", "tokens", *(F.round(c, 6).alias(c) for c in ("loss", "token_accuracy", "sequence_accuracy")))


@query
def latest_user_history(spark: SparkSession, d: str) -> DataFrame:
    rows = _examples(spark, d).select("user_id", "target_timestamp", "history_item_ids", "history_feedback_ids")
    return _text(sequences.latest_history(rows))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


@query
def serving_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return _text(generative.serving_table(_generated(spark, d), _titles(spark, d))).drop("score")


@query
def serving_widened_beam(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d).withColumn("width", generative.serving_width(F.col("history"), BEAM, TOP))
    beams = beam.beam_search(asked, _index(spark, d)[1], HashScorer(), CODES.depth, CODES.branching, "width")
    found = generative.recommend(beams, _part_codec(spark, d), asked, TOP)
    return generative.serving_table(found, _titles(spark, d)).select("query_id", "rank", "item_id", "title")


@query
def missing_titles(spark: SparkSession, d: str) -> DataFrame:
    return generative.missing_titles(_part_codec(spark, d), _titles(spark, d))


@query
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    times = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") + 0.5).alias("ms"))
    s = generative.latency_summary(times, "ms")
    return s.select("n", *(F.round(c, 6).alias(c) for c in s.columns[1:]))
