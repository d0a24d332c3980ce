import pytest
from pyspark.sql import functions as F

from seqrec.config import SplitConfig
from seqrec.errors import MissingColumns
from seqrec.operators import sequences
from seqrec.sources import interactions


def ratings(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, timestamp long")


def split(df, cfg):
    rows = sequences.examples(sequences.add_feedback(df, cfg.positive, cfg.neutral), cfg).collect()
    return {s: sorted(((r.user_id, r.history_item_ids, r.history_feedback_ids, r.positive_history_item_ids, r.target_item_id, r.history_length) for r in rows if r.split == s), key=lambda x: (x[0], x[4])) for s in ("train", "valid", "test")}


def test_sorted_positions(spark):
    df = ratings(spark, [(2, 20, 4.0, 30), (1, 11, 4.0, 20), (2, 21, 4.0, 10), (1, 10, 4.0, 10)])
    got = sequences.positions(df).orderBy("user_id", "position").select("user_id", "item_id", "timestamp").collect()
    assert [tuple(r) for r in got] == [(1, 10, 10), (1, 11, 20), (2, 21, 10), (2, 20, 30)]


def test_feedback_and_filters(spark):
    df = ratings(spark, [(1, 10, 5.0, 1), (1, 11, 3.5, 2), (1, 12, 2.0, 3), (2, 13, float("nan"), 4), (2, 14, None, 5)])
    assert [r.feedback_id for r in sequences.add_feedback(df, 4.0, 3.0).orderBy("item_id").collect()] == [3, 2, 1, 1, 1]
    assert {r.item_id for r in sequences.min_rating(df, 3.5).where("not isnan(rating)").collect()} == {10, 11}
    assert {r.user_id for r in sequences.users_with(df, 3).collect()} == {1}
    with pytest.raises(ValueError):
        sequences.add_feedback(df, 3.0, 4.0)
    with pytest.raises(ValueError):
        sequences.users_with(df, 0)


def test_users_with_positives_keep_all_rows(spark):
    df = sequences.add_feedback(ratings(spark, [(1, 10, 5.0, 1), (1, 11, 2.0, 2), (1, 12, 4.0, 3), (2, 13, 5.0, 1), (2, 14, 2.0, 2), (2, 15, 2.0, 3)]), 4.0, 3.0)
    assert sorted(r.item_id for r in sequences.users_with(df, 2, positive_only=True).collect()) == [10, 11, 12]


def test_split(spark):
    rows = [(1, 10 + i, r, i + 1) for i, r in enumerate((4.0, 4.0, 5.0, 5.0, 4.0))] + [(2, 20, 5.0, 1), (2, 21, 5.0, 2)]
    got = split(ratings(spark, rows), SplitConfig(min_interactions=3, max_history=None))
    assert [(r[1], r[4]) for r in got["train"]] == [([10], 11), ([10, 11], 12)]
    assert [(r[1], r[4]) for r in got["valid"]] == [([10, 11, 12], 13)]
    assert [(r[1], r[4], r[5]) for r in got["test"]] == [([10, 11, 12, 13], 14, 4)]


def test_low_rating_stays_in_history(spark):
    rows = [(1, 10 + i, r, i + 1) for i, r in enumerate((4.0, 4.0, 2.0, 5.0, 4.0))]
    got = split(ratings(spark, rows), SplitConfig(min_interactions=3, max_history=None))
    assert [(r[1], r[4]) for r in got["train"]] == [([10], 11)]
    assert [r[1:5] for r in got["valid"]] == [([10, 11, 12], [3, 3, 1], [10, 11], 13)]
    assert got["test"][0][4] == 14


def test_truncation_and_three_items(spark):
    rows = [(1, 10 + i, 4.0, i + 1) for i in range(5)]
    got = split(ratings(spark, rows), SplitConfig(min_interactions=3, max_history=2))
    assert got["test"][0][1:6] == ([12, 13], [3, 3], [12, 13], 14, 2)
    got = split(ratings(spark, rows[:3]), SplitConfig(min_interactions=3, max_history=None))
    assert not got["train"] and [(r[1], r[4]) for r in got["valid"]] == [([10], 11)]


def test_statistics(spark):
    rows = [(1, 10 + i, r, i) for i, r in enumerate((5.0, 4.0, 2.0, 5.0, 4.0))] + [(2, 10, 5.0, 1), (2, 11, 4.0, 2), (2, 12, 1.0, 3)]
    got = {r.stage: (r.users, r["items"], r.n) for r in sequences.statistics(sequences.add_feedback(ratings(spark, rows), 4.0, 3.0), SplitConfig(min_interactions=3)).collect()}
    assert got == {"raw": (2, 5, 8), "positive": (2, 4, 6), "eligible": (1, 5, 5)}


def test_csv_and_missing_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n1,10,4.5,100\n")
    assert [tuple(r) for r in interactions.read_ratings(spark, str(tmp_path / "r.csv")).collect()] == [(1, 10, 4.5, 100)]
    with pytest.raises(MissingColumns):
        interactions.normalize(spark.createDataFrame([(1,)], "user_id long"))
    (tmp_path / "t.csv").write_text("movieId,title,genres\n1,Old,x\n1,New,x\n2,B,y\n")
    assert {r.item_id: r.title for r in interactions.read_titles(spark, str(tmp_path / "t.csv")).collect()} == {1: "New", 2: "B"}


def test_latest_history_and_split_table(spark, tmp_path):
    rows = spark.createDataFrame([(123, 1, [1000], [3]), (123, 2, [1000, 1001], [3, 3])], "user_id long, target_timestamp long, history_item_ids array<long>, history_feedback_ids array<long>")
    assert sequences.latest_history(rows).first().history_item_ids == [1000, 1001]
    interactions.write_splits(rows.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert interactions.read_split(spark, str(tmp_path / "s"), "train").count() == 2


def test_config():
    with pytest.raises(ValueError):
        SplitConfig(min_interactions=2)
