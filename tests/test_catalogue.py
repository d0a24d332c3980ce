"""Every query of the catalogue against its SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqrec.plans import oracles, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(table):
    return sorted(repr([None if v is None or v != v else v for v in r]) for r in table)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = db.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows([r[c] for c in columns] for r in got.collect()) == rows([r[i] for i in order] for r in want.fetchall())


def test_pad_history_takes_every_train_row(spark):
    """All train rows at the length of 50, by hand from the split and the vocabulary."""
    from seqrec.operators import embedding

    index = {r.item_id: r.item_idx for r in embedding.vocabulary(queries._part_codec(spark, DIR)).collect()}
    want = []
    for r in queries._split(spark, DIR, "train").collect():
        n = len(r.history_item_ids)
        full = lambda x, pad: ",".join(map(str, [*x, *[pad] * (50 - n)]))
        want.append((r.user_id, r.target_timestamp, full((index.get(i, 1) for i in r.history_item_ids), 0), full(r.history_feedback_ids, 0), full([0] * n, 1)))
    assert max(len(r[4].split(",")) for r in want) == 50 and any("1" not in r[4] for r in want)
    got = queries.QUERIES["pad_history"](spark, DIR).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(oracles.ORACLE_SQL) <= set(entry.queries())
