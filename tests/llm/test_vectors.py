import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import negatives, topk, units
from logloom.llm.negatives import Lists, hard_negatives, window
from logloom.llm.topk import Cell, top_products

SCHEMA = "rid int, vec_id long, embedding array<double>, label int, kind string, cell int, far double"


def usable(rows):
    """(row, id, label, integers) of what takes part."""
    return [
        (at, i, label, [math.floor(256 * x) for x in v]) for at, (i, v, label) in enumerate(rows)
        if v is not None and None not in v and np.isfinite(v).all()
    ]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def first(scored, k):
    return sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:k]


@pytest.fixture(scope="module")
def odd():
    """Vectors with nulls, ties, copies, other lengths, nothing in them, and very large components."""
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in random.normal(size=6)], int(random.integers(0, 4))) for i in range(160)]
    same = rows[3][1]
    return rows + [
        (200 + i, same, 1) for i in range(12)
    ] + [
        (250, same, 1), (250, same, 1), (250, same, 2), (None, same, 1), (300, None, 1), (301, [math.nan] + same[1:], 1),
        (302, [None] + same[1:], 1), (303, [math.inf] + same[1:], 1), (304, same, None), (350, [], 1), (351, [], 2), (352, [], 1),
        (400, [1.0, 2.0], 0), (401, [0.5, 2.0], 0), (402, [1.0, 1.5], 3), (450, [0.0] * 6, 0), (500, [3e7] * 6, 2), (501, [-3e7] * 6, 2),
        (550, [1e200, 0, 0, 0, 0, 0], 3), (551, [1e200, 1, 0, 0, 0, 0], 3),
    ]


def table(spark, rows):
    return spark.createDataFrame([(0, i, v if v is None else [None if x is None else float(x) for x in v], label, "k", 5, 0.5) for i, v, label in rows], SCHEMA)


def test_highest_products_against_brute_force(spark, odd, values):
    rows = usable(odd)
    want = []
    for at, i, _, v in rows:
        if i is not None and i % 50 == 0:
            scored = [(units.as_long(dot(v, w)), j, other) for other, j, _, w in rows if other != at and len(w) == len(v)]
            want += [(i, rank, j, s) for rank, (s, j, _) in enumerate(first(scored, 5), 1)]
    got = top_products(table(spark, odd).repartition(3))
    assert values(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert top_products(table(spark, []).where("false")).count() == 0


def test_hard_negatives_against_brute_force(spark, odd, values):
    rows = [r for r in usable(odd) if r[2] is not None]
    want = []
    for at, i, label, v in rows:
        if i is None or i % 50:
            continue
        scored = [(units.as_long(dot(v, w)), j, other, tag) for other, j, tag, w in rows if other != at and len(w) == len(v)]
        for p, j, other, _ in first([s for s in scored if s[3] == label], 5):
            inside = [s for s in scored if s[3] != label and 50 * p <= 100 * s[0] <= 95 * p]
            want += [(i, j, rank, n, p, s) for rank, (s, n, *_) in enumerate(first(inside, 3), 1)]
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(want) > 30
    assert values(hard_negatives(table(spark, odd).repartition(3)), *columns) == sorted(want, key=repr)
    assert hard_negatives(table(spark, []).where("false")).count() == 0


def test_labels_of_any_type(spark, odd, values):
    rows = table(spark, odd)
    named = rows.selectExpr("vec_id", "embedding", "concat('label ', label) AS label")
    assert values(hard_negatives(named)) == values(hard_negatives(rows))


def test_several_units_agree_with_the_sql(spark, small, values, monkeypatch):
    """Small units make many cells, rings and lists of what is one unit else."""
    monkeypatch.setattr(topk, "UNIT", 60)
    monkeypatch.setattr(topk, "RING", 16)
    monkeypatch.setattr(negatives, "UNIT", 60)
    monkeypatch.setattr(negatives, "DEPTH", 4)
    monkeypatch.setattr(units, "COMPONENTS", 50 * 64)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    rows = spark.read.parquet(f"{small}/embeddings.parquet").repartition(3)
    got = top_products(rows).select("query_id", "rank", "vec_id", "score")
    assert values(got) == sorted(db.execute(topk.top_sql()).fetchall(), key=repr)
    moved = rows.selectExpr("vec_id", "embedding", "IF(vec_id % 7 = 0, (label + 1) % 10, label) AS label")
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    got = hard_negatives(moved).select(*columns.split(", "))
    want = db.execute(f"SELECT {columns} FROM ({negatives.negatives_sql()})").fetchall()
    assert values(got) == sorted(want, key=repr)


def unit_of(y, far, label=0):
    n = len(y)
    return pa.table({
        "rid": np.arange(n), "vec_id": pa.array(np.arange(n)), "dimension": pa.array([y.shape[1]] * n, pa.int32()),
        "far": far, "label": np.full(n, label), "y": pa.array(list(y), pa.list_(pa.float64())),
    })


def test_rings_beyond_the_bound_are_left_out():
    random = np.random.default_rng(3)
    y = np.concatenate([np.floor(random.normal(size=(500, 8)) * 20), np.floor(random.normal(size=(3000, 8)) * 20 + 400)])
    cell = Cell(unit_of(y, np.sqrt((y**2).sum(axis=1))))
    query = y[3000:3001]
    (found, scores), = cell.search(query, np.array([3000]), np.sqrt((query**2).sum(axis=1)), np.array([-np.inf]), 5)
    exact = y @ query[0]
    assert sorted(scores, reverse=True) == sorted(np.delete(exact, 3000), reverse=True)[:5]
    assert cell.visited < 3500


def test_lists_are_not_read_to_the_end():
    random = np.random.default_rng(5)
    y = np.floor(random.normal(size=(4000, 3)) * 50)
    y[:5] = 900, 900, -900
    lists = Lists(unit_of(y, np.zeros(4000)))
    anchor = np.array([[30.0, 30.0, -30.0]])
    (found, scores), = lists.search(anchor, np.ones((1, 4000), bool), [[(-np.inf, np.inf)]], 5)[0:1][0]
    assert sorted(found) == [0, 1, 2, 3, 4] and lists.read < 200


def test_windows_are_exact_integers():
    for score in (0, 1, 7, 100, 12345, 2**62):
        low, high = window(score, 50, 95)
        assert 50 * score <= 100 * low < 50 * score + 100 and 95 * score - 100 < 100 * high <= 95 * score
