import random

import numpy as np
import pytest

from linewarden.llm import treap

ITEMS = "item_id long, text string"


def found(spark, df, items, k=treap.TOP):
    out = treap.search(treap.build(df), spark.createDataFrame(items, ITEMS), k)
    return sorted((tuple(r) for r in out.collect()), key=str)


def expected(rows, items, k=treap.TOP):
    return sorted(treap.brute_force([r[:2] for r in rows], items, k), key=str)


def random_rows(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Über", "naïve", "日本", "X1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [
        (i, rng.choice([" ", ", ", "--"]).join(rng.choices(words, weights, k=rng.randrange(90))), "en", "a")
        for i in range(n)
    ]


@pytest.mark.parametrize("block", [400, 5000, treap.BLOCK_BYTES])
def test_equals_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(treap, "BLOCK_BYTES", block)
    monkeypatch.setattr(treap, "WIDTH", 3)
    rows = random_rows(400, block)
    items = [(i, r[1][:80]) for i, r in enumerate(random_rows(12, 3))] + [(99, "nothing known")]
    for k in (1, 7):
        assert found(spark, docs(rows).repartition(3), items, k) == expected(rows, items, k)


def test_blocks_of_queries(spark, docs, monkeypatch):
    monkeypatch.setattr(treap, "QUERY_TERMS", 20)
    rows = random_rows(80, 1)
    items = [(i, r[1]) for i, r in enumerate(random_rows(15, 2))]
    assert found(spark, docs(rows), items, 5) == expected(rows, items, 5)


def test_ties_go_to_the_smaller_id(spark, docs):
    rows = [(i, "same words here" if i % 2 else "other text", "en", "a") for i in range(200)]
    rows.append((None, "same words here", "en", "a"))
    items = [(1, "same"), (2, "SAME here"), (2, "other"), (None, "words"), (3, None)]
    assert found(spark, docs(rows), items, 50) == expected(rows, items, 50)
    assert found(spark, docs(rows), items, 101) == expected(rows, items, 101)


def test_odd_rows(spark, docs, odd_rows):
    """Every row is a document, equal ones too."""
    df = docs(odd_rows, extra=("term", "score", "ids"))
    items = [(1, "alpha DELTA"), (2, "ünïcödé ワード"), (3, ""), (4, "word5 tail5"), (5, "Ünïcödé")]
    assert found(spark, df, items) == expected(odd_rows, items)


def test_empty_tables(spark, docs):
    assert found(spark, docs([]), [(1, "a")]) == []
    assert found(spark, docs([(1, "a", "en", "a")]), []) == []


def test_cells_hold_maxima():
    rng = np.random.default_rng(0)
    points = np.unique(rng.integers(0, 300, (500, 2)), axis=0)
    value = rng.integers(1, 1_000_000, len(points))
    cells = treap.Cells(**treap.grow(points[:, 0], points[:, 1], value))
    assert cells.most[0] == value.max()
    for (row, column), v in zip(points, value, strict=True):
        cell = np.zeros(1, np.int64)
        for level in range(cells.height):
            shift = cells.height - 1 - level
            child = np.array([2 * (row >> shift & 1) + (column >> shift & 1)])
            has, below = cells.below(cell, child)
            assert has[0] and cells.most[below[0]] <= cells.most[cell[0]]
            side = points >> shift == np.array([row, column]) >> shift
            assert cells.most[below[0]] == value[side.all(axis=1)].max()
            cell = below
        assert cells.most[cell[0]] == v
