import math
import random
from fractions import Fraction

from linewarden.llm import topk
from pyspark.sql import functions as F


def brute(rows, k):
    known = [
        (i, [math.floor(64 * Fraction(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (q, v) in enumerate(known):
        if q % 20:
            continue
        products = [
            (x, sum(a * b for a, b in zip(v, w, strict=False)))
            for m, (x, w) in enumerate(known)
            if m != n
        ]
        scores = sorted((-min(max(s, topk.LOWEST), topk.HIGHEST), x) for x, s in products)
        out += [(q, r, x, -s) for r, (s, x) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k=topk.K):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 AS rank", "2 AS score")
    got = topk.top_k(topk.scaled(df, "vec_id", "embedding"), F.col("id") % 20 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def as_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [as_float(rng.gauss(0, 0.3)) for _ in range(9)]) for i in range(300)]
    # A common vector, ties, repeats, odd lengths and what takes no part.
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    rows += [rows[3], (20, [0.0] * 9), (2000, None), (2001, []), (2020, [0.5, None]), (None, [1.0]),
             (2040, [math.nan] * 9), (2041, [math.inf] * 9), (2042, [1.0, 2.0])]
    for size in ("QUERY_BLOCK", "ROW_BLOCK", "PART"):
        monkeypatch.setattr(topk, size, 64)
    assert found(spark, rows) == brute(rows, topk.K)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.25])]
    assert found(spark, rows) == brute(rows, topk.K)
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == []


def test_large_components_score_exactly(spark):
    """Beyond doubles, beyond 64 bits, and beyond any double when scaled."""
    rows = [(0, [1e8, 1.0]), (1, [5e6, 0.0]), (2, [5e6, as_float(0.1)]), (3, [-7e7, 3.0])]
    assert found(spark, rows) == brute(rows, topk.K)
    assert found(spark, rows)[1] == (0, 2, 1, 64 * 100_000_000 * 64 * 5_000_000)
    rows += [(20, [as_float(1e30), -1.0]), (21, [as_float(3e38), 2.0]), (40, [0.0, as_float(1e-30)])]
    assert found(spark, rows) == brute(rows, topk.K)
    many = topk._matrix([[1e307, -1.5], [0.5]], 2)
    assert many.tolist() == [[64 * int(1e307), -96], [32, 0]]


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 2.0]), (20, [3.0, -1.0]), (20, [3.0, -1.0]), (1, [0.5, 0.5]), (1, [2.0, 2.0]), (5, [])]
    got = found(spark, rows)
    assert got == brute(rows, topk.K)
    assert len([r for r in got if r[0] == 20]) == 3 * 5


def test_blocks_that_cannot_reach_the_cutoff_are_skipped(spark, monkeypatch):
    import pandas as pd

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)]
    rows += [(100 + i, [rng.gauss(0, 0.001) for _ in range(8)]) for i in range(400)]
    frame = pd.DataFrame({"id": [r[0] for r in rows], "row": range(len(rows)), "v": [r[1] for r in rows]})
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    queries = frame.iloc[:5].assign(cutoff=0)
    first = topk._meet(5, False)(queries, frame)
    cutoff = first.groupby("query_row")["score"].nlargest(5).groupby("query_row").min()
    seen = []
    products = topk._products
    monkeypatch.setattr(topk, "_products", lambda q, x: seen.append(len(x)) or products(q, x))
    best = topk._meet(5, True)(queries.assign(cutoff=cutoff.to_numpy()), frame)
    assert sum(seen) == 40 * topk.SLICES
    assert len(best) == 25
