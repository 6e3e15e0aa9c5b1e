"""Exact top-k inner products by a three-phase uniform threshold.

A vector is cut into ``SLICES`` runs of components, whose partial products are the lists
of the threshold algorithm.

1. Every part of the rows gathers, per query and slice, the k entries of the highest
   partial products among its rows of the largest norms. Their full scores give a safe cutoff:
   the k-th best of some rows cannot exceed the k-th best of all.
2. The cutoff goes back to all parts with the queries. A row that reaches it must reach
   ``cutoff / SLICES`` in some slice, so the entries that do so are sufficient. A block
   of rows whose norms rule that out in every slice is not multiplied at all.
3. Only for these entries the remaining partial products are resolved, exactly, and the k
   best are kept.

Queries meet rows in blocks: each part of the rows receives the queries a block at a time,
so no task holds all queries or all rows. Products are exact: in doubles where every sum is
below 2^53, in 64 bit integers below 2^63, else in integers of any size.

Defined results: a vector that is null or has a null or non-finite component takes no part,
nor does a null id; an empty vector scores 0 with any other, and shorter vectors are
continued by zeros. Each row is a candidate and, if its id is asked for, a query of its own,
rows with the same id too. A score beyond a long counts as the nearest long. Ties go to the
smaller id. An empty table gives no rows. Only
the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewarden.llm.common import ship_package, stored

K = 20
SCALE = 64
SLICES = 2
QUERY_BLOCK = 2048
ROW_BLOCK = 1024
#: Rows of one part, which meets one block of queries in one task.
PART = 1 << 14
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and v: the components, as doubles, of every vector that takes part."""
    x = "cast(x as double)"
    good = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs({x}) < double('Infinity'))"
    return (
        rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector))
        .where(f"id IS NOT NULL AND {vector} IS NOT NULL AND {good}")
        .select("id", F.expr(f"transform({vector}, x -> {x})").alias("v"))
    )


def _matrix(vectors: list, width: int) -> np.ndarray:
    """floor(64 * x) of every component: doubles that are whole, or integers of any size."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        many = np.floor(SCALE * out)
    if np.isfinite(many).all():
        return many
    # Beyond 2^1018 a double has no fraction, so the product is exact in integers.
    exact = [
        [int(m) if np.isfinite(m) else SCALE * int(x) for m, x in zip(ms, xs, strict=True)]
        for ms, xs in zip(many, out, strict=True)
    ]
    return np.array(exact, object).reshape(out.shape)


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products, in the cheapest numbers that hold every sum."""
    most = int(abs(q).max(initial=0)) * int(abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return np.matmul(q.astype(float), x.astype(float).T).astype(np.int64)
    if most < 1 << 62:
        return np.matmul(q.astype(np.int64), x.astype(np.int64).T)
    return np.dot(_integers(q), _integers(x).T)


def _norms(x: np.ndarray) -> np.ndarray:
    """At least the length of each row."""
    with np.errstate(over="ignore"):
        return np.sqrt((x.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    some = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    # The complement falls as a score rises, also for the lowest long.
    return some[np.lexsort((ids[some], ~scores[some]))][:k]


def _meet(k: int, bounded: bool):
    """Entries of one part of the rows for one block of queries."""

    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "vec_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        width = max(max(map(len, left["v"])), max(map(len, right["v"])))
        cuts = [width * s // SLICES for s in range(SLICES + 1)]
        q_rows = left["row"].to_numpy()
        q = _matrix(left["v"].tolist(), width)
        need = left["cutoff"].to_numpy() if bounded else None
        slices = list(zip(cuts, cuts[1:], strict=False))
        q_norms = np.stack([_norms(q[:, a:b]) for a, b in slices])
        # Blocks of like norms: a phase begins with the largest.
        size = [np.linalg.norm(np.asarray(v, float) / 2.0**500) for v in right["v"]]
        right = right.iloc[np.argsort(-np.array(size), kind="stable")]
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for start in range(0, len(right) if bounded else 1, ROW_BLOCK):
            part = right.iloc[start : start + ROW_BLOCK]
            ids, rows = part["id"].to_numpy(), part["row"].to_numpy()
            x = _matrix(part["v"].tolist(), width)
            asked = np.arange(len(q))
            if bounded:
                # By Cauchy and Schwarz no partial product exceeds the norms' product.
                most = np.stack([_norms(x[:, a:b]).max() for a, b in slices])
                with np.errstate(over="ignore", invalid="ignore"):
                    low = q_norms * most[:, None] * SLICES < need
                asked = np.flatnonzero(~low.all(axis=0))
                if not len(asked):
                    continue
            partial = [_products(q[asked, a:b], x[:, a:b]) for a, b in slices]
            for n, i in enumerate(asked):
                if bounded:
                    # partial * SLICES >= cutoff in some slice; only these are resolved.
                    # Without a cutoff all are.
                    at_least = -(-int(need[i]) // SLICES)
                    enough = (partial[0][n] >= at_least) | (need[i] == LOWEST)
                    for p in partial[1:]:
                        enough = enough | (p[n] >= at_least)
                    some = np.flatnonzero(enough)
                else:
                    tops = [_best(ids, p[n], k + 1) for p in partial]
                    some = np.unique(np.concatenate(tops))
                some = some[rows[some] != q_rows[i]]
                if not len(some):
                    continue
                whole = sum(p[n, some].astype(object) for p in partial)
                scores = np.array([min(max(int(s), LOWEST), HIGHEST) for s in whole], np.int64)
                got = ids[some]
                if i in held:
                    got = np.concatenate((held[i][0], got))
                    scores = np.concatenate((held[i][1], scores))
                best = _best(got, scores, k)
                held[i] = got[best], scores[best]
        sizes = [len(held[i][0]) for i in held]
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame(
            {
                "query_row": np.repeat(q_rows[list(held)], sizes),
                "query_id": np.repeat(left["id"].to_numpy()[list(held)], sizes),
                "vec_id": np.concatenate([held[i][0] for i in held] or none),
                "score": np.concatenate([held[i][1] for i in held] or none),
            }
        )

    return of


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` has id and v; ``is_query`` is a condition on id."""
    ship_package(vectors.sparkSession)
    # A number for every row of the stored table, as ids may repeat.
    rows = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_rows, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, parts = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // PART))
    queries = rows.where(is_query).withColumn(
        "block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    )
    # Names of its own, as both sides of the meeting come from the same rows.
    own = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    placed = own.withColumn(
        "part", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(parts)).cast("int")
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    all_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    schema = "query_row long, query_id long, vec_id long, score long"

    def met(asked: DataFrame, bounded: bool) -> DataFrame:
        left = asked.withColumn("part", all_parts).groupBy("block", "part")
        right = placed.groupBy("block", "part")
        return left.cogroup(right).applyInPandas(_meet(k, bounded), schema)

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    first = met(queries, bounded=False).withColumn("rank", F.row_number().over(order))
    # With fewer than k entries any score may still be among the best.
    safe = first.where(F.col("rank") == k).select("query_row", F.col("score").alias("cutoff"))
    cutoffs = stored(safe, "cutoffs")
    asked = queries.join(cutoffs, F.col("row") == F.col("query_row"), "left").select(
        "row", "id", "v", "block", F.coalesce("cutoff", F.lit(LOWEST)).alias("cutoff")
    )
    best = met(asked, bounded=True).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
