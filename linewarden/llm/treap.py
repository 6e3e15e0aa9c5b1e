"""Ranked search of documents by words, over a K2-treap of terms and documents.

An index row covers a block of documents (about ``BLOCK_BYTES`` of text). Its terms, in the order of
their first occurrence, and its documents span a square grid; a point is a term of a document,
its value the impact ``1e9 tf div (1000 tf + 20 m)``. The grid is a quadtree of which only cells
with points are kept: a mask of four children per cell and the difference between its largest
impact and its parent's, level by level.

A query descends the rows of all its terms jointly. A range of documents is bounded by the
sum, over its terms, of weight times the largest impact of the cell that holds the term's
row and that range; the best ranges of every query are halved first (``WIDTH`` at a time, for
``TOGETHER`` queries at once), and those below the k-th score so far are never opened. At a
single document the bound is its score. Weights are not part of the index: they
come from document frequencies, which the index holds per block.

Queries go in blocks of about ``QUERY_TERMS`` terms, each of which meets every index row;
nothing of the index is exchanged, only k rows per query and task.

Defined results: a null text has no terms; a document without terms counts nowhere; repeated
rows, and rows with a null id, are documents of their own; among equal scores null ids are last.
Items that share an id are one item with the terms of all; an item without known terms and
an empty table give no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewarden.llm import tokens
from linewarden.llm.common import ship_package, stored

TOP = 50
#: Bytes of text of an index row.
BLOCK_BYTES = 1 << 21
#: Terms of a block of queries, on average.
QUERY_TERMS = 1 << 17
#: Ranges of a query that are opened together, and queries that descend together.
WIDTH = 64
TOGETHER = 25
#: Groups of a query's results that are ranked before the last ranking.
SALTS = 64
#: Rows are large, so pages and groups are closed by size from the first row on.
ROWS = {
    "parquet.block.size": str(1 << 25),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}

INDEX = """ids array<long>, terms array<binary>, dfs array<int>, sizes array<int>, root int,
           masks binary, drops binary"""

# Bytes of terms stay, A-Z are lowered, all others cut.
_BYTES = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _BYTES[_a:_b] = np.arange(_a, _b)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)

_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def _interleave(x: np.ndarray) -> np.ndarray:
    """Bits of a 32 bit number, a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The m of documents with n terms."""
    if 50 * int(n.max(initial=0)) * n_docs < 2**63:
        return 50 + (50 * n * n_docs) // n_terms
    return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    rows, found = tokens.split(texts, _BYTES)
    code, distinct = tokens.codes(found)
    return rows, code, distinct


def grow(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> dict:
    """The treap of points: cells per level, largest value, masks and differences."""
    height = max(1, int(max(row.max(), column.max())).bit_length())
    z = (_interleave(row) << np.uint64(1)) | _interleave(column)
    order = np.argsort(z)
    cells, most = z[order], value[order]
    sizes, masks, drops = [len(cells)], [], []
    for _ in range(height):
        above = cells >> np.uint64(2)
        first = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
        child = np.left_shift(1, (cells & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
        masks.append(np.bitwise_or.reduceat(child, first))
        peak = np.maximum.reduceat(most, first)
        drops.append(np.repeat(peak, np.diff(np.append(first, len(cells)))) - most)
        cells, most = above[first], peak
        sizes.append(len(cells))
    drop = np.concatenate(drops[::-1]).astype("<u4")
    return {
        "sizes": sizes[::-1],
        "root": int(most[0]),
        "masks": np.concatenate(masks[::-1]).tobytes(),
        # Planes of equal significance are easier to compress.
        "drops": drop.view(np.uint8).reshape(-1, 4).T.tobytes(),
    }


class Cells:
    """A treap made ready for descents: cells of all levels in one numbering."""

    def __init__(self, sizes: list[int], root: int, masks: bytes, drops: bytes):
        self.height = len(sizes) - 1
        inner = sum(sizes[:-1])
        self.mask = np.frombuffer(masks, np.uint8).astype(np.int64)
        children = _ONES[self.mask]
        self.base = 1 + np.cumsum(children) - children
        drop = np.frombuffer(drops, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        self.most = np.empty(inner + sizes[-1], np.int64)
        self.most[0] = root
        parent = np.repeat(np.arange(inner), children)
        start = 1
        for n in sizes[1:]:
            at = slice(start, start + n)
            self.most[at] = self.most[parent[start - 1 : start - 1 + n]] - drop[start - 1 : start - 1 + n]
            start += n

    def below(self, cell: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the child exists, and its number."""
        mask = self.mask[cell]
        before = _ONES[mask & ((1 << child) - 1)]
        return (mask >> child) & 1 == 1, self.base[cell] + before


class Best:
    """The k best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.cutoff = np.ones(queries, np.int64)
        self.query = self.score = self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, query, score, doc, null) -> None:
        query, score = np.append(self.query, query), np.append(self.score, score)
        doc, null = np.append(self.doc, doc), np.append(self.null, null)
        order = np.lexsort((doc, null, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        order = order[keep]
        self.query, self.score = query[keep], score[order]
        self.doc, self.null = doc[order], null[order]
        last = np.flatnonzero(np.arange(len(order)) - first[keep] == self.k - 1)
        self.cutoff[self.query[last]] = self.score[last]


class _Frontier:
    """Open ranges of documents with the cells of their query's terms."""

    def __init__(self):
        self.ranges = np.zeros((5, 0), np.int64)  # query, bound, level, column, first entry
        self.entries = np.zeros((3, 0), np.int64)  # term, cell, weight
        self.open = np.zeros(0, bool)
        self.counts = np.zeros(0, np.int64)

    def add(self, query, bound, level, column, counts, entries) -> None:
        start = self.entries.shape[1] + np.cumsum(counts) - counts
        new = np.stack([query, bound, level, column, start])
        self.ranges = np.concatenate([self.ranges, new], axis=1)
        self.entries = np.concatenate([self.entries, entries], axis=1)
        self.open = np.append(self.open, np.ones(len(query), bool))
        self.counts = np.append(self.counts, counts)

    def best(self, cutoff: np.ndarray, width: int) -> np.ndarray:
        """The ranges with the largest bounds of each query; those below its cutoff are closed."""
        live = np.flatnonzero(self.open)
        live = live[self.ranges[1, live] >= cutoff[self.ranges[0, live]]]
        self.open[:] = False
        query, bound = self.ranges[0, live], self.ranges[1, live]
        order = np.lexsort((-bound, query))
        live, query = live[order], query[order]
        taken = np.arange(len(live)) - np.searchsorted(query, query) < width
        self.open[live[~taken]] = True
        return np.sort(live[taken])

    def compact(self) -> None:
        """Forget closed ranges."""
        live = np.flatnonzero(self.open)
        if 2 * len(live) > len(self.open):
            return
        counts = self.counts[live]
        at = _spread(self.ranges[4, live], counts)
        self.entries = self.entries[:, at]
        self.ranges = self.ranges[:, live]
        self.ranges[4] = np.cumsum(counts) - counts
        self.counts, self.open = counts, np.ones(len(live), bool)


def _spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count."""
    shift = np.repeat(start - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(len(shift))


def descend(cells: Cells, query, term, weight, best: Best, docs, null) -> None:
    """Add the best documents of all queries; ``query`` is sorted, one entry per term of a query."""
    height = cells.height
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    counts = np.diff(np.append(first, len(query)))
    frontier = _Frontier()
    zero = np.zeros(len(first), np.int64)
    bound = np.add.reduceat(weight, first) * cells.most[0]
    frontier.add(query[first], bound, zero, zero, counts, np.stack([term, 0 * term, weight]))
    while len(taken := frontier.best(best.cutoff, WIDTH)):
        owner_query, _, level, column, start = frontier.ranges[:, taken]
        counts = frontier.counts[taken]
        term, cell, weight = frontier.entries[:, _spread(start, counts)]
        owner = np.repeat(np.arange(len(taken)), counts)
        bit = (term >> (height - 1 - level[owner])) & 1
        frontier.compact()
        for side in (0, 1):
            has, child = cells.below(cell, 2 * bit + side)
            if not has.any():
                continue
            of, child = owner[has], child[has]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            bound = np.add.reduceat(weight[has] * cells.most[child], first)
            counts = np.diff(np.append(first, len(of)))
            parent = of[first]
            q, depth, at = owner_query[parent], level[parent] + 1, 2 * column[parent] + side
            stays = bound >= best.cutoff[q]
            leaf = stays & (depth == height)
            if leaf.any():
                best.add(q[leaf], bound[leaf], docs[at[leaf]], null[at[leaf]])
            inner = stays & (depth < height)
            entry = np.repeat(inner, counts)
            entries = np.stack([term[has][entry], child[entry], weight[has][entry]])
            frontier.add(
                q[inner], bound[inner], depth[inner], at[inner], counts[inner], entries
            )


@dataclass
class Index:
    """Rows of ``INDEX``, number of documents with terms, and of all their terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, name: str = "doc_id") -> Index:
    """Index every row of ``docs``: two passes over the texts, no exchange."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    docs = docs.select(F.col(name).cast("long").alias("id"), text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            rows, _ = tokens.split(batch.column("text"), _BYTES)
            yield pa.RecordBatch.from_pydict({"docs": [len(np.unique(rows))], "terms": [len(rows)]})

    total = docs.mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms"))
    n_docs, n_terms = (int(x or 0) for x in total.first())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.gathered(batches, "text", BLOCK_BYTES):
            rows, code, distinct = _terms(batch.column("text"))
            if not len(rows):
                continue
            there, column = np.unique(rows, return_inverse=True)
            n = np.bincount(column)
            points, tf = np.unique(column * len(distinct) + code, return_counts=True)
            column, row = np.divmod(points, len(distinct))
            value = impacts(tf, lengths(n, n_docs, n_terms)[column])
            grown = grow(row, column, value)
            kind = pa.schema([("sizes", pa.list_(pa.int32())), ("root", pa.int32())])
            fixed = pa.RecordBatch.from_pylist([grown], schema=kind)
            yield pa.RecordBatch.from_pydict(
                {
                    "ids": _one(batch.column("id").take(pa.array(there))),
                    "terms": _one(distinct.cast(pa.binary())),
                    "dfs": _one(pa.array(np.bincount(row).astype(np.int32))),
                    "sizes": fixed.column("sizes"),
                    "root": fixed.column("root"),
                    "masks": pa.array([grown["masks"]], pa.binary()),
                    "drops": pa.array([grown["drops"]], pa.binary()),
                }
            )

    return Index(stored(docs.mapInArrow(index, INDEX), "treap", **ROWS), n_docs, n_terms)


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, name: str) -> DataFrame:
    """item, term: the distinct terms of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            rows, found = tokens.split(batch.column("text"), _BYTES)
            item = batch.column("item").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([item, found.cast(pa.binary())], names=["item", "term"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    items = items.select(F.col(name).cast("long").alias("item"), text)
    return items.mapInArrow(cut, "item long, term binary").distinct()


def _frequencies(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """Documents that hold each term; only the dictionaries of the index are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), value_set=terms)
            known = at.is_valid().to_numpy(False)
            at = at.drop_null().to_numpy().astype(np.int64)
            df = batch.column("dfs").flatten().to_numpy()[known]
            np.add.at(total, at, df)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["t", "n"])

    counts = index.select("terms", "dfs").mapInArrow(count, "t long, n long")
    out = np.zeros(len(terms), np.int64)
    # As many rows as the block of queries has terms.
    for r in counts.groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r["t"]] = r["n"]
    return out


def _search_block(index: Index, pairs: list, k: int) -> DataFrame:
    """item, doc_id, score: the k best of every task, for the items of one block."""
    items = sorted({r["item"] for r in pairs}, key=lambda x: (x is None, x))
    number = {x: i for i, x in enumerate(items)}
    words = sorted({bytes(r["term"]) for r in pairs})
    place = {w: i for i, w in enumerate(words)}
    terms = pa.array(words, pa.binary())
    df = _frequencies(index.table, terms)
    weights = np.array([weight(index.n_docs, int(d)) if d else 0 for d in df], np.int64)
    both = sorted((number[r["item"]], place[bytes(r["term"])]) for r in pairs)
    query, term = np.array(both, np.int64).T
    ids = pa.array(items, pa.int64())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                local = np.full(len(terms), -1, np.int64)
                at = pc.index_in(one.column("terms").flatten(), value_set=terms)
                known = np.flatnonzero(at.is_valid().to_numpy(False))
                local[at.drop_null().to_numpy()] = known
                here = (local[term] >= 0) & (weights[term] > 0)
                if not here.any():
                    continue
                ids_here = one.column("ids").flatten()
                cells = Cells(*(one.column(c)[0].as_py() for c in ("sizes", "root", "masks", "drops")))
                docs = pc.fill_null(ids_here, 0).to_numpy(False)
                null = ids_here.is_null().to_numpy(False)
                # A few queries at a time bound the open ranges that a task holds.
                for first in range(0, len(ids), TOGETHER):
                    some = here & (query >= first) & (query < first + TOGETHER)
                    if some.any():
                        t = term[some]
                        descend(cells, query[some], local[t], weights[t], best, docs, null)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(best.query)), pa.array(best.doc, mask=best.null), pa.array(best.score)],
            names=["item", "doc_id", "score"],
        )

    return index.table.mapInArrow(search, "item long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = TOP, name: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    pairs = stored(item_terms(items, name), "item-terms")
    blocks = max(1, -(-pairs.count() // QUERY_TERMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = None
    for b in range(blocks):
        # One block of queries at a time, of bounded size.
        taken = pairs.where(block == b).collect()
        if taken:
            part = _search_block(index, taken, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    found = found.withColumn("salt", salt)
    near = Window.partitionBy("item", "salt").orderBy(*order)
    found = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k)
    last = Window.partitionBy("item").orderBy(*order)
    return (
        found.withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= k)
        .select(F.col("item").alias(name), "rank", "doc_id", "score")
    )


def brute_force(docs: list[tuple], items: list[tuple], k: int = TOP) -> list[tuple]:
    """item, rank, document and score by a loop over all documents; for tests."""
    import re
    from collections import Counter

    lower = {c: c + 32 for c in range(65, 91)}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text: str | None) -> Counter:
        return Counter(w.translate(lower) for w in pattern.findall(text or ""))

    held = [(i, c) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in wanted.items():
        scores = []
        for doc, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                weight(n_docs, df[w]) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m))
                for w in words
                if w in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort(key=lambda x: x[:3])
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(scores[:k], 1)]
    return out
