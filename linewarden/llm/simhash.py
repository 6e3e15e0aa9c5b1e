"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at
most three bits, one segment differs in at most one. So each fingerprint is entered in
the table of either segment once, and looked up there under its own value and the 32
values at distance one. Matches are verified over all 64 bits. Work is done on distinct
fingerprints; equal ones are one node. Links become components by large-star and
small-star rounds.

Defined results: a text without words (null, empty, blanks) has fingerprint zero and is
linked like any other; rows with a null id take part, and a component of nulls only has a
null id; repeated rows share fingerprint and component; an empty table gives no rows.
Only doc_id and text are read, other columns are kept where documents are returned.

Memory: a table entry holds at most about ``CHUNK`` fingerprints; larger buckets are cut by
a hash, and the probes of a bucket meet its entries one by one. The links of one node are
joined by a key that Spark splits when it is skewed, so no task needs all of a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.llm.common import ship_package, stored

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENT = 32
#: Fingerprints in one entry of a segment's table.
CHUNK = 1024
#: Hashes of a text whose bits are counted at a time.
AT_ONCE = 1 << 15


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """A hash of each run of ``width`` words; a shorter text is one run."""
    w = (text or "").encode().lower().split()
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) < width:
        return [h(b" ".join(w), SEED)]
    runs = zip(*(w[i:] for i in range(width)), strict=False)
    return [h(b" ".join(s), SEED) for s in runs]


def fingerprint(text: str | None) -> int:
    """64 bits as a signed integer; a bit is set if over half the shingles set it."""
    hashes = shingle_hashes(text, SHINGLE)
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        part = np.array(hashes[i : i + AT_ONCE], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())

    return of(text)


def _segments(fp: str) -> list[Column]:
    mask = F.lit((1 << SEGMENT) - 1)
    return [F.col(fp).bitwiseAND(mask), F.shiftrightunsigned(fp, SEGMENT)]


def _entries(nodes: DataFrame, ball: bool) -> DataFrame:
    """seg, key, fp; with ``ball`` also for the keys at distance one."""
    flips = [F.lit(0).cast("long")] + [F.lit(1 << j) for j in range(SEGMENT) if ball]
    keys = [
        F.struct(F.lit(n).alias("seg"), F.array(*[s.bitwiseXOR(x) for x in flips]).alias("keys"))
        for n, s in enumerate(_segments("fp"))
    ]
    return (
        nodes.select("fp", F.explode(F.array(*keys)).alias("s"))
        .select("fp", "s.seg", F.explode("s.keys").alias("key"))
    )


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the links of each batch, so a dense group stays linear."""
    for b in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, c = [], []
        for one, many in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for other in many.values.to_pylist():
                x, y = root(one), root(other)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(one)
                    c.append(other)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"]
        )


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links that connect all fingerprints within the distance."""
    table = _entries(nodes, ball=False)
    large = table.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    parts = F.ceil(F.col("n") / CHUNK)
    table = (
        table.join(large, ["seg", "key"], "left")
        .withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("fp"), parts), F.lit(0)))
        .groupBy("seg", "key", "chunk")
        .agg(F.collect_list("fp").alias("fps"))
    )
    # The planner would take the entries for as small as the nodes and broadcast them.
    found = _entries(nodes, ball=True).hint("merge").join(table, ["seg", "key"])
    verified = F.expr(f"filter(fps, x -> x > fp AND bit_count(x ^ fp) <= {DISTANCE})")
    found = found.select("fp", verified.alias("near")).where(F.size("near") > 0)
    return found.mapInArrow(_forest, "a long, b long").distinct()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round; edges (a, b) with a > b."""
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    # Written, so both sides of the join are exchanged and Spark can split a node of many links.
    least = stored(least.withColumn("m", F.least("a", "m")), "least")
    joined = both.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("x"), "m").union(
            least.select(F.col("a").alias("x"), "m")
        )
    else:
        out = joined.where("b > a").select(F.col("b").alias("x"), "m")
    return out.where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """a, b: every node that is not the smallest of its component, and that smallest."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.where("a > b").distinct(), "edges")
    seen = None
    while True:
        edges = stored(_star(_star(edges, small=False), small=True), "edges")
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        second = F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count("*"), digest, second).first())
        if now == seen:
            return edges
        seen = now


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp and component_id of every row of documents."""
    ship_package(docs.sparkSession)
    rows = stored(
        docs.select(
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            fingerprint_column(F.col("text")).alias("fp"),
        ),
        "fingerprints",
    )
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    return named(rows, nodes, links(nodes))


def named(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds root and component_id, the smallest id of the component, to rows with fp."""
    of = components(edges).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: that of the smallest id, and one row of it."""
    best = F.min(F.struct("doc_id", "text_hash")).alias("best")
    kept = classes(docs).groupBy("root").agg(best)
    kept = kept.select(F.col("best.doc_id").alias("__id"), F.col("best.text_hash").alias("__th"))
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    rows = rows.join(
        kept.distinct(), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th"))
    )
    rows = rows.dropDuplicates(["doc_id", "__hash"])
    return rows.select(*[rows[f"`{c}`"] for c in docs.columns])
