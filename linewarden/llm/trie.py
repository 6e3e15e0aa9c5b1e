"""Prefix trie of conversations by union-find over neighbours in sorted order.

Distinct conversations are sorted by their turns. Two neighbours share as many turns as
their longest common prefix (LCP); taking the edges between neighbours in descending LCP, every
merge of two components creates the trie's branching node at that depth, or extends the node that is
there already. Nothing else is needed than the components at both ends, so the forest of a
batch, of a task and of many tasks is built by the same step (``contract``): what lies between
complete neighbours is closed and leaves as an edge of the trie; what touches either end stays,
contracted to one row per open node. Open nodes of ``FAN`` forests at a time are then merged
across their boundaries until one forest is left.

A node is named by a hash of its turns, so that a child which leaves before its parent is
closed finds it by a join. An edge holds a chain of nodes with the same members and becomes one
row per node at the end.

Defined results: null roles and texts are empty; a null turn comes first, equal turns are
ordered by role and text and all stay; rows without a conversation belong to none and take no
part; equal conversations are members of the same nodes; an empty table gives no rows. Only the four
named columns are read.

Memory: a conversation is one row, of about 28 bytes per turn. A batch of ``BATCH`` distinct
conversations and the open nodes (as many as branchings on two paths) are held at a time. Members
that end at a node are listed in runs of at most 4096, whose digest is folded as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewarden.llm.common import ship_package, stored

#: Turns of the first conversation of its hundred that a conversation may begin with, and one more.
HEADS = 6
#: Characters of a turn's name: 15 bytes in base 64.
NAME = 20
#: Forests that are merged at a time.
FAN = 64
#: Conversations of a batch.
BATCH = 1000
RUN_BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()

EDGE, CLOSED, OPEN = 0, 1, 2
ROW = """kind int, part int, seq int, top long, deep long, first long, n long, children long, leaves long,
         below long, digest string, sums array<long>, key binary, held boolean,
         node string, parent_first long"""
TYPES = {
    "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
}
FIELDS = pa.schema([(c.split()[0], TYPES[c.split()[1]]) for c in ROW.split(",")])


class Node:
    """A node that may still grow: totals of its members and closed children."""

    __slots__ = (
        "depth", "key", "sums", "n", "first", "children", "leaves", "below", "digest", "held", "kids"
    )

    def __init__(self, depth, key, sums, n=0, first=None, children=0, leaves=0, below=0,
                 digest=None, held=False):
        self.depth, self.key, self.sums = depth, key, sums
        self.n, self.first, self.children = n, first, children
        self.leaves, self.below, self.digest = leaves, below, digest
        #: Whether children left before this node was closed.
        self.held = held
        self.kids: list[Node] = []

    def absorb(self, other: Node) -> None:
        """The same node, seen from the other side."""
        self.n += other.n
        if self.first is None or (other.first is not None and other.first < self.first):
            self.first = other.first
        self.children += other.children
        self.leaves += other.leaves
        self.below += other.below
        self.digest = self.digest or other.digest
        self.held |= other.held
        self.kids += other.kids

    def name(self) -> str:
        return xxhash.xxh3_128_hexdigest(self.key[: NAME * self.depth])


class Rows:
    """Rows that leave a forest."""

    def __init__(self):
        self.rows: list[dict] = []

    def edge(self, kid: Node, depth: int, first: int | None, name: str | None) -> None:
        """The nodes below ``depth`` down to ``kid``, which have the same members."""
        self.rows.append(
            {
                "kind": EDGE, "top": depth + 1, "deep": kid.depth, "first": kid.first, "n": kid.n,
                "children": kid.children, "leaves": kid.leaves if kid.children else 1,
                "below": kid.below, "digest": kid.digest,
                "sums": kid.sums[depth : kid.depth + 1], "node": name, "parent_first": first,
            }
        )

    def close(self, node: Node) -> None:
        for kid in node.kids:
            self.edge(kid, node.depth, node.first, None)
        node.kids = []
        if node.held:
            self.rows.append({"kind": CLOSED, "first": node.first, "node": node.name()})

    def attach(self, node: Node, child: Node) -> None:
        """``child`` is complete."""
        self.close(child)
        node.n += child.n
        if node.first is None or child.first < node.first:
            node.first = child.first
        node.children += 1
        node.leaves += child.leaves if child.children else 1
        chain = child.sums[child.depth] - child.sums[node.depth]
        node.below += child.below + (child.n - 1) * chain
        node.kids.append(child)

    def root(self, node: Node) -> None:
        self.close(node)
        self.rows.append(
            {
                "kind": EDGE, "top": 0, "deep": 0, "first": node.first, "n": node.n,
                "children": node.children, "leaves": node.leaves if node.children else 1,
                "below": node.below, "digest": node.digest, "sums": [0, 0],
            }
        )

    def open(self, part: int, nodes: list[Node]) -> None:
        for i, x in enumerate(nodes):
            self.rows.append(
                {
                    "kind": OPEN, "part": part, "seq": i, "deep": x.depth, "first": x.first,
                    "n": x.n, "children": x.children, "leaves": x.leaves, "below": x.below,
                    "digest": x.digest, "sums": x.sums[: x.depth + 1],
                    "key": x.key[: NAME * x.depth], "held": x.held,
                }
            )

    def batches(self) -> list[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        return [pa.RecordBatch.from_pylist(rows, schema=FIELDS)]


def shared_turns(one: bytes, two: bytes) -> int:
    """Length of the longest common prefix, in turns."""
    low, high = 0, min(len(one), len(two)) // NAME
    while low < high:
        mid = (low + high + 1) // 2
        if one[NAME * low : NAME * mid] == two[NAME * low : NAME * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def contract(nodes: list[Node], shared: list[int], out: Rows, final: bool = False) -> list[Node]:
    """Merge neighbours in descending depth; returns the nodes that stay open, in order.

    ``shared`` is the LCP of each node with the next. Neighbours in the result
    share as many turns as the shallower of them has.
    """
    if not nodes:
        return []
    up = list(range(len(nodes)))
    tops = list(nodes)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    left: list[Node] = []
    right: list[Node] = []
    for e in sorted(range(len(shared)), key=lambda e: -shared[e]):
        depth, a, b = shared[e], find(e), find(e + 1)
        x, y = tops[a], tops[b]
        node = x
        if x.depth > depth:
            node = Node(depth, x.key, x.sums)
            if not final and a == find(0):
                left.append(x)
            else:
                out.attach(node, x)
        if y.depth == depth:
            node.absorb(y)
        elif not final and b == find(len(nodes) - 1):
            right.append(y)
        else:
            out.attach(node, y)
        up[b] = a
        tops[a] = node
    whole = tops[find(0)]
    if final:
        if whole.depth:
            root = Node(0, b"", whole.sums)
            out.attach(root, whole)
            whole = root
        out.root(whole)
        return []
    left += [whole, *reversed(right)]
    for node in left:
        if node.kids:
            name = node.name()
            for kid in node.kids:
                out.edge(kid, node.depth, None, name)
            node.kids, node.held = [], True
    return left


def _shallower(nodes: list[Node]) -> list[int]:
    return [min(x.depth, y.depth) for x, y in zip(nodes, nodes[1:], strict=False)]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's sorted conversations: closed edges, and the open nodes at its end."""
    out, held, part = Rows(), [], 0
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            batch = whole.slice(start, BATCH)
            part = batch.column("part")[0].as_py()
            new = []
            for r in batch.to_pylist():
                sums = np.concatenate([[0], np.cumsum(r["chars"], dtype=np.int64)]).tolist()
                key = r["key"].encode()
                new.append(Node(len(key) // NAME, key, sums, r["n"], r["first"], digest=r["digest"]))
            ends = held[-1:] + new
            shared = _shallower(held) + [
                shared_turns(x.key, y.key) for x, y in zip(ends, ends[1:], strict=False)
            ]
            held = contract(held + new, shared, out)
            yield from out.batches()
    out.open(part, held)
    yield from out.batches()


def _merged(final: bool):
    """Merge the open nodes of several forests, in the order of their keys."""

    def merge(table: pa.Table) -> pa.Table:
        out, nodes, shared, before = Rows(), [], [], None
        rows = table.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
        for r in rows:
            new = Node(
                r["deep"], r["key"], r["sums"], r["n"], r["first"], r["children"], r["leaves"],
                r["below"], r["digest"], r["held"],
            )
            if nodes:
                near = min(nodes[-1].depth, new.depth)
                if r["part"] != before:
                    near = shared_turns(nodes[-1].key, new.key)
                shared.append(near)
            nodes.append(new)
            before = r["part"]
        left = contract(nodes, shared, out, final)
        out.open(rows[0]["part"] // FAN, left)
        return pa.Table.from_batches(out.batches(), schema=FIELDS)

    return merge


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct conversation: members are folded from their runs, in order."""
    now, digest = None, hashlib.sha256()
    names = ["key", "chars", "n", "first", "digest"]
    schema = pa.schema(
        [("key", pa.string()), ("chars", pa.list_(pa.int64())), ("n", pa.int64()),
         ("first", pa.int64()), ("digest", pa.string())]
    )
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if now is not None and r["same"] == now["same"]:
                digest.update(b"," + r["ids"].encode())
                now["n"] += r["n"]
                continue
            if now is not None:
                done.append({**now, "digest": digest.hexdigest()})
            now, digest = r, hashlib.sha256(r["ids"].encode())
        yield pa.RecordBatch.from_pylist([{k: d[k] for k in names} for d in done], schema=schema)
    if now is not None:
        last = {**now, "digest": digest.hexdigest()}
        yield pa.RecordBatch.from_pylist([{k: last[k] for k in names}], schema=schema)


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, names, chars: every conversation behind the first turns of its hundred's first."""
    turns = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    # The length of the role keeps a turn's name from standing for two cuts.
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    name = F.base64(F.substring(F.unhex(F.sha2(whole, 256)), 1, NAME * 3 // 4))
    chars = F.length("text").cast("long")
    turn = F.struct(F.row_number().over(order).alias("p"), name.alias("name"), chars.alias("chars"))
    own = turns.select("conv_id", turn.alias("turn"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    own = stored(own, "conversations", True)
    first = F.col("conv_id") - F.col("conv_id") % 100
    heads = own.where(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("own", 1, HEADS - 1).alias("head")
    )
    joined = own.withColumn("head_id", first).join(heads, "head_id", "left")
    shown = F.col("conv_id").cast("string").cast("binary")
    h = (F.crc32(shown) % HEADS).cast("int")
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), 1, h)
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns")).select(
        "conv_id", F.col("turns.name").alias("names"), F.col("turns.chars").alias("chars")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``conversations`` has conv_id, names (of ``NAME`` characters each) and chars per turn.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    key = F.array_join("names", "")
    runs = (
        conversations.select("conv_id", key.alias("key"), "chars")
        .groupBy(F.sha2("key", 256).alias("same"), F.shiftright("conv_id", RUN_BITS).alias("run"))
        .agg(
            F.sort_array(F.collect_list("conv_id")).alias("ids"),
            F.first("key").alias("key"),
            F.first("chars").alias("chars"),
        )
        .select(
            "same",
            "run",
            F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
            F.size("ids").cast("long").alias("n"),
            F.col("ids")[0].alias("first"),
            "key",
            "chars",
        )
    )
    sequences = runs.repartition("same").sortWithinPartitions("same", "run")
    sequences = sequences.mapInArrow(
        _sequences, "key string, chars array<long>, n long, first long, digest string"
    )
    sequences = stored(sequences, "sequences", True)
    ordered = sequences.repartitionByRange("key").sortWithinPartitions("key")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    forest = stored(ordered.mapInArrow(_forest, ROW), "forest", True)
    tables = [forest]
    last = False
    while not last:
        left = tables[-1].where(F.col("kind") == OPEN)
        parts = left.agg(F.max("part")).first()[0]
        last = parts is None or parts < FAN
        if parts is not None:
            grouped = left.groupBy(F.floor(F.col("part") / FAN))
            merged = grouped.applyInArrow(_merged(last), ROW)
            tables.append(stored(merged, "forest", True))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    edges = rows.where(F.col("kind") == EDGE)
    known = edges.where("node IS NULL")
    closed = rows.where(F.col("kind") == CLOSED).select("node", F.col("first").alias("found"))
    late = edges.where("node IS NOT NULL").join(closed, "node")
    late = late.withColumn("parent_first", F.col("found")).drop("found")
    nodes = known.unionByName(late).withColumn("size", F.size("sums"))
    nodes = nodes.select("*", F.posexplode(F.expr("slice(sums, 1, size - 1)")).alias("i", "before"))
    end = F.col("top") + F.col("i") == F.col("deep")
    chain = F.element_at("sums", -1) - F.col("before")
    return nodes.select(
        F.col("first").alias("conv_id"),
        (F.col("top") + F.col("i")).alias("depth"),
        F.when(F.col("i") == 0, F.col("parent_first")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * chain).alias("saved_tokens"),
        F.when(end, F.coalesce("digest", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def brute_force(turns: list[tuple]) -> list[tuple]:
    """The nodes by a dictionary of all prefixes, from (conv_id, turn, role, text); for tests."""
    import zlib

    own: dict[int, list] = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members: dict[tuple, list[int]] = {}
    ends: dict[tuple, list[int]] = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % HEADS
        head = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h]
        whole = tuple(head + ts[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children: dict[tuple, int] = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves = dict.fromkeys(members, 0)
    saved = dict.fromkeys(members, 0)
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
    return [
        (
            min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), children.get(p, 0),
            leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, ms in members.items()
    ]
