import random

import pytest

from linewarden.llm import trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def found(spark, turns, schema=TURNS):
    df = spark.createDataFrame(turns, schema)
    out = trie.prefix_trie(trie.rebuilt(df))
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


def expected(turns):
    return sorted(trie.brute_force([t[:4] for t in turns]), key=str)


def random_turns(n, seed, kinds=2, most=8):
    rng = random.Random(seed)
    turns = []
    for c in rng.sample(range(-150, 100 + 3 * n), n):
        for t in range(rng.randrange(1, most)):
            text = f"text {rng.randrange(kinds)} é" if rng.random() < 0.9 else f"own {rng.random()}"
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("batch, fan, parts", [(1, 2, 5), (2, 2, 3), (7, 3, 9), (1000, 64, 2)])
def test_equals_brute_force(spark, monkeypatch, batch, fan, parts):
    """Forests of every size, merged in one round or several."""
    monkeypatch.setattr(trie, "BATCH", batch)
    monkeypatch.setattr(trie, "FAN", fan)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = random_turns(150, batch)
        assert found(spark, turns) == expected(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_deep_and_equal_conversations(spark):
    """A long shared path with ends on the way, and many equal conversations."""
    rng = random.Random(0)
    path = [("user", f"t{i % 7}") for i in range(120)]
    turns = []
    for c in range(60):
        own = path[: rng.randrange(1, 121)] + [("x", str(rng.randrange(3)))] * rng.randrange(2)
        turns += [(1000 + 7 * c, i, *t) for i, t in enumerate(own)]
    turns += [(c, i, "user", f"same {i}") for c in range(5000, 14000, 9) for i in range(2)]
    assert found(spark, turns) == expected(turns)


def test_contract_in_any_grouping():
    """Any cut of the sorted conversations into forests gives the same rows."""
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("ab") * trie.NAME for _ in range(rng.randrange(7))) for _ in range(40)})
    nodes = [
        trie.Node(len(k) // trie.NAME, k.encode(), list(range(len(k) // trie.NAME + 1)), 1 + i % 3, i, digest=str(i))
        for i, k in enumerate(keys)
    ]

    def fresh(x):
        return trie.Node(x.depth, x.key, x.sums, x.n, x.first, digest=x.digest)

    results = set()
    for size in (1, 2, 3, 5, 8, 100):
        out, held = trie.Rows(), []
        for start in range(0, len(nodes), size):
            new = [fresh(x) for x in nodes[start : start + size]]
            ends = held[-1:] + new
            shared = trie._shallower(held) + [
                trie.shared_turns(x.key, y.key) for x, y in zip(ends, ends[1:], strict=False)
            ]
            held = trie.contract(held + new, shared, out)
            # Only two paths stay.
            assert len(held) <= 2 * 8 + 1
        trie.contract(held, trie._shallower(held), out, final=True)
        names = {r["node"]: r["first"] for r in out.rows if r["kind"] == trie.CLOSED}
        edges = [r for r in out.rows if r["kind"] == trie.EDGE]
        for r in edges:
            if r.get("node"):
                r["parent_first"] = names[r["node"]]
        results.add(tuple(sorted(
            str([r.get(k) for k in ("top", "deep", "first", "n", "children", "leaves", "below", "digest",
                                    "parent_first", "sums")]) for r in edges
        )))
    assert len(results) == 1


def test_odd_rows(spark):
    turns = [
        (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "a"),
        (None, 0, "user", "lost"), (2, 5, "user", ""), (3, 1, "us", "er"), (4, 1, "user", ""),
        (100, 0, "user", "long " * 50_000), (101, 0, None, "x"), (102, None, "user", "long " * 50_000),
        (7, 0, "user", "🙂é"),
    ]
    rows = [(*t, "x", 1) for t in turns]
    assert found(spark, rows, TURNS + ", names string, depth int") == expected(turns)


def test_turnless_and_empty(spark):
    """A conversation all of whose turns are replaced by an absent head ends at the root."""
    turns = [(c, 0, "user", "only") for c in range(101, 130)]
    rows = expected(turns)
    assert any(r[1] == 0 and r[7] != trie.EMPTY for r in rows)
    assert found(spark, turns) == rows
    assert found(spark, []) == []
