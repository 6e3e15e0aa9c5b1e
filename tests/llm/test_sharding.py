from collections import defaultdict

from linewarden.llm import sharding


def test_bytes_are_even_and_slots_gapless(spark, docs, odd_rows):
    # The very long text alone would fill several shards.
    rows = [r for r in odd_rows if len(r[1] or "") < 1000]
    rows += ((i, "x" * (i * 37 % 400), "en", "a") for i in range(100, 4000))
    rows += [(i, "the same text", "en", "b") for i in range(5000, 7500)]
    got = sharding.shard_by_bytes(docs(rows, ["shard", "SIZE", "more"]))
    assert got.columns.count("shard") == 1 and "more" in got.columns
    size, slots, per_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got.collect():
        assert r.size == len((r.text or "").encode()) + 1
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        per_text[r.text].add(r.shard)
    assert sum(map(len, slots.values())) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(size) == list(range(16))
    share = sum(size.values()) / 16
    longest = max(len((r[1] or "").encode()) + 1 for r in rows)
    assert max(size.values()) <= share + longest and min(size.values()) >= share - longest
    # Equal texts are neighbours: only the hot group spans more than two shards.
    assert all(len(s) <= 2 for t, s in per_text.items() if t != "the same text")


def test_splitters_refine_within_one_text(spark, docs):
    rows = [(i, "same", "en", "a") for i in range(1600)]
    got = sharding.shard_by_bytes(docs(rows)).groupBy("shard").count().collect()
    assert len(got) == 16 and all(abs(r["count"] - 100) <= 1 for r in got)


def test_empty_and_equal_rows(spark, docs):
    assert sharding.shard_by_bytes(docs([])).count() == 0
    assert sharding.shard_by_bytes(docs([(1, "a", "en", "a")] * 3)).count() == 3


def check_order(rows, shards=16):
    """Bytes even, slots gapless and in order of the key across all shards."""
    size, slots = defaultdict(int), defaultdict(dict)
    for r in rows:
        size[r.shard] += r.size
        assert r.slot not in slots[r.shard]
        slots[r.shard][r.slot] = r.text
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    line = [slots[s][i] for s in sorted(slots) for i in range(len(slots[s]))]
    return size, line


def test_equal_rows_fill_all_shards(spark, docs, monkeypatch):
    """Half of the rows are one row; and texts lie side by side."""
    for heavy in (sharding.HEAVY, 100):
        monkeypatch.setattr(sharding, "HEAVY", heavy)
        rows = [(7, "the very same row", "en", "a")] * 3000
        rows += [(i, f"text {i % 60} of its own", "en", "b") for i in range(10, 3010)]
        rows += [(None, None, "en", "b")] * 500
        got = sharding.shard_by_bytes(docs(rows).repartition(5)).collect()
        assert len(got) == len(rows)
        size, line = check_order(got)
        share = sum(size.values()) / 16
        assert sorted(size) == list(range(16))
        assert max(size.values()) <= share + 40 and min(size.values()) >= share - 40
        runs = 1 + sum(a != b for a, b in zip(line, line[1:]))
        assert runs == len({r[1] for r in rows})


def test_all_rows_equal(spark, docs):
    got = sharding.shard_by_bytes(docs([(1, "a", "en", "a")] * 1600)).collect()
    size, _ = check_order(got)
    assert sorted(size.values()) == [200] * 16


def test_slots_equal_a_plain_sort(spark, docs):
    """Against one sort of all rows by the key, cut where the bytes say."""
    from pyspark.sql import functions as F

    rows = [(i, "word " * (i % 83), "en", "a") for i in range(3000)]
    frame = docs(rows)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(frame).collect()}
    keys = sharding.keyed(frame).select("doc_id", "__key", "__tie", "size").collect()
    below, want = 0, []
    total = sum(r["size"] for r in keys)
    for r in sorted(keys, key=lambda r: (r["__key"], r["__tie"])):
        want.append((r["doc_id"], below))
        below += r["size"]
    order = [i for i, _ in sorted(got.items(), key=lambda x: x[1])]
    assert order == [i for i, _ in want]
    for i, start in want:
        assert abs(got[i][0] - start * 16 / total) < 1.2
