import random

import xxhash
from linewarden.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and group[j] > group[i]:
                    group[j], changed = group[i], True
    ids = {}
    for g, (doc_id, *_) in zip(group, rows, strict=True):
        known = [x for x in (ids.get(g), doc_id) if x is not None]
        ids[g] = min(known) if known else None
    return [(d, f, ids[g]) for (d, *_), f, g in zip(rows, fps, group, strict=True)]


def near_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 60, 250]))
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 1)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(w), "en", f"s{g}"))
    return rows


def by_key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_components_equal_brute_force(spark, docs, odd_rows):
    rows = [*odd_rows, *near_rows()]
    got = simhash.classes(docs(rows, ["fp", "root"]))
    found = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got.collect()]
    assert by_key(found) == by_key(brute_components(rows))


def test_links_follow_every_segment(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for f in fps[:100]:
        g = f
        for b in rng.sample(range(64), rng.randint(1, 4)):
            g ^= 1 << b
        fps.append(g)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in edges.collect()}
    near = {
        frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3
    }
    assert got <= near
    # Few enough that each is a tree edge of its own.
    assert len(got) == len(near)


def test_long_chains_and_large_buckets(spark, monkeypatch):
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    got = {(r.a, r.b) for r in simhash.components(chain).collect()}
    assert got == {(i, 0) for i in range(1, 301)}
    monkeypatch.setattr(simhash, "CHUNK", 4)
    # All share the lower segment; neighbours in the upper one are linked.
    fps = [((i ^ (i >> 1)) << 32) for i in range(64)]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = simhash.components(simhash.links(nodes))
    assert roots.count() == 63 and {r.b for r in roots.collect()} == {0}


def test_first_of_each(spark, docs, odd_rows):
    frame = docs(odd_rows, ["extra"])
    kept = simhash.first_of_each(frame)
    assert kept.columns == frame.columns
    groups = {}
    for d, _, c in brute_components(odd_rows):
        groups.setdefault(c, d)
    assert kept.count() == len(groups)
    assert simhash.first_of_each(docs([])).count() == 0
    assert simhash.classes(docs([])).count() == 0
