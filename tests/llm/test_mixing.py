from collections import defaultdict

from linewarden.llm import mixing


def reshared(sizes):
    """Targets by handing out excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    free, rest = set(names), mixing.SHARE * sum(sizes.values())
    while free and rest > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - 2 * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def test_targets_taken_words_and_reruns(spark, docs, odd_rows):
    rows = [*odd_rows, *((100 + i, "w " * (i % 90 + 1), "en", f"s{i % 5}") for i in range(600))]
    frame = docs(rows, ["size", "target", "slot"])
    got = mixing.taken_words(frame).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    expected = reshared(dict(sizes))
    for r in got:
        assert abs(r.target - expected[r.source]) < 1e-6
        assert r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 6 * mixing.BLOCK_MIN
    again = mixing.taken_words(frame.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_a_small_source_beside_a_huge_one(spark, docs):
    """Sources of a few words are taken as nearly as large ones."""
    rows = [(i, "w " * 450, "en", "huge") for i in range(1000)]
    rows += [(5000 + i, "one two three", "en", f"tiny{i}") for i in range(4)]
    rows += [(6000 + i, "w " * 30, "en", "small") for i in range(10)]
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in mixing.taken_words(docs(rows)).collect():
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(2, 0.05 * target[s]), s
        assert taken[s] > 0


def test_taken_equals_a_loop_over_the_schedule(spark, docs, odd_rows):
    """Every word that a document gives, recomputed from the slots alone."""
    rows = [*odd_rows[2:], *((100 + i, "w " * (i % 37 + 1), "en", f"s{i % 4}") for i in range(200))]
    frame = docs(rows)
    sizes = mixing.sized(frame)
    targets = mixing.source_targets(sizes)
    total = sum(r.target for r in targets.collect())
    sources = mixing.with_blocks(targets, mixing.block_words(total))
    slots = mixing.slots(sources).collect()
    block = {r.source_no: r.block_words for r in sources.collect()}
    n = len(slots)
    assert sorted(r.slot for r in slots) == list(range(n))
    line, bounds, at = [], {}, 0.0
    for r in sorted(sources.collect(), key=lambda r: r.source_no):
        bounds[r.source_no] = (at, at + r.n_slots)
        at += r.n_slots
    for r in sorted(slots, key=lambda r: r.slot):
        u = (r.slot * mixing.GOLDEN) % 1.0 * at
        low, high = bounds[r.source_no]
        assert low - 1e-6 <= u <= high + 1e-6
        assert r.block == sum(x == r.source_no for x in line)
        line.append(r.source_no)
    docs_of = defaultdict(list)
    for r in mixing.placed(sizes, sources).collect():
        docs_of[r.source_no].append(r)
    want = {}
    for no, own in docs_of.items():
        words = [r.doc_id for r in sorted(own, key=lambda r: r.place) for _ in range(r.size)]
        given = (words * 2)[: block[no] * line.count(no)]
        for r in own:
            want[(r.doc_id, r.size, r.source)] = given.count(r.doc_id)
    got = {(r.doc_id, r.size, r.source): r.taken for r in mixing.taken_words(frame).collect()}
    assert got == want


def test_schedule_is_even_and_covers_whole_blocks(spark, docs):
    rows = [(i, "w " * 50, "en", f"s{i % 3}") for i in range(300)]
    mix, documents = mixing.schedule(docs(rows))
    found = mix.collect()
    by_slot = defaultdict(int)
    for r in found:
        by_slot[r.slot] += r.n_words
    assert max(by_slot.values()) == mixing.BLOCK_MIN
    # Every stretch of the schedule holds a source in proportion.
    source = {r.slot: r.source_no for r in found}
    target = {r.source_no: r.target for r in documents.collect()}
    share = target[0] / sum(target.values())
    n = max(source)
    for a in range(0, n - 200, 200):
        count = sum(source.get(i) == 0 for i in range(a, a + 200))
        assert abs(count - 200 * share) < 6


def test_whole_documents_and_empty_table(spark, docs, odd_rows):
    frame = docs(odd_rows, ["extra"])
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    rows = [tuple(r) for r in mixed.collect()]
    assert rows and max(rows.count(r) for r in rows) <= 4
    assert mixing.mixed_documents(docs([])).count() == 0
    assert mixing.taken_words(docs([])).count() == 0
    assert mixing.taken_words(docs([(1, None, "en", None)])).collect()[0].taken == 0
