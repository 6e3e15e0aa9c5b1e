import random

import numpy as np

from linewarden.llm import recompression


def found(df):
    rows = recompression.deduplicated(df).withColumn("sha", recompression.digest())
    return sorted(
        (tuple(r) for r in rows.select("doc_id", "n_words", "n_removed", "sha").collect()),
        key=str,
    )


def expected(rows):
    return sorted(recompression.brute_force([r[:2] for r in rows]), key=str)


def test_random_texts_equal_brute_force(spark, docs):
    """Few words make runs, periods and passages across documents."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        alphabet = ["a", "b", "c", "d", "e"][: 1 + i % 5] if i % 3 else [f"w{k}" for k in range(400)]
        words = [rng.choice(alphabet) for _ in range(rng.randrange(0, 160))]
        rows.append([i, words])
    passage = [f"p{k}" for k in range(57)]
    for i in range(0, 60, 7):
        at = rng.randrange(len(rows[i][1]) + 1)
        rows[i][1][at:at] = passage[rng.randrange(5) : 40 + rng.randrange(17)]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(w), "en", "a") for i, w in rows]
    rows.append((70, rows[8][1], "en", "a"))
    rows.append((71, rows[8][1].replace("\n", " "), "de", "b"))
    rng.shuffle(rows)
    assert found(docs(rows)) == expected(rows)


def test_repeats_inside_a_document_and_long_runs(docs):
    passage = " ".join(f"x{k}" for k in range(25))
    rows = [
        (3, f"{passage} gap {passage} {passage}", "en", "a"),
        (1, "same " * 500, "en", "a"),
        (2, "same " * 19, "en", "a"),
        (4, "other " + "same " * 30 + passage, "en", "a"),
        (5, "ab " * 15 + passage.upper(), "en", "a"),
    ]
    assert found(docs(rows)) == expected(rows)


def test_one_word_changed_in_a_window(docs):
    base = [f"k{i}" for i in range(40)]
    rows = [(0, " ".join(base), "en", "a")]
    for i in range(1, 40):
        other = base.copy()
        other[i] = "changed"
        rows.append((i, " ".join(other), "en", "a"))
    assert found(docs(rows)) == expected(rows)


def test_odd_rows(docs, odd_rows):
    """Null and equal ids, empty and long texts; equal rows are one place and keep equal results."""
    rows = odd_rows + [(None, odd_rows[6][1], "en", "c"), (5, odd_rows[6][1], "en", "c")]
    df = docs(rows, extra=("Kept", "n_words", "place"))
    out = recompression.deduplicated(df)
    assert [c for c in out.columns if c.lower() in ("kept", "n_words", "n_removed")] == [
        "n_words", "n_removed", "kept"
    ]
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in out.collect()}
    long = len(odd_rows[6][1].split())
    # The null id comes first, so the long text of id 5 goes twice; its own periods go in both.
    assert (5, long, long) in got and (2, 0, 0) in got and (4, 0, 0) in got
    assert any(i is None and n == long and 0 <= k < long for i, n, k in got)
    assert out.count() == len(rows)


def test_empty_table(docs):
    assert found(docs([])) == []


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 50):
        alphabet = rng.integers(0, 2**63, size).astype(np.uint64)
        names = alphabet[rng.integers(0, size, 4000)]
        edge = np.zeros(4000, bool)
        edge[rng.integers(0, 4000, 20)] = True
        edge[0] = True
        doc = np.cumsum(edge)
        starts = np.array([s for s in range(3981) if doc[s] == doc[s + 19]])
        chosen, _ = recompression.anchors(names, edge, starts)
        seen: dict[bytes, int] = {}
        for s, c in zip(starts, chosen, strict=True):
            assert 0 <= c - s <= recompression.WINDOW - recompression.NAMED
            assert seen.setdefault(names[s : s + 20].tobytes(), c - s) == c - s


def test_hashed_words_are_those_of_a_plain_split():
    import pyarrow as pa

    from linewarden.llm import tokens

    rng = random.Random(9)
    texts = ["", " ", "a", "a ", " a", "é\u00a0x\ty", "ab ba", "\x0b\x0c"]
    texts += ["".join(rng.choices("ab \n\tü", k=rng.randrange(12))) for _ in range(400)]
    data = [t.encode() for t in texts]
    whole = pa.array([b"skipped", *data], pa.binary())
    counts, lanes = tokens.hashed_words(whole.slice(1))
    words = [d.split() for d in data]
    assert np.diff(counts).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    pairs = {}
    for w, a, b in zip(flat, lanes[0].tolist(), lanes[1].tolist(), strict=True):
        assert pairs.setdefault(w, (a, b)) == (a, b)
    assert len({a for a, _ in pairs.values()}) == len({b for _, b in pairs.values()}) == len(pairs)
    assert tokens.hashed_words(pa.array([], pa.binary()))[1].shape == (2, 0)
