import math
from collections import Counter

import xxhash
from linewarden.llm import quality

WORD_SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WORD_SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute_base(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(inside),
    )


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(*strings):
    h = 42
    for s in strings:
        if s is not None:
            h = xxhash.xxh64_intdigest(s.encode(), h)
    return signed(h)


def brute_grams(text):
    w = words(text)
    half = quality.BUCKETS // 2
    one = [spark_hash(t) % half for t in w]
    two = [half + spark_hash(a, b) % half for a, b in zip(w, [*w[1:], None], strict=False)]
    return one + two


def brute_scores(rows, trusted):
    raw, target = Counter(), Counter()
    for doc_id, text, *_ in rows:
        g = brute_grams(text)
        raw.update(g)
        if doc_id in trusted:
            target.update(g)
    if not target:
        return [0.0] * len(rows)
    n_raw = sum(raw.values()) + quality.BUCKETS
    n_target = sum(target.values()) + quality.BUCKETS

    def weight(b):
        x = math.log((target[b] + 1.0) / n_target * n_raw / (raw[b] + 1.0))
        return round(1_000_000 * x)

    out = []
    for _, text, *_ in rows:
        g = brute_grams(text)
        out.append(sum(map(weight, g)) / max(1, len(g)) / 1_000_000)
    return out


def test_measures_and_scores_equal_brute_force(spark, docs, odd_rows):
    good = "the ship and the moon rise over the hill and the sea while the men sing"
    rows = [
        *odd_rows,
        (20, " ".join([good, good.replace("moon", "sun")] * 3), "en", "a"),
        (21, "x### y*** z$$$ " * 30, "en", "a"),
        (22, "a\nb\na\n\n \na b a b a b", "en", "a"),
    ]
    trusted = spark.createDataFrame([(20,), (20,), (None,)], "doc_id long")
    got = quality.judge(docs(rows, ["KEPT", "score", "other"]), trusted)
    assert sorted(got.columns) == sorted(
        ["doc_id", "text", "lang", "source", "n_chars", "other", *quality.ADDED]
    )
    found = sorted(
        (
            (r.doc_id is not None, r.doc_id or 0, r.text or "", r.n_words, r.word_chars, r.n_symbols,
             r.n_dup_lines, r.n_repeat_words, round(r.score, 6), r.base_failed, r.kept)
            for r in got.collect()
        )
    )
    expected = []
    for (doc_id, text, *_), score in zip(rows, brute_scores(rows, {20}), strict=True):
        base = brute_base(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        kept = not failed and score >= quality.THRESHOLD
        expected.append(
            (doc_id is not None, doc_id or 0, text or "", *base, round(score, 6), failed, kept)
        )
    assert found == sorted(expected)


def test_filter_on_the_verdict_and_empty_tables(spark, docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long")
    kept = quality.judge(docs(odd_rows), none).where("kept").collect()
    assert [r.doc_id for r in kept] == [5]
    assert quality.judge(docs([]), none).count() == 0
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None)], "doc_id long, quality int, toxic int"
    )
    assert sorted(r[0] for r in quality.trusted_documents(labels).collect()) == [1, 4]


def test_words_count_whole(spark, docs):
    """Words that end alike are apart: only the first half of the rejected ones differs."""
    rng = [f"{a}{b}" for a in ("gold", "silver", "iron") for b in ("smith", "work", "leaf")]
    rows = [(i, " ".join(rng[(i + k) % 9] for k in range(60)), "en", "a") for i in range(40)]
    bad = [w.replace("gold", "zzzz").replace("silver", "yyyy").replace("iron", "xxxx") for w in rng]
    rows += [(100 + i, " ".join(bad[(i + k * k) % 9] for k in range(60)), "en", "a") for i in range(40)]
    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    got = {r.doc_id: r.score for r in quality.judge(docs(rows), trusted).collect()}
    assert min(got[i] for i in range(40)) > 0 > max(got[i] for i in range(100, 140))
