import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from linewarden.llm import packing
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    encode = packing.encoder(PATH)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "word", "Ünï", "don't", "I'll", "12", "__", "...", "é", "ワード", "🙂",
             "<|endoftext|>", "\x1c", "\xa0", "²", "x" * 40, "\u0301", "A", "'s"]
    texts = ["", " ", "\n \n", "a  b", " a ", "a \n b"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += [" ".join(rng.choices(parts[4:11], k=30)) for _ in range(300)]
    for t in texts:
        expected = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == expected, repr(t)


def test_a_batch_equals_its_texts():
    """Texts of all kinds side by side, in a slice of a longer array."""
    import pyarrow as pa

    encode = packing.encoder(PATH)
    rng = random.Random(7)
    parts = [" ", "word", " word", "\n", "é", "ワード", "<|endoftext|>", "don't", "  "]
    texts = ["", *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500)), "", "a"]
    data = pa.array([b"skipped", *(t.encode() for t in texts)], pa.binary()).slice(1)
    end = np.array([0], "<u4").tobytes()
    ids, counts = encode.batch(data, end)
    expected = [encode.whole(t) + end for t in texts]
    assert ids.tobytes() == b"".join(expected)
    assert counts.tolist() == [len(e) // 4 for e in expected]
    assert encode.batch(pa.array([], pa.binary()), end)[0].size == 0


@pytest.mark.parametrize("text", ["", "a b", "a b c d", "x " * 8, "y " * 36])
def test_short_texts_fill_their_sequences(spark, docs, text):
    rows = [(i, text, "en", "a") for i in range(2000)]
    cut = packing.pieces(docs(rows), PATH)
    got = packing.pack(cut.drop("ids")).collect()
    length = got[0].doc_tokens
    assert sum(r.length for r in got) == 2000 * length
    assert len({r.sequence_id for r in got}) == -(-2000 // (1024 // length))


def brute_knapsack(lengths, values, room):
    best = [0.0] * (room + 1)
    for c in range(1, room + 1):
        best[c] = max([best[c - 1], *(best[c - n] + v for n, v in zip(lengths, values, strict=True) if n <= c)])
    return best[room]


def test_pricing_and_patterns():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 40, 8))
        values = rng.random(len(lengths))
        gain, counts = packing.best_pattern(lengths, values, 50)
        assert abs(gain - brute_knapsack(lengths, values, 50)) < 1e-9
        assert abs(counts @ values - gain) < 1e-9 and counts @ lengths <= 50
    histogram = {int(n): int(c) for n, c in zip(range(1, 33), rng.integers(0, 400, 32), strict=True)}
    found = packing.patterns(histogram, 64)
    used = defaultdict(int)
    for items, times in found:
        assert sum(n * c for n, c in items.items()) <= 64
        for n, c in items.items():
            used[n] += c * times
    assert dict(used) == {n: c for n, c in histogram.items() if c}
    least = sum(n * c for n, c in histogram.items()) / 64
    assert sum(times for _, times in found) <= 1.01 * least + 1
    assert packing.patterns({}, 64) == []


def test_every_token_in_one_place(spark, docs, odd_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    rows = [*odd_rows, *((i, "lorem ipsum " * rng.randint(0, 900), "en", "a") for i in range(100, 300))]
    frame = docs(rows, ["sequence_id", "ids"])
    cut = packing.pieces(frame, PATH).withColumn("crc", F.crc32("ids"))
    got = packing.pack(cut.withColumn("offset", F.lit("x"))).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.crc == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        pieces = by_doc[(doc_id, len(ids))]
        for s in range(0, len(ids), 1024):
            part = np.array(ids[s : s + 1024], "<u4").tobytes()
            assert any(p.start == s and bytes(p.ids) == part for p in pieces)
    assert sum(r.length for r in got) == total
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) * 1024 <= 1.03 * total + 1024
    assert packing.pack(packing.pieces(docs([]), PATH)).count() == 0
