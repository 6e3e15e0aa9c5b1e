import hashlib
import random

import pytest
from linewarden.llm import chat

TURNS = "conv_id long, turn long, role string, text string, level string"
PARTS = ["###", "</turn>", ": ", "\\", " ", "\n", "a", "### Assistant: ", "#", ":", "é", "assistant"]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, chat.render(r[2] or "", r[3] or "")[0]))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        size = sum(len(chat.render(r[2] or "", r[3] or "")[0]) for r in own)
        out[conv] = (
            len(own),
            hashlib.sha256(turns.encode()).hexdigest(),
            len(learned),
            hashlib.sha256(learned.encode()).hexdigest(),
            size,
        )
    return out


def test_any_content_comes_back():
    rng = random.Random(1)
    for _ in range(20_000):
        turns = [
            ("".join(rng.choices(PARTS, k=rng.randint(0, 3))), "".join(rng.choices(PARTS, k=rng.randint(0, 6))))
            for _ in range(rng.randint(1, 3))
        ]
        text = "".join(chat.render(*t)[0] for t in turns)
        got, end = chat.parse(text)
        assert end == len(text) and [t[:2] for t in got] == turns


def test_no_more_escapes_than_needed():
    assert chat.render("user", "plain # text \\n a: b") == ("### user: plain # text \\n a: b</turn>\n", 0)
    assert chat.render("user", "a ### b")[0] == "### user: a \\### b</turn>\n"
    assert chat.render("user", r"\### Assistant: </turn> ok")[1] == 2


def test_digests_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(PARTS, k=rng.randint(0, 9))))
        for c in range(60) for t in range(rng.randint(1, 7))
    ]
    rows += [(500, t, "assistant", f"turn {t} " * 20) for t in range(3000)]
    rows += [(600, 0, None, None), (600, None, "user", "early"), (600, 1, "assistant", ""), (None, 0, "user", "x"),
             (700, 0, "user", "same"), (700, 0, "user", "same"), (701, 0, "assistant", "long ### " * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], TURNS)
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.formatted(df)).collect()}
    assert got == brute(rows)
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_a_segment_outside_the_grammar_is_an_error(spark):
    bad = spark.createDataFrame(
        [(1, 0, "### user: no end", 0, None, None)],
        "conv_id long, turn long, segment string, level int, loss_start long, loss_end long",
    )
    with pytest.raises(Exception, match="outside the grammar"):
        chat.read_back(bad).collect()
