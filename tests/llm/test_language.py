import random

import numpy as np
from linewarden.llm import language
from pyspark.sql import functions as F

STEMS = {
    "aa": ["kala", "meri", "talo", "puu", "joki", "ranta"],
    "bb": ["stone", "river", "thing", "house", "which", "strong"],
    "cc": ["çeau", "ouè", "tré", "eaux", "être", "noué"],
}


def sentence(lang, rng, n):
    return " ".join(rng.choice(STEMS[lang]) for _ in range(n))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, sentence(lang, rng, rng.randint(4, 60)), lang, "a")
            for i in range(n) for lang in [rng.choice(list(STEMS))]]


def brute_trigrams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(low.split()) + " " if low.split() else " "
    return len([padded[i : i + 3] for i in range(len(padded) - 2)])


def test_trigrams_do_not_depend_on_pieces(monkeypatch):
    text = "Abc,  déf\n\n12 ghi " * 50
    whole = language.trigrams(text)
    assert whole.sum() == brute_trigrams(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "AT_ONCE", size)
        assert np.array_equal(language.trigrams(text), whole)


def test_held_out_accuracy_and_odd_rows(spark, docs, odd_rows):
    rows = [*corpus(), *((r[0], r[1], None, r[3]) for r in odd_rows)]
    frame = docs(rows, ["score", "extra"])
    out = language.held_out(F.col("doc_id"))
    names, model = language.learn(frame.where(~out))
    assert names == sorted(STEMS)
    got = language.predict(frame, names, model)
    assert "extra" in got.columns and got.columns.count("score") == 1
    found = got.collect()
    assert len(found) == len(rows)
    judged = [r for r in found if r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in judged) / len(judged) > 0.98
    for r in found:
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == language.UNKNOWN) == (not letters)


def test_mixtures_and_single_languages(spark, docs):
    names, model = language.learn(docs(corpus(400, 2)))
    rng = random.Random(3)
    mixed = sentence("aa", rng, 70) + ". " + sentence("bb", rng, 30)
    share = language.proportions(language.trigrams(mixed), model)
    assert names[int(share.argmax())] in ("aa", "bb") and (share > 0.2).sum() == 2
    assert share[names.index("cc")] == 0
    alone = language.proportions(language.trigrams(sentence("cc", rng, 50)), model)
    assert alone[names.index("cc")] > 0.99


def test_nothing_to_learn_from(spark, docs, odd_rows):
    names, model = language.learn(docs([(1, None, "en", "a"), (2, "text", None, "a")]))
    assert names == []
    got = language.predict(docs(odd_rows), names, model).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert language.predict(docs([]), names, model).count() == 0
