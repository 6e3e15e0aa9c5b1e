"""Languages of a document as a mixture that expectation-maximisation estimates.

Each language is a multinomial over hashed character trigrams of lower-case letters and word
boundaries, counted over all documents that may be learned from. A document is a mixture:
the EM algorithm finds the proportions that make its trigrams most likely. Languages are
then left out one by one, the least first, as long as the likelihood, penalised by the
number of languages and the amount of text, does not fall. The language of the largest
proportion is predicted, and its proportion is the score.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every
text if nothing could be learned; null languages are not learned from; an empty name is
a language like any other; ties go to the name that sorts first; repeated rows count as
often as they occur; texts are read whole, in pieces of bounded size. Extra columns are
kept, those named like an added one replaced. The model has ``BUCKETS`` numbers for each
language, whatever the input, and is the only thing sent to the workers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.llm.common import ship_package, without

UNKNOWN = "und"
BUCKETS = 1 << 15
SMOOTHING = 0.1
ROUNDS = 25
#: Trigrams overlap, so three of them weigh as one observation in the penalty.
OVERLAP = 3
#: A language costs so many halves of log(observations).
PENALTY = 2.0
#: Characters of a text that are hashed at a time.
AT_ONCE = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of a text."""
    counts = np.zeros(BUCKETS, np.int64)
    is_letter = letters()
    carry = np.zeros(0, np.uint32)
    for i in range(0, len(text), AT_ONCE):
        codes = np.frombuffer(text[i : i + AT_ONCE].lower().encode("utf-32-le"), "<u4")
        codes = np.where(is_letter[codes], codes, 32)
        codes = np.concatenate((carry if i else np.array([32], np.uint32), codes))
        if i + AT_ONCE >= len(text):
            codes = np.append(codes, 32)
        # Runs of other characters are one boundary.
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep].astype(np.uint64)
        carry = codes[-2:].astype(np.uint32)
        if len(codes) < 3:
            continue
        h = (codes[:-2] * 0x1F_FFFF + codes[1:-1]) * 0x1F_FFFF + codes[2:]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        counts += np.bincount(h.astype(np.int64), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def counted(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of documents with a language and a text."""
    ship_package(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = trigrams(text.as_py())
                if lang in totals:
                    totals[lang] += found
                else:
                    totals[lang] = found
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(at), pa.string()),
                    pa.array(at, pa.int32()),
                    pa.array(counts[at], pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    partial = rows.mapInArrow(of, "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and log probabilities (buckets x languages)."""
    rows = counted(docs).toPandas()
    names = sorted(rows["lang"].unique())
    counts = np.full((BUCKETS, len(names)), SMOOTHING)
    column = rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int)
    counts[rows["bucket"].to_numpy(int), column] += rows["n"].to_numpy(float)
    return names, np.log(counts / counts.sum(axis=0, keepdims=True))


def proportions(counts: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Proportions of the languages of one document after selecting their set."""
    at = np.flatnonzero(counts)
    n = counts[at].astype(float)
    total = n.sum()
    log_p = model[at]
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - top)
    observations = max(2.0, total / OVERLAP)
    price = PENALTY * 0.5 * math.log(observations)

    def estimate(active: np.ndarray) -> tuple[np.ndarray, float]:
        q = p[:, active]
        share = np.full(len(active), 1 / len(active))
        for _ in range(ROUNDS if len(active) > 1 else 0):
            joint = q * share
            share_new = (n / joint.sum(axis=1)) @ joint / total
            if np.abs(share_new - share).max() < 1e-6:
                share = share_new
                break
            share = share_new
        mixed = np.maximum((q * share).sum(axis=1), 1e-300)
        fit = float(n @ (np.log(mixed) + top[:, 0])) / OVERLAP
        return share, fit - price * (len(active) - 1)

    active = np.arange(model.shape[1])
    share, worth = estimate(active)
    best = active, share, worth
    while len(active) > 1:
        active = np.delete(active, int(share.argmin()))
        share, worth = estimate(active)
        if worth >= best[2]:
            best = active, share, worth
    out = np.zeros(model.shape[1])
    out[best[0]] = best[1]
    return out


def predict(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """All documents with lang_pred, score and langs (the selected set by proportion)."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast((names, model))

    @F.pandas_udf("lang_pred string, score double, langs map<string,double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, model = sent.value
        for texts in batches:
            rows = []
            for text in texts:
                if not names or not has_letter(text):
                    rows.append((UNKNOWN, 0.0, {}))
                    continue
                share = proportions(trigrams(text), model)
                best = int(share.argmax())
                score = float(min(1.0, share[best]))
                found = {n: float(s) for n, s in zip(names, share, strict=True) if s > 0}
                rows.append((names[best], score, found))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "langs"])

    out = without(docs, "lang_pred", "score", "langs")
    return out.withColumn("__of", of("text")).select(
        *[F.col(f"`{c}`") for c in out.columns], "__of.lang_pred", "__of.score", "__of.langs"
    )


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that is not learned from."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 5 == 0
