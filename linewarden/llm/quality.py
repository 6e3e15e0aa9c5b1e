"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into buckets, whole and unchanged. Two
multinomials over the buckets, one of all documents and one of the trusted documents
among them, give each n-gram the logarithm of their ratio. The score of a document is
the mean over its n-grams, so it does not depend on its length. Every document whose
score is under the threshold is rejected; no random draw is involved.

Defined results: a null or empty text has no words, score 0 and fails the base rules;
null ids are never trusted; without trusted documents all scores are 0, so only the base
rules reject; repeated rows are judged alike. Extra columns are kept, those named like an
added one replaced. All steps are built-in functions; only the bucket weights, a fixed
number of integers, pass through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.llm.common import text_or_empty, without, words

BUCKETS = 1 << 14
#: Added to every bucket of either multinomial.
SMOOTHING = 1.0
#: Least mean log ratio of a kept document, in nats.
THRESHOLD = -0.1
#: At most so many trusted documents (those of the smallest hashes) are learned from, so
#: that their ids can be broadcast: 16 bytes each.
TRUSTED_MOST = 200_000
MICRO = 1_000_000
ADDED = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "score",
    "kept",
)


def with_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__w", words(F.col("text")))


def base_counts(docs: DataFrame) -> DataFrame:
    """The base measures of every document that has its words in ``__w``.

    Repeated three-word windows: positions are sorted by a 32 bit hash of their
    window; only neighbours with equal hashes are compared as text.
    """
    windows = """
        CASE WHEN size(__w) >= 3 THEN sort_array(transform(sequence(0, size(__w) - 3),
            i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]) & 4294967295L, 31) | i))
        ELSE CAST(array() AS array<bigint>) END"""
    near = """
        filter(__s, (x, j) -> shiftright(x, 31) <=> shiftright(get(__s, j - 1), 31)
                           OR shiftright(x, 31) <=> shiftright(get(__s, j + 1), 31))"""
    exact = """
        sort_array(transform(__c, x -> named_struct(
            'g', concat_ws(' ', __w[int(x & 2147483647L)], __w[int(x & 2147483647L) + 1],
                           __w[int(x & 2147483647L) + 2]),
            'i', int(x & 2147483647L))))"""
    repeated = """
        filter(__e, (x, j) -> x.g <=> get(__e, j - 1).g OR x.g <=> get(__e, j + 1).g)"""
    text = text_or_empty(F.col("text"))
    lines = "filter(split(coalesce(text, ''), '\n'), x -> x rlike '[^ \t-\r]')"
    df = docs.withColumn("__s", F.expr(windows))
    df = df.withColumn("__c", F.expr(near))
    df = df.withColumn("__e", F.expr(exact))
    df = df.withColumn("__r", F.expr(repeated)).withColumn("__l", F.expr(lines))
    df = df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (
                F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
            ).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.expr(
                "size(array_distinct(flatten(transform(__r, x -> array(x.i, x.i + 1, x.i + 2)))))"
            ).cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__s", "__c", "__e", "__r", "__l")


def grams(docs: DataFrame) -> DataFrame:
    """Buckets of words (lower half) and of pairs (upper half) in ``__g``."""
    half = BUCKETS // 2
    pair = f"int({half} + pmod(xxhash64(x, get(__w, i + 1)), {half}))"
    one = f"int(pmod(xxhash64(x), {half}))"
    return docs.withColumn(
        "__g", F.expr(f"concat(transform(__w, x -> {one}), transform(__w, (x, i) -> {pair}))")
    )


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Log ratio of trusted to raw for every bucket, in millionths of a nat."""
    some = (
        trusted.where("doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("__id"))
        .distinct()
        .orderBy(F.xxhash64("__id"))
        .limit(TRUSTED_MOST)
    )
    rows = grams(with_words(docs.select("doc_id", "text")))
    rows = rows.join(F.broadcast(some), F.col("doc_id") == F.col("__id"), "left")
    # An outer explode: for the inner one, a filter on the size of the array is pushed down
    # and evaluates the array again, with its words inside the lambda.
    trusted_row = F.col("__id").isNotNull().cast("long").alias("t")
    counts = (
        rows.select(F.explode_outer("__g").alias("g"), trusted_row)
        .where("g IS NOT NULL")
        .groupBy("g")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
        .collect()
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["g"]], target[r["g"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * BUCKETS
    n_raw = sum(raw) + SMOOTHING * BUCKETS
    n_target = sum(target) + SMOOTHING * BUCKETS
    return [
        round(MICRO * math.log((t + SMOOTHING) / n_target * n_raw / (r + SMOOTHING)))
        for t, r in zip(target, raw, strict=True)
    ]


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All documents with their base counts, base_failed, score and kept."""
    docs = without(docs, *ADDED)
    weights = ",".join(map(str, bucket_weights(docs, trusted)))
    table = F.split(F.lit(weights), ",").cast("array<bigint>")
    df = grams(base_counts(with_words(docs)))
    total = F.aggregate("__g", F.lit(0).cast("long"), lambda a, g: a + F.get(table, g))
    mean = total / F.greatest(F.size("__g"), F.lit(1)) / MICRO
    df = df.withColumn("score", mean).drop("__g", "__w")
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    # A filter on a generated column stays above it. It would be pushed through plain
    # projections, with all their expressions written into its lambdas.
    own = [F.col(f"`{c}`") for c in docs.columns]
    judged = df.select(*own, F.explode_outer(F.array(F.struct(*ADDED))).alias("__q"))
    return judged.select(*own, "__q.*")


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Labelled documents of good quality that are not toxic."""
    return labels.where("quality = 1 AND NOT coalesce(toxic, 0) = 1").select("doc_id")
