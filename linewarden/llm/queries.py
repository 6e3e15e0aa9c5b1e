"""Named queries of this package over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.llm import (
    chat,
    language,
    mixing,
    packing,
    quality,
    recompression,
    secrets,
    sharding,
    simhash,
    topk,
    treap,
    trie,
    urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # In order of start, then of the kind as listed.
    base = "transform(base, x -> concat_ws(':', x.kind, x.start, x.stop))"
    rank = "array_position(array('assign', 'access', 'hex', 'random'), kind)"
    every = f"""
        transform(array_sort(concat(
            transform(base, x -> struct(x.start AS start, {rank.replace("kind", "x.kind")} AS rank,
                                        x.kind AS kind, x.stop AS stop)),
            transform(random, x -> struct(x.start AS start, 4L AS rank,
                                          'random' AS kind, x.stop AS stop)))),
            x -> concat_ws(':', x.kind, x.start, x.stop))"""
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.array_join(F.expr(base), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(every), ",").alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


def op2_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 20 == 0)


OP2_SQL = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS n,
           list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scores AS (
    SELECT q.n, q.vec_id AS query_id, r.vec_id,
           CASE WHEN len(q.v) = len(r.v) AND len(q.v) > 0
                THEN CAST(list_inner_product(q.v, r.v) AS BIGINT)
                ELSE CAST(coalesce(list_sum(list_transform(list_zip(q.v, r.v),
                     lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) END AS score
    FROM v q JOIN v r ON r.n <> q.n
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, vec_id, score,
           CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_documents(table(spark, sf_dir, "labels"))
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "score",
    )


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    names, model = language.learn(docs.where(~out).select("text", "lang"))
    found = language.predict(docs.select("doc_id", "text"), names, model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op6_column_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, tokenizer_path())
    packed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op7_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    sharded = sharding.shard_by_bytes(docs.withColumn("text_crc32", crc))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken_words(docs).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


PLANTED = r"\### Assistant: </turn> ok"


def op9_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema
    )
    return chat.read_back(chat.formatted(turns.union(planted)))


OP9_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body
    FROM conversations
    UNION ALL
    SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL
    SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), levels AS (
    SELECT *, CASE
        WHEN NOT regexp_matches(body, '###|</turn>|\\\\|\\$') THEN 0
        WHEN NOT regexp_matches(body, '\\(\\|###|</turn>|$)')
            THEN len(regexp_extract_all(body, '###|</turn>'))
        ELSE len(regexp_extract_all(body, '\\|###|</turn>'))
    END AS escapes
    FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(body)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       CAST(sum(14 + length(role) + length(body) + escapes) AS BIGINT) AS formatted_chars
FROM levels
GROUP BY conv_id
"""

def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the document whose number ends its path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL OR toxic IS NOT NULL")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:[.][a-z]+)?/?(?:[?#].*)?$", 1)
    numbered = pages.select("url", number.try_cast("long").alias("doc_id"))
    marks = numbered.where("doc_id IS NOT NULL").join(
        labels.select("doc_id", bad.cast("long").alias("bad")), "doc_id"
    )
    judged = urls.judge(pages, marks.select("url", "bad"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie.prefix_trie(trie.rebuilt(turns))


OP11_SQL = """
WITH turns AS (
    SELECT conv_id, struct_pack(role := coalesce(role, ''), body := coalesce(text, '')) AS said,
           row_number() OVER (PARTITION BY conv_id
               ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(said ORDER BY p) AS own,
           xor(4294967295, list_reduce(
               list_concat([CAST(4294967295 AS BIGINT)],
                   list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                  lambda ch: CAST(ascii(ch) AS BIGINT))),
               lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1],
                   lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
           )) % 6 AS h
    FROM turns GROUP BY conv_id
), whole AS (
    SELECT o.conv_id, list_concat(coalesce(b.own[1:o.h], []), o.own[o.h + 1:]) AS said
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefixes AS (
    SELECT conv_id, depth, said[1:depth] AS path, len(said) = depth AS ends,
           coalesce(length(said[depth].body), 0) AS chars
    FROM (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS depth FROM whole)
), placed AS (
    SELECT conv_id, depth, ends, chars, min(conv_id) OVER (PARTITION BY depth, path) AS node
    FROM prefixes
), linked AS (
    SELECT p.*, a.node AS parent
    FROM placed p LEFT JOIN placed a ON a.conv_id = p.conv_id AND a.depth = p.depth - 1
), nodes AS (
    SELECT node, depth, any_value(parent) AS parent, count(*) AS n, any_value(chars) AS chars,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
               FILTER (ends), '')) AS ends_sha256
    FROM linked GROUP BY node, depth
), children AS (
    SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
    SELECT a.node, a.depth, sum(CAST(c.n IS NULL AS BIGINT)) AS leaves,
           sum((x.n - 1) * x.chars) AS saved
    FROM nodes x JOIN placed a ON a.conv_id = x.node AND a.depth <= x.depth
    LEFT JOIN children c ON c.node = x.node AND c.depth = x.depth
    GROUP BY a.node, a.depth
)
SELECT x.node AS conv_id, x.depth, x.parent AS parent_conv_id, x.n AS n_convs,
       coalesce(c.n, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes x JOIN below b USING (node, depth) LEFT JOIN children c USING (node, depth)
"""


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = treap.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return treap.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = r"""
WITH terms AS (
    SELECT doc_id, unnest(list_transform(
        regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
    FROM documents
), sizes AS (
    SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), whole AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), points AS (
    SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM points, whole GROUP BY term, n_docs
), wanted AS (
    SELECT DISTINCT item_id, unnest(list_transform(
        regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf)
               // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
    FROM wanted JOIN points USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole
    GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER)
           AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def op13_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = recompression.deduplicated(docs)
    digest = recompression.digest().alias("kept_sha256")
    return cleaned.select("doc_id", "n_words", "n_removed", digest)


OP13_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                               lambda x: x <> '') AS words
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS content
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)
), later AS (
    SELECT doc_id, i FROM windows
    QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, i) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later
), placed AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body
    FROM placed ANTI JOIN gone USING (doc_id, i)
    GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


LLM_QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_top_inner_products": op2_top_inner_products,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_mixture": op4_language_mixture,
    "op5_simhash_components": op5_simhash_components,
    "op6_column_packing": op6_column_packing,
    "op7_histogram_sort": op7_histogram_sort,
    "op8_source_mix": op8_source_mix,
    "op9_chat_round_trip": op9_chat_round_trip,
    "op10_url_templates": op10_url_templates,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_treap_search": op12_treap_search,
    "op13_recompression_dedup": op13_recompression_dedup,
}

LLM_CHECKS: dict[str, str] = {
    "op2_top_inner_products": OP2_SQL,
    "op9_chat_round_trip": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_treap_search": OP12_SQL,
    "op13_recompression_dedup": OP13_SQL,
}
