"""The registered queries over whole tables, against SQL or plain loops."""

import hashlib
import os
import sys
import zlib
from collections import defaultdict
from urllib.parse import urlsplit

import pyarrow.parquet as pq
import pytest
from test_pipeline import first_of_each
from test_quality import brute_base
from test_secrets import brute_base as brute_secrets

from linewarden.llm import packing, queries, secrets, simhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from checking import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.LLM_CHECKS))
def test_query_equals_sql(spark, sf_dir, name):
    problem = compare(
        spark, connect(sf_dir), queries.LLM_QUERIES[name], queries.LLM_CHECKS[name], sf_dir
    )
    assert problem is None


def test_secret_scan(spark, sf_dir, documents):
    """Every span and digest by plain patterns, and a battery run by itself on each token."""
    got = {r.doc_id: r for r in queries.op1_secret_scan(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    strata, tokens = defaultdict(lambda: defaultdict(int)), {}
    for d in documents:
        text = d["text"] or ""
        tokens[d["doc_id"]] = secrets.tested_tokens(text, brute_secrets(text))
        for stratum, level, _, _ in tokens[d["doc_id"]]:
            strata[stratum][level] += 1
    # The step-up rule, by its definition: the lowest level at which it holds.
    least = {}
    for stratum, levels in strata.items():
        n = sum(levels.values())
        for level in sorted(levels):
            above = sum(v for k, v in levels.items() if k >= level)
            if n * 10 ** (-level / secrets.STEPS) <= secrets.FALSE_SHARE * above:
                least[stratum] = level
                break
    rank = {"assign": 0, "access": 1, "hex": 2, "random": 3}
    for d in documents:
        base = brute_secrets(d["text"] or "")
        r = got[d["doc_id"]]
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        kinds = [k for k, _, _ in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        more = [("random", s, e) for t, v, s, e in tokens[d["doc_id"]] if v >= least.get(t, 10**9)]
        every = sorted(base + more, key=lambda x: (x[1], rank[x[0]]))
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in every)


def test_quality_rules(spark, sf_dir, documents):
    rows = queries.op3_quality_rules(spark, sf_dir).collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(documents) == len(rows)
    for d in documents:
        r, want = got[d["doc_id"]], brute_base(d["text"])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_language_mixture(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op4_language_mixture(spark, sf_dir).collect()}
    known = {d["lang"] for d in documents if d["lang"]} | {"und"}
    right = total = 0
    for d in documents:
        r = got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)
        assert r.lang_pred in known and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d["text"] or ""))
        if r.held_out and d["lang"] and r.lang_pred != "und":
            total += 1
            right += r.lang_pred == d["lang"]
    assert total > 20 and right >= 0.95 * total


def test_simhash_components(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op5_simhash_components(spark, sf_dir).collect()}
    prints = {d["doc_id"]: simhash.fingerprint(d["text"]) for d in documents}
    for i, p in prints.items():
        assert got[i].fingerprint == f"{p & (2**64 - 1):016x}"
    assert {r.component_id for r in got.values()} == set(first_of_each([(d["doc_id"], d["text"]) for d in documents]))
    for i, r in got.items():
        assert r.component_id <= i and got[r.component_id].component_id == r.component_id


def test_column_packing(spark, sf_dir, documents):
    encode = packing.encoder(queries.tokenizer_path())
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in queries.op6_column_packing(spark, sf_dir).collect():
        pieces[r.doc_id][r.start] = r
        places[r.sequence_id].append((r.offset, r.length))
    for d in documents:
        ids = encode.whole(d["text"] or "") + b"\0\0\0\0"
        at = 0
        for start, r in sorted(pieces[d["doc_id"]].items()):
            assert start == at and r.doc_tokens == len(ids) // 4
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


def test_histogram_sort(spark, sf_dir, documents):
    rows = queries.op7_histogram_sort(spark, sf_dir).collect()
    text = {d["doc_id"]: d["text"] or "" for d in documents}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size) <= 15
    most = max(r.size for r in rows)
    assert max(size.values()) <= sum(size.values()) / 16 + most


def test_source_mix(spark, sf_dir, documents):
    rows = queries.op8_source_mix(spark, sf_dir).collect()
    words = {d["doc_id"]: len((d["text"] or "").encode().split()) for d in documents}
    by_source, taken, target = defaultdict(int), defaultdict(int), {}
    for d in documents:
        by_source[d["source"]] += words[d["doc_id"]]
    for r in rows:
        assert r.size == words[r.doc_id] and r.source_size == by_source[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(words.values())) < 1
    for s in by_source:
        assert abs(taken[s] - target[s]) <= max(64, 0.02 * target[s])


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_url_templates(spark, sf_dir):
    pages = pq.read_table(f"{sf_dir}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    got = {r.page_id: r for r in queries.op10_url_templates(spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        host = path = ""
        if p["url"] and "://" in p["url"]:
            rest = p["url"].split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
            assert urlsplit(p["url"]).path == path
        assert (r.host, r.path) == (host, path)
        fits = [
            (len(h) + len(t), v, h + t)
            for v, h, t in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(t)
        ]
        best = max(fits, default=None)
        assert r.rule == (best[2] if best else None)
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
