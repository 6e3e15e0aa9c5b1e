from collections import Counter

import corpus_pipeline
from linewarden.llm import packing, quality, secrets, simhash


def first_of_each(rows):
    """Smallest id of each component of fingerprints, by a loop over all pairs."""
    prints = sorted({simhash.fingerprint(r[1]) for r in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.DISTANCE:
                root[find(a)] = find(b)
    least = {}
    for r in rows:
        p = find(simhash.fingerprint(r[1]))
        least[p] = min(least.get(p, r[0]), r[0])
    return sorted(least.values())


def test_stages_work_on_all_rows_before_them(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    names = [n for n, _ in corpus_pipeline.STAGES]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
    for f in frames[1:-1]:
        assert f.columns == corpus_pipeline.COLUMNS
    rows = [[tuple(r) for r in f.collect()] for f in frames[:-1]]
    trusted = quality.trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.judge(docs, trusted).where("kept")
    assert sorted(r[0] for r in rows[1]) == sorted(r[0] for r in kept.collect())
    assert sorted(r[0] for r in rows[2]) == first_of_each(rows[1])
    assert [r[0] for r in sorted(rows[3])] == [r[0] for r in sorted(rows[2])]
    assert not any(secrets.base_spans(r[1]) for r in rows[3])
    assert max(Counter(rows[4]).values()) <= 2 and set(rows[4]) <= set(rows[3])
    path = corpus_pipeline.tokenizer_path()
    tokens = sum(len(packing.encoder(path)(r[1])) // 4 + 1 for r in rows[4])
    assert frames[-1].agg({"length": "sum"}).first()[0] == tokens
    assert names == ["quality_rules", "simhash_dedup", "secret_scan", "source_mix", "packing"]


def folder(spark, path, rows, labels=((20, 1, 0),)):
    """Tables as the pipeline reads them, with columns that its stages add themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "length(text) AS n_chars", "'x' AS kept", "1 AS slot", "2 AS fp")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )
    return str(path)


def test_run_equals_its_stages_one_by_one(spark, tmp_path, odd_rows):
    """Nulls, blanks, a long text, repeated rows and texts, ids that repeat, clashing columns."""
    good = " ".join(f"plain{i} words{i % 13} here" for i in range(40))
    rows = [
        *odd_rows,
        (20, good, "en", "a"),
        (20, good, "en", "a"),
        (21, good, "de", None),
        (None, good + " and more", "en", "b"),
        (None, good + " and more", "en", "b"),
        (22, good.replace("plain", "other"), None, "c"),
    ]
    sf_dir = folder(spark, tmp_path / "odd", rows)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() > 0
        assert {r[0] for r in map(tuple, docs.collect())} <= {r[0] for r in before}
    path = corpus_pipeline.tokenizer_path()
    sizes = [len(packing.encoder(path)(r.text or "")) // 4 + 1 for r in docs.collect()]
    assert sum(r.length for r in got) == sum(sizes)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_stages_on_odd_rows(spark, docs, odd_rows, sf_dir):
    """Each stage by itself, whatever the ones before would have dropped."""
    frame = docs(odd_rows, ["fp", "kept", "slot", "sequence_id"])
    for name, stage in corpus_pipeline.STAGES:
        for rows in (frame, frame.limit(0)):
            out = stage(spark, rows, sf_dir)
            if name != "packing":
                assert out.columns == corpus_pipeline.COLUMNS
            n = out.count()
            assert n == 0 if rows is not frame else n > 0 or name == "quality_rules"
    found = corpus_pipeline.simhash_dedup(spark, frame, sf_dir).collect()
    # Blank texts are one component, the repeated text another; the null id comes first.
    assert len([r for r in found if not (r.text or "").strip()]) == 1
    assert [r.doc_id for r in found if (r.text or "").startswith("alpha")] == [None]


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [], ())).count() == 0
