import hashlib

import numpy as np

import corpus_pipeline
from pathwise.llm import secret_scan
from tests.llm.test_corpus_ops import brute_join, brute_secrets
from tests.llm.test_text_ops import brute_contamination
from tests.llm.util import docs, edge_rows


def test_stages_equal_brute_force(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    by_name, texts = dict(corpus_pipeline.STAGES), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == frame.columns
        out = out.checkpoint()
        before, after = ({r.doc_id: r.text for r in x.collect()} for x in (frame, out))
        texts.append((name, before, after))
        frame = out
    (_, b, a) = texts[0]
    assert set(a) < set(b) and all(b[k] == t for k, t in a.items())
    (_, b, a) = texts[1]
    assert set(a) == {k for k, _, _, g in brute_join(list(b.items())) if k == g} and all(b[k] == t for k, t in a.items())
    (_, b, a) = texts[2]
    hit = {k: (n, h) for k, n, h, *_ in brute_contamination(list(b.items()), items)}
    assert set(a) == {k for k, (n, h) in hit.items() if h <= 0.5 * n}
    assert all((a[k] == b[k]) == (hit[k][1] == 0) for k in a)
    (_, b, a) = texts[3]
    assert set(a) == set(b)
    for k, t in b.items():
        found = any(brute_secrets(t)[:3])
        assert (secret_scan.MARK in a[k]) >= found and (found or a[k] == t)
    assert all(len(r.text) == r.n_chars for r in frame.collect())
    last = by_name["byte-level BPE"](spark, frame, sf_dir).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in a.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(a)


def test_stages_take_edge_cases_and_empty_tables(spark, sf_dir):
    for rows in (edge_rows(), []):
        frame = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, sf_dir).collect()


def test_stages_keep_extra_columns_with_clashing_names(spark, sf_dir):
    from pyspark.sql import functions as F

    from pathwise.llm import decontaminate, near_dup, quality

    extra = ["hit_words", "hit_items", "_blob", "_spans", "_gone", "fp", "blob", "w", "s", "p", "n_words", "c0", "root", "kept"]
    frame = docs(spark, edge_rows()).withColumns({c: F.lit(c) for c in extra})
    bench = spark.createDataFrame([(1, "tie tie")], "item_id long, text string")
    for out in (quality.keep(frame), near_dup.keep_one(frame), decontaminate.remove(frame, bench), secret_scan.redact(frame)):
        assert out.columns == frame.columns
        assert all(r[c] == c for r in out.collect() for c in extra)


def test_last_stage_returns_the_ids_of_its_digests(spark, sf_dir):
    import public_tokenizers

    from pathwise.llm import bpe

    frame, ranks = docs(spark, edge_rows()), public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = corpus_pipeline.byte_bpe(spark, frame, sf_dir)
    c = bpe.codec(ranks)
    texts = sorted((r.text or "") for r in frame.collect())
    rows = out.collect()
    assert sorted(c.decode(np.array(r.token_ids, np.uint32)).decode() for r in rows) == texts
    assert all(r.n_tokens == len(r.token_ids) for r in rows)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert sorted(map(key, rows)) == sorted(map(key, bpe.digests(frame, ranks).collect()))
