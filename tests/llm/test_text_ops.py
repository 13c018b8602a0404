import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import weakref
import zlib

from pathwise.llm import bpe, decontaminate, quality, queries, sharding
from tests.llm.util import TOKEN, docs, edge_rows, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# --- 1 ---------------------------------------------------------------------------------------------


def brute_contamination(rows, items, window=10):
    windows = defaultdict(set)
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(key)
    sizes = sorted({len(k) for k in windows})
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[t]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination_equals_brute_force(spark, sf_dir, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = Counter(map(tuple, queries.op1_decontamination(spark, sf_dir).collect()))
    assert got == brute_contamination(rows, items)
    assert any(r[5] for r in got)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_of_random_small_alphabets(spark, block_bytes):
    rng = random.Random(5)
    draw = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, draw(rng.choice([1, 2, 3, 4, 6, 9, 12]) + (3 if i else 0))) for i in range(12)] + [(3, draw(5)), (None, draw(4)), (99, ""), (98, None)]
    rows = [(i, draw(rng.randrange(0, 40))) for i in range(120)] + edge_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(docs(spark, rows).select("doc_id", "text"), bench, 4, block_bytes)
    got = Counter((r.doc_id, r.hit_n_words, sum(b - a for a, b in zip(r.hit_words[::2], r.hit_words[1::2])), tuple(r.hit_items)) for r in found.collect())
    want = Counter()
    for (k, n, h, _, _, _), c in brute_contamination(rows, items, 4).items():
        want[k, n, h] += c
    assert Counter({k[:3]: 0 for k in got}) + sum((Counter({k[:3]: c}) for k, c in got.items()), Counter()) == want


def test_blocks_of_the_benchmark_are_held_one_at_a_time(spark, monkeypatch):
    rng = random.Random(8)
    draw = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(k, draw(rng.randrange(1, 25))) for k in range(60)]
    rows = [(k, draw(rng.randrange(0, 80))) for k in range(100)] + [(None, None), (5, "")]
    live, most, make = weakref.WeakSet(), [], decontaminate.Index.__init__

    def started(self, *args):
        make(self, *args)
        live.add(self)
        most.append(len(live))

    monkeypatch.setattr(decontaminate.Index, "__init__", started)
    frame = docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(frame.withColumn("row_of_hit", frame["doc_id"]), bench, 10, 100)
    assert len(most) > 5 and max(most) <= 2
    assert "row_of_hit" not in got.columns
    assert Counter(map(tuple, decontaminate.report(frame, bench, block_bytes=100).collect())) == Counter(brute_contamination(rows, items))


def test_removal_cuts_only_the_passage(spark):
    passage = " ".join(f"item{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = " ".join(f"clean{i}" for i in range(30))
    out = {r.doc_id: r.text for r in decontaminate.remove(docs(spark, [(1, f"{clean}, {passage}! {clean}"), (2, clean), (3, passage), (4, None)]), bench).collect()}
    assert out == {1: f"{clean}, ! {clean}", 2: clean, 4: None}


def test_empty_tables(spark):
    none, bench = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(none, bench).count() == 0
    assert [r.n_hit for r in decontaminate.report(docs(spark, [(1, "a b")]), bench).collect()] == [0]
    for frame in (sharding.assign(none), quality.judge(none), quality.keep(none), bpe.digests(none, RANKS)):
        assert frame.count() == 0


# --- 2 ---------------------------------------------------------------------------------------------


def test_shards(spark, rows):
    all_rows = rows + edge_rows() + [(k, "same text") for k in range(300)]
    got = sharding.assign(docs(spark, all_rows), shards=7).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, size(t), zlib.crc32((t or "").encode())) for k, t in all_rows)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(7))  # a text larger than a shard leaves its neighbours empty
    for rs in map(by.get, range(7)):
        rs = rs or []
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 7) <= largest
    order = sorted(all_rows, key=lambda x: (hashlib.md5((x[1] or "").encode()).digest(), x[0] is not None, x[0] or 0))
    run, want = 0, Counter()
    for k, t in order:
        want[k, size(t), (2 * run + size(t)) * 7 // (2 * total)] += 1
        run += size(t)
    assert Counter((r.doc_id, r.size, r.shard) for r in got) == want


# --- 7 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 50])
def test_tree_equals_whole_encoding(enc, rows, leaf):
    c, rng = bpe.Codec(RANKS, leaf_chars=leaf), random.Random(leaf)
    alphabet = [" ", "  ", "\n", "'", "'re", "re", "ll", "s", "a", "B", "1", "23", "!", "...", "é", "😀", " ", " ", "\t", "\x1c", "\x85", "<|endoftext|>", "ing"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + [t[:400] for _, t in rows[:40]]
    for text in texts:
        ids = c.encode(text)
        assert ids.tolist() == enc.encode_ordinary(text), repr(text)
        assert c.decode(ids) == text.encode()


def test_digests(spark, enc, rows):
    all_rows = rows + edge_rows()
    want = Counter()
    for k, t in all_rows:
        ids = enc.encode_ordinary(t or "")
        want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs(spark, all_rows), RANKS).collect())) == want


def test_round_trip_keeps_rows_and_clashing_columns(spark):
    rows = edge_rows()
    from pyspark.sql import functions as F

    frame = docs(spark, rows).withColumn("token_ids", F.lit("clash"))
    back = bpe.decode(bpe.encode(frame, RANKS), RANKS)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((k, t or "") for k, t in rows)


# --- 9 ---------------------------------------------------------------------------------------------


def brute_figures(text):
    text = text or ""
    w = TOKEN.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if TOKEN.search(x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), failed


def test_quality_figures_equal_brute_force(spark, rows):
    rng = random.Random(2)
    some = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))) for k in range(80)] + [(k, "x y z\n\n x y z\nx y z\n") for k in range(2)]
    all_rows = rows + edge_rows() + some
    got = quality.judge(docs(spark, all_rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in got) == Counter((k, *brute_figures(t)) for k, t in all_rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_verdicts_follow_the_labels(spark):
    d = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in queries.op9_quality_rules(spark, d).collect() if r.doc_id in label]
    right = sum(r.kept == bool(label[r.doc_id]) for r in got)
    clean = [r.kept for r in got if label[r.doc_id] and not r.base_failed]
    junk = [r.kept for r in got if not label[r.doc_id] and not r.base_failed]
    assert right / len(got) > 0.85
    assert junk and sum(junk) / len(junk) < 0.05
    assert sum(clean) / len(clean) > 0.97


def test_quality_stage_keeps_the_same_rows(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(frame).collect() if r.kept}
    out = quality.keep(frame)
    assert out.columns == frame.columns
    assert {r.doc_id for r in out.collect()} == kept
