import datetime
import math
import random
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pathwise.llm import license_scan, queries, toxicity, url_filter
from pathwise.llm.text import ALNUM, Texts, Words, hash_word
from tests.llm.util import crc, docs, edge_rows, words

# --- 4 ---------------------------------------------------------------------------------------------


def brute_filter(captures, log):
    state = {}
    for lst, action, key, op, day in log:
        if None in (lst, key, day):
            continue
        k = (lst, action, key, day)
        state[k] = min(state.get(k, 1), op == "add")
    out = []
    for url, day in captures:
        keys, hits = set(), []
        m = url and __import__("re").match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(/[^?#]*)?", url)
        if m and day:
            h = m[1].lower()
            labels, parts = h.split("."), [x for x in (m[2] or "").split("/") if x]
            keys = {f"host:{h}"} | {"domain:" + ".".join(labels[i:]) for i in range(len(labels) - 1)} | {f"prefix:{h}/" + "/".join(parts[: i + 1]) for i in range(len(parts))}
        for lst, action, key in {x[:3] for x in state if x[2] in keys}:
            days = [d for a, b, c, d in state if (a, b, c) == (lst, action, key) and d <= day]
            if days and state[lst, action, key, max(days)]:
                hits.append((len(key), action == "block", key, lst))
        best = max(hits, default=(0, 0, "", ""))
        out.append((url, day, len(hits), ("block" if best[1] else "allow") if hits else "none", best[2], best[3]))
    return Counter(out)


def test_filter_equals_brute_force(spark):
    rng = random.Random(6)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(90))
    hosts = ["a.example.com", "b.example.com", "x.y.example.org", "Example.org", "10.0.0.1"]
    urls = [f"http{s}://{h}{p}" for s in ("", "s") for h in hosts for p in ("", "/", "/d/e/f.html?q=/z", "/d", "/d//e#/x")] + [None, "", "no url", "http://u:p@a.example.com:80/d/x"]
    captures = [(rng.choice(urls), rng.choice([None, *[day() for _ in range(12)]])) for _ in range(400)]
    keys = ["host:a.example.com", "domain:example.com", "domain:com", "prefix:a.example.com/d", "prefix:a.example.com/d/e", "host:example.org", None]
    log = [(rng.choice(["l1", "l2"]), rng.choice(["block", "allow"]), rng.choice(keys), rng.choice(["add", "remove"]), day()) for _ in range(120)] + [("l1", "block", "domain:org", "add", None)]
    frame = spark.createDataFrame(captures, "url string, day date").withColumn("verdict", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    entries = spark.createDataFrame(log, "list string, action string, key string, op string, day date")
    got = url_filter.evaluate(frame, entries)
    assert Counter((r.url, r.day, r.n_active, r.verdict, r.decided_by, r.list_name) for r in got.collect()) == brute_filter(captures, log)
    assert url_filter.evaluate(frame.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.evaluate(frame, entries.limit(0)).collect()} == {"none"}


def test_filter_equals_the_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = Counter(map(tuple, queries.op4_url_filter(spark, sf_dir).collect()))
    assert got == Counter(c.execute(url_filter.ORACLE).fetchall())
    assert {k[3] for k in got} >= {"block", "none"}


def test_filter_keeps_any_column_name(spark):
    names = ["u", "d", "_n", "_k", "_v", "_l", "n", "v", "k", "l", "key", "month", "c0", "best", "n_active"]
    captures = spark.createDataFrame([("http://a.example.com/x", datetime.date(2024, 1, 5))], "url string, day date")
    for c in names:
        captures = captures.withColumn(c, captures["url"])
    entries = spark.createDataFrame([("l1", "block", "domain:example.com", "add", datetime.date(2024, 1, 1))], "list string, action string, key string, op string, day date")
    out = url_filter.evaluate(captures, entries)
    assert out.columns == ["url", "day", *names[:-1], "n_active", "verdict", "decided_by", "list_name"]
    row = out.collect()[0]
    assert all(row[c] == row.url for c in names[:-1]) and row.verdict == "block" and row.n_active == 1


def test_a_hot_domain_is_asked_about_once_a_day(spark):
    """All captures ask for one domain, and a third of them are one URL; open entries hold for ever."""
    day = datetime.date(2150, 3, 1)
    captures = [(f"http://h{k}.example.com/{k}" if k % 3 else "http://hot.example.com/", day + datetime.timedelta(k % 2)) for k in range(3000)]
    log = [("l", "block", "domain:example.com", "add", datetime.date(2024, 1, 1)), ("l", "allow", "host:hot.example.com", "add", day + datetime.timedelta(1)), ("l", "block", "domain:org", "add", day)]
    frame = spark.createDataFrame(captures, "url string, day date")
    got = url_filter.evaluate(frame, spark.createDataFrame(log, "list string, action string, key string, op string, day date"))
    assert Counter((r.url, r.day, r.n_active, r.verdict, r.decided_by, r.list_name) for r in got.collect()) == brute_filter(captures, log)


# --- 6 ---------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    frame, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.report(frame, labels).collect()
    assert len(got) == frame.count()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    hit = sum(p for t, p in test if t)
    assert hit / sum(t for t, _ in test) > 0.9
    assert hit / max(1, sum(p for _, p in test)) > 0.9


def test_counterfactual_penalty_evens_out_groups(spark, monkeypatch):
    rng = random.Random(8)
    filler = [f"w{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.5
        # One group is named in toxic texts more often than the other.
        group = "muslim" if rng.random() < (0.8 if toxic else 0.2) else "christian"
        rows.append((i, " ".join([*rng.choices(filler, k=12), group, *(["slur"] if toxic and rng.random() < 0.8 else [])])))
        labels.append((i, int(toxic)))
    lf = spark.createDataFrame(labels + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    neutral = docs(spark, [(1, "the muslim family w1 w2"), (2, "the christian family w1 w2"), (3, "slur w1"), (4, None), (None, "")])

    def run(fairness):
        monkeypatch.setattr(toxicity, "FAIRNESS", fairness)
        return {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.train(docs(spark, rows), lf)).collect()}

    free, even = run(0.0), run(10.0)
    assert abs(even[1] - even[2]) < 0.3 * abs(free[1] - free[2])
    assert even[1] < free[1] and even[3] > 0.7


def naive_features(text):
    """Densities of words and of other words' prefixes, from Python strings."""
    w, n = words(text), Counter()
    terms = {t for g in toxicity.IDENTITY for t in g}
    for x in w:
        n[word_hash(x.encode())] += 1
        if x not in terms:
            raw = x.encode()
            for k in toxicity.PREFIXES:
                if len(raw) > k:
                    n[prefix_hash(raw, k)] += 1
    return {h: math.log1p(100 * c / len(w)) for h, c in n.items()}


@lru_cache(maxsize=None)
def word_hash(raw):
    return hash_word(raw)


@lru_cache(maxsize=None)
def prefix_hash(raw, k):
    found = dict(zip(toxicity.PREFIXES, Words(Texts(pa.array([raw.decode()])), ALNUM).prefixes(toxicity.PREFIXES), strict=True))
    return int(found[k][1][0])


def log_odds(model, text):
    weight = getattr(model, "by_key", None) or dict(zip(map(int, model.keys), model.weights, strict=True))
    model.by_key = weight
    return model.bias + sum(weight.get(h, 0.0) * x for h, x in naive_features(text).items())


def test_toxicity_scores_equal_a_naive_sum(spark, sf_dir):
    """Of a model over many words and prefixes of the documents, and of the trained one."""
    frame, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in frame.collect()}
    features = sorted({h for t in list(texts.values())[:100] for h in naive_features(t)})
    rng = np.random.default_rng(4)
    keys = np.array(features, np.uint64)[rng.random(len(features)) < 0.3]
    assert len(keys) > 1000
    some = toxicity.Model(keys, rng.normal(0, 0.1, len(keys)), -0.2)
    trained = toxicity.train(frame, labels.where(~toxicity.held_out()).select("doc_id", "toxic"))
    for model, got in ((some, toxicity.score(frame, some)), (trained, toxicity.report(frame, labels))):
        for r in got.collect():
            assert r.score == pytest.approx(1 / (1 + math.exp(-log_odds(model, texts[r.doc_id]))), abs=1e-6)


def test_fit_is_the_least_of_the_objective_over_written_swaps(spark):
    """The objective, with every identity term really swapped in the text and the text scored anew, has no lower neighbour."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        toxic = rng.random() < 0.5
        named = rng.choice(["muslim", "christian", "women", "gay", "", ""]) if not toxic else rng.choice(["muslim", "muslim", "women", ""])
        text = " ".join([*rng.choices([f"w{k}" for k in range(20)], k=10), named, *(["slur"] if toxic and rng.random() < 0.7 else [])])
        rows.append((i, text))
        labels.append((i, int(toxic)))
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    group = {t: g for g in toxicity.IDENTITY for t in g}

    def row(text):
        have, x = naive_features(text), np.zeros(len(model.keys))
        for k, h in enumerate(map(int, model.keys)):
            x[k] = have.get(h, 0.0)
        return x

    x, y = np.array([row(t) for _, t in rows]), np.array([t for _, t in labels])
    swapped = []
    for k, (_, text) in enumerate(rows):
        for term in set(words(text)) & set(group):
            for other in group[term]:
                if other != term:
                    swapped.append(row(" ".join(other if w == term else w for w in words(text))) - x[k])
    swapped = np.array(swapped)
    assert len(swapped) > 500

    def objective(w, b):
        z = x @ w + b
        return (np.logaddexp(0, z) - y * z).sum() + toxicity.RIDGE / 2 * (w**2).sum() + toxicity.FAIRNESS * ((swapped @ w) ** 2).sum()

    least = objective(model.weights, model.bias)
    used = np.flatnonzero(np.abs(x).sum(0) + np.abs(swapped).sum(0))
    for k in used.tolist():
        for step in (0.05, -0.05):
            w = model.weights.copy()
            w[k] += step
            assert objective(w, model.bias) > least
    assert min(objective(model.weights, model.bias + s) for s in (0.05, -0.05)) > least


def test_an_id_of_many_rows_is_learned_from_once(spark):
    rows = [(k, f"good words here {k}") for k in range(40)] + [(1000 + k, f"slur bad words {k}") for k in range(40)]
    labels = spark.createDataFrame([(k, int(k >= 1000)) for k, _ in rows], "doc_id long, toxic int")
    hot = docs(spark, rows + [(1000, f"zz good words again {k}") for k in range(500)])
    one, many = (toxicity.train(frame, labels) for frame in (docs(spark, rows), hot))
    assert np.array_equal(one.keys, many.keys) and np.allclose(one.weights, many.weights)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.report(docs(spark, edge_rows()), none).collect()
    assert len(got) == len(edge_rows()) and {r.score for r in got} == {0.5}
    assert toxicity.report(docs(spark, []), none).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_planted_licenses_are_found_with_their_spans(spark):
    rng = random.Random(11)
    noise = lambda n: " ".join(f"n{rng.randrange(500)}" for _ in range(n))
    names, rows = sorted(license_scan.TEMPLATES), []
    for i in range(60):
        name = names[i % len(names)]
        text = license_scan.TEMPLATES[name].split(" ")
        if i >= len(names) and len(text) > 30:  # drop, add and change a few words
            for _ in range(3):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice([[], [text[k], "inserted"], ["changed"]])
        before = noise(rng.randrange(20))
        rows.append((i, f"Ünï {before} {' '.join(text)} {noise(rng.randrange(20))}"))
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    for i, text in rows:
        name = names[i % len(names)]
        assert name in got[i].licenses.split(","), (name, got[i].licenses)
        for span in got[i].spans.split(","):
            t, a, b, c = span.rsplit(":", 3)
            inside, template = words(text[int(a) : int(b)]), words(license_scan.TEMPLATES[t])
            assert longest_common(template, inside) / len(template) == pytest.approx(float(c), abs=1e-3)


def naive_matches(text, template):
    """How many disjoint runs of the text's words hold enough of the template's in order: each run of every place tried, the fullest taken."""
    w, t, n = words(text), words(template), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(w)):
            if w[a] not in t:
                continue
            row, top = [0] * (len(t) + 1), 0
            for b in range(a, min(len(w), a + len(t) + license_scan.GAP)):
                new = [0]
                for j, y in enumerate(t):
                    new.append(row[j] + 1 if w[b] == y else max(row[j + 1], new[-1]))
                row = new
                if row[-1] > top:
                    top = row[-1]
                    best = max(best, (top, a - b, -a))
        if best[0] / len(t) < license_scan.MIN_COVERAGE:
            return n
        n, a = n + 1, -best[2]
        w[a : a - best[1] + 1] = ["\0"] * (1 - best[1])


def test_matches_equal_brute_force(spark):
    rng = random.Random(21)
    names = ("Apache-2.0-notice", "CC-BY-4.0-notice", "GPL-3.0-notice", "MIT-notice")
    templates = {k: license_scan.TEMPLATES[k] for k in names} | {"long": " ".join(license_scan.TEMPLATES["ISC"].split()[:45])}
    noise = lambda n: [f"n{rng.randrange(50)}" for _ in range(n)]
    rows = []
    for i in range(40):
        text = noise(rng.randrange(6))
        for _ in range(rng.randrange(4)):
            some = templates[rng.choice(list(templates))].split()
            if len(some) > 20 and rng.random() < 0.7:
                k = rng.randrange(10, len(some) - 10)
                some[k:k] = noise(rng.choice([1, 5, 12, 30]))
            text += some + noise(rng.choice([0, 0, 3, 20]))
        rows.append((i, " ".join(text)))
    rows.append((100, "Released under the MIT License. " * 7))
    got = {r.doc_id: Counter(x.rsplit(":", 3)[0] for x in r.spans.split(",") if x) for r in license_scan.scan(docs(spark, rows), templates).collect()}
    want = {i: Counter({k: n for k, t in templates.items() if (n := naive_matches(text, t))}) for i, text in rows}
    assert got == want
    assert got[100] == {"MIT-notice": 7} and sum(map(len, want.values())) > 30


def test_clean_texts_have_no_license(spark):
    rows = [*edge_rows(), (50, "under the license of the software"), (51, "licensed under the moon, the version of the license")]
    assert {r.n_matches for r in license_scan.scan(docs(spark, rows)).collect()} == {0}
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_lines_of_the_documents(spark, sf_dir):
    lines = ("Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_matches for r in queries.op8_license_scan(spark, sf_dir).collect()}
    assert {k for k, n in got.items() if n} == {k for k, t in text.items() if any(x in t for x in lines)}
    assert any(got.values())


def test_every_shared_run_meets_a_fingerprint():
    rng = random.Random(5)
    text = " ".join(f"t{rng.randrange(40)}" for _ in range(80))
    h = Words(Texts(pa.array([text])), ALNUM).hashes()
    grams = license_scan._grams(h)
    kept = set(license_scan.winnow(grams))
    for a in range(len(grams) - license_scan.WINNOW + 1):
        assert kept & set(range(a, a + license_scan.WINNOW))
