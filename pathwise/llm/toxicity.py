"""A counterfactual-regularised toxicity classifier.

A logistic regression over the density of words and of words' prefixes (families of words in languages
that inflect or compound), fitted on a bounded sample of labelled documents. Beside the loss and a small
ridge, the fit penalises the squared change of a document's log odds when an identity term in it is
swapped for another of its group, once for each term named and other term: a text must not score higher
for the group it names. For a linear model that change is the difference of the
two terms' weights times the term's density, so the penalty is exact without writing swapped texts; an
identity term has no prefix features, which would carry the group around the penalty.

Features are chosen over the whole sample, by how strongly the shares of documents in which they are
dense differ between the classes; identity terms always take part. Labels, languages, sources and ids are
never inputs.

Bound: ``SAMPLE`` labelled documents, those of the least hashes of their ids, one text each; at most ``FEATURES``
features.

Defined results: a null text is the empty text and scores by the intercept; rows with a null label or id
are not learned from, a document labelled more than once is toxic if any label says so, and of several
texts of one id the least is learned from; without labelled rows every score is 0.5; repeated rows are
each scored; an empty table gives no rows. A text is held by one task, with some 100 bytes for each of
its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.runtime import materialise
from pathwise.llm.text import ALNUM, Texts, Words, slices

SAMPLE = 30_000
FEATURES = 4096
MIN_DOCS = 4
MIN_Z = 3.5
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is dense in a document from one occurrence in so many words.
DENSE = 200
THRESHOLD = 0.7
RIDGE = 0.3
FAIRNESS = 10.0
STEPS = 600

#: Identity terms by group; terms of a group are swapped for each other.
IDENTITY = (
    ("women", "men", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
)


def _hash_words(words: list[str]) -> np.ndarray:
    return Words(Texts(pa.array(words, pa.string())), ALNUM).hashes()


_GROUPS = [_hash_words(list(g)) for g in IDENTITY]
_TERMS = np.concatenate(_GROUPS)


def _occurrences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of every word and of other words' prefixes than identity terms'."""
    doc, own = words.doc(), words.hashes()
    free = ~np.isin(own, _TERMS)
    parts = [(doc, own), *((doc[k[free[k]]], h[free[k]]) for k, h in words.prefixes(PREFIXES))]
    return np.concatenate([d for d, _ in parts]), np.concatenate([h for _, h in parts])


class Model:
    """keys: feature hashes, ascending; weights of the same order; bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def present(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, density), each text and feature once: the log of 1 + occurrences in 100 words."""
        doc, h = _occurrences(words)
        maybe = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        same = self.keys[at] == h[maybe]
        pair, n = np.unique(doc[maybe[same]] * len(self.keys) + at[same], return_counts=True)
        doc = pair // len(self.keys)
        return doc, pair % len(self.keys), np.log1p(100 * n / words.counts[doc])

    def scores(self, texts: Texts) -> np.ndarray:
        doc, feature, value = self.present(Words(texts, ALNUM))
        return 1 / (1 + np.exp(-(self.bias + np.bincount(doc, self.weights[feature] * value, len(texts)))))


def _document_frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, toxic, n): in how many of a partition's documents of a class a feature is dense."""
    for whole in batches:
        keys, counts = [[], []], [[], []]
        for batch in slices(whole, "text"):
            words = Words(Texts(batch.column(0)), ALNUM)
            (doc, h), toxic = _occurrences(words), np.asarray(batch.column(1))
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(edge, len(h)))
            edge = edge[times * DENSE >= words.counts[doc[edge]]]
            h, doc = h[edge], doc[edge]
            for label in (0, 1):
                u, n = np.unique(h[toxic[doc] == label], return_counts=True)
                keys[label].append(u)
                counts[label].append(n)
        for label in (0, 1):
            if keys[label]:
                u, at = np.unique(np.concatenate(keys[label]), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts[label]), len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), label, np.int32)), pa.array(n)], ["h", "toxic", "n"])


def _fit(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, n_features: int, swaps: list[tuple[int, int, float]]) -> tuple[np.ndarray, float]:
    """Adam on the mean loss, the ridge and the counterfactual penalty. swaps: (named, swapped in, density), a mention each."""
    n = len(label)
    w = np.zeros(n_features + 1)  # the last is the bias
    w[-1] = np.log((label.sum() + 1) / (n - label.sum() + 1))
    a, b, x = (np.array([s[k] for s in swaps], kind) for k, kind in enumerate((np.int64, np.int64, float)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z = w[-1] + np.bincount(doc, w[feature] * value, n)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
        g = np.append(np.bincount(feature, error[doc] * value, n_features) + RIDGE * w[:-1], error.sum()) / n
        if len(a):
            change = 2 * FAIRNESS * x * x * (w[a] - w[b]) / n
            g[:-1] += np.bincount(a, change, n_features) - np.bincount(b, change, n_features)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (STEPS + 1))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows (doc_id, toxic) and their texts."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` short rows: a broadcast of a fixed bound.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    known = materialise(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    counts = known.mapInArrow(_document_frequencies, "h long, toxic int, n long").groupBy("h").agg(
        F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("b")
    )
    sizes = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0) + 1.0, sizes.get(0, 0) + 1.0
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.greatest(n1 - F.col("a"), F.lit(0.0)) + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (F.greatest(n0 - F.col("b"), F.lit(0.0)) + 0.5))
    strong = counts.where((F.col("a") + F.col("b") >= MIN_DOCS) & (F.col("a") <= n1) & (F.col("b") <= n0)).select("h", F.abs(odds / spread).alias("z")).where(F.col("z") >= MIN_Z)
    picked = strong.orderBy(F.desc("z"), "h").limit(FEATURES).select("h").collect()
    keys = np.unique(np.concatenate([np.array([r.h for r in picked], np.int64).view(np.uint64), _TERMS]))
    blank = Model(keys, np.zeros(len(keys)), 0.0)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = Texts(batch.column(0))
                doc, feature, value = blank.present(Words(texts, ALNUM))
                edge = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edge, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(value.astype(np.float32))), batch.column(1)], ["f", "v", "toxic"])

    rows = known.mapInArrow(read, "f array<int>, v array<float>, toxic int").toArrow().combine_chunks()
    if not rows.num_rows:
        return blank
    lists = rows["f"].combine_chunks()
    feature, value = np.asarray(lists.flatten()).astype(np.int64), np.asarray(rows["v"].combine_chunks().flatten()).astype(float)
    doc = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
    label = rows["toxic"].to_numpy().astype(float)
    group = {int(k): g for g in (np.searchsorted(keys, x) for x in _GROUPS) for k in g}
    swaps = [(f, int(o), v) for f, v in zip(feature.tolist(), value.tolist(), strict=True) if f in group for o in group[f] if o != f]
    return Model(keys, *_fit(doc, feature, value, label, len(keys), swaps))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                p = shipped.value.scores(Texts(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from the labels that are not held out."""
    model = train(docs, labels.where(~held_out()).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
