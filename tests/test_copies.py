"""Pools with many copies of few sequences: the same results as sequence by sequence, and no limit by the number of copies."""

import math
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pathwise.functions import SequencePool
from pathwise.operators import clustering, discrepancy, distances
from pathwise.operators.distances import Batch, Classes, DistanceMatrix
from pathwise.operators.kernels import levenshtein
from pathwise.plans import catalog

WORDS = ("ABC", "A", "ABAB", "CCA", "BBBB", "ACB", "CABCA", "BA", "AAB", "C", "BCBC", "CA")
MANY = 9000  # more ids than a dense matrix may have


def pool(spark, *words):
    rows = [(i + 1, t, s) for i, w in enumerate(words) for t, s in enumerate(w)]
    return SequencePool(spark.createDataFrame(rows, "id long, time long, state string"))


def some(n, seed=1):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def single(x: DistanceMatrix) -> DistanceMatrix:
    """The same matrix, each sequence by itself."""
    return DistanceMatrix(values=x.values, labels=x.labels)


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    """Tables of MANY conversations of twelve kinds."""
    d = str(tmp_path_factory.mktemp("many"))
    words = F.array(*(F.array(*map(F.lit, w)) for w in WORDS))
    rows = spark.range(MANY).select(F.col("id").alias("conv_id"), F.posexplode(words[(F.xxhash64("id") % 7 + F.col("id") % 6).cast("int") % 6 + 5]).alias("turn", "role"))
    rows.withColumn("turn", F.col("turn").cast("long")).write.parquet(f"{d}/conversations.parquet")
    return d


#: The finding of each query that has been settled, and the rows that it has on MANY conversations: 0 for a row each, -1 for several.
SETTLED: dict[str, int] = {
    "clara": 0,
    "dissimilarity_tree": -1,
    "hierarchical_average": 0,
    "hierarchical_single": 0,
    "multi_factor_discrepancy": 2,
    "pam_inits": 3,
    "representatives_by_cluster": 6,
    "distance_matrix": 1,
    "hierarchical_class": 0,
    "hierarchical_ward": 0,
    "pam_predict": 0,
    "discrepancy_permutation": 1,
    "hierarchical_complete": 0,
    "matrix_quality": 0,
}


@pytest.mark.parametrize("name", sorted(SETTLED))
def test_query_over_more_sequences_than_a_matrix_has(spark, talks, name):
    found = catalog.QUERIES[name](spark, talks).count()
    assert found > 1 if SETTLED[name] < 0 else found == (SETTLED[name] or MANY)


def test_quality_needs_no_pairs_of_ids(spark, monkeypatch):
    p = pool(spark, *some(60))
    labels = p.base.select("id").distinct().withColumn("cluster", (F.col("id") % 3).cast("int"))
    dm = distances.compute(p, "euclidean")
    want = clustering.cluster_quality(single(dm), [x % 3 for x in dm.labels])
    assert clustering.cluster_quality(dm, [x % 3 for x in dm.labels]) == pytest.approx(want)
    long = clustering.cluster_quality_frame(distances.compute(p, "euclidean").pairs, labels).first()
    monkeypatch.setattr(distances, "BLOCK", 3)
    monkeypatch.setattr(distances, "tile_pairs", None)
    got = clustering.cluster_quality_frame(distances.compute(p, "euclidean"), labels).first()
    for row in (long, got):
        assert [row.asw, row.pbc, row.hg, row.r2] == pytest.approx([want["ASW"], want["PBC"], want["HG"], want["R2"]])
    one = pool(spark, "AB")
    assert clustering.cluster_quality_frame(distances.compute(one, "euclidean"), one.base.select("id", F.lit(1).alias("cluster")).distinct()).first().asDict() == dict.fromkeys(("asw", "pbc", "hg", "r2"))


@pytest.mark.parametrize("seed", [1, 2])
def test_medoids_of_copies(spark, seed):
    dm = distances.compute(pool(spark, *some(70, seed)), "om")
    alone = single(dm)
    assert len(dm.classes.size) == len(set(some(70, seed)))
    for k in (2, 3, 5):
        for init in ("build", "random", "k-medoids++"):
            a, b = (clustering.pam_clustering(x, k, init=init, random_state=3) for x in (dm, alone))
            assert a.medoid_indices.tolist() == b.medoid_indices.tolist() and a.labels.tolist() == b.labels.tolist() and a.total_cost == b.total_cost
        a, b = (clustering.clara_clustering(x, k, random_state=1) for x in (dm, alone))
        assert a.medoid_indices.tolist() == b.medoid_indices.tolist() and a.labels.tolist() == b.labels.tolist() and a.sample_costs == b.sample_costs


def test_tree_of_copies(spark):
    words = some(90, 4)
    dm = distances.compute(pool(spark, *words), "om")
    covariates = np.array([[len(w), k % 2] for k, w in enumerate(words)])
    a, b = (discrepancy.dissimilarity_tree(x, covariates, ["turns", "parity"]) for x in (dm, single(dm)))
    assert a.rows == b.rows and a.leaf_labels.tolist() == b.leaf_labels.tolist() and len(a.rows) > 3


def check_linkage(spark, method):
    for seed in (1, 2):
        dm = distances.compute(pool(spark, *some(50, seed)), "om")
        a, b = (clustering.hierarchical_clustering(x, 4, method) for x in (dm, single(dm)))
        assert len(dm.classes.size) < 50 and a.linkage_matrix.tolist() == b.linkage_matrix.tolist() and a.labels.tolist() == b.labels.tolist()


def test_average_linkage_of_copies(spark):
    check_linkage(spark, "average")


def test_linkage_where_unlike_sequences_are_0_apart(spark):
    dm = distances.compute(pool(spark, "AB", "ABAB", "A", "AB", "C", "CA", "C"), "euclidean")
    a, b = (clustering.hierarchical_clustering(x, 3, "average") for x in (dm, single(dm)))
    assert a.linkage_matrix.tolist() == b.linkage_matrix.tolist()


def test_single_linkage_of_copies(spark):
    check_linkage(spark, "single")


def test_permutations_of_copies(spark):
    dm = distances.compute(pool(spark, *some(40, 5)), "om")
    factors = {"parity": [x % 2 for x in dm.labels], "third": [x % 3 for x in dm.labels]}
    a, b = (discrepancy.multi_factor_discrepancy(x, factors, 49, 1) for x in (dm, single(dm)))
    assert len(dm.classes.size) < 40
    for k in factors:
        assert a[k].p_value == b[k].p_value and (a[k].pseudo_f, a[k].ss_within, a[k].ss_total) == pytest.approx((b[k].pseudo_f, b[k].ss_within, b[k].ss_total))


def test_a_copy_of_a_medoid_may_be_the_next_one(spark):
    dm = distances.compute(pool(spark, "AB", "AB", "AB", "C", "AB"), "om")
    for k in (3, 4, 5):
        a, b = (clustering.pam_clustering(x, k) for x in (dm, single(dm)))
        assert a.medoid_indices.tolist() == b.medoid_indices.tolist() and a.labels.tolist() == b.labels.tolist()


@pytest.mark.parametrize("strategy", ["centrality", "frequency", "density"])
def test_representatives_by_cluster_of_copies(spark, strategy):
    dm = distances.compute(pool(spark, *some(50, 6)), "om")
    labels = [x % 3 for x in dm.labels]
    a, b = (clustering.extract_representatives(x, 7, strategy, labels) for x in (dm, single(dm)))
    assert len(dm.classes.size) < 50 and a.indices.tolist() == b.indices.tolist() and a.scores == pytest.approx(b.scores)


def test_classes_of_a_matrix(spark):
    dm = distances.compute(pool(spark, *some(40, 7)), "om")
    c = dm.classes
    assert np.array_equal(c.dense[np.ix_(c.of, c.of)], dm.values) and c.size.sum() == 40 == dm.n and len(set(c.of)) == len(c.size)
    assert c.of[c.first].tolist() == list(range(len(c.size))) and distances.compute(pool(spark, "AB", "AB"), "softdtw").classes.size.tolist() == [1, 1]


def test_the_class_of_linkage_with_copies(spark):
    dm = distances.compute(pool(spark, *some(30, 8)), "om")
    a, b = (clustering.HierarchicalClustering(3, "average").fit(x) for x in (dm, single(dm)))
    assert len(dm.classes.size) < 30 and a.labels_.tolist() == b.labels_.tolist()


def test_ward_linkage_of_copies(spark):
    check_linkage(spark, "ward")


def test_predict_for_copies(spark):
    dm = distances.compute(pool(spark, *some(50, 9)), "om")
    model = clustering.PAMClustering(3).fit(dm)
    assert model.predict(dm).tolist() == model.predict(dm.values).tolist() == model.labels_.tolist()
    with pytest.raises(ValueError):
        model.predict(distances.compute(pool(spark, "AB"), "om"))


@pytest.mark.parametrize("strategy", ["centrality", "frequency", "density"])
@pytest.mark.parametrize("n", [1, 2, 41, 60])
def test_representatives_need_no_pairs_of_ids(spark, monkeypatch, strategy, n):
    p = pool(spark, *some(n, n))
    long = clustering.representatives_frame(distances.compute(p, "euclidean").pairs, strategy, 9).collect()
    monkeypatch.setattr(distances, "BLOCK", 3)
    monkeypatch.setattr(distances, "tile_pairs", None)
    got = clustering.representatives_frame(distances.compute(p, "euclidean"), strategy, 9).collect()
    assert [r.id for r in got] == [r.id for r in long] and [r.score for r in got] == pytest.approx([r.score for r in long])


def test_draws_go_by_the_md5_of_seed_and_place():
    import hashlib

    draws = clustering.Draws(5)
    for drawn in range(2):
        assert draws.order(300).tolist() == sorted(range(300), key=lambda i: hashlib.md5(f"5:{drawn}:{i}".encode()).digest())


def test_complete_linkage_of_copies(spark):
    check_linkage(spark, "complete")


def test_quality_of_a_matrix_of_copies(spark):
    dm = distances.compute(pool(spark, *some(50, 10)), "om")
    labels, alone = [x % 3 for x in dm.labels], single(dm)
    assert len(dm.classes.size) < 50
    assert clustering.silhouette_scores(dm, labels) == pytest.approx(clustering.silhouette_scores(alone, labels)) and clustering.distance_to_center(dm, labels) == pytest.approx(clustering.distance_to_center(alone, labels))


def test_pair_functions_compare_different_sequences_once(spark):
    p = pool(spark, *some(60, 2))
    seqs, _, n, *_ = distances.coded(p)
    codes = {r.id: r.codes for r in seqs.collect()}

    def counted(codes):
        assert len({tuple(c) for c in codes}) <= len(WORDS) and len(codes) <= 2 * len(WORDS)
        return lambda i, j: np.array([distances.lcs_similarity(codes[x], codes[y]) for x, y in zip(i, j)], float)

    got = distances.tile_pairs(seqs, n, {"v": counted, "w": lambda codes: lambda i, j: np.zeros(len(i))}, symmetric=True, digits=6).collect()
    assert {(r.id_a, r.id_b): r.v for r in got} == {(a, b): round(distances.lcs_similarity(codes[a], codes[b]), 6) for a in codes for b in codes if a < b}
    assert len(got) == 60 * 59 // 2


def test_common_subsequence_by_bits():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 130)))] for _ in range(2))
        assert distances.lcs_length(a, b) == (len(a) + len(b) - distances.lcs_distance(a, b)) / 2
    began = time.process_time()
    assert distances.lcs_length([0, 1] * 4000, [1] * 9000) == 4000 and time.process_time() - began < 5


@pytest.mark.parametrize("method", ["om", "softdtw"])
def test_pairs_where_blocks_are_missing(spark, method):
    for n in (1, 2, 9, 18, 33):
        words = some(n, n)
        p = pool(spark, *words)
        codes = {r.id: r.codes for r in p.sequences.collect()}
        want = {(a, b): distances._single(method)(codes[a], codes[b]) for a in codes for b in codes if a < b}
        got = {(r.id_a, r.id_b): r.distance for r in distances.compute(p, method).pairs.collect()}
        assert got == pytest.approx(want)


def sent(rows):
    """Ids that tasks send."""
    return rows.agg(F.sum(F.size("ids_a") + F.size("ids_b"))).first()[0]


def test_tasks_send_pair_functions_by_class(spark):
    p = pool(spark, *[WORDS[x // 100] for x in range(200)])
    seqs, _, n, *_ = distances.coded(p)
    values = {c: lambda codes: lambda i, j: np.zeros(len(i)) for c in "vw"}
    assert sent(distances.tile_rows(seqs, n, values, symmetric=True, digits=6)) < 200 * 199 // 2 // 2
    assert distances.tile_pairs(seqs, n, values, symmetric=True, digits=6).distinct().count() == 200 * 199 // 2


EQUAL = ("ABC", "AAC", "BCC", "CCC", "ABB", "AAA")


def check_pairs(spark, monkeypatch, method, naive, words, **options):
    """All pairs of ids, rounded, in blocks that split groups of copies; blocks are sent as their different sequences."""
    monkeypatch.setattr(distances, "BLOCK", 7)
    p = pool(spark, *words)
    seqs, k, n, *_ = distances.coded(p)
    codes = {r.id: r.codes for r in seqs.collect()}
    got = distances.compute(p, method, **options).rounded_pairs(6).collect()
    want = {(a, b): naive(codes[a], codes[b], k) for a in codes for b in codes if a < b}
    assert len(got) == len(want) and {(r.id_a, r.id_b): r.distance for r in got} == pytest.approx(want, abs=6e-7)
    g, _ = distances.grid(n, spark.sparkContext.defaultParallelism)
    assert distances.tiled(distances.placed(seqs.select("id", "codes"), "codes", "id"), n, "id").count() <= g * g < n * g


def test_hamming_of_copies(spark, monkeypatch):
    words = [EQUAL[x % 4 if x % 5 else 4 + x % 2] for x in range(60)]
    check_pairs(spark, monkeypatch, "hamming", lambda a, b, k: distances.hamming_distance(a, b), words)


def test_rlcp_of_copies(spark, monkeypatch):
    check_pairs(spark, monkeypatch, "rlcp", lambda a, b, k: distances.rlcp_distance(a, b), some(60, 11))


def test_chi2_of_copies(spark, monkeypatch):
    check_pairs(spark, monkeypatch, "chi2", lambda a, b, k: distances.chi2_distance(a, b, k), some(60, 12))


def test_large_pools_are_written_in_fewer_files():
    assert distances.grid(90_000, 6) == (88, 244)
    assert distances.grid(90_000, 60) == (88, 1920)


def test_rounding_is_that_of_spark(spark):
    x = [0.1234565, 2.5e-7, 5e-7, 1.0000005, 0.3, -0.0000015, 1e-9, 12345.6789015, math.inf, 1 / 3]
    rows = spark.createDataFrame(list(enumerate(x)), "i long, x double").select("i", F.round("x", 6).alias("r")).orderBy("i").collect()
    assert distances.rounded(np.array(x), 6).tolist() == [r.r for r in rows]


def test_lcp_of_copies(spark, monkeypatch):
    check_pairs(spark, monkeypatch, "lcp", lambda a, b, k: distances.lcp_distance(a, b, normalize=True), some(60, 13), normalize=True)


def test_dhd_of_copies(spark, monkeypatch):
    words = [EQUAL[x % 4 if x % 5 else 4 + x % 2] for x in range(60)]
    costs = distances.position_costs(pool(spark, *words))
    check_pairs(spark, monkeypatch, "dhd", lambda a, b, k: distances.dhd_distance(a, b, position_costs=costs), words)


def test_euclidean_of_copies(spark, monkeypatch):
    check_pairs(spark, monkeypatch, "euclidean", lambda a, b, k: distances.euclidean_distance(a, b, k), some(60, 14))


def test_unit_costs_of_copies(spark, monkeypatch):
    check_pairs(spark, monkeypatch, "om", lambda a, b, k: distances.optimal_matching_distance(a, b, sub_cost=1.0), some(60, 15), sub_cost=1.0)


def test_edit_distance_by_bits():
    rng = random.Random(3)
    a, b = ([np.array([rng.randrange(4) for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 130)))], int) for _ in range(60)] for _ in range(2))
    t = Batch(a, b)
    assert np.array_equal(levenshtein(t, 4), distances.KERNELS["om"](t, 4, sub_cost=1.0))


#: Metrics whose tasks send pairs by class, and their options.
PACKED: dict[str, dict] = {
    "hamming": {},
    "rlcp": {},
    "chi2": {},
    "lcp": {},
    "dhd": {},
    "euclidean": {},
    "om": {"sub_cost": 1.0},
}


@pytest.mark.parametrize("method", sorted(PACKED))
def test_tasks_send_pairs_by_class(spark, method):
    p = pool(spark, *[EQUAL[x // 100] for x in range(200)])
    source = distances.compute(p, method, **PACKED[method]).source
    assert source.metric and sent(distances.tile_rows(source.seqs, source.n, {"d": source.pairwise}, True, 6)) < 200 * 199 // 2 // 2
    assert source.pairs(6).distinct().count() == 200 * 199 // 2


@pytest.mark.parametrize("name", ["dist_chi2", "dist_dhd", "dist_euclidean", "dist_hamming", "dist_lcp", "dist_om_unit", "dist_rlcp"])
def test_written_pairs_keep_no_null_levels(spark, sf_dir, tmp_path, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    assert [f.name for f in found.schema if f.nullable] == []
    found.write.parquet(str(tmp_path / "out"))
    kinds = [pq.ParquetFile(f).schema for f in (tmp_path / "out").glob("*.parquet")]
    assert kinds and all(k.column(c).max_definition_level == 0 for k in kinds for c in range(3))
    again = spark.read.parquet(str(tmp_path / "out"))
    n = SequencePool(spark.read.parquet(f"{sf_dir}/events.parquet"), catalog.EVENTS).base.select("id").where("id is not null").distinct().count()
    assert again.where("id_a < id_b and distance is not null").distinct().count() == n * (n - 1) // 2


@pytest.mark.parametrize("method", ["chi2", "euclidean", "om"])
def test_pairs_of_a_packed_row_are_not_held_at_once(spark, method):
    p = pool(spark, *[EQUAL[x // 10] for x in range(20)])
    pairs = distances.compute(p, method, **PACKED[method]).source.pairs(6)
    assert len(pairs.collect()) == 20 * 19 // 2
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    explodes = [line.strip(" +-:") for line in plan.split("\n") if "Generate" in line and "ids_" in line]
    assert [line.startswith("*") for line in explodes if "posexplode" in line] == [True]
    assert [line.startswith("*") for line in explodes if "posexplode" not in line] == [False]


def test_pairs_of_ids_that_are_strings(spark):
    words = some(40, 6)
    rows = [(f"k{i:03}", t, s) for i, w in enumerate(words) for t, s in enumerate(w)]
    got = distances.compute(SequencePool(spark.createDataFrame(rows, "id string, time long, state string")), "lcp").rounded_pairs(6)
    assert not any(f.nullable for f in got.schema)
    assert {(r.id_a, r.id_b): r.distance for r in got.collect()} == {(f"k{i:03}", f"k{j:03}"): distances.lcp_distance(words[i], words[j]) for i in range(40) for j in range(i + 1, 40)}


def test_the_steps_of_a_day_are_made_once(spark, sf_dir):
    plan = catalog.hours(spark, sf_dir).base._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "parquet" not in plan.lower()


#: Metrics whose written pairs take few bytes, and their options.
SMALL_RESULTS: dict[str, dict] = {"euclidean": {}, "chi2": {}, "dhd": {}, "om": {"sub_cost": 1.0}}


@pytest.mark.parametrize("method", sorted(SMALL_RESULTS))
def test_ids_of_written_pairs_take_few_bytes(spark, tmp_path, monkeypatch, method):
    monkeypatch.setattr(distances, "TILES_A_CORE", 1)
    words = F.array(*(F.array(*map(F.lit, w)) for w in EQUAL))
    rows = spark.range(2048).select("id", F.posexplode(words[(F.col("id") % 6).cast("int")]).alias("time", "state"))
    pairs = distances.compute(SequencePool(rows.withColumn("time", F.col("time").cast("long"))), method, **SMALL_RESULTS[method]).rounded_pairs(6)
    pairs.write.parquet(str(tmp_path / "out"))
    groups = [m.row_group(g) for f in (tmp_path / "out").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 2048 * 2047 // 2 == spark.read.parquet(str(tmp_path / "out")).distinct().count()
    assert sum(g.column(c).total_compressed_size for g in groups for c in range(2)) < 0.27 * 2048 * 2047 // 2
