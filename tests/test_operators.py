"""Unit tests of the sequence operators: fixed values, naive versions, error contracts, edge cases."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwise.functions import Alphabet, SequenceConfig, SequencePool, StateSequence, coerce
from pathwise.operators import clustering, descriptive, discrepancy, distances, filters, mining, normative, transitions
from pathwise.sources import generate_financial_journeys, generate_markov_sequences, generate_simple_sequences, load_csv, load_dataframe, load_json, load_parquet, sample_intervals, save_csv, save_json, save_parquet


def pool(spark, *words, kind=SequencePool, alphabet=None):
    rows = [(i + 1, t, s) for i, w in enumerate(words) for t, s in enumerate(w)]
    return kind(spark.createDataFrame(rows, "id long, time long, state string"), alphabet=alphabet)


def values(frame, name):
    return [r[name] for r in frame.orderBy(frame.columns[0]).collect()]


@pytest.fixture(scope="module")
def simple(spark):
    return pool(spark, "AABC", "ABBC", "BBCD")


def test_alphabet():
    a = Alphabet(("b", "a", "b"))
    assert a.states == ("a", "b") and a.encode("ab") == [0, 1] and a.decode([1]) == ["b"] and "a" in a and len(a.colors) == 2
    with pytest.raises(ValueError):
        a.index_of("z")
    with pytest.raises(KeyError):
        a.encode("z")
    with pytest.raises(KeyError):
        a.get_color("z")
    assert a.with_colors(["#1", "#2"]).get_color("b") == "#2"
    assert a.n_states == 2 and a[1] == "b" and a[-1] == "b"
    assert a.with_colors({"b": "#9"}).get_color("b") == "#9" and a.with_colors({"b": "#9"}).get_color("a") == a.get_color("a")
    assert Alphabet(("b", "a"), {"a": "#1"}).get_color("a") == "#1"


def test_package_root():
    import pathwise

    assert pathwise.SequencePool is SequencePool and pathwise.Alphabet is Alphabet and pathwise.io.load_csv
    assert {"Alphabet", "SequenceConfig", "SequencePool", "StateSequence", "io"} <= set(pathwise.__all__)


def test_an_alphabet_has_a_bound(spark, monkeypatch):
    from pathwise.functions import model

    monkeypatch.setattr(model, "MAX_STATES", 3)
    frame = spark.createDataFrame([(str(k % 4),) for k in range(9)], "s string")
    with pytest.raises(ValueError, match="more than 3"):
        Alphabet.from_column(frame, "s")
    assert Alphabet.from_column(frame.where("s < '3'"), "s").n_states == 3


def test_shared_folder(spark, monkeypatch):
    from pathwise.functions import runtime

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)
    monkeypatch.setattr(Context, "master", "local[4]")
    assert runtime.shared_dir(Session)
    monkeypatch.setattr(Context, "getCheckpointDir", lambda self: "hdfs://x/y")
    assert runtime.shared_dir(Session) == "hdfs://x/y"
    assert runtime.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_pool_surface(spark, simple):
    assert len(simple) == 3 and simple.sequence_ids == [1, 2, 3] and simple[2] == list("ABBC") and simple.get_encoded_sequence(3) == [1, 1, 2, 3]
    d = simple.describe()
    assert (d["n_sequences"], d["total_observations"], d["mean_length"], d["states"]) == (3, 12, 4.0, list("ABCD"))
    assert len(simple.to_state_sequence()) == 12 and coerce(simple) is simple and list(simple) == [1, 2, 3]
    assert SequencePool.coerce(simple) is simple and isinstance(StateSequence.coerce(simple), StateSequence) and len(SequencePool.coerce(simple.data)) == 3
    assert simple.recode_states({"D": "C"}).alphabet.states == ("A", "B", "C")
    assert len(simple.sample(2, 1)) == 2 and simple.sample(2, 1).sequence_ids == simple.sample(2, 1).sequence_ids
    assert len(simple.filter_by_length(5)) == 0 and simple.filter_by_length(5).alphabet.states == tuple("ABCD")
    empty = SequencePool(simple.data.limit(0))
    assert empty.sequence_ids == [] and empty.describe()["max_length"] == 0 and math.isnan(descriptive.turbulence(empty))
    with pytest.raises(ValueError, match="Missing required column"):
        SequencePool(simple.data.drop("state"))
    with pytest.raises(ValueError, match="not in alphabet"):
        pool(spark, "AZ", kind=StateSequence, alphabet=Alphabet(("A",)))


def test_descriptive_values(simple):
    per = lambda f, name, **k: values(f(simple, per_sequence=True, **k), name)
    assert per(descriptive.spell_count, "n_spells") == [3, 3, 3] and per(descriptive.visited_states, "n_visited") == [3, 3, 3]
    assert per(descriptive.longitudinal_entropy, "entropy") == pytest.approx([0.75] * 3)
    assert per(descriptive.complexity_index, "complexity") == pytest.approx([0.612372] * 3, abs=1e-6)
    assert per(descriptive.turbulence, "turbulence") == pytest.approx([1.459432] * 3, abs=1e-6)
    assert descriptive.normalized_turbulence(simple) == pytest.approx(0.729716, abs=1e-6)
    assert descriptive.subsequence_count(simple) == 11.0 and per(descriptive.subsequence_count, "log2_n_subsequences", use_log=True) == pytest.approx([3.584963] * 3, abs=1e-6)
    assert per(descriptive.sequence_log_probability, "log_probability") == pytest.approx([-2.014903, -1.832581, -1.427116], abs=1e-6)
    assert descriptive.transition_count(simple) == 6 and descriptive.visited_proportion(simple) == 0.75 and descriptive.transition_proportion(simple) == pytest.approx(2 / 3)
    assert values(normative.objective_volatility(simple, per_sequence=True), "objective_volatility") == pytest.approx([0.666667] * 3, abs=1e-6)
    assert set(descriptive.describe_sequences(simple).columns) >= {"id", "length", "n_spells"}


def test_subsequence_counts_of_short_words(spark):
    assert values(descriptive.subsequence_count(pool(spark, "A", "ABC", "AAA"), per_sequence=True), "n_subsequences") == [1, 7, 3]


def test_normative_values(spark):
    p = pool(spark, "EEEE", "UUUU", "EUEU")
    assert values(normative.badness(p, ["U"], True), "badness") == [0, 1, 0.5]
    assert values(normative.degradation(p, ["E"], ["U"], True), "degradation") == pytest.approx([0, 0, 2 / 3])
    assert values(normative.volatility(p, ["E"], ["U"], True), "volatility") == [0, 0, 1]
    assert values(normative.precarity(p, ["U"], True), "precarity") == pytest.approx([0, 1, 0.6])
    assert values(normative.insecurity(p, ["U"], True), "insecurity") == pytest.approx([0, 1, np.mean([2 / 4, 2 / 3, 1 / 2, 1])])
    assert values(normative.integration(p, ["E"], True), "integration") == pytest.approx([1, 0, np.mean([1, 1 / 2, 2 / 3, 1 / 2])])
    q = pool(spark, "ABAB", alphabet=Alphabet(("A", "B", "C")))
    assert [normative.objective_volatility(q, w) for w in (0.5, 1, 0)] == pytest.approx([0.75, 0.5, 1])
    with pytest.raises(ValueError):
        normative.objective_volatility(q, 2)


def test_transitions(spark, simple):
    assert transitions.transition_rate_matrix(simple, as_counts=True).tolist() == [[1, 2, 0, 0], [0, 2, 3, 0], [0, 0, 0, 1], [0, 0, 0, 0]]
    assert {(r.id, r.first_time) for r in transitions.first_occurrence_time(pool(spark, "ABC", "BCA", "AAB"), "C").collect()} == {(1, 2), (2, 1)}
    with pytest.warns(DeprecationWarning):
        transitions.state_duration_stats(simple)
    for method in ("trate", "indels", "future", "features"):
        with pytest.raises(ValueError):
            transitions.build_substitution_matrix(3, method)
    with pytest.raises(ValueError):
        transitions.build_substitution_matrix(3, "none")


def test_spells_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, 0, "A"), (1, 1, None), (1, 2, "A"), (1, 3, "A"), (2, 5, "B"), (2, 5, "A")]
    s = StateSequence(spark.createDataFrame(rows, "id long, time long, state string").withColumn("spell_id", F.lit("x")).withColumn("duration", F.lit(0)))
    sps = [(r.id, r.spell_id, r.state, r.start, r.end, r.duration) for r in s.to_sps().orderBy("spell_id").collect()]
    assert sps == [(1, 1, "A", 0, 0, 1), (1, 2, None, 1, 1, 1), (1, 3, "A", 2, 3, 2), (2, 4, "A", 5, 5, 1), (2, 5, "B", 5, 5, 1)]
    assert s.to_dss().count() == 5 and "spell_id" in s.to_dss().columns
    assert s.alphabet.states == ("A", "B")


def test_granularity(spark):
    t = lambda *a: datetime.datetime(2024, *a)
    df = spark.createDataFrame([(1, t(1, 3, 10), "A"), (1, t(1, 3, 23), "B"), (1, t(5, 31, 1), "B")], "id long, time timestamp_ntz, state string")
    for g, want in (("1d", [t(1, 3), t(1, 3), t(5, 31)]), ("1w", [t(1, 1), t(1, 1), t(5, 27)]), ("1mo", [t(1, 1), t(1, 1), t(5, 1)]), ("1q", [t(1, 1), t(1, 1), t(4, 1)]), ("2mo", [t(1, 1), t(1, 1), t(5, 1)]), ("12h", [t(1, 3), t(1, 3, 12), t(5, 31)])):
        got = StateSequence(df, SequenceConfig(granularity=g)).data.select(F.col("time").cast("timestamp_ntz").alias("t")).collect()
        assert sorted(r.t for r in got) == want, g
    with pytest.raises(ValueError):
        StateSequence(spark.createDataFrame([(1, 1, "A")], "id long, time long, state string"), SequenceConfig(granularity="1d"))
    with pytest.raises(TypeError):
        descriptive.modal_states(SequencePool(df), 5)


def test_intervals(spark):
    iv = lambda rows: spark.createDataFrame(rows, "id long, start long, end long, state string")
    out = lambda s: sorted((r.id, r.time, r.state) for r in s.data.collect())
    a = iv([(1, 0, 3, "A"), (1, 5, 8, "B"), (2, 0, 3, "X"), (2, 3, 6, "Y")])
    assert out(sample_intervals(a, time_points=[0, 2, 5, 7])) == [(1, 0, "A"), (1, 2, "A"), (1, 5, "B"), (1, 7, "B"), (2, 0, "X"), (2, 2, "X"), (2, 5, "Y")]
    assert [t for _, t, _ in out(sample_intervals(iv([(1, 0, 3, "A"), (1, 4, 6, "B")])))] == [0, 1, 2, 4, 5]
    shadow = out(sample_intervals(iv([(1, 0, 10, "E"), (1, 4, 8, "L")])))
    assert (1, 5, "L") in shadow and not {8, 9} & {t for _, t, _ in shadow}
    rng = random.Random(6)
    rows = [(rng.randrange(5), a := rng.randrange(30), a + rng.randrange(8), rng.choice("ABC")) for _ in range(80)] + [(9, None, 4, "A"), (9, 1, None, "B"), (None, 2, 4, "C"), (4, 3, 9, None)]
    default, given = (sample_intervals(iv(rows), time_points=points).data for points in (None, list(range(40))))
    assert default.count() == given.count() > 100 and default.exceptAll(given).count() == 0
    with pytest.raises(ValueError):
        sample_intervals(iv([(1, 3, 1, "A")]))
    with pytest.raises(ValueError, match="explicit time_points"):
        sample_intervals(spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2), "A")], "id long, start timestamp_ntz, end timestamp_ntz, state string"))


def test_filters(spark):
    p = pool(spark, "ABBC", "AAC", "BCCDD")
    ids = lambda *c, combine="and": filters.filter_sequences(p, list(c), combine).sequence_ids
    assert ids(filters.LengthCriterion(4)) == [1, 3] and ids(filters.LengthCriterion(1, 9, exact_length=3)) == [2]
    assert ids(filters.ContainsStateCriterion(["D"])) == [3] and ids(filters.ContainsStateCriterion(["A", "B"], require_all=True)) == [1] and ids(filters.ContainsStateCriterion(["A"], exclude=True)) == [3]
    assert ids(filters.ContainsStateCriterion([])) == [] and ids(filters.StartsWithCriterion([])) == [1, 2, 3] and ids(filters.StartsWithCriterion(["A", "A"])) == [2]
    assert ids(filters.QueryCriterion("time = 4")) == [3] and ids(filters.TimeCriterion(contains_time=3)) == [1, 3] and ids(filters.TimeCriterion(end_after=2, end_before=4)) == [1]
    assert ids() == [1, 2, 3] and ids(combine="or") == [] and ids(filters.LengthCriterion(5), filters.StartsWithCriterion(["A"]), combine="or") == [1, 2, 3]
    with pytest.raises(ValueError):
        ids(combine="xor")


# --- distances -------------------------------------------------------------------------------------

SMALL = {
    "om": (2, 2, 4), "hamming": (1, 2, 2), "lcs": (2, 2, 4), "lcp": (4, 6, 6), "rlcp": (4, 4, 4), "euclidean": (0.471405, 0.471405, 0.816497), "chi2": (0.666667, 0.666667, 1.666667), "dtw": (1, 1, 2),
    "softdtw": (-0.788615, -0.285271, 0.211385), "twed": (2, 2.004, 4), "dhd": (0.555556, 0.666667, 0.666667), "omloc": (2, 2, 4), "omspell": (1.414214, 2, 2.414214), "omstran": (2, 2, 4),
    "nms": (0.545455, 0.545455, 0.818182), "nmsmst": (0.430197, 0.430197, 0.818182), "svrspell": (2, 2, 4),
}


@pytest.mark.parametrize("method", sorted(SMALL))
def test_distances_of_the_small_pool(spark, method):
    dm = distances.compute(pool(spark, "ABC", "AAC", "BCC"), method)
    assert [dm[0, 1], dm[0, 2], dm[1, 2]] == pytest.approx(SMALL[method], abs=1e-6)
    assert np.allclose(dm.values, dm.values.T) and not dm.values.diagonal().any()


def naive_edit(a, b, indel, sub):
    d = [[j * indel for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        d.append([i * indel])
        for j, y in enumerate(b, 1):
            d[i].append(min(d[i - 1][j] + indel, d[i][j - 1] + indel, d[i - 1][j - 1] + sub(i - 1, j - 1)))
    return d[-1][-1]


def test_kernels_equal_naive_versions():
    rng = random.Random(1)
    a = [[rng.randrange(3) for _ in range(rng.randrange(0, 7))] for _ in range(60)]
    b = [[rng.randrange(3) for _ in range(rng.randrange(0, 7))] for _ in range(60)]
    t = distances.Batch([np.array(x, int) for x in a], [np.array(x, int) for x in b])
    om = distances.KERNELS["om"](t, 3, indel=0.7, sub_cost=1.1)
    assert om == pytest.approx([naive_edit(x, y, 0.7, lambda i, j, x=x, y=y: 1.1 * (x[i] != y[j])) for x, y in zip(a, b)])
    sm = np.array([[0, 1, 3], [1, 0, 0.5], [3, 0.5, 0]])
    assert distances.KERNELS["om"](t, 3, sm=sm) == pytest.approx([naive_edit(x, y, 1, lambda i, j, x=x, y=y: sm[x[i], y[j]]) for x, y in zip(a, b)])
    assert distances.KERNELS["omloc"](t, 3, context_factor=0.0) == pytest.approx(distances.KERNELS["om"](t, 3))
    assert distances.KERNELS["omstran"](t, 3, otto=0.0) == pytest.approx(distances.KERNELS["om"](t, 3))

    def dtw(x, y, w):
        if not x or not y:
            return 0.0 if x == y else math.inf
        d = {(0, 0): 0.0}
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                if not w or abs(i - j) <= w:
                    d[i, j] = (x[i - 1] != y[j - 1]) + min(d.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        return d.get((len(x), len(y)), math.inf)

    for w in (0, 1, 3):
        assert list(distances.KERNELS["dtw"](t, 3, window=w)) == pytest.approx([dtw(x, y, w) for x, y in zip(a, b)])


def test_single_pair_functions():
    assert distances.optimal_matching_distance([0] * 4, [1] * 4) == 8 and distances.optimal_matching_distance([0] * 4, [1] * 4, normalize=True) == 2
    assert distances.optimal_matching_distance([0, 1, 2], []) == 3 and distances.lcs_length([0, 0, 1, 2], [0, 1, 1, 2]) == 3 and distances.lcs_similarity([0, 0, 1, 2], [0, 1, 1, 2]) == 0.75
    assert (distances.dtw_distance([0, 1], [1, 0]), distances.dtw_distance([1, 0], [0, 0]), distances.dtw_distance([0, 1], [0, 0])) == (2, 1, 1)
    assert distances.lcp_similarity([], []) == 1 and distances.lcp_similarity([1], []) == 0 and distances.rlcp_length([1, 2], [3, 2]) == 1
    assert math.isinf(distances.dtw_distance([0], [])) and distances.nms_distance([0], []) == 1 and distances.svrspell_distance([0, 0, 1], [0, 1, 1]) == 2
    assert distances.softdtw_divergence([0, 1], [0, 1]) == pytest.approx(0) and distances.chi2_distance([0, 1], [0, 0]) == pytest.approx((1 / 3 + 1) / 2)
    with pytest.raises(ValueError):
        distances.softdtw_distance([0], [1], gamma=0)
    with pytest.raises(ValueError):
        distances.optimal_matching_distance([0, 2], [1], sm=np.zeros((2, 2)))
    with pytest.raises(ValueError):
        distances.hamming_distance([0], [0, 1])


def test_distance_contracts(spark, monkeypatch):
    p = pool(spark, "ABC", "AAC", "BC")
    with pytest.raises(ValueError, match="Unknown method"):
        distances.compute(p, "none")
    with pytest.raises(ValueError, match="equal length"):
        distances.compute(p, "hamming")
    with pytest.raises(TypeError):
        distances.compute(p, "nmsmst", normalize=True)
    dm = distances.compute(p, "om", sub_cost=1.0)
    assert dm.get_distance(1, 3) == 1 and distances.DistanceMatrix.from_condensed(dm.to_condensed()).values.tolist() == dm.values.tolist()
    with pytest.raises(ValueError):
        distances.DistanceMatrix(values=np.zeros((2, 3)))
    with pytest.raises(ValueError):
        distances.DistanceMatrix(values=np.zeros((2, 2))).get_distance(0, 1)
    rng = random.Random(2)
    many = pool(spark, *("".join(rng.choice("ABC") for _ in range(rng.randrange(1, 9))) for _ in range(40)))
    whole = {method: distances.compute(many, method).values for method in ("om", "lcp")}
    monkeypatch.setattr(distances, "BLOCK", 3)
    for method, values in whole.items():
        again = distances.compute(many, method)
        assert again.pairs.count() == 40 * 39 // 2 and np.allclose(again.values, values)
    monkeypatch.setattr(distances, "MAX_DENSE", 39)
    with pytest.raises(ValueError, match="clara_pool"):
        distances.compute(many, "om").values  # noqa: B018


def test_tiles_are_dealt_to_many_tasks(spark):
    assert distances.grid(0, 8) == (1, 1) and distances.grid(5, 8) == (1, 1)
    for n in (150, 1500, 10**6):
        g, tasks = distances.grid(n, 8)
        assert tasks >= 64 and math.ceil(n / g) <= distances.BLOCK
    rng = random.Random(4)
    many = pool(spark, *("".join(rng.choice("ABC") for _ in range(rng.randrange(1, 9))) for _ in range(120)))
    for method in ("om", "lcp"):
        busy = distances.compute(many, method).pairs.select(F.spark_partition_id()).distinct().count()
        assert busy >= 16


@pytest.mark.parametrize("method", sorted(SMALL))
def test_null_states_and_ids_in_distances(spark, method):
    """A null state is one more state, an id that is null names no sequence."""
    rows = [(k, t, None if s == "-" else s) for k, text in ((1, "A-C"), (2, "AAC"), (3, "-CC"), (None, "ABC")) for t, s in enumerate(text)]
    with_null = distances.compute(SequencePool(spark.createDataFrame(rows, "id long, time long, state string")), method)
    named = distances.compute(pool(spark, "AZC", "AAC", "ZCC"), method)
    assert with_null.labels == [1, 2, 3]
    assert np.allclose(with_null.values, named.values) and np.isfinite(named.values).all()


def test_null_states_need_a_place_in_a_given_cost_matrix(spark):
    nulls = SequencePool(spark.createDataFrame([(1, 0, "A"), (1, 1, None), (2, 0, "B")], "id long, time long, state string"))
    with pytest.raises(ValueError, match="too small"):
        distances.compute(nulls, "om", sm=np.ones((2, 2)))
    assert distances.compute(nulls, "om", sm=np.ones((3, 3)) - np.eye(3)).get_distance(1, 2) == 2
    rows, medoids = clustering.clara_pool(nulls, 1)
    assert rows.count() == 2 and len(medoids) == 1


# --- clustering, discrepancy, mining ---------------------------------------------------------------

FOUR = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 1], [5, 5, 1, 0]], float)


def scattered(n=20, seed=42):
    x = np.random.default_rng(seed).random((n, n))
    x = (x + x.T) / 2
    np.fill_diagonal(x, 0)
    return x


def test_pam_takes_the_best_swaps():
    r = clustering.pam_clustering(FOUR, 2, sequence_ids=list("abcd"))
    assert r.labels.tolist() in ([0, 0, 1, 1], [1, 1, 0, 0]) and r.total_cost == 2 and sorted(r.cluster_sizes.values()) == [2, 2]
    d = scattered()
    r = clustering.pam_clustering(d, 3)
    cost = d[:, r.medoid_indices].min(1).sum()
    for m in range(3):
        for x in set(range(20)) - set(r.medoid_indices.tolist()):
            swapped = [x if k == m else v for k, v in enumerate(r.medoid_indices)]
            assert d[:, swapped].min(1).sum() >= cost - 1e-12
    for init in ("random", "k-medoids++"):
        assert len(set(clustering.pam_clustering(d, 3, init=init, random_state=0).medoid_indices.tolist())) == 3
    for bad in (dict(n_clusters=9), dict(n_clusters=2, init="none"), dict(n_clusters=2, sequence_ids=[1])):
        with pytest.raises(ValueError):
            clustering.pam_clustering(FOUR, **bad)
    m = clustering.PAMClustering(2)
    with pytest.raises(ValueError):
        m.predict(FOUR)
    assert m.fit(FOUR).predict(FOUR).tolist() == m.labels_.tolist()
    assert clustering.clara_clustering(d, 3, random_state=1).total_cost >= cost - 1e-9


@pytest.mark.parametrize("method", ["ward", "complete", "average", "single"])
def test_linkage_equals_a_naive_search(method):
    d = scattered(12, 7)
    merges = clustering._linkage(d, method)
    groups, names = [[i] for i in range(12)], list(range(12))

    def between(a, b):
        x = d[np.ix_(a, b)]
        if method == "ward":
            ss = lambda g: (d[np.ix_(g, g)] ** 2).sum() / (2 * len(g))
            return math.sqrt(max(0, 2 * (ss(a + b) - ss(a) - ss(b))))
        return {"single": x.min, "complete": x.max, "average": x.mean}[method]()

    for k, (a, b, h, size) in enumerate(merges):
        i, j = names.index(a), names.index(b)
        best = min(between(x, y) for n, x in enumerate(groups) for y in groups[:n])
        assert h == pytest.approx(between(groups[i], groups[j])) and h == pytest.approx(best) and size == len(groups[i]) + len(groups[j])
        merged = groups[i] + groups[j]
        groups, names = [g for n, g in enumerate(groups) if n not in (i, j)] + [merged], [x for n, x in enumerate(names) if n not in (i, j)] + [12 + k]
    r = clustering.hierarchical_clustering(FOUR, 2, method)
    assert r.labels.tolist() in ([0, 0, 1, 1], [1, 1, 0, 0])
    with pytest.raises(ValueError):
        clustering.hierarchical_clustering(FOUR, 2, "none")


def test_quality():
    d = np.array([[0, 0.1, 1, 1.1], [0.1, 0, 1.1, 1], [1, 1.1, 0, 0.1], [1.1, 1, 0.1, 0]])
    q = clustering.cluster_quality(d, [0, 0, 1, 1])
    assert q["ASW"] > 0.85 and q["PBC"] < -0.9 and q["HG"] == -q["PBC"] and q["R2"] > 0.9
    assert clustering.silhouette_scores(d, [0, 0, 0, 1])[3] == 1 and not clustering.silhouette_scores(d, [0] * 4).any()
    assert clustering.distance_to_center(d, [0, 0, 1, 2]).tolist() == [0.1, 0.1, 0, 0]
    assert [r["k"] for r in clustering.pam_range(scattered(), clustering.k_range(1, 4))] == [2, 3, 4]
    with pytest.warns(DeprecationWarning):
        assert len(clustering.pam_range(d, (2, 3))) == 2
    with pytest.raises(TypeError):
        clustering.pam_range(d, [2], k_range=[2])
    r = clustering.extract_representatives(scattered(), 5, labels=[0] * 10 + [1] * 10)
    assert len(r.indices) == 5 and (r.cluster_labels == [0, 0, 0, 1, 1]).all()
    for s in ("centrality", "frequency", "density"):
        assert len(set(clustering.extract_representatives(scattered(), 4, s).indices.tolist())) == 4
    with pytest.raises(ValueError):
        clustering.extract_representatives(d, 1, "none")


def test_discrepancy_and_tree():
    r = discrepancy.discrepancy_analysis(FOUR, [0, 0, 1, 1], 99, 1)
    assert r.ss_total == pytest.approx((FOUR**2).sum() / 8) and r.ss_within == pytest.approx(1.0) and 0 < r.p_value <= 1
    perfect = np.array([[0, 0, 5, 5], [0, 0, 5, 5], [5, 5, 0, 0], [5, 5, 0, 0]], float)
    with pytest.warns(UserWarning):
        r = discrepancy.discrepancy_analysis(perfect, [0, 0, 1, 1], 199, 1)
    assert math.isinf(r.pseudo_f) and r.p_value > 0.1
    x = np.where(np.arange(20)[:, None] // 10 == np.arange(20)[None, :] // 10, 0.3, 3.0)
    np.fill_diagonal(x, 0)
    t = discrepancy.dissimilarity_tree(x, np.arange(20.0), ["age"])
    assert t.root.split_variable == "age" and t.root.split_value == 9 and t.leaf_labels[0] != t.leaf_labels[19]
    assert discrepancy.dissimilarity_tree(x, np.array(["a"] * 10 + ["b"] * 10)).n_leaves >= 2


def test_mining(spark):
    got = {tuple(r.subsequence): r.support for r in mining.frequent_subsequences(pool(spark, "ABC", "ABC", "ACB"), 0.67).collect()}
    assert got == {("A",): 3, ("B",): 3, ("C",): 3, ("A", "B"): 3, ("A", "C"): 3, ("B", "C"): 2, ("A", "B", "C"): 2}
    rules = {(tuple(r.antecedent), tuple(r.consequent)): r for r in mining.association_rules(pool(spark, "ABC", "ABD", "ABC", "ACD"), 0.1).collect()}
    r = rules[("B",), ("C",)]
    assert (r.support, r.confidence, r.lift, r.leverage, r.conviction) == pytest.approx((0.5, 2 / 3, 8 / 9, -0.0625, 0.75))


# --- sources ---------------------------------------------------------------------------------------


def test_round_trips(spark, simple, tmp_path):
    rows = sorted(map(tuple, simple.data.collect()))
    for save, load, name in ((save_csv, load_csv, "c"), (save_json, load_json, "j"), (save_parquet, load_parquet, "p")):
        save(simple, str(tmp_path / name))
        assert sorted((r.id, r.time, r.state) for r in load(spark, str(tmp_path / name)).data.collect()) == rows
    with pytest.raises(ValueError):
        save_parquet(simple, str(tmp_path / "x"), "none")
    (tmp_path / "a.json").write_text('[{"id": 1, "time": 0, "state": "A"}, {"id": 1, "time": 1, "state": "B"}]')
    (tmp_path / "b.json").write_text('{"id": [1, 1], "time": [0, 1], "state": ["A", "B"]}')
    for f in ("a.json", "b.json"):
        assert load_json(spark, str(tmp_path / f))[1] == ["A", "B"]
    nulls = spark.createDataFrame([(1, 0, "A"), (1, 1, None), (1, 2, "B")], "id long, time long, state string")
    assert load_dataframe(nulls, drop_nulls=True)[1] == ["A", "B"]
    with pytest.raises(ValueError):
        load_dataframe(nulls, alphabet=Alphabet(("A",)))


def test_generators(spark):
    a, b = (generate_markov_sequences(spark, 200, 15, np.array([[0.9, 0.1], [0.5, 0.5]]), ["x", "y"], seed=3) for _ in range(2))
    assert sorted(a.data.collect()) == sorted(b.data.collect())
    assert transitions.transition_rate_matrix(a)[0, 0] == pytest.approx(0.9, abs=0.03)
    assert generate_simple_sequences(spark, 50, 7, 3, seed=1).describe()["states"] == ["A", "B", "C"]
    rows = generate_financial_journeys(spark, 60, seed=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert len(by) == 60
    for rs in by.values():
        rs.sort(key=lambda r: r.time)
        assert rs[0].state == "lead" and len({r.time for r in rs}) == len(rs) <= 365
        assert all(r.state not in ("closed_voluntary", "closed_involuntary", "kyc_rejected") for r in rs[:-1])
        assert all(r.date.timetuple().tm_yday - 1 == r.time for r in rs)


def test_running_transitions(spark, tmp_path):
    from pathwise.streaming import observations, running_transitions

    src = str(tmp_path / "in")
    first = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, "C")], "id long, time long, state string")
    first.coalesce(1).write.parquet(src)
    spark.createDataFrame([(1, 2, "B"), (2, 1, "A")], first.schema).coalesce(1).write.mode("append").parquet(src)
    stream = running_transitions(observations(spark, src, first.schema, max_files=1))
    q = stream.writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("moves").collect())) == [(1, "A", "B"), (1, "B", "B"), (2, "C", "A")]
