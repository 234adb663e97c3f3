"""Fitted parts: transforms, clusters, trees, training and their saved forms."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog import load
from holdfast.operators import clustering, encoding, power, sampling, segments, survival
from holdfast.operators.treeshap import Node, TreeEnsemble
from holdfast.plans import explain, segmentation, training
from holdfast.plans.scored import featured_accounts, scored_accounts


def test_scaler_uses_population_deviation_and_guards_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    encoder = encoding.fit_encoder(df, ["a", "b"], [])
    rows = encoder.transform(df).select(vector_to_array("features").alias("x")).collect()
    assert sorted(r.x for r in rows) == [[-1.0, 0.0], [1.0, 0.0]]


def test_one_hot_keeps_all_levels_and_zeroes_unknown(spark, tmp_path):
    train = spark.createDataFrame([(1.0, "x'y"), (2.0, "z")], "a double, c string")
    encoder = encoding.fit_encoder(train, ["a"], ["c"])
    assert encoder.names == ["num__a", "cat__c_x'y", "cat__c_z"]
    encoder.model().write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    new = spark.createDataFrame([(1.5, "new"), (1.5, "x'y")], "a double, c string")
    rows = again.transform(new).select(vector_to_array("features").alias("x")).collect()
    assert [r.x for r in rows] == [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]


def test_weight_of_evidence_groups_rare_levels(spark):
    rows = [("a", 1)] * 30 + [("a", 0)] * 30 + [("b", 1)] * 10 + [("b", 0)] * 26 + [("c", 1)] * 4
    df = spark.createDataFrame(rows, "c string, label int")
    encoder = encoding.fit_encoder(df, [], ["c"], use_woe=True)
    pos, neg = 44, 56
    want = {"a": np.log((30 / pos) / (30 / neg)), "b": np.log((10 / pos) / (26 / neg)),
            "Rare": np.log((4 / pos) / 0.0001)}
    assert encoder.woe["c"] == pytest.approx(want)
    new = spark.createDataFrame([("a",), ("c",), ("unseen",)], "c string")
    got = [r.x[0] for r in encoder.transform(new).select(vector_to_array("features").alias("x")).collect()]
    assert got == pytest.approx([want["a"], want["Rare"], want["Rare"]])


def _yeo(x, e):
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if e == 0 else ((x[up] + 1) ** e - 1) / e
    out[~up] = -np.log1p(-x[~up]) if e == 2 else -((1 - x[~up]) ** (2 - e) - 1) / (2 - e)
    return out


def test_power_transform_finds_the_best_exponent(spark):
    rng = np.random.default_rng(0)
    x = rng.lognormal(size=800) - 0.6
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    fitted = power.fit_power(df, ["v"])

    def likelihood(e):
        return -len(x) / 2 * np.log(_yeo(x, e).var()) + (e - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.linspace(-3, 3, 6001)
    best = grid[np.argmax([likelihood(e) for e in grid])]
    assert fitted.exponents["v"] == pytest.approx(best, abs=2e-3)
    y = np.array([r[0] for r in fitted.stage().transform(df).select("pt__v").collect()])
    assert abs(y.mean()) < 1e-9
    assert y.std() == pytest.approx(1.0)
    row = spark.createDataFrame([(-0.5, 0.0, 2.0), (3.0, 0.0, 2.0)], "x double, e0 double, e2 double")
    cells = row.select(power.yeo_johnson(F.col("x"), F.col("e0")), power.yeo_johnson(F.col("x"), F.col("e2"))).collect()
    want = [[_yeo(np.array([v]), e)[0] for e in (0, 2)] for v in (-0.5, 3.0)]
    assert np.allclose([list(c) for c in cells], want)


def test_euclidean_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(m, 1, size=(40, 2)) for m in (0, 4, 9)] + [[[30.0, 30.0]]])
    c = [0] * 40 + [1] * 40 + [2] * 40 + [3]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, c, strict=True))],
                               "k long, x array<double>, cluster int")
    got = {r.k: r.silhouette for r in clustering.euclidean_silhouette(df, "k", "x", block=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    c = np.array(c)
    for i in range(len(x)):
        if c[i] == 3:
            assert got[i] == 0.0
            continue
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_cluster_names(spark):
    rows = [(0, 50.0, 40.0), (1, 5.0, 90.0), (2, 30.0, 60.0), (3, 31.0, 20.0)]
    profile = spark.createDataFrame(rows, "cluster int, avg_tenure double, avg_monthly double")
    names = {r.cluster: r.customer_segment for r in segments.name_clusters(profile).collect()}
    assert names == {1: S.NEW, 0: S.VETERAN, 2: S.AT_RISK, 3: S.MID_TIER}


def test_segments_fit_save_and_load(spark, sf_dir, tmp_path):
    df = scored_accounts(spark, sf_dir).drop("cluster", "customer_segment").persist()
    fitted = segmentation.fit_segments(df, n_init=2)
    rows = segmentation.segment_rows(fitted, df)
    assert rows.count() == df.count()
    assert {r[0] for r in rows.select("customer_segment").distinct().collect()} == {S.NEW, S.AT_RISK, S.MID_TIER, S.VETERAN}
    means = rows.agg(F.avg("pca1"), F.avg("pca2")).first()
    assert max(abs(m) for m in means) < 1e-6
    fitted.save(str(tmp_path / "segments"))
    again = segmentation.FittedSegments.load(str(tmp_path / "segments")).transform(df)
    key = ["account_id", "cluster"]
    assert rows.select(*key).exceptAll(again.select(*key)).isEmpty()


def test_survival_reaches_zero_and_stays(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1)], "tenure int, Churn_Numeric int")
    curve = survival.survival_curve(df).orderBy("time").collect()
    assert [r.survival for r in curve] == pytest.approx([0.75, 0.75, 0.0])
    assert [r.at_risk for r in curve] == [4, 3, 2]
    assert all(r.lower <= r.survival <= r.upper for r in curve)
    assert survival.survival_at(survival.survival_curve(df), 0.5).first()[0] == 1.0
    assert survival.survival_at(survival.survival_curve(df), 2.5).first()[0] == pytest.approx(0.75)


def _expected(node, x, known):
    if node.feature is None:
        return node.value
    if node.feature in known:
        return _expected(node.left if x[node.feature] <= node.threshold else node.right, x, known)
    shares = [c.cover / node.cover if node.cover else 0.0 for c in (node.left, node.right)]
    return sum(w * _expected(c, x, known) for w, c in zip(shares, (node.left, node.right), strict=True))


def _shapley(root, x, n):
    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            weight = factorial(size) * factorial(n - size - 1) / factorial(n)
            for known in combinations(others, size):
                phi[i] += weight * (_expected(root, x, {*known, i}) - _expected(root, x, set(known)))
    return phi


def test_tree_attributions_equal_the_definition():
    def leaf(cover, value):
        return Node(cover, value)

    # Feature 0 is split twice on one path.
    deep = Node(40, feature=0, threshold=0.5, left=leaf(15, 2.0), right=leaf(25, -1.0))
    root = Node(100, feature=0, threshold=1.5, left=Node(70, feature=1, threshold=0.0, left=deep, right=leaf(30, 0.5)),
                right=Node(30, feature=2, threshold=-1.0, left=leaf(10, 4.0), right=leaf(20, -3.0)))
    ensemble = TreeEnsemble()
    ensemble.add(root, 0.7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) * 2
    got = ensemble.attribute(x)
    for row, phi in zip(x, got, strict=True):
        assert np.allclose(phi, 0.7 * _shapley(root, row, 4))
    assert ensemble.base_value == pytest.approx(0.7 * _expected(root, x[0], set()))


def test_attributions_of_deep_trees_equal_the_definition():
    """Random trees with paths of up to nine features, repeated features and empty covers among them."""
    rng = np.random.default_rng(7)

    def grown(depth, cover):
        if depth == 0 or rng.random() < 0.15:
            return Node(cover, value=float(rng.normal()))
        left = float(rng.integers(0, int(cover) + 1))
        sides = [grown(depth - 1, c) for c in (left, cover - left)]
        return Node(cover, feature=int(rng.integers(0, 9)), threshold=float(rng.normal()), left=sides[0], right=sides[1])

    def spine(depth):
        node = Node(1.0, value=3.0)
        for f in range(depth):
            node = Node(node.cover + 2, feature=f, threshold=0.0, left=node, right=Node(2.0, value=float(rng.normal())))
        return node

    x = rng.normal(size=(6, 9))
    for root in [*(grown(5, 40.0) for _ in range(4)), spine(9)]:
        ensemble = TreeEnsemble()
        ensemble.add(root)
        for row, phi in zip(x, ensemble.attribute(x), strict=True):
            assert np.allclose(phi, _shapley(root, row, 9))


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    rows = training.labelled(featured_accounts(spark, sf_dir))
    split = sampling.stratified_split(rows, S.KEY, "label").persist()
    return split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")


def test_logistic_saves_scores_and_balances(spark, parts, tmp_path):
    train, test = parts
    ready = training.prepare(train, ratio=1.0)
    shares = {r.label: r["count"] for r in ready.balanced.groupBy("label").count().collect()}
    assert shares[0.0] == shares[1.0]
    model = ready.fit(training.logistic(ready.n))
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    a = training.scorer(model)(test).orderBy("account_id").collect()
    b = training.scorer(again)(test).orderBy("account_id").collect()
    assert [r.churn_prob for r in a] == [r.churn_prob for r in b]
    assert all(0 <= r.churn_prob <= 1 for r in a)
    row = training.evaluate(model, test).first()
    assert set(row.asDict()) == {"accuracy", "precision", "recall", "f1", "roc_auc"}


def test_boosted_model_attributions_add_up(spark, parts):
    train, test = parts
    ready = training.prepare(train, ratio=None)
    model = ready.fit(training.boosted_trees({"n_estimators": 4, "max_depth": 3}))
    rows = explain.explain_rows(model, test).collect()
    names = explain.feature_names(model)
    assert len(rows) == test.count()
    for r in rows:
        assert len(r.phi) == len(names)
        odds = np.log(r.churn_prob / (1 - r.churn_prob))
        assert r.base_value + sum(r.phi) == pytest.approx(odds, abs=1e-9)


def test_random_search(spark, parts):
    train, _ = parts
    space = {"n_estimators": [2], "max_depth": [2, 3], "learning_rate": [0.1], "gamma": [0, 0.1]}
    table, model = training.random_search(train, space=space, n_iter=2, folds=2)
    rows = table.collect()
    assert len(rows) == 2
    assert sum(r.best for r in rows) == 1
    assert all(r.mean_auc == pytest.approx((r.fold_0 + r.fold_1) / 2) for r in rows)
    assert model.stages[-1].getNumTrees == 2


def test_fits_have_a_scan_for_a_plan(spark, parts):
    """Kept tables behind kept tables made plans of hundreds of megabytes of text in the driver."""
    train, _ = parts
    plan = training.prepare(train).balanced._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and "Join" not in plan and len(plan) < 10_000


def test_registered_models_run_the_library_defaults(spark, sf_dir, monkeypatch):
    """What each registered query passes on, beyond its rows; nothing is fitted."""
    asked = []

    class Asked(Exception):
        pass

    def note(name):
        def call(*rows, **options):
            asked.append((name, rows, options))
            raise Asked

        return call

    for name in ("compare_baselines", "random_search", "boosted_trees"):
        monkeypatch.setattr(training, name, note(name))
    monkeypatch.setattr(segmentation, "choose_k", note("choose_k"))
    queries = load()[0]
    for name in ("model_search", "model_forest", "tree_segment_drivers", "tree_local_accuracy", "choose_k"):
        with pytest.raises(Asked):
            queries[name](spark, sf_dir)
    assert [(name, len(rows), options) for name, rows, options in asked] == [
        ("random_search", 1, {}),
        ("compare_baselines", 2, {"only": ["Random Forest"]}),
        ("boosted_trees", 0, {}),
        ("boosted_trees", 0, {}),
        ("choose_k", 1, {}),
    ]


def test_search_space_size_and_draws():
    draws = training.draw_settings(training.SEARCH_SPACE, 20)
    assert len(draws) == 20
    assert len({str(d) for d in draws}) == 20
    assert np.prod([len(v) for v in training.SEARCH_SPACE.values()]) == 8640


def test_long_paths_are_explained():
    """A path of 13 features: attributions add up, and the table and the per-batch way agree."""
    rng = np.random.default_rng(3)

    def chain(features):
        node = Node(cover=1.0, value=2.5)
        for f in reversed(range(features)):
            node = Node(cover=node.cover * 2, feature=f, threshold=0.0, left=node, right=Node(node.cover, value=0.1 * f))
        return node

    x = rng.normal(size=(40, 13))
    long = TreeEnsemble()
    long.add(chain(13))
    phi = long.attribute(x)
    for row, parts in zip(x, phi, strict=True):
        positive = np.flatnonzero(row > 0)
        value = 0.1 * positive[0] if len(positive) else 2.5
        assert long.base_value + parts.sum() == pytest.approx(value)
    short = TreeEnsemble()
    short.add(chain(4))
    for leaf in short.leaves:
        meets = (np.arange(2 ** len(leaf.features))[:, None] >> np.arange(len(leaf.features))) & 1
        assert leaf.rows(meets).shape == meets.shape
    assert short.attribute(x[:, :4]).shape == (40, 4)


def test_power_exponents_have_no_fixed_range(spark):
    """Narrow data far from zero: the best exponent lies far outside the first grid, and is a maximum."""
    rng = np.random.default_rng(1)
    x = 5.0 + np.exp(rng.normal(0, 0.5, 400)) * 1.2
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    best = power.fit_power(df, ["x"]).exponents["x"]
    assert best < -4
    around = [best - 0.5, best, best + 0.5]
    curve = {r.exponent: r.log_likelihood for r in power.log_likelihoods(df, {"x": around}).collect()}
    assert curve[best] >= max(curve[around[0]], curve[around[2]])


def test_tree_attributions_read_whole_columns(monkeypatch):
    """Each bound of a path is one comparison of a column that lies in one piece; a batch's rows get what each gets alone."""
    from holdfast.operators import treeshap

    rng = np.random.default_rng(4)

    def tree(depth, cover):
        if not depth:
            return treeshap.Node(cover=cover, value=float(rng.normal()))
        share = float(rng.uniform(0.2, 0.8))
        sides = tree(depth - 1, cover * share), tree(depth - 1, cover * (1 - share))
        return treeshap.Node(cover, 0.0, int(rng.integers(9)), float(rng.normal()), *sides)

    ensemble = treeshap.TreeEnsemble()
    for depth in (2, 4, 8):
        ensemble.add(tree(depth, 100.0), 0.5)
    assert max(len(leaf.features) for leaf in ensemble.leaves) > treeshap.TABLE_PATH
    x = rng.normal(size=(40, 9))
    x[0], x[1], x[2, ::2] = np.nan, -np.inf, np.inf
    seen, met = [], treeshap.Leaf.met
    monkeypatch.setattr(treeshap.Leaf, "met", lambda leaf, values, at: seen.append(values) or met(leaf, values, at))
    got = ensemble.attribute(x)
    assert len(seen) == sum(len(leaf.features) for leaf in ensemble.leaves)
    assert all(v.flags.c_contiguous and v.shape == (40,) for v in seen)
    want = np.zeros_like(x)
    for r, row in enumerate(x):
        for leaf in ensemble.leaves:
            meets = np.array([[lo < v <= hi for lo, v, hi in zip(leaf.low, row[leaf.features], leaf.high, strict=True)]])
            want[r, leaf.features] += leaf.rows(meets.astype(int))[0]
    assert np.allclose(got, want, atol=1e-12)


def test_attributions_by_subtrees_equal_those_by_leaves(monkeypatch):
    """A row looks up each feature once per subtree, not once per leaf; paths beyond a table and odd values included."""
    from holdfast.operators import treeshap

    rng = np.random.default_rng(11)

    def tree(depth, cover):
        if not depth or rng.random() < 0.1:
            return treeshap.Node(cover=cover, value=float(rng.normal()))
        left = cover * float(rng.choice([0.0, 0.3, 0.8]))
        sides = tree(depth - 1, left), tree(depth - 1, cover - left)
        return treeshap.Node(cover, 0.0, int(rng.integers(14)), float(rng.normal()), *sides)

    def spine(depth):
        node = treeshap.Node(1.0, value=3.0)
        for f in range(depth):
            node = treeshap.Node(node.cover + 2, 0.0, f, 0.0, node, treeshap.Node(2.0, value=float(rng.normal())))
        return node

    ensemble = treeshap.TreeEnsemble()
    for root in [treeshap.Node(1.0, value=2.0), *(tree(d, 100.0) for d in (1, 3, 6, 6, 8)), spine(12)]:
        ensemble.add(root, 0.5)
    assert ensemble.long and sum(len(g.leaves) for g in ensemble.groups) + len(ensemble.long) == len(ensemble.leaves)
    assert len(ensemble.groups) < len(ensemble.leaves) / 2
    x = rng.normal(size=(300, 14))
    x[0], x[1], x[2, ::2], x[3, 1] = np.nan, -np.inf, np.inf, np.nan
    tables = {}
    for part in (x[:100], x[100:], x[:0]):
        assert np.allclose(ensemble.attribute_all(part, tables), ensemble.attribute(part), atol=1e-12)
    asked = []
    monkeypatch.setattr(treeshap.Leaf, "met", lambda leaf, values, at: asked.append(leaf) or np.zeros(len(values), bool))
    ensemble.attribute_all(x[4:], tables)
    assert all(leaf in ensemble.long for leaf in asked)
