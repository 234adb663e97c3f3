"""Histogram trees and side-by-side k-means against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast import schema as S
from holdfast.catalog import load
from holdfast.operators import kmeans, sampling, trees
from holdfast.plans import segmentation, training
from holdfast.plans.scored import featured_accounts, scored_accounts


def bins_of(x):
    cuts = [np.unique(c)[:-1] for c in x.T]
    codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
    return codes.astype(np.uint8), cuts


def greedy(x, g, h, rows, depth, ridge, gamma, least):
    """Leaf value of every row by trying all splits of all nodes."""
    total = (g[rows].sum(), h[rows].sum())
    best = (max(gamma, 1e-9), None)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[rows, f])[:-1]:
            sides = [rows[x[rows, f] <= cut], rows[x[rows, f] > cut]]
            sums = [(g[s].sum(), h[s].sum()) for s in sides]
            if min(s[1] for s in sums) >= max(least, 1e-12):
                gain = sum(a * a / (b + ridge) for a, b in sums) - total[0] ** 2 / (total[1] + ridge)
                if gain > best[0] + 1e-12:
                    best = (gain, sides)
    out = np.zeros(len(x))
    if best[1] is None:
        out[rows] = total[0] / (total[1] + ridge)
        return out
    return sum(greedy(x, g, h, side, depth - 1, ridge, gamma, least) for side in best[1])


@pytest.mark.parametrize("seed", range(8))
def test_tree_equals_greedy_search(seed, monkeypatch):
    monkeypatch.setattr(trees, "MOST_CELLS", 97 if seed % 2 else 1 << 21)
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (70, 4)) + rng.normal(size=(70, 4)) * (seed % 3)
    codes, cuts = bins_of(x)
    g, h = rng.normal(size=70), rng.random(70)
    rows = np.flatnonzero(rng.random(70) < 0.8)
    tree, leaf = trees.Grower(codes, cuts).grow(g, h, rows, 4, 1.0, 0.2, 0.6)
    want = greedy(x, g, h, rows, 4, 1.0, 0.2, 0.6)
    assert np.allclose(tree.predict(x)[rows], want[rows])
    assert np.allclose(tree.value[leaf], want[rows])


def test_unlimited_tree_is_pure():
    """No depth limit: every leaf holds one class, down a path as long as the rows ask for."""
    x = np.stack([np.arange(200.0), np.zeros(200)], axis=1)
    y = (np.arange(200) % 2).astype(float)
    codes, cuts = bins_of(x)
    tree, _ = trees.Grower(codes, cuts).grow(
        y, np.ones(200), np.arange(200), None, 0.0, 0.0, 1.0, per_node=1, lots=np.random.default_rng(0)
    )
    assert (tree.predict(x) == y).all()


def test_boosting_lowers_the_loss_and_follows_its_settings():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    codes, cuts = bins_of(np.round(x, 1))

    def loss(**params):
        base, found = trees.boost(codes, y, cuts, params)
        odds = base + sum(t.predict(np.round(x, 1)) for t in found)
        p = 1 / (1 + np.exp(-odds))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), found

    few, many = loss(n_estimators=3), loss(n_estimators=40)
    assert many[0] < few[0] < np.log(2)
    assert max(len(t.value) for t in loss(n_estimators=5, max_depth=2)[1]) <= 7
    assert all(len(t.value) == 1 for t in loss(n_estimators=2, gamma=1e9)[1])
    assert loss(n_estimators=10, subsample=0.6, colsample_bytree=0.6)[0] < np.log(2)
    one = [set(t.feature) - {-1} for t in loss(n_estimators=8, colsample_bytree=0.2)[1]]
    assert max(map(len, one)) <= 1 and len(set.union(*one)) > 1


def test_aucs_equal_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(rng.integers(0, 2)), float(rng.integers(0, 9)) / 9) for k in range(3) for _ in range(60)] + [(3, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k int, label double, churn_prob double")
    got = {r.k: r.auc for r in trees.aucs(df, ["k"]).collect()}
    assert got.pop(3) is None
    for k, auc in got.items():
        a = [p for j, y, p in rows if j == k and y == 1]
        b = [p for j, y, p in rows if j == k and y == 0]
        assert auc == pytest.approx(np.mean([(p > q) + (p == q) / 2 for p in a for q in b]))


@pytest.fixture(scope="module")
def learned(spark, sf_dir):
    rows = training.labelled(featured_accounts(spark, sf_dir))
    return rows.persist()


def test_fits_score_save_and_load(spark, learned, tmp_path):
    ready = training.prepare(learned, ratio=None)
    fits = {"boosted": ready.fit_boosted({"n_estimators": 5, "max_depth": 3}), "forest": ready.fit_forest(7)}
    x = np.array([r.features.toArray() for r in ready.encoder.transform(learned).orderBy(S.KEY).collect()])
    for name, fit in fits.items():
        rows = fit.score(learned).orderBy(S.KEY).collect()
        assert rows[0].__fields__[-1] == "churn_prob" and len(rows) == learned.count()
        want = fit.trees.probability(x)
        assert np.allclose([r.churn_prob for r in rows], want)
        fit.save(str(tmp_path / name), learned)
        again = trees.FittedTrees.load(learned, str(tmp_path / name), name == "forest")
        assert np.allclose([r.churn_prob for r in again.score(learned).orderBy(S.KEY).collect()], want)
    # a forest without a depth limit knows most of its own rows
    y = np.array([r.label for r in learned.orderBy(S.KEY).collect()])
    assert ((fits["forest"].trees.probability(x) > 0.5) == y).mean() > 0.85
    assert fits["forest"].trees.getNumTrees == 7 and fits["boosted"].trees.getNumTrees == 5
    same = ready.fit_boosted({"n_estimators": 5, "max_depth": 3})
    assert np.array_equal(same.trees.probability(x), fits["boosted"].trees.probability(x))


def test_drawing_with_replacement(spark):
    df = spark.range(4000).select(F.col("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("tree"))
    rows = df.select("id", "tree", trees.poisson(F.col("id"), F.col("tree"), "s").alias("n")).collect()
    n = np.array([r.n for r in rows])
    assert n.mean() == pytest.approx(1, abs=0.05) and n.var() == pytest.approx(1, abs=0.08)
    assert (n == 0).mean() == pytest.approx(np.exp(-1), abs=0.02)


def test_draws_of_a_forest_are_spread_and_hash_once(spark):
    rows = spark.range(300).select(
        F.col("id").alias("lot"), F.col("id").cast("string").cast("binary").alias("bins"), (F.col("id") % 2).cast("double").alias("label")
    )
    found = trees.draws(rows.coalesce(1), 20, 7)
    every = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(19))))
    want = every.withColumn("n", trees.poisson(F.col("lot"), F.col("tree"), "forest-7")).where("n > 0")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("tree", "bins", "label", "n").collect()))
    # one file's rows are drawn in more than one task
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line and "md5" in line]
    assert conditions and all(line.count("md5") == 1 for line in conditions)



def test_fit_rows_bound(spark, learned):
    few = training.bounded(learned, 300)
    assert 200 < few.count() < 400 and training.bounded(learned, 10**9).count() == learned.count()


def test_forests_and_boosted_trees_learn_from_all_rows(spark, learned, monkeypatch):
    """The comparison fits on every training row, however many there are."""
    asked, prepare = [], training.prepare
    monkeypatch.setattr(training, "bounded", lambda *_: pytest.fail("rows are left out of the fit"))
    monkeypatch.setattr(training, "prepare", lambda train, *a, **k: asked.append(train.count()) or prepare(train, *a, **k))
    monkeypatch.setattr(training.Prepared, "fit_forest", lambda self, **_: self.fit_boosted({"n_estimators": 2}))
    training.compare_baselines(learned, learned, only=["Random Forest"])
    assert asked == [learned.count()]


def test_search_learns_from_all_rows(spark, learned, monkeypatch):
    """Folds hold every training row, and the best setting is refitted on all of them."""
    asked, prepare, held, scores = [], training.prepare, [], trees.search_scores
    monkeypatch.setattr(training, "bounded", lambda *_: pytest.fail("rows are left out of the search"))
    monkeypatch.setattr(training, "prepare", lambda train, *a, **k: asked.append(train.count()) or prepare(train, *a, **k))
    monkeypatch.setattr(trees, "search_scores", lambda parts, *a: held.append(sum(h.count() for _, h in parts)) or scores(parts, *a))
    space = {"n_estimators": [2], "max_depth": [2], "learning_rate": [0.1]}
    training.random_search(learned, space=space, n_iter=1, folds=2)
    n = learned.count()
    assert held == [n] and sum(asked[:2]) == n and asked[2] == n


def test_sums_of_codes_equal_those_of_bins():
    """Codes that features share, added up, give the sums of each bin."""
    rng = np.random.default_rng(12)
    sizes = (257, 2, 2, 73, 5, 1, 2, 2, 30, 9)
    codes = np.stack([rng.integers(0, k, 500) for k in sizes], axis=1)
    grower = trees.Grower(codes, [np.arange(k - 1.0) for k in sizes])
    rows, node, g = np.arange(100, 500), rng.integers(0, 3, 400), rng.integers(-9, 9, 500).astype(float)
    (got,) = grower._sums(rows, node, 3, np.arange(len(sizes)), [g[rows]])
    want = np.zeros((3, sum(sizes)))
    for f in range(len(sizes)):
        np.add.at(want, (node, grower.starts[f] + codes[rows, f]), g[rows])
    assert np.array_equal(got, want)


def test_forest_draws_are_those_of_the_hash(spark):
    lots = np.array([5, -7, 2**62, 0, 123456789] * 40) + np.arange(200)
    df = spark.createDataFrame([(int(v), b"x", 1.0) for v in lots], "lot long, bins binary, label double")
    want = {(r.lot): r.n for r in trees.draws(df, 3, 11).where("tree = 2").withColumn("lot", F.lit(0)).collect()}
    every = df.withColumn("n", trees.poisson(F.col("lot"), F.lit(2), "forest-11")).collect()
    assert want and trees._taken(lots, 2, 11).tolist() == [r.n for r in every]


def test_a_large_forest_scores_from_files(spark, learned, tmp_path, monkeypatch):
    """Trees that the driver does not hold give the same probabilities, pass by pass, and are saved and loaded."""
    ready = training.prepare(learned, ratio=None)
    small = ready.fit_forest(5)
    monkeypatch.setattr(trees, "MOST_NODES", 10)
    monkeypatch.setattr(trees, "SCORED_BYTES", 1 << 14)
    large = ready.fit_forest(5)
    assert large.trees.trees is None and large.trees.getNumTrees == 5
    large.save(str(tmp_path / "forest"), learned)
    want = {r[S.KEY]: r.churn_prob for r in small.score(learned).collect()}
    for fit in (large, trees.FittedTrees.load(learned, str(tmp_path / "forest"), True)):
        found = fit.score(learned.repartition(3)).collect()
        assert len(found) == len(want) and all(r.churn_prob == want[r[S.KEY]] for r in found)


def test_bins_beyond_a_byte_keep_their_order():
    """A feature of 256 cuts has 257 bins; its greatest values are not those of the first bin."""
    x = np.arange(257.0)[:, None]
    y = (x[:, 0] == 256).astype(float)
    cuts = [np.arange(256.0)]
    codes = np.searchsorted(cuts[0], x[:, 0])[:, None]
    tree, _ = trees.Grower(codes, cuts).grow(
        y, np.ones(257), np.arange(257), None, 0.0, 0.0, 1.0, per_node=1, lots=np.random.default_rng(0)
    )
    assert (tree.predict(x) == y).all() and len(tree.value) == 3


@pytest.mark.parametrize("depth", [None, 3])
def test_trees_of_a_forest_equal_greedy_search(depth):
    """All features tried at each node: the best split of every node, down to pure leaves."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (80, 4)).astype(float)
    n = rng.integers(1, 4, 80).astype(float)
    y = (rng.random(80) < 0.4).astype(float)
    codes, cuts = bins_of(x)
    tree, leaf = trees.Grower(codes, cuts).grow(
        n * y, n, np.arange(80), depth, 0.0, 0.0, 1.0, per_node=4, lots=np.random.default_rng(1)
    )
    want = greedy(x, n * y, n, np.arange(80), depth or 50, 0.0, 0.0, 1.0)
    assert np.allclose(tree.value[leaf], want) and np.allclose(tree.predict(x), want)


def test_stratified_folds(spark):
    rows = [(i, "a" if i % 7 == 0 else "b") for i in range(500)] + [(1000, "c"), (1001, "d"), (1002, "d")]
    df = spark.createDataFrame(rows, "account_id long, kind string")
    got = sampling.stratified_folds(df, "account_id", "kind", 3).collect()
    assert len(got) == len(rows)
    for kind in "abcd":
        mine = [r.fold for r in got if r.kind == kind]
        sizes = [mine.count(f) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(mine)


def lloyd(x, w, centres, passes, tol=1e-4):
    for _ in range(passes):
        at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([np.average(x[at == c], axis=0, weights=w[at == c]) if (at == c).any() else centres[c] for c in range(len(centres))])
        moved = ((new - centres) ** 2).sum()
        centres = new
        if moved <= tol:
            break
    at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    return centres, (w * ((x - centres[at]) ** 2).sum(axis=1)).sum()


def test_kmeans_equals_lloyd_from_the_same_starts(spark):
    rng = np.random.default_rng(2)
    x = np.round(np.vstack([rng.normal(m, 0.7, size=(60, 3)) for m in (0, 3, 6)]), 1)
    x = np.vstack([x, x[:40]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    points = kmeans.kept(kmeans.weighted_points(df.union(df.limit(1).selectExpr("null", "b", "c")), ["a", "b", "c"]))
    assert points.agg(F.sum("w")).first()[0] == len(x)
    u, w = np.unique(x, axis=0, return_counts=True)
    drawn = kmeans.starts(points, 4, 3, 42)
    again = kmeans.starts(points.repartition(1), 4, 3, 42)
    assert all(np.array_equal(a, b) for a, b in zip(drawn, again, strict=True))
    assert all(len(np.unique(c, axis=0)) == 4 for c in drawn) and not np.array_equal(drawn[0], drawn[1])
    fits = kmeans.fit_all(points, [2, 3, 4], 3, 42)
    for k, fit in fits.items():
        want = min((lloyd(u, w, c[:k], 300) for c in drawn), key=lambda f: f[1])
        assert fit.cost == pytest.approx(want[1])
        assert np.allclose(np.sort(fit.centres, axis=0), np.sort(want[0], axis=0), atol=1e-6)
    scores = kmeans.silhouettes(points, {k: f.centres for k, f in fits.items()})
    for k, fit in fits.items():
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        at = ((x[:, None] - fit.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        own = []
        for i in range(len(x)):
            mine = at == at[i]
            a = d[i, mine].sum() / max(mine.sum() - 1, 1)
            b = min(d[i, at == c].mean() for c in range(k) if c != at[i])
            own.append(0.0 if mine.sum() == 1 else (b - a) / max(a, b))
        assert scores[k] == pytest.approx(np.mean(own))


def test_runs_in_tasks_are_those_of_passes(spark, monkeypatch):
    """Points that fit are sent out once, and no pass over them is a Spark job; the centres are the same."""
    rng = np.random.default_rng(9)
    x = np.round(np.vstack([rng.normal(m, 1.0, size=(80, 2)) for m in (0, 2, 4)]), 2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    points = kmeans.kept(kmeans.weighted_points(df, ["a", "b"]))
    passes, sums = [], kmeans._sums
    monkeypatch.setattr(kmeans, "_sums", lambda *a, **k: passes.append(k) or sums(*a, **k))
    near = kmeans.fit_all(points, [2, 3, 5], 4, 7)
    assert passes == [{"costs": True}]
    monkeypatch.setattr(kmeans, "SENT_BYTES", 0)
    far = kmeans.fit_all(points, [2, 3, 5], 4, 7)
    assert len(passes) > 3
    for k, fit in far.items():
        assert np.array_equal(near[k].centres, fit.centres) and near[k].passes == fit.passes
        assert near[k].cost == pytest.approx(fit.cost)


def test_kmeans_with_few_points(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (5.0,)], "a double")
    points = kmeans.weighted_points(df, ["a"])
    fits = kmeans.fit_all(points, [1, 2, 4], 2, 1)
    assert fits[4].centres.tolist() == fits[2].centres.tolist() == [[1.0], [5.0]] and fits[2].cost == 0.0
    assert fits[1].centres[0][0] == pytest.approx(7 / 3)
    assert kmeans.silhouettes(points, {2: fits[2].centres})[2] == pytest.approx(2 / 3)
    assert kmeans.fit_all(points.where("false"), [2], 2, 1) == {}


def test_nearest_in_sql(spark):
    rng = np.random.default_rng(5)
    x, centres = rng.normal(size=(50, 2)), rng.normal(size=(3, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = [r[0] for r in df.selectExpr(kmeans.nearest_sql(["a", "b"], centres)).collect()]
    assert got == kmeans.squared_distances(x, centres).argmin(axis=1).tolist()


@pytest.mark.parametrize("name", ["segmentation_fit", "choose_k", "model_forest", "model_search"])
def test_registered_fits_finish(spark, sf_dir, name):
    """The registered fits with the library's settings, each within a time limit."""
    began = time.monotonic()
    rows = load()[0][name](spark, sf_dir).collect()
    assert time.monotonic() - began < 240
    if name == "model_search":
        assert len(rows) == 20 and sum(r.best for r in rows) == 1 and all(0 <= r.mean_auc <= 1 for r in rows)
    if name == "choose_k":
        costs = [r.inertia for r in sorted(rows, key=lambda r: r.k)]
        assert len(costs) == 9 and costs == sorted(costs, reverse=True)
    if name == "segmentation_fit":
        assert sum(r.n for r in rows) == scored_accounts(spark, sf_dir).count() and len(rows) == 4


def test_segments_are_at_their_nearest_centre(spark, sf_dir):
    scored = scored_accounts(spark, sf_dir).drop("cluster", "customer_segment")
    fitted = segmentation.fit_segments(scored, n_init=3)
    assert fitted.centres.shape == (4, len(S.SEGMENT_INPUTS))


def test_nearest_centres_by_products_are_those_by_distances(monkeypatch):
    """Ties, near ties, copies of centres and values far from the origin: the same answer as from the distances."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(kmeans, "SLICE", 7)
    for offset in (0.0, 1e6):
        centres = offset + rng.integers(0, 3, (5, 4, 3)).astype(float)
        x = np.vstack([offset + rng.integers(0, 5, (90, 3)) / 2, offset + rng.normal(size=(50, 3)), centres.reshape(-1, 3)])
        x = np.vstack([x, x + rng.normal(size=x.shape) * 1e-12])
        got = kmeans.Nearest(centres).of(x)
        assert got.tolist() == [kmeans.squared_distances(x, c).argmin(axis=1).tolist() for c in centres]


def test_points_go_to_python_in_blocks(spark, monkeypatch):
    """A pass reads few rows of bytes, not a row per point."""
    monkeypatch.setattr(kmeans, "SLICE", 100)
    df = spark.range(1000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b").coalesce(1)
    blocks = kmeans.packed(kmeans.weighted_points(df, ["a", "b"]).coalesce(1))
    assert blocks.count() == 10 and blocks.agg(F.sum("n")).first()[0] == 1000
    assert kmeans.packed(blocks) is blocks
    sums = kmeans._sums(blocks, {(1, 0): np.array([[0.0, 0.0]])}, costs=True)[1, 0]
    assert sums[0].tolist() == [1000.0] and sums[1][0, 0] == 499500.0
    assert sums[2] == float(sum(i * i + (i % 7) ** 2 for i in range(1000)))
