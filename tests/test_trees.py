"""Deep trees grown from bins: against a plain recursive tree, over several tasks, in forests and boosted."""
import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import models as Mo
from colloquy.operators import trees as Tr
from test_models import blobs


def noisy(spark, n=900, seed=3):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    x[:, 4] = rng.integers(0, 3, n)
    y = (x[:, 0] + x[:, 1] * x[:, 4] + rng.normal(size=n) > 0.5).astype(float)
    return spark.createDataFrame([(i, float(y[i]), Vectors.dense(x[i].tolist())) for i in range(n)], blobs(spark, 2).schema).repartition(4), x, y


def plain_gain(left, total):
    right = total - left
    return sum((s * s).sum() / s.sum() for s in (left, right)) - (total * total).sum() / total.sum()


def check(t, node, x, y, w, depth):
    """Every node holds its rows' class weights and splits them best, or is a leaf for a reason."""
    total = np.array([w[y == c].sum() for c in range(2)])
    assert np.allclose(t.value[node], total)
    gains = [(plain_gain(np.array([w[(y == c) & (x[:, f] <= b)].sum() for c in range(2)]), total), f, b)
             for f in range(x.shape[1]) for b in np.unique(x[:, f])[:-1]]
    best = max(gains, default=(0, 0, 0))[0]
    if t.feature[node] < 0:
        assert depth == 0 or best < 1e-9 or (total > 0).sum() < 2
        return 1
    assert abs(best - plain_gain(np.array([w[(y == c) & (x[:, t.feature[node]] <= t.cut[node])].sum() for c in range(2)]), total)) < 1e-9
    left = x[:, t.feature[node]] <= t.cut[node]
    return 1 + check(t, t.left[node], x[left], y[left], w[left], depth - 1) + check(t, t.left[node] + 1, x[~left], y[~left], w[~left], depth - 1)


def test_a_tree_takes_the_best_split_of_every_node():
    rng = np.random.default_rng(1)
    x = rng.integers(0, Tr.BINS, (3000, 4)).astype(np.uint8)
    x[:, 3] //= 16
    y = (rng.random(3000) < x[:, 0] / 60 + (x[:, 1] > 9) * 0.3).astype(np.uint8)
    w = rng.random(3000) * (rng.random(3000) > 0.1)
    for depth in (30, 4, 0):
        t, gains = Tr.grow(x, y, w, 2, depth, 4, np.random.default_rng(0))
        used = w > 0
        assert check(t, 0, x[used], y[used], w[used], depth) == len(t.feature) and (gains.sum() > 0) == (depth > 0)
    pure, _ = Tr.grow(x, np.ones(3000, np.uint8), w, 2, 30, 4, np.random.default_rng(0))
    assert len(pure.feature) == 1


def test_one_tree_over_many_tasks_is_the_same_tree(spark):
    df, x, y = noisy(spark)
    rows = Mo.tree_rows(df, "features", "label", F.lit(1.0))
    cuts = Tr.cuts_of(rows)
    assert len(cuts[4]) == 2 and cuts[4].tolist() == [0.5, 1.5] and len(cuts[0]) == Tr.BINS - 1
    stored, binned = Tr.stored_chunks(rows, cuts), Tr.bins(x, cuts)
    found = []
    for local in (None, 60):
        made = [p.collect() for p in Tr.grow_trees(stored, 900, 2, 5, [7], 12, 5, 1, lambda c, t: c.w, local)]
        assert (len(made[0]) > 9) == (local == 60)
        (t,) = [Tr.assembled(m) for m in made]
        assert check(t, 0, binned, y.astype(int), np.ones(900), 12) == len(t.feature)
        found.append(t.value[t.leaves(binned)])
    assert np.allclose(found[0], found[1])


def test_large_deep_forest_scores_saves_and_groups(spark, monkeypatch):
    df, x, y = noisy(spark)
    monkeypatch.setattr(Tr, "SHIPPED_ROWS", 3000)
    model = Mo.Forest(10, 30, tree_rows=1000).fit(df)
    assert isinstance(model, Mo.GrownForestModel) and len(model.sizes) == 10 and min(model.sizes) > 50
    spark_own = Mo.Forest(10, 30).fit(df)
    a, b = model.featureImportances.toArray(), spark_own.featureImportances.toArray()
    assert abs(a.sum() - 1) < 1e-9 and np.abs(a - b).max() < 0.1
    want = {r["participant_id"]: (r["prediction"], r["probability"]) for r in model.transform(df).collect()}
    assert len(want) == 900 and np.mean([want[i][0] == y[i] for i in want]) > 0.95
    cuts = [np.array(c) for c in model.cuts]
    trees = Tr.load(model.table(spark, model.path), list(range(10)))
    p = np.mean([(v := t.value[t.leaves(Tr.bins(x, cuts))]) / v.sum(1, keepdims=True) for t in trees], axis=0)
    assert all(np.allclose(want[i][1].toArray(), p[i]) for i in want)
    monkeypatch.setattr(Tr, "GROUP_NODES", 400)     # several groups of trees
    assert len(Tr.groups(model.sizes)) > 2
    again = Mo.load_model(Mo.save_model(Mo.PipelineModel([model]), "t_grown", spark))
    assert {r["participant_id"]: (r["prediction"], r["probability"]) for r in again.transform(df).collect()}.keys() == want.keys()
    for r in again.transform(df).collect():
        assert r["prediction"] == want[r["participant_id"]][0] and np.allclose(r["probability"].toArray(), want[r["participant_id"]][1].toArray())


def test_boosting_of_grown_trees_follows_samme(spark):
    df, x, y = noisy(spark, 500)
    model = Mo.AdaBoostClassifier(4, 0.5, max_depth=11, boost_rows=100, balanced_trees=True).fit(df)
    assert isinstance(model, Mo.GrownBoostModel)
    cuts = [np.array(c) for c in model.cuts]
    binned, w = Tr.bins(x, cuts), np.full(500, 1 / 500)
    factor = np.array([500 / (2 * (y == c).sum()) for c in range(2)])[y.astype(int)]
    trees, score = Tr.load(model.table(spark, model.path), list(range(len(model.sizes)))), np.zeros((500, 2))
    for t, alpha in zip(trees, model.alphas, strict=True):
        assert check(t, 0, binned, y.astype(int), w * factor, 11) == len(t.feature)
        got = t.value[t.leaves(binned)].argmax(1)
        miss = got != y
        err = (w * miss).sum()
        assert abs(alpha - (0.5 * np.log((1 - err) / err) if err > 0 else 1.0)) < 1e-9
        score[np.arange(500), got] += alpha
        w = w * np.exp(alpha * miss)
        w /= w.sum()
    out = {r["participant_id"]: r for r in model.transform(df).collect()}
    e = np.exp(score / sum(model.alphas))
    for i, r in out.items():
        assert r["prediction"] == score[i].argmax() and np.allclose(r["probability_array"], e[i] / e[i].sum())
    again = Mo.load_model(Mo.save_model(Mo.PipelineModel([model]), "t_boost", spark))
    assert sorted(r["prediction"] for r in again.transform(df).collect()) == sorted(r["prediction"] for r in out.values())
