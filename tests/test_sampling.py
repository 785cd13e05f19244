"""kNN equals brute force across several blocks; SMOTE balances classes with rows on segments."""
import numpy as np

from colloquy.operators import sampling as Sm


def data(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i % 4 == 0), [float(x) for x in rng.normal(size=3)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, cls int, vec array<double>"), rows


def test_knn_matches_brute_force(spark):
    df, rows = data(spark)
    got = {(r["id"], r["rank"]): r["nid"] for r in Sm.knn(df, "id", "vec", 3, block_rows=7).collect()}
    vec = {i: np.array(v) for i, _, v in rows}
    for i in vec:
        d = sorted((float(np.linalg.norm(vec[i] - vec[j])), j) for j in vec if j != i)
        for r in range(3):
            assert got[(i, r)] == d[r][1]


def test_knn_ties_and_offsets(spark):
    rng = np.random.default_rng(5)
    ids = rng.permutation(300).tolist()
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids], "id long, vec array<double>")
    for r in Sm.knn(same, "id", "vec", 5, block_rows=64).groupBy("id").agg({"nid": "collect_set"}).collect():
        assert sorted(r[1]) == [j for j in range(7) if j != r["id"]][:5]
    vec = {i: 1e8 + rng.normal(size=3) for i in range(80)}
    far = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vec.items()], "id long, vec array<double>")
    for r in Sm.knn(far, "id", "vec", 4, block_rows=32).collect():
        best = sorted((float(((vec[r["id"]] - vec[j]) ** 2).sum()), j) for j in vec if j != r["id"])
        assert best[r["rank"]][1] == r["nid"]


def test_smote_reaches_the_majority_from_a_tiny_class(spark):
    for n_min in (2, 4):
        rows = [(i, int(i < n_min), [float(i), float(i * i % 7)]) for i in range(20 + n_min)]
        out = Sm.smote(spark.createDataFrame(rows, "id long, cls int, vec array<double>"), "id", "vec", "cls", k=5)
        assert out.filter("cls = 1").count() == 20
    one = spark.createDataFrame([(i, int(i < 1), [float(i)]) for i in range(6)], "id long, cls int, vec array<double>")
    try:
        Sm.smote(one, "id", "vec", "cls")
        raise AssertionError("a class of one row was interpolated")
    except ValueError:
        pass


def test_smote_balances_and_interpolates(spark):
    df, rows = data(spark)
    out = Sm.smote(df, "id", "vec", "cls", k=3)
    counts = {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()}
    assert counts[0] == counts[1]
    vec = {i: np.array(v) for i, _, v in rows}
    nn = {(r["id"], r["nid"]) for r in Sm.knn(df.filter("cls = 1"), "id", "vec", 3).collect()}
    for r in out.filter("synthetic").collect():
        base = vec[r["source_id"]]
        new = np.array(r["vec"])
        ok = False
        for (i, j) in nn:
            if i == r["source_id"]:
                seg = vec[j] - base
                t = float(np.dot(new - base, seg) / np.dot(seg, seg))
                ok |= 0 <= t <= 1 and np.allclose(base + t * seg, new)
        assert ok


def test_adasyn_counts(spark):
    df, _ = data(spark)
    out = Sm.adasyn(df, "id", "vec", "cls", k=3)
    synth = out.filter("synthetic").count()
    assert abs(synth - (45 - 15)) <= 15     # rounding of per-row quotas
