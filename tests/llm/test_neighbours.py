import numpy as np

from factloom.llm.neighbours import Graph, nearest


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, (i, x) in enumerate(ok):
        if i % every == 0:
            near = sorted((-float(x @ y), j) for p, (j, y) in enumerate(ok) if p != q and len(y) == len(x))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(120, 8)) * r.uniform(0.5, 2, size=(120, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200 + i, v[7].tolist()) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] * 4), (None, [1.0] * 8), (304, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as rank", "2 as score", "3 as v")
    got: dict = {}
    for x in sorted(nearest(df, 5, 10).collect(), key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    want = brute(rows, 5, 10)
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]])


def test_recall_of_a_graph():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = Graph(x).search(x[:100], 20)
    want = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, want, strict=True)]) >= 0.9


def test_few_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(x["query_id"], x["vec_id"]) for x in nearest(df).collect()] == [(20, 21)]
    assert nearest(df.where("false")).count() == 0 and Graph(np.zeros((0, 3))).search(np.zeros((1, 3)), 2).tolist() == [[-1, -1]]


def test_repeated_ids(spark):
    r = np.random.default_rng(5)
    other = [(i, x.tolist()) for i, x in enumerate(r.normal(size=(30, 4)), 101) if i % 20]
    # two equal rows of id 20, one more of it with another vector, and id 40 with fewer copies than neighbours
    rows = [(20, [1.0, 2.0, 0.0, 0.0])] * 2 + [(20, [0.0, 0.0, -1.0, 3.0]), (21, [1.0, 2.0, 0.0, 0.0])] + [(40, [2.0, 0.0, 1.0, 0.0])] * 7 + other
    got = sorted((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9)) for x in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).collect())
    want = []
    for q, (i, x) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-float(np.dot(x, y)), j) for p, (j, y) in enumerate(rows) if p != q)[:5]
            want += [(i, n, j, round(-s, 9)) for n, (s, j) in enumerate(near, 1)]
    assert got == sorted(want)
