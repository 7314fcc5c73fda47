import numpy as np

from chronofold.llm import neighbours as N


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def clustered(n, d=16, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(20, d))[r.integers(0, 20, n)] * 2 + r.normal(size=(n, d)) * 0.4).astype(np.float32)


def test_parts_are_balanced():
    x = clustered(2000).astype(float)
    g = N.neighbour_graph(x)
    part = N.balanced_parts(x, g, 16)
    assert np.bincount(part, minlength=16).max() <= np.ceil(2000 / 16 * 1.1)
    inside = (part[g] == part[:, None]).mean()
    assert inside > 0.5


def test_recall_and_exact_scores(spark):
    x = clustered(3000)
    ids = np.arange(3000) * 2
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, part int").repartition(3)
    got = results(N.search(df, df.where("vec_id % 20 = 0"), k=20, probes=8, block=100))
    want = brute(ids, x.astype(float), [i for i in range(3000) if ids[i] % 20 == 0], 20)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    exact = {int(i): v.astype(float) for i, v in zip(ids, x)}
    assert all(abs(s - (exact[q] * exact[i]).sum()) < 1e-12 for q in got for i, s in got[q])


def test_probes_follow_the_data():
    x = clustered(5000).astype(float)
    router = N.train_router(x, g := N.neighbour_graph(x), N.balanced_parts(x, g, 32), 32)
    few = N.probes_needed(router, clustered(300, seed=0).astype(float), x, 32)
    noise = np.random.default_rng(1).normal(size=(5000, 16))
    router = N.train_router(noise, g := N.neighbour_graph(noise), N.balanced_parts(noise, g, 32), 32)
    many = N.probes_needed(router, np.random.default_rng(2).normal(size=(300, 16)), noise, 32)
    assert few <= 10 < many <= 32 and N.probes_needed(router, noise[:5], noise, 32) == 32
    assert [N.parts_for(n) for n in (0, 50_000, 1_000_000, 10**12)] == [32, 32, 128, 256]


def test_recall_with_measured_probes(spark):
    x = clustered(4000)
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = results(N.search(df, df.where("vec_id % 20 = 0")))
    want = brute(ids, x.astype(float), range(0, 4000, 20), 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_all_parts_is_exact_with_ties(spark):
    x = np.concatenate([np.repeat(clustered(1), 700, axis=0), clustered(300, seed=5)])
    ids = np.arange(1000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = results(N.search(df, df.where("vec_id % 20 = 0"), k=20, probes=32, block=64))
    want = brute(ids, x.astype(float), range(0, 1000, 20), 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_rows_of_all_kinds(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [2.0, 1.0]), (8, [2.0, 1.0]), (40, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = results(N.search(df, df.where("vec_id % 20 = 0"), probes=32))
    assert got == {0: [(8, 2.0), (8, 2.0), (20, 0.5)], 20: [(8, 1.5), (8, 1.5), (0, 0.5)]}
    assert N.search(df.limit(0), df.limit(0)).count() == 0
    assert N.search(df, df.limit(0)).count() == 0


def test_queries_of_mostly_another_length(spark):
    """The commonest length of all vectors counts, not that of the queries."""
    rows = [(k, [1.0, float(k)]) for k in range(1, 9)] + [(20, [1.0, 2.0, 3.0]), (40, [1.0, 2.0, 4.0]), (60, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = results(N.search(df, df.where("vec_id % 20 = 0"), k=2, probes=32))
    assert got == {60: [(8, 10.0), (7, 9.0)]}


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = brute(ids, x, [k for k in range(len(ids)) if ids[k] % 20 == 0], 20)
    got = results(N.op4_learned_partitions(spark, sf))
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
