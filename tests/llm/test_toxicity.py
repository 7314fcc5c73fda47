import random
import zlib

import numpy as np

from chronofold.llm import toxicity as T


def brute_grams(text):
    """Distinct n-grams of one text by the rule of the module, as strings."""
    s = " " + (text or "").lower() + " "
    s = "".join(c if ord(c) >= 0x250 or c.isalpha() else " " for c in s)
    while "  " in s:
        s = s.replace("  ", " ")
    return {s[i : i + n] for n in T.NGRAMS for i in range(len(s) - n + 1)}


def test_grams_match_brute_force():
    texts = ["You IDIOT!!", None, "", "a", "Änd 12 ünd, 日本語です", "x" * 1000, "ab  cd"]
    owner, bucket = T.present(texts)
    for k, t in enumerate(texts):
        alone = T.present([t])[1]
        assert set(bucket[owner == k]) == set(alone)
        assert len(alone) <= len(brute_grams(t)) and len(alone) >= 0.98 * len(brute_grams(t))


def test_windows_change_nothing(monkeypatch):
    texts = ["one two " * 40, "", None, "Ünder the bridge" * 9, "xyz"]
    whole = T.present(texts)
    monkeypatch.setattr(T, "WINDOW", 7)
    parts = T.present(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_scores_are_those_of_a_plain_scaled_logistic_model(spark):
    """Features, ratios and the optimum anew, with dictionaries and dense matrices."""
    rows = corpus(160, 3)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    bucket = {}
    sets = []
    for _, t, _ in rows:
        sets.append(set(T.present([t])[1].tolist()))
    y = np.array([r[2] for r in rows], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    for b in set().union(*sets):
        has = np.array([b in s for s in sets])
        bucket[b] = has[y == 1].sum(), has[y == 0].sum()

    def z(c):
        pooled = (c[0] + c[1] + 1) / (len(y) + 2)
        return abs(c[0] / n1 - c[1] / n0) / np.sqrt(pooled * (1.0001 - pooled) * (1 / n1 + 1 / n0))

    best = sorted((b for b, c in bucket.items() if sum(c) >= 3 and z(c) > 3), key=lambda b: (-z(bucket[b]), b))[: T.FEATURES]
    assert set(best) == set(model.buckets.tolist())
    ratio = np.array([np.log((bucket[b][0] + 1) / (n1 + 2)) - np.log((bucket[b][1] + 1) / (n0 + 2)) for b in best])
    x = np.array([[b in s for b in best] for s in sets]) * ratio
    x = np.hstack([x, np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 1 / len(y))
    ridge[-1] = 1e-9
    for _ in range(40):  # Newton's method with the whole Hessian
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge), x.T @ (p - y) / len(y) + ridge * w)
    want = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
    got = {r.doc_id: r.score for r in T.score(docs, model, ["doc_id"]).collect()}
    assert max(abs(got[d] - want[k]) for k, (d, _, _) in enumerate(rows)) < 1e-3


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(r.choice(["the", "an", "er", "in", "on", "re"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 200))]
        toxic = int(k % 4 == 0)
        if toxic:
            words[r.randrange(len(words))] = "grobnik" + r.choice(["a", "os", "ent"])
        rows.append((k, " ".join(words), toxic))
    return rows


def test_learns_and_scores_every_row(spark):
    rows = corpus(400, 1)
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t, _ in rows], "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (3, None), (1, 1), (1, 0)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    new = corpus(200, 2)
    extra = [(1000, None), (1001, ""), (1002, "erthe " * 50_000), (1002, "erthe " * 50_000), (None, "GROBNIKULA?")]
    df = spark.createDataFrame([(d, t, 9) for d, t, _ in new] + [(d, t, 9) for d, t in extra], "doc_id long, text string, score int")
    got = {r[0]: r[1] for r in T.score(df, model, ["doc_id"]).collect()}
    assert all((got[d] >= 0.5) == bool(y) for d, _, y in new)
    assert got[1000] == got[1001] < 0.5 and got[1002] < 0.5 and got[None] >= 0.5
    left = T.drop_toxic(df, model)
    assert left.columns == df.columns and left.count() == 150 + 4 and {r.score for r in left.collect()} == {9}
    assert T.score(df.limit(0), model, ["doc_id"]).count() == 0
    nothing = T.fit(docs, labels.limit(0))
    assert {r.score for r in T.score(df, nothing, []).collect()} == {0.0}


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = T.op1_toxicity_nbsvm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in test]) >= 0.95
    assert T.op1_toxicity_nbsvm(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
