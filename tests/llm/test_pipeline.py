import collections

import pytest

import corpus_pipeline as C
from chronofold.llm import toxicity
from test_jaccard_join import corpus, shingle_set
from test_packing import brute as brute_pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_and_run(spark, docs):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]
    clean = C.without_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit_on_tables(spark, SF), ["doc_id"]).where("score >= 0.5").collect()}
    ids = {r.doc_id for r in clean.collect()}
    assert toxic and ids == {r.doc_id for r in docs.collect()} - toxic
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[d] == 0 for d in toxic if d in labels) <= 0.02 * len(ids)
    out = C.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def near_duplicates_kept(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for k, (d, _) in enumerate(rows):
        key = (d is None, d or 0, k)
        best[group[k]] = min(best.get(group[k], key), key)
    return collections.Counter(rows[b[2]] for b in best.values())


def test_near_duplicates_against_brute_force(spark):
    rows = corpus(3, groups=12) + [(None, "a b c d e f"), (5000, "a b c d e f"), (5000, "a b c d e f"), (6000, None), (6001, ""), (6002, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, Text string, label int, uid string")
    out = C.without_near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    got = collections.Counter((r.doc_id, r.Text) for r in out.collect())
    want = near_duplicates_kept(rows)
    assert got == want


def test_personal_data(spark):
    df = spark.createDataFrame([(1, "write a@b.cd", "en", "s", 12), (2, None, "en", "s", None), (3, "clean", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    out = C.without_personal_data(spark, df, SF)
    assert out.dtypes == df.dtypes
    assert sorted(tuple(r) for r in out.collect()) == [(1, "write <email>", "en", "s", 13), (2, None, "en", "s", None), (3, "clean", None, None, 5)]


def test_packing_and_empty_tables(spark, docs):
    rows = [(1, "a b"), (2, None), (2, "x" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r)[:5] for r in C.packed_sequences(spark, df, SF).collect())) == sorted(brute_pieces(rows))
    none = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0
