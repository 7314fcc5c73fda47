import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import jaccard_join as J
from chronofold.llm.components import components


def words_of(text):
    return [w for w in re.split("[ \t\n\x0b\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Component ids by position, comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted(((d, len(sets[k]), least.get(root(k))) for k, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, uid string").repartition(3)
    return sorted((tuple(r) for r in J.component_ids(df).collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\té\x85", max_size=40) | st.none(), max_size=8))
def test_shingles_are_as_many_as_distinct(texts):
    h, cuts = J.shingles(pa.array(texts, pa.string()))
    sets = [set(h[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
    want = [shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_bitmap_bounds_from_above():
    r = np.random.default_rng(0)
    for n in (1, 5, 40, 700):
        a = np.unique(r.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 5], r.integers(0, 1 << 60, n // 3).astype(np.uint64)]))
        x, y = (np.frombuffer(J.bitmap(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(J.folded(x, size) ^ J.folded(y, size)).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b))
        assert (J.unpack48(J.pack48(a)) == np.sort(a & np.uint64((1 << 48) - 1))).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300), (7, 7), (500, 501), (501, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    assert {got[k] for k in range(1, 61)} == {1} and got[300] == 100 and got[501] == 500
    assert components(df.limit(0)).count() == 0


def corpus(seed, groups=25, size=9):
    r = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows, d = [], 0
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 12, 40, 150, 400]))]
        if g % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5, 12])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w = w[: max(1, int(len(w) * r.uniform(0.7, 1)))]
            rows.append((d * 7 % 1009, " ".join(w).upper() if r.random() < 0.2 else "\n".join(w)))
            d += 1
    return rows


def test_equals_all_pairs(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_hot_shingles_and_boundaries(spark, monkeypatch):
    rows = corpus(2, groups=6, size=25)
    words = ["v%d" % k for k in range(200)]
    # Chains whose neighbours link just so or just not so.
    for step in (27, 28, 29, 30, 31):
        rows += [(10_000 + step * 100 + k, " ".join(words[k * step : k * step + 200 - 4] + ["x%d-%d" % (step, i) for i in range(k * step)])) for k in range(4)]
    rows += [(20_000 + n, " ".join("z%d" % i for i in range(n))) for n in range(1, 30)]
    want = brute(rows)
    assert run(spark, rows) == want
    real = J.levels_of
    monkeypatch.setattr(J, "levels_of", lambda c: np.where(real(c) > 0, 10, 9).astype(np.uint8))
    assert run(spark, rows) == want


def test_small_shares_of_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(J, "MAIN_ROWS", 5)
    monkeypatch.setattr(J, "OTHER_ROWS", 3)
    rows = corpus(5, groups=6, size=30)
    assert run(spark, rows) == brute(rows)


def test_rows_of_all_kinds(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "lonely row without id at all"), (8, "long " * 30_000), (9, "é É"), (10, "É é")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, "x")])[:1] == [(1, 1, 1)]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.component_ids(df).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in J.op8_ngram_jaccard_join(spark, sf).collect()), key=str) == brute(rows)
