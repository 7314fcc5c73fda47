import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronofold.llm import fingerprints as P


def shingles(text):
    words = [w for w in "".join(" " if c in P.BLANKS else c for c in text.lower()).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (d, t) in enumerate(rows):
        t, follow = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out.append((d, t, t[: len(t) - cut] + follow[:cut], follow))
    return out


def check(got, rows, slack=0.16):
    want = edited(rows)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], r[2])
    mine = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r) for r in got), key=key)
    theirs = sorted(((d, len(t), hashlib.sha256(e.encode()).hexdigest(), (t, e, f)) for d, t, e, f in want), key=key)
    off = []
    for (d, n, s, r), (d2, n2, s2, (t, e, f)) in zip(mine, theirs):
        assert (d, n, s) == (d2, n2, s2)
        off += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, f)]
        few = min(len(shingles(x)) for x in (t, e, f)) < 30  # then digits that agree by chance count for much
        assert max(map(abs, off[-2:])) < (0.55 if few else slack), (d, off[-2:])
    return sum(off) / len(off)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["w%d" % k for k in range(3000)]
    return [(k * 3, " ".join(r.choice(words) for _ in range(r.choice([3, 8, 40, 300, 1500])))) for k in range(60)]


def test_likeness_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = P.edited_fingerprints(df).collect()
    assert abs(check(got, rows)) < 0.01


def test_runs_of_any_size(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.col("doc_id"))
    for size in (1, 7, 59, 1000):
        got = {r.doc_id: r.next_text for r in P.with_next(df, "k", ["text"], ["text"], size).collect()}
        assert got == {d: rows[(k + 1) % len(rows)][1] for k, (d, _) in enumerate(rows)}


def test_rows_of_all_kinds(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One  TWO three"), (5, "one two\nthree"), (7, "Ünï 日本 🙂 a b c d"), (7, "Ünï 日本 🙂 a b c d"), (None, "no id here at all today"), (9, "word " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, k int, fingerprint string")
    got = P.edited_fingerprints(df).collect()
    check(got, rows, 0.5)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[3].fingerprint == P.EMPTY and by[1].near_next == 1 and by[3].near_next == 0
    assert by[4].fingerprint == by[5].fingerprint and by[4].near_next == 1 and "." not in by[4].fingerprint
    assert P.edited_fingerprints(df.limit(0)).count() == 0
    one = P.edited_fingerprints(df.where("doc_id = 9")).first()
    assert one.near_next == 1


def test_no_python_in_the_plan(spark, rows, capsys):
    P.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").where("doc_id > 0")).explain()
    assert "Python" not in capsys.readouterr().out
