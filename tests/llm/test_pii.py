import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import pii as P

#: The contract's own patterns.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for k, n in enumerate(P.KINDS):
        for m in re.finditer(BASE[n], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if n == "email" or n == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or n == "card" and 14 <= len(d) <= 19 and luhn(d) or n == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, n, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "mail jo.doe@x.example.com, or a@b@c.de_f@g.hi!", "1.2.3.4.5.6.7.8 300.1.1.1 010.000.1.0255 9999999999.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "+1 (293) 555-9179, +12, +49 30 1234567890123456", "é🙂 x@y.zz 日本 1.1.1.1 🙂 +441234567890", "9" * 40_000, "1 2 " * 30_000, "a.b" * 40_000, "a" * 100_000 + "@" + "b." * 20_000 + "c", "+" * 20_000, "+1" + "(" * 50_000,
    "0" * 14, "00000000000000 0000000000000000000", "1-2-3-4-5-6-7-8-9-0-1-2-3-4", "@a.b a@.b a@b. a@b.c.", "x" * 3000 + " a@b.cd " + "y" * 3000, "4111  1111", "5.5.5.5@6.6.6.6.com", "same text a@b.cd", "same text a@b.cd",
]


def digest(spans):
    return hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in spans).encode()).hexdigest()


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(want), (texts[r.doc_id] or "")[:80]
        assert [r[f"n_{n}"] for n in P.KINDS] == [sum(x[2] == n for x in want) for n in P.KINDS]
        assert {f"{n}:{s}:{e}" for s, _, n, e in want} <= set(r.spans.split(","))


def run(spark, texts, tmp_path, more=""):
    path = str(tmp_path / "sf")
    spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, base string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return P.op5_pii_weak_supervision(spark, path).collect()


def test_base_spans_equal_the_contract(spark, tmp_path):
    check(run(spark, TEXTS, tmp_path), TEXTS)
    assert run(spark, [], tmp_path) == []


def test_random_texts(spark, tmp_path):
    import random

    r = random.Random(7)
    bits = ["@", ".", "a", "b1", "12", "1", "255", "256", " ", "-", "+", "(", ")", "4111111111111111", "é", "🙂", "\n", "_", "%", "x.y", "4111 1111 1111 1111"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    check(run(spark, texts, tmp_path), texts)


def test_loose_spans_are_added(spark, tmp_path):
    texts = [f"please mail jo{k}@host.com or call +1 (293) 555-91{k:02d} from ip 10.1.2.{k}, card 4111111111111111" for k in range(40)]
    texts += ["please mail mary (at) host (dot) com", "call my phone (293) 555-9179 now", "version token 293.555.9179x", "nothing here"]
    rows = {r.doc_id: r.spans for r in run(spark, texts, tmp_path)}
    assert rows[40] == "email:12:36" and rows[41] == "phone:14:28" and rows[43] == ""


def test_expectation_maximisation_finds_reliabilities():
    good, bad = (1, 0, 1, 1, 0, 1), (0, 1, -1, 0, -1, -1)
    post, chance = P.expectation_maximisation({(0, good): 900, (0, bad): 80, (0, (0, 1, 1, 1, 0, 1)): 20})
    assert post[0, good] > 0.99 and post[0, bad] < 0.2 and post[0, (0, 1, 1, 1, 0, 1)] > 0.5
    assert abs(sum(chance[0, 2, 1, v] for v in (-1, 0, 1)) - 1) < 1e-9


def test_redact_keeps_columns(spark):
    rows = [(1, "é a@b.cd +1 (293) 555-9179.", 5), (2, None, 6), (3, "clean", 7), (4, "1.1.1.1@x.yz", 8)]
    df = spark.createDataFrame(rows, "doc_id long, Text string, base int")
    got = {r.doc_id: (r.Text, r.base) for r in P.redact(df).collect()}
    assert got == {1: ("é <email> <phone>.", 5), 2: (None, 6), 3: ("clean", 7), 4: ("<email>", 8)}


@settings(max_examples=200)
@given(st.text(alphabet="0123456789", min_size=1, max_size=19))
def test_luhn(d):
    total = 0
    for i, c in enumerate(d, 1):
        x = int(c) * (2 if (len(d) - i) % 2 == 1 else 1)
        total += x - 9 if x > 9 else x
    assert (total % 10 == 0) == luhn(d)
