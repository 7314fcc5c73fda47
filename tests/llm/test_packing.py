import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronofold.llm import packing as G

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120), st.integers(0, 99))
def test_operators_keep_packings_valid(sizes, seed):
    sizes, rng = np.sort(np.array(sizes, np.int64))[::-1], np.random.default_rng(seed)
    population = [G.packed(p) for p in G.first_packings(sizes, 100, 4, rng)]
    end = G.evolve(sizes, population, 100, 6, rng)
    for p in (*population, *end, G.crossover(sizes, population[0], population[1], 100, rng), G.mutate(sizes, population[0], 100, rng)):
        assert (p >= 0).all() and np.bincount(p, sizes).max() <= 100
    assert G.lower_bound(sizes, 100) <= end[0].max() + 1 <= population[0].max() + 1


def test_beats_best_fit():
    r = np.random.default_rng(0)
    s = -np.sort(-r.integers(300, 900, 2048))
    population = [G.packed(p) for p in G.first_packings(s, 2048, 6, r)]
    assert G.evolve(s, population, 2048, 24, r)[0].max() < population[0].max()


def brute(rows, capacity=2048):
    t, out = Tokenizer.from_file(PATH), []
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        cuts = list(range(len(ids), 0, -capacity))[::-1]
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            out.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def check(got, rows, slack):
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute(rows), key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    sizes = np.array([r.length for r in got], np.int64)
    assert len(bins) <= G.lower_bound(sizes, 2048) * (1 + slack) + 1, (len(bins), G.lower_bound(sizes, 2048))


@pytest.mark.parametrize("block", [50, 2048])
def test_rows_of_all_kinds(spark, block):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y  z"), (3, "hello world " * 8_000), (4, "a" * 2046), (5, "\n\n  odd <|endoftext|> text \n")] + [(k, "word and more. " * (k % 97 * 4)) for k in range(10, 400)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, uid string")
    check(G.pack(G.cut_pieces(df, PATH), block=block).collect(), rows, 0.05)
    assert G.pack(G.cut_pieces(df.limit(0), PATH)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(G.op6_grouping_genetic_packing(spark, sf).collect(), rows, 0.02)
