import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronofold.llm import rans_store as R
from chronofold.llm._common import shared_dir


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=600), st.integers(1, 40), st.integers(1, 5))
def test_block_round_trip(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    if not len(ids):
        return
    t = R.Table(*R.frequencies(ids))
    codes = np.searchsorted(t.symbols, ids).astype(np.uint32)
    data = R.encode_block(codes, t, lanes, every)
    assert (t.symbols[R.decode_block(data, t)] == ids).all()
    marks = int.from_bytes(data[12:16], "little")
    for k in range(1, marks + 1):
        assert (t.symbols[R.decode_block(data, t, k)] == ids[k * every * lanes :]).all()


def test_segment_checks():
    ids = np.random.default_rng(0).zipf(1.3, 50_000).clip(0, 49_407).astype(np.uint32)
    data = R.encode_segment([1, None, 3], np.array([20_000, 0, 30_000]), ids)
    docs, counts, back = R.decode_segment(data)
    assert docs == [1, None, 3] and list(counts) == [20_000, 0, 30_000] and (back == ids).all()
    assert len(data) < 2 * len(ids)
    for at in (10, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            R.decode_segment(bytes(bad))


def brute(rows, path, end):
    t, out, start = Tokenizer.from_file(path), [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_equals_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, "Hello  wörld <|endoftext|> x"), (2, None), (9, ""), (2, "same id"), (None, "no id"), (7, "a b " * 20_000), (8, "don't ÉÉ 12\n\nstop")]
    docs = spark.createDataFrame([(d, x, "clash", 1) for d, x in rows], "doc_id long, text string, path string, n_tokens int")
    segments = R.write_ids(docs, path, shared_dir(spark, "t"), 1, partitions=3).persist()
    got = [tuple(r) for r in R.read_ids(segments).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows, path, 1)
    assert R.read_ids(R.write_ids(docs.limit(0), path, shared_dir(spark, "t"), 1)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in R.op3_rans_token_store(spark, sf).collect()), key=lambda r: r[1])
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows, public_tokenizers.path("word_bpe_49k.json"), 1)
