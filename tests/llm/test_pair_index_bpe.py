import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronofold.llm import pair_index_bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_padding()
LIBRARY.no_truncation()


def brute(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "the", "ing", "'s", "'LL", " ", "\n", "\x0b", "\x1c", "\x85", " ", "é", "é", "İ", "ΑΣ", "12", "!!", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "<|", "\x00"]) | st.text(max_size=4), max_size=20))
def test_equals_library(parts):
    text = "".join(p for p in parts if not any(0xD800 <= ord(c) < 0xE000 for c in p))
    bpe = B.PairIndexBpe.of(PATH)
    ids, decoded = brute(text)
    assert bpe.encode(text) == ids
    assert bpe.decode(ids) == decoded


def test_rows_of_all_kinds(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "aaaa" * 30_000), (4, "word " * 20_000 + "́ end"), (5, "é é <|endoftext|>")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_tokens int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(d), len(i), sha(" ".join(map(str, i))), sha(s)) for d, t in rows for i, s in [brute(t)])
    assert sorted((str(r[0]), *r[1:]) for r in B.encode_digests(docs, PATH).collect()) == want
    assert B.encode_digests(docs.limit(0), PATH).count() == 0
    got = {r.doc_id: (r.ids, r.decoded) for r in B.encode_ids(docs, PATH).collect()}
    assert got[4] == brute(rows[5][1])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in B.op9_pair_index_bpe(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, decoded = brute(t)
        assert got[d] == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
