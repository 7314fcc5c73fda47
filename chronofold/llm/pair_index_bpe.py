"""BPE encoding and decoding by a pair occurrence index.

All distinct new words of a batch lie in one linked symbol array. The index maps each adjacent pair that has a merge
to the positions of all its occurrences; the active ranks leave a heap in ascending order, every occurrence of a rank is
merged from left to right, and the two pairs that each merge makes are put into the index. A merge can only make pairs
of a higher rank (a token exists only after the merge that makes it), which is checked when the table is read, so the order
of the ranks in every word is the one that encoding word by word gives.

The normalizer, the splitting and the special tokens are those of the tokenizer's file. Words are kept per worker, the
memory starting anew beyond KEPT pieces.

Nulls and empty texts give no ids and decode to the empty text. Rows that repeat are kept. Columns besides doc_id and text
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._common import by_bytes, distinct, table
from .tokens import whole, word_parts

#: Pieces kept per worker, and their characters; beyond either the memory starts anew.
KEPT, KEPT_CHARS = 700_000, 20_000_000
#: Pieces whose lower case and splitting need no tables of Unicode: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_made: dict[str, "PairIndexBpe"] = {}


#: Fixed values of the splitting and normalizing that the short way for plain pieces follows; other files go the library's way.
KNOWN_RULE = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
KNOWN_NORMALIZER = ["NFC", "Replace", "Lowercase"]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level tokenizers write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairIndexBpe:
    """A word-level BPE tokenizer (pieces end in a suffix, no unknown token) read from a tokenizers JSON file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        data = json.load(open(path, encoding="utf-8"))
        model = data["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or data.get("decoder") or data.get("post_processor") or not model.get("end_of_word_suffix"):
            raise ValueError("only BPE with word ends and without decoder and post-processor")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.text_of = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.special.items()}
        self.pairs: list[tuple[int, int, int]] = []
        made = set()
        parts = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        results = {a + b for a, b in parts}
        for a, b in parts:
            if (a in results and a not in made) or (b in results and b not in made) or a + b in made:
                raise ValueError("a merge uses a token before it is made, or makes one twice")
            made.add(a + b)
            self.pairs.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
        keys = np.array([a << 32 | b for a, b, _ in self.pairs], np.int64)
        self.rank_of_key = np.argsort(keys)
        self.keys = keys[self.rank_of_key]
        self.letters = byte_letters()
        self.first, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for letter, b in self.letters.items():
            self.first[b], self.last[b] = self.vocab[letter], self.vocab[letter + self.suffix]
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+") if KNOWN_RULE in json.dumps(data["pre_tokenizer"]) and KNOWN_NORMALIZER == [n["type"] for n in (data["normalizer"] or {}).get("normalizers", [])] else None
        self.reset()

    def reset(self) -> None:
        self.kept: dict[str, int] = {}
        self.chars = 0
        self.counts: list[int] = []
        self.ids_of: list[str] = []
        self.decoded_of: list[str] = []

    @classmethod
    def of(cls, path: str) -> "PairIndexBpe":
        """One per worker process."""
        if path not in _made:
            _made[path] = cls(path)
        return _made[path]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where no merge has it."""
        pairs = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.rank_of_key[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each given by its bytes (at least one): (all ids, where each word's begin and the last ends)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        symbol = self.first[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = -1, -1
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            known = ranks >= 0
            ranks, places = ranks[known], places[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for r, b, e in zip(ranks[begins].tolist(), begins, [*begins[1:], len(ranks)]):
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(places[b:e])

        inner = np.flatnonzero(after >= 0)
        add(self._ranks(symbol[inner], symbol[inner + 1]), inner)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.pairs[r]
            held = index.pop(r)
            at = held[0] if len(held) == 1 else distinct(np.concatenate(held))
            at = at[symbol[at] == a]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping occurrences the left one counts
                taken, keep = -1, []
                for i in at.tolist():
                    if i != taken:
                        keep.append(i)
                        taken = int(after[i])
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = new, -1
            right = after[gone]
            after[at] = right
            some = right >= 0
            before[right[some]] = at[some]
            left = before[at]
            left = left[left >= 0]
            right = at[some]
            add(self._ranks(np.concatenate([symbol[left], symbol[right]]), np.concatenate([symbol[after[left]], symbol[after[right]]])), np.concatenate([left, right]))
        alive = symbol >= 0
        return symbol[alive], np.concatenate([[0], np.cumsum(alive)[ends - 1]])

    def _split(self, piece: str) -> list[bytes | int]:
        """The bytes of words, and ids of special tokens, of a piece without ASCII white space."""
        if self.plain and "<|" not in piece and _PLAIN.fullmatch(piece):
            return [w.encode() for w in self.plain.findall(piece.lower())]
        found: list[bytes | int] = []
        for part in self.special_re.split(piece) if self.special_re else [piece]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                normal = self.normalizer.normalize_str(part) if self.normalizer else part
                found += [bytes(map(self.letters.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(normal) if w]
        return found

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where counts, ids_of and decoded_of hold what each piece has; new ones are encoded together."""
        if len(self.kept) + len(pieces) // 2 > KEPT or self.chars > KEPT_CHARS:
            self.reset()
        found = np.fromiter(map(self.kept.get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(found < 0)
        if len(at):
            new = [pieces[k] for k in at.tolist()]
            split = [self._split(p) for p in new]
            words = list({w for ws in split for w in ws if isinstance(w, bytes)})
            flat, cuts = self.merge(words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
            flat, cuts = flat.tolist(), cuts.tolist()
            ids_of = {w: flat[b:e] for w, b, e in zip(words, cuts, cuts[1:])}
            n = len(self.kept)
            self.kept.update(zip(new, range(n, n + len(new))))
            self.chars += sum(map(len, new))
            for ws in split:
                ids = ids_of[ws[0]] if len(ws) == 1 and isinstance(ws[0], bytes) else [x for w in ws for x in ((w,) if isinstance(w, int) else ids_of[w])]
                self.counts.append(len(ids))
                self.ids_of.append(" ".join(map(str, ids)))
                self.decoded_of.append(self.decode(ids))
            found[at] = np.arange(n, n + len(new))
        return found

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts with blanks between them; ids without a token are left out."""
        known = self.text_of
        return " ".join([known[i] for i in ids if i in known])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of each text the number of ids, the ids in decimal and the decoded text, joined by blanks."""
        parts = word_parts(whole(texts)) if self.plain else pc.ascii_split_whitespace(whole(texts))
        coded = parts.flatten().dictionary_encode()
        at, offsets = coded.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy()
        kept = self.places(coded.dictionary.to_pylist())
        own = kept.tolist()
        counts = np.array([self.counts[k] for k in own], np.int64)
        each = counts[at] if len(at) else np.zeros(0, np.int64)
        some = each > 0
        upto = np.concatenate([[0], np.cumsum(some)])[offsets]
        at = pa.array(at[some])
        joined = [pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array([held[k] for k in own], pa.string()).take(at)), " ") for held in (self.ids_of, self.decoded_of)]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[offsets]), *joined

    def encode(self, text: str) -> list[int]:
        found = self.batch(pa.array([text]))[1][0].as_py()
        return [int(i) for i in found.split(" ")] if found else []


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256 (decimal ids joined by blanks) and decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBpe.of(tokenizer_path)
        sha = hashlib.sha256
        for batch in by_bytes(batches, "text"):
            counts, ids, decoded = bpe.batch(batch.column("text"))
            digests = [pa.array([sha(x.as_buffer()).hexdigest() for x in column], pa.string()) for column in (ids, decoded)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row doc_id, ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBpe.of(tokenizer_path)
        for batch in by_bytes(batches, "text", 2 << 20):
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op9_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_pair_index_bpe": op9_pair_index_bpe}
ORACLE_SQL: dict[str, str] = {}
