"""Exact Jaccard self-join on word n-grams: size-banded tiles with hashed bitmap signatures.

A document's set is its distinct shingles of five words (lower case A-Z; words between ASCII white space; fewer words make one shingle),
as 64-bit hashes. Two documents link when 100 * |A and B| >= 75 * |A or B|.

1. A count of all shingles by hash slot (2**20 slots, so one megabyte whatever the corpus) puts the hashes into a global order, frequent
   slots last. Any order is right; this one keeps passages that many documents share out of the prefixes.
2. Linked sets share one of their first |A| - ceil(0.75 |A|) + 1 shingles in that order. These postings go, packed, to buckets of shingles, as
   many as the count asks for; each list is cut where the next larger set is too large for any pair across, and what holds two or more documents
   is put into the tile of its smallest one. A shingle whose slot is very frequent is split into pairs of shares of the documents, as many as
   its count asks for, so that its lists do not grow with the corpus.
3. In each tile that smallest document is compared with the others; pairs that the check below confirms are joined into components.
4. Tiles that still hold several components are put together by their smallest component and cut into bands of set size, each compared with
   itself and the next: pairs of different components go on if their sizes and wider bitmaps allow a link. |A xor B| is at least the number of bits
   that differ, which bounds |A and B| from above. What is left is checked and joined too: first the most alike pair of each two components of a
   tile; then, of components that had such a pair and are still apart, all pairs. As every pair that may link is compared in the end or is in one
   component before, no link is lost. Large tiles are dealt to several tasks by shares of their documents.
The check of a pair: size and bitmap bound first, then the intersection of the sorted arrays. The table is read once for the count, once for
the postings and up to three times for the sorted arrays of the texts that pairs ask for; it has to give the same rows each time.
Intermediate tables go as soon as the next one is written.

Equal sets link without a comparison. Copies need not be expanded: pairs that are in one component already are not compared.

Nulls: a null text is empty; a text without words has an empty set and links with nothing. Rows that repeat, and rows with equal doc_ids, are
separate documents. A null doc_id is never a component's id unless all its documents have none. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ROWS_A_TASK, by_bytes, discard, distinct, give_back, materialize, table
from .components import components, moves
from .tokens import whole

WORDS = 5
SLOT_BITS, CHUNKS = 20, 16
#: Least and most bits of a filter, as powers of two; 2 MB at most. Tasks that fill one; more only beyond 2**24 rows a task.
FILTER_BITS, FILTER_TASKS = (16, 24), 16
#: Postings of a task that are packed at a time, and of a bucket; from this level on a shingle's list is split, into lists of about LIST documents.
HELD, BUCKET, HOT_LEVEL, LIST = 500_000, 500_000, 8, 200_000
#: Signatures that a task remembers, so that it sends a set met again only once.
SEEN = 100_000
#: Rows of one component, and of others, that a task of the last comparison holds, and the bytes of their bitmaps.
MAIN_ROWS, OTHER_ROWS, SHARE_BYTES = 8192, 4096, 16 << 20
_M, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters their bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in a row, where each text's begin and the last ends); repeated shingles stay."""
    import pandas as pd

    parts = pc.ascii_split_whitespace(pc.ascii_lower(whole(texts)))
    coded = parts.flatten().dictionary_encode()
    at, offsets = coded.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy().astype(np.int64)
    words = coded.dictionary.to_pylist()
    hashes = pd.util.hash_array(np.array([*words, ""], object), categorize=False)[:-1]
    if "" in words:
        some = at != words.index("")
        offsets = np.concatenate([[0], np.cumsum(some)])[offsets]
        at = at[some]
    w = hashes[at]
    counts = np.diff(offsets)
    n = len(w)
    h = w[: max(0, n - WORDS + 1)].copy()
    for k in range(1, WORDS):
        h *= _M
        h += w[k : n - WORDS + 1 + k]
    h = mix(h)
    begins = offsets[:-1]
    sizes = np.where(counts == 0, 0, np.maximum(1, counts - WORDS + 1))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    owner = np.repeat(np.arange(len(counts)), sizes)
    place = np.arange(len(out)) - (ends - sizes)[owner] + begins[owner]
    full = (counts >= WORDS)[owner]
    out[full] = h[place[full]]
    for d in np.flatnonzero((counts > 0) & (counts < WORDS)):
        x = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for v in w[begins[d] : begins[d] + counts[d]]:
                x = mix(np.array([x * _M + v]))[0]
        out[ends[d] - 1] = x
    return out, np.concatenate([[0], ends])


def slot_counts(df: DataFrame, slots_of, bits: int) -> np.ndarray:
    """How often each of 2**bits slots occurs; slots_of: slots of a record batch. Tasks send their counts in chunks, which are added up as they come."""
    size = (1 << bits) // CHUNKS

    def narrow(p: np.ndarray) -> np.ndarray:
        return p.astype(np.uint8 if p.max() < 1 << 8 else np.uint16 if p.max() < 1 << 16 else np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.int64)
        for batch in batches:
            held += np.bincount(slots_of(batch), minlength=1 << bits)
        parts = [(c, held[c * size : (c + 1) * size]) for c in range(CHUNKS)]
        sent = [(c, narrow(p)) for c, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sent], pa.int32()), pa.array([p.dtype.itemsize for _, p in sent], pa.int32()), pa.array([p.tobytes() for _, p in sent], pa.binary())], ["chunk", "width", "counts"])
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, width, data in zip(*(x.to_pylist() for x in batch.columns)):
                part = np.frombuffer(data, {1: np.uint8, 2: np.uint16, 8: np.int64}[width])
                sums[c] = sums[c] + part if c in sums else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])

    rows = df.mapInArrow(count, "chunk int, width int, counts binary").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    out = np.zeros(1 << bits, np.int64)
    for chunk, data in zip(rows["chunk"].to_pylist(), rows["counts"].to_pylist()):
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(data, np.int64)
    return out


def filter_slot(ids: pa.Array, bits: int) -> np.ndarray:
    return (mix(ids.to_numpy().astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def slots_filled(ids: DataFrame, rows: int) -> np.ndarray:
    """Which slots the numbers of all columns fall into, as packed bits: about eight slots a number, as far as FILTER_BITS go. ids: a written table of `rows` rows."""
    low, high = FILTER_BITS
    bits = min(high, max(low, (8 * rows * len(ids.columns)).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            for column in batch.columns:
                at = filter_slot(column, bits)
                np.bitwise_or.at(packed, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << bits - 3, np.uint8)
    for data in ids.coalesce(max(FILTER_TASKS, rows >> 24)).mapInArrow(mark, "bits binary").toArrow()["bits"].to_pylist():
        out |= np.frombuffer(data, np.uint8)
    return out


def in_filter(packed: np.ndarray, ids: pa.Array) -> pa.Array:
    at = filter_slot(ids, 3 + (len(packed) - 1).bit_length())
    return pa.array((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))


def asked_for(rows: DataFrame, column: str, ids: DataFrame, count: int) -> DataFrame:
    """rows without most of those whose `column` is not among ids, `count` of them: a filter of bounded size, so that they need not be shuffled for a join."""
    wanted = slots_filled(ids, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(in_filter(wanted, batch.column(column)))

    return rows.mapInArrow(run, rows.schema)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """0 for a slot as full as chance makes it, one more for each doubling of the excess."""
    mean = counts.mean()
    excess = (counts - mean) / (4 * np.sqrt(mean) + 4)
    return np.clip(np.floor(np.log2(np.maximum(excess, 0.5))) + 1, 0, 15).astype(np.uint8)


def shares_of(counts: np.ndarray, levels: np.ndarray) -> dict[int, int]:
    """Into how many shares the documents with a shingle of a very frequent slot are cut: a power of two; a list holds two shares."""
    hot = np.flatnonzero(levels > HOT_LEVEL)
    return {s: max(1 << int(levels[s]) - HOT_LEVEL, 1 << (2 * int(counts[s]) // LIST).bit_length()) for s in hot.tolist()}


def bitmap(tokens: np.ndarray, times: int = 2) -> bytes:
    """A set's bits: 2**k of them, at least `times` as many as elements and at least 64."""
    width = max(64, 1 << (times * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bits (bytes of a bitmap) of the same set at a smaller width."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def pack48(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.sort(tokens & np.uint64((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def in_order(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """60 bits of each hash below its slot's level: numbers that sort in the global order."""
    return levels[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(60) | h >> np.uint64(4)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    m = mix(tokens)
    return int(m.sum(dtype=np.uint64).astype(np.int64)), int((m * m + tokens).sum(dtype=np.uint64).astype(np.int64))


def links(na: int, nb: int, common: int) -> bool:
    return 100 * common >= 75 * (na + nb - common)


SETS = "kind int, uid long, doc_id long, key long, n int, s1 long, s2 long, bits binary, wide binary, bucket int, postings binary"
KEYED = ("cast(doc_id as bigint) as doc_id", "cast(text as string) as text", "xxhash64(cast(text as string)) as key")


def build_sets(docs: DataFrame, levels: np.ndarray, shares_by_slot: dict[int, int], buckets: int) -> DataFrame:
    """Rows of kind 0: a document's text key, set size, signature and bitmap. Rows of kind 1: packed postings."""
    names = [x.split()[0] for x in SETS.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SETS.split(", ")]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        seen: set[tuple[int, int]] = set()
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        bands: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal held
            k, o, q = np.concatenate(keys), np.concatenate(owners), np.concatenate(bands)
            for x in (keys, owners, bands):
                x.clear()
            held = 0
            b = (k % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            k, o, q, b = k[order], o[order], q[order], b[order]
            cuts = np.searchsorted(b, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            blobs = [np.ascontiguousarray(k[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:7]).tobytes() + o[x:y].astype("<u4").tobytes() + q[x:y].tobytes() for x, y in zip(cuts[some].tolist(), cuts[some + 1].tolist())]
            return rows(kind=[1] * len(some), uid=[TaskContext.get().partitionId() << 40] * len(some), bucket=some, postings=blobs)

        for batch in by_bytes(batches, "text", 4 << 20):
            h, cuts = shingles(batch.column("text"))
            ranked = in_order(h, levels)
            own, sizes, s1, s2, bits, wide = [], [], [], [], [], []
            for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
                r = distinct(ranked[a:z])
                n = len(r)
                own.append(uid)
                sizes.append(n)
                sig = signature(r)
                s1.append(sig[0])
                s2.append(sig[1])
                bits.append(bitmap(r) if n else b"")
                wide.append(bitmap(r, 4) if n else b"")
                if n and sig not in seen:
                    if len(seen) < SEEN:
                        seen.add(sig)
                    first = r[: n - (75 * n + 99) // 100 + 1]
                    level = (first >> np.uint64(60)).astype(np.int64)
                    keys.append(mix(first[level <= HOT_LEVEL]))
                    for x in first[level > HOT_LEVEL].tolist():
                        shares = shares_by_slot[x >> 60 - SLOT_BITS & (1 << SLOT_BITS) - 1]
                        i = (uid * 0x9E3779B97F4A7C15 >> 20) % shares
                        pairs = np.array([(x + (min(i, j) * shares + max(i, j) + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1 for j in range(shares)], np.uint64)
                        keys.append(mix(pairs))
                    total = sum(map(len, keys[len(owners) :]))
                    keys[len(owners) :] = [np.concatenate(keys[len(owners) :])]
                    owners.append(np.full(total, uid & (1 << 40) - 1, np.uint32))
                    bands.append(np.full(total, min(255, int(16 * np.log2(n))), np.uint8))
                    held += total
                uid += 1
            yield rows(kind=[0] * len(own), uid=own, doc_id=batch.column("doc_id"), key=batch.column("key"), n=sizes, s1=s1, s2=s2, bits=bits, wide=wide)
            if held > HELD:
                yield packed()
        if held:
            yield packed()
        give_back()

    return docs.selectExpr(*KEYED).mapInArrow(run, SETS)


def tiles_of(sets: DataFrame, buckets: int) -> DataFrame:
    """pivot, uid, q (sixteenths of doublings of its size), near (whether its size and the pivot's allow a link): the lists of two or more documents,
    put together by their smallest document, the pivot, which is one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, uids, bands = [], [], []
        for batch in batches:
            for base, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("uid", "bucket", "postings"))):
                n = len(data) // 11
                k = np.zeros((n, 8), np.uint8)
                k[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(-1, 6)
                keys.append(k.view("<u8").ravel() << np.uint64(16) | np.uint64(bucket & 0xFFFF))
                uids.append(np.frombuffer(data, "<u4", n, 6 * n).astype(np.int64) + base)
                bands.append(np.frombuffer(data, np.uint8, n, 10 * n))
        if not keys:
            return
        k, u, q = np.concatenate(keys), np.concatenate(uids), np.concatenate(bands).astype(np.int64)
        for x in (keys, uids, bands):
            x.clear()
        order = np.lexsort((q, k))
        k, u, q = k[order], u[order], q[order]
        # A step of 8 sixteenths of a doubling between neighbouring sizes is more than 4 to 3: no pair across it links.
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (q[1:] - q[:-1] >= 8), [True]]))
        sizes = np.diff(edge)
        many = sizes > 1
        begin, sizes = edge[:-1][many], sizes[many]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        u, q = u[at], q[at]
        del k, at, order
        order = np.lexsort((u, owner))
        u, q, owner = u[order], q[order], owner[order]
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(u) else np.zeros(0, bool)
        keep = first.copy()
        keep[1:] |= u[1:] != u[:-1]
        u, q, owner, first = u[keep], q[keep], owner[keep], first[keep]
        if not len(u):
            return
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(u)))
        pivot, at_pivot = np.repeat(u[starts], counts), np.repeat(q[starts], counts)
        several = np.repeat(counts > 1, counts)
        pivot, u, q, near = pivot[several], u[several], q[several], np.abs(q - at_pivot)[several] < 8
        order = np.lexsort((u, pivot))
        pivot, u, q, near = pivot[order], u[order], q[order], near[order]
        once = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (u[1:] != u[:-1])])) if len(u) else np.zeros(0, np.int64)
        for a in range(0, len(once), 1 << 18):
            at = once[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(pivot[at]), pa.array(u[at]), pa.array(q[at].astype(np.int32)), pa.array(near[at])], ["pivot", "uid", "q", "near"])
        give_back()

    return sets.where("kind = 1").select("uid", "bucket", "postings").repartition(buckets, "bucket").mapInArrow(run, "pivot long, uid long, q int, near boolean")


def with_sides(pairs: DataFrame, plain: DataFrame, *more: str) -> DataFrame:
    """pairs (a, b and others) with n, key, s1, s2 and more of both sides."""
    side = lambda c: plain.select(*[F.col(x).alias(c if x == "uid" else f"{x}{c}") for x in ("uid", "n", "key", "s1", "s2", *more)])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def may_link(pairs: DataFrame, plain: DataFrame) -> DataFrame:
    """The pairs a, b (with la, lb) whose sizes and bitmaps allow a link, with both sides' n, key, s1 and s2."""
    rows = with_sides(pairs, plain, "bits").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    names = ["a", "b", "la", "lb", *[f"{x}{c}" for c in "ab" for x in ("n", "key", "s1", "s2")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (na, nb, x, y) in enumerate(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("bitsa"), batch.column("bitsb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                keep[k] = links(na, nb, (na + nb - apart) // 2)
            yield batch.select(names).filter(pa.array(keep))

    return rows.mapInArrow(run, ", ".join(f"{n} {'int' if n in ('na', 'nb') else 'long'}" for n in names))


def verified(pairs: DataFrame, plain: DataFrame, docs: DataFrame, levels: np.ndarray, bound: int, bounded: bool = False) -> DataFrame:
    """The pairs a, b (with la, lb) that link.

    The sorted sets (48 bits of each hash) are made again from the texts, only of texts whose key is in a filter of bounded size
    that the surviving pairs fill, so that sets nobody asks for are neither kept nor shuffled.
    bound: of the number of pairs. bounded: sizes and bitmaps allow each of them a link already, and pairs is a written table.
    """
    if not bounded:
        near = materialize(may_link(pairs, plain), "jaccard-near", 16 * bound)
    else:
        described = asked_for(plain.select("uid", "n", "key", "s1", "s2"), "uid", pairs.select("a", "b"), bound)
        near = materialize(with_sides(pairs, described), "jaccard-near", bound)
    count, size = near.agg(F.count("*"), F.coalesce(F.sum(F.col("na").cast("long") + F.col("nb")), F.lit(0))).first()
    wanted = slots_filled(near.select("keya", "keyb"), count)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for whole_batch in batches:
            some = whole_batch.filter(in_filter(wanted, whole_batch.column("key")))
            for batch in by_bytes(iter([some]), "text", 4 << 20):
                h, cuts = shingles(batch.column("text"))
                ranked = in_order(h, levels)
                found = []
                for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
                    r = distinct(ranked[a:z])
                    sig = signature(r)
                    if sig not in seen:
                        if len(seen) < SEEN:
                            seen.add(sig)
                        found.append((*sig, pack48(r)))
                if found:
                    s1, s2, tokens = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(tokens, pa.binary())], ["s1", "s2", "tokens"])
        give_back()

    # Six bytes an element, four megabytes a task; each set once, in a written table, so that adaptive execution can split a set with many pairs.
    sets = docs.selectExpr(*KEYED[1:]).mapInArrow(asked, "s1 long, s2 long, tokens binary")
    once = materialize(sets.dropDuplicates(["s1", "s2"]), "jaccard-sets", ROWS_A_TASK * (6 * size >> 22))
    side = lambda c: once.select(*[F.col(x).alias(f"{x}{c}") for x in ("s1", "s2", "tokens")])
    rows = near.join(side("a"), ["s1a", "s2a"]).join(side("b"), ["s1b", "s2b"]).select("a", "b", "la", "lb", "na", "nb", "tokensa", "tokensb")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (na, nb, ta, tb) in enumerate(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("tokensa"), batch.column("tokensb"))):
                both = np.concatenate([unpack48(ta.as_buffer()), unpack48(tb.as_buffer())])
                both.sort()
                keep[k] = links(na, nb, int((both[1:] == both[:-1]).sum()))
            yield batch.select(["a", "b", "la", "lb"]).filter(pa.array(keep))
        give_back()

    # The rows that this stage reads hold whole sets: tasks by bytes, not by pairs.
    made = materialize(rows.mapInArrow(exact, "a long, b long, la long, lb long"), "jaccard-edges", ROWS_A_TASK * (6 * size >> 22))
    discard(near, once)
    return made


def across(n: np.ndarray, label: np.ndarray, bits: list[bytes], main: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of a tile that are in different components and may link, band by band, and the largest share they may have.

    With main, a label, only pairs with exactly one document of that component.
    """
    band = np.floor(np.log(n) / np.log(4 / 3) + 1e-9).astype(np.int64)
    raw = [np.frombuffer(b, np.uint8) for b in bits]
    for b in np.unique(band).tolist():
        own, near = np.flatnonzero(band == b), np.flatnonzero((band == b) | (band == b + 1))
        if len(np.unique(label[near])) < 2:
            continue
        size = min(len(raw[i]) for i in near.tolist())
        all_bits = np.stack([folded(raw[i], size) for i in near.tolist()]).view(np.uint64)
        sides = [(own, near)]
        if main is not None:  # this band's others against both bands' main component, the next band's others against this band's
            sides = [(own[label[own] != main], near[label[near] == main]), (near[(label[near] != main) & (band[near] > b)], own[label[own] == main])]
        for rows, columns in sides:
            if not len(rows) or not len(columns):
                continue
            at, cols = np.searchsorted(near, rows), np.searchsorted(near, columns)
            step = max(1, (2 << 20) // max(1, len(cols) * all_bits.shape[1]))
            for a in range(0, len(rows), step):
                r = rows[a : a + step]
                may = label[r][:, None] != label[columns][None, :]
                if main is None:
                    may &= (band[columns][None, :] > b) | (r[:, None] < columns[None, :])
                low, high = np.minimum(n[r][:, None], n[columns][None, :]), np.maximum(n[r][:, None], n[columns][None, :])
                may &= 4 * low >= 3 * high
                if not may.any():
                    continue
                apart = np.bitwise_count(all_bits[at[a : a + step]][:, None, :] ^ all_bits[cols][None, :, :]).sum(axis=2, dtype=np.int64)
                total = low + high
                common = (total - apart) // 2
                i, j = np.nonzero(may & (100 * common >= 75 * (total - common)))
                if len(i):
                    yield r[i], columns[j], common[i, j] / (total[i, j] - common[i, j])


def gathered(members: DataFrame, rows: int) -> DataFrame:
    """members (pivot, uid, q, label) of tiles with several components -> tile, uid, q, label.

    Tiles with the same smallest label become one larger tile, which that label names, so that a document is in it once and not in each of them.
    """
    ends = materialize(members.groupBy("pivot").agg(F.min("label").alias("tile"), F.max("label").alias("most")).where("tile <> most").select("pivot", "tile"), "jaccard-open", rows)
    made = materialize(members.join(ends, "pivot").select("tile", "uid", "q", "label").distinct(), "jaccard-gathered", rows)
    discard(ends)
    return made


def dealt(rows: DataFrame, bound: int) -> DataFrame:
    """rows (tile, uid, q, label) -> task (tile, x, y), main (a label or null), uid, label.

    A tile's rows of its smallest label, the main component, are cut into shares, and the others too; a task gets a share of each, or two shares of the others.
    """
    bytes_ = F.sum(F.pow(F.lit(2.0), F.col("q") / 16))
    labels = rows.groupBy("tile", "label").agg(F.count("*").alias("c"), bytes_.alias("w"))
    shares = lambda c, w, most: F.ceil(F.greatest(c / most, w / SHARE_BYTES)).cast("int")
    sums = labels.groupBy("tile").agg(F.min(F.struct("label", "c", "w")).alias("own"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("labels")).where("labels > 1")
    counts = sums.select("tile", F.col("own.label").alias("main"), shares(F.col("own.c"), F.col("own.w"), MAIN_ROWS).alias("mains"), shares(F.col("c") - F.col("own.c"), F.col("w") - F.col("own.w"), OTHER_ROWS).alias("others"), (F.col("labels") - 1).alias("labels"))
    held = materialize(counts, "jaccard-counts", bound)
    sized = rows.join(held, "tile")
    own = F.col("label") == F.col("main")
    share = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    i, j = share(F.col("mains")), share(F.col("others"))
    to_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(i.alias("x"), o.alias("y"), F.col("main").alias("m")))
    to_others = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: F.struct(m.alias("x"), j.alias("y"), F.col("main").alias("m")))
    between = F.when(F.col("labels") > 1, F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct((-1 - F.least(o, j)).alias("x"), F.greatest(o, j).alias("y"), F.lit(None).cast("long").alias("m")))).otherwise(F.array())
    both = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(None).cast("long").alias("m")))
    tasks = F.when((F.col("mains") == 1) & (F.col("others") == 1), both).when(own, to_main).otherwise(F.concat(to_others, between))
    made = sized.select("tile", "uid", "label", F.explode(tasks).alias("t")).select("tile", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.m").alias("m"), "uid", "label")
    return materialize(made, "jaccard-tasks", 2 * bound)


def most_alike(label: np.ndarray, found: list[tuple]) -> list[tuple]:
    """Of pairs (i, j, share) the most alike one of each two components."""
    i, j, share = (np.concatenate(x) for x in zip(*found))
    x, y = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
    order = np.lexsort((-share, y, x))
    first = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
    keep = order[first]
    return [(i[keep], j[keep], share[keep])]


def cross_pairs(rows: DataFrame, partitions: int, best: bool = False) -> DataFrame:
    """rows: tile, x, y (a task), m, uid, label, n, wide. Pairs a < b of a task in different components (la, lb) that size and bitmaps let link;
    with best, only the most alike pair of each two components."""
    ordered = rows.repartition(partitions, "tile", "x", "y").sortWithinPartitions("tile", "x", "y", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cuts(t) -> np.ndarray:
            k = [t[c].to_numpy() if isinstance(t, pa.Table) else t.column(c).to_numpy() for c in ("tile", "x", "y")]
            return np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1 if len(k[0]) else np.zeros(0, np.int64)

        def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
            tile, uid, label, n = t["tile"].to_numpy(), t["uid"].to_numpy(), t["label"].to_numpy(), t["n"].to_numpy().astype(np.int64)
            bits, main = t["wide"].to_pylist(), t["m"].to_pylist()
            edge = [0, *cuts(t).tolist(), t.num_rows]
            for a, z in zip(edge, edge[1:]):
                found = across(n[a:z], label[a:z], bits[a:z], main[a])
                if best:
                    kept: list[tuple] = []
                    for part in found:
                        kept = most_alike(label[a:z], [*kept, part])
                    found = iter(kept)
                for i, j, _ in found:
                    swap = uid[a:z][i] > uid[a:z][j]
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    columns = [np.full(len(i), tile[a]), uid[a:z][i], uid[a:z][j], label[a:z][i], label[a:z][j]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tile", "a", "b", "la", "lb"])

        last = None
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 2000):
                batch = whole_batch.slice(start, 2000)
                first = tuple(batch.column(c)[0].as_py() for c in ("tile", "x", "y"))
                if held and first != last:
                    yield from compared(pa.Table.from_batches(held))
                    held = []
                change = cuts(batch)
                if len(change):
                    cut = int(change[-1])
                    yield from compared(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = [batch.slice(cut)]
                else:
                    held.append(batch)
                last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in ("tile", "x", "y"))
        if held:
            yield from compared(pa.Table.from_batches(held))
        give_back()

    return ordered.mapInArrow(run, "tile long, a long, b long, la long, lb long")


def link_components(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> uid, doc_id, n_shingles, label: rows with the same label are connected by links."""
    spark = docs.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def slots(batch: pa.RecordBatch) -> np.ndarray:
        out = [shingles(b.column("text"))[0] for b in by_bytes(iter([batch]), "text", 4 << 20)]
        return (np.concatenate(out) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) if out else np.zeros(0, np.int64)

    counts = slot_counts(docs.selectExpr("cast(text as string) as text"), slots, SLOT_BITS)
    levels = levels_of(counts)
    buckets = buckets or max(64, 2 * partitions, int(counts.sum()) // (3 * BUCKET))
    sets = materialize(build_sets(docs, levels, shares_of(counts, levels), buckets), "jaccard-rows")
    plain = sets.where("kind = 0")
    rows = plain.count()
    copies = materialize(plain.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("c")).where("c > 1").select("s1", "s2", "n", "rep"), "jaccard-copies", rows)
    equal = plain.where("n > 0").select("uid", "s1", "s2", "n").join(copies, ["s1", "s2", "n"]).where("uid <> rep").select(F.col("rep").alias("a"), F.col("uid").alias("b"))
    tiles = materialize(tiles_of(sets, buckets).distinct(), "jaccard-tiles", int(counts.sum()) // 4 + rows)
    bound = tiles.count()
    stars = tiles.where("near and uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b"), F.col("pivot").alias("la"), F.col("uid").alias("lb"))
    found = verified(stars, plain, docs, levels, bound)
    labels = components(found.select("a", "b").unionByName(equal), rows + bound)
    discard(found, copies)
    named = labels.withColumnRenamed("node", "uid")
    members = materialize(tiles.join(named, "uid", "left").select("pivot", "uid", "q", F.coalesce("label", "uid").alias("label")), "jaccard-members", bound)
    apart = gathered(members, bound)
    discard(tiles, members)
    for best in (True, False):
        tasks = dealt(apart, bound)
        dealt_rows = tasks.count()
        bits = asked_for(plain.select("uid", "n", "wide"), "uid", tasks.select("uid"), dealt_rows)
        more = materialize(cross_pairs(tasks.join(bits, "uid"), partitions, best), "jaccard-cross", 64 * dealt_rows)
        discard(tasks)
        count = more.count()
        if not count:
            discard(more)
            break
        pairs = materialize(more.select("a", "b", "la", "lb").distinct(), "jaccard-pairs", count)
        second = verified(pairs, plain, docs, levels, count, bounded=True)
        joined = components(second.select(F.col("la").alias("a"), F.col("lb").alias("b")), count)
        moved = labels.join(moves(joined), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
        fresh = materialize(moved.unionByName(joined.join(labels, "node", "left_anti")), "jaccard-joined", rows)
        if best:
            # Components that may still link: those of the pairs compared that are not one now. All others had no pair to compare.
            now = lambda c: joined.select(F.col("node").alias(c), F.col("label").alias(f"new{c}"))
            ends = more.select("tile", "la", "lb").distinct().join(now("la"), "la", "left").join(now("lb"), "lb", "left").where("coalesce(newla, la) <> coalesce(newlb, lb)")
            left = materialize(ends.select("tile", F.explode(F.array(*[F.struct(F.col(c).alias("label"), F.coalesce(f"new{c}", c).alias("new")) for c in ("la", "lb")])).alias("x")).select("tile", "x.label", "x.new").distinct(), "jaccard-apart", 2 * count)
            fewer = materialize(apart.join(left, ["tile", "label"]).select("tile", "uid", "q", F.col("new").alias("label")), "jaccard-gathered", bound)
            discard(apart, left)
            apart = fewer
        discard(more, pairs, second, joined, labels)
        labels = fresh
        if not apart.count():
            break
    discard(apart)
    named = labels.withColumnRenamed("node", "uid")
    made = plain.select("uid", "doc_id", F.col("n").cast("long").alias("n_shingles")).join(named, "uid", "left").select("uid", "doc_id", "n_shingles", F.coalesce("label", "uid").alias("label"))
    kept = materialize(made, "jaccard-labels", rows)
    discard(sets, labels)
    return kept


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    found = link_components(docs)
    least = materialize(found.groupBy("label").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return found.join(least, "label").select("doc_id", "n_shingles", "component_id")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
ORACLE_SQL = {
    "op8_ngram_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4])) END AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, both_.b FROM r JOIN both_ ON r.other = both_.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
}
