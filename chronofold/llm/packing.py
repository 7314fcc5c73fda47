"""Packing documents into sequences by a grouping genetic algorithm on islands.

A document's ids are cut into pieces of `capacity` where it is longer; the first piece is the remainder, and only it, or a whole shorter
document, has to be packed. Such items are dealt by a hash of their row into blocks of about BLOCK items. For each block several islands
evolve packings of the same items: a packing starts from best fit with shuffled or falling sizes; crossover injects a random choice of the
best-filled bins of one parent whole into the other, removes the bins that hold an item twice and best-fits what that displaces, largest
first; mutation empties a few bins, the emptiest among them, and best-fits their items. After each epoch the best packing of an island goes to the next island of its ring.
The best packing of a block stays, but the bins with room for SPARE tokens or more are opened again and their items packed
once more, in blocks of items from many first blocks, so that what is left over in one block meets the others'.

Every step works on rows of small state (sizes and packings as arrays); texts and ids are not shuffled.

Nulls: a null text is an empty document, which is its end id alone. Repeated rows are packed each. Empty tables give an empty result. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_bytes, give_back, materialize, table

CAPACITY = 2048
#: Items of a block, islands of a block, packings of an island, epochs and generations of an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2048, 2, 6, 3, 20
SPARE = 24
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Room:
    """Bins by their free room; finds the fullest one that takes a size."""

    def __init__(self, free: list[int]):
        self.free = free
        self.by: dict[int, list[int]] = {}
        self.mask = 0
        for b, f in enumerate(free):
            self._put(b, f)

    def _put(self, b: int, f: int) -> None:
        if f > 0:
            self.by.setdefault(f, []).append(b)
            self.mask |= 1 << f

    def place(self, size: int, capacity: int) -> int:
        fits = self.mask >> size
        if not fits:
            b, f = len(self.free), capacity
            self.free.append(f)
        else:
            f = size + (fits & -fits).bit_length() - 1
            held = self.by[f]
            b = held.pop()
            if not held:
                self.mask &= ~(1 << f)
        self.free[b] = f - size
        self._put(b, f - size)
        return b


def best_fit(sizes: np.ndarray, bins: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """bins (of each item, -1 where it has none, numbered from 0) with the items of `order` placed one after the other."""
    n = int(bins.max()) + 1 if len(bins) else 0
    known = bins >= 0
    fill = np.bincount(bins[known], sizes[known], n).astype(np.int64)
    room = _Room((capacity - fill).tolist())
    out = bins.copy()
    out[order] = [room.place(s, capacity) for s in sizes[order].tolist()]
    return out


def packed(bins: np.ndarray) -> np.ndarray:
    """The same packing with bins numbered without gaps."""
    return (np.cumsum(np.bincount(bins) > 0) - 1)[bins] if len(bins) else bins


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[float, float]:
    """Fewer bins first, then the sum of squared fillings: full bins beside nearly empty ones are the better start."""
    fill = np.bincount(bins, sizes)
    return -float(len(fill)), float(((fill / capacity) ** 2).sum())


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with some of b's best-filled bins injected."""
    fill = np.bincount(b, sizes)
    best = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(best, max(1, len(best) // 2), replace=False)] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    child = np.where(injected, b + len(broken), np.where(broken[a], -1, a))
    displaced = np.flatnonzero(child < 0)
    child[child >= 0] = packed(child[child >= 0])
    return best_fit(sizes, child, displaced[np.argsort(-sizes[displaced], kind="stable")], capacity)


def mutate(sizes: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(a, sizes)
    some = np.argsort(fill, kind="stable")[:2].tolist() + rng.choice(len(fill), min(len(fill), 1 + len(fill) // 12), replace=False).tolist()
    opened = np.zeros(len(fill), bool)
    opened[some] = True
    child = np.where(opened[a], -1, a)
    displaced = np.flatnonzero(child < 0)
    child[child >= 0] = packed(child[child >= 0])
    keys = sizes[displaced] * rng.uniform(0.7, 1.3, len(displaced))
    return best_fit(sizes, child, displaced[np.argsort(-keys, kind="stable")], capacity)


def first_packings(sizes: np.ndarray, capacity: int, count: int, rng: np.random.Generator) -> list[np.ndarray]:
    none = np.full(len(sizes), -1, np.int64)
    falling = np.argsort(-sizes, kind="stable")
    out = [best_fit(sizes, none, falling, capacity)]
    while len(out) < count:
        keys = sizes * rng.uniform(0.8, 1.25, len(sizes))
        out.append(best_fit(sizes, none, np.argsort(-keys, kind="stable"), capacity))
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by the sum, and with items beyond half a bin apart from what their bins can't take."""
    least = -(-int(sizes.sum()) // capacity)
    for k in np.unique(sizes[sizes <= capacity // 2])[:: max(1, len(sizes) // 256)].tolist():
        large, half = sizes > capacity - k, (sizes > capacity // 2) & (sizes <= capacity - k)
        rest = int(sizes[(sizes >= k) & (sizes <= capacity // 2)].sum()) - (int(half.sum()) * capacity - int(sizes[half].sum()))
        least = max(least, int(large.sum() + half.sum()) + max(0, -(-rest // capacity)))
    return max(least, int((sizes > capacity // 2).sum()))


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best packing first. It ends early once no packing can have fewer bins."""
    least = lower_bound(sizes, capacity)
    ranked = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2], reverse=True)
    count, serial = len(population), len(population)
    for _ in range(generations):
        if -ranked[0][0][0] <= least:
            break
        children = []
        for _ in range(max(1, count // 2)):
            i, j = sorted(rng.integers(0, count, 2).tolist())
            child = crossover(sizes, ranked[i][2], ranked[j if j != i else (i + 1) % count][2], capacity, rng)
            if rng.random() < 0.6:
                child = mutate(sizes, child, capacity, rng)
            child = packed(child)
            children.append((fitness(sizes, child, capacity), serial, child))
            serial += 1
        ranked = sorted([*ranked, *children], key=lambda x: x[:2], reverse=True)[:count]
    return [p for _, _, p in ranked]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, kind: str = "byte") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import PieceEncoder

        encoder = PieceEncoder.of(tokenizer_path, kind)
        for batch in by_bytes(batches, "text", 4 << 20):
            ids, each = encoder.encode(batch.column("text"))
            raw = memoryview(np.insert(ids, np.cumsum(each), np.uint32(end_id)).astype("<u4")).cast("B")
            sizes = each + 1
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
            head = (sizes - 1) % capacity + 1
            start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[owner], capacity)
            begin = (np.cumsum(sizes) - sizes)[owner] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, PIECES)


def pack_items(items: DataFrame, rows: int, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """items (uid, length and others) with block, bin (numbered from 0 in the block), offset and filled (of the bin).

    rows: how many items there are. The state of an island is a row: the sizes of its block and its packings.
    """
    blocks = max(1, -(-rows // block))
    tasks = max(1, min(blocks * islands, 8 * items.sparkSession.sparkContext.defaultParallelism))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    state = "block int, island int, home boolean, sizes binary, packings binary"

    def arrays(row: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        return sizes, list(np.frombuffer(row["packings"], "<i4").astype(np.int64).reshape(-1, len(sizes)))

    def rows_of(b: int, island: int, sizes: np.ndarray, population: list[np.ndarray]) -> list[tuple]:
        pack = lambda a: np.asarray(a, "<i4").tobytes()
        return [(b, island, True, pack(sizes), pack(np.stack(population))), (b, (island + 1) % islands, False, pack(sizes), pack(population[0]))]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["block", "island", "home", "sizes", "packings"])

    def found_islands(own: pd.DataFrame) -> pd.DataFrame:
        sizes = own.sort_values(["length", "uid"], ascending=[False, True])["length"].to_numpy(np.int64)
        b, out = int(own["block"].iloc[0]), []
        first = packed(best_fit(sizes, np.full(len(sizes), -1, np.int64), np.arange(len(sizes)), capacity))
        for island in range(islands):
            out.append((b, island, True, np.asarray(sizes, "<i4").tobytes(), np.asarray(first, "<i4").tobytes()))
        return frame(out)

    def epoch(number: int):
        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("home", ascending=False, kind="stable")
            b, island = int(own["block"].iloc[0]), int(own["island"].iloc[0])
            sizes, population = arrays(own.iloc[0])
            for k in range(1, len(own)):
                population = [*population[: POPULATION - 1], arrays(own.iloc[k])[1][0]]
            rng = np.random.default_rng([b, island, number, int(sizes.sum())])
            if len(population) < POPULATION:
                population = [*population, *(packed(p) for p in first_packings(sizes, capacity, POPULATION, rng)[1 : POPULATION - len(population) + 1])]
            return frame(rows_of(b, island, sizes, evolve(sizes, population, capacity, generations, rng)))

        return run

    evolved = dealt.select("block", "uid", "length").repartition(tasks, "block").groupBy("block").applyInPandas(found_islands, state)
    for number in range(epochs):
        evolved = evolved.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(epoch(number), state)
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields]

    def settle(own: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=[*own.columns, "bin", "offset", "filled"])
        own = own.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        sizes = own["length"].to_numpy(np.int64)
        best = max((arrays(r)[1][0] for _, r in states[states["home"]].sort_values("island").iterrows()), key=lambda p: fitness(sizes, p, capacity))
        order = np.argsort(best, kind="stable")
        ends = np.cumsum(sizes[order])
        filled = np.bincount(best, sizes).astype(np.int64)
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - (np.cumsum(filled) - filled)[best[order]]
        return own.assign(bin=best, offset=offset, filled=filled[best])

    return dealt.repartition(tasks, "block").groupBy("block").cogroup(evolved.repartition(tasks, "block").groupBy("block")).applyInPandas(settle, ", ".join([*columns, "block int", "bin long", "offset long", "filled long"]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, spare: int = SPARE, **shape: int) -> DataFrame:
    """pieces with sequence_id and offset: whole pieces alone, all others packed in two levels (see the module)."""
    held = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    own = [c for c in pieces.columns]
    whole = held.where(F.col("length") >= capacity).select(*own, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = held.where(F.col("length") < capacity)
    rows = items.count()
    if not rows:
        return whole
    level = materialize(pack_items(items, rows, capacity, **shape), "packing-level")
    numbered = lambda df, top: df.select(*own, (F.lit(top) + F.col("block").cast("long") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    opened = F.col("filled") <= capacity - spare
    done = whole.unionByName(numbered(level.where(~opened), 0))
    left = level.where(opened).select(*items.columns)
    n = left.count()
    if not n:
        return done
    return done.unionByName(numbered(pack_items(left, n, capacity, **shape), 1 << 60))


def op6_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op6_grouping_genetic_packing": op6_grouping_genetic_packing}
ORACLE_SQL: dict[str, str] = {}
