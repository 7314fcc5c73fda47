"""Nearest neighbours by inner product with learned partitions.

Fit, on a bounded sample (the SAMPLE vectors with the smallest hashed vec_id): the exact neighbour graph of the sample; a balanced
partitioning of the graph (principal directions split it into equal halves, then vertices move to the part that holds most of their
neighbours, as long as it has room); a small network that gives for a vector the shares of its neighbours in each part. The number of parts
grows with the square root of the rows, between PARTS and what the sample bears. Some of the sample is held out: how many parts a query needs
is the least number with which these rows find TARGET of their nearest in the rest of the sample, so clustered vectors need few of them.

Index and search, over all rows: every vector goes to its most probable part, every query to that many of its most probable ones. Parts are cut
into blocks of about BLOCK rows and queries into blocks too, so no task holds more than a block of each, however common a vector is; a
block gives each of its queries its nearest, which are ranked again over the blocks by exact scores. Recall is measured in the tests.

Scores: inner products of the original components in double precision. The blocks are searched with matrix products; all that
come within rounding of the k-th are summed again row by row, in an order that does not depend on the block, so equal vectors tie exactly.

Vectors that are null, empty or zero, hold a null or a component that is not finite, or have another length than most take no part; nor do rows
without vec_id. Rows that repeat are candidates each; a query never finds rows of its own vec_id. Equal scores go by vec_id. Fewer candidates than k
give fewer rows, empty tables none. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, table

#: Bounds of the sample and the shape of the index.
SAMPLE, DEGREE, PARTS, MOST_PARTS, HIDDEN = 8192, 16, 32, 256, 128
BLOCK, QUERY_BLOCK, K = 4096, 4096, 20
#: Rows of the sample that are held out, and the recall that is to be reached with them.
HELD_OUT, TARGET = 1024, 0.93


@dataclass
class Router:
    """parts most probable parts of vectors; one hidden layer, on vectors scaled to the sample's spread."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each row the rows with the largest inner products, itself left out."""
    n = len(x)
    k = min(degree, n - 1)
    out = np.zeros((n, k), np.int64)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[a : a + 1024]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int = PARTS, slack: float = 0.1, rounds: int = 12) -> np.ndarray:
    """The part of each vertex; no part holds more than (1 + slack) times its share, rounded up."""
    n = len(x)
    part = np.zeros(n, np.int64)

    def halve(at: np.ndarray, low: int, count: int) -> None:
        if count == 1 or len(at) < 2:
            part[at] = low
            return
        y = x[at] - x[at].mean(axis=0)
        v = y[0] + 1e-9
        for _ in range(12):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-30
        left = count // 2
        order = at[np.argsort(y @ v, kind="stable")]
        cut = len(at) * left // count
        halve(order[:cut], low, left)
        halve(order[cut:], low + left, count - left)

    halve(np.arange(n), 0, parts)
    room = int(np.ceil(n / parts * (1 + slack)))
    both = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        held = np.bincount(both[0] * parts + part[both[1]], minlength=n * parts).reshape(n, parts)
        best = held.argmax(axis=1)
        gain = held[np.arange(n), best] - held[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room:
                sizes[best[v]] += 1
                sizes[part[v]] -= 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int = PARTS, hidden: int = HIDDEN, epochs: int = 40, seed: int = 0) -> Router:
    """Cross-entropy against the shares of a vertex's neighbours (and its own part) by part; Adam on small batches."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph.ravel()]), 1.0)
    target[np.arange(n), part] += 1.0
    target /= target.sum(axis=1, keepdims=True)
    mean = x.mean(axis=0)
    scale = 1 / (x.std() + 1e-12)
    z = (x - mean) * scale
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(epochs):
        rate = 0.003 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(n)
        for a in range(0, n, 256):
            at = order[a : a + 256]
            h = np.maximum(z[at] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            g = (o / o.sum(axis=1, keepdims=True) - target[at]) / len(at)
            back = (g @ p[2].T) * (h > 0)
            grads = [z[at].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0)]
            step += 1
            for k, q in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *p)


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """vec_id, embedding of the rows that take part: those of that length, or else of the commonest one."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    if length is None:
        common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        length = common.n if common else 0
    return rows.where(F.size("embedding") == length)


def parts_for(rows: int) -> int:
    """A power of two near an eighth of the square root of the rows."""
    return int(min(MOST_PARTS, max(PARTS, 1 << round(np.log2(max(1.0, np.sqrt(rows) / 8))))))


def fit(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS, k: int = K) -> Router | None:
    """Learn the partitions from a bounded sample of usable vectors, and how many of them a query needs; None without any."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    if not rows.num_rows:
        return None
    x = np.stack(rows.column("embedding").to_numpy())
    held, x = np.split(x, [min(HELD_OUT, len(x) // 8)])
    graph = neighbour_graph(x)
    router = train_router(x, graph, balanced_parts(x, graph, parts), parts)
    router.probes = probes_needed(router, held, x, parts, k)
    return router


def probes_needed(router: Router, queries: np.ndarray, x: np.ndarray, parts: int, k: int = K, target: float = TARGET) -> int:
    """The least number of parts with which the queries find `target` of their k nearest rows of x; all parts for too few queries or rows."""
    if len(queries) < 64 or len(x) < 10 * k:
        return parts
    near = np.argpartition(-(queries @ x.T), k - 1, axis=1)[:, :k]
    own = router.logits(x).argmax(axis=1)
    order = np.argsort(-router.logits(queries), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    ranks = np.take_along_axis(place, own[near], axis=1)
    found = np.cumsum(np.bincount(ranks.ravel(), minlength=parts)) / ranks.size
    return int(np.searchsorted(found, target) + 1) if found[-1] >= target else parts


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def routed(vectors: DataFrame, router: Router, probes: int) -> DataFrame:
    """vec_id, embedding, parts (the most probable ones, best first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                b = batch.slice(a, 4096)
                o = router.logits(_matrix(b.column("embedding")))
                best = np.argsort(-o, axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], ["vec_id", "embedding", "parts"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, parts array<int>")


def nearest_in_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vec_id, score) of each query's k nearest rows with another id; ties to the smaller id."""
    out = []
    for a in range(0, len(q), 512):
        own = q[a : a + 512]
        s = own @ x.T
        s[q_ids[a : a + 512, None] == ids[None, :]] = -np.inf
        if s.shape[1] > k:
            low = np.partition(s, -k, axis=1)[:, -k]
            low = low - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(low), low, 0)))
            r, c = np.nonzero((s >= low[:, None]) & (s > -np.inf))
        else:
            r, c = np.nonzero(s > -np.inf)
        exact = (own[r] * x[c]).sum(axis=1)
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, np.arange(len(own)))
        keep = np.arange(len(r)) - first[r] < k if len(r) else np.zeros(0, bool)
        out.append((r[keep] + a, ids[c[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, parts: int | None = None, block: int = BLOCK, router: Router | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest found; both tables have vec_id and embedding.

    probes: parts that a query looks into, else as many as the fit found to be needed.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = usable(vectors, len(router.mean) if router else None)
    router = router or fit(rows, parts=parts or parts_for(rows.count()), k=k)
    if router is None:
        return spark.createDataFrame([], schema)
    parts = len(router.b2)
    probes = min(parts, probes or router.probes or parts)
    items = materialize(routed(rows, router, 1), "ann-items").select("vec_id", "embedding", F.element_at("parts", 1).alias("part"))
    sizes = {r.part: r["count"] for r in items.groupBy("part").count().collect()}
    blocks = [max(1, -(-sizes.get(p, 0) // block)) for p in range(parts)]
    asked = materialize(routed(usable(queries, len(router.mean)), router, probes), "ann-queries")
    total = asked.count()
    shares = max(1, -(-total * probes // (parts * QUERY_BLOCK)))
    n_blocks = F.array(*map(F.lit, blocks))
    put = items.select("part", (F.pmod(F.xxhash64("vec_id", "embedding"), F.element_at(n_blocks, F.col("part") + 1))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "vec_id", "embedding")
    ask = asked.select("vec_id", "embedding", F.explode("parts").alias("part")).select("part", F.explode(F.sequence(F.lit(0), F.element_at(n_blocks, F.col("part") + 1) - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int").alias("share"), "vec_id", "embedding")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q_ids = right["vec_id"].to_numpy()
        at, ids, score = nearest_in_block(q_ids, np.stack(right["embedding"].to_numpy()), left["vec_id"].to_numpy(), np.stack(left["embedding"].to_numpy()), k)
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "score": score})

    keys = ["part", "block", "share"]
    found = put.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op4_learned_partitions": op4_learned_partitions}
ORACLE_SQL: dict[str, str] = {}
