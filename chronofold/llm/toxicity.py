"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Text is lowered, every run of characters other than letters becomes one blank, and the n-grams of NGRAMS code points go to
2**BITS buckets. A feature is the presence of a bucket in a text, times the log ratio of its smoothed frequencies in toxic
and clean training texts; the FEATURES buckets that tell the classes apart best enter a logistic regression.

Fitting uses a bounded sample of labelled rows: the `most_toxic` and `most_clean` rows whose hashed doc_id is smallest.
Counting and looking up features run on the executors, over the sample; the driver gets at most FEATURES counts and, per sampled
row, the selected features it has. Scoring is one pass over whole texts without a shuffle.

Nulls: a null text is empty; it and texts without letters get the score of no feature. A row whose label or doc_id is null
doesn't teach; of several labels of a doc_id the highest counts. Without rows of both classes every score is 0. Repeated rows are
scored each. Columns besides doc_id, text and toxic are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_bytes, distinct, give_back, materialize, table

NGRAMS = (3, 4, 5, 6)
BITS = 20
FEATURES = 6000
#: Bytes of text that are normalized at a time (a longer text stands alone, at some 20 times its size), and code points whose n-grams are in memory at a time.
SLICE, WINDOW = 1 << 18, 1 << 17
#: Bounds of the sample that the classifier is fitted on.
MOST_TOXIC, MOST_CLEAN = 3000, 6000
_SYMBOLS = np.array([c if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)


@dataclass
class Model:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(1 where a bucket has a weight, the weights by bucket)."""
        marks, weights = np.zeros(1 << BITS, np.uint8), np.zeros(1 << BITS, np.float64)
        marks[self.buckets], weights[self.buckets] = 1, self.weights
        return marks, weights


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(normalized code points of all texts in a row, each text between blanks; the text that each belongs to)."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer((" " + " \0 ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    owner = np.repeat(np.arange(len(low), dtype=np.int32), sizes + 3)[: len(code)]
    code = np.where(code < len(_SYMBOLS), _SYMBOLS[np.minimum(code, len(_SYMBOLS) - 1)], code)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (owner[1:] != owner[:-1])
    return code[keep], owner[keep]


def _grams(code: np.ndarray, owner: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n (the bucket of the n-gram at each of the first `most` places or -1 where it reaches into another text)."""
    mixed = code * np.uint32(0x9E3779B1)
    h = mixed
    for n in range(2, max(NGRAMS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + mixed[n - 1 :] if len(h) > 1 else h[:0]
        if n in NGRAMS:
            b = ((h ^ (h >> np.uint32(15)) ^ np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            b = b.astype(np.int32)
            b[owner[: len(b)] != owner[len(owner) - len(b) :]] = -1
            yield b[:most]


def present(texts: list[str | None], marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; with marks, of marked buckets only."""
    code, owner = _codes(texts)
    found = []
    for a in range(0, max(1, len(code)), WINDOW):
        part = slice(a, a + WINDOW + max(NGRAMS) - 1)
        keys = []
        for b in _grams(code[part], owner[part], WINDOW):
            at = np.flatnonzero(b >= 0 if marks is None else (b >= 0) & (marks[b] > 0))
            keys.append(owner[a + at].astype(np.int64) << BITS | b[at])
        found.append(distinct(np.concatenate(keys)))
    keys = distinct(np.concatenate(found)) if len(found) > 1 else found[0]
    return keys >> BITS, keys & ((1 << BITS) - 1)


def training_sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """text, toxic of the sampled labelled rows. The sampled doc_ids are bounded and so are broadcast."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Counting is no input of a score: the hash only chooses rows.
    pick = lambda t, n: known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, most_toxic).unionByName(pick(0, most_clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, features: int = FEATURES) -> Model:
    sample = materialize(training_sample(docs, labels, most_toxic, most_clean), "toxicity-sample")
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model(-math.inf, np.zeros(0, np.int64), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int32)
        for batch in by_bytes(batches, "text", SLICE):
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            owner, bucket = present(batch.column("text").to_pylist())
            for t in (0, 1):
                held[t] += np.bincount(bucket[label[owner] == t], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(held.any(axis=0))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[0, at].astype(np.int64)), pa.array(held[1, at].astype(np.int64))], ["bucket", "clean", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = F.col("toxic") / F.lit(float(toxic)), F.col("clean") / F.lit(float(clean))
    pooled = (F.col("toxic") + F.col("clean") + 1.0) / F.lit(float(toxic + clean + 2))
    z = F.abs(p - q) / F.sqrt(pooled * (F.lit(1.0001) - pooled) * F.lit(1 / toxic + 1 / clean))
    best = counts.where("toxic + clean >= 3").withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "bucket").limit(features).select("bucket", "toxic", "clean").toArrow()
    buckets = best["bucket"].to_numpy().astype(np.int64)
    if not len(buckets):
        return Model(-math.inf, buckets, np.zeros(0))
    ratio = np.log((best["toxic"].to_numpy() + 1) / (toxic + 2)) - np.log((best["clean"].to_numpy() + 1) / (clean + 2))
    marks = np.zeros(1 << BITS, np.uint8)
    marks[buckets] = 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            owner, bucket = present(batch.column("text").to_pylist(), marks)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bucket, pa.int32()))], ["toxic", "buckets"])
        give_back()

    rows = sample.select("text", "toxic").mapInArrow(find, "toxic int, buckets array<int>").toArrow().combine_chunks()
    place = np.zeros(1 << BITS, np.int32)
    place[buckets] = np.arange(len(buckets))
    y = rows["toxic"].to_numpy().astype(np.float64)
    lists = rows["buckets"].combine_chunks()
    col = place[lists.flatten().to_numpy()].astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    bias, w = logistic(row, col, ratio[col], y, len(buckets))
    give_back()
    return Model(bias, buckets, w * ratio)


def logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, l2: float = 1.0, rounds: int = 50) -> tuple[float, np.ndarray]:
    """(intercept, weights) that minimize the mean logistic loss plus l2 / 2n times the squared weights: Newton steps by conjugate gradients until the gradient vanishes."""
    n = len(y)
    times = lambda v: np.bincount(row, value * v[col], n) + v[-1]
    back = lambda u: np.append(np.bincount(col, value * u[row], width), u.sum())
    ridge = np.append(np.full(width, l2 / n), 1e-9)
    loss = lambda v, z: float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (ridge * v * v).sum())
    w = np.zeros(width + 1)
    z = times(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        g = back((p - y) / n) + ridge * w
        size = float(np.sqrt(g @ g))
        if size < 1e-7:
            break
        s = p * (1 - p) / n
        step, rest = np.zeros(width + 1), -g
        way, left = rest.copy(), float(rest @ rest)
        for _ in range(200):
            if np.sqrt(left) <= min(0.1, np.sqrt(size)) * size:
                break
            bent = back(s * times(way)) + ridge * way
            far = left / float(way @ bent)
            step += far * way
            rest -= far * bent
            left, before = float(rest @ rest), left
            way = rest + left / before * way
        length, start, slope = 1.0, loss(w, z), float(g @ step)
        dz = times(step)
        while length > 1e-6 and loss(w + length * step, z + length * dz) > start + 1e-4 * length * slope:
            length /= 2
        w, z = w + length * step, z + length * dz
    return float(w[-1]), w[:-1]


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs (none of them named score), and score."""
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").cast("string").alias("__text"))
    low, names = math.isinf(model.bias), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, weights = model.tables()
        for batch in by_bytes(batches, "__text", SLICE):
            n = batch.num_rows
            if low:
                p = np.zeros(n)
            else:
                owner, bucket = present(batch.column("__text").to_pylist(), marks)
                p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[bucket], n) + model.bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*names, "score"])
        give_back()

    scored = renamed.mapInArrow(run, f"{schema}{', ' if keep else ''}score double")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "score")


def held_out() -> Column:
    """Rows from which nothing is learnt; a null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_tables(spark: SparkSession, sf_dir: str) -> Model:
    return fit(table(spark, sf_dir, "documents").where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows that score threshold or more."""
    own = [c for c in docs.columns if c.lower() != "score"]
    if len(own) == len(docs.columns):
        return score(docs, model, own).where(F.col("score") < threshold).drop("score")
    moved = docs.select(*[F.col(f"`{c}`").alias(c if c.lower() != "score" else "__score") for c in docs.columns])
    return drop_toxic(moved, model, threshold).select(*[F.col(f"`{c}`") if c.lower() != "score" else F.col("__score").alias(c) for c in docs.columns])


def op1_toxicity_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), fit_on_tables(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity_nbsvm": op1_toxicity_nbsvm}
ORACLE_SQL: dict[str, str] = {}
