"""Document fingerprints: one-permutation MinHash with optimal densification, low-order bits packed. DataFrame functions only.

A text's shingles are its runs of five lowered words (with fewer words, all of them as one). Each shingle is hashed once; the
upper eight bits choose one of 256 bins, and a bin keeps its smallest hash. As a sorted array of hashes has the bins
one after the other, a bin's smallest hash is the one that follows a change of bin. Of each bin the six lowest bits are kept, as a
base64 digit, so a fingerprint is 192 bytes as 256 digits. An empty bin takes the digit of the first filled bin among
random ones that depend on the bin alone: eight probes, then the filled bin with the smallest hash of the pair, so the same bins are
tried in the same order in every text. Two unlike bins agree in six bits by chance in 1 of 64 cases, which the likeness takes out.

Nulls: a null text is empty; a text without words has the fingerprint of 256 points, which is like itself (1) and like no
other (0). A null doc_id comes before all others. Repeated rows stay, rows of equal doc_id follow each other by text. Of one
document the next is itself. An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

BINS, WORDS, PROBES = 256, 5, 8
BLANKS = " \t\n\x0b\f\r"
EMPTY = "." * BINS
DIGITS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
#: Rows of a run of doc_ids, and the most runs there are; a run sorts and spills like any window partition.
RUN_ROWS, MOST_RUNS = 500, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column) -> Column:
    """The hashes of a text's shingles, one for each place."""
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))

    def hashed(words: Column) -> Column:
        n = F.size(words) - (WORDS - 1)
        parts = [F.slice(words, F.lit(k + 1), n) for k in range(WORDS)]
        each = F.transform(F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)]), lambda z: F.xxhash64(z))
        return F.when(n > 0, each).otherwise(F.array(F.xxhash64(F.concat_ws(" ", words))))

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(let(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"), hashed))


def _bin(h: Column) -> Column:
    return F.shiftright(h, 56).cast("int") + BINS // 2


def _digit(h: Column) -> Column:
    return F.substring(F.lit(DIGITS), h.bitwiseAND(F.lit(63)).cast("int") + 1, F.lit(1))


def bin_digits(hashes: Column) -> Column:
    """A digit for each bin, a point where it is empty."""

    def digits(s: Column) -> Column:
        first = F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))

        def spaced(f: Column) -> Column:
            each = F.transform(f, lambda h, i: F.concat(F.repeat(F.lit("."), _bin(h) - F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(f, i - 1))) - 1), _digit(h)))
            return F.rpad(F.array_join(each, ""), BINS, ".")

        return let(first, spaced)

    return let(F.sort_array(hashes), digits)


def densify(raw: Column) -> Column:
    """raw with every empty bin filled, unless all are."""

    def at(r: Column, place: Column) -> Column:
        return F.substring(r, place, F.lit(1))

    def fill(r: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda p: at(r, p) != ".")

        def digits(known: Column) -> Column:
            def one(j: Column) -> Column:
                tried = [F.nullif(at(r, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int") + 1), F.lit(".")) for t in range(PROBES)]
                rest = at(r, F.array_min(F.transform(known, lambda p: F.struct(F.xxhash64(j, F.lit(-1), p).alias("h"), p.alias("p"))))["p"])
                return F.coalesce(F.nullif(at(r, j), F.lit(".")), *tried, rest)

            return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(BINS)), one), "")

        return let(filled, digits)

    return let(raw, lambda r: F.when((F.instr(r, ".") == 0) | (r == EMPTY), r).otherwise(fill(r)))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that is not null."""
    return densify(bin_digits(shingle_hashes(text)))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles, 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    chance = 1 / len(DIGITS)
    return F.when(a == b, 1.0).when((a == EMPTY) | (b == EMPTY), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def packed(digits: Column) -> Column:
    """The fingerprint's 192 bytes; null for a text without words."""
    return F.when(digits != EMPTY, F.unbase64(digits))


def run_starts(keys: DataFrame, run_rows: int = RUN_ROWS, most_runs: int = MOST_RUNS) -> list[int]:
    """The smallest key of each of about equally many runs of keys (column k); at most most_runs numbers reach the driver."""
    rows = keys.count()
    runs = min(most_runs, math.ceil(rows / run_rows))
    if runs <= 1:
        low = keys.agg(F.min("k")).first()[0] if rows else None
        return [] if low is None else [low]
    cuts = keys.agg(F.percentile_approx("k", [i / runs for i in range(1, runs)], 10 * runs)).first()[0]
    inner = sorted(set(cuts))
    firsts = keys.groupBy(_place(F.col("k"), inner).alias("b")).agg(F.min("k").alias("k")).collect()
    return sorted(r.k for r in firsts)


def _place(k: Column, starts: list[int]) -> Column:
    """How many of the ascending starts are at most k, found in two steps of about the square root of their number."""
    if not starts:
        return F.lit(0)
    step = math.isqrt(len(starts)) + 1
    parts = [starts[i : i + step] for i in range(0, len(starts), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    part = F.size(F.filter(longs([p[0] for p in parts]), lambda x: x <= k))
    inner = F.size(F.filter(F.element_at(F.array(*[longs(p) for p in parts]), part), lambda x: x <= k))
    return F.when(part == 0, 0).otherwise((part - 1) * step + inner)


def with_next(docs: DataFrame, key: str, order: list[str], carry: list[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """docs with next_<c> of each column of carry: its value in the row that follows by (key, order), cyclically.

    Rows are dealt once, by runs of keys; the rows that begin a run also go, as guests, to the end of the run before it.
    """
    starts = run_starts(docs.select(F.col(key).alias("k")), run_rows)
    if not starts:
        starts = [0]
    place = _place(F.col(key), starts)
    longs = F.array(*[F.lit(x).cast("long") for x in starts])
    own = F.struct(F.col("__run").alias("run"), F.lit(0).alias("guest"))
    guest = F.struct(F.when(F.col("__run") == 1, len(starts)).otherwise(F.col("__run") - 1).alias("run"), F.lit(1).alias("guest"))
    dealt = docs.withColumn("__run", place).withColumn("__at", F.explode(F.when(F.element_at(longs, F.col("__run")) == F.col(key), F.array(own, guest)).otherwise(F.array(own))))
    w = Window.partitionBy(F.col("__at.run")).orderBy(F.col("__at.guest"), key, *order)
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where("__at.guest = 0").drop("__run", "__at")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of texts and of their edited texts (see op7's contract), with their likenesses."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("k"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    near = with_next(rows, "k", ["text"], ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    made = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    done = made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op7_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_one_permutation_minhash": op7_one_permutation_minhash}
ORACLE_SQL: dict[str, str] = {}
