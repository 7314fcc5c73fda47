"""Relational operators with explicit cardinality, null and tie rules. All are plans of built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType


class ContractError(ValueError):
    """A table breaks what an operator requires of it."""


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, key: Sequence[str], what: str = "table") -> DataFrame:
    """df itself, after a check that no key repeats (one aggregation, which stops at the first repeated key)."""
    first = duplicates(df, key).limit(1).collect()
    if first:
        raise ContractError(f"{what}: key {dict(zip(key, first[0][:-1]))} occurs {first[0]['rows']} times")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """A join whose cardinality is checked first: 1:1, 1:m, m:1 or m:m; `inner1` also requires that no left row is lost."""
    if validate.startswith("1:"):
        require_unique(left, on, "left side")
    if validate.endswith(":1"):
        require_unique(right, on, "right side")
    if how != "inner1":
        return left.join(right, list(on), how)
    lost = left.join(right, list(on), "left_anti").limit(1).collect()
    if lost:
        raise ContractError(f"no match for {lost[0]}")
    return left.join(right, list(on), "inner")


def densify(rows: DataFrame, days: DataFrame, day: str, key: str) -> DataFrame:
    """Every day for every key; missing rows become nulls. days, a calendar, is small and known in size, and so is broadcast."""
    keys = rows.select(key).distinct()
    return keys.join(F.broadcast(days)).join(rows, [day, key], "left")


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, carry: Sequence[str], by: Sequence[str] = (), allow_exact: bool = True, forward: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """For each left row the nearest right row before (or after) it, as columns `carry`.

    Both sides meet in one sort per `by` group instead of a range join. Of right rows with equal times the last by `tie` counts.
    Left rows whose time is null match nothing. Without `by`, a group is a bucket of time, and what the buckets before (or after) it
    left last comes from a table with one row per bucket, the only rows that meet in one task.
    """
    payload = F.struct(*[F.col(c).alias(c) for c in carry])
    lows = left.select(*[F.col(c) for c in by], F.col(left_on).alias("__t"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__right"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__tie{k}") for k, c in enumerate(tie)])
    highs = right.where(F.col(right_on).isNotNull()).select(*[F.col(c) for c in by], F.col(right_on).alias("__t"), F.lit(None).cast(lows.schema["__left"].dataType).alias("__left"), payload.alias("__right"), *[F.col(c).alias(f"__tie{k}") for k, c in enumerate(tie)])
    both = lows.unionByName(highs)
    # The right rows of an equal time come first where they may match.
    side = F.when(F.col("__left").isNull() == F.lit(allow_exact), 0).otherwise(1)
    ties = [F.asc_nulls_first(f"__tie{k}") for k in range(len(tie))]
    order = [F.desc_nulls_last("__t") if forward else F.asc_nulls_first("__t"), side, *ties]
    known = F.col("__t").isNotNull()
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where("__left is not null")
        return found.select("__left.*", *[F.when(known, F.col(f"__found.{c}")).alias(c) for c in carry])
    kind = left.schema[left_on].dataType
    cut = both.withColumn("__b", bucket_of(kind, F.col("__t")))
    w = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = cut.withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where("__left is not null")
    last = [F.asc("__t") if forward else F.desc("__t"), *[F.desc_nulls_last(f"__tie{k}") for k in range(len(tie))]]
    edges = latest_per_key(highs.withColumn("__b", bucket_of(kind, F.col("__t"))), ["__b"], last).select("__b", F.col("__right").alias("__edge"))
    buckets = lows.select(bucket_of(kind, F.col("__t")).alias("__b")).where("__b is not null").distinct().join(edges, "__b", "full_outer")
    beyond = Window.orderBy(F.desc("__b") if forward else F.asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("__b", F.last("__edge", ignorenulls=True).over(beyond).alias("__far"))
    found = near.join(carried, "__b", "left").withColumn("__found", F.coalesce("__found", "__far"))
    return found.select("__left.*", *[F.when(known, F.col(f"__found.{c}")).alias(c) for c in carry])


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of old whose key is not in new, and all of new."""
    return old.join(new, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def soft_delete(members: DataFrame, selected: DataFrame, key: Sequence[str], reason: str) -> DataFrame:
    """selected as included, and members that are not selected any more as not included, with the reason."""
    gone = members.join(selected, list(key), "left_anti").withColumns({"included": F.lit(False), "reason": F.lit(reason)})
    kept = selected.withColumns({"included": F.lit(True), "reason": F.lit(None).cast("string")})
    return kept.unionByName(gone, allowMissingColumns=True)


def key_mismatch(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of one side only, and which."""
    a, b = left.select(*key).distinct().withColumn("__l", F.lit(1)), right.select(*key).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only")
    return a.join(b, list(key), "full_outer").select(*key, side.alias("side")).where("side is not null")


def cascade(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, in order; null where none does."""
    out = F
    for name, test in rules:
        out = out.when(test, name)
    return out


def interval_join(points: DataFrame, spans: DataFrame, on: Sequence[str], point: str, low: str, high: str, open_low: bool = True) -> DataFrame:
    """points joined with the spans of the same `on` that hold them: low < point <= high, or low <= point.

    Both sides meet by bucket of the point's type (see bucket_of), a span once for each bucket it reaches into, so that a key's points
    meet only the spans near them. Nulls match nothing.
    """
    inside = (F.col(point) > F.col(low)) if open_low else (F.col(point) >= F.col(low))
    kind = points.schema[point].dataType
    left = points.where(F.col(point).isNotNull()).withColumn("__b", bucket_of(kind, F.col(point)))
    right = spans.where(F.col(low) <= F.col(high)).withColumn("__b", F.explode(buckets_between(kind, F.col(low), F.col(high))))
    return left.join(right, [*on, "__b"]).where(inside & (F.col(point) <= F.col(high))).drop("__b")


def without_overlap(rows: DataFrame, held: DataFrame, on: Sequence[str], span: tuple[str, str], held_span: tuple[str, str]) -> DataFrame:
    """rows whose closed span meets none of held's of the same `on`. Rows with a null end stay; repeated rows stay or go together."""
    kind = rows.schema[span[0]].dataType
    numbered = rows.withColumn("__key", F.struct(*on, *span))
    mine = numbered.select("__key", *on, *span).distinct().where(F.col(span[0]) <= F.col(span[1])).withColumn("__b", F.explode(buckets_between(kind, F.col(span[0]), F.col(span[1]))))
    other = held.select(*on, *held_span).distinct().where(F.col(held_span[0]) <= F.col(held_span[1])).withColumn("__b", F.explode(buckets_between(kind, F.col(held_span[0]), F.col(held_span[1]))))
    met = mine.join(other, [*on, "__b"]).where((F.col(span[0]) <= F.col(held_span[1])) & (F.col(span[1]) >= F.col(held_span[0]))).select("__key").distinct()
    return numbered.join(met, "__key", "left_anti").drop("__key")


#: Whole numbers that share a bucket.
BUCKET = 64


def bucket_of(kind: DataType, c: Column) -> Column:
    """A coarse bucket that keeps the order of c: the month of a date, the day of a timestamp, BUCKET neighbouring numbers."""
    if isinstance(kind, DateType):
        return F.year(c) * 12 + F.month(c)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    return F.floor(c / BUCKET).cast("long")


def buckets_between(kind: DataType, low: Column, high: Column) -> Column:
    return F.sequence(bucket_of(kind, low), bucket_of(kind, high))
