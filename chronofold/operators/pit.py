"""Point-in-time selection: what was known at a decision date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ContractError, asof_join, latest_per_key


def select_latest(rows: DataFrame, key: Sequence[str], available: str, revision: str, decision: Column, strict: bool = True) -> DataFrame:
    """Per key the row with the latest availability, then the latest revision, among those available by `decision`.

    Null revisions come before all others. Rows that tie raise ContractError if strict, else all stay.
    """
    w = Window.partitionBy(*key).orderBy(F.desc(available), F.desc_nulls_last(revision))
    best = rows.where(F.col(available) <= decision).withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")
    if strict:
        tie = best.groupBy(*key).count().where("count > 1").limit(1).collect()
        if tie:
            raise ContractError(f"{tie[0]['count']} equally late rows of {tie[0].asDict()}")
    return best


def snapshots(rows: DataFrame, decisions: DataFrame, decision: str, key: Sequence[str], available: str, order: Sequence[Column]) -> DataFrame:
    """The full state at every decision date: each key's latest row known then. decisions, a few dates, are broadcast."""
    known = rows.join(F.broadcast(decisions), F.col(available) <= F.col(decision))
    return latest_per_key(known, [decision, *key], order)


def state_updates(rows: DataFrame, decisions: DataFrame, decision: str, key: Sequence[str], available: str, order: Sequence[Column]) -> DataFrame:
    """Only what changed: each row at the first decision date that knows it, one row per key and date."""
    dated = asof_join(rows, decisions, available, decision, [decision], forward=True).where(F.col(decision).isNotNull())
    return latest_per_key(dated, [decision, *key], order)


def age_in_months(later: Column, earlier: Column) -> Column:
    """Whole calendar months between two dates, without fractions."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def pick_sales(sales: DataFrame, formations: DataFrame) -> DataFrame:
    """Per formation and ticker the newest period known, 0 to 2 months old."""
    near = sales.join(F.broadcast(formations), F.col("available") <= F.col("formation_date"))
    near = near.withColumn("age", age_in_months(F.col("formation_date"), F.col("period"))).where("age between 0 and 2 and r18 is not null and not isnan(r18)")
    return latest_per_key(near, ["formation_date", "ticker"], [F.desc("period"), F.desc("available"), F.desc("row_id")])


def pick_fundamentals(rows: DataFrame, formations: DataFrame, most_days: int = 180) -> DataFrame:
    """Per formation and ticker the newest positive r103 known; null revisions lose against dated ones."""
    near = rows.join(F.broadcast(formations), (F.col("available") <= F.col("formation_date")) & (F.col("revision_date").isNull() | (F.col("revision_date") <= F.col("formation_date"))))
    near = near.withColumn("age", F.datediff("formation_date", "available")).where(f"r103 > 0 and age between 0 and {most_days}")
    return latest_per_key(near, ["formation_date", "ticker"], [F.desc("period_end"), F.desc("available"), F.desc_nulls_last("revision_date"), F.desc("row_no")])
