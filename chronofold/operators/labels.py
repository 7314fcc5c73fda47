"""Event labels: triple barriers, concurrency, uniqueness, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import asof_join, interval_join


def triple_barrier(bars: DataFrame, path: DataFrame, width: float = 2.0, horizon: int = 60) -> DataFrame:
    """bars: etf_id, bar, end_date, close, sigma. path: etf_id, date, nav. Per bar with sigma: event_id parts, t1, label and why.

    The vertical barrier is the end of exactly the horizon-th bar ahead; without one the event is an unresolved tail, touched or not. The first day
    whose log return from the close reaches width * sigma either way decides, else the sign at the vertical barrier (0 if nothing changed).
    """
    order = Window.partitionBy("etf_id").orderBy("bar")
    rows = bars.withColumn("vertical", F.lead("end_date", horizon).over(order)).where("sigma > 0").select("etf_id", "bar", F.col("end_date").alias("t0"), F.col("close").alias("entry"), "sigma", "vertical")
    known = rows.where("vertical is not null")
    moves = interval_join(path, known, ["etf_id"], "date", "t0", "vertical").withColumn("move", F.ln(F.col("nav") / F.col("entry")))
    limit = F.col("sigma") * width
    side: Column = F.when(F.col("move") >= limit, 1).when(F.col("move") <= -limit, -1)
    first = moves.withColumn("side", side).groupBy("etf_id", "bar").agg(F.min(F.when(F.col("side").isNotNull(), F.struct("date", "side"))).alias("touch"), F.max(F.struct("date", "move")).alias("last"))
    out = rows.join(first, ["etf_id", "bar"], "left")
    touched = F.col("touch").isNotNull()
    reason = F.when(F.col("vertical").isNull(), "unresolved_tail").when(touched & (F.col("touch.side") == 1), "upper").when(touched, "lower").otherwise("vertical")
    label = F.when(touched, F.col("touch.side")).when(F.col("vertical").isNotNull(), F.signum("last.move").cast("int"))
    return out.select("etf_id", "bar", "t0", F.when(touched, F.col("touch.date")).otherwise(F.col("vertical")).alias("t1"), label.alias("label"), reason.alias("reason"))


def uniqueness(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """events (etf_id, bar, t0, t1) with concurrency at its first session, the largest, and the mean of 1/concurrency over its sessions, from t0 to t1.

    Repeated sessions count once; an event without t1 or without a session is left out.
    """
    spread = interval_join(sessions.distinct(), events.where("t1 is not null").select("etf_id", "bar", "t0", "t1"), ["etf_id"], "date", "t0", "t1", open_low=False).select("etf_id", "bar", "date")
    counted = spread.groupBy("etf_id", "date").agg(F.count("*").alias("c"))
    each = spread.join(counted, ["etf_id", "date"])
    return each.groupBy("etf_id", "bar").agg(F.min_by("c", "date").alias("at_start"), F.max("c").alias("most"), F.avg(1.0 / F.col("c")).alias("uniqueness"))


def split_of(t0: Column, t1: Column, train_end: str, validation_end: str) -> Column:
    """train, validation or test by t0; crossing where t1 is beyond the split's end."""
    a, b = F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    return F.when(t1.isNull(), "unresolved").when((t0 <= a) & (t1 > a), "crossing").when(t0 <= a, "train").when((t0 <= b) & (t1 > b), "crossing").when(t0 <= b, "validation").otherwise("test")


def purged_folds(events: DataFrame, folds: int) -> DataFrame:
    """Expanding chronological folds: fold, part (train or validation) and the event's columns.

    Distinct t0 dates go to folds + 1 blocks; block k validates fold k, and the fold trains on events that were resolved before its first date.
    """
    dates = events.select("t0").distinct().withColumn("block", F.ntile(folds + 1).over(Window.orderBy("t0")) - 1)
    rows = events.join(F.broadcast(dates), "t0")
    starts = dates.where("block > 0").groupBy(F.col("block").alias("fold")).agg(F.min("t0").alias("first"))
    both = rows.join(F.broadcast(starts), F.col("block") <= F.col("fold"))
    part = F.when(F.col("block") == F.col("fold"), "validation").when(F.col("t1") < F.col("first"), "train")
    return both.withColumn("part", part).where("part is not null").drop("block", "first")


def next_open_targets(bars: DataFrame, opens: DataFrame, barrier: float, horizon: int, buy: float = 0.001425, sell: float = 0.003) -> DataFrame:
    """bars: etf_id, bar, end_date. opens: etf_id, date, nav (of legal opens). etf_id, bar, entry_date, exit_date, net_return.

    Entry at the first open after the bar; the log return net of both costs reaches the barrier, or the horizon-th bar ahead ends; exit at the
    first open after that. Events without horizon or without exit are left out.
    """
    order = Window.partitionBy("etf_id").orderBy("bar")
    rows = bars.withColumn("vertical", F.lead("end_date", horizon).over(order)).where("vertical is not null")
    day = lambda prefix: opens.select("etf_id", F.col("date").alias(f"{prefix}_date"), F.col("nav").alias(prefix))
    entered = asof_join(rows, day("entry"), "end_date", "entry_date", ["entry_date", "entry"], by=["etf_id"], forward=True, allow_exact=False).where("entry is not null")
    path = interval_join(opens, entered, ["etf_id"], "date", "entry_date", "vertical")
    move = F.abs(F.ln(F.col("nav") * (1 - sell)) - F.ln(F.col("entry") * (1 + buy)))
    hit = path.groupBy("etf_id", "bar", "entry_date", "entry", "vertical").agg(F.min(F.when(move >= barrier, F.col("date"))).alias("touch"))
    due = hit.withColumn("due", F.coalesce("touch", "vertical"))
    left = asof_join(due, day("exit"), "due", "exit_date", ["exit_date", "exit"], by=["etf_id"], forward=True, allow_exact=False).where("exit is not null")
    net = F.col("exit") * (1 - sell) / (F.col("entry") * (1 + buy)) - 1
    return left.select("etf_id", "bar", "entry_date", "exit_date", net.alias("net_return"))
