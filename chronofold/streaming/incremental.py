"""Incremental bars and signals with Structured Streaming.

Batches bring whole sessions in order; inside a batch rows come in any order and are sorted by the operator. State per key is the open bar or the
evidence score, so results equal those of the batch operators on the same rows, however the rows are dealt to batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BAR_OUT = "etf_id string, bar long, start_date date, end_date date, amount double, days long"
BAR_STATE = "bar long, is_open boolean, total double, lim double, start date, days long"


def streaming_bars(days: DataFrame) -> DataFrame:
    """Closed bars of a stream of etf_id, date, etf_amount, threshold; the open bar stays in state."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, is_open, total, lim, start, n = state.get if state.exists else (0, False, 0.0, 0.0, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("date")
        for date, a, t in zip(rows["date"], rows["etf_amount"], rows["threshold"]):
            if not is_open:
                if not t > 0:
                    continue
                is_open, total, lim, start, n = True, 0.0, float(t), date, 0
            total += float(a) if a == a else 0.0
            n += 1
            if total >= lim:
                out.append((key[0], bar, start, date, total, n))
                bar, is_open = bar + 1, False
        state.update((bar, is_open, total, lim, start, n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BAR_OUT.split(", ")])

    return days.groupBy("etf_id").applyInPandasWithState(walk, BAR_OUT, BAR_STATE, "append", GroupStateTimeout.NoTimeout)


CUSUM_OUT = "etf_id string, bar long, score double, state string, transition string"


def streaming_cusum(rows: DataFrame, enter: float = 0.20, leave: float = -0.10) -> DataFrame:
    """The evidence machine of models.cusum_states over a stream of etf_id, bar, p."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, long = state.get if state.exists else (0.0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("bar")
        for bar, p in zip(rows["bar"], rows["p"]):
            score = min(0.0, score + p - 0.5) if long else max(0.0, score + p - 0.5)
            change = score <= leave + 1e-12 if long else score >= enter - 1e-12
            name = None
            if change:
                name, long, score = ("long_to_flat" if long else "flat_to_long"), not long, 0.0
            out.append((key[0], bar, score, "long" if long else "flat", name))
        state.update((float(score), bool(long)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CUSUM_OUT.split(", ")])

    return rows.groupBy("etf_id").applyInPandasWithState(walk, CUSUM_OUT, "score double, long boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events per type in tumbling or sliding windows; later rows than `lateness` are left out once a window is closed."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def upsert_batches(stream: DataFrame, store, contract, checkpoint: str):
    """Publish every batch into a partitioned artifact; a batch that comes again changes nothing, as rows are merged by key."""

    def publish(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            store.publish(contract, batch.dropDuplicates(list(contract.key)))

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
