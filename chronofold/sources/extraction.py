"""From raw source tables to normalized rows: extraction profiles, fan-out over tables, row identity, cutoffs, families.

All are plans over DataFrames; only checks bring a row to the driver. Missing required values are errors, named by their first row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.relational import ContractError

PROFILES = ("small_snapshot", "medium_pit_table", "large_daily_panel")


@dataclass(frozen=True)
class Family:
    """A source family: its profile, the dates it is cut by, and the tables it comes from."""

    family_id: str
    profile: str
    event: tuple[str, ...] = ()
    available: tuple[str, ...] = ()
    table: str | None = None
    pattern: str | None = None
    tickers: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ContractError(f"{self.family_id}: unknown profile {self.profile!r}")
        if not (self.table or self.pattern):
            raise ContractError(f"{self.family_id} names no table")


def window(column: str, start: str | None, end: str | None) -> Column:
    """Rows whose date lies between both ends, as far as they are given; a null date lies nowhere."""
    c = F.col(column).cast("date")
    test = c.isNotNull()
    if start:
        test &= c >= F.lit(start).cast("date")
    return test & (c <= F.lit(end).cast("date")) if end else test


def extract(rows: DataFrame, family: Family, start: str | None = None, end: str | None = None, full_history: bool = False) -> DataFrame:
    """The rows that a run takes, by the family's profile.

    A small snapshot is taken whole. A medium table gives rows whose availability or event date lies in the window, all without one. A large
    daily panel needs both ends, unless the run takes the full history; its event dates must lie in the window.
    """
    if family.profile == "small_snapshot" or not (start or end) and (family.profile == "medium_pit_table" or full_history):
        return rows
    if family.profile == "large_daily_panel":
        if not (start and end):
            if full_history:
                return rows
            raise ContractError(f"{family.family_id} needs a first and a last date")
        columns: Sequence[str] = family.event
    else:
        columns = (*family.available, *family.event)
    if not columns:
        raise ContractError(f"{family.family_id} names no date to cut by")
    test = window(columns[0], start, end)
    for c in columns[1:]:
        test |= window(c, start, end)
    return rows.where(test)


def tables_of(family: Family, known: Iterable[str]) -> list[str]:
    """The family's tables: its fixed one; its pattern for each of its tickers; or the known ones that match, {ticker} being any text without a dot."""
    if family.table:
        return [family.table]
    pattern = family.pattern or ""
    if family.tickers:
        return [pattern.replace("{ticker}", t) for t in family.tickers]
    if "{ticker}" not in pattern:
        return [pattern]
    test = re.compile("[^.]+".join(map(re.escape, pattern.split("{ticker}"))))
    found = sorted(n for n in known if test.fullmatch(n))
    if not found:
        raise ContractError(f"{family.family_id}: no table matches {pattern}")
    return found


def identified(rows: DataFrame, table: str, primary_key: Sequence[str] = (), source_id: str | None = None) -> DataFrame:
    """rows with source_collection and source_row_id: a hash of the primary key where none of it is null, else the source's own id, else a hash of the row.

    Hashed are JSON objects with sorted names and no blanks. Equal rows without key and id get equal identities.
    """
    taken = {"source_row_id", "source_collection", source_id}
    digest = lambda names: F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(names)]), {"ignoreNullFields": "false"}), 256)
    label = F.lit(table)
    out = F.concat(label, F.lit(":sha256:"), digest([c for c in rows.columns if c not in taken]))
    if source_id:
        out = F.coalesce(F.concat(label, F.lit(":"), F.col(source_id).cast("string")), out)
    if primary_key:
        whole = F.lit(True)
        for c in primary_key:
            whole &= F.col(c).isNotNull()
        out = F.when(whole, F.concat(label, F.lit(":pk-sha256:"), digest(primary_key))).otherwise(out)
    made = rows if "source_row_id" in rows.columns else rows.withColumn("source_row_id", out)
    made = made if "source_collection" in rows.columns else made.withColumn("source_collection", label)
    return made.drop(source_id) if source_id else made


def with_cutoff(rows: DataFrame, completed: str, column: str = "data_cutoff_at") -> DataFrame:
    """rows whose cutoff is the end of extraction where they state no real moment: null, a date alone and the epoch are none."""
    have = F.col(column).cast("string") if column in rows.columns else F.lit(None).cast("string")
    stamp = F.try_to_timestamp(F.trim(have))
    real = have.rlike("[T ]") & stamp.isNotNull() & (F.unix_timestamp(stamp) != 0)
    real = F.coalesce(real, F.lit(False))
    return rows.withColumns({column: F.when(real, have).otherwise(F.lit(completed)), "data_cutoff_origin": F.when(~real, "extraction_completed_fallback")})


def _text(name: str) -> Column:
    return F.trim(F.col(f"`{name}`").cast("string"))


def _date(name: str) -> Column:
    return F.substring(_text(name), 1, 10).try_cast("date")


def _first(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that are there whose text isn't blank."""
    there = [F.when(_text(n) != "", _text(n)) for n in names if n in rows.columns]
    return F.coalesce(*there, F.lit(None).cast("string"))


def _calendar(rows: DataFrame) -> tuple[dict[str, Column], tuple[str, ...]]:
    mark = F.coalesce(_text("date_rmk"), F.lit("")) if "date_rmk" in rows.columns else F.lit("")
    day = _date("zdate")
    return {"date": day, "market": F.coalesce(_first(rows, "mkt", "market"), F.lit("TWSE")), "is_trading_day": mark == "", "date_rmk": mark, "source_available_date": day}, ("date",)


def _sales(rows: DataFrame) -> tuple[dict[str, Column], tuple[str, ...]]:
    return {"ticker": _first(rows, "coid"), "source_period_date": _date("mdate"), "source_available_date": _date("annd_s")}, ("ticker", "source_period_date", "source_available_date")


def _panel(rows: DataFrame) -> tuple[dict[str, Column], tuple[str, ...]]:
    return {"date": _date("mdate"), "ticker": _first(rows, "coid", "ticker"), "source_available_date": _date("mdate")}, ("date", "ticker")


def _statement(rows: DataFrame) -> tuple[dict[str, Column], tuple[str, ...]]:
    names = {n: _first(rows, n) for n in ("no", "sem", "curr", "merg")}
    begin = _date("begd") if "begd" in rows.columns else F.lit(None).cast("date")
    dates = {"period_start_date": begin, "period_end_date": _date("endd"), "source_period_date": _date("mdate"), "source_available_date": _date("key3"), "revision_date": _date("mdate")}
    return {"ticker": _first(rows, "coid"), **names, **dates}, ("ticker", *names, "period_end_date", "source_available_date", "revision_date")


def _reported(rows: DataFrame) -> tuple[dict[str, Column], tuple[str, ...]]:
    names = {n: _first(rows, n) for n in ("key3", "sem", "curr", "merg")}
    dates = {"period_end_date": _date("endd" if "endd" in rows.columns else "mdate"), "source_available_date": _date("annd"), "revision_date": _date("mdate")}
    return {"ticker": _first(rows, "coid"), **names, **dates}, ("ticker", *names, *dates)


def _dated(rows: DataFrame) -> tuple[dict[str, Column], tuple[str, ...]]:
    return {"ticker": _first(rows, "coid", "ticker"), "source_date": _date("mdate"), "source_available_date": _date("mdate")}, ("source_date",)


def _futures(rows: DataFrame) -> tuple[dict[str, Column], tuple[str, ...]]:
    return {"date": _date("日期"), "source_available_date": _date("日期"), "contract": F.coalesce(_first(rows, "contract", "契約", "symbol"), F.lit("TX_1"))}, ("date",)


NORMALIZERS: dict[str, Callable[[DataFrame], tuple[dict[str, Column], tuple[str, ...]]]] = {
    "trading_calendar": _calendar,
    "monthly_sales": _sales,
    "daily_panel": _panel,
    "financial_statement": _statement,
    "self_reported_numbers": _reported,
    "generic_mdate": _dated,
    "futures_near_month": _futures,
}


def normalize(rows: DataFrame, family: str) -> DataFrame:
    """Raw rows of a family with its canonical columns in front; other columns stay unless a canonical one has their name.

    Blank text is missing and a date is the first ten characters. A row that misses a required column is an error. Financial statements that differ
    only in the time of day at which they were available (key3) give the latest; ties stay. Repeated rows of other families stay.
    """
    made, required = NORMALIZERS[family](rows)
    out = rows.select(*[c.alias(n) for n, c in made.items()], *[F.col(f"`{c}`") for c in rows.columns if c not in made])
    lost = F.lit(False)
    for c in required:
        lost |= F.col(c).isNull()
    bad = out.where(lost).limit(1).collect()
    if bad:
        raise ContractError(f"{family}: no {[c for c in required if bad[0][c] is None]} in {bad[0].asDict()}")
    if family != "financial_statement":
        return out
    key = ["ticker", "no", "sem", "curr", "merg", "period_end_date", "source_available_date", "revision_date"]
    stamp = F.try_to_timestamp(_text("key3"))
    return out.withColumn("__r", F.rank().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(stamp)))).where("__r = 1").drop("__r")


def check_catalog(catalog: Sequence[dict], registry: Iterable[str], forbidden: Iterable[str] = ()) -> None:
    """The ids of a source catalog don't repeat and equal the registry's; no entry names a forbidden source or lacks a profile."""
    ids = [str(x.get("family_id") or "") for x in catalog]
    again = sorted({i for i in ids if ids.count(i) > 1})
    if again or "" in ids:
        raise ContractError(f"catalog: missing or repeated ids {again}")
    apart = sorted(set(ids) ^ set(registry))
    if apart:
        raise ContractError(f"catalog and registry differ in {apart}")
    for x in catalog:
        if x.get("profile") not in PROFILES:
            raise ContractError(f"{x['family_id']}: unknown profile {x.get('profile')!r}")
        if {x.get("table"), x.get("family_id")} & set(forbidden):
            raise ContractError(f"{x['family_id']} is a forbidden source")
