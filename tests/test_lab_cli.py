"""Whole runs and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from chronofold import cli, lab
from chronofold.operators import portfolio as P
from chronofold.operators.relational import ContractError
from chronofold.plans.domain import market_of
from chronofold.plans.views import Views

SF = "/root/testdata/sf0.01"


def test_portfolio_run(spark, tmp_path):
    m = market_of(Views(spark, SF))
    rules = tuple(r for r in P.RULES if r.etf_id in ("market_cap", "low_volatility"))
    result = lab.run_all(m, rules=rules)
    nav = result.nav().persist()
    assert {r.etf_id for r in nav.select("etf_id").distinct().collect()} == {"market_cap", "low_volatility"}
    assert nav.where("cash < 0 or nav <= 0").count() == 0
    total = result.holdings().groupBy("etf_id", "date").agg(F.sum("weight").alias("w"))
    assert total.where(F.abs(F.col("w") - 1) > 1e-9).count() == 0
    assert result.amounts.where("missing_count < 0").count() == 0
    with pytest.raises(ContractError):
        lab.check_coverage(lab.Market(m.calendar, m.prices, m.chip, m.master, m.state.where("ticker <> '1105'"), m.sales, m.financial, m.index))
    result.targets.write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() > 0


def test_bar_run(spark):
    v = Views(spark, SF)
    result = lab.build_all(v.curve.select("etf_id", "date", "nav", "etf_amount"), train_end="1999-12-31", horizon=10)
    assert result.bars.count() > 600
    assert {r.reason for r in result.labels.select("reason").distinct().collect()} >= {"unresolved_tail"}
    assert lab.for_trading(result, "2000-06-30").count() == 5


def test_allocation_plan():
    orders, cash = P.allocation_plan({"a": 0.6, "b": 0.4}, {"a": 10.0, "b": 25.0, "c": 5.0}, 1000.0, {"c": 100})
    assert [(o.ticker, o.shares) for o in orders][0] == ("c", -100) and 0 <= cash < 30
    with pytest.raises(ValueError):
        P.allocation_plan({"a": 1.2}, {"a": 1.0}, 10.0)


def test_command_line(spark, tmp_path, capsys):
    store, table = f"file://{tmp_path}/s", str(tmp_path / "t")
    spark.range(5).select(F.col("id").alias("k"), F.lit("2024-01-01").cast("date").alias("date")).write.parquet(table)
    assert cli.main([store, "publish", "numbers", table, "--key", "k", "--date", "date"], spark) == 0
    assert cli.main([store, "verify"], spark) == 0
    found = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert found["rows"] == 5 and found["count_holds"] and not found["repeated_keys"]
    assert cli.main([store, "inspect", "none"], spark) == 2
    assert cli.main([store, "archive", "numbers", found["fingerprint"]], spark) == 0
    assert cli.main([store, "sessions", "numbers", "2023-12-31", "2024-01-05"], spark) == 0
