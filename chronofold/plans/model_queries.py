"""Queries of models, policies, ledgers and allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators import features, labels, models, validators
from chronofold.operators import relational as R

from .catalog import query
from .domain import FOLD_SQL, LABEL_SQL, UNIQUE_SQL, labelled
from .views import Views
from .windows import SPREAD_SQL

RETURN_SQL = "SELECT date, etf_id, nav / lag(nav) OVER (PARTITION BY etf_id ORDER BY date) - 1 AS ret FROM fx_curve"
SCORE_SQL = "SELECT etf_id, bar, end_date, ((bar * 37 + length(etf_id) * 11) % 101) / 101.0 AS p FROM fx_bar"


def daily_returns(v: Views) -> DataFrame:
    return v.curve.select("date", "etf_id", (F.col("nav") / F.lag("nav").over(Window.partitionBy("etf_id").orderBy("date")) - 1).alias("ret"))


def scores(v: Views) -> DataFrame:
    return v.bar.select("etf_id", "bar", "end_date", ((F.col("bar") * 37 + F.length("etf_id") * 11) % 101 / 101.0).alias("p"))


@query("t01_average_uniqueness", f"SELECT etf_id, round(avg(uniqueness), 8) AS uniqueness FROM ({UNIQUE_SQL}) GROUP BY 1")
def t01(v: Views) -> DataFrame:
    return labels.uniqueness(labelled(v), v.curve.select("etf_id", "date")).groupBy("etf_id").agg(F.round(F.avg("uniqueness"), 8).alias("uniqueness"))


def training_rows(v: Views) -> DataFrame:
    w = Window.partitionBy("etf_id").orderBy("bar")
    features = v.bar.select("etf_id", "bar", (F.col("high") / F.col("low") - 1).alias("spread"), (F.ln("close") - F.ln(F.lag("close").over(w))).alias("move"), F.ln("amount").alias("size"))
    events = labels.purged_folds(labelled(v).where("t1 is not null"), 3).withColumn("y", (F.col("label") > 0).cast("int"))
    return R.checked_join(events, features, ["etf_id", "bar"], "inner", "m:1").withColumn("weight", F.lit(1.0))


@query("t04_out_of_fold_predictions")
def t04(v: Views) -> DataFrame:
    return models.oof_predictions(training_rows(v), ["spread", "move", "size"], "y", "weight", ["etf_id", "bar"])


@query("t05_training_frame", f"SELECT e.etf_id, e.bar, e.label, round(ln(b.amount), 9) AS size FROM ({LABEL_SQL}) e JOIN fx_bar b ON b.etf_id = e.etf_id AND b.bar = e.bar WHERE e.t1 IS NOT NULL AND b.bar >= 2")
def t05(v: Views) -> DataFrame:
    rows = R.checked_join(labelled(v).where("t1 is not null"), v.bar.select("etf_id", "bar", "amount"), ["etf_id", "bar"], "inner1", "1:1")
    return rows.where("bar >= 2").select("etf_id", "bar", "label", F.round(F.ln("amount"), 9).alias("size"))


@query("t06_threshold_choice", f"""SELECT threshold, round(gain, 9) AS gain, round(share, 9) AS share FROM (SELECT t.threshold, sum(x.g) / count(*) AS gain, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM fx_bar) AS share FROM (SELECT p, close / open - 1 AS g FROM ({SCORE_SQL}) s JOIN fx_bar b USING (etf_id, bar)) x
  JOIN (SELECT CAST(unnest([0.5, 0.55, 0.6, 0.65, 0.7]) AS DOUBLE) AS threshold) t ON x.p >= t.threshold GROUP BY 1) WHERE share >= 0.1 ORDER BY gain DESC, threshold LIMIT 1""")
def t06(v: Views) -> DataFrame:
    rows = scores(v).join(v.bar.select("etf_id", "bar", (F.col("close") / F.col("open") - 1).alias("gain")), ["etf_id", "bar"]).withColumn("w", F.lit(1.0))
    best = models.best_threshold(rows, "p", "gain", "w")
    return best.select("threshold", F.round("gain", 9).alias("gain"), F.round("share", 9).alias("share"))


@query("t07_gate_metrics", f"""SELECT etf_id, count(*) AS n, round(avg(CAST(c AS INTEGER)), 9) AS share, round(avg(CAST(c = y AS INTEGER)), 9) AS accuracy,
    CASE WHEN count(*) FILTER (WHERE c) > 0 THEN round(count(*) FILTER (WHERE c AND y) / count(*) FILTER (WHERE c), 9) END AS precision,
    CASE WHEN count(*) FILTER (WHERE y) > 0 THEN round(count(*) FILTER (WHERE c AND y) / count(*) FILTER (WHERE y), 9) END AS recall,
    CASE WHEN count(*) < 100 THEN 'few' WHEN min(y) = max(y) THEN 'one_sided' ELSE 'ok' END AS status
    FROM (SELECT etf_id, p >= 0.5 AS c, label > 0 AS y FROM ({SCORE_SQL}) s JOIN ({LABEL_SQL}) l USING (etf_id, bar) WHERE label IS NOT NULL) GROUP BY 1""")
def t07(v: Views) -> DataFrame:
    rows = scores(v).join(labelled(v).select("etf_id", "bar", "label"), ["etf_id", "bar"])
    found = validators.gate_metrics(rows, "p", F.col("label") > 0)
    return found.withColumns({c: F.round(c, 9) for c in ("share", "accuracy", "precision", "recall")})


CUSUM_SQL = f"""WITH RECURSIVE s AS MATERIALIZED ({SCORE_SQL}), m(etf_id, bar, score, is_long, changed) AS (SELECT DISTINCT etf_id, -1::BIGINT, 0.0::DOUBLE, false, false FROM s UNION ALL
  SELECT etf_id, bar, CASE WHEN c THEN 0 ELSE x END, CASE WHEN c THEN NOT is_long ELSE is_long END, c FROM (SELECT *, CASE WHEN is_long THEN x <= -0.1 + 1e-12 ELSE x >= 0.2 - 1e-12 END AS c FROM
    (SELECT m.etf_id, s.bar, m.is_long, CASE WHEN m.is_long THEN least(0, m.score + s.p - 0.5) ELSE greatest(0, m.score + s.p - 0.5) END AS x FROM m JOIN s ON s.etf_id = m.etf_id AND s.bar = m.bar + 1)))
  SELECT etf_id, bar, round(score, 9) AS score, CASE WHEN is_long THEN 'long' ELSE 'flat' END AS state, CASE WHEN changed THEN CASE WHEN is_long THEN 'flat_to_long' ELSE 'long_to_flat' END END AS transition FROM m WHERE bar >= 0"""


@query("t08_evidence_states", CUSUM_SQL)
def t08(v: Views) -> DataFrame:
    return models.cusum_states(scores(v), "etf_id", "bar", "p").withColumn("score", F.round("score", 9))


def executed(v: Views) -> DataFrame:
    moves = models.cusum_states(scores(v), "etf_id", "bar", "p").where("transition is not null").join(v.bar.select("etf_id", "bar", "end_date"), ["etf_id", "bar"])
    opens = v.curve.select("etf_id", F.col("date").alias("open_date"), F.col("nav").alias("price"))
    return R.asof_join(moves, opens, "end_date", "open_date", ["open_date", "price"], by=["etf_id"], forward=True, allow_exact=False).select("etf_id", F.col("open_date").alias("date"), "transition", "price")


@query("t09_transition_ledger")
def t09(v: Views) -> DataFrame:
    return models.transition_ledger(executed(v))


@query("t10_marked_ledger")
def t10(v: Views) -> DataFrame:
    """Value of each day: cash and shares of the last trade up to it."""
    trades = models.transition_ledger(executed(v)).select("etf_id", F.col("date").alias("trade_date"), "cash", F.when(F.col("side") == "buy", F.col("shares")).otherwise(0).alias("held"))
    days = R.asof_join(v.curve.select("etf_id", "date", "nav"), trades, "date", "trade_date", ["cash", "held"], by=["etf_id"])
    return days.select("etf_id", "date", F.round(F.coalesce("cash", F.lit(1e6)) + F.coalesce("held", F.lit(0)) * F.col("nav"), 6).alias("value"))


@query("t11_meta_frame", f"SELECT s.etf_id, s.bar, l.label, greatest(s.end_date, l.t1) AS known_at FROM ({SCORE_SQL}) s JOIN ({LABEL_SQL}) l USING (etf_id, bar) WHERE s.p >= 0.5 AND l.t1 IS NOT NULL")
def t11(v: Views) -> DataFrame:
    targets = labelled(v).where("t1 is not null").select("etf_id", "bar", "t1", "label")
    candidates = models.forbid_outcomes(scores(v)).where("p >= 0.5").join(targets.select("etf_id", "bar"), ["etf_id", "bar"], "left_semi")
    return models.meta_frame(candidates, targets, "end_date", "t1", ["etf_id", "bar"]).select("etf_id", "bar", "label", "known_at")


@query("t12_return_history", f"SELECT date, etf_id, round(ret, 12) AS ret FROM ({RETURN_SQL})")
def t12(v: Views) -> DataFrame:
    return daily_returns(v).withColumn("ret", F.round("ret", 12))


IDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query("t13_inverse_volatility", f"""WITH r AS ({RETURN_SQL}), d AS (SELECT date FROM r WHERE etf_id IN {IDS} AND ret IS NOT NULL GROUP BY 1 HAVING count(*) = 4), s AS (SELECT r.etf_id, 1 / stddev_samp(r.ret) AS i FROM r JOIN d ON d.date = r.date WHERE r.etf_id IN {IDS} GROUP BY 1)
  SELECT etf_id, round(i / (SELECT sum(i) FROM s), 9) AS weight FROM s""")
def t13(v: Views) -> DataFrame:
    _, weights = models.allocate(daily_returns(v), IDS, "inverse_vol")
    return v.spark.createDataFrame([(k, round(x, 9)) for k, x in weights.items()], "etf_id string, weight double")


@query("t13_hierarchical_risk_parity")
def t13h(v: Views) -> DataFrame:
    _, weights = models.allocate(daily_returns(v), IDS, "hrp")
    return v.spark.createDataFrame(list(weights.items()), "etf_id string, weight double")


@query("t14_sharpe_evidence", f"SELECT etf_id, count(ret) AS n, round(avg(ret) / stddev_samp(ret), 9) AS sharpe, round(skewness(ret), 6) AS skew, round(kurtosis(ret) + 3, 5) AS kurtosis FROM ({RETURN_SQL}) GROUP BY 1")
def t14(v: Views) -> DataFrame:
    returns = daily_returns(v)
    ids = [r.etf_id for r in v.orders.select("etf_id").distinct().orderBy("etf_id").collect()]
    found = [(k, models.sharpe_evidence(returns.where(F.col("etf_id") == k), "ret", 10, 0.5)) for k in ids]
    return v.spark.createDataFrame([(k, e.n, round(e.sharpe, 9), round(e.skew, 6), round(e.kurtosis, 5)) for k, e in found], "etf_id string, n long, sharpe double, skew double, kurtosis double")


COVER = "SELECT CAST(fold AS INTEGER) AS fold, '{0}' AS feature, count(*) AS n, count({0}) AS known FROM (" + FOLD_SQL + ") f JOIN (" + SPREAD_SQL + ") x USING (etf_id, bar) WHERE part = 'train' GROUP BY 1"


@query("t16_feature_coverage", " UNION ALL ".join(COVER.format(c) for c in ("level14", "change14", "level60", "change60")))
def t16(v: Views) -> DataFrame:
    names = ["level14", "change14", "level60", "change60"]
    rows = features.deviations(features.difference(v.bar.withColumn("y", F.ln("close")), "y", "d"), "y", "d")
    folds = labels.purged_folds(labelled(v).where("t1 is not null"), 3).where("part = 'train'").select("fold", "etf_id", "bar")
    return validators.feature_coverage(folds.join(rows, ["etf_id", "bar"]), "fold", names)


TARGET_SQL = """WITH c AS (SELECT etf_id, date, nav FROM fx_curve), b AS (SELECT etf_id, bar, end_date, lead(end_date, 6) OVER (PARTITION BY etf_id ORDER BY bar) AS vertical FROM fx_bar),
  e AS (SELECT b.etf_id, b.bar, b.vertical, min(c.date) AS entry_date, arg_min(c.nav, c.date) AS entry FROM b JOIN c ON c.etf_id = b.etf_id AND c.date > b.end_date WHERE b.vertical IS NOT NULL GROUP BY 1, 2, 3),
  t AS (SELECT e.etf_id, e.bar, e.entry_date, e.entry, coalesce(min(c.date) FILTER (WHERE abs(ln(c.nav * (1 - 0.003)) - ln(e.entry * (1 + 0.001425))) >= 0.1), e.vertical) AS trigger FROM e JOIN c ON c.etf_id = e.etf_id AND c.date > e.entry_date AND c.date <= e.vertical GROUP BY e.etf_id, e.bar, e.entry_date, e.entry, e.vertical)
  SELECT t.etf_id, t.bar, t.entry_date, min(c.date) AS exit_date, round(arg_min(c.nav, c.date) * (1 - 0.003) / (t.entry * (1 + 0.001425)) - 1, 9) AS net_return FROM t JOIN c ON c.etf_id = t.etf_id AND c.date > t.trigger GROUP BY t.etf_id, t.bar, t.entry_date, t.entry"""


@query("l04_next_open_targets", TARGET_SQL)
def l04(v: Views) -> DataFrame:
    return labels.next_open_targets(v.bar.select("etf_id", "bar", "end_date"), v.curve.select("etf_id", "date", "nav"), 0.1, 6).withColumn("net_return", F.round("net_return", 9))


@query("e01_tumbling_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM fx_event GROUP BY 1, 2")
def e01(v: Views) -> DataFrame:
    """A convenience over the event table; the streaming form is streaming.incremental.windowed_counts."""
    return v.event.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
