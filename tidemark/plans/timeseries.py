"""Causal transforms, calendars and time joins over the order and event tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import store
from ..functions import calendar, series
from ..operators import joins
from ..session import table
from .asof import CUTOFF, LEDGER_SQL, ledger
from .base import MONTHLY_SQL, RETURNS_SQL, monthly, r, returns, sql_r, timeline

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


W = "(PARTITION BY key ORDER BY month ROWS BETWEEN {} AND CURRENT ROW)"
ALL, LAST12, LAST6 = W.format("UNBOUNDED PRECEDING"), W.format("11 PRECEDING"), W.format("5 PRECEDING")
KEY = "(PARTITION BY key ORDER BY month)"


@query(f"SELECT series_id, max(event_time) AS last_event, max(knowledge_time) AS last_known, count(*) AS n_versions, date_diff('day', max(knowledge_time)::DATE, TIMESTAMP '{CUTOFF}'::DATE) AS age_days FROM ({LEDGER_SQL}) WHERE knowledge_time <= TIMESTAMP '{CUTOFF}' GROUP BY 1")
def freshness(spark, sf_dir):
    return store.freshness(ledger(spark, sf_dir), CUTOFF)


@query(f"SELECT series_id, event_time, knowledge_time, _seq, value, row_number() OVER w AS version, {sql_r('value - lag(value) OVER w', 'change')} FROM ({LEDGER_SQL}) WINDOW w AS (PARTITION BY series_id, event_time ORDER BY knowledge_time, _seq)")
def revisions(spark, sf_dir):
    return store.revisions(ledger(spark, sf_dir)).withColumn("change", r("change", "change"))


@query(f"SELECT series_id, count(*) FILTER (value >= 20 AND value <= 400) AS valid, count(*) FILTER (NOT (value >= 20 AND value <= 400)) AS quarantined FROM ({LEDGER_SQL}) GROUP BY 1")
def contract_validation(spark, sf_dir):
    checked = store.validate(ledger(spark, sf_dir).withColumn("valid_min", F.lit(20.0)).withColumn("valid_max", F.lit(400.0)))
    bad = F.size("violations") > 0
    return checked.groupBy("series_id").agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("quarantined"))


@query(f"SELECT key, month, {sql_r('avg(ret) OVER p', 'mean')}, {sql_r('stddev_samp(ret) OVER p', 'std')}, {sql_r('min(ret) OVER p', 'low')}, {sql_r('median(ret) OVER p', 'mid')} FROM ({RETURNS_SQL}) WINDOW p AS {LAST12}")
def rolling_statistics(spark, sf_dir):
    w = timeline()
    stats = {"mean": F.avg, "std": F.stddev_samp, "low": F.min, "mid": series.quantile(0.5)}
    return returns(spark, sf_dir).select("key", "month", *(r(series.rolling(f, "ret", w, 12, 1), n) for n, f in stats.items()))


@query(f"SELECT key, month, CASE WHEN count(ret) OVER p >= 6 THEN {sql_r('(ret - avg(ret) OVER p) / nullif(greatest(stddev_samp(ret) OVER p, 0.05), 0)', 'z').removesuffix(' AS z')} END AS z FROM ({RETURNS_SQL}) WINDOW p AS {LAST12}")
def rolling_zscore(spark, sf_dir):
    return returns(spark, sf_dir).select("key", "month", r(series.zscore("ret", timeline(), 12, floor=0.05), "z"))


@query(f"""SELECT key, month, {sql_r('CASE WHEN ret IS NULL OR n < 20 THEN ret ELSE least(greatest(ret, lo), hi) END', 'w')} FROM (
 SELECT *, count(ret) OVER p AS n, quantile_cont(ret, 0.05) OVER p AS lo, quantile_cont(ret, 0.95) OVER p AS hi FROM (SELECT key, month, ret FROM ({RETURNS_SQL})) WINDOW p AS {ALL})""")
def causal_winsorize(spark, sf_dir):
    return returns(spark, sf_dir).select("key", "month", r(series.winsorize("ret", timeline()), "w"))


@query(f"SELECT key, month, {sql_r('total - lag(total, 3) OVER w', 'd3')}, {sql_r('total / lag(total, 12) OVER w - 1', 'yoy')}, {sql_r('lead(total) OVER w', 'next_total')} FROM ({MONTHLY_SQL}) WINDOW w AS {KEY}")
def differences(spark, sf_dir):
    w = timeline()
    return monthly(spark, sf_dir).select("key", "month", r(series.difference("total", w, 3), "d3"), r(series.change("total", w, 12), "yoy"), r(F.lead("total").over(w), "next_total"))


@query(f"SELECT key, month, CASE WHEN count(ret) OVER f = 3 THEN {sql_r('product(1 + ret) OVER f - 1', 'x').removesuffix(' AS x')} END AS fwd3, CASE WHEN count(ret) OVER b = 12 THEN {sql_r('product(1 + ret) OVER b - 1', 'x').removesuffix(' AS x')} END AS back12 FROM ({RETURNS_SQL}) WINDOW f AS (PARTITION BY key ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), b AS {LAST12}")
def compounded_returns(spark, sf_dir):
    w = timeline()
    return returns(spark, sf_dir).select("key", "month", r(series.forward_return("ret", w, 3), "fwd3"), r(series.compound("ret", w, 12), "back12"))


@query(f"SELECT key, month, {sql_r('c', 'equity')}, {sql_r('c / max(c) OVER p - 1', 'drawdown')} FROM (SELECT key, month, product(1 + coalesce(ret, 0)) OVER {ALL} AS c FROM ({RETURNS_SQL})) WINDOW p AS {ALL}")
def equity_drawdown(spark, sf_dir):
    w = timeline()
    c = returns(spark, sf_dir).withColumn("c", series.equity("ret", w))
    return c.select("key", "month", r("c", "equity"), r(series.drawdown("c", w), "drawdown"))


@query(f"SELECT key, month, {sql_r('CASE WHEN count(ret) OVER p >= 3 THEN sum(ret) OVER p END', 'mom3')} FROM ({RETURNS_SQL}) WINDOW p AS {W.format('2 PRECEDING')}")
def momentum(spark, sf_dir):
    return returns(spark, sf_dir).select("key", "month", r(series.momentum("ret", timeline(), 3), "mom3"))


@query(f"""SELECT key, month, {sql_r('pos', 'position')}, {sql_r('lag(pos) OVER w * ret', 'gross')}, {sql_r('lag(pos) OVER w * ret - abs(lag(pos) OVER w - coalesce(lag(pos, 2) OVER w, 0)) * 0.0002', 'net')} FROM (
 SELECT *, CASE WHEN n >= 12 AND sd > 0 THEN least(greatest((sig - mu) / sd, -2), 2) / 2 END AS pos FROM (
  SELECT *, count(sig) OVER p AS n, avg(sig) OVER p AS mu, stddev_samp(sig) OVER p AS sd FROM (
   SELECT key, month, ret, CASE WHEN count(ret) OVER m >= 3 THEN sum(ret) OVER m END AS sig FROM ({RETURNS_SQL}) WINDOW m AS {W.format('2 PRECEDING')}) WINDOW p AS {ALL})) WINDOW w AS {KEY}""")
def momentum_sleeve(spark, sf_dir):
    w = timeline()
    s = returns(spark, sf_dir).withColumn("sig", series.momentum("ret", w, 3)).withColumn("pos", series.causal_position("sig", w))
    held, before = F.lag("pos").over(w), F.coalesce(F.lag("pos", 2).over(w), F.lit(0.0))
    return s.select("key", "month", r("pos", "position"), r(held * F.col("ret"), "gross"), r(held * F.col("ret") - F.abs(held - before) * 0.0002, "net"))


@query(f"SELECT key, month, {sql_r('(SELECT avg((b.ret <= a.ret)::INT) FROM x b WHERE b.key = a.key AND b.month <= a.month AND b.ret IS NOT NULL)', 'pct')} FROM x a".join([f"WITH x AS ({RETURNS_SQL}) ", ""]))
def expanding_rank(spark, sf_dir):
    return returns(spark, sf_dir).select("key", "month", r(series.expanding_rank("ret", timeline()), "pct"))


SPARSE_SQL = f"SELECT key, month, CASE WHEN month(month) % 3 = 0 THEN total END AS v FROM ({MONTHLY_SQL})"


@query(f"""SELECT key, month, {sql_r('last_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)', 'filled')}, {sql_r(f'last_value(v IGNORE NULLS) OVER {ALL}', 'held')}, {sql_r('lag(v, 2) OVER (PARTITION BY key ORDER BY month)', 'published')} FROM ({SPARSE_SQL})""")
def bounded_fill(spark, sf_dir):
    w = timeline()
    s = monthly(spark, sf_dir).withColumn("v", F.when(F.month("month") % 3 == 0, F.col("total")))
    return s.select("key", "month", r(series.bounded_ffill("v", w, 1), "filled"), r(series.hold("v", w), "held"), r(F.lag("v", 2).over(w), "published"))


@query("SELECT event_type AS key, last_day(ts::DATE) AS month, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def month_end_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "key")
    return calendar.to_monthly(e, "key", "ts", "value", tie="event_id")


@query(f"""SELECT g.key, g.month, {sql_r('m.total', 'total')} FROM (SELECT key, last_day(unnest(generate_series(date_trunc('month', min(month)), date_trunc('month', max(month)), INTERVAL 1 MONTH))::DATE) AS month FROM (SELECT * FROM ({MONTHLY_SQL}) WHERE month(month) % 3 = 0) GROUP BY key) g
 LEFT JOIN (SELECT * FROM ({MONTHLY_SQL}) WHERE month(month) % 3 = 0) m USING (key, month)""")
def calendar_grid(spark, sf_dir):
    q = monthly(spark, sf_dir).where("month(month) % 3 = 0").select("key", "month", "total")
    return calendar.month_grid(q, "key").select("key", "month", r("total", "total"))


ANNUAL_SQL = "SELECT o_orderpriority AS key, last_day(make_date(year(o_orderdate), 12, 1)) AS year_end, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2"


@query(f"""WITH a AS ({ANNUAL_SQL}), g AS (SELECT key, last_day(unnest(generate_series(date_trunc('month', min(year_end)), date_trunc('month', max(year_end)), INTERVAL 1 MONTH))::DATE) AS month FROM a GROUP BY key)
 SELECT g.key, g.month, a.v FROM g ASOF JOIN a ON g.key = a.key AND g.month >= a.year_end""")
def annual_hold(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.groupBy(F.col("o_orderpriority").alias("key"), F.last_day(F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(1))).alias("year_end")).agg(F.count("*").cast("double").alias("v"))
    return calendar.annual_to_monthly(a, "key", "year_end", "v")


@query(f"SELECT o_orderkey, last_day(o_orderdate::DATE) AS month_end, last_day((o_orderdate::DATE + 1)::DATE) AS next_end, last_day((date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE) AS previous_end, o_orderdate::TIMESTAMP + INTERVAL 10 DAY AS known FROM orders")
def month_ends(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", calendar.month_end("o_orderdate").alias("month_end"), calendar.next_month_end("o_orderdate").alias("next_end"), calendar.previous_month_end("o_orderdate").alias("previous_end"), calendar.knowledge_time("o_orderdate", 10).alias("known"))


@query("""SELECT v.event_id, v.user_id, v.ts, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') v
 ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON v.user_id = p.user_id AND v.ts >= p.ts""")
def asof_backward(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return joins.asof_join(views, buys, "user_id", "ts", ["last_purchase"])


SCENARIOS = [("first", "1996-01-01", "1996-06-30"), ("second", "1997-03-01", "1998-02-28"), ("overlap", "1997-06-01", "1997-12-31"), ("last", "2000-01-01", "2001-12-31")]
SPANS_SQL = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in SCENARIOS) + ") s(scenario, a, b)"


def _scenarios(spark):
    return spark.createDataFrame(SCENARIOS, "scenario string, a string, b string").select("scenario", F.col("a").cast("date"), F.col("b").cast("date"))


@query(f"SELECT scenario, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total FROM orders JOIN {SPANS_SQL} ON o_orderdate::DATE BETWEEN a AND b GROUP BY 1")
def scenario_range_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    hit = joins.range_join(o, _scenarios(spark), "day", "a", "b")
    return hit.groupBy("scenario").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"SELECT o_orderkey, scenario FROM orders JOIN {SPANS_SQL} ON o_orderdate::DATE BETWEEN a AND b")
def bucketed_range_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return joins.range_join_days(o, _scenarios(spark), "day", "a", "b").select("o_orderkey", "scenario")


FOLD_SQL = "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS a, l_shipdate::DATE + 30 AS b, year(l_shipdate) AS fold FROM lineitem"


@query(f"""WITH x AS ({FOLD_SQL}), s AS (SELECT fold, min(a) AS f, max(b) + 5 AS t FROM x GROUP BY fold)
 SELECT s.fold, count(*) AS kept FROM s, x WHERE x.fold <> s.fold AND NOT (x.a <= s.t AND x.b >= s.f) GROUP BY s.fold""")
def purge_anti_join(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("a"), F.date_add(F.to_date("l_shipdate"), 30).alias("b"), F.year("l_shipdate").alias("own"))
    days = x.groupBy("own", "a", "b").agg(F.count("*").alias("n"))  # rows of one span are purged together
    years = days.groupBy().agg(F.collect_set("own").alias("folds"))
    train = days.crossJoin(F.broadcast(years)).withColumn("fold", F.explode("folds")).where("own <> fold")  # one row of years; a row for each day and fold that it trains
    return joins.purge(train, days.withColumn("fold", F.col("own")), "a", "b", "fold", 5).groupBy("fold").agg(F.sum("n").alias("kept"))


@query("""SELECT user_id, day, count(*) AS n FROM (SELECT user_id, ts::DATE AS day, min(event_id) AS first_id FROM events c WHERE event_type = 'click'
 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'error' AND o.user_id = c.user_id AND o.ts::DATE = c.ts::DATE) GROUP BY 1, 2) GROUP BY 1, 2""")
def insert_absent(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    have, new = (e.where(F.col("event_type") == t).select("user_id", "day", F.col("event_id").alias("first_id")) for t in ("error", "click"))
    return joins.insert_absent(have, new, ["user_id", "day"]).groupBy("user_id", "day").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def keep_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return joins.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.v, b.v) AS v FROM (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) a
 FULL JOIN (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.user_id = b.user_id""")
def patch_outer(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.max("value").alias("v"))
    return joins.patch(side("view"), side("click"), ["user_id"], "v")


@query(f"SELECT a.key, a.month, a.total, b.total AS previous_total FROM ({MONTHLY_SQL}) a LEFT JOIN ({MONTHLY_SQL}) b ON a.key = b.key AND b.month = last_day((date_trunc('month', a.month) - INTERVAL 1 MONTH)::DATE)")
def previous_calendar_month(spark, sf_dir):
    return joins.previous_month(monthly(spark, sf_dir).select("key", "month", "total"), "key", "month", "total")


@query(f"""WITH x AS (SELECT key, month, ret, row_number() OVER (PARTITION BY key ORDER BY month) AS k FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL),
 g AS (SELECT a.key, a.month, a.k, sum(power(1 - 2 / 21.0, a.k - b.k)) AS w, sum(power(1 - 2 / 21.0, 2 * (a.k - b.k))) AS w2, sum(power(1 - 2 / 21.0, a.k - b.k) * b.ret) AS s, sum(power(1 - 2 / 21.0, a.k - b.k) * b.ret * b.ret) AS q FROM x a JOIN x b ON a.key = b.key AND b.k <= a.k GROUP BY 1, 2, 3)
 SELECT key, month, {sql_r('CASE WHEN k >= 6 THEN s / w END', 'ewm_mean')}, {sql_r('CASE WHEN k >= 6 THEN sqrt(greatest(q / w - s * s / w / w, 0) * w * w / (w * w - w2)) END', 'ewm_std')} FROM g""")
def ewm_volatility(spark, sf_dir):
    e = series.ewm(returns(spark, sf_dir).where("ret is not null").select("key", "month", "ret"), "key", "month", "ret", span=20, least=6)
    return e.select("key", "month", r("ewm_mean", "ewm_mean"), r("ewm_std", "ewm_std"))


@query(f"""WITH x AS (SELECT key, month, total, row_number() OVER (PARTITION BY key ORDER BY month) AS bar, stddev_samp(ret) OVER {LAST12} AS vol FROM ({RETURNS_SQL})), y AS (
 SELECT a.key, a.month, arg_min(CASE WHEN b.total >= a.total * (1 + a.vol) THEN 1 WHEN b.total <= a.total * (1 - a.vol) THEN -1 END, b.month) FILTER (b.total >= a.total * (1 + a.vol) OR b.total <= a.total * (1 - a.vol)) AS hit FROM x a LEFT JOIN x b ON a.key = b.key AND b.bar > a.bar AND b.bar <= a.bar + 6
 WHERE a.vol > 0 GROUP BY 1, 2),
 z AS (SELECT y.key, y.month, coalesce(y.hit, 0)::INT AS label, min(b.month) FILTER ((y.hit = 1 AND b.total >= a.total * (1 + a.vol)) OR (y.hit = -1 AND b.total <= a.total * (1 - a.vol))) AS touched, max(b.month) AS last_month
  FROM y JOIN x a ON a.key = y.key AND a.month = y.month JOIN x b ON b.key = a.key AND b.bar > a.bar AND b.bar <= a.bar + 6 GROUP BY 1, 2, 3)
 SELECT z.key, z.month, z.label, coalesce(touched, last_month) AS t1, round(e.total / s.total - 1, 7) AS ret FROM z JOIN x s ON s.key = z.key AND s.month = z.month JOIN x e ON e.key = z.key AND e.month = coalesce(touched, last_month)""")
def triple_barrier(spark, sf_dir):
    w = timeline()
    x = returns(spark, sf_dir).withColumn("vol", series.rolling(F.stddev_samp, "ret", w, 12, 1))
    return store.triple_barrier(x, w, "month", "total", "vol", 6).where("vol > 0").select("key", "month", "label", "t1", r("ret", "ret"))


@query("SELECT window_start, event_type, count(*) AS n, sum(value::DECIMAL(18, 4))::DOUBLE AS total FROM (SELECT date_trunc('day', ts) AS window_start, * FROM events) GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
