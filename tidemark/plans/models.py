"""Models, runs, alerts, parsers, scalar families and streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import series
from ..operators import joins, models, regimes, risk, runs
from ..session import shared_folder, table
from ..sources import parsers
from ..streaming import filters, jobs
from .base import MONTHLY_SQL, RETURNS_SQL, monthly, r, returns, signals, sql_r, timeline

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _wide(spark, sf_dir):
    x = returns(spark, sf_dir).where("ret is not null").withColumn("a", F.substring("key", 1, 1))
    return x.groupBy("month").pivot("a", ["1", "2", "3", "4", "5"]).agg(F.first("ret")).select(F.lit("all").alias("key"), "month", *(F.col(f"`{k}`").alias(f"s{k}") for k in range(1, 6)))


@query()
def rolling_regression(spark, sf_dir):
    x = models.rolling_regression(signals(spark, sf_dir), "key", "month", ["signal", "carry"], "ret", 36)
    return x.select("key", "month", r("fitted", "fitted"), r("fitted_residual", "residual"))


@query()
def shrunken_rolling_regression(spark, sf_dir):
    x = models.rolling_regression(signals(spark, sf_dir), "key", "month", ["signal", "carry"], "ret", prior=[0.1, 0.0], weight=0.3)
    return x.select("key", "month", r("fitted", "fitted"))


W60 = "(PARTITION BY key ORDER BY month ROWS 59 PRECEDING)"


@query(f"""SELECT key, month, {sql_r('least(greatest(2.5 + greatest(cds / 100, embi / 100 * 0.35) + coalesce(least(greatest((vix - mv) / mv * 0.5, -1), 2), 0) + coalesce(least(greatest((debt - 60) * 0.03, 0), 3), 0) + coalesce(least(greatest((vix - mean) / greatest(sd, 0.5) * -0.3, -1), 1), 0), 2), 12)', 'rstar')} FROM (
 SELECT *, CASE WHEN count(vix) OVER w >= 24 THEN median(vix) OVER w END AS mv, CASE WHEN count(vix) OVER w >= 24 THEN avg(vix) OVER w END AS mean, CASE WHEN count(vix) OVER w >= 24 THEN stddev_samp(vix) OVER w END AS sd
 FROM (SELECT key, month, 100.0 + n AS cds, 150.0 + n AS embi, n::DOUBLE AS vix, 40.0 + n / 2.0 AS debt FROM ({RETURNS_SQL})) WINDOW w AS {W60})""")
def parity_rate(spark, sf_dir):
    m = monthly(spark, sf_dir)
    n = F.col("n").cast("double")
    return m.select("key", "month", r(models.parity_rate(F.lit(2.5), 100.0 + n, 150.0 + n, n, 40.0 + n / 2, n, timeline()), "rstar"))


BLEND = {"carry": {"a": 0.6, "b": 0.4}, "riskoff": {"a": 0.2, "b": 0.8}}


@query(f"""SELECT key, month, {sql_r('least(greatest((a * wa + b * wb) / (wa + wb), 2), 10)', 'rstar')}, {sql_r('CASE WHEN a < 3 THEN -1 WHEN a > 6 THEN 1 ELSE (a - 4.5) / 1.5 END', 'signal')} FROM (
 SELECT *, 0.6 * p + 0.2 * (1 - p) AS wa, 0.4 * p + 0.8 * (1 - p) AS wb FROM (SELECT key, month, n / 20.0 AS a, n / 15.0 AS b, (month(month) % 4) / 3.0 AS p FROM ({RETURNS_SQL})))""")
def regime_blend(spark, sf_dir):
    m = monthly(spark, sf_dir).select("key", "month", (F.col("n") / 20.0).alias("a"), (F.col("n") / 15.0).alias("b"), ((F.month("month") % 4) / 3.0).alias("p"))
    rstar = models.regime_blend({"a": F.col("a"), "b": F.col("b")}, {"carry": F.col("p"), "riskoff": 1 - F.col("p")}, BLEND)
    return m.select("key", "month", r(rstar, "rstar"), r(models.policy_regime(F.col("a")), "signal"))


@query(f"""WITH RECURSIVE x AS (SELECT key, month, n::DOUBLE AS v, row_number() OVER (PARTITION BY key ORDER BY month) AS k FROM ({MONTHLY_SQL})),
 f AS (SELECT key, month, k, v AS level, 10.05::DOUBLE * (1 - 10.05 / 11.05) AS p FROM x WHERE k = 1
  UNION ALL SELECT x.key, x.month, x.k, level + (p + 0.05) / (p + 1.05) * (v - level), (p + 0.05) * (1 - (p + 0.05) / (p + 1.05)) FROM f JOIN x ON x.key = f.key AND x.k = f.k + 1)
 SELECT key, month, {sql_r('level', 'level')}, {sql_r('level - 1.96 * sqrt(p)', 'level_low')}, {sql_r('level + 1.96 * sqrt(p)', 'level_high')} FROM f""")
def local_level(spark, sf_dir):
    m = monthly(spark, sf_dir).withColumn("v", F.col("n").cast("double")).select("key", "month", "v")
    x = models.local_level(m, "key", "month", "v")
    return x.select("key", "month", *(r(c, c) for c in ("level", "level_low", "level_high")))


@query()
def regime_probabilities(spark, sf_dir):
    x = signals(spark, sf_dir).select("key", "month", "ret", "carry")
    x = regimes.point_in_time(x, "key", "month", ["ret", "carry"], F.month("month") % 6 == 0, 2, "ret", 36)
    return x.select("key", "month", "asof", r("p0", "p0"), r("p1", "p1"))


@query()
def dynamic_factor(spark, sf_dir):
    return models.dynamic_factor(_wide(spark, sf_dir), "key", "month", [f"s{k}" for k in range(1, 6)], "s1").select("month", r("factor", "factor"))


@query(f"""SELECT {sql_r('power(5, 2) / sum(CASE WHEN i = j THEN 1 ELSE 2 END * c * c)', 'eff_n')} FROM (SELECT a.key AS i, b.key AS j, corr(a.ret, b.ret) AS c FROM ({RETURNS_SQL}) a JOIN ({RETURNS_SQL}) b ON a.month = b.month AND a.key <= b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)""")
def effective_number(spark, sf_dir):
    c = risk.covariance(returns(spark, sf_dir), "key", "month", "ret")
    return models.effective_number(c).select(r("eff_n", "eff_n"))


@query()
def walk_forward(spark, sf_dir):
    return models.walk_forward(signals(spark, sf_dir), "key", "month", ["signal", "carry"], "fwd").select("key", "month", r("prediction", "prediction"))


@query()
def rolling_books(spark, sf_dir):
    w = _wide(spark, sf_dir)
    for m in ("equal", "min_variance", "black_litterman"):
        w = models.rolling_book(w, "key", "month", [f"s{k}" for k in range(1, 6)], method=m).withColumnRenamed("book_return", m)
    return w.select("month", *(r(m, m) for m in ("equal", "min_variance", "black_litterman")))


@query(f"""SELECT key, month, {sql_r('greatest(CASE WHEN d <= -0.1 THEN 0 WHEN d <= -0.05 THEN 0.5 - 0.5 * (d + 0.05) / -0.05 WHEN d <= 0 THEN 1 - 0.5 * d / -0.05 ELSE 1 END, 0.1)', 'scale')} FROM (SELECT key, month, c / max(c) OVER w - 1 AS d FROM (SELECT key, month, product(1 + coalesce(ret, 0) / 20) OVER (PARTITION BY key ORDER BY month) AS c FROM ({RETURNS_SQL})) WINDOW w AS (PARTITION BY key ORDER BY month))""")
def drawdown_overlay(spark, sf_dir):
    w = timeline()
    x = returns(spark, sf_dir).withColumn("c", series.equity(F.col("ret") / 20, w)).withColumn("d", series.drawdown("c", w))
    return x.select("key", "month", r(models.drawdown_scale(F.col("d")), "scale"))


# runs: an order is a run of its customer


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("strategy"), F.struct("o_orderdate", "o_orderkey").alias("completed_at"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        F.col("o_orderpriority").alias("regime"), (F.col("o_totalprice") % 1).alias("p_stress"), ((F.col("o_totalprice") % 7) - 3.5).alias("score"), (-(F.col("o_totalprice") % 20)).alias("max_drawdown"),
    )


RUNS_SQL = "SELECT o_orderkey AS run_id, o_custkey AS strategy, o_orderdate, o_orderpriority AS regime, o_totalprice % 1 AS p_stress, o_totalprice % 7 - 3.5 AS score, -(o_totalprice % 20) AS max_drawdown FROM orders WHERE o_orderstatus <> 'P'"


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def latest_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return runs.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def latest_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return runs.latest(o, [], ["o_orderdate", "o_orderkey"], 50, F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query(f"""WITH r AS (SELECT *, lag(regime) OVER w AS pr, lag(p_stress) OVER w AS ps, lag(score) OVER w AS pc FROM ({RUNS_SQL}) WINDOW w AS (PARTITION BY strategy ORDER BY o_orderdate, run_id)), a AS (
 SELECT run_id, 'regime_change' AS kind, 'warning' AS severity FROM r WHERE regime <> pr UNION ALL SELECT run_id, 'stress_rise', 'warning' FROM r WHERE regime = pr AND p_stress - ps > 0.15
 UNION ALL SELECT run_id, 'score_change', CASE WHEN abs(score - pc) > 2 THEN 'warning' ELSE 'info' END FROM r WHERE abs(score - pc) > 1 UNION ALL SELECT run_id, 'direction_reversal', 'warning' FROM r WHERE sign(score) * sign(pc) < 0
 UNION ALL SELECT run_id, 'drawdown', CASE WHEN max_drawdown < -15 THEN 'critical' ELSE 'warning' END FROM r WHERE max_drawdown < -10) SELECT kind, severity, count(*) AS n FROM a GROUP BY 1, 2""")
def run_alerts(spark, sf_dir):
    return runs.run_alerts(_runs(spark, sf_dir)).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH shares AS (SELECT l_orderkey AS run_id, l_returnflag AS feature, sum(l_quantity) / (sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey)) AS share FROM lineitem GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY share DESC, feature) AS rank FROM shares),
 past AS (SELECT run_id, lag(run_id) OVER (PARTITION BY strategy ORDER BY o_orderdate, run_id) AS past FROM ({RUNS_SQL})),
 r AS (SELECT n.run_id, n.feature, n.share, n.rank, coalesce(o.share, 0) AS was, o.rank AS wrank FROM ranked n JOIN past p ON p.run_id = n.run_id AND past IS NOT NULL LEFT JOIN ranked o ON o.run_id = p.past AND o.feature = n.feature),
 a AS (SELECT 'importance_crossing' AS kind, 'info' AS severity, feature AS subject FROM r WHERE (share >= 0.2) <> (was >= 0.2) UNION ALL SELECT 'importance_shift', 'warning', feature FROM r WHERE abs(share - was) > 0.15
  UNION ALL SELECT 'importance_first', 'info', feature FROM r WHERE rank = 1 AND coalesce(wrank <> 1, true))
 SELECT kind, severity, subject, count(*) AS n FROM a GROUP BY 1, 2, 3""")
def importance_alerts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    total = F.sum("l_quantity")
    shares = li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("feature")).agg(total.alias("q"))
    whole = li.groupBy(F.col("l_orderkey").alias("run_id")).agg(total.alias("t"))
    shares = shares.join(whole, "run_id").select("run_id", "feature", (F.col("q") / F.col("t")).alias("share"))
    return runs.importance_alerts(shares, _runs(spark, sf_dir)).groupBy("kind", "severity", "subject").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT l_orderkey AS run_id, l_linestatus AS instrument, sum(l_quantity) / 100 AS weight, round(avg(l_discount), 6) - 0.05 AS mu FROM lineitem GROUP BY 1, 2),
 past AS (SELECT run_id, lag(run_id) OVER (PARTITION BY strategy ORDER BY o_orderdate, run_id) AS past FROM ({RUNS_SQL})),
 m AS (SELECT n.weight - coalesce(o.weight, 0) AS move, past FROM w n JOIN past p ON p.run_id = n.run_id LEFT JOIN w o ON o.run_id = p.past AND o.instrument = n.instrument),
 a AS (SELECT 'weight_move' AS kind, CASE WHEN abs(move) > 0.2 THEN 'warning' ELSE 'info' END AS severity FROM m WHERE past IS NOT NULL AND abs(move) > 0.1
  UNION ALL SELECT 'gross_weight', 'critical' FROM (SELECT run_id FROM w GROUP BY 1 HAVING sum(abs(weight)) > 2)
  UNION ALL SELECT 'signal_conflict', 'warning' FROM w WHERE abs(weight) > 0.05 AND ((weight > 0 AND mu < -0.01) OR (weight < 0 AND mu > 0.01)))
 SELECT kind, severity, count(*) AS n FROM a GROUP BY 1, 2""")
def weight_alerts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("instrument")).agg((F.sum("l_quantity") / 100).alias("weight"), (F.round(F.avg("l_discount"), 6) - 0.05).alias("mu"))
    return runs.weight_alerts(w, _runs(spark, sf_dir)).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_custkey AS instrument, o_orderdate AS "at", list_distinct(list(o_orderpriority)) AS f FROM orders GROUP BY 1, 2), p AS (SELECT *, lag(f) OVER (PARTITION BY instrument ORDER BY "at") AS p FROM s)
 SELECT instrument, "at", array_to_string(list_sort(list_filter(f, lambda x: list_contains(p, x) = false)), ',') AS gained, array_to_string(list_sort(list_filter(p, lambda x: list_contains(f, x) = false)), ',') AS lost FROM p WHERE p IS NOT NULL""")
def selection_changes(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("instrument"), F.col("o_orderdate").alias("at")).agg(F.collect_set("o_orderpriority").alias("features"))
    return runs.selection_changes(s).select("instrument", "at", F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost"))


PNL_SQL = "SELECT o_custkey % 10 AS book, o_orderdate::DATE AS day, sum((o_totalprice - 150000)::DECIMAL(18, 2))::DOUBLE AS pnl FROM orders GROUP BY 1, 2"


@query(f"""WITH x AS (SELECT *, sum(pnl) OVER w AS c FROM ({PNL_SQL}) WHERE day <= DATE '1998-06-15' WINDOW w AS (PARTITION BY book ORDER BY day)), y AS (SELECT *, greatest(max(c) OVER (PARTITION BY book ORDER BY day), 0) AS h FROM x)
 SELECT book, round(coalesce(sum(pnl) FILTER (day >= DATE '1998-06-01'), 0), 2) AS mtd, round(coalesce(sum(pnl) FILTER (day >= DATE '1998-01-01'), 0), 2) AS ytd, round(sum(pnl), 2) AS inception, round(arg_max(c - h, day), 2) AS drawdown FROM y GROUP BY book""")
def pnl_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = o.groupBy((F.col("o_custkey") % 10).alias("book"), F.to_date("o_orderdate").alias("day")).agg(F.sum((F.col("o_totalprice") - 150000).cast("decimal(18,2)")).cast("double").alias("pnl"))
    s = runs.pnl_summary(d, "1998-06-15")
    return s.select("book", *(F.round(c, 2).alias(c) for c in ("mtd", "ytd", "inception", "drawdown")))


@query("""SELECT source, arg_max(status, (ts, event_id)) AS status, round(avg((status <> 'down')::INT) * 100, 7) AS uptime_pct, count(*) AS n FROM (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT event_type || user_id % 5 AS source, ts, event_id, CASE WHEN value % 20 >= 15 OR event_id % 11 = 0 THEN 'down' WHEN value % 20 > 10 THEN 'degraded' ELSE 'healthy' END AS status FROM events)) WHERE rn <= 100 GROUP BY source""")
def source_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.select(F.concat("event_type", (F.col("user_id") % 5).cast("string")).alias("source"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_id") % 11 == 0, 503).otherwise(200).alias("code"), (F.col("value") % 20).alias("seconds"))
    return runs.health(p).withColumn("uptime_pct", r("uptime_pct", "uptime_pct"))


# parsers, over payloads made of the order table


@query("SELECT o_custkey AS series, o_orderdate::DATE AS event_time, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 7 <> 0")
def parse_sgs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.regexp_replace(F.format_string("%.2f", "o_totalprice"), r"\.", ","))
    item = F.struct(F.date_format("o_orderdate", "dd/MM/yyyy").alias("data"), value.alias("valor"))
    raw = o.groupBy(F.col("o_custkey").alias("series")).agg(F.to_json(F.collect_list(item)).alias("raw"))
    return parsers.sgs(raw).withColumn("value", F.round("value", 2))


@query("SELECT o_custkey AS series, o_orderdate::DATE AS event_time, (o_orderdate::DATE + 40)::TIMESTAMP AS knowledge_time, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 5 <> 0")
def parse_fred_vintages(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    value = F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.format_string("%.2f", "o_totalprice"))
    item = F.struct(day.cast("string").alias("date"), F.date_add(day, 40).cast("string").alias("realtime_start"), F.lit("9999-12-31").alias("realtime_end"), value.alias("value"))
    raw = o.groupBy(F.col("o_custkey").alias("series")).agg(F.to_json(F.struct(F.collect_list(item).alias("observations"))).alias("raw"))
    return parsers.fred_vintages(raw).select("series", "event_time", "knowledge_time", F.round("value", 2).alias("value"))


@query("""WITH l AS (SELECT l_suppkey, l_quantity AS t, l_extendedprice AS y FROM lineitem), g AS (SELECT l_suppkey AS base, max(t) FILTER (t <= 20) AS tl, min(t) FILTER (t >= 20) AS th FROM l GROUP BY 1)
 SELECT base, round(CASE WHEN tl = th THEN yl ELSE yl + (yh - yl) * (20 - tl) / (th - tl) END, 7) AS value FROM (SELECT base, tl, th, (SELECT max(y) FROM l WHERE l_suppkey = base AND t = tl) AS yl, (SELECT max(y) FROM l WHERE l_suppkey = base AND t = th) AS yh FROM g) WHERE tl IS NOT NULL AND th IS NOT NULL""")
def constant_maturity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lines = li.groupBy(F.col("l_suppkey").alias("base"), F.col("l_quantity").alias("ttm_years")).agg(F.max("l_extendedprice").alias("rate"))
    return parsers.constant_maturity(lines, 20.0).withColumn("value", r("value", "value"))


@query("""SELECT key, month, v, source FROM (SELECT *, min(rk) OVER (PARTITION BY key) AS best FROM (SELECT o_custkey AS key, o_orderkey AS month, o_totalprice AS v, o_orderpriority AS source, list_position(['1-URGENT', '3-MEDIUM', '5-LOW'], o_orderpriority) AS rk FROM orders) WHERE rk > 0) WHERE rk = best""")
def source_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("month"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("source"))
    return parsers.first_available(o, "key", "month", "v", "source", ["1-URGENT", "3-MEDIUM", "5-LOW"])


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k, sha256(event_type || ':' || event_id) AS digest, upper(event_type) AS kind, lpad(event_id::VARCHAR, 8, '0') AS padded FROM events")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.sha2(F.concat_ws(":", "event_type", "event_id"), 256).alias("digest"), F.upper("event_type").alias("kind"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("padded"))


@query("SELECT conv_id, count(*) AS turns, arg_max(text, turn) AS last_text, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY 1")
def conversation_state(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("text", "turn").alias("last_text"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query("SELECT strip_accents(lower(lang)) AS lang, source, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1, 2")
def accent_free_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(parsers.strip_accents(F.col("lang")).alias("lang"), "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# streams: the events table read as a stream to its end


def _finish(spark, stream, latest: list[str] | None = None):
    """Run a stream over all there is and return its rows from a table in the shared folder; with ``latest``, the last state of each of these keys, of which every batch writes those that changed."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if latest is None:
        writer.format("parquet").option("path", path).outputMode("append").start().awaitTermination()
        return spark.read.parquet(path)
    # a batch that runs again writes the same folder again
    writer.foreachBatch(lambda rows, k: rows.withColumn("_batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/{k:09d}")).outputMode("update").start().awaitTermination()
    return joins.keep_last(spark.read.parquet(f"{path}/*"), latest, ["_batch"]).drop("_batch")


def _event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if path.endswith("/") else f"{sf_dir}/events.parque[t]")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_windows(spark, sf_dir):
    e = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _finish(spark, jobs.windowed(e, "ts", "event_type", "value", late="40 days"), ["window_start", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def streaming_once_each(spark, sf_dir):
    e = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    both = e.unionByName(e)
    out = _finish(spark, jobs.once_each(both, "ts", ["event_id"], "40 days").select("event_id", "ts"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query()
def streaming_order_states(spark, sf_dir):
    e = _event_stream(spark, sf_dir)
    moves = F.element_at(F.create_map(*(F.lit(x) for p in (("view", "WORKING"), ("click", "PARTIAL"), ("purchase", "FILLED"), ("error", "CANCELED"), ("signup", "REJECTED")) for x in p)), F.col("event_type"))
    orders = e.select(F.floor(F.col("event_id") / 6).cast("long").alias("order_id"), F.col("event_id").alias("seq"), moves.alias("target"), F.lit(10.0).alias("qty"), F.when(F.col("event_type").isin("click", "purchase"), 2.0).otherwise(0.0).alias("fill_qty"), F.col("value").alias("fill_price"))
    return jobs.moves_of(_finish(spark, jobs.order_states(orders), ["order_id"])).select("order_id", "seq", "state", "filled", "legal")


# filters over the same stream; each user's events are a series


_USER_EVENTS = "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events"


@query(f"""WITH RECURSIVE x AS ({_USER_EVENTS}), f AS (
  SELECT user_id, event_id, k, value AS level, CASE WHEN value IS NULL THEN 10.05 ELSE 10.05 * (1 - 10.05 / 11.05) END AS p FROM x WHERE k = 1
  UNION ALL SELECT x.user_id, x.event_id, x.k, CASE WHEN x.value IS NULL THEN level WHEN level IS NULL THEN x.value ELSE level + (p + 0.05) / (p + 1.05) * (x.value - level) END,
   CASE WHEN x.value IS NULL THEN p + 0.05 ELSE (p + 0.05) * (1 - (p + 0.05) / (p + 1.05)) END FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
 SELECT user_id, event_id, {sql_r('level', 'level')}, {sql_r('p', 'variance')} FROM f""")
def streaming_levels(spark, sf_dir):
    with filters.state_store(spark):
        out = _finish(spark, filters.stream(_event_stream(spark, sf_dir), "user_id", "event_id", ["value"], filters.level_filter()))
    return out.select("user_id", "event_id", r(series.known("level"), "level"), r("variance", "variance"))


@query(f"""WITH RECURSIVE x AS ({_USER_EVENTS}), f AS (SELECT user_id, event_id, k, value, 100.0::DOUBLE AS h FROM x WHERE k = 1
  UNION ALL SELECT x.user_id, x.event_id, x.k, x.value, 1.0371 + 0.05317 * coalesce(f.value * f.value, h) + 0.89113 * h FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
 SELECT user_id, event_id, {sql_r('h', 'variance')} FROM f""")
def streaming_variances(spark, sf_dir):
    with filters.state_store(spark):
        out = _finish(spark, filters.stream(_event_stream(spark, sf_dir), "user_id", "event_id", ["value"], filters.variance_filter(1.0371, 0.05317, 0.89113, 100.0)))
    return out.select("user_id", "event_id", r("variance", "variance"))


@query("""WITH RECURSIVE x AS (SELECT user_id, event_id, list_position(['view', 'click', 'purchase'], event_type) - 1 AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('view', 'click', 'purchase')),
 f AS (SELECT user_id, event_id, k, now, false AS changed, false AS fires, -999::BIGINT AS fired_at FROM x WHERE k = 1
  UNION ALL SELECT x.user_id, x.event_id, x.k, x.now, x.now <> f.now, x.now <> f.now AND x.k - fired_at >= 6, CASE WHEN x.now <> f.now AND x.k - fired_at >= 6 THEN x.k ELSE fired_at END FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1)
 SELECT user_id, event_id, now AS dominant, changed, fires FROM f""")
def streaming_regime_refits(spark, sf_dir):
    kinds = ["view", "click", "purchase"]
    e = _event_stream(spark, sf_dir).where(F.col("event_type").isin(kinds)).select("user_id", "event_id", *((F.col("event_type") == k).cast("double").alias(k) for k in kinds))
    with filters.state_store(spark):
        return _finish(spark, filters.stream(e, "user_id", "event_id", kinds, filters.cooldown_filter()))
