"""Risk measures over long return panels (key or asset, at, value)."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series, statistics


#: Ranks on either side of the one sought that the middle class of ``tail`` spans, as a share of a key's rows; ten times the error of the approximate quantiles.
BRACKET = 1e-3


def tail(df: DataFrame, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(key, n, var, es): the loss at the lower order statistic floor((n - 1) alpha), and the mean loss at or beyond it.

    Two approximate quantiles cut a key's values into three classes, whose exact counts tell in
    which of them the order statistic lies; only the distinct values of that class are ranked. So no task holds
    a key's rows, and the result does not depend on how good the quantiles are. A few numbers for each key are broadcast.
    """
    known = df.select(F.col(key).alias("_key"), F.col(value).alias("_v")).where("_v is not null")  # other columns may be named as the results are
    shares = F.array(*(F.lit(min(max(x, 0.0), 1.0)) for x in (alpha - BRACKET, alpha + BRACKET)))
    cuts = known.groupBy("_key").agg(F.count("*").alias("n"), F.percentile_approx("_v", shares, round(10 / BRACKET)).alias("_cuts"))
    cuts = cuts.withColumn("_at", F.floor((F.col("n") - 1) * alpha) + 1)
    rows = known.join(F.broadcast(cuts), "_key").withColumn("_class", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    counts = rows.groupBy("_key", "_class").agg(F.count("*").alias("_in"), F.first("n").alias("n"), F.first("_at").alias("_at"))
    below = F.sum("_in").over(Window.partitionBy("_key").orderBy("_class")) - F.col("_in")  # three rows a key
    sought = counts.withColumn("_at", F.col("_at") - below).where((F.col("_at") > 0) & (F.col("_at") <= F.col("_in"))).select("_key", "_class", "_at", "n")
    inside = rows.select("_key", "_class", "_v").join(F.broadcast(sought), ["_key", "_class"]).groupBy("_key", "_at", "n", "_v").agg(F.count("*").alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy("_key").orderBy("_v"))
    edge = inside.withColumn("_upto", upto).where("_upto >= _at and _upto - _in < _at").select("_key", "n", F.col("_v").alias("_q"))
    found = known.join(F.broadcast(edge), "_key").where("_v <= _q").groupBy("_key").agg(F.first("n").alias("n"), (-F.first("_q")).alias("var"), (-F.avg("_v")).alias("es"))
    return found.withColumnRenamed("_key", key)


def parametric_var(mu: Column, sigma: Column, alpha: float = 0.05) -> Column:
    return -(mu + sigma * NormalDist().inv_cdf(alpha))


def parametric_es(mu: Column, sigma: Column, alpha: float = 0.05) -> Column:
    n = NormalDist()
    return -mu + sigma * (n.pdf(n.inv_cdf(alpha)) / alpha)


def cornish_fisher_var(df: DataFrame, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(key, var): the normal quantile adjusted by skewness and excess kurtosis, both over the deviation with n - 1."""
    z = NormalDist().inv_cdf(alpha)
    m = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"), F.stddev_pop(value).alias("sp"), F.skewness(value).alias("sk"), F.kurtosis(value).alias("ku"))
    ratio = F.col("sp") / F.col("sd")
    s, k = F.col("sk") * F.pow(ratio, F.lit(3)), (F.col("ku") + 3) * F.pow(ratio, F.lit(4)) - 3
    adjusted = z + (z**2 - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s * s
    return m.select(key, F.when((F.col("n") > 3) & (F.col("sd") > 0), -(F.col("mu") + F.col("sd") * adjusted)).alias("var"))


def covariance(panel: DataFrame, asset: str, at: str, value: str) -> DataFrame:
    """(i, j, n, cov, corr) of every two assets over the times where both are known, i <= j.

    The self-join is on time, so its size is times x assets squared: the size of the answer before it is summed.
    """
    known = panel.where(F.col(value).isNotNull())
    a = known.select(at, F.col(asset).alias("i"), F.col(value).alias("x"))
    b = known.select(at, F.col(asset).alias("j"), F.col(value).alias("y"))
    both = a.join(b, at).where("i <= j")
    return both.groupBy("i", "j").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov"), statistics.correlation("x", "y").alias("corr"))


def ewma_covariance(panel: DataFrame, asset: str, at: str, value: str, halflife: float = 12.0) -> DataFrame:
    """(i, j, cov): covariance with weights that halve every ``halflife`` times, over times where all assets are known."""
    n = panel.agg(F.countDistinct(asset).alias("_n"))
    full = panel.where(F.col(value).isNotNull()).groupBy(at).agg(F.count("*").alias("_k")).crossJoin(F.broadcast(n)).where("_k = _n").select(at)  # n has one row
    age = F.row_number().over(Window.orderBy(F.col(at).desc())) - 1
    weights = full.withColumn("_w", F.pow(F.lit(0.5), age / halflife))
    total = F.sum("_w").over(Window.partitionBy(F.lit(0)))
    weights = weights.withColumn("_w", F.col("_w") / total)
    rows = panel.join(weights, at)
    mean = rows.groupBy(asset).agg(F.sum(F.col("_w") * F.col(value)).alias("_m"))
    rows = rows.join(mean, asset).select(at, F.col(asset).alias("i"), "_w", (F.col(value) - F.col("_m")).alias("x"))
    other = rows.select(at, F.col("i").alias("j"), F.col("x").alias("y"))
    return rows.join(other, at).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("_w") * F.col("x") * F.col("y")).alias("cov"))


def portfolio_variance(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(variance, sigma) of weights (asset, w) under covariances (i <= j, cov)."""
    wi, wj = weights.select(F.col("asset").alias("i"), F.col("w").alias("wi")), weights.select(F.col("asset").alias("j"), F.col("w").alias("wj"))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    v = cov.join(wi, "i").join(wj, "j").agg(F.sum(twice * F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))
    return v.withColumn("sigma", F.sqrt(F.greatest("variance", F.lit(0.0))))


def component_var(weights: DataFrame, cov: DataFrame, z: float = 1.645) -> DataFrame:
    """(asset, marginal, component, share): each position's part of the portfolio's VaR; the parts add up to it."""
    both = cov.unionByName(cov.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in cov.columns if c not in ("i", "j")]))
    inner = both.join(weights.select(F.col("asset").alias("j"), F.col("w").alias("wj")), "j").groupBy("i").agg(F.sum(F.col("wj") * F.col("cov")).alias("cw"))
    rows = inner.join(weights.select(F.col("asset").alias("i"), "w"), "i")
    sigma = F.sqrt(F.sum(F.col("w") * F.col("cw")).over(Window.partitionBy(F.lit(0))))
    rows = rows.withColumn("marginal", F.when(sigma > 0, z * F.col("cw") / sigma)).withColumn("component", F.col("w") * F.col("marginal"))
    return rows.select(F.col("i").alias("asset"), "marginal", "component", (F.col("component") / (z * sigma)).alias("share"))


def pretrade_gate(weights: DataFrame, cov: DataFrame, var_limit: float, alpha: float = 0.05) -> DataFrame:
    """(var, breach): a VaR at its limit passes."""
    v = portfolio_variance(weights, cov)
    return v.select(parametric_var(F.lit(0.0), F.col("sigma"), alpha).alias("var")).withColumn("breach", F.col("var") > var_limit)


def garch_recursion(e2: np.ndarray, omega: float, alpha: float, beta: float, h0: float) -> np.ndarray:
    h = np.empty(len(e2))
    now = h0
    for k in range(len(e2)):
        h[k] = now
        now = omega + alpha * e2[k] + beta * now
    return h


def fit_garch(returns: np.ndarray, least: int = 24) -> tuple[float, float, float]:
    """(omega, alpha, beta) of a variance-targeted GARCH(1, 1) by a refined grid search of the Gaussian likelihood; (0, .06, .94) on short or constant samples."""
    e2 = (returns - returns.mean()) ** 2 if len(returns) else returns
    target = e2.mean() if len(e2) else 0.0
    if len(e2) < least or target <= 0:
        return 0.0, 0.06, 0.94

    def loss(a: float, b: float) -> float:
        h = np.maximum(garch_recursion(e2, target * (1 - a - b), a, b, target), 1e-18)
        return float(np.sum(np.log(h) + e2 / h))

    best = min((loss(a, p - a), a, p - a) for p in np.linspace(0.5, 0.995, 12) for a in np.linspace(0.01, 0.3, 8) if p > a)
    step = (0.03, 0.03)
    for _ in range(12):
        _, a, b = best
        near = [(x, y) for x in (a - step[0], a, a + step[0]) for y in (b - step[1], b, b + step[1]) if x > 0 and y >= 0 and x + y < 0.999]
        found = min([(loss(x, y), x, y) for x, y in near] + [best])
        if found == best:
            step = (step[0] / 2, step[1] / 2)
        best = found
    _, a, b = best
    return target * (1 - a - b), a, b


def garch(df: DataFrame, key: str, at: str, value: str, parameters: tuple[float, float] | None = None) -> DataFrame:
    """``df`` with the conditional deviation garch_vol, whose first value is the unconditional one, and garch_next, that of the time after the last row.

    With ``parameters`` (alpha, beta) nothing is fitted; the variance is targeted.
    """

    def step(v: pd.Series) -> pd.DataFrame:
        r = v.dropna().to_numpy()
        e2 = (r - r.mean()) ** 2 if len(r) else r
        target = e2.mean() if len(e2) else 0.0
        omega, alpha, beta = fit_garch(r) if parameters is None else (target * (1 - sum(parameters)), *parameters)
        h = garch_recursion(np.append(e2, 0.0), omega, alpha, beta, target)
        out = pd.Series(np.nan, v.index)
        out[v.notna()] = np.sqrt(h[:-1])
        return pd.DataFrame({"garch_vol": out, "garch_next": np.sqrt(h[-1])})

    return series.recursive(df, key, at, value, {"garch_vol": "double", "garch_next": "double"}, step)


#: Grid of (a, b) that ``fit_dcc`` compares.
DCC_GRID = tuple((a, b) for a in (0.01, 0.02, 0.03, 0.05, 0.08, 0.12) for b in (0.6, 0.75, 0.85, 0.9, 0.94, 0.97) if a + b < 0.999)


def standardised(panel: DataFrame, asset: str, at: str, value: str, parameters: tuple[float, float] | None = None) -> DataFrame:
    """(asset, at, s, z, sigma_next): GARCH residuals at the times where every asset is known, numbered from 0 in order of time, and each asset's next deviation; a residual without a deviation is 0."""
    known = panel.where(series.known(value).isNotNull()).select(F.col(asset).alias("asset"), F.col(at).alias("at"), F.col(value).cast("double").alias("x"))
    assets = known.agg(F.countDistinct("asset").alias("_n"))
    times = known.groupBy("at").agg(F.count("*").alias("_k")).crossJoin(F.broadcast(assets)).where("_k = _n")  # one row
    times = times.select("at", (F.row_number().over(Window.orderBy("at")) - 1).alias("s"))  # a dimension: one row for each time
    full = garch(known.join(times, "at"), "asset", "s", "x", parameters)
    mean = F.avg("x").over(Window.partitionBy("asset"))
    z = F.coalesce(series.known((F.col("x") - mean) / F.when(F.col("garch_vol") > 0, F.col("garch_vol"))), F.lit(0.0))
    return full.select("asset", "at", "s", z.alias("z"), F.col("garch_next").alias("sigma_next"))


def _pairs(z: DataFrame) -> DataFrame:
    """(i, j, s, zi, zj), i <= j: times x pairs of assets, the size of what is added up."""
    a, b = z.select("s", F.col("asset").alias("i"), F.col("z").alias("zi")), z.select("s", F.col("asset").alias("j"), F.col("z").alias("zj"))
    return a.join(b, "s").where("i <= j")


def _scaled(pairs: DataFrame, value: str, out: str) -> DataFrame:
    """``pairs`` (i, j) with ``value`` over the roots of its diagonal, whose own are 1."""
    diagonal = pairs.where("i = j").select("i", F.col(value).alias("_d"))
    both = pairs.join(diagonal.withColumnRenamed("_d", "_di"), "i").join(diagonal.select(F.col("i").alias("j"), F.col("_d").alias("_dj")), "j")
    ratio = F.col(value) / F.sqrt(F.greatest("_di", F.lit(1e-300)) * F.greatest("_dj", F.lit(1e-300)))
    return both.withColumn(out, F.when(F.col("i") == F.col("j"), 1.0).otherwise(ratio)).drop("_di", "_dj")


def fit_dcc(z: DataFrame, grid: tuple = DCC_GRID, least: int = 10) -> tuple[float, float] | None:
    """(a, b) of greatest composite likelihood: the Gaussian likelihoods of all pairs, added up; None under ``least`` times or two assets.

    A pair is a group of its own, as long as its history; the driver receives one row for each point of the grid.
    """
    if z.agg(F.countDistinct("s")).first()[0] < least:
        return None

    def likelihoods(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("s")[["zi", "zj"]].to_numpy()
        bar = np.cov(x.T)
        bar = bar / np.sqrt(np.outer(np.maximum(np.diag(bar), 1e-300), np.maximum(np.diag(bar), 1e-300)))
        products = np.stack([x[:, 0] ** 2, x[:, 1] ** 2, x[:, 0] * x[:, 1]])
        target = np.array([1.0, 1.0, bar[0, 1]])
        a, b = np.array(grid).T
        q, total = np.repeat(target[:, None], len(grid), axis=1), np.zeros(len(grid))
        for t in range(len(x)):
            rho = np.clip(q[2] / np.sqrt(np.maximum(q[0] * q[1], 1e-300)), -0.999999, 0.999999)
            left = 1 - rho**2
            total += np.log(left) + (products[0, t] + products[1, t] - 2 * rho * products[2, t]) / left
            q = (1 - a - b) * target[:, None] + a * products[:, t, None] + b * q
        return pd.DataFrame({"a": a, "b": b, "loss": total / 2})

    found = _pairs(z).where("i < j").groupBy("i", "j").applyInPandas(likelihoods, "a double, b double, loss double")
    best = found.groupBy("a", "b").agg(F.sum("loss").alias("loss")).orderBy("loss", "a", "b").first()
    return None if best is None else (best["a"], best["b"])


def dcc_correlation(panel: DataFrame, asset: str, at: str, value: str, a: float | None = 0.03, b: float | None = 0.95, parameters: tuple[float, float] | None = None) -> DataFrame:
    """(i, j, qbar, corr) for i <= j: the conditional correlations of the assets' GARCH residuals for the time after the last.

    The recursion q = (1 - a - b) qbar + a z z' + b q acts on every pair by itself, and from
    q = qbar it adds up to a sum of decayed products, one aggregation by pair; the diagonal is joined back
    to scale it. With a and b None they are fitted by ``fit_dcc``; where that has too little, or a + b is not below 1,
    the correlation is qbar. No asset or time is held in one place; the work is times x pairs.
    """
    z = standardised(panel, asset, at, value, parameters)
    if a is None or b is None:
        a, b = fit_dcc(z) or (-1.0, -1.0)
    return _dcc(z, a, b)


def _dcc(z: DataFrame, a: float, b: float) -> DataFrame:
    sound = a >= 0 and b >= 0 and a + b < 1
    n = z.agg((F.max("s") + 1).alias("_n"))
    pairs = _pairs(z).crossJoin(F.broadcast(n))  # one row
    # the last residual is that of the forecast's own time
    decayed = F.sum(F.when(F.col("s") < F.col("_n") - 1, F.pow(F.lit(b), F.col("_n") - 2 - F.col("s")) * F.col("zi") * F.col("zj")).otherwise(0.0))
    sums = pairs.groupBy("i", "j").agg(F.covar_samp("zi", "zj").alias("c"), decayed.alias("_sum"), F.first("_n").alias("_n"))
    sums = _scaled(sums, "c", "qbar")
    if not sound:
        return sums.select("i", "j", "qbar", F.col("qbar").alias("corr"))
    past = F.pow(F.lit(b), F.col("_n") - 1)
    q = F.col("qbar") * (past + (1 - a - b) * (1 - past) / (1 - b)) + a * F.col("_sum")
    return _scaled(sums.withColumn("q", q), "q", "corr").select("i", "j", "qbar", "corr")


def dcc_garch_covariance(panel: DataFrame, asset: str, at: str, value: str, a: float | None = 0.03, b: float | None = 0.95, parameters: tuple[float, float] | None = None) -> DataFrame:
    """(i, j, cov) for i <= j: the next covariances, made of the assets' next GARCH deviations and their conditional correlations.

    Fewer than three times or two assets, or an asset without a positive next deviation, fall back to ``ewma_covariance``.
    """
    z = standardised(panel, asset, at, value, parameters)
    size = z.agg(F.countDistinct("s").alias("times"), F.countDistinct("asset").alias("assets"), F.min("sigma_next").alias("least")).first()
    if size["times"] < 3 or size["assets"] < 2 or not size["least"] > 0:
        return ewma_covariance(panel, asset, at, value)
    if a is None or b is None:
        a, b = fit_dcc(z) or (-1.0, -1.0)
    sigma = z.groupBy("asset").agg(F.first("sigma_next").alias("sigma"))
    made = _dcc(z, a, b).join(sigma.select(F.col("asset").alias("i"), F.col("sigma").alias("_si")), "i").join(sigma.select(F.col("asset").alias("j"), F.col("sigma").alias("_sj")), "j")
    return made.select("i", "j", (F.col("_si") * F.col("corr") * F.col("_sj")).alias("cov"))
