"""Statistical evaluation of return and signal series, one result row for each series.

Inputs are long tables (key, at, value). Null is missing. Moments are
population moments unless said otherwise.
"""

from __future__ import annotations

from itertools import combinations
from math import exp
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EULER = 0.5772156649015329
#: Lags that a Newey-West statistic can use; 4 (n / 100)^(2/9) reaches it at two million rows.
MOST_LAGS = 36


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """The standard normal distribution function. Spark has no error function."""
    n = NormalDist()
    return x.map(lambda v: None if pd.isna(v) else n.cdf(v))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    n = NormalDist()
    return p.map(lambda v: n.inv_cdf(v) if pd.notna(v) and 0 < v < 1 else None)


def moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, sd (n - 1), skew and kurt (not in excess) of each key's known values."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))


def expected_max_sharpe(trials: Column, sr_std: Column) -> Column:
    """The Sharpe ratio that the best of so many worthless trials is expected to show."""
    best = (1 - EULER) * normal_quantile(1 - 1 / trials) + EULER * normal_quantile(1 - exp(-1) / trials)
    return F.when(trials <= 1, 0.0).otherwise(sr_std * best)


def probabilistic_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: Column) -> Column:
    under = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return normal_cdf(F.when((n > 1) & (under > 0), (sr - benchmark) * F.sqrt(n - 1) / F.sqrt(under)))


def sharpe_statistics(df: DataFrame, key: str, value: str, trials: int, sr_std: float | None = None, periods: int = 12, least: int = 6) -> DataFrame:
    """n, sharpe for a period and a year, psr and dsr of each key; null under ``least`` values or without variation.

    Without ``sr_std`` the deviation of Sharpe ratios is the standard error
    of the key's own.
    """
    m = moments(df, key, value).withColumn("sharpe", F.when((F.col("n") >= least) & (F.col("sd") > 0), F.col("mean") / F.col("sd")))
    sr, n, skew, kurt = (F.col(c) for c in ("sharpe", "n", "skew", "kurt"))
    own = F.sqrt(F.greatest((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1), F.lit(0.0)))
    m = m.withColumn("benchmark", expected_max_sharpe(F.lit(float(trials)), own if sr_std is None else F.lit(sr_std)))
    return m.select(key, "n", "sharpe", (sr * F.sqrt(F.lit(float(periods)))).alias("sharpe_annual"), probabilistic_sharpe(sr, n, skew, kurt, F.lit(0.0)).alias("psr"), probabilistic_sharpe(sr, n, skew, kurt, F.col("benchmark")).alias("dsr"))


def newey_west(df: DataFrame, key: str, at: str, value: str, lags: int | None = None) -> DataFrame:
    """(key, n, lags, tstat): the mean over its HAC standard error with Bartlett weights."""
    w = Window.partitionBy(key).orderBy(at)
    whole = Window.partitionBy(key)
    known = df.where(F.col(value).isNotNull()).select(key, at, (F.col(value) - F.avg(value).over(whole)).alias("e"), F.col(value).alias("x"))
    most = MOST_LAGS if lags is None else lags
    products = [F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, most + 1)]
    g = known.select(key, "e", "x", *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, most + 1)))
    g = g.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.sum(F.col("e") * F.col("e")).alias("g0"), *products)
    g = g.withColumn("lags", F.least(F.lit(most), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))) if lags is None else F.lit(lags)).cast("int"))
    total = F.col("g0")
    for k in range(1, most + 1):
        total = total + F.when(F.lit(k) <= F.col("lags"), 2 * (1 - F.lit(k) / (F.col("lags") + 1)) * F.coalesce(f"g{k}", F.lit(0.0))).otherwise(0.0)
    se = F.sqrt(total) / F.col("n")
    return g.select(key, "n", "lags", F.when((F.col("n") > 1) & (total > 0), F.col("mean") / se).alias("tstat"))


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties at their average, among the rows of equal ``by``."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Correlation over a group; null where either side does not vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def information_coefficient(df: DataFrame, key: str, predicted: str, realized: str, method: str = "spearman") -> DataFrame:
    """(key, n, ic): correlation over the rows where both are known; null under 3 rows."""
    both = df.where(F.col(predicted).isNotNull() & F.col(realized).isNotNull()).select(key, F.col(predicted).alias("p"), F.col(realized).alias("r"))
    if method == "spearman":
        both = both.select(key, average_rank("p", key).alias("p"), average_rank("r", key).alias("r"))
    return both.groupBy(key).agg(F.count("*").alias("n"), correlation("p", "r").alias("ic")).select(key, "n", F.when(F.col("n") >= 3, F.col("ic")).alias("ic"))


def residualize(df: DataFrame, key: str, y: str, x: str, name: str) -> DataFrame:
    """``df`` with the residual of y on x and a constant within each key; a constant x only takes the mean away."""
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(y, x).alias("_c"), F.var_pop(x).alias("_v"))
    slope = F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).otherwise(0.0)
    return df.join(fit, key, "left").withColumn(name, F.col(y) - F.col("_my") - slope * (F.col(x) - F.col("_mx"))).drop("_mx", "_my", "_c", "_v")


def carry_neutral_ic(df: DataFrame, key: str, predicted: str, realized: str, carry: str, method: str = "spearman") -> DataFrame:
    """Information coefficient of prediction and outcome, both residualized on carry over complete rows."""
    full = df.dropna(subset=[predicted, realized, carry])
    out = residualize(residualize(full, key, predicted, carry, "_p"), key, realized, carry, "_r")
    return information_coefficient(out, key, "_p", "_r", method)


def half_sample_ic(df: DataFrame, key: str, at: str, predicted: str, realized: str, carry: str, least: int = 24) -> DataFrame:
    """(key, first, second, drop): carry-neutral IC of the earlier and later half; null under ``least`` rows."""
    full = df.dropna(subset=[predicted, realized, carry])
    n = F.count("*").over(Window.partitionBy(key))
    half = full.withColumn("_n", n).withColumn("_late", F.row_number().over(Window.partitionBy(key).orderBy(at)) > F.floor(F.col("_n") / 2)).where(F.col("_n") >= least)
    half = half.withColumn("_part", F.struct(F.col(key).alias("k"), F.col("_late").alias("late")))
    ic = carry_neutral_ic(half, "_part", predicted, realized, carry)
    out = ic.groupBy(F.col("_part.k").alias(key)).agg(F.max(F.when(~F.col("_part.late"), F.col("ic"))).alias("first"), F.max(F.when(F.col("_part.late"), F.col("ic"))).alias("second"))
    return df.select(key).distinct().join(out, key, "left").withColumn("drop", F.col("first") - F.col("second"))


def partial_ic(df: DataFrame, key: str, signal: str, target: str, controls: list[str], least: int = 40) -> DataFrame:
    """(key, n, ic): Pearson correlation of the residuals on several controls.

    Only the cross products of the columns leave the aggregation, so a group
    of any length sends one row.
    """
    names = [signal, target, *controls]
    full = df.dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = full.groupBy(key).agg(F.count("*").alias("n"), *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs))

    def solve(parts):
        for rows in parts:
            out = []
            for r in rows.to_dict("records"):
                c = np.zeros((len(names), len(names)))
                for i, j in pairs:
                    c[i, j] = c[j, i] = r[f"c{i}_{j}"]
                rest = c[:2, :2] - c[:2, 2:] @ np.linalg.pinv(c[2:, 2:]) @ c[2:, :2]
                fine = r["n"] >= least and rest[0, 0] > 1e-18 and rest[1, 1] > 1e-18
                out.append((r[key], r["n"], rest[0, 1] / np.sqrt(rest[0, 0] * rest[1, 1]) if fine else None))
            yield pd.DataFrame(out, columns=[key, "n", "ic"])

    return sums.mapInPandas(solve, f"`{key}` {df.schema[key].dataType.simpleString()}, n long, ic double")


def folds(df: DataFrame, key: str, at: str, n: int, name: str = "fold") -> DataFrame:
    """Contiguous folds from 0 whose sizes differ by one at most, the longer ones first."""
    return df.withColumn(name, F.ntile(n).over(Window.partitionBy(key).orderBy(at)) - 1)


def combinatorial_ic(df: DataFrame, key: str, at: str, predicted: str, realized: str, groups: int = 6, test_groups: int = 2) -> DataFrame:
    """(key, mean, std, least, n): rank IC over all choices of ``test_groups`` of ``groups`` contiguous groups."""
    grouped = folds(df.dropna(subset=[predicted, realized]), key, at, groups, "_group")
    choices = list(combinations(range(groups), test_groups))
    in_choice = F.array(*(F.when(F.col("_group").isin(*c), F.lit(k)) for k, c in enumerate(choices)))
    rows = grouped.withColumn("_choice", F.explode(F.array_compact(in_choice))).withColumn("_part", F.struct(F.col(key).alias("k"), F.col("_choice").alias("c")))
    ic = information_coefficient(rows, "_part", predicted, realized)
    return ic.groupBy(F.col("_part.k").alias(key)).agg(F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("std"), F.min("ic").alias("least"), F.count("ic").alias("n"))


def overfitting_probability(df: DataFrame, trial: str, at: str, value: str, blocks: int = 10) -> DataFrame:
    """(pbo, splits): the share of symmetric splits in which the best trial in sample ranks in the lower half out of sample.

    Rows shrink to (n, sum, sum of squares) for each trial and block of time
    before any split is looked at.
    """
    if blocks % 2:
        raise ValueError("an even number of blocks")
    times = df.select(at).distinct().withColumn("_block", F.ntile(blocks).over(Window.orderBy(at)) - 1)
    sums = df.where(F.col(value).isNotNull()).join(times, at).groupBy(trial, "_block").agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    choices = list(combinations(range(blocks), blocks // 2))
    inside = F.array(*(F.array(*map(F.lit, c)) for c in choices))
    rows = sums.select(trial, "_block", "n", "s", "q", F.posexplode(inside).alias("split", "members")).withColumn("own", F.array_contains("members", F.col("_block")))
    side = rows.groupBy("split", "own", trial).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    side = side.withColumn("sharpe", F.when(var > 0, F.col("s") / F.col("n") / F.sqrt(var)).otherwise(0.0))
    best = side.where("own").groupBy("split").agg(F.max_by(trial, F.struct("sharpe", trial)).alias(trial))
    w = Window.partitionBy("split")
    out = side.where("not own").withColumn("rank", F.rank().over(w.orderBy("sharpe"))).withColumn("trials", F.count("*").over(w))
    share = F.col("rank") / (F.col("trials") + 1)
    return out.join(best, ["split", trial]).agg(F.avg((F.log(share / (1 - share)) <= 0).cast("double")).alias("pbo"), F.count("*").alias("splits"))


def ridge_cpcv(df: DataFrame, at: str, features: list[str], target: str, alpha: float = 1.0, groups: int = 6, test_groups: int = 2) -> DataFrame:
    """(choice, n, ic): out-of-sample rank IC of a ridge refitted for every choice of test groups.

    Each group of time sends its cross products once; a fit adds those of its
    training groups, and predictions are made where the rows lie.
    """
    full = df.dropna(subset=[*features, target]).select(at, *features, target)
    cut = full.select(at).distinct().withColumn("_group", F.ntile(groups).over(Window.orderBy(at)) - 1)
    full = full.join(cut, at)
    names = [*features, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = full.groupBy("_group").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs)).collect()  # one row a group
    choices = list(combinations(range(groups), test_groups))
    fits = []
    for k, test in enumerate(choices):
        train = [r for r in sums if r["_group"] not in test]
        n = sum(r["n"] for r in train)
        mean = np.array([sum(r[f"s{i}"] for r in train) for i in range(len(names))]) / max(n, 1)
        c = np.zeros((len(names), len(names)))
        for i, j in pairs:
            c[i, j] = c[j, i] = sum(r[f"q{i}_{j}"] for r in train) / max(n, 1) - mean[i] * mean[j]
        sd = np.sqrt(np.diag(c)[:-1])
        sd[sd == 0] = 1
        z = c[:-1, :-1] / np.outer(sd, sd)
        beta = np.linalg.solve(z + alpha / max(n, 1) * np.eye(len(features)), c[:-1, -1] / sd) / sd
        fits.append((k, test, mean, beta))
    parts = []
    for k, test, mean, beta in fits:
        guess = F.lit(float(mean[-1]))
        for i, f in enumerate(features):
            guess = guess + float(beta[i]) * (F.col(f) - float(mean[i]))
        parts.append(F.when(F.col("_group").isin(*test), F.struct(F.lit(k).alias("choice"), guess.alias("guess"))))
    rows = full.select(target, F.explode(F.array_compact(F.array(*parts))).alias("_p")).select("_p.*", target)
    return information_coefficient(rows, "choice", "guess", target)


def carry_portfolio(df: DataFrame, at: str, carry: str, realized: str) -> DataFrame:
    """(at, ret): at each time the assets' carries, less their mean and over their gross, earn the outcome."""
    w = Window.partitionBy(at)
    full = df.dropna(subset=[carry, realized]).withColumn("_d", F.col(carry) - F.avg(carry).over(w))
    gross = F.sum(F.abs("_d")).over(w)
    return full.withColumn("_w", F.when(gross > 0, F.col("_d") / gross)).groupBy(at).agg(F.sum(F.col("_w") * F.col(realized)).alias("ret"))


def population_stability(reference: DataFrame, current: DataFrame, value: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """(psi): the population stability index over the quantile bins of the reference."""
    at = [k / bins for k in range(1, bins)]
    edges = reference.agg(F.percentile(value, F.array(*map(F.lit, at))).alias("_edges"))

    def shares(df: DataFrame, name: str) -> DataFrame:
        b = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).select(F.size(F.filter("_edges", lambda e: e < F.col(value))).alias("bin"))  # one row of edges
        n = b.groupBy("bin").agg(F.count("*").alias("n"))
        return n.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))

    every = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = every.join(shares(reference, "p"), "bin", "left").join(shares(current, "q"), "bin", "left")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)) for c in ("p", "q"))
    return both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def stability_by(df: DataFrame, key: str, value: str, current: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """(key, psi): the same for each key, of the rows where ``current`` holds against its others; null for a key that lacks either."""
    known = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), F.coalesce(current, F.lit(False)).alias("_now"))
    at = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    edges = known.where(~F.col("_now")).groupBy(key).agg(F.percentile("_v", at).alias("_edges"))
    counted = known.join(edges, key).groupBy(key, F.size(F.filter("_edges", lambda e: e < F.col("_v"))).alias("bin")).agg(F.count_if(F.col("_now")).alias("q"), F.count_if(~F.col("_now")).alias("p"))
    total = Window.partitionBy(key)
    share = lambda c: F.greatest(F.col(c) / F.nullif(F.sum(c).over(total), F.lit(0)), F.lit(floor))
    shares = counted.select(key, share("p").alias("p"), share("q").alias("q"))
    # bins that neither has differ by nothing
    found = shares.groupBy(key).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("_psi"))
    have = known.groupBy(key).agg(F.bool_or("_now").alias("_both"))
    return have.join(found, key, "left").select(key, F.when(F.col("_both"), F.col("_psi")).alias("psi"))


def sleeve_statistics(df: DataFrame, key: str, at: str, value: str, periods: int = 12) -> DataFrame:
    """(key, n, ann_return, ann_vol, sharpe, max_drawdown, hit_rate) of each return series."""
    w = Window.partitionBy(key).orderBy(at)
    curve = F.product(1 + F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.where(F.col(value).isNotNull()).withColumn("_c", curve)
    rows = rows.withColumn("_d", F.col("_c") / F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = rows.groupBy(key).agg(F.count("*").alias("n"), (F.avg(value) * periods).alias("ann_return"), (F.stddev_samp(value) * periods**0.5).alias("ann_vol"), F.min("_d").alias("max_drawdown"), F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"))
    return out.withColumn("sharpe", F.when(F.col("ann_vol") > 0, F.col("ann_return") / F.col("ann_vol")))
