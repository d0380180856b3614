"""Feature selection by shadows and by stability over subsamples, its history, and models of trees.

Work is dealt as groups (instrument, iteration), (instrument, subsample) or
(instrument, fold, setting): a group holds one instrument's history, sorted by
time before anything random is drawn from a seed made of the instrument and
the number, so results do not depend on the partitioning.
"""

from __future__ import annotations

import zlib
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trees
from . import joins
from .intelligence import elastic_net

#: Snapshots that a history keeps.
MOST_SNAPSHOTS = 52
#: Weights of the three parts of a composite score.
WEIGHTS = (0.4, 0.3, 0.3)


def _seed(key, number: int) -> int:
    return zlib.crc32(f"{key}:{number}".encode())


def _complete(part: pd.DataFrame, at: str, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and target of the complete rows in order of time."""
    part = part.sort_values(at, kind="stable")
    x, y = part[features].to_numpy(float), part[target].to_numpy(float)
    fine = np.isfinite(x).all(axis=1) & np.isfinite(y)
    return x[fine], y[fine]


def _dealt(df: DataFrame, key: str, at: str, columns: list[str], number: str, n: int) -> DataFrame:
    """The rows once for each of ``n`` numbers."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(number)
    return df.select(key, at, *columns, numbers)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _shadow(x: np.ndarray, y: np.ndarray, seed: int, size: int, depth: int) -> tuple[np.ndarray, float]:
    """Importances of the features beside permuted copies of all of them, and the greatest of the copies'."""
    draw = np.random.default_rng(seed)
    shadows = np.column_stack([draw.permutation(x[:, k]) for k in range(x.shape[1])])
    model = trees.forest(np.column_stack([x, shadows]), y, seed, size, depth, max(5, len(y) // 50))
    found = trees.importances(model, 2 * x.shape[1])
    return found[: x.shape[1]], float(found[x.shape[1] :].max())


def shadow_hits(df: DataFrame, key: str, at: str, features: list[str], target: str, iterations: int = 50, size: int = 200, depth: int = 5, least: int = 24) -> DataFrame:
    """(key, iteration, feature, importance, shadow, hit): whether a feature matters more to a forest than the best permuted copy of any. A key under ``least`` complete rows has none."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        name, k = part[key].iloc[0], int(part["iteration"].iloc[0])
        x, y = _complete(part, at, features, target)
        if len(y) < least:
            return pd.DataFrame(columns=[key, "iteration", "feature", "importance", "shadow", "hit"])
        own, shadow = _shadow(x, y, _seed(name, k), size, depth)
        return pd.DataFrame({key: name, "iteration": k, "feature": features, "importance": own, "shadow": shadow, "hit": own > shadow})

    schema = f"`{key}` {_kind(df, key)}, iteration int, feature string, importance double, shadow double, hit boolean"
    return _dealt(df, key, at, [*features, target], "iteration", iterations).groupBy(key, "iteration").applyInPandas(run, schema)


def binomial_quantile(q: float, n: int, p: float = 0.5) -> int:
    """The least k of which a binomial of n has probability ``q`` or more at or below."""
    total = 0.0
    for k in range(n + 1):
        total += comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= q - 1e-12:
            return k
    return n


def shadow_classes(hits: DataFrame, key: str, alpha: float = 0.05, most: int = 200) -> DataFrame:
    """(key, feature, iterations, hit_rate, importance, shadow, class): confirmed, rejected or tentative by the binomial bounds of as many fair tosses as there are iterations (up to ``most``)."""
    g = hits.groupBy(key, "feature").agg(F.count("*").cast("int").alias("iterations"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("importance").alias("importance"), F.avg("shadow").alias("shadow"))
    bound = lambda q: F.get(F.array(*(F.lit(binomial_quantile(q, n) / max(n, 1)) for n in range(most + 1))), F.col("iterations"))
    kind = F.when(F.col("hit_rate") >= bound(1 - alpha), "confirmed").when(F.col("hit_rate") <= bound(alpha), "rejected").otherwise("tentative")
    return g.withColumn("class", kind)


def interactions(df: DataFrame, key: str, pairs: list[tuple[str, str, str]]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column IX_name for each pair (a, b, name) whose columns are there: the product of both, standardised over the key; and their names."""
    w = Window.partitionBy(key)
    std = lambda c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + 1e-10)
    there = [(a, b, f"IX_{name}") for a, b, name in pairs if a in df.columns and b in df.columns]
    return df.withColumns({name: std(a) * std(b) for a, b, name in there}), [name for *_, name in there]


def validated_interactions(df: DataFrame, key: str, at: str, pairs: list[tuple[str, str, str]], target: str, iterations: int = 30, size: int = 200, depth: int = 5) -> DataFrame:
    """(key, feature, hit_rate, confirmed) of the interactions among themselves: those that beat the shadows in over half the iterations."""
    wide, names = interactions(df, key, pairs)
    if not names:
        return df.select(key, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("hit_rate"), F.lit(None).cast("boolean").alias("confirmed")).where("false")
    hits = shadow_hits(wide, key, at, names, target, iterations, size, depth)
    return hits.groupBy(key, "feature").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate")).withColumn("confirmed", F.col("hit_rate") > 0.5)


def _clipped(v: np.ndarray) -> np.ndarray:
    return np.clip(v, *np.quantile(v, [0.05, 0.95], axis=0)) if len(v) >= 10 else v


def elastic_net_cv(x: np.ndarray, y: np.ndarray, alphas: int = 8, ratios: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9, 1.0), folds: int = 3) -> tuple[np.ndarray, float, float]:
    """Coefficients on standardised columns, with the penalty and its ratio of the least squared error over contiguous folds."""
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    v = y - y.mean()
    top = max(np.abs(z.T @ v).max() / len(v), 1e-12)
    parts = np.array_split(np.arange(len(v)), folds)
    best = (np.inf, top, ratios[0])
    for ratio in ratios:
        for alpha in np.geomspace(top / ratio, 1e-3 * top / ratio, alphas):
            error = 0.0
            for part in parts:
                rest = np.setdiff1d(np.arange(len(v)), part)
                b = elastic_net(z[rest], v[rest], alpha, ratio, 100)
                error += float(((v[part] - v[rest].mean() - (z[part] - z[rest].mean(axis=0)) @ b) ** 2).sum())
            if error < best[0] - 1e-12:
                best = (error, float(alpha), ratio)
    return elastic_net(z, v, best[1], best[2]), best[1], best[2]


def subsample_scores(df: DataFrame, key: str, at: str, features: list[str], target: str, subsamples: int = 100, share: float = 0.8, fast: int = 10, size: int = 100, depth: int = 5, least: int = 24) -> DataFrame:
    """(key, subsample, feature, net, shadow, importance): of each drawn subsample (without replacement, clipped to its own quantiles) whether the elastic net and the shadows select a feature, and what it matters to a forest."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        name, k = part[key].iloc[0], int(part["subsample"].iloc[0])
        x, y = _complete(part, at, features, target)
        if len(y) < least:
            return pd.DataFrame(columns=[key, "subsample", "feature", "net", "shadow", "importance"])
        draw = np.random.default_rng(_seed(name, k))
        own = np.sort(draw.permutation(len(y))[: int(len(y) * share)])
        x, y = _clipped(x[own]), _clipped(y[own])
        net = np.abs(elastic_net_cv(x, y)[0]) > 1e-8
        hits = np.zeros(len(features))
        for n in range(fast):
            found, shadow = _shadow(x, y, _seed(name, 1_000_003 * (k + 1) + n), size, depth)
            hits += found > shadow
        model = trees.forest(x, y, _seed(name, -1 - k), size, depth, max(5, len(y) // 50))
        return pd.DataFrame({key: name, "subsample": k, "feature": features, "net": net, "shadow": hits > fast / 2, "importance": trees.importances(model, len(features))})

    schema = f"`{key}` {_kind(df, key)}, subsample int, feature string, net boolean, shadow boolean, importance double"
    return _dealt(df, key, at, [*features, target], "subsample", subsamples).groupBy(key, "subsample").applyInPandas(run, schema)


def stability_classes(scores: DataFrame, key: str) -> DataFrame:
    """(key, feature, subsamples, net, shadow, importance, score, robust_from, moderate_from, class) from subsample scores.

    The score weighs both selection shares and the mean importance over the greatest of the key. From its 75th percentile on
    a feature is robust, from the 40th on moderate, else unstable; where these lie closer than 0.05, the 70th and 35th count.
    """
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    g = scores.groupBy(key, "feature").agg(F.count("*").alias("subsamples"), mean("net"), mean("shadow"), mean("importance"))
    top = F.max("importance").over(Window.partitionBy(key))
    g = g.withColumn("importance", F.when(top > 0, F.col("importance") / top).otherwise(F.col("importance")))
    return classified(g.withColumn("score", WEIGHTS[0] * F.col("net") + WEIGHTS[1] * F.col("shadow") + WEIGHTS[2] * F.col("importance")), key, "score")


def classified(df: DataFrame, key: str | list[str], score: str) -> DataFrame:
    """``df`` with robust_from, moderate_from and class of each score among those of its key."""
    keys = [key] if isinstance(key, str) else key
    at = df.groupBy(*keys).agg(F.percentile(score, F.array(*map(F.lit, (0.75, 0.4, 0.7, 0.35)))).alias("_p"))
    close = F.get("_p", F.lit(0)) - F.get("_p", F.lit(1)) < 0.05
    pick = lambda near, far: F.when(close, F.get("_p", F.lit(near))).otherwise(F.get("_p", F.lit(far)))
    out = df.join(at, keys).withColumns({"robust_from": pick(2, 0), "moderate_from": pick(3, 1)}).drop("_p")
    return out.withColumn("class", F.when(F.col(score) >= F.col("robust_from"), "robust").when(F.col(score) >= F.col("moderate_from"), "moderate").otherwise("unstable"))


def save_snapshot(history: DataFrame, snapshot: DataFrame, most: int = MOST_SNAPSHOTS) -> DataFrame:
    """``history`` (date, ...) with ``snapshot`` in place of the rows of its dates, and of all dates the ``most`` last."""
    whole = joins.upsert(history, snapshot.select(*history.columns), ["date"])
    return whole.join(_last_dates(whole, most), "date", "left_semi")


def _last_dates(history: DataFrame, most: int) -> DataFrame:
    return F.broadcast(history.select("date").distinct().orderBy(F.desc("date")).limit(most))  # at most ``most`` rows


def class_transitions(history: DataFrame) -> DataFrame:
    """(date, instrument, feature, before, class, severity) of the features whose class fell from robust (critical to unstable, warning to moderate) or rose from unstable to robust (info), between every two snapshots of an instrument.

    ``history`` has (date, instrument, feature, class); a feature that the snapshot before lacks has no transition.
    """
    dates = history.select("instrument", "date").distinct()
    dates = dates.withColumn("_before", F.lag("date").over(Window.partitionBy("instrument").orderBy("date"))).where("_before is not null")
    now = history.select("instrument", "date", "feature", "class").join(dates, ["instrument", "date"])
    past = history.select("instrument", F.col("date").alias("_before"), "feature", F.col("class").alias("before"))
    both = now.join(past, ["instrument", "_before", "feature"])
    fell = F.col("before") == "robust"
    severity = F.when(fell & (F.col("class") == "unstable"), "critical").when(fell & (F.col("class") == "moderate"), "warning").when((F.col("before") == "unstable") & (F.col("class") == "robust"), "info")
    return both.withColumn("severity", severity).where("severity is not null").select("date", "instrument", "feature", "before", "class", "severity")


def persistence(history: DataFrame) -> DataFrame:
    """(instrument, feature, share): of the snapshots in which an instrument selected anything, the share that selected the feature. ``history`` has (date, instrument, feature, selected)."""
    chosen = history.where("selected").select("instrument", "date", "feature").distinct()
    all_of = chosen.groupBy("instrument").agg(F.countDistinct("date").alias("_n"))
    return chosen.groupBy("instrument", "feature").agg(F.count("*").alias("_k")).join(all_of, "instrument").select("instrument", "feature", (F.col("_k") / F.col("_n")).alias("share"))


def rolling_scores(history: DataFrame, snapshots: int = 12) -> DataFrame:
    """(instrument, feature, date, score, class) over the last ``snapshots`` dates: every feature an instrument had there, at every one of them; where it was missing its score is 0 and its class unknown."""
    dates = _last_dates(history, snapshots)
    recent = history.join(dates, "date", "left_semi")
    every = recent.select("instrument", "feature").distinct().crossJoin(dates)
    found = every.join(recent.select("instrument", "feature", "date", "score", "class"), ["instrument", "feature", "date"], "left")
    return found.select("instrument", "feature", "date", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("class", F.lit("unknown")).alias("class"))


def class_counts(history: DataFrame) -> DataFrame:
    """(instrument, date, robust, moderate, unstable, pct_robust)."""
    g = history.groupBy("instrument", "date").agg(*(F.count_if(F.col("class") == c).alias(c) for c in ("robust", "moderate", "unstable")))
    total = F.col("robust") + F.col("moderate") + F.col("unstable")
    return g.withColumn("pct_robust", F.when(total > 0, F.col("robust") / total * 100).otherwise(0.0))


# models: (name, parameters); a setting is one of these

RIDGE = tuple(("ridge", {"alpha": a}) for a in (1.0, 5.0, 10.0, 20.0, 50.0))
BOOSTED = tuple(("boosted", dict(trees=n, depth=d, rate=r, share=s)) for n, d, r, s in ((50, 2, 0.05, 0.8), (100, 3, 0.05, 0.8), (100, 2, 0.03, 0.8), (150, 3, 0.03, 0.7)))
FOREST = tuple(("forest", dict(trees=n, depth=d, least=m)) for n, d, m in ((100, 3, 5), (200, 4, 5), (200, 3, 3), (300, 5, 5)))
PENALISED = tuple(("penalised", dict(trees=n, depth=d, rate=r, share=s, columns=c, least=m, l1=0.1, l2=1.0)) for n, d, r, s, c, m in ((50, 2, 0.05, 0.8, 0.8, 5), (100, 3, 0.05, 0.8, 0.8, 5), (100, 2, 0.03, 0.7, 0.7, 3), (150, 3, 0.03, 0.8, 0.8, 5)))
SETTINGS = RIDGE + BOOSTED + FOREST + PENALISED
#: The setting of each model that counts where no fold could be scored.
USUAL = {"ridge": RIDGE[2], "boosted": BOOSTED[1], "forest": FOREST[1], "penalised": PENALISED[1]}


def fitted(model: str, parameters: dict, x: np.ndarray, y: np.ndarray, seed: int):
    """A function from rows to predictions."""
    if model == "ridge":
        m = x.mean(axis=0)
        b = np.linalg.solve((x - m).T @ (x - m) + parameters["alpha"] * np.eye(x.shape[1]), (x - m).T @ (y - y.mean()))
        return lambda rows: y.mean() + (rows - m) @ b
    made = trees.forest(x, y, seed, **parameters) if model == "forest" else trees.boosted(x, y, seed, **parameters)
    return lambda rows: trees.predicted(made, rows)


def purged_scores(df: DataFrame, key: str, at: str, features: list[str], target: str, settings: tuple = SETTINGS, folds: int = 5, gap: int = 3) -> DataFrame:
    """(key, setting, model, fold, n_train, n_test, r2): out-of-sample R2 on contiguous folds in order of time, trained on the rows before the fold less the last ``gap``.

    A fold of fewer than 12 rows of history, 24 training rows or 6 test rows is left out.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        name, number = part[key].iloc[0], int(part["_group"].iloc[0])
        fold, setting = divmod(number, len(settings))
        x, y = _complete(part, at, features, target)
        size = len(y) // folds
        start, end = fold * size, min((fold + 1) * size, len(y))
        train = max(0, start - gap)
        columns = [key, "setting", "model", "fold", "n_train", "n_test", "r2"]
        if size < 12 or train < 24 or end - start < 6:
            return pd.DataFrame(columns=columns)
        model, parameters = settings[setting]
        off = y[start:end] - fitted(model, parameters, x[:train], y[:train], _seed(name, fold))(x[start:end])
        spread = float(((y[start:end] - y[start:end].mean()) ** 2).sum())
        return pd.DataFrame([(name, setting, model, fold, train, end - start, 1 - float((off**2).sum()) / spread if spread > 0 else 0.0)], columns=columns)

    schema = f"`{key}` {_kind(df, key)}, setting int, model string, fold int, n_train int, n_test int, r2 double"
    return _dealt(df, key, at, [*features, target], "_group", folds * len(settings)).groupBy(key, "_group").applyInPandas(run, schema)


def best_settings(scores: DataFrame, key: str) -> DataFrame:
    """(key, model, setting, r2): of each model the setting of the greatest mean R2; of equal ones the first."""
    mean = scores.groupBy(key, "model", "setting").agg(F.avg("r2").alias("r2"))
    best = mean.groupBy(key, "model").agg(F.max_by(F.struct("setting", "r2"), F.struct("r2", -F.col("setting"))).alias("_b"))
    return best.select(key, "model", "_b.setting", "_b.r2")


def forecasts(df: DataFrame, key: str, at: str, features: list[str], target: str, best: DataFrame | None = None, settings: tuple = SETTINGS, window: int | None = None, least: int = 36) -> DataFrame:
    """(key, model, at, prediction): each model's prediction for a key's last row from its complete rows before (the ``window`` last), features it lacks taken as 0.

    The last row's target counts as unknown. ``best`` (key, model, setting) names settings; without it, and for a model it
    lacks, the usual one counts. A key under ``least`` complete rows has none; a model that cannot be fitted predicts 0.
    """
    models = list(USUAL)
    dealt = _dealt(df, key, at, [*features, target], "_model", len(models)).withColumn("model", F.get(F.array(*map(F.lit, models)), F.col("_model")))
    dealt = dealt.withColumn("setting", F.lit(None).cast("int")) if best is None else dealt.join(best.select(key, "model", "setting"), [key, "model"], "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable")
        name, model, setting = part[key].iloc[0], part["model"].iloc[0], part["setting"].iloc[0]
        past, last = part.iloc[:-1], part.iloc[-1:]
        x, y = _complete(past, at, features, target)
        if window:
            x, y = x[-window:], y[-window:]
        if len(y) < least:
            return pd.DataFrame(columns=[key, "model", at, "prediction"])
        parameters = (USUAL[model] if pd.isna(setting) else settings[int(setting)])[1]
        now = np.nan_to_num(last[features].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
        try:
            found = float(fitted(model, parameters, _clipped(x), _clipped(y), _seed(name, 0))(now)[0])
        except np.linalg.LinAlgError:
            found = 0.0
        return pd.DataFrame([(name, model, last[at].iloc[0], found)], columns=[key, "model", at, "prediction"])

    schema = f"`{key}` {_kind(df, key)}, model string, `{at}` {_kind(df, at)}, prediction double"
    return dealt.groupBy(key, "model").applyInPandas(run, schema)


def ensemble_forecast(predictions: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, prediction): the weighted sum over the models (key, model, prediction) and (key, model, weight); a model without a weight gets a quarter."""
    both = predictions.join(weights.select(key, "model", "weight"), [key, "model"], "left")
    return both.groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(1 / len(USUAL))) * F.col("prediction")).alias("prediction"))


def tree_attributions(df: DataFrame, key: str, at: str, features: list[str], target: str, parameters: dict | None = None, window: int | None = None, least: int = 36) -> DataFrame:
    """(key, feature, mean_abs, current, rank): the Shapley values of the features in boosted trees fitted to a key's complete rows, their mean size and those of the last row with all features; ranks by size, equal ones by name."""
    parameters = parameters or dict(trees=100, depth=3, rate=0.05, share=0.8, columns=0.8)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y = _complete(part, at, features, target)
        if window:
            x, y = x[-window:], y[-window:]
        if len(y) < least:
            return pd.DataFrame(columns=[key, "feature", "mean_abs", "current"])
        model = trees.boosted(x, y, _seed(part[key].iloc[0], 0), **parameters)
        shown = part.sort_values(at, kind="stable")[features].to_numpy(float)
        shown = shown[np.isfinite(shown).all(axis=1)][-1:]
        _, values = trees.attributions(model, np.concatenate([x, shown]))
        return pd.DataFrame({key: part[key].iloc[0], "feature": features, "mean_abs": np.abs(values[:-1]).mean(axis=0), "current": values[-1]})

    made = df.select(key, at, *features, target).groupBy(key).applyInPandas(run, f"`{key}` {_kind(df, key)}, feature string, mean_abs double, current double")
    return made.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("mean_abs"), "feature")))
