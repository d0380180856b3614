"""Instrument returns and features where series are missing, and the misalignment against its regression."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import features


def frame(spark, months=140, **more):
    rng = np.random.default_rng(4)
    x = {"reer": np.exp(rng.normal(size=months) * 0.1 + 4.5), "tot": rng.normal(size=months) + 100, "ibc_br": rng.normal(size=months) + 140, **more}
    rows = [("k", t, *(float(v[t]) if v[t] is not None else None for v in x.values())) for t in range(months)]
    return x, spark.createDataFrame(rows, "key string, t int, " + ", ".join(f"{n} double" for n in x))


def test_what_lacks_its_series_is_not_made(spark):
    _, df = frame(spark)
    assert [c for c in features.instrument_returns(df, "key", "t").columns if c.startswith("ret_")] == []
    made = set(features.features(df, "key", "t").columns) - set(df.columns)
    assert made == {"reer_gap", "Z_reer_gap", "Z_tot", "beer_misalignment", "Z_beer"}
    _, one = frame(spark, ptax=[5.0] * 70 + [None] + [5.5] * 69)
    r = features.instrument_returns(one, "key", "t").orderBy("t").collect()
    assert r[0].ret_fx is None and r[1].ret_fx == 0 and r[70].ret_fx is None and r[71].ret_fx is None and r[72].ret_fx == 0


def test_misalignment_is_beyond_the_regression_of_the_rows_before(spark):
    x, df = frame(spark)
    got = {r.t: r.beer_misalignment for r in features.features(df, "key", "t").collect()}
    y, a = np.log(x["reer"]), np.column_stack([np.ones(140), x["tot"], np.log(x["ibc_br"])])
    assert all(got[t] is None for t in range(60))
    for t in (60, 99, 139):
        b = np.linalg.lstsq(a[t - 60 : t], y[t - 60 : t], rcond=None)[0]
        assert got[t] == pytest.approx(y[t] - a[t] @ b, abs=1e-9)


def test_core_returns_must_be_known(spark):
    df = spark.createDataFrame([("k", 1, 0.1, None), ("k", 2, None, 0.2), ("k", 3, 0.3, 0.4)], "key string, t int, ret_fx double, ret_hard double")
    assert [(r.t, r.ret_fx, r.ret_hard) for r in features.aligned_returns(df, "key", "t").orderBy("t").collect()] == [(1, 0.1, 0.0), (3, 0.3, 0.4)]
    m = features.feature_matrix(spark.createDataFrame([("k", t, 1.0 if t == 1 else None) for t in range(6)], "key string, t int, f double"), "key", "t", ["f"], 2)
    assert sorted((r.t, r.f) for r in m.collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert [(r.key, r.t) for r in features.features_at(m, "key", "t", 2).collect()] == [("k", 2)]
