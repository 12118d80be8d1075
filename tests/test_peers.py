"""Leave-one-out statistics of peers against brute force, in cohorts and over all entities."""

import math

import numpy as np
import pytest

from socspan.operators import peers
from socspan.params import Params


def brute(value, others):
    o = np.array(others, float)
    med, (q25, q75) = np.median(o), np.quantile(o, [0.25, 0.75])
    mad, span = np.median(np.abs(o - med)), o.max() - o.min()
    for spread, k, name in ((mad, 0.6745, "MAD"), (q75 - q25, 0.7413, "IQR"), (span, 1.0, "RANGE")):
        if spread > 0:
            return med, mad, k * (value - med) / spread, name
    return med, mad, 0.0, "SKIP"


def frame(spark, values):
    return spark.createDataFrame([(f"e{i:03d}", m, float(v) if v is not None else None) for m, vs in values.items() for i, v in enumerate(vs)], "entity_id string, metric string, value double")


VALUES = {
    "odd": [5, 1, 1, 9, 3, 3, 3],
    "even": [4, 8, 15, 16, 23, 42],
    "flat": [2, 2, 2, 2],
    "one off": [0, 0, 0, 0, 0, 7],
    "quarter": [0, 0, 0, 5, 5, 0, 0, 9],
    "two": [1, 4],
    "gaps": [1, None, math.nan, 4, math.inf, 6, 9],
    "many": np.random.default_rng(2).integers(0, 40, 201).tolist(),
}


def test_modified_z(spark):
    got = {(r.metric, r.entity_id): r for r in peers.modified_z(frame(spark, VALUES)).collect()}
    for m, vs in VALUES.items():
        for i, v in enumerate(vs):
            others = [x for j, x in enumerate(vs) if j != i and x is not None and math.isfinite(x)]
            r = got[m, f"e{i:03d}"]
            assert r.n_peers == len(others)
            if v is not None and math.isfinite(v):
                med, mad, z, method = brute(v, others)
                assert (r.median, r.mad, r.z) == pytest.approx((med, mad, z)) and r.method == method


def test_lonely_and_empty(spark):
    r = peers.modified_z(frame(spark, {"m": [3]})).first()
    assert (r.n_peers, r.median, r.z, r.method) == (0, None, 0.0, "SKIP")
    assert peers.modified_z(frame(spark, {})).count() == 0


def test_benchmark_in_and_out_of_cohorts(spark):
    rng = np.random.default_rng(6)
    ids = [f"e{i:02d}" for i in range(20)]
    cohort = {e: "big" if i < 8 else "small" if i < 11 else "alone" if i == 11 else None for i, e in enumerate(ids)}
    x = dict(zip(ids, rng.integers(0, 9, 20).tolist(), strict=True))
    features = spark.createDataFrame([(e, float(v)) for e, v in x.items()], "entity_id string, m double")
    registry = spark.createDataFrame([(e, c) for e, c in cohort.items() if e != "e19"], "entity_id string, cohort_id string")
    got = {r.entity_id: r for r in peers.benchmark(features, registry, ["m"], Params()).collect()}
    for e in ids:
        c = cohort[e] or "GLOBAL"
        near = [x[o] for o in ids if o != e and (cohort[o] or "GLOBAL") == c]
        used = near if len(near) >= 5 else [x[o] for o in ids if o != e]
        med, _, z, method = brute(x[e], used)
        r = got[e]
        assert (r.cohort_n, r.fell_back, r.method) == (len(near), len(near) < 5, method)
        assert (r.median, r.z, r.percentile_rank) == pytest.approx((med, z, np.mean(np.array(used) < x[e])))
        assert r.penalty == (0.0 if len(near) >= 5 else 0.4 if len(near) <= 1 else 0.2)
    assert {r.fell_back for r in got.values()} == {True, False}
