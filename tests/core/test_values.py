"""Queries without SQL whose rows are plain functions of their input, worked out again row by row."""

import math

import numpy as np
import pytest
from conftest import DATA

from spliceflow.plans.domain import view
from spliceflow.plans.registry import QUERIES


def upper(x):
    return math.erfc(x / math.sqrt(2)) / 2


def moments(spark):
    from spliceflow.plans.calibration import scored

    return {r.event_id: (r.dpsi, r.sd) for r in scored(spark, DATA).collect()}


def test_detection_p_is_the_normal_tail(spark):
    known = moments(spark)
    got = {r.event_id: r.p for r in QUERIES["detection_p"](spark, DATA).collect()}
    assert set(got) == set(known) and len(got) > 50
    for event, (mean, sd) in known.items():
        assert got[event] == pytest.approx(2 * upper(abs(mean) / sd), abs=1e-9)


def test_large_change_probability_is_two_normal_tails(spark):
    known = moments(spark)
    got = {r.event_id: r.p for r in QUERIES["large_change_probability"](spark, DATA).collect()}
    assert set(got) == set(known)
    for event, (mean, sd) in known.items():
        assert got[event] == pytest.approx(upper((0.1 - mean) / sd) + upper((0.1 + mean) / sd), abs=1e-6)


def test_beta_interval_holds_its_share(spark):
    """The share of Beta(a, b) below each end, by adding up its density on a fine grid."""
    counts = {r.event_id: (r.inc1, r.exc1) for r in view(spark, DATA, "ev").select("event_id", "inc1", "exc1").collect()}
    got = {r.event_id: (r.ci_low, r.ci_high) for r in QUERIES["beta_ci"](spark, DATA).collect()}
    assert set(got) == set(counts)
    grid = (np.arange(200_000) + 0.5) / 200_000
    some = sorted(counts)[::7]
    for event in some:
        inc, exc = counts[event]
        if inc + exc == 0:
            assert got[event] == (0.0, 1.0)
            continue
        log = inc * np.log(grid) + exc * np.log1p(-grid)
        mass = np.concatenate(([0], np.cumsum(np.exp(log - log.max()))))
        below = np.interp(got[event], np.arange(200_001) / 200_000, mass / mass[-1])
        assert below == pytest.approx([0.025, 0.975], abs=1e-4)
