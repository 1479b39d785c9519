"""Adjusted p values and fronts from buckets, against plain loops."""

import random

from spliceflow.operators import metrics


def test_holm_steps_down_over_any_number_of_tests(spark):
    rng = random.Random(3)
    p = [None, None, 0.0, 1.0, 1e-300] + [rng.choice([0.01, 0.02, 0.5, rng.random(), rng.random() ** 9]) for _ in range(400)]
    known = sorted(x for x in p if x is not None)
    want, most = {None: None}, 0.0
    for at, x in enumerate(known):
        most = max(most, min(1.0, (len(known) - at) * x))
        want.setdefault(x, most)
    got = metrics.holm(spark.createDataFrame(list(enumerate(p)), "id int, p double").repartition(3)).collect()
    assert [r.id for r in sorted(got)] == list(range(len(p)))
    assert all(r.p_holm == want[r.p] for r in got)
    assert metrics.holm(spark.createDataFrame([], "p double")).count() == 0


def test_pareto_front_is_what_no_point_beats(spark):
    rng = random.Random(4)
    points = [(i, rng.choice([None, -2.5, float(rng.randint(-9, 9)), rng.gauss(0, 4)]), rng.choice([None, 3.0, float(rng.randint(-9, 9)), rng.gauss(0, 4)])) for i in range(300)]
    points += [(300, 8.5, 8.5), (301, 8.5, 8.5)]
    full = [(i, x, y) for i, x, y in points if x is not None and y is not None]
    want = {i for i, x, y in full if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in full)}
    assert {r.id for r in metrics.pareto_front(spark.createDataFrame(points, "id int, x double, y double").repartition(3), "x", "y").collect()} == want
    assert metrics.pareto_front(spark.createDataFrame([], "x double, y double"), "x", "y").count() == 0
