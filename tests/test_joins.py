"""Interval joins, walks without growing plans, and selection by counts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tremor.operators import intervals, select, traverse


def spans(rng, n, most):
    out = []
    for i in range(n):
        low = rng.randrange(most)
        out.append((rng.choice("ab"), i, low, low + rng.choice([-1, 0, 1, 5, 40, 900])))
    return out


def test_points_and_overlaps_match_loops(spark):
    rng = random.Random(1)
    left, right = spans(rng, 60, 1000), spans(rng, 80, 1000)
    points = [(rng.choice("abc"), i, rng.choice([rng.randrange(1100), None])) for i in range(90)] + [("a", 0, 5), (None, 1, 5)]
    lf = spark.createDataFrame([*left, ("a", 900, None, 4), (None, 901, 1, 4)], "g string, i int, low int, high int")
    rf = spark.createDataFrame(right, "g string, j int, start int, end int")
    pf = spark.createDataFrame(points, "g string, k int, at int")
    got = intervals.points_in_intervals(pf, lf, "g", "at", "low", "high")
    want = sorted((g, k, i) for g, k, p in points for h, i, a, b in left if g == h and p is not None and a <= p <= b)
    assert sorted((r.g, r.k, r.i) for r in got.collect()) == want
    pairs = intervals.overlapping_pairs(lf, rf, "g", ("low", "high"), ("start", "end"))
    want = sorted((i, j) for g, i, a, b in left for h, j, c, d in right if g == h and a <= b and c <= d and a <= d and c <= b)
    assert sorted((r.i, r.j) for r in pairs.collect()) == want
    assert intervals.overlapping_pairs(lf.limit(0), rf, "g", ("low", "high"), ("start", "end")).count() == 0


def test_what_meets_is_about_what_matches(spark):
    """One file of 100,000 symbols: rows of the join before its test within twice the result."""
    rng = random.Random(2)
    symbols = spark.range(100_000).select(F.lit("f").alias("g"), F.col("id").alias("i"), (F.col("id") * 7 % 500_000).alias("low")).withColumn("high", F.col("low") + F.col("i") % 90)
    points = spark.createDataFrame([("f", rng.randrange(500_000)) for _ in range(300)], "g string, at long")
    result = intervals.points_in_intervals(points, symbols, "g", "at", "low", "high").count()
    # the same join with its test left out
    good = symbols.withColumn("_shift", intervals._shift(F.col("high") - F.col("low") + 1))
    near = good.withColumn("_block", F.explode(F.sequence(intervals._block(F.col("low"), F.col("_shift")), intervals._block(F.col("high"), F.col("_shift")))))
    asked = points.join(good.select("g", "_shift").distinct(), "g").withColumn("_block", intervals._block(F.col("at"), F.col("_shift")))
    met = asked.join(near, ["g", "_shift", "_block"]).count()
    assert 0 < result <= met <= 2 * result
    assert near.count() <= 5 * 100_000


def test_plans_of_layers_do_not_grow(spark):
    calls = spark.createDataFrame([(i + 1, i, 0.9) for i in range(12)], "src int, dst int, resolution_confidence double")
    seeds = spark.createDataFrame([(0,)], "id int")
    sizes = {}
    for depth in (2, 10):
        found = traverse.best_paths(calls, seeds, depth)
        assert sorted((r.start, r.depth, r.path) for r in found.collect()) == [(d, d, list(range(d, -1, -1))) for d in range(1, depth + 1)]
        sizes[depth] = len(found._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert sizes[2] == sizes[10]
    reached = traverse.reachable_callers(calls, seeds, 50)
    assert sorted((r.node, r.depth) for r in reached.collect()) == [(d, d) for d in range(1, 13)]
    assert traverse.reachable_callers(calls, seeds.limit(0)).collect() == []


@pytest.mark.parametrize("values", [[5], [0, 0, 0], [1, 2], [3, 1, 2], [2**40, 7, 2**62 + 5, 0], list(range(4090, 4105)) * 2])
def test_selection_matches_sorting(spark, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    got = select.values_at(rows, "v", list(range(len(values))))
    assert got == sorted(values)
    s, n = sorted(values), len(values)
    assert select.median_of(rows, "v") == (s[(n - 1) // 2] + s[n // 2]) / 2
    with pytest.raises(ValueError, match="places"):
        select.values_at(rows, "v", [len(values)])


def test_median_of_nothing(spark):
    assert select.median_of(spark.createDataFrame([(None,)], "v long"), "v") is None
