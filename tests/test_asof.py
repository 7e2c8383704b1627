"""As-of search, interpolation, axis order and runs against plain Python, with one large key."""

import math

import numpy as np
from pyspark.sql import functions as F

from spectrafold.operators import axis as X
from spectrafold.operators.neighborhood import consecutive_runs


def test_counts_at_or_below(spark):
    rows = [([], 1.0), ([2.0], 1.0), ([2.0], 2.0), ([1.0, 1.0, 3.0], 1.0), ([1.0, 2.0, 3.0, 4.0], 9.0), ([0.0] * 5 + [1.0] * 8, 0.5)]
    df = spark.createDataFrame(rows, "v ARRAY<DOUBLE>, t DOUBLE")
    got = [r["n"] for r in df.coalesce(1).select(X.at_or_below(F.col("v"), F.col("t")).alias("n")).collect()]
    assert got == [sum(x <= t for x in v) for v, t in rows]


def test_nearest_channel_with_ties_and_gaps(spark):
    rng = np.random.default_rng(5)
    axes = {"a": [3.0, 1.0, 2.0, 2.0, None, float("nan"), 7.0], "b": rng.uniform(0, 50, 40).round(1).tolist(), "c": [4.0]}
    axis = spark.createDataFrame([(i, c, v) for i, vs in axes.items() for c, v in enumerate(vs)], "image_id STRING, channel INT, value DOUBLE")
    goals = [("a", t) for t in (-1.0, 1.5, 2.0, 2.5, 5.0, 9.0, 2.0)] + [("b", float(t)) for t in rng.uniform(-5, 55, 300)] + [("c", 0.0), ("a", None), ("a", float("nan")), ("d", 1.0)]
    got = X.nearest_channel(spark.createDataFrame([(n, *g) for n, g in enumerate(goals)], "n INT, image_id STRING, target DOUBLE"), axis).collect()
    assert len(got) == len(goals) - 1  # an image without an axis has no row
    for r in got:
        image, t = goals[r["n"]]
        if t is None or math.isnan(t):
            assert r["channel"] is None and r["axis_value"] is None
            continue
        points = [(abs(v - t), c) for c, v in enumerate(axes[image]) if v is not None and not math.isnan(v)]
        assert r["channel"] == min(points)[1] and r["axis_value"] == axes[image][r["channel"]]


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(6)
    curves = {(i, k): (rng.permutation(60)[:n].astype(float), rng.normal(size=n)) for i in "ab" for k, n in enumerate((1, 2, 17, 60))}
    axes = {i: rng.uniform(-10, 70, 33) for i in "ab"}
    rows = [(i, k, float(x), float(v)) for (i, k), (xs, vs) in curves.items() for x, v in zip(xs, vs)] + [("a", 2, None, 1.0)]
    axis = [(i, c, float(t)) for i, ts in axes.items() for c, t in enumerate(ts)] + [("a", 90, None)]
    out = X.interpolate_to_axis(spark.createDataFrame(rows, "image_id STRING, component INT, axis_value DOUBLE, value DOUBLE").repartition(5),
                                spark.createDataFrame(axis, "image_id STRING, channel INT, value DOUBLE"), ["image_id", "component"]).collect()
    assert len(out) == len(curves) * 33
    for r in out:
        xs, vs = curves[r["image_id"], r["component"]]
        order = np.argsort(xs)
        assert abs(r["value"] - np.interp(axes[r["image_id"]][r["channel"]], xs[order], vs[order])) < 1e-12


def test_axis_order_of_one_large_image(spark):
    rng = np.random.default_rng(7)
    rows = [(image, c, float(v)) for image, n in (("a", 900), ("b", 3), (None, 5)) for c, v in enumerate(rng.integers(0, 40, n))]
    got = X.sort_axis(spark.createDataFrame(rows, "image_id STRING, channel INT, value DOUBLE").repartition(6)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["image_id", "channel", "value", "sorted_channel"]
    for image in ("a", "b", None):
        mine = sorted((r["value"], r["channel"], r["sorted_channel"]) for r in got if r["image_id"] == image)
        assert [m[2] for m in mine] == list(range(len(mine)))


def test_runs_that_cross_many_ranges(spark):
    rng = np.random.default_rng(8)
    indices = {"long": set(range(-400, 900)) - {7, 450, 452}, "rare": set(range(0, 300, 3)), "mixed": set(rng.integers(0, 500, 330).tolist()), "one": {5}}
    rows = [(k, int(i)) for k, values in indices.items() for i in values] + [("long", 3), ("one", None), ("none", None)]
    got = consecutive_runs(spark.createDataFrame(rows, "k STRING, i INT").repartition(4), ["k"], "i", partitions=23).collect()
    want = set()
    for k, values in indices.items():
        for first in (i for i in values if i - 1 not in values):
            last = first
            while last + 1 in values:
                last += 1
            want.add((k, first, last, last - first + 1))
    assert len(got) == len(want) and {(r["k"], r["first"], r["last"], r["length"]) for r in got} == want
