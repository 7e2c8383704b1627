"""The ways taken when a side is too large or a group too hot give the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectrafold import scale


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({
        "image_id": np.where(rng.random(3000) < 0.5, "hot", rng.integers(0, 9, 3000).astype(str)),
        "y": rng.integers(0, 60, 3000), "x": np.arange(3000), "value": rng.integers(0, 40, 3000) / 4.0,
    })
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(rows, spark, how):
    big, _ = rows
    small = spark.createDataFrame([("hot", 1), ("3", 2), ("none", 3)], "image_id STRING, k INT")
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert key(scale.join_dim(big, small, ["image_id"], how, limit=0)) == key(big.join(small, ["image_id"], how))


def test_running_total(rows):
    df, pdf = rows
    out = scale.running_total(df, ["image_id"], [F.col("value"), F.col("x")], F.lit(1), "n").toPandas()
    want = pdf.sort_values(["value", "x"]).assign(n=lambda d: d.groupby("image_id").cumcount() + 1)
    merged = out.merge(want, on="x")
    assert (merged["n_x"] == merged["n_y"]).all() and len(merged) == 3000


def test_top_n_both_ways(rows):
    df, pdf = rows
    order = [F.desc("value"), F.asc("x")]
    few = scale.top_n(df, ["image_id"], order, 17, 17).toPandas()
    many = scale.top_n(df, ["image_id"], order, 17, 10**9).toPandas()
    want = pdf.sort_values(["value", "x"], ascending=[False, True]).groupby("image_id").head(17)
    assert set(few["x"]) == set(many["x"]) == set(want["x"])
    assert (few.sort_values("x")["rank"].to_numpy() == many.sort_values("x")["rank"].to_numpy()).all()


def test_exact_percentile(rows):
    df, pdf = rows
    out = scale.exact_percentile(df, ["image_id"], "value", [0.0, 0.1, 0.5, 0.995, 1.0], list("abcde")).toPandas().set_index("image_id")
    for key, part in pdf.groupby("image_id"):
        assert np.allclose(out.loc[key], np.percentile(part["value"], [0, 10, 50, 99.5, 100]))


def test_theta_join_large_side(rows, spark):
    df, pdf = rows
    spans = spark.createDataFrame([("hot", 10, 20), ("hot", 15, 30), ("4", 0, 60)], "image_id STRING, a INT, b INT")
    cond = (F.col("y") >= F.col("a")) & (F.col("y") < F.col("b"))
    n = [scale.theta_join(df, spans, ["image_id"], cond, limit=lim).count() for lim in (None, 0)]
    assert n[0] == n[1] > 0


def test_cells_of_nested_columns_are_counted(spark):
    rows = [(i, [([1.0] * 1000, j, "x" * 16) for j in range(5)], {"k": 1.0}, None) for i in range(3)]
    df = spark.createDataFrame(rows, "a INT, b ARRAY<STRUCT<s: ARRAY<DOUBLE>, j: INT, t: STRING>>, c MAP<STRING, DOUBLE>, d ARRAY<ARRAY<DOUBLE>>")
    assert scale.cell_count(df) == 3 * (1 + 5 * (1000 + 1 + 2) + 2 + 1)


def test_line_regions_have_members_and_spectra(spark):
    from spectrafold.operators import rois as R

    px = spark.createDataFrame([("a", 0, y, x, [float(x), 1.0]) for y in range(6) for x in range(6)],
                               "image_id STRING, slice_id INT, y INT, x INT, spectrum ARRAY<DOUBLE>")
    roi = spark.createDataFrame([("a", 0, "LineROI", 1.0, 2.0, 3.0, 0.0, 0.0, 0, False, 1.0, 0.0, 0), ("a", 1, None, 0.0, 0.0, 2.0, 2.0, 0.0, 0, False, 1.0, 0.0, 0)],
                                "image_id STRING, roi_id INT, shape STRING, x0 DOUBLE, y0 DOUBLE, w DOUBLE, h DOUBLE, angle DOUBLE, component INT, background BOOLEAN, scale DOUBLE, offset DOUBLE, smooth_sigma INT")
    hits = R.pixels_in_roi(px, roi).select("roi_id", "y", "x").collect()
    assert sorted((r["y"], r["x"]) for r in hits if r["roi_id"] == 0) == [(2, 1), (2, 2), (2, 3), (2, 4)]
    assert sum(r["roi_id"] == 1 for r in hits) == 4
    mean = {(r["roi_id"], r["channel"]): r["value"] for r in R.roi_mean_spectrum(px, roi, smooth=False).collect()}
    assert mean == {(0, 0): 2.5, (0, 1): 1.0, (1, 0): 0.5, (1, 1): 1.0}


def test_fixed_maps_keep_pixels_of_later_maps(spark):
    from spectrafold.operators.seeds import fixed_w_mean

    rows = [("a", 0, 0, 0, 0, 1.0), ("a", 0, 0, 0, 1, 0.5), ("a", 0, 1, 0, 1, 1.0), ("a", 0, 1, 0, 2, 0.5)]
    maps = spark.createDataFrame(rows, "image_id STRING, component INT, map_id INT, y INT, x INT, w DOUBLE")
    got = {r["x"]: round(r["w"], 6) for r in fixed_w_mean(maps).collect()}
    assert got == {0: 1.0, 1: 0.75, 2: 0.5}


def test_fixed_maps_are_made_once(spark):
    """However many maps there are, they are computed once, and components with fewer maps are not scaled again."""
    from spectrafold.operators.seeds import fixed_w_mean

    rows = [("a", 0, 5, 0, 0, 4.0), ("a", 0, 5, 0, 1, 2.0), ("a", 0, 7, 0, 1, 1.0), ("a", 0, 7, 0, 2, 0.5), ("a", 0, 9, 0, 0, 8.0), ("a", 1, 1, 0, 0, 3.0),
            ("a", 1, 1, 0, 1, None), ("b", 0, 2, 0, 3, 0.0), ("b", 0, 3, 0, 4, 2.0)]
    maps = spark.createDataFrame(rows, "image_id STRING, component INT, map_id INT, y INT, x INT, w DOUBLE")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = {(r["image_id"], r["component"], r["x"]): round(r["w"], 9) for r in fixed_w_mean(maps.mapInArrow(count, maps.schema)).collect()}
    assert got == {("a", 0, 0): 1.0, ("a", 0, 1): 0.75, ("a", 0, 2): 0.5, ("a", 1, 0): 1.0, ("a", 1, 1): 3e-9, ("b", 0, 3): 1e-8, ("b", 0, 4): 1.0}
    assert seen.value == len(rows)


def test_one_model_row_without_image_key(spark):
    from spectrafold.operators import illumination as L

    shape = spark.createDataFrame([("a", 0, 8, 8)], "image_id STRING, slice_id INT, ny INT, nx INT")
    model = L.default_model(shape).drop("image_id", "slice_id")
    with pytest.raises(ValueError, match="exactly one row"):
        L.illum_gain(model.union(model), shape).count()


def test_python_stage_from_another_folder(tmp_path):
    """The package reaches the workers although only the driver can import it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["nnls_fixed_h"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_equal_values_have_no_deviation(spark):
    """Merging the moments of 49 and 49 equal values rounds to a deviation above 0; such a channel does not survive."""
    from spectrafold.operators.condition import channel_moments, kept_channels, standardize_channels

    flat = spark.range(0, 98, 1, 2).select(F.lit("a").alias("image_id"), F.lit(0).alias("slice_id"), F.lit(2).alias("channel"), F.lit(4.0).alias("value"))
    assert flat.groupBy("channel").agg(F.stddev_pop("value").alias("s")).first()["s"] > 0
    assert channel_moments(flat).first()["std"] == 0
    assert kept_channels(channel_moments(flat)).count() == 0 and standardize_channels(flat).count() == 0


def test_exploded_grids_are_not_broadcast(spark):
    """The mask of a few large images looks small to the planner; its join with the pixels is merged."""
    from spectrafold.operators import illumination as L

    shape = spark.createDataFrame([("a", 0, 300, 300)], "image_id STRING, slice_id INT, ny INT, nx INT")
    made = L.mask(shape, "diamond", 0.5)
    out = L.apply_mask(made.withColumnRenamed("value", "correction"), made)
    assert out.count() == 90_000
    first = out._jdf.queryExecution().optimizedPlan().toString().split("Join ")
    assert sum("strategy=merge" in p for p in first) == 1


def test_a_row_of_a_broadcast_weighs_more_than_its_numbers(spark):
    df = spark.range(1000)
    assert scale.cell_count(df) == 1000
    assert scale.fits_broadcast(df, 9000) and not scale.fits_broadcast(df, 8999)


def test_clustered_rows_meet_few_keys_in_a_task(spark):
    """40 fields of 200 pixels that arrive mixed: a task of the factorisation meets a range of them, not all."""
    from spectrafold.operators.factorize import nmf_mu

    rows = spark.range(8000).selectExpr("concat('i', id % 40) AS image_id", "0 AS slice_id", "CAST(id div 200 AS INT) AS y", "CAST(id % 200 AS INT) AS x",
                                        "array(1.0D + id % 7, 2.0D, 1.0D + id % 3) AS spectrum")
    met = lambda df: df.select("image_id", F.spark_partition_id().alias("p")).distinct().count()
    mixed = rows.repartition(8, "y", "x")
    assert met(mixed) == 320
    for df in (scale.clustered(mixed, ["image_id", "slice_id"], ["y", "x"]), nmf_mu(mixed, 2, max_iter=1).cached[0]):
        assert df.count() == 8000 and met(df) < 48
