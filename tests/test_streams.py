"""Streams in several micro-batches against the batch operators."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions import arrays as A
from spectrafold.operators.condition import subtract_background
from spectrafold.operators.rois import roi_background
from spectrafold.scale import shared_dir
from spectrafold.streaming.streams import stream_subtract_slices
from spectrafold.tables import PIXEL

SCHEMA = "image_id STRING, slice_id INT, y INT, x INT, spectrum ARRAY<DOUBLE>, ts TIMESTAMP"
ROIS = ("image_id STRING, roi_id INT, shape STRING, x0 DOUBLE, y0 DOUBLE, w DOUBLE, h DOUBLE, component INT, background BOOLEAN, "
        "scale DOUBLE, offset DOUBLE, smooth_sigma DOUBLE, subtract BOOLEAN, angle DOUBLE")


def run(spark, parts, rois, **options):
    """Every part is a file and so a micro-batch of its own."""
    base = f"{shared_dir(spark)}/stream-test-{uuid.uuid4().hex}"
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = stream_subtract_slices(stream, rois, 5, **options)
    q = (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == len(parts)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@pytest.mark.parametrize("salts", [1, 7])
def test_slices_over_three_batches_equal_the_batch(spark, salts):
    rng = np.random.default_rng(3)
    rows = [(image, s, y, x, rng.uniform(0, 9, 5).tolist(), s) for image in "ab" for s in range(3) for y in range(6) for x in range(5)]
    df = spark.createDataFrame(rows, SCHEMA.replace("ts TIMESTAMP", "d INT")).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("d") * 86400)).drop("d")
    late = df.limit(1).withColumn("slice_id", F.lit(99)).withColumn("ts", F.timestamp_seconds(F.lit(1704067200 + 40 * 86400)))
    rois = spark.createDataFrame([
        ("a", 0, "RectROI", 0.0, 0.0, 3.0, 4.0, 0, True, 1.5, -0.2, 0.8, True, 0.0), ("a", 1, None, 1.0, 2.0, 2.0, 2.0, 0, False, None, None, None, True, 0.0),
        ("a", 2, "LineROI", 0.5, 0.5, 3.0, 3.0, 0, False, 1.0, 0.0, 0.0, True, 0.0), ("a", 3, "RectROI", 0.0, 0.0, 5.0, 6.0, 0, False, 1.0, 0.0, 0.0, False, 0.0)], ROIS)
    # pixels of every slice in each of the three first files, the last one closes the windows
    piece = lambda i: df.filter(F.pmod(F.xxhash64("image_id", "slice_id", "y", "x"), F.lit(3)) == i)
    assert all(piece(i).select("image_id", "slice_id").distinct().count() == 6 for i in range(3))
    got = run(spark, [piece(0), piece(1), piece(2), late], rois, watermark="20 days", salts=salts)
    want = subtract_background(df, roi_background(df, rois))
    key = lambda r: tuple(r[k] for k in PIXEL)
    found, known = {key(r): r for r in got.collect()}, {key(r): r for r in want.collect()}
    assert set(found) == set(known) and got.count() == len(known)
    for k, r in known.items():
        assert found[k]["spectrum"] == r["spectrum"]
        if k[0] == "b":  # no region
            assert found[k]["spectrum_sub"] is None and r["spectrum_sub"] is None
        else:
            assert np.allclose(found[k]["spectrum_sub"], r["spectrum_sub"], rtol=0, atol=1e-9)


def test_smoothing_by_row(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0, 0.0], s) for s in (0.0, 0.6, 1.7)], "v ARRAY<DOUBLE>, s DOUBLE")
    for r in df.select("s", A.smooth_by("v", F.col("s")).alias("a"), *[A.smooth("v", s).alias(f"f{i}") for i, s in enumerate((0.0, 0.6, 1.7))]).collect():
        assert np.allclose(r["a"], r[f"f{(0.0, 0.6, 1.7).index(r['s'])}"])
