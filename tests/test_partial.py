"""Registered queries against their SQL on embeddings kept as a folder of part files, whose count fills no last row."""

import os

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry

NAMES = ["stream_unmix", "stream_background_subtract", "stream_subtract_slices", "gaussian_blur_2d", "gaussian_blur_2d_nearest",
         "rolling_ball_background", "upsample_nearest", "w_seed_downsampled"]


@pytest.fixture(scope="module")
def cut(spark, sf, tmp_path_factory):
    """490 vectors: 20 rows of 25 pixels, the last one with 15."""
    folder = str(tmp_path_factory.mktemp("partial"))
    for name in os.listdir(sf):
        if name != "embeddings.parquet":
            os.symlink(f"{sf}/{name}", f"{folder}/{name}")
    spark.read.parquet(f"{sf}/embeddings.parquet").filter(F.col("vec_id") < 490).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, cut):
    con = connect(cut)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{cut}/embeddings.parquet/*.parquet'")
    assert compare(entry.queries()[name](spark, cut), con, entry.oracle_sql()[name]) == []
