"""Readers and writers on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import axis as X
from spectrafold.sources import readers as R
from spectrafold.sources import writers as W


def test_text_spectra(spark, tmp_path):
    (tmp_path / "bead.asc").write_text("﻿header line\n\n2800\t1.5 extra\nbad 2\n2810 2.5\n3\n")
    rows = R.read_spectra_text(spark, str(tmp_path)).orderBy("axis_value").collect()
    assert [(r["name"], r["axis_value"], r["value"]) for r in rows] == [("bead", 2800.0, 1.5), ("bead", 2810.0, 2.5)]
    (tmp_path / "empty.txt").write_text("nothing here\n")
    with pytest.raises(Exception, match="no numeric"):
        R.read_spectra_text(spark, str(tmp_path)).collect()


def test_csv_spectra(spark, tmp_path):
    (tmp_path / "s.csv").write_text('wavenumber,"lipid",\n2800,1,2\n2900,3,4\n')
    rows = R.read_spectra_csv(spark, str(tmp_path / "s.csv")).orderBy("component", "axis_value").collect()
    assert [(r["component"], r["name"], r["value"]) for r in rows] == [
        (0, "lipid", 1.0), (0, "lipid", 3.0), (1, "Component 2", 2.0), (1, "Component 2", 4.0)]


def test_csv_files_of_different_width_and_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nm,one\n1,10\n2,20\n")
    (tmp_path / "b.csv").write_text('nm,"x, y",two,three\r\n1,1,2,3\r\nnote,,\r\n2,4,,6\r\n')
    (tmp_path / "c.csv").write_text("5,7\n6,8\n")
    got = sorted((r["path"][-5:], r["component"], r["name"], r["axis_value"], r["value"]) for r in R.read_spectra_csv(spark, str(tmp_path)).filter("value IS NOT NULL").collect())
    assert got == [("a.csv", 0, "one", 1.0, 10.0), ("a.csv", 0, "one", 2.0, 20.0), ("b.csv", 0, "x, y", 1.0, 1.0), ("b.csv", 0, "x, y", 2.0, 4.0),
                   ("b.csv", 1, "two", 1.0, 2.0), ("b.csv", 2, "three", 1.0, 3.0), ("b.csv", 2, "three", 2.0, 6.0),
                   ("c.csv", 0, "Component 1", 5.0, 7.0), ("c.csv", 0, "Component 1", 6.0, 8.0)]


def test_written_csv_names_each_images_own_axis(spark, tmp_path):
    spectra = spark.createDataFrame([(i, c, ch, float(10 * c + ch)) for i in ("a", "b", "l") for c in range(2) for ch in range(3)],
                                    "image_id STRING, component INT, channel INT, value DOUBLE")
    axis = spark.createDataFrame([(i, ch, 100.0 + ch, None if i != "l" else f"L{ch}", u) for i, u in (("a", "nm"), ("b", "cm⁻¹"), ("l", "index")) for ch in range(3)],
                                 "image_id STRING, channel INT, value DOUBLE, label STRING, unit STRING")
    W.write_spectra_csv(spectra, axis, str(tmp_path / "out"), 2)
    text = {i: next((tmp_path / "out" / f"image_id={i}").glob("*.txt")).read_text().split("\n") for i in ("a", "b", "l")}
    assert len({t[0] for t in text.values()}) == 3 and "nm" in text["a"][0] and "cm" in text["b"][0]
    assert text["a"][1:4] == ["100.0,0.0,10.0", "101.0,1.0,11.0", "102.0,2.0,12.0"] and text["l"][1] == '"L0",0.0,10.0'
    back = R.read_spectra_csv(spark, str(tmp_path / "out" / "image_id=b")).orderBy("component", "axis_value").collect()
    assert [r["value"] for r in back] == [0.0, 1.0, 2.0, 10.0, 11.0, 12.0] and back[0]["name"] == "Component 0"


def test_user_function_per_tile(spark):
    import pandas as pd

    rows = [("m", t, 0, y, x, [float(y * 6 + x + t), 1.0]) for t in range(2) for y in range(6) for x in range(6)]
    tiles = spark.createDataFrame(rows, "mosaic_id STRING, tx INT, ty INT, y INT, x INT, spectrum ARRAY<DOUBLE>")
    fn = lambda key, cube: pd.DataFrame({"tx": [key[1]], "n": [cube.shape[0] * cube.shape[1]], "first": [cube[0, 0, 0]]})
    got = sorted(map(tuple, R.map_tiles(tiles, fn, "tx INT, n INT, first DOUBLE", crop=1, bin_factor=2).collect()))
    assert got == [(0, 4, 10.5), (1, 4, 11.5)]


def test_axis_json(spark, tmp_path):
    f = tmp_path / "axis.json"
    f.write_text(json.dumps({"custom_points": [1, 2], "labels": ["a", "b"], "unit": "nm"}, indent=1))
    r = R.read_axis_json(spark, str(f)).first()
    assert r["custom_values"] == [1.0, 2.0] and r["custom_labels"] == ["a", "b"] and r["spectral_unit"] == "nm"
    for bad in ({"custom_values": [1], "custom_labels": ["a", "b"]}, {"tuned_beam": "laser", "fixed_beam_nm": 1},
                {"tuned_beam": "pump", "fixed_beam_nm": 1064}):
        f.write_text(json.dumps(bad))
        with pytest.raises(Exception):
            R.read_axis_json(spark, str(f)).collect()


def test_axis_list(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1;2, 3\n4")
    assert [r["value"] for r in R.read_axis_list(spark, str(tmp_path)).orderBy("channel").collect()] == [1.0, 2.0, 3.0, 4.0]


def test_tile_catalog_and_loader(spark, tmp_path):
    for n in ("a_pos_0_1.tif", "a_POS-3-4_z.tif", "a_pos_-1_2.tif", "notes.txt"):
        (tmp_path / n).write_bytes(n.encode())
    rows = R.tile_catalog(spark, str(tmp_path), "*.tif").collect()
    assert {(r["tx"], r["ty"]) for r in rows} == {(0, 1), (3, 4), (-1, 2)}
    import pandas as pd

    out = R.load_tiles(spark, str(tmp_path), lambda p, c: pd.DataFrame({"n": [len(c)]}), "n INT", "*.tif")
    assert sorted(r["n"] for r in out.collect()) == [13, 14, 15]


def test_seed_library_round_trip(spark, tmp_path):
    seeds = spark.createDataFrame([("a", 0, "s", [0.0, 10.0, 20.0], False)], "image_id STRING, component INT, name STRING, spectrum ARRAY<DOUBLE>, background BOOLEAN")
    axis = spark.createDataFrame([("a", c, 100.0 + 10 * c, None, "nm") for c in range(3)], "image_id STRING, channel INT, value DOUBLE, label STRING, unit STRING")
    W.save_seed_library(seeds, axis, str(tmp_path / "lib"))
    target = spark.createDataFrame([("a", i, v) for i, v in enumerate([90.0, 105.0, 112.5, 150.0])], "image_id STRING, channel INT, value DOUBLE")
    got = W.load_seed_library(spark, str(tmp_path / "lib"), target).first()["spectrum"]
    assert np.allclose(got, np.interp([90, 105, 112.5, 150], [100, 110, 120], [0, 10, 20]))


def test_writers(spark, tmp_path):
    spectra = spark.createDataFrame([("a", c, ch, float(c + ch)) for c in range(2) for ch in range(3)], "image_id STRING, component INT, channel INT, value DOUBLE")
    axis = spark.createDataFrame([("a", c, 100.0 + c, None, "nm") for c in range(3)], "image_id STRING, channel INT, value DOUBLE, label STRING, unit STRING")
    W.write_spectra_csv(spectra, axis, str(tmp_path / "csv"), 2)
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert "Wavelength (nm)" in back.columns and "Component 1" in back.columns and back.count() == 3
    maps = spark.createDataFrame([("a", 0, 0, 0, [1.0, 2.0])], "image_id STRING, slice_id INT, y INT, x INT, w ARRAY<DOUBLE>")
    W.write_maps(maps, str(tmp_path / "maps"), [1])
    assert spark.read.parquet(str(tmp_path / "maps")).first()["w"] == [2.0]


def test_interpolation_of_unsorted_curve(spark):
    rng = np.random.default_rng(0)
    ax, v = rng.permutation(20) * 3.0, rng.random(20)
    curve = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(ax, v)], "image_id STRING, axis_value DOUBLE, value DOUBLE")
    t = np.linspace(-5, 70, 31)
    target = spark.createDataFrame([("a", i, float(q)) for i, q in enumerate(t)], "image_id STRING, channel INT, value DOUBLE")
    got = [r["value"] for r in X.interpolate_to_axis(curve, target, ["image_id"]).orderBy("channel").collect()]
    o = np.argsort(ax)
    assert np.allclose(got, np.interp(t, ax[o], v[o]))
