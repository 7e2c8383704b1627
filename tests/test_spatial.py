"""Neighbourhoods, suggestion and mosaics against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import illumination as L
from spectrafold.operators import mosaic as K
from spectrafold.operators import neighborhood as N
from spectrafold.operators import suggest as S


def field(spark, a, image="a"):
    rows = [(image, 0, int(y), int(x), float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id STRING, slice_id INT, y INT, x INT, value DOUBLE")


def grid(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r["value"]
    return out


def numpy_blur(a, sigma):
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    p = np.pad(a, r, mode="symmetric")
    rows = sum(w * p[i: i + a.shape[0], :] for i, w in enumerate(k))
    return sum(w * rows[:, i: i + a.shape[1]] for i, w in enumerate(k))


@pytest.mark.parametrize("sigma", [0.8, 3.0, 9.0])
def test_blur_over_tiles(spark, sigma):
    a = np.random.default_rng(0).random((41, 53))
    f = field(spark, a)
    assert np.allclose(grid(N.gaussian_blur_2d(f, N.field_shape(f), sigma, tile=16), a.shape), numpy_blur(a, sigma))


def test_bilinear_zoom_end_points(spark):
    a = np.random.default_rng(1).random((4, 3))
    shape = spark.createDataFrame([("a", 0, 13, 10, 4, 3)], "image_id STRING, slice_id INT, ny INT, nx INT, sy INT, sx INT")
    got = grid(N.upsample_bilinear(field(spark, a), shape), (13, 10))
    yy, xx = np.linspace(0, 3, 13), np.linspace(0, 2, 10)
    half = np.array([np.interp(xx, range(3), row) for row in a])
    want = np.array([np.interp(yy, range(4), half[:, j]) for j in range(10)]).T
    assert np.allclose(got, want)


def blobs():
    a = np.zeros((60, 70))
    yy, xx = np.mgrid[:60, :70]
    for y, x, h in ((12, 14, 1.0), (14, 52, 0.8), (44, 18, 0.6), (46, 55, 0.9)):
        a += h * np.exp(-0.5 * ((yy - y) ** 2 + (xx - x) ** 2) / 9)
    return a


def parts(mask):
    """4-connected parts of a mask by spreading the smallest cell number."""
    name = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        wide = np.pad(name, 1, constant_values=mask.size)
        low = np.min([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]], axis=0)
        low = np.where(mask, low, mask.size)
        if (low == name).all():
            return name
        name = low


def boxes_by_hand(a, st):
    """Candidate boxes of one map without binning and smoothing, straight from the rules."""
    wide = np.pad(a, 2, mode="edge")
    peak = a == np.max([wide[i: i + a.shape[0], j: j + a.shape[1]] for i in range(5) for j in range(5)], axis=0)
    taken = []
    for share, floor in st.levels():
        cut = max(a.max() * share, np.percentile(a[a > 0], floor))
        regions = parts(a >= cut)
        for r in np.unique(regions[regions < a.size]):
            cells = [tuple(c) for c in np.argwhere(regions == r)]
            if len(cells) < st.min_area:
                continue
            tried = [c for c in cells if peak[c]] or [max(cells, key=lambda c: (a[c], -c[0], -c[1]))]
            for c in sorted(tried, key=lambda c: (-a[c], c)):
                near = parts((regions == r) & (a >= max(cut, a[c] * st.peak_region_ratio)))
                ys, xs = np.nonzero(near == near[c])
                box = np.array([ys.min(), xs.min(), np.ptp(ys) + 1, np.ptp(xs) + 1], dtype=float)
                if len(taken) < st.wanted and all(S.overlap_with(box, t[None, :4])[0] < 0.45 for t in taken):
                    taken.append(np.append(box, a[c]))
    return sorted((tuple(t) for t in taken), key=lambda t: -t[4])


def test_planted_blobs_give_four_boxes(spark):
    f = field(spark, blobs())
    st = S.Settings(max_groups=2, pool_factor=2, padding=0, smoothing_sigma=1.0)
    found = S.extract_candidates(f, N.field_shape(f), st).collect()
    assert len({(r["y"] + r["h"] / 2 > 30, r["x"] + r["w"] / 2 > 35) for r in found}) == len(found) == 4


def test_candidates_by_the_rules_in_several_rounds(spark):
    a = np.round(np.random.default_rng(5).random((24, 30)), 3)
    f = field(spark, a)
    st = S.Settings(max_groups=1, max_rois_per_group=2, pool_factor=5, padding=0, smoothing_sigma=0.0, min_area=2)
    found = S.extract_candidates(f, N.field_shape(f), st).orderBy("candidate").collect()
    assert sorted((r["y"], r["x"], r["h"], r["w"], r["score"]) for r in found) == sorted(boxes_by_hand(a, st))


def test_candidates_over_tiles_by_the_rules(spark):
    a = np.round(np.random.default_rng(8).random((24, 30)), 2)
    a[:, 5:7] += 1  # one region lies over all tiles from top to bottom
    f = field(spark, a)
    st = S.Settings(max_groups=1, max_rois_per_group=2, pool_factor=8, padding=0, smoothing_sigma=0.0, min_area=4)
    found = S.extract_candidates(f, N.field_shape(f), st, tile=8).orderBy("candidate").collect()
    assert sorted((r["y"], r["x"], r["h"], r["w"], r["score"]) for r in found) == sorted(boxes_by_hand(a, st))


def test_peaks_inside_a_tile_label_no_surroundings(spark, monkeypatch):
    labelled = []
    monkeypatch.setattr(S, "connected_regions", lambda mask, *a, **k: labelled.append(mask.count()))
    a = np.round(np.random.default_rng(5).random((24, 30)), 3)
    f = field(spark, a)
    st = S.Settings(max_groups=1, max_rois_per_group=2, pool_factor=5, padding=0, smoothing_sigma=0.0, min_area=2)
    found = S.extract_candidates(f, N.field_shape(f), st).collect()
    assert labelled == [] and sorted((r["y"], r["x"], r["h"], r["w"], r["score"]) for r in found) == sorted(boxes_by_hand(a, st))


def test_component_tree_by_labels():
    a = np.round(np.random.default_rng(9).random((9, 13)), 1)
    a[4, 3:6] = -np.inf
    parent, tree = S.component_tree(a)
    above = [parent]
    for _ in range(7):
        above.append(above[-1][above[-1]])
    for p in np.flatnonzero(np.isfinite(a.ravel())):
        for cut in (a.ravel()[p], a.ravel()[p] * 0.5):
            node = S._climb(above, a.ravel(), np.array([p]), np.array([cut]))[0]
            part = S._label(a >= cut)
            cells = np.flatnonzero(part == part[p // 13, p % 13])
            ys, xs = cells // 13, cells % 13
            want = [ys.min(), ys.max(), xs.min(), xs.max(), len(cells), cells[0], min(cells, key=lambda c: (-a.ravel()[c], c))]
            assert [tree[k][node] for k in ("y0", "y1", "x0", "x1", "size", "first", "best")] == want


def balanced_by_hand(v, sigma):
    """Balanced projection of frames (c, y, x); missing voxels are NaN."""
    maps = []
    for frame in v:
        up = np.maximum(np.nan_to_num(frame) - numpy_blur(np.nan_to_num(frame), sigma), 0) if sigma else np.maximum(frame, 0)
        maps.append(np.minimum(up / np.percentile(up[up > 0], 99.5), 1))
    weight = np.array([np.nanvar(m) for m in maps])[:, None, None]
    return np.nansum(maps * weight, axis=0) / (~np.isnan(maps) * weight).sum(axis=0)


@pytest.mark.parametrize("sigma", [2.0, 0.0])
def test_balanced_projection_of_voxels_and_pixels(spark, monkeypatch, sigma):
    monkeypatch.setattr(S, "FRAMES", 3)
    monkeypatch.setattr(S, "STRIP", 40)
    v = np.random.default_rng(10).random((7, 21, 30))
    v[2, 4:9, 3:20] = np.nan
    rows = [("a", 0, y, x, c, float(v[c, y, x])) for c in range(7) for y in range(21) for x in range(30) if not np.isnan(v[c, y, x])]
    voxels = spark.createDataFrame(rows, "image_id STRING, slice_id INT, y INT, x INT, channel INT, value DOUBLE")
    shape = N.field_shape(voxels)
    assert np.allclose(grid(S.balanced_projection(voxels, shape, sigma), v.shape[1:]), balanced_by_hand(v, sigma))
    full = np.nan_to_num(v)
    wide = [("a", 0, y, x, full[:, y, x].tolist()) for y in range(21) for x in range(30)]
    pixels = spark.createDataFrame(wide, "image_id STRING, slice_id INT, y INT, x INT, spectrum ARRAY<DOUBLE>")
    assert np.allclose(grid(S.balanced_projection(pixels, shape, sigma), v.shape[1:]), balanced_by_hand(full, sigma))


def test_balanced_projection_keeps_voxels_in_strips(spark, monkeypatch):
    written = []
    monkeypatch.setattr(S, "materialize", lambda df, real=S.materialize: written.append((out := real(df)).count()) or out)
    a = np.random.default_rng(11).random((7, 40, 40))
    wide = [("a", 0, y, x, a[:, y, x].tolist()) for y in range(40) for x in range(40)]
    pixels = spark.createDataFrame(wide, "image_id STRING, slice_id INT, y INT, x INT, spectrum ARRAY<DOUBLE>")
    long = pixels.select("image_id", "slice_id", "y", "x", F.posexplode("spectrum").alias("channel", "value"))
    assert np.allclose(grid(S.balanced_projection(long, N.field_shape(pixels), 2.0), (40, 40)), balanced_by_hand(a, 2.0))
    assert max(written) <= 7  # before: a row for each of the 11200 voxels


def test_nms_keeps_the_first_of_overlapping_boxes(spark):
    rng = np.random.default_rng(6)
    rows = [("a", i % 2, i, int(y), int(x), int(h), int(w), float(s)) for i, (y, x, h, w, s) in enumerate(
        zip(rng.integers(0, 150, 200), rng.integers(0, 150, 200), rng.integers(1, 60, 200), rng.integers(1, 60, 200), rng.permutation(200)))]
    df = spark.createDataFrame(rows, "image_id STRING, slice_id INT, n INT, y INT, x INT, h INT, w INT, score DOUBLE")
    got = {r["n"] for r in S.greedy_nms(df, ["image_id", "slice_id"], 0.3).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: -r[7]):
        box = np.array(r[3:7], dtype=float)
        if all(k[1] != r[1] or S.overlap_with(box, np.array([k[3:7]], dtype=float))[0] < 0.3 for k in kept):
            kept.append(r)
    assert got == {r[2] for r in kept}


def test_connected_regions_over_tiles(spark):
    a = np.random.default_rng(2).random((50, 50)) < 0.58
    f = field(spark, a.astype(float)).filter("value > 0")
    got = np.zeros(a.shape, dtype=np.int64)
    for r in S.connected_regions(f, tile=8).collect():
        got[r["y"], r["x"]] = r["region"] + 1
    want = S._label(a)
    assert len({(g, w) for g, w in zip(got.ravel(), want.ravel())}) == len(np.unique(want))
    first = {w: int(np.flatnonzero(want.ravel() == w)[0]) for w in np.unique(want) if w}
    assert all(got.ravel()[i] == (i // 50) * 2**31 + i % 50 + 1 for i in first.values())


def test_ward_separates_three_families():
    rng = np.random.default_rng(3)
    base = np.eye(3).repeat(4, axis=0) + 0.05 * rng.random((12, 3))
    v = base / np.linalg.norm(base, axis=1, keepdims=True)
    label = S.ward_labels(v, 3)
    assert len(set(label)) == 3 and all(len(set(label[i * 4: i * 4 + 4])) == 1 for i in range(3))


def test_correlation_finds_known_shift():
    rng = np.random.default_rng(4)
    big = rng.random((30, 60))
    a, b = big[5:21, 5:45], big[7:23, 2:42]
    oy, ox = K.correlation_offset(a, b)
    assert (oy, ox) == (-2.0, 3.0)


def tiles(spark, image, origins, size, n_channels):
    rows = []
    for (tx, ty), (y0, x0) in origins.items():
        for y in range(size):
            for x in range(size):
                rows.append(("m", tx, ty, y, x, [float(v) for v in image[y0 + y, x0 + x]]))
    return spark.createDataFrame(rows, "mosaic_id STRING, tx INT, ty INT, y INT, x INT, spectrum ARRAY<DOUBLE>")


def test_mosaic_recovers_shifted_columns(spark):
    image = np.random.default_rng(5).random((70, 60, 2))
    origins = {(0, 0): (3, 0), (0, 1): (23, 0), (1, 0): (1, 18), (1, 1): (21, 18)}  # nominal overlap 8 of 28
    t = tiles(spark, image, origins, 28, 2)
    out = K.mosaic(t, 28, 28, 8, 8, 2, mode="normal", sigma=3.0)
    got = {(r["y"], r["x"]): r["spectrum"] for r in out.collect()}
    assert len(got) == 48 * 28 + 48 * 28 - 46 * 10
    # the second column starts two rows higher, so its first row is row 0 of the mosaic
    for (y, x), v in got.items():
        assert np.allclose(v, image[y + 1, x], atol=1e-9)


def test_missing_tile_is_an_error(spark):
    image = np.zeros((60, 60, 1))
    t = tiles(spark, image, {(0, 0): (0, 0), (0, 1): (20, 0), (1, 0): (0, 20)}, 28, 1)
    with pytest.raises(ValueError):
        K.mosaic_grid(t, 28, 28, 8, 8, 1)


def test_wide_overlap_blends_like_the_sequence(spark):
    image = np.random.default_rng(6).random((3, 12, 5, 1))
    rows = [("m", 0, t, y, x, [float(image[t, y, x, 0])]) for t in range(3) for y in range(12) for x in range(5)]
    df = spark.createDataFrame(rows, "mosaic_id STRING, tx INT, ty INT, y INT, x INT, spectrum ARRAY<DOUBLE>")
    ov = 8
    a = np.linspace(1, 0, ov)[:, None, None]
    col = image[0]
    for nxt in image[1:]:
        col = np.concatenate([col[:-ov], col[-ov:] * a + nxt[:ov] * (1 - a), nxt[ov:]])
    got = np.zeros(col.shape)
    for r in K.mosaic_grid(df, 12, 5, ov, 0, 1).collect():
        got[r["y"], r["x"]] += r["spectrum"]
    assert np.allclose(got, col)


def test_illumination_fit_finds_the_hill(spark):
    yy, xx = np.mgrid[:40, :60]
    a = 5 + 100 * np.exp(-0.5 * ((xx - 33.5) / 12) ** 2 - 0.5 * ((yy - 17.0) / 9) ** 2)
    f = field(spark, a)
    r = L.illum_fit(f, N.field_shape(f)).first()
    assert r["dx"] == pytest.approx(33.5 - 29.5, abs=1e-3) and r["dy"] == pytest.approx(17 - 19.5, abs=1e-3)
    assert r["sigma_x"] == pytest.approx(12, abs=1e-2) and r["sigma_y"] == pytest.approx(9, abs=1e-2)


def test_radial_fits(spark):
    yy, xx = np.mgrid[:30, :36]
    g = 80 * np.exp(-0.004 * (xx - 15.5) ** 2 - 0.006 * (yy - 12.2) ** 2)
    r = L.fit_radial(field(spark, g), "gaussian").first()
    assert (r["xc"], r["yc"]) == pytest.approx((15.5, 12.2), abs=1e-2) and r["amplitude"] == pytest.approx(80, rel=1e-3)
    q = 500 - 0.2 * ((xx - 10.5) ** 2 + (yy - 8) ** 2)
    r = L.fit_quadratic(field(spark, q)).first()
    assert (r["xc"], r["yc"], r["peak"], r["slope"]) == pytest.approx((10.5, 8, 500, -0.2), abs=1e-6)


def test_missing_pixels_of_the_last_row_get_no_rows(spark):
    """A 5 x 4 image that ends within its last row: blur, ball and zoom against sums over the pixels that are there."""
    a = np.random.default_rng(5).random((5, 4))
    a[4, 2:] = np.nan
    f = field(spark, a).filter("NOT isnan(value)")
    shape = N.field_shape(f)
    hole = ~np.isnan(a)
    blurred = grid(N.gaussian_blur_2d(f, shape, 0.8, tile=16, there=True), a.shape)
    assert np.allclose(blurred, np.where(hole, numpy_blur(np.nan_to_num(a), 0.8), np.nan), equal_nan=True)
    ball = grid(N.rolling_ball_background(f, shape, 1, tile=16), a.shape)
    for y, x in np.argwhere(hole):
        near = [(y, x, 0.0), *[(y + i, x + j, 1.0) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))]]
        want = min(a[p, q] + up for p, q, up in near if 0 <= p < 5 and 0 <= q < 4 and hole[p, q])
        assert ball[y, x] == pytest.approx(want)
    assert np.isnan(ball[~hole]).all()


def test_tables_of_pixels_are_merged_not_broadcast(spark):
    """Labelled pixels pack into small files; regions over tile borders must not send them through the driver."""
    a = np.ones((40, 40))
    out = S.connected_regions(field(spark, a).filter("value > 0"), tile=16)
    assert "strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.select("region").distinct().count() == 1 and out.count() == 1600
