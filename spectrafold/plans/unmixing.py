"""Queries over fixed-spectrum unmixing and its diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import stats as S
from ..operators import unmix as U
from ..scale import join_dim
from ..tables import FIELD, PIXEL
from . import fixtures as fx
from .registry import query
from .sourcing import rnd

# Exact answer for two spectra: the best feasible one of the four subsets.
NNLS2_SQL = """
h2 AS (SELECT channel, max(value) FILTER (component = 0) AS a, max(value) FILTER (component = 1) AS b FROM hk WHERE component < 2 GROUP BY ALL),
g2 AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM h2),
p2 AS (SELECT v.image_id, v.slice_id, v.y, v.x, any_value(v.label) AS label, sum(v.value * a) AS xa, sum(v.value * b) AS xb FROM vox v JOIN h2 USING (channel) GROUP BY ALL),
s2 AS (SELECT *, (bb * xa - ab * xb) / (aa * bb - ab * ab) AS u, (aa * xb - ab * xa) / (aa * bb - ab * ab) AS v, greatest(xa / aa, 0) AS u1, greatest(xb / bb, 0) AS v1 FROM p2, g2),
w2 AS (SELECT image_id, slice_id, y, x, label,
  CASE WHEN u >= 0 AND v >= 0 THEN u WHEN u1 * u1 * aa >= v1 * v1 * bb THEN u1 ELSE 0 END AS w0,
  CASE WHEN u >= 0 AND v >= 0 THEN v WHEN u1 * u1 * aa >= v1 * v1 * bb THEN 0 ELSE v1 END AS w1 FROM s2)"""


def flagship(spark, sf):
    """Abundances of two reference spectra in every pixel, averaged per class."""
    w = U.nnls_fixed_h(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 2), keep=["label"], require=2)
    return w.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        rnd(F.avg(F.element_at("w", 1)), "mean_w0"), rnd(F.avg(F.element_at("w", 2)), "mean_w1"),
    )


query("unmix_by_class", """
SELECT label, count(*) AS n_pixels, round(avg(w0), 6) AS mean_w0, round(avg(w1), 6) AS mean_w1 FROM w2 GROUP BY ALL""", NNLS2_SQL)(flagship)


@query("unmix_corpus", """
SELECT l_returnflag, CAST(l_linenumber AS INT) AS line, count(*) AS n_pixels, round(avg(l_quantity * w0), 6) AS mean_w0, round(avg(l_quantity * w1), 6) AS mean_w1
FROM lineitem JOIN w2 ON w2.y * 25 + w2.x = l_orderkey % (SELECT count(*) FROM embeddings) GROUP BY ALL""", NNLS2_SQL)
def _(spark, sf):
    """Every order line is a pixel whose spectrum is an embedding scaled by its quantity."""
    base = fx.pixels_emb(spark, sf).select((F.col("y") * 25 + F.col("x")).cast("bigint").alias("id"), "spectrum")
    n = fx.table(spark, sf, "embeddings").count()
    lines = fx.table(spark, sf, "lineitem").select(
        F.lit("emb").alias("image_id"), F.lit(0).alias("slice_id"), F.expr("CAST(l_orderkey div 1024 AS INT)").alias("y"),
        F.expr("CAST(l_orderkey % 1024 AS INT)").alias("x"), (F.col("l_orderkey") % n).alias("id"), "l_quantity", "l_returnflag",
        F.col("l_linenumber").cast("int").alias("line"))
    pixels = join_dim(lines, base, ["id"]).withColumn("spectrum", F.transform("spectrum", lambda v: v * F.col("l_quantity")))
    w = U.nnls_fixed_h(pixels, fx.label_spectra(spark, sf, 2), keep=["l_returnflag", "line"])
    return w.groupBy("l_returnflag", "line").agg(
        F.count(F.lit(1)).alias("n_pixels"), rnd(F.avg(F.element_at("w", 1)), "mean_w0"), rnd(F.avg(F.element_at("w", 2)), "mean_w1"))


@query("nnls_fixed_h", "SELECT image_id, slice_id, y, x, round(w0, 6) AS w0, round(w1, 6) AS w1 FROM w2", NNLS2_SQL)
def _(spark, sf):
    w = U.nnls_fixed_h(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 2), require=2)
    return w.select(*PIXEL, rnd(F.element_at("w", 1), "w0"), rnd(F.element_at("w", 2), "w1"))


@query("nnls_k1", """
SELECT image_id, slice_id, y, x, round(greatest(sum(v.value * h.value) / (any_value(hh) + 1e-8), 0), 6) AS w FROM vox v
JOIN (SELECT channel, value, sum(value * value) OVER () AS hh FROM hk WHERE component = 0) h USING (channel) GROUP BY ALL""")
def _(spark, sf):
    return U.nnls_k1(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 1)).select(*PIXEL, rnd("w", "w"))


@query("nnls_kkt_check")
def _(spark, sf):
    """Optimality of a five-spectrum solve: worst negative gradient and worst slackness per slice."""
    h = fx.label_spectra(spark, sf, 5)
    p = fx.pixels_emb4d(spark, sf)
    w = U.nnls_fixed_h(p, h, keep=["spectrum"])
    r = U.residual_of(U.reconstruct(w, h))
    packed = h.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("component", "spectrum"))).alias("hs"))
    g = r.join(F.broadcast(packed), "image_id").select(
        *FIELD, "w", F.transform("hs", lambda q: -A.dot(q["spectrum"], F.col("residual"))).alias("g"))
    return g.groupBy(*FIELD).agg(
        F.min(F.array_min("g")).alias("lowest_gradient"), F.min(F.array_min("w")).alias("lowest_w"),
        F.max(F.array_max(F.zip_with("w", "g", lambda a, b: F.abs(a * b)))).alias("slackness"),
    )


@query("project_on_basis", """
SELECT image_id, slice_id, y, x, component, round(greatest(sum(v.value * h.value), 0), 6) AS strength FROM vox v JOIN (SELECT * FROM hk WHERE component < 3) h USING (channel) GROUP BY ALL""")
def _(spark, sf):
    return U.project_on_basis(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 3)).withColumn("strength", rnd("strength"))


SCORE_SQL = """
st AS (SELECT image_id, slice_id, y, x, component, sum(v.value * h.value) AS t FROM vox v JOIN (SELECT * FROM hk WHERE component < 3) h USING (channel) GROUP BY ALL),
score AS (SELECT a.image_id, a.slice_id, a.y, a.x, a.component, greatest(any_value(a.t) * any_value(a.t) / (any_value(a.t) + max(b.t) + 1e-8), 1e-8) AS w
  FROM st a JOIN st b ON a.image_id = b.image_id AND a.slice_id = b.slice_id AND a.y = b.y AND a.x = b.x AND a.component <> b.component GROUP BY ALL)"""


@query("selective_score_map", "SELECT image_id, slice_id, y, x, component, round(w, 6) AS w FROM score", SCORE_SQL)
def _(spark, sf):
    return U.selective_score_map(fx.pixels_emb(spark, sf), fx.label_spectra(spark, sf, 3)).withColumn("w", rnd("w"))


@query("reconstruct", """
SELECT v.image_id, v.slice_id, v.y, v.x, v.channel, round(w0 * a + w1 * b, 6) AS model, round(v.value - (w0 * a + w1 * b), 6) AS residual
FROM vox v JOIN h2 USING (channel) JOIN w2 ON w2.y = v.y AND w2.x = v.x""", NNLS2_SQL)
def _(spark, sf):
    h = fx.label_spectra(spark, sf, 2)
    p = fx.pixels_emb(spark, sf)
    r = U.residual(p, U.nnls_fixed_h(p, h), h)
    return r.select(*PIXEL, F.posexplode(F.arrays_zip("model", "residual")).alias("channel", "m")).select(
        *PIXEL, "channel", rnd("m.model", "model"), rnd("m.residual", "residual"))


@query("fit_error", """
SELECT v.image_id, v.slice_id, round(sqrt(sum((v.value - (w0 * a + w1 * b)) ** 2)), 6) AS final_error, round(sqrt(sum(v.value ** 2)), 6) AS data_norm,
  count(*) // 64 AS n_pixels, round(sqrt(sum((v.value - (w0 * a + w1 * b)) ** 2)) / sqrt(sum(v.value ** 2)), 6) AS relative_error
FROM vox v JOIN h2 USING (channel) JOIN w2 ON w2.y = v.y AND w2.x = v.x GROUP BY ALL""", NNLS2_SQL)
def _(spark, sf):
    h = fx.label_spectra(spark, sf, 2)
    w = U.nnls_fixed_h(fx.pixels_emb(spark, sf), h, keep=["spectrum"])
    out = S.fit_error(U.reconstruct(w, h))
    return out.select(*FIELD, rnd("final_error", "final_error"), rnd("data_norm", "data_norm"), "n_pixels", rnd("relative_error", "relative_error"))


@query("fit_series_stats", """
SELECT image_id, round(avg(e), 6) AS mean_error, round(min(e), 6) AS min_error, round(max(e), 6) AS max_error, count(*) AS n_slices FROM (
  SELECT v.image_id, v.slice_id, sqrt(sum((v.value - w * h.value) ** 2)) / sqrt(sum(v.value ** 2)) AS e
  FROM vox4 v JOIN (SELECT channel, value FROM hk WHERE component = 0) h USING (channel)
  JOIN (SELECT slice_id, y, x, sum(v.value * h.value) / (any_value(hh) + 1e-8) AS w FROM vox4 v JOIN (SELECT channel, value, sum(value * value) OVER () AS hh FROM hk WHERE component = 0) h USING (channel) GROUP BY ALL) w
    ON w.slice_id = v.slice_id AND w.y = v.y AND w.x = v.x
  GROUP BY ALL) GROUP BY ALL""")
def _(spark, sf):
    h = fx.label_spectra(spark, sf, 1)
    w = U.nnls_fixed_h(fx.pixels_emb4d(spark, sf), h, keep=["spectrum"])
    out = S.fit_series_stats(S.fit_error(U.reconstruct(w, h)))
    return out.select("image_id", rnd("mean_error", "mean_error"), rnd("min_error", "min_error"), rnd("max_error", "max_error"), "n_slices")


@query("apply_fixed_w", """
SELECT image_id, slice_id, y, x, CAST(c AS INT) AS component, round(CASE WHEN c = 1 AND label < 5 THEN label / 10 WHEN c = 0 THEN w0 ELSE w1 END, 6) AS w
FROM w2, (SELECT unnest([0, 1]) AS c)""", NNLS2_SQL)
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    w = U.to_long_maps(U.nnls_fixed_h(p, fx.label_spectra(spark, sf, 2)))
    fixed = p.filter("label < 5").select("image_id", F.lit(1).alias("component"), "y", "x", (F.col("label") / 10).alias("w"))
    return U.apply_fixed_w(w, fixed).select(*PIXEL, "component", rnd("w", "w"))
