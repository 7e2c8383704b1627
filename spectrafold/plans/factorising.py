"""Queries over matrix factorisation and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import condition as C
from ..operators import factorize as M
from ..operators import unmix as U
from ..tables import FIELD, PIXEL
from . import fixtures as fx
from .registry import query
from .sourcing import rnd

STEP_SQL = """
h3 AS (SELECT * FROM hk WHERE component < 3),
w0 AS (SELECT y, x, component, 0.5::DOUBLE + component * 0.25::DOUBLE + (x % 3) * 0.1::DOUBLE AS w FROM pix, (SELECT DISTINCT component FROM h3)),
hht AS (SELECT a.component AS i, b.component AS j, sum(a.value * b.value) AS v FROM h3 a JOIN h3 b USING (channel) GROUP BY ALL),
xht AS (SELECT y, x, component, sum(v.value * h.value) AS v FROM vox v JOIN h3 h USING (channel) GROUP BY ALL),
w1 AS (SELECT w.y, w.x, w.component, w.w * any_value(n.v) / (sum(d.w * hht.v) + 1e-8) AS w FROM w0 w JOIN w0 d ON d.y = w.y AND d.x = w.x
  JOIN hht ON hht.i = w.component AND hht.j = d.component JOIN xht n ON n.y = w.y AND n.x = w.x AND n.component = w.component GROUP BY w.y, w.x, w.component, w.w)"""


def _start(spark, sf):
    p = fx.pixels_emb(spark, sf)
    w = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: 0.5 + j * F.lit(0.25) + (F.col("x") % 3) * F.lit(0.1))
    return p.withColumn("w", w), fx.label_spectra(spark, sf, 3)


@query("nmf_mu_step_w", "SELECT y, x, component, round(w, 6) AS w FROM w1", STEP_SQL)
def _(spark, sf):
    w, _h = M.nmf_mu_step(*_start(spark, sf))
    return w.select("y", "x", F.posexplode("w").alias("component", "w")).withColumn("w", rnd("w"))


@query("nmf_mu_step_h", """
SELECT h.component, h.channel, round(h.value * n.v / (d.v + 1e-8), 6) AS value FROM h3 h
JOIN (SELECT component, channel, sum(w * value) AS v FROM w1 JOIN vox USING (y, x) GROUP BY ALL) n ON n.component = h.component AND n.channel = h.channel
JOIN (SELECT a.i AS component, channel, sum(a.v * h3.value) AS v FROM (SELECT p.component AS i, q.component AS j, sum(p.w * q.w) AS v FROM w1 p JOIN w1 q USING (y, x) GROUP BY ALL) a JOIN h3 ON h3.component = a.j GROUP BY ALL) d
  ON d.component = h.component AND d.channel = h.channel""", STEP_SQL)
def _(spark, sf):
    _w, h = M.nmf_mu_step(*_start(spark, sf))
    return h.select("component", "channel", rnd("value", "value"))


def _check_step(spark, sf):
    """One iteration of the distributed loop, which must equal the expression form."""
    p, h = _start(spark, sf)
    return M.nmf(p, 3, spectra=h, w0="w", max_iter=1, track_error_every=1)


@query("nmf_one_iteration", """
SELECT h.component, h.channel, round(h.value * n.v / (d.v + 1e-8), 6) AS value FROM h3 h
JOIN (SELECT component, channel, sum(w * value) AS v FROM w1 JOIN vox USING (y, x) GROUP BY ALL) n ON n.component = h.component AND n.channel = h.channel
JOIN (SELECT a.i AS component, channel, sum(a.v * h3.value) AS v FROM (SELECT p.component AS i, q.component AS j, sum(p.w * q.w) AS v FROM w1 p JOIN w1 q USING (y, x) GROUP BY ALL) a JOIN h3 ON h3.component = a.j GROUP BY ALL) d
  ON d.component = h.component AND d.channel = h.channel""", STEP_SQL)
def _(spark, sf):
    out = _check_step(spark, sf).spectra
    return out.select("component", F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))


def _report(fit):
    return fit.report.select(
        *FIELD, "algorithm", "n_iter", "n_pixels", "active_pixels", rnd("final_error", "final_error"),
        rnd("relative_error", "relative_error"), F.size("history").alias("n_checks"),
        F.forall(F.sequence(F.lit(2), F.greatest(F.size("history"), F.lit(2))),
                 lambda i: (i > F.size("history")) | (F.try_element_at("history", i) <= F.try_element_at("history", i - 1) * (1 + 1e-9))).alias("monotone"),
    )


@query("nmf_mu")
def _(spark, sf):
    return _report(M.nmf_mu(fx.pixels_ord(spark, sf), 3, max_iter=12, track_error_every=3, patience=3))


@query("nmf_cd")
def _(spark, sf):
    return _report(M.nmf_cd(fx.pixels_ord(spark, sf), 3))


@query("nmf_seeded")
def _(spark, sf):
    p = fx.pixels_emb(spark, sf)
    h = fx.label_spectra(spark, sf, 3)
    w = U.nnls_fixed_h(p, h, keep=["spectrum"])
    return _report(M.nmf_seeded(w, h, 3, max_iter=10, track_error_every=2))


@query("nmf_switches")
def _(spark, sf):
    """W frozen in one run, columns of W normalised in another."""
    p, h = _start(spark, sf)
    a = M.nmf(p, 3, spectra=h, w0="w", update_w=False, max_iter=4, track_error_every=1)
    b = M.nmf(p, 3, spectra=h, w0="w", normalize_w_columns=True, max_iter=4, track_error_every=1)
    sums = lambda f, n: f.abundance.select(F.posexplode("w").alias("component", "w")).groupBy("component").agg(rnd(F.sum("w"), n))
    return sums(a, "frozen_sum").join(sums(b, "normalized_sum"), "component")


@query("pca")
def _(spark, sf):
    fit = M.pca(fx.pixels_ord(spark, sf), 3)
    s = fit.abundance.select(*FIELD, F.posexplode("w").alias("component", "w"))
    return s.groupBy(*FIELD, "component").agg(
        rnd(F.min("w"), "low"), rnd(F.max("w"), "high"), rnd(F.avg("w"), "mean"), F.count(F.lit(1)).alias("n"))


@query("pca_trace", """
SELECT image_id, slice_id, CAST(count(*) AS INT) AS n_kept, round(CAST(count(*) AS DOUBLE), 6) AS trace FROM (SELECT image_id, slice_id, channel, stddev_pop(value) AS s FROM ordvox GROUP BY ALL) WHERE s > 0 GROUP BY ALL""")
def _(spark, sf):
    rep = M.pca(fx.pixels_ord(spark, sf), 3).report
    return rep.select(*FIELD, F.size("history").alias("n_kept"), rnd(A.total("history"), "trace"))


@query("pca_two_channels", """
SELECT image_id, slice_id, y, x, round((s1 - least(m1, 0)) * 65535 / greatest(x1 - least(m1, 0), x2 - least(m2, 0)), 4) AS pc1, round((s2 - least(m2, 0)) * 65535 / greatest(x1 - least(m1, 0), x2 - least(m2, 0)), 4) AS pc2
FROM (SELECT *, min(s1) OVER p AS m1, min(s2) OVER p AS m2, max(s1) OVER p AS x1, max(s2) OVER p AS x2 FROM (
  SELECT image_id, slice_id, y, x, (a + CASE WHEN r >= 0 THEN b ELSE -b END) AS s1, (a - CASE WHEN r >= 0 THEN b ELSE -b END) * CASE WHEN r >= 0 THEN 1 ELSE 1 END AS s2 FROM (
    SELECT q.image_id, q.slice_id, q.y, q.x, (q.a - avg(q.a) OVER p) / stddev_pop(q.a) OVER p AS a, (q.b - avg(q.b) OVER p) / stddev_pop(q.b) OVER p AS b, corr(q.a, q.b) OVER p AS r
    FROM two q WINDOW p AS (PARTITION BY image_id))) WINDOW p AS (PARTITION BY image_id))""", """
two AS (SELECT image_id, slice_id, y, x, spectrum[1] AS a, spectrum[1] * 2 + spectrum[2] AS b FROM ordpix)""")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf).withColumn(
        "spectrum", F.array(F.element_at("spectrum", 1), F.element_at("spectrum", 1) * 2 + F.element_at("spectrum", 2)))
    w = M.pca(p, 2).abundance
    return w.select(*PIXEL, F.round(F.element_at("w", 1), 4).alias("pc1"), F.round(F.element_at("w", 2), 4).alias("pc2"))
