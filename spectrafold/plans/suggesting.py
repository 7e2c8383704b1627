"""Queries over automatic region suggestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import neighborhood as N
from ..operators import stats as S
from ..operators import suggest as G
from ..scale import materialize, top_n
from ..tables import FIELD, PIXEL
from . import fixtures as fx
from .registry import query
from .sourcing import rnd


def field(spark, sf):
    return fx.pixels_ord(spark, sf).select(*PIXEL, A.total("spectrum").alias("value"))


@query("response_map_unblurred", """
SELECT image_id, slice_id, y, x, round(least(value / q, 1), 6) AS value FROM (SELECT image_id, slice_id, y, x, sum(value) AS value FROM ordvox GROUP BY ALL)
JOIN (SELECT image_id, quantile_cont(v, 0.995) AS q FROM (SELECT image_id, y, x, sum(value) AS v FROM ordvox GROUP BY ALL HAVING sum(value) > 0) GROUP BY ALL) USING (image_id)""")
def _(spark, sf):
    f = field(spark, sf)
    return G.response_map(f, N.field_shape(f), 0.0).withColumn("value", rnd("value"))


@query("response_map")
def _(spark, sf):
    f = field(spark, sf)
    r = G.response_map(f, N.field_shape(f), 2.0)
    return r.groupBy(*FIELD).agg(rnd(F.min("value"), "low"), rnd(F.max("value"), "high"), rnd(F.avg("value"), "mean"))


@query("balanced_projection")
def _(spark, sf):
    p = materialize(fx.pixels_ord(spark, sf))
    r = G.balanced_projection(p, N.field_shape(p), 2.0)
    return r.groupBy(*FIELD).agg(rnd(F.min("value"), "low"), rnd(F.max("value"), "high"), rnd(F.avg("value"), "mean"))


@query("connected_regions", """
SELECT image_id, slice_id, y, x, root AS region FROM (
  WITH RECURSIVE m AS (SELECT image_id, slice_id, y, x, CAST(y AS BIGINT) * 2147483648 + x AS code FROM (SELECT image_id, slice_id, y, x, sum(value) AS v FROM ordvox GROUP BY ALL) WHERE v > 110),
  e AS (SELECT a.image_id, a.code AS a, b.code AS b FROM m a JOIN m b ON a.image_id = b.image_id AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
  reach AS (SELECT image_id, code AS a, code AS b FROM m UNION SELECT r.image_id, r.a, e.b FROM reach r JOIN e ON e.image_id = r.image_id AND e.a = r.b)
  SELECT m.image_id, m.slice_id, m.y, m.x, min(reach.b) AS root FROM m JOIN reach ON reach.image_id = m.image_id AND reach.a = m.code GROUP BY ALL)""")
def _(spark, sf):
    return G.connected_regions(field(spark, sf).filter("value > 110"), tile=16)


@query("extract_candidates")
def _(spark, sf):
    f = field(spark, sf)
    shape = N.field_shape(f)
    return G.extract_candidates(G.response_map(f, shape, 2.0), shape, G.Settings(bin_factor=2)).withColumn("score", rnd("score"))


@query("multiband_candidates")
def _(spark, sf):
    p = fx.pixels_ord(spark, sf)
    return G.multiband_candidates(p, N.field_shape(p), G.Settings(background_sigma=2.0), 3).withColumn("score", rnd("score"))


@query("suggest_rois")
def _(spark, sf):
    return G.suggest_rois(fx.pixels_emb(spark, sf), G.Settings(background_sigma=2.0, padding=1), fx.rois(spark)).withColumn("score", rnd("score"))


@query("suggest_rois_greedy")
def _(spark, sf):
    st = G.Settings(background_sigma=2.0, padding=1, hierarchical=False, max_rois_per_group=2, projection_mode="max")
    return G.suggest_rois(fx.pixels_ord(spark, sf), st).withColumn("score", rnd("score"))


BOX_SQL = """
bx AS (SELECT 'b' || (l_suppkey % 5) AS image_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS box_id, CAST(l_partkey % 90 AS INT) AS y, CAST(l_orderkey % 80 AS INT) AS x, CAST(4 + l_quantity % 16 AS INT) AS h, CAST(4 + l_linenumber AS INT) AS w FROM lineitem)"""


@query("scale_boxes", """
SELECT image_id, box_id, greatest(0, y * 3 - 4) AS y, greatest(0, x * 3 - 4) AS x, greatest(1, least(300, (y + h) * 3 + 4) - greatest(0, y * 3 - 4)) AS h, greatest(1, least(260, (x + w) * 3 + 4) - greatest(0, x * 3 - 4)) AS w FROM bx""", BOX_SQL)
def _(spark, sf):
    b = fx.table(spark, sf, "lineitem").selectExpr(
        "concat('b', l_suppkey % 5) AS image_id", "l_orderkey * 8 + l_linenumber AS box_id", "CAST(l_partkey % 90 AS INT) AS y", "CAST(l_orderkey % 80 AS INT) AS x",
        "CAST(4 + l_quantity % 16 AS INT) AS h", "CAST(4 + l_linenumber AS INT) AS w", "300 AS ny", "260 AS nx")
    return G.scale_boxes(b, 3, 4).drop("ny", "nx")


@query("cap_per_group", """
SELECT image_id, box_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rn FROM (
  SELECT 'b' || (l_suppkey % 5) AS image_id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) * 100 + l_suppkey % 100 AS box_id, l_extendedprice AS score, l_partkey FROM lineitem)) WHERE rn <= 7""")
def _(spark, sf):
    b = fx.table(spark, sf, "lineitem").selectExpr(
        "concat('b', l_suppkey % 5) AS image_id", "(l_orderkey * 8 + l_linenumber) * 100 + l_suppkey % 100 AS box_id", "l_extendedprice AS score")
    return top_n(b, ["image_id"], [F.desc("score"), F.asc("box_id")], 7, 7, spread=("box_id",))


@query("candidate_spectra", """
SELECT image_id, slice_id, candidate, channel, round(avg(value), 6) AS value FROM vox, (VALUES (0, 2, 3, 4, 5), (1, 10, 0, 3, 9), (2, 15, 20, 9, 9)) b(candidate, by0, bx0, h, w)
WHERE y >= by0 AND y < by0 + h AND x >= bx0 AND x < bx0 + w GROUP BY ALL""")
def _(spark, sf):
    boxes = spark.createDataFrame([("emb", 0, 0, 2, 3, 4, 5), ("emb", 0, 1, 10, 0, 3, 9), ("emb", 0, 2, 15, 20, 9, 9)],
                                  "image_id STRING, slice_id INT, candidate INT, y INT, x INT, h INT, w INT")
    out = G.candidate_spectra(fx.pixels_emb(spark, sf), boxes)
    return out.select(*FIELD, "candidate", F.posexplode("spectrum").alias("channel", "value")).withColumn("value", rnd("value"))
