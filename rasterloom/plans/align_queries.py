"""Star alignment of many pairs of frames at once (A19, G9, J5, J6): parts stand for the stars of some frames, and turned, shifted and thinned copies for their partners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.operators import calibrate
from rasterloom.plans.registry import register
from rasterloom.sources.views import table

#: Stars of frame k % 8, and their places in frame 100 + k % 8. Frame 106 has stars of its own, frame 107 too few.
X, Y, FRAMES = "k * 7919 % 1009 * 1e0", "k * 10473 % 719 * 1e0", "k % 8"
ANGLE = "(0.01e0 * (k % 8 + 1))"
X2 = f"CASE WHEN k % 8 = 6 THEN k * 523 % 887 * 1e0 ELSE cos{ANGLE} * {X} - sin{ANGLE} * {Y} + 5 + k % 8 + (k % 3 - 1) * 0.1e0 END"
Y2 = f"CASE WHEN k % 8 = 6 THEN k * 311 % 641 * 1e0 ELSE sin{ANGLE} * {X} + cos{ANGLE} * {Y} - 3 + (k % 5 - 2) * 0.1e0 END"
RANKED = "SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, k) AS INT) AS star, x, y FROM ({both}) t"
BOTH = f"SELECT k, {FRAMES} AS frame_id, {X} AS x, {Y} AS y, k * 31 % 1013 AS flux FROM {{part}} p UNION ALL SELECT k, 100 + {FRAMES}, {X2}, {Y2}, k * 31 % 1013 FROM {{part}} q WHERE k % 7 <> 3 AND (k % 8 <> 7 OR k < 16)"


def stars(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey AS k")
    return spark.sql(RANKED.replace("{both}", BOTH), part=part)


_M = calibrate.DRAW
_SQL = f"""
WITH st AS ({RANKED.replace('{both}', BOTH.replace('{part}', '(SELECT p_partkey AS k FROM part)'))}),
lead_ AS (SELECT frame_id, count(*) AS n, arg_min(x, star) AS lx, arg_min(y, star) AS ly FROM st GROUP BY frame_id HAVING count(*) >= 3),
pair AS (SELECT r.frame_id AS rf, t.frame_id AS tf, t.lx - r.lx AS ox, t.ly - r.ly AS oy FROM lead_ r JOIN lead_ t ON t.frame_id = r.frame_id + 100),
s AS (SELECT * FROM st WHERE star <= 30),
tri AS (SELECT frame_id, list_sort([[-bc, a], [-ca, b], [-ab, c]]) AS v FROM (
  SELECT p.frame_id, p.star AS a, q.star AS b, r.star AS c, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS ab, sqrt(pow(q.x - r.x, 2) + pow(q.y - r.y, 2)) AS bc, sqrt(pow(r.x - p.x, 2) + pow(r.y - p.y, 2)) AS ca
  FROM s p JOIN s q ON q.frame_id = p.frame_id AND p.star < q.star JOIN s r ON r.frame_id = p.frame_id AND q.star < r.star) WHERE ab >= 4 AND bc >= 4 AND ca >= 4),
t2 AS (SELECT frame_id, [v[1][2], v[2][2], v[3][2]] AS v, v[2][1] / v[1][1] AS r1, v[3][1] / v[1][1] AS r2 FROM tri),
hit AS (SELECT rf, tf, unnest(r.v) AS ref, unnest(t.v) AS tgt FROM pair JOIN t2 r ON r.frame_id = rf JOIN t2 t ON t.frame_id = tf AND abs(r.r1 - t.r1) < 0.025e0 AND abs(r.r2 - t.r2) < 0.025e0),
vote AS (SELECT rf, tf, ref, tgt, count(*) AS votes FROM hit GROUP BY ALL),
m AS (SELECT v.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, sum(votes) OVER (PARTITION BY rf, tf ORDER BY ref, tgt ROWS UNBOUNDED PRECEDING) AS upto FROM vote v JOIN st a ON a.frame_id = rf AND a.star = ref JOIN st b ON b.frame_id = tf AND b.star = tgt),
d AS (SELECT rf, tf, draw, (draw * {_M[0]} % {calibrate.PRIME} * {_M[1]} % {calibrate.PRIME}) % total AS i, (draw * {_M[1]} % {calibrate.PRIME} * {_M[0]} % {calibrate.PRIME}) % total AS j FROM (SELECT rf, tf, CAST(sum(votes) AS BIGINT) AS total FROM m GROUP BY rf, tf HAVING sum(votes) >= 3), range(1, 101) r(draw)),
e AS (SELECT d.rf, d.tf, draw, p.ax, p.ay, p.bx, p.b_y, q.ax - p.ax AS dx, q.ay - p.ay AS dy, q.bx - p.bx AS ex, q.b_y - p.b_y AS ey FROM d JOIN m p ON p.rf = d.rf AND p.tf = d.tf AND i >= p.upto - p.votes AND i < p.upto JOIN m q ON q.rf = d.rf AND q.tf = d.tf AND j >= q.upto - q.votes AND j < q.upto),
f AS (SELECT rf, tf, draw, ax, ay, bx, b_y, (ex * dx + ey * dy) / (dx * dx + dy * dy) AS c, (ey * dx - ex * dy) / (dx * dx + dy * dy) AS s FROM e WHERE dx * dx + dy * dy >= 1e-4),
g AS (SELECT rf, tf, draw, c, s, bx - (c * ax - s * ay) AS tx, b_y - (s * ax + c * ay) AS ty FROM f),
n AS (SELECT g.rf, g.tf, draw, c, s, tx, ty, sum(votes) AS inliers FROM g JOIN m ON m.rf = g.rf AND m.tf = g.tf WHERE sqrt(pow(c * ax - s * ay + tx - bx, 2) + pow(s * ax + c * ay + ty - b_y, 2)) < 2.5e0 GROUP BY ALL),
o AS (SELECT * FROM n WHERE inliers >= 3 QUALIFY row_number() OVER (PARTITION BY rf, tf ORDER BY inliers DESC, draw) = 1)
SELECT pair.rf AS ref_frame, pair.tf AS tgt_frame, round(coalesce(c, 1), 4) AS m00, round(coalesce(-s, 0), 4) AS m01, round(coalesce(tx, ox), 3) AS tx, round(coalesce(s, 0), 4) AS m10, round(coalesce(c, 1), 4) AS m11, round(coalesce(ty, oy), 3) AS ty, CAST(coalesce(inliers, 0) AS BIGINT) AS inliers
FROM pair LEFT JOIN o ON o.rf = pair.rf AND o.tf = pair.tf"""


@register("g09_align", _SQL)
def g09_align(spark: SparkSession, d: str) -> DataFrame:
    """Transforms of all pairs of frames in one query."""
    s = stars(spark, d)
    pairs = s.select("frame_id").distinct().where("frame_id < 100").selectExpr("frame_id AS ref_frame", "frame_id + 100 AS tgt_frame")
    return calibrate.align(s, pairs).selectExpr("ref_frame", "tgt_frame", *[f"round({k}, {3 if k[0] == 't' else 4}) AS {k}" for k in calibrate.TRANSFORM], "inliers")
