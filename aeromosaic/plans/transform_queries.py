"""Transform queries with their check SQL."""

import math

from pyspark.sql import functions as F

from aeromosaic.functions import solve
from aeromosaic.functions.ordering import settle
from aeromosaic.operators import transform as tr
from aeromosaic.plans import match_queries as mq
from aeromosaic.plans import workload as wl



def _correspondences(spark, sf_dir):
    best = settle(mq.pair_best(spark, sf_dir)).where(F.col("n_matches") >= wl.MIN_MATCHES)
    return tr.correspondences(best, mq.matches(spark, sf_dir), wl.keypoints(spark, sf_dir))


def _lines(spark, sf_dir, hard=False):
    """Correspondences are read by several steps, so they are derived once."""
    return settle(wl.line_correspondences(spark, sf_dir, hard))


def _affine(spark, sf_dir, hard=False):
    return tr.affine_ransac(_lines(spark, sf_dir, hard))


def _entries(df, *columns):
    """The six affine entries, rounded, with negative zero made zero."""
    six = [(F.round(F.col("h")[k], 4) + 0.0).alias(f"h{k}") for k in range(6)]
    return df.select("i", "j", *columns, *six)


def _homography(spark, sf_dir):
    points = settle(wl.tilted_correspondences(spark, sf_dir))
    found = tr.homography_ransac(points)
    better = tr.refit(points, found, "homography").withColumnRenamed("h", "refined")
    h = F.col("refined")
    whole = [(F.round(h[k] * (1e6 if k > 5 else 1), 0 if k > 5 else 4) + 0.0).alias(f"h{k}") for k in range(8)]
    return found.join(better, ["i", "j"]).select("i", "j", "n_inliers", *whole)


def _stats(spark, sf_dir):
    points = _lines(spark, sf_dir)
    return tr.inlier_stats(points, tr.affine_ransac(points))


def _refit(spark, sf_dir):
    points = _lines(spark, sf_dir)
    return _entries(tr.refit(points, tr.affine_ransac(points), "affine"))


def _choose(spark, sf_dir):
    homographies, affines = wl.candidates(spark, sf_dir)
    pairs = homographies.select("i", "j")
    return tr.choose_model(pairs, homographies, affines).drop("h")


def _compose(spark, sf_dir):
    poses = tr.compose(settle(wl.event_links(spark, sf_dir, breaks=False)))
    h = F.col("h")
    return poses.where("pos > 0").select(
        "strip_id", "pos", "frame_idx", h[2].cast("int").alias("x"), h[5].cast("int").alias("y")
    )


def _shifts(spark, sf_dir):
    links = wl.event_links(spark, sf_dir, breaks=False)
    return tr.compose_shifts(links).select(
        "strip_id", "pos", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")
    )


def _cut(spark, sf_dir):
    return tr.cut_at_break(wl.event_links(spark, sf_dir)).select("strip_id", "pos", "i", "j")


def _split(spark, sf_dir):
    return tr.split_at_breaks(wl.event_links(spark, sf_dir)).select("strip_id", "pos", "i", "j")


QUERIES = {
    "t1_correspondences": _correspondences,
    "t2_affine_ransac": lambda s, d: _entries(_affine(s, d), "trial", "n_inliers"),
    "t2_affine_hard": lambda s, d: _entries(_affine(s, d, hard=True), "trial", "n_inliers"),
    "t3_homography_ransac": _homography,
    "t4_refit": _refit,
    "t5_inlier_stats": _stats,
    "t6_choose_model": _choose,
    "t7_compose": _compose,
    "t7_compose_shifts": _shifts,
    "t8_cut_at_break": _cut,
    "t8_split_at_breaks": _split,
}



def _mixed(value, turn):
    """The mixing steps of the draws on a column, in the same whole numbers."""
    a, b, c = solve.FACTORS
    x = f"(({value} * {a} + k * {b} + {turn * c + 11}) % {solve.PRIME})"
    x = f"(({x} * {x} + k) % {solve.PRIME})"
    x = f"(({x} * {a} + {turn}) % {solve.PRIME})"
    return f"({x} * {x} % {solve.PRIME})"


_PERMUTED = f"""SELECT i, j, s, t, d, k, a, b, y // b AS l0, y % b AS r0,
    (l0 + {_mixed("r0", 0)}) % a AS l1, (r0 + {_mixed("l1", 1)}) % b AS r1,
    (l1 + {_mixed("r1", 2)}) % a AS l2, (r1 + {_mixed("l2", 3)}) % b AS r2"""


def _round(number, low, high, missed):
    """Draws, hypotheses and scores of the trials low..high-1 of the pairs that still need them."""
    wanted = "SELECT i, j, p, s FROM pool"
    if number:
        wanted += f" LEFT JOIN best{number - 1} USING (i, j) WHERE {missed}"
    return f"""
drawn{number} AS (
  SELECT i, j, s, t, d, t // (s // 3) AS k, t % (s // 3) * 3 + d AS y,
         CAST(ceil(sqrt(s)) AS BIGINT) AS a, (s + a - 1) // a AS b
  FROM ({wanted}) CROSS JOIN (SELECT unnest(range({low}, {high})) AS t)
       CROSS JOIN (SELECT unnest(range(3)) AS d)),
walk{number} AS (
  SELECT i, j, s, t, d, k, a, b, l2 * b + r2 AS y FROM ({_PERMUTED} FROM drawn{number})
  UNION ALL
  SELECT i, j, s, t, d, k, a, b, l2 * b + r2 AS y FROM ({_PERMUTED} FROM walk{number} WHERE y >= s)),
samples{number} AS (
  SELECT i, j, t, max(p[y + 1]) FILTER (d = 0) AS p0, max(p[y + 1]) FILTER (d = 1) AS p1,
         max(p[y + 1]) FILTER (d = 2) AS p2
  FROM walk{number} JOIN pool USING (i, j) WHERE y < walk{number}.s GROUP BY i, j, t),
edges{number} AS (
  SELECT i, j, t, p0, p1[1] - p0[1] AS x1, p2[1] - p0[1] AS x2, p1[2] - p0[2] AS y1,
         p2[2] - p0[2] AS y2, p1[3] - p0[3] AS u1, p2[3] - p0[3] AS u2,
         p1[4] - p0[4] AS v1, p2[4] - p0[4] AS v2
  FROM samples{number}),
linear{number} AS (
  SELECT i, j, t, p0, (u1 * y2 - u2 * y1) / (x1 * y2 - x2 * y1) AS h0,
         (u2 * x1 - u1 * x2) / (x1 * y2 - x2 * y1) AS h1,
         (v1 * y2 - v2 * y1) / (x1 * y2 - x2 * y1) AS h3,
         (v2 * x1 - v1 * x2) / (x1 * y2 - x2 * y1) AS h4
  FROM edges{number} WHERE x1 * y2 - x2 * y1 <> 0),
trial_h{number} AS (
  SELECT i, j, t, h0, h1, p0[3] - h0 * p0[1] - h1 * p0[2] AS h2, h3, h4,
         p0[4] - h3 * p0[1] - h4 * p0[2] AS h5
  FROM linear{number}),
scored{number} AS (
  SELECT i, j, t, any_value(h0) AS h0, any_value(h1) AS h1, any_value(h2) AS h2,
         any_value(h3) AS h3, any_value(h4) AS h4, any_value(h5) AS h5,
         count(*) FILTER ((h0*sx + h1*sy + h2 - dx) * (h0*sx + h1*sy + h2 - dx)
           + (h3*sx + h4*sy + h5 - dy) * (h3*sx + h4*sy + h5 - dy) <= 2.25::DOUBLE) AS n_inliers
  FROM trial_h{number} JOIN corr USING (i, j) GROUP BY i, j, t{
    f" UNION ALL SELECT * FROM best{number - 1}" if number else ""}),
best{number} AS (
  SELECT i, j, t, h0, h1, h2, h3, h4, h5, n_inliers FROM (
    SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY n_inliers DESC, t) AS rank FROM scored{number})
  WHERE rank = 1)"""


def _search(correspondences):
    """Tables fits and close of the affine search over a table corr, round by round."""
    ends = [tr.FIRST_TRIALS]
    while ends[-1] < tr.MAX_TRIALS:
        ends.append(min(ends[-1] * tr.GROWTH, tr.MAX_TRIALS))
    share = "least(pow(coalesce(n_inliers, 0) / s, 3), 1 - 1e-12::DOUBLE)"
    rounds = [
        _round(r, low, high, f"{low} * ln(1 - {share}) > {math.log(1 - tr.CONFIDENCE)!r}::DOUBLE")
        for r, (low, high) in enumerate(zip([0, *ends], ends))
    ]
    return f"""RECURSIVE {correspondences},
pool AS (
  SELECT i, j, list([sx, sy, dx, dy] ORDER BY m, sx, sy, dx, dy) AS p, count(*) AS s
  FROM corr GROUP BY i, j HAVING count(*) >= 3),
{",".join(rounds)},
fits AS (SELECT * FROM best{len(ends) - 1}),
close AS (
  SELECT i, j, sx, sy, dx, dy FROM fits JOIN corr USING (i, j)
  WHERE (h0*sx + h1*sy + h2 - dx) * (h0*sx + h1*sy + h2 - dx)
    + (h3*sx + h4*sy + h5 - dy) * (h3*sx + h4*sy + h5 - dy) <= 2.25::DOUBLE)
"""


_SEARCH = _search(wl.CORRESPONDENCES_SQL)
_SIX = ", ".join(f"round(h{k}, 4) + 0.0::DOUBLE AS h{k}" for k in range(6))

ORACLES = {
    "t1_correspondences": mq._sql(
        mq._KNN,
        """SELECT i, j, q_kp AS m, b.x AS sx, b.y AS sy, a.x AS dx, a.y AS dy
           FROM matches SEMI JOIN (SELECT * FROM best WHERE n_matches >= 7) w
             ON w.i = matches.i AND w.j = matches.j AND w.detector = matches.detector
           JOIN kp a ON a.f = i AND a.k = q_kp JOIN kp b ON b.f = j AND b.k = t_kp""",
    ),
    "t2_affine_ransac": f"WITH {_SEARCH} SELECT i, j, t AS trial, n_inliers, {_SIX} FROM fits",
    "t2_affine_hard": f"""WITH {_search(wl.HARD_CORRESPONDENCES_SQL)}
        SELECT i, j, t AS trial, n_inliers, {_SIX} FROM fits""",
    "t3_homography_ransac": f"""WITH {wl.TILTED_SQL}
        SELECT i, j, n_inliers, {_SIX}, round(h6 * 1e6::DOUBLE, 0) + 0.0::DOUBLE AS h6,
               round(h7 * 1e6::DOUBLE, 0) + 0.0::DOUBLE AS h7 FROM tilted""",
    "t4_refit": f"""WITH {_SEARCH},
        m AS (SELECT i, j, var_pop(sx) AS xx, var_pop(sy) AS yy, covar_pop(sx, sy) AS xy,
                covar_pop(dx, sx) AS ux, covar_pop(dx, sy) AS uy, covar_pop(dy, sx) AS vx,
                covar_pop(dy, sy) AS vy, avg(sx) AS ax, avg(sy) AS ay, avg(dx) AS au, avg(dy) AS av
              FROM close GROUP BY i, j),
        n AS (SELECT *, (ux * yy - uy * xy) / (xx * yy - xy * xy) AS h0,
                (uy * xx - ux * xy) / (xx * yy - xy * xy) AS h1,
                (vx * yy - vy * xy) / (xx * yy - xy * xy) AS h3,
                (vy * xx - vx * xy) / (xx * yy - xy * xy) AS h4 FROM m),
        r AS (SELECT *, au - h0 * ax - h1 * ay AS h2, av - h3 * ax - h4 * ay AS h5 FROM n)
        SELECT i, j, {_SIX} FROM r""",
    "t5_inlier_stats": f"""WITH {_SEARCH}
        SELECT i, j, count(*) AS n_inliers,
               (max(sx) - min(sx)) * (max(sy) - min(sy)) AS spread
        FROM close GROUP BY i, j""",
    "t6_choose_model": f"""WITH {wl.CANDIDATES_SQL},
        w AS (SELECT *, CASE WHEN h_inl >= 20 AND h_spread >= 10000 THEN 'homography'
                WHEN a_inl >= 20 AND a_spread >= 10000 THEN 'affine' ELSE 'broken' END AS model
              FROM cand)
        SELECT i, j, model,
               CASE model WHEN 'homography' THEN h_inl WHEN 'affine' THEN a_inl END AS n_inliers,
               CASE model WHEN 'homography' THEN h_spread WHEN 'affine' THEN a_spread END AS spread
        FROM w""",
    "t7_compose": f"""WITH {wl.LINKS_SQL}
        SELECT strip_id, CAST(pos + 1 AS INT) AS pos, j AS frame_idx,
               CAST(sum(dx) OVER w AS INT) AS x, CAST(sum(dy) OVER w AS INT) AS y
        FROM links WINDOW w AS (PARTITION BY strip_id ORDER BY pos)""",
    "t7_compose_shifts": f"""WITH {wl.LINKS_SQL}
        SELECT strip_id, pos, CAST(sum(dx) OVER w AS INT) AS x, CAST(sum(dy) OVER w AS INT) AS y
        FROM links WINDOW w AS (PARTITION BY strip_id ORDER BY pos)""",
    "t8_cut_at_break": f"""WITH {wl.LINKS_SQL}
        SELECT strip_id, pos, i, j FROM (
          SELECT *, bool_or(broken) OVER (PARTITION BY strip_id ORDER BY pos) AS over FROM links)
        WHERE NOT over""",
    "t8_split_at_breaks": f"""WITH {wl.LINKS_SQL},
        r AS (SELECT *, sum(CAST(broken AS INT)) OVER (PARTITION BY strip_id ORDER BY pos) AS run
              FROM links)
        SELECT first_value(i) OVER w AS strip_id, CAST(row_number() OVER w - 1 AS INT) AS pos, i, j
        FROM r WHERE NOT broken WINDOW w AS (PARTITION BY strip_id, run ORDER BY pos)""",
}
