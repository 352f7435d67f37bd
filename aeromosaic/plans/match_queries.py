"""Pair, matching and chain queries with their check SQL."""

from pyspark.sql import functions as F

from aeromosaic.functions.distance import hamming_distance, l2_distance
from aeromosaic.functions.ordering import settle
from aeromosaic.operators import chain as ch
from aeromosaic.operators import match as mt
from aeromosaic.operators import pairs as pr
from aeromosaic.plans import workload as wl


def _pairs(spark, sf_dir):
    return pr.window_pairs(wl.keypoint_frames(spark, sf_dir), wl.WINDOW)


def _nearest(spark, sf_dir):
    return mt.block_nearest(_pairs(spark, sf_dir), wl.keypoints(spark, sf_dir))


def _passing(spark, sf_dir):
    return mt.ratio_test(mt.knn2(_nearest(spark, sf_dir)), wl.RATIO)


def matches(spark, sf_dir):
    return mt.mutual(_passing(spark, sf_dir))


def pair_best(spark, sf_dir):
    return mt.best_detector(_pairs(spark, sf_dir), mt.pair_scores(matches(spark, sf_dir)))


def _hops(spark, sf_dir):
    return ch.next_hops(pair_best(spark, sf_dir), wl.MIN_MATCHES, wl.WINDOW)


def walks(spark, sf_dir, revisit=False):
    hops = settle(_hops(spark, sf_dir))
    return ch.chain(wl.keypoint_frames(spark, sf_dir), hops, revisit)


def _chain_links(spark, sf_dir):
    best = settle(pair_best(spark, sf_dir))
    hops = ch.next_hops(best, wl.MIN_MATCHES, wl.WINDOW)
    linked = ch.chain(wl.keypoint_frames(spark, sf_dir), hops)
    return ch.chain_links(linked, best, wl.MIN_MATCHES)


def _segments(spark, sf_dir):
    hops = settle(_hops(spark, sf_dir))
    return ch.segments(settle(ch.chain(wl.keypoint_frames(spark, sf_dir), hops)), hops)


def _candidates(spark, sf_dir, detector, distance):
    """The two nearest of each pair of blocks, both directions, with their distance taken again."""
    kps = settle(wl.keypoints(spark, sf_dir).where(F.col("detector") == detector))
    found = mt.block_nearest(_pairs(spark, sf_dir), kps, size=16)
    here = kps.select(F.col("frame_idx").alias("f"), F.col("kp_id").alias("src_kp"), "descriptor", "bits")
    there = kps.select(
        F.col("frame_idx").alias("g"), F.col("kp_id").alias("dst_kp"),
        F.col("descriptor").alias("descriptor2"), F.col("bits").alias("bits2"),
    )
    forward = F.col("dir") == 0
    sides = found.drop("distance", "error").withColumns(
        {"f": F.when(forward, F.col("i")).otherwise(F.col("j")), "g": F.when(forward, F.col("j")).otherwise(F.col("i"))}
    )
    both = sides.join(here, ["f", "src_kp"]).join(there, ["g", "dst_kp"])
    return both.select("i", "j", "dir", "src_kp", "dst_kp", distance.alias("distance"))


def _l2(spark, sf_dir):
    return _candidates(spark, sf_dir, "blob", F.round(l2_distance("descriptor", "descriptor2"), 6))


def _hamming(spark, sf_dir):
    return _candidates(spark, sf_dir, "corner", hamming_distance("bits", "bits2"))


def _report(spark, sf_dir):
    names = wl.keypoint_frames(spark, sf_dir).select(
        "frame_idx", F.concat(F.lit("frame-"), F.col("frame_idx").cast("string")).alias("name")
    )
    return mt.match_report(pair_best(spark, sf_dir), wl.MIN_MATCHES, names)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _scores(spark, sf_dir):
    return _rounded(mt.pair_scores(matches(spark, sf_dir)), "mean_distance", "score")


def _chain_keypoints(spark, sf_dir):
    """How many keypoints of each detector the frames of each strip bring along."""
    rows = ch.chain_rows(walks(spark, sf_dir), wl.keypoints(spark, sf_dir).select("frame_idx", "detector"))
    return rows.groupBy("strip_id", "pos", "frame_idx", "detector").agg(F.count("*").alias("n"))


QUERIES = {
    "p1_adjacent_pairs": lambda s, d: pr.adjacent_pairs(wl.keypoint_frames(s, d)),
    "p2_all_pairs": lambda s, d: pr.all_pairs(wl.keypoint_frames(s, d)),
    "p3_window_pairs": _pairs,
    "m1_comparable": lambda s, d: mt.comparable(_pairs(s, d), wl.keypoints(s, d)),
    "m2_l2_distance": _l2,
    "m3_hamming_distance": _hamming,
    "m4_knn2": lambda s, d: _rounded(mt.knn2(_nearest(s, d)), "distance"),
    "m5_ratio_test": lambda s, d: _rounded(_passing(s, d), "distance"),
    "m6_mutual": lambda s, d: _rounded(matches(s, d), "distance"),
    "m7_pair_scores": _scores,
    "m8_best_detector": lambda s, d: _rounded(pair_best(s, d), "score"),
    "m9_match_blocks": lambda s, d: _rounded(
        mt.mutual(
            mt.ratio_test(
                mt.knn2(mt.block_nearest(_pairs(s, d), wl.keypoints(s, d), size=16)), wl.RATIO
            )
        ),
        "distance",
    ),
    "m10_match_report": lambda s, d: mt.match_report(pair_best(s, d), wl.MIN_MATCHES),
    "m10_named_report": _report,
    "c1_next_hops": lambda s, d: _hops(s, d),
    "c2_strip_roots": lambda s, d: ch.strip_roots(wl.keypoint_frames(s, d), _hops(s, d)),
    "c3_chain": lambda s, d: walks(s, d),
    "c3_segments": _segments,
    "c3_chain_revisit": lambda s, d: walks(s, d, revisit=True),
    "c4_chain_links": _chain_links,
    "c5_chain_rows": _chain_keypoints,
}

_PAIRS = """,
pairs AS (SELECT a.frame_idx AS i, b.frame_idx AS j FROM frames a
          JOIN frames b ON b.frame_idx > a.frame_idx AND b.frame_idx <= a.frame_idx + 3)
"""
_KNN = (
    _PAIRS
    + """,
dist AS (
  SELECT i, j, 'blob' AS detector, a.k AS q, b.k AS t, list_distance(a.d, b.d) AS distance
  FROM pairs JOIN kp a ON a.f = i JOIN kp b ON b.f = j
  UNION ALL
  SELECT i, j, 'corner', a.k, b.k,
         CAST(list_sum(list_transform(range(1, 65),
              lambda n: CASE WHEN a.s[n] = b.s[n] THEN 0 ELSE 1 END)) AS DOUBLE)
  FROM pairs JOIN kp a ON a.f = i JOIN kp b ON b.f = j),
both_ways AS (
  SELECT i, j, detector, 0 AS dir, q AS src_kp, t AS dst_kp, distance FROM dist
  UNION ALL SELECT i, j, detector, 1, t, q, distance FROM dist),
ranked AS (
  SELECT *, row_number() OVER near AS rank, lead(distance) OVER near AS second FROM both_ways
  WINDOW near AS (PARTITION BY i, j, detector, dir, src_kp ORDER BY distance, dst_kp)),
passing AS (
  SELECT i, j, detector, dir, src_kp, dst_kp, distance FROM ranked
  WHERE rank = 1 AND distance < 0.95 * second),
matches AS (
  SELECT f.i, f.j, f.detector, f.src_kp AS q_kp, f.dst_kp AS t_kp, f.distance
  FROM passing f SEMI JOIN (SELECT * FROM passing WHERE dir = 1) b
    ON f.i = b.i AND f.j = b.j AND f.detector = b.detector
   AND f.src_kp = b.dst_kp AND f.dst_kp = b.src_kp
  WHERE f.dir = 0),
scores AS (
  SELECT i, j, detector, count(*) AS n_matches, avg(distance) AS mean_distance,
         count(*) / (1 + avg(distance)) AS score
  FROM matches GROUP BY ALL),
best AS (
  SELECT i, j, detector, coalesce(n_matches, 0) AS n_matches, coalesce(score, 0) AS score
  FROM pairs LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY score DESC, detector) AS place
    FROM scores) USING (i, j)
  WHERE coalesce(place, 1) = 1),
hops AS (SELECT i, min(j) AS j FROM best WHERE n_matches >= 7 GROUP BY i),
roots AS (SELECT frame_idx FROM frames WHERE frame_idx NOT IN (SELECT j FROM hops)),
walk AS (
  SELECT frame_idx AS strip_id, 0 AS pos, frame_idx FROM roots
  UNION ALL
  SELECT strip_id, pos + 1, j FROM walk JOIN hops ON i = frame_idx),
owned AS (
  SELECT strip_id, CAST(row_number() OVER (PARTITION BY strip_id ORDER BY frame_idx) - 1 AS INT)
         AS pos, frame_idx
  FROM (SELECT min(strip_id) AS strip_id, frame_idx FROM walk GROUP BY frame_idx))
"""
)


def _sql(body, final):
    return f"WITH RECURSIVE {wl.KEYPOINTS_SQL}{body} {final}"


_MATCHES = "SELECT i, j, detector, q_kp, t_kp, round(distance, 6) AS distance FROM matches"
_BLOCKS = """SELECT i, j, dir, src_kp, dst_kp, {distance} AS distance
  FROM (SELECT *, row_number() OVER (PARTITION BY i, j, dir, src_kp, dst_kp // 16
                                     ORDER BY distance, dst_kp) AS place
        FROM both_ways WHERE detector = '{detector}') WHERE place <= 2"""

ORACLES = {
    "p1_adjacent_pairs": _sql(
        "",
        "SELECT i, j FROM (SELECT frame_idx AS i, lead(frame_idx) OVER (ORDER BY frame_idx) AS j"
        " FROM frames) WHERE j IS NOT NULL",
    ),
    "p2_all_pairs": _sql(
        "",
        "SELECT a.frame_idx AS i, b.frame_idx AS j FROM frames a JOIN frames b"
        " ON a.frame_idx < b.frame_idx",
    ),
    "p3_window_pairs": _sql(_PAIRS, "SELECT i, j FROM pairs"),
    "m1_comparable": _sql(
        _PAIRS
        + """, n AS (SELECT f, count(*) AS n FROM kp GROUP BY f),
        kinds AS (SELECT 'blob' AS detector, 64 AS dim, 0 AS words
                  UNION ALL SELECT 'corner', 0, 2)""",
        "SELECT i, j, detector, dim, words, a.n AS n_i, b.n AS n_j"
        " FROM pairs JOIN n a ON a.f = i JOIN n b ON b.f = j CROSS JOIN kinds",
    ),
    "m2_l2_distance": _sql(_KNN, _BLOCKS.format(detector="blob", distance="round(distance, 6)")),
    "m3_hamming_distance": _sql(_KNN, _BLOCKS.format(detector="corner", distance="distance")),
    "m4_knn2": _sql(
        _KNN,
        "SELECT i, j, detector, dir, src_kp, dst_kp, round(distance, 6) AS distance,"
        " CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 2",
    ),
    "m5_ratio_test": _sql(
        _KNN,
        "SELECT i, j, detector, dir, src_kp, dst_kp, round(distance, 6) AS distance FROM passing",
    ),
    "m6_mutual": _sql(_KNN, _MATCHES),
    "m7_pair_scores": _sql(
        _KNN,
        "SELECT i, j, detector, n_matches, round(mean_distance, 6) AS mean_distance,"
        " round(score, 6) AS score FROM scores",
    ),
    "m8_best_detector": _sql(
        _KNN,
        "SELECT i, j, detector, n_matches, round(score, 6) AS score, 'ok' AS status FROM best",
    ),
    "m9_match_blocks": _sql(_KNN, _MATCHES),
    "m10_match_report": _sql(
        _KNN,
        """SELECT i, j, CASE WHEN grouping(i) = 1 THEN 'TOTAL'
             WHEN sum(CAST(n_matches >= 7 AS INT)) > 0 THEN 'VALID'
             ELSE 'INSUFFICIENT' END AS verdict,
           CAST(sum(n_matches) AS BIGINT) AS n_matches,
           CAST(sum(CAST(n_matches >= 7 AS INT)) AS BIGINT) AS valid_pairs, count(*) AS n_pairs
         FROM best GROUP BY GROUPING SETS ((i, j), ())""",
    ),
    "m10_named_report": _sql(
        _KNN,
        """SELECT i, j, 'frame-' || i AS name_i, 'frame-' || j AS name_j, CASE WHEN grouping(i) = 1 THEN 'TOTAL'
             WHEN sum(CAST(n_matches >= 7 AS INT)) > 0 THEN 'VALID'
             ELSE 'INSUFFICIENT' END AS verdict,
           CAST(sum(n_matches) AS BIGINT) AS n_matches,
           CAST(sum(CAST(n_matches >= 7 AS INT)) AS BIGINT) AS valid_pairs, count(*) AS n_pairs
         FROM best GROUP BY GROUPING SETS ((i, j), ())""",
    ),
    "c1_next_hops": _sql(_KNN, "SELECT i, j FROM hops"),
    "c2_strip_roots": _sql(_KNN, "SELECT frame_idx FROM roots"),
    "c3_chain": _sql(_KNN, "SELECT strip_id, pos, frame_idx FROM owned"),
    "c3_segments": _sql(
        _KNN,
        """SELECT l.strip_id, n_frames, o.strip_id AS next_strip, o.pos AS entry
           FROM (SELECT strip_id, max(frame_idx) AS f, count(*) AS n_frames FROM owned GROUP BY 1) l
           LEFT JOIN hops h ON h.i = l.f LEFT JOIN owned o ON o.frame_idx = h.j""",
    ),
    "c3_chain_revisit": _sql(_KNN, "SELECT strip_id, pos, frame_idx FROM walk"),
    "c4_chain_links": _sql(
        _KNN,
        """SELECT a.strip_id, a.pos, a.frame_idx AS i, b.frame_idx AS j, detector, n_matches,
                  n_matches IS NULL AS broken
           FROM owned a JOIN owned b ON a.strip_id = b.strip_id AND b.pos = a.pos + 1
           LEFT JOIN (SELECT * FROM best WHERE n_matches >= 7) m
             ON m.i = a.frame_idx AND m.j = b.frame_idx""",
    ),
    "c5_chain_rows": _sql(
        _KNN,
        """SELECT strip_id, pos, frame_idx, detector, count(*) AS n
           FROM owned JOIN kp ON f = frame_idx
           CROSS JOIN (SELECT unnest(['blob', 'corner']) AS detector) GROUP BY ALL""",
    ),
}
