"""Ordering helpers, chaining, transform search and composition against small models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeromosaic.functions import ordering, solve
from aeromosaic.operators import chain as ch
from aeromosaic.operators import match as mt
from aeromosaic.operators import pairs as pr
from aeromosaic.operators import transform as tr
from rasters import greedy


def test_number_rows(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    rows = ordering.number_rows(df, ["v"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(5000))
    assert all(a.v < b.v for a, b in zip(rows, rows[1:]))


def test_running_sum_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET", 16)
    df = spark.range(300).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 5).alias("v"))
    rows = ordering.running_sum(df, ["k"], "id", {"total": F.col("v")}).collect()
    for r in rows:
        assert r.total == sum(x % 5 for x in range(r.k, r.id + 1, 2))


@pytest.mark.parametrize("threshold", ["1000", "3"])
def test_top_n_with_and_without_salt(spark, threshold):
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        df = spark.range(0, 1000, 1, 6).select(F.lit(1).alias("k"), (F.col("id") * 37 % 1009).alias("v"))
        rows = ordering.top_n(df, ["k"], [F.desc("v")], 8, "rank").orderBy("rank").collect()
    finally:
        spark.conf.set(key, before)
    want = sorted((x * 37 % 1009 for x in range(1000)), reverse=True)[:8]
    assert [(r.rank, r.v) for r in rows] == list(enumerate(want, 1))


@pytest.mark.parametrize("seed", range(3))
def test_chain_equals_the_sequential_walk(spark, seed):
    rng = np.random.default_rng(seed)
    n, skip = 60, 3
    hops = {(i, i + s) for i in range(n) for s in range(1, skip + 1) if i + s < n and rng.random() < 0.3}
    best = spark.createDataFrame([(i, j, 9) for i, j in hops], "i int, j int, n_matches long")
    frames = spark.range(n).select(F.col("id").cast("int").alias("frame_idx"))
    found = ch.next_hops(best, 5, skip)
    want = greedy(n, hops, skip)
    walks = ch.chain(frames, found, revisit=True).orderBy("strip_id", "pos").collect()
    assert [r.frame_idx for r in walks] == want
    first, seen = [], set()
    for r in walks:
        if r.frame_idx not in seen:
            seen.add(r.frame_idx)
            first.append((r.strip_id, r.frame_idx))
    owned = ch.chain(frames, found).orderBy("strip_id", "pos").collect()
    assert [(r.strip_id, r.frame_idx) for r in owned] == first
    assert len(owned) == n
    owned = ch.chain(frames, found)
    parts = ch.segments(owned, found)
    assert parts.count() == len({s for s, _ in first})
    asked = spark.createDataFrame([(walks[0].strip_id,), (walks[-1].strip_id,)], "strip_id int")
    some = ch.full_walks(owned, parts, asked).orderBy("strip_id", "pos").collect()
    assert some == [r for r in walks if r.strip_id in (walks[0].strip_id, walks[-1].strip_id)]


def test_pairs_of_few_frames(spark):
    none, one = spark.createDataFrame([], "frame_idx int"), spark.createDataFrame([(0,)], "frame_idx int")
    for frames in (none, one):
        assert pr.adjacent_pairs(frames).count() == pr.all_pairs(frames).count() == 0
    many = spark.range(9).select(F.col("id").cast("int").alias("frame_idx"))
    assert pr.all_pairs(many).count() == 36


def test_ties_go_to_the_first_detector_and_errors_are_reported(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "i int, j int")
    scores = spark.createDataFrame(
        [(0, 1, "corner", 4, 1.0), (0, 1, "blob", 4, 1.0)],
        "i int, j int, detector string, n_matches long, score double",
    )
    failed = spark.createDataFrame([(1, 2, "bad block")], "i int, j int, error string")
    rows = mt.best_detector(pairs, scores, failed).orderBy("i").collect()
    assert [(r.detector, r.n_matches, r.status) for r in rows] == [
        ("blob", 4, "ok"), (None, 0, "error: bad block"), (None, 0, "ok")
    ]


def test_unequal_descriptors_are_not_compared(spark):
    kps = spark.createDataFrame(
        [(f, "blob", k, 0.0, 0.0, 1.0, [1.0] * (2 + (k if f else 0)), None) for f in (0, 1) for k in (0, 1)],
        "frame_idx int, detector string, kp_id long, x double, y double, response double, "
        "descriptor array<float>, bits array<long>",
    )
    pairs = spark.createDataFrame([(0, 1)], "i int, j int")
    assert mt.comparable(pairs, kps).count() == 0
    even = kps.where("frame_idx = 0")
    both = even.union(even.withColumn("frame_idx", F.lit(1)))
    assert mt.block_nearest(pairs, both).where("error is not null").count() == 0


def test_ragged_descriptors_are_an_error_row(spark):
    kps = spark.createDataFrame(
        [(f, "blob", k, 0.0, 0.0, 1.0, [1.0] * (3 - f * k), None) for f in (0, 1) for k in (0, 1)],
        "frame_idx int, detector string, kp_id long, x double, y double, response double, "
        "descriptor array<float>, bits array<long>",
    )
    pairs = spark.createDataFrame([(0, 1)], "i int, j int")
    nearest = mt.block_nearest(pairs, kps)
    assert nearest.where("error is not null").count() == 1
    (best,) = mt.best_detector(pairs, mt.pair_scores(mt.mutual(mt.ratio_test(mt.knn2(nearest)))), nearest).collect()
    assert best.status.startswith("error: ") and best.n_matches == 0


def _points(spark, h, n, stray, pair=(0, 1), seed=0, noise=0.0):
    rng = np.random.default_rng(seed)
    src = rng.uniform(0, 600, (n, 2))
    dst = np.c_[src, np.ones(n)] @ np.array(h).reshape(3, 3).T
    dst = dst[:, :2] / dst[:, 2:] + rng.normal(0, noise, (n, 2))
    lost = rng.random(n) < stray
    dst[lost] = rng.uniform(0, 600, (int(lost.sum()), 2))
    rows = [(*pair, k, *map(float, src[k]), *map(float, dst[k])) for k in range(n)]
    return spark.createDataFrame(
        rows, "i int, j int, m long, sx double, sy double, dx double, dy double"
    )


H = [0.98, -0.12, 40.0, 0.11, 1.01, -25.0, 5e-5, -4e-5, 1.0]


def _corner_error(found):
    corners = np.array([[0, 0, 1], [600, 0, 1], [600, 450, 1], [0, 450, 1]], float).T
    a, b = (np.array(h).reshape(3, 3) @ corners for h in (found, H))
    return np.abs(a[:2] / a[2] - b[:2] / b[2]).max()


def test_homography_is_recovered(spark):
    points = _points(spark, H, 400, 0.4, noise=0.2)
    (row,) = tr.fitted(points, "homography").collect()
    assert _corner_error(row.h) < 0.5
    # a model through four noisy points keeps most of the 240 true matches, not all
    assert row.n_inliers >= 180 and row.spread > 10000


def test_few_inliers_get_a_second_round(spark):
    points = _points(spark, H, 300, 0.8, noise=0.1)
    (row,) = tr.homography_ransac(points).collect()
    assert row.n_inliers >= 45
    assert _corner_error(row.h) < 8


def test_crowded_pair_is_split_with_the_same_result(spark, monkeypatch):
    points = _points(spark, H[:6] + [0.0, 0.0, 1.0], 500, 0.3).repartition(5)
    whole = tr.affine_ransac(points).collect()
    monkeypatch.setattr(tr, "POINT_BLOCK", 40)
    split = tr.affine_ransac(points).collect()
    assert [(r.trial, r.n_inliers) for r in whole] == [(r.trial, r.n_inliers) for r in split]


def test_too_few_points_and_affine_fallback(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "i int, j int")
    points = _points(spark, H, 3, 0).union(_points(spark, H, 100, 0.1, pair=(1, 2)))
    rows = tr.fit_links(points, pairs).orderBy("i").collect()
    assert [r.model for r in rows] == ["broken", "homography"]
    bad = spark.createDataFrame(
        [(0, 1, [1.0] * 9, 5, 2e4), (1, 2, [1.0] * 9, 25, 2e4)],
        "i int, j int, h array<double>, n_inliers long, spread double",
    )
    good = bad.withColumn("n_inliers", F.lit(30))
    assert [r.model for r in tr.choose_model(pairs, bad, good).orderBy("i").collect()] == [
        "affine", "homography"
    ]


def test_compose_equals_running_product(spark):
    rng = np.random.default_rng(3)
    n, want, total = 300, [], np.eye(3)
    steps = np.eye(3) + rng.normal(0, 1e-3, (n, 3, 3))
    rows = []
    for k in range(n):
        total = total @ steps[k]
        want.append((total / total[2, 2]).ravel())
        rows.append((7, k, 7 + k, 8 + k, [float(v) for v in steps[k].ravel()]))
    links = spark.createDataFrame(rows, "strip_id int, pos int, i int, j int, h array<double>")
    poses = tr.compose(links.repartition(6)).orderBy("pos").collect()
    assert [p.frame_idx for p in poses] == list(range(7, 8 + n))
    assert poses[0].h == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    assert np.allclose([p.h for p in poses[1:]], want, rtol=1e-9)


def test_places_are_permuted_and_drawn_evenly():
    for size, count in ((3, 3), (4, 4), (10, 3), (601, 4), (2000, 4)):
        x = np.arange(size)
        for key in (0, 1, 12345):
            same = np.full(size, size, np.int64)
            assert sorted(solve.permuted(x.copy(), same, same * 0 + key)) == list(range(size))
        places = solve.sample_places(np.arange(4 * (size // count)), size, count)
        assert all(len(set(row)) == count for row in places.tolist())
        drawn = np.bincount(places.ravel(), minlength=size)
        assert drawn.max() <= 4 and drawn.sum() == places.size
    first = solve.sample_places(np.arange(256), 2000, 4)
    assert len(np.unique(first)) == 1024
    a, b = first[:, 0], first[:, 1]
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.2


def test_homographies_have_the_least_reprojection_error(spark):
    draw = np.random.default_rng(3)
    truth = np.array([[1.05, -0.12, 20], [0.1, 0.97, -8], [4e-5, -6e-5, 1]])
    rows, sets = [], {}
    for i in range(3):
        xy = draw.uniform(0, 600, (80, 2))
        whole = np.c_[xy, np.ones(80)] @ truth.T
        uv = whole[:, :2] / whole[:, 2:] + draw.normal(0, 0.3, (80, 2))
        sets[i] = xy, uv
        rows += [(i, i + 1, k, *map(float, (*xy[k], *uv[k]))) for k in range(80)]
    points = spark.createDataFrame(rows, "i int, j int, m long, sx double, sy double, dx double, dy double")
    start = spark.createDataFrame(
        [(i, i + 1, truth.ravel().tolist()) for i in range(3)], "i int, j int, h array<double>"
    )
    found = {r.i: np.array(r.h) for r in tr.refit(points, start, "homography", 100.0).collect()}

    def error(h, xy, uv):
        whole = np.c_[xy, np.ones(len(xy))] @ np.append(h, 1).reshape(3, 3).T
        return (whole[:, :2] / whole[:, 2:] - uv).ravel()

    for i, (xy, uv) in sets.items():
        h = truth.ravel()[:8].copy()
        unit = np.array([1, 1, 100, 1, 1, 100, 1e-3, 1e-3])
        for _ in range(50):  # Gauss-Newton on all points with differences for derivatives
            now = error(h, xy, uv)
            jac = np.stack([(error(h + 1e-6 * unit * e, xy, uv) - now) / 1e-6 for e in np.eye(8)], 1)
            h = h - unit * np.linalg.lstsq(jac, now, rcond=None)[0]
        assert np.abs((found[i][:8] - h) / unit).max() < 1e-6
        least = (error(h, xy, uv) ** 2).sum()
        assert abs((error(found[i][:8], xy, uv) ** 2).sum() - least) < 1e-9 * least
