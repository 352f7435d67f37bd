"""Which canvas tiles a frame touches, and frames that reach to the horizon."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeromosaic.operators import enhance as en
from aeromosaic.operators import mosaic as ms
from aeromosaic.operators import transform as tr
from aeromosaic.sources import images as im
from rasters import frames_table, ground, mosaic_table, picture

WIDE, HIGH, SIZE = 150, 110, 16
POSES = {
    "plain": [1, 0, 20, 0, 1, 15, 0, 0, 1],
    "turned": [0.7, -0.7, 60, 0.7, 0.7, 5, 0, 0, 1],
    "tilted": [1.1, 0.2, 5, -0.1, 0.9, 20, 2e-3, -1e-3, 1],
    "horizon": [1.0, 0.1, 30, 0.1, 1.0, 40, -2.2e-2, 4e-3, 1],
    "behind": [-1.0, 0, -20, 0, -1, -15, 0, 0, -1],
    "negative": [1, 0, 0, 0, 1, 0, -1, -1, -1e-3],
    "off": [1, 0, 500, 0, 1, 0, 0, 0, 1],
}


def covered(h, width, height, step=1.0):
    """Where on the canvas, every ``step``, a point of the frame of positive depth is shown."""
    h = np.array(h, float).reshape(3, 3)
    h = -h if h[2] @ [width / 2, height / 2, 1] < 0 else h
    x, y = np.meshgrid(np.arange(0, WIDE - 1 + step / 2, step), np.arange(0, HIGH - 1 + step / 2, step))
    sx, sy, d = np.linalg.inv(h) @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    sx, sy = sx / d, sy / d
    depth = h[2, 0] * sx + h[2, 1] * sy + h[2, 2]
    inside = (sx >= -1) & (sx <= width) & (sy >= -1) & (sy <= height) & (depth >= ms.NEAR)
    return x.ravel()[inside], y.ravel()[inside]


def shifted(spark, h):
    row = [(0, 0, [float(v) for v in h], WIDE, HIGH)]
    return spark.createDataFrame(row, "strip_id int, frame_idx int, h array<double>, width int, height int")


@pytest.mark.parametrize("name", POSES)
def test_touched_tiles(spark, name):
    width, height = 60, 45
    tile = spark.createDataFrame(
        [(0, 0, 0, 0, 0, width, height, width, height)],
        "frame_idx int, tx int, ty int, x0 int, y0 int, w int, h0 int, width int, height int",
    )
    found = ms.assign_tiles(tile, shifted(spark, POSES[name]), SIZE).select("cx", "cy").collect()
    assert len(found) == len(set(found))
    x, y = covered(POSES[name], width, height)
    needed = set(zip((x // SIZE).astype(int).tolist(), (y // SIZE).astype(int).tolist()))
    # a tile's pixels reach from its first to its last; what is between tiles belongs to none
    x, y = covered(POSES[name], width, height, 0.05)
    near = [(np.floor(v / SIZE), np.ceil((v - SIZE + 1) / SIZE)) for v in (x, y)]
    touched = set(zip(near[0][0].astype(int).tolist(), near[1][0].astype(int).tolist()))
    assert needed <= set(map(tuple, found)) <= touched
    assert bool(found) == (name != "off")


def test_a_frame_is_cut_at_the_horizon(spark):
    image = ground(45, 60)
    frames = frames_table(spark, [image])
    laid = ms.blend(im.to_tiles(frames, 16, 1), shifted(spark, POSES["horizon"]), SIZE)
    whole = picture(laid)
    x, y = covered(POSES["horizon"], 60, 45)
    mask = np.zeros((HIGH, WIDE), bool)
    mask[y.astype(int), x.astype(int)] = True
    assert not whole[~mask].any()
    h = np.linalg.inv(np.array(POSES["horizon"], float).reshape(3, 3))
    sx, sy, d = h @ np.stack([x, y, np.ones(len(x))])
    sx, sy = sx / d, sy / d
    inner = (sx >= 0) & (sx <= 58.9) & (sy >= 0) & (sy <= 43.9)
    fx, fy = np.floor(sx[inner]).astype(int), np.floor(sy[inner]).astype(int)
    ax, ay = (sx[inner] - fx)[:, None], (sy[inner] - fy)[:, None]
    top = image[fy, fx] * (1 - ax) + image[fy, fx + 1] * ax
    low = image[fy + 1, fx] * (1 - ax) + image[fy + 1, fx + 1] * ax
    want = top * (1 - ay) + low * ay
    assert inner.sum() > 500
    assert np.abs(whole[y[inner].astype(int), x[inner].astype(int)] - want).max() <= 1.01


def test_canvases_that_do_not_fit_are_flagged(spark):
    rows = [(0, 0.0, 10.0), (1, 0.0, 3e9), (2, -2e9, 2e9), (3, float("nan"), 4.0), (4, 0.0, float("inf"))]
    corners = spark.createDataFrame(rows, "strip_id int, a double, b double").select(
        "strip_id", F.explode(F.array("a", "b")).alias("x"), F.lit(5.0).alias("y")
    )
    found = {r.strip_id: r.refused for r in ms.canvas(corners).collect()}
    assert found == {0: False, 1: True, 2: True, 3: True, 4: True}


def test_tiles_no_frame_touches_have_no_row(spark):
    """A slanted flight: the same pictures from touched tiles and blank rows as from the whole canvas."""
    frames = frames_table(spark, [ground(40, 40, k) for k in range(3)])
    poses = spark.createDataFrame(
        [(0, k, k, [1.0, 0.0, 70.0 * k, 0.0, 1.0, 70.0 * k, 0.0, 0.0, 1.0]) for k in range(3)],
        "strip_id int, pos int, frame_idx int, h array<double>",
    )
    canvases = ms.canvas(ms.footprints(frames, poses))
    laid = ms.blend(im.to_tiles(frames, 16, 1), ms.shift(poses, canvases), 32).cache()
    whole = ms.fill(laid, canvases, 32).cache()
    places = {(r.tx, r.ty) for r in laid.collect()}
    every = {(r.tx, r.ty): r.bgr is None for r in whole.collect()}
    side = max(x for x, _ in every) + 1
    assert len(every) == side * side and places == {p for p, blank in every.items() if not blank}
    assert len(places) < len(every) / 2
    image = picture(laid)
    dense = mosaic_table(spark, image, 32)
    (a,), (b,) = (ms.crop_box(m).collect() for m in (whole, dense))
    assert a == b and a.area == 1600
    box = spark.createDataFrame([(0, 5, 9, 150, 140, 1)], "strip_id int, x0 int, y0 int, w int, h int, area long")
    sparse, full = (
        en.variants(m, ms.crop(m, box), 3, 5).cache() for m in (whole, dense)
    )
    for name in ("uncropped", "cropped", "sharpened", "enhanced", "bilateral", "nlmeans", "gaussian", "smooth_combo"):
        one, two = (picture(m.where(F.col("variant") == name)) for m in (sparse, full))
        assert one.shape == two.shape and (one == two).all(), name
    views = (sorted(map(tuple, ms.overview(m, 20).collect())) for m in (laid, dense))
    seen, all_cells = (dict(((x, y), (b_, g, r)) for _, x, y, b_, g, r in v) for v in views)
    assert all(np.allclose(seen.get(c, (0, 0, 0)), v) for c, v in all_cells.items())


def test_crowded_tiles_are_added_in_parts(spark, monkeypatch):
    frames = frames_table(spark, [ground(30, 40, k) for k in range(6)])
    poses = spark.createDataFrame(
        [(0, k, k, [1.0, 0.0, 3.5 * k, 0.0, 1.0, 1.25 * k, 0.0, 0.0, 1.0]) for k in range(6)],
        "strip_id int, pos int, frame_idx int, h array<double>",
    )
    canvases = ms.canvas(ms.footprints(frames, poses))
    tiles, shifts = im.to_tiles(frames, 16, 1), ms.shift(poses, canvases)
    whole = picture(ms.blend(tiles, shifts, 32))
    monkeypatch.setattr(ms, "CROWD", 8)
    assert (picture(ms.blend(tiles, shifts, 32)) == whole).all() and whole.any()


def test_a_hub_of_many_regions_has_one_root(spark):
    rng = np.random.default_rng(1)
    pairs = {(k, 0) for k in range(1, 300)} | {(900, k) for k in range(400, 700)}
    pairs |= {tuple(sorted(p, reverse=True)) for p in rng.integers(1000, 1400, (250, 2)).tolist() if p[0] != p[1]}
    edges = spark.createDataFrame([(0, u, v) for u, v in pairs], "strip_id int, u long, v long")
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in pairs:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    found = {r.region: r.root for r in ms.connected_roots(edges).collect()}
    assert all(found.get(n, n) == root(n) for n in parent)


@pytest.mark.parametrize("size", [(1, 1), (2, 9), (3, 5), (8, 17)])
def test_contrast_of_small_pictures(spark, size):
    image = ground(*size)
    tables = en.clahe_tables(en.cell_histograms(mosaic_table(spark, image, 32)))
    assert tables.count() == 8 * 8 * 256
    assert picture(en.clahe(mosaic_table(spark, image, 32))).shape == image.shape


def test_residuals_take_out_a_strip_s_own_frame(spark):
    rng = np.random.default_rng(4)
    true = rng.uniform(0, 900, (40, 2))
    turn, scale = 0.3, 1.25
    own = (true @ np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]]).T - [7, 30]) * scale
    noise = rng.normal(0, 0.5, own.shape)
    ddl = "strip_id int, frame_idx int, corner int, x double, y double"

    def table(points):
        return spark.createDataFrame([(3, k // 4, k % 4, *map(float, p)) for k, p in enumerate(points)], ddl)

    (row,) = tr.pose_residuals(table(own), table(true)).collect()
    assert row.n_points == 40 and row.rms < 1e-4  # sums of squares cancel to half their digits
    assert abs(row.scale - 1 / scale) < 1e-9 and abs(row.angle + turn) < 1e-9
    (row,) = tr.pose_residuals(table(own + noise), table(true)).collect()
    a = np.array([[x, -y, 1, 0] for x, y in own + noise] + [[y, x, 0, 1] for x, y in own + noise])
    least = np.linalg.lstsq(a, true.T.ravel(), rcond=None)[1][0]
    assert abs(row.rms - np.sqrt(least / 40)) < 1e-6
