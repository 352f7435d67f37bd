"""Tiled pictures against whole-image computations, files, and the whole job."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from aeromosaic.functions import filters, keypoints, ordering
from aeromosaic.operators import enhance as en
from aeromosaic.operators import features as ft
from aeromosaic.operators import mosaic as ms
from aeromosaic.plans import orthomosaic as om
from aeromosaic.schemas import FRAMES, empty
from aeromosaic.sources import images as im
from aeromosaic.sources import sinks
from rasters import frames_table, ground, mosaic_table, picture

POSES = "strip_id int, pos int, frame_idx int, h array<double>"


def _padded(image, r):
    return np.pad(image, ((r, r), (r, r), (0, 0)), mode="reflect")


@pytest.fixture(scope="module")
def noisy():
    return np.clip(ground(70, 90) + np.random.default_rng(2).integers(-30, 30, (70, 90, 3)), 0, 255).astype(
        np.uint8
    )


def test_stencils_do_not_depend_on_tiles(spark, noisy):
    small, weights = filters.gaussian_weights(7), filters.gaussian_weights(0, 3.0)
    assert len(weights) == 19 and sum(weights) == sum(small) == 65536
    tiles = mosaic_table(spark, noisy, 32)
    assert (picture(en.gaussian(tiles, 7)) == filters.gaussian(_padded(noisy, 3), small)).all()
    sharp = filters.unsharp(noisy, filters.gaussian(_padded(noisy, 9), weights))
    assert (picture(en.unsharp(tiles)) == sharp).all()
    rows = en.smoothed(tiles)
    want = {
        "bilateral": filters.bilateral(_padded(noisy, 4)),
        "nlmeans": filters.nlmeans(_padded(noisy, 13)),
        "gaussian": filters.gaussian(_padded(noisy, 3), small),
    }
    step = filters.nlmeans(_padded(want["bilateral"], 13))
    want["smooth_combo"] = filters.gaussian(_padded(step, 3), small)
    for name, image in want.items():
        assert (picture(rows.where(F.col("variant") == name)) == image).all(), name


def test_nlmeans_equals_plain_loops():
    image = np.random.default_rng(5).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    template, search, h = 3, 5, 10.0
    rt, rs = template // 2, search // 2
    lab = filters.to_lab(_padded(image, rt + rs)).astype(float)
    want = np.zeros_like(image, dtype=float)
    for y in range(5):
        for x in range(6):
            cy, cx = y + rt + rs, x + rt + rs
            for planes in ([0], [1, 2]):
                total = weights = 0.0
                for dy in range(-rs, rs + 1):
                    for dx in range(-rs, rs + 1):
                        a = lab[cy - rt : cy + rt + 1, cx - rt : cx + rt + 1, planes]
                        b = lab[cy + dy - rt : cy + dy + rt + 1, cx + dx - rt : cx + dx + rt + 1, planes]
                        w = np.exp(-((a - b) ** 2).sum() / (template**2 * len(planes) * h * h))
                        total, weights = total + w * lab[cy + dy, cx + dx, planes], weights + w
                want[y, x, planes] = total / weights
    found = filters.nlmeans(_padded(image, rt + rs), h, h, template, search)
    assert (found == filters.from_lab(np.rint(want).astype(np.uint8))).all()


def test_clahe_does_not_depend_on_tiles(spark, noisy):
    whole, tiled = (picture(en.clahe(mosaic_table(spark, noisy, n))) for n in (128, 32))
    assert (whole == tiled).all()
    assert filters.to_lab(whole)[..., 0].std() > filters.to_lab(noisy)[..., 0].std()


def test_lab_round_trip(spark):
    colours = np.random.default_rng(0).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    back = picture(en.from_lab(en.to_lab(mosaic_table(spark, colours, 16))))
    # 8-bit Lab is coarse for dark channels of bright colours: small on average, and stable
    assert np.abs(back.astype(int) - colours).mean() < 1.5
    assert np.abs(filters.to_lab(back).astype(int) - filters.to_lab(colours)).max() <= 1
    greys = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 3, 2)
    assert np.abs(filters.from_lab(filters.to_lab(greys)).astype(int) - greys).max() <= 2


def _flood(mask, steps):
    """Regions of a mask by plain flooding."""
    label, regions = np.full(mask.shape, -1), []
    for start in zip(*np.nonzero(mask)):
        if label[start] >= 0:
            continue
        label[start], todo, region = len(regions), [start], []
        while todo:
            y, x = todo.pop()
            region.append((y, x))
            for dy, dx in steps:
                p = y + dy, x + dx
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and label[p] < 0:
                    label[p] = len(regions)
                    todo.append(p)
        regions.append(np.array(region))
    return regions


@pytest.mark.parametrize("seed,share", [(0, 0.45), (1, 0.6), (2, 0.0)])
def test_crop_box_with_holes(spark, seed, share):
    bright = np.random.default_rng(seed).random((37, 45)) < share
    image = np.repeat((bright * 200).astype(np.uint8)[..., None], 3, 2)
    (row,) = ms.crop_box(mosaic_table(spark, image, 10)).collect()
    if not share:
        assert (row.x0, row.y0, row.w, row.h, row.area) == (0, 0, 45, 37, 0)
        return
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    outside = np.zeros_like(bright)
    for region in _flood(~bright, four):
        y, x = region.T
        if (y == 0).any() or (x == 0).any() or (y == 36).any() or (x == 44).any():
            outside[y, x] = True
    eight = four + [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    best = max(_flood(~outside, eight), key=len)
    (y0, x0), (y1, x1) = best.min(0), best.max(0)
    assert (row.area, row.x0, row.y0, row.w, row.h) == (len(best), x0, y0, x1 - x0 + 1, y1 - y0 + 1)


def _tilted(spark):
    images = [ground(90, 120, s) for s in (1, 2, 3)]
    hs = [
        [1.0, 0, 0, 0, 1, 0, 0, 0, 1],
        [0.97, -0.17, 60.3, 0.17, 0.98, 5.7, 1e-4, -5e-5, 1],
        [1.02, 0.1, 110.9, -0.09, 1.0, 20.2, 0, 1e-4, 1],
    ]
    poses = spark.createDataFrame([(0, k, k, [float(v) for v in h]) for k, h in enumerate(hs)], POSES)
    return frames_table(spark, images), poses


def _laid_out(frames, poses, size, frame_tile, weight="uniform", **limits):
    canvases = ms.canvas(ms.footprints(frames, poses), **limits)
    tiles = im.to_tiles(frames, frame_tile, 1)
    return ms.blend(tiles, ms.shift(poses, canvases), size, weight)


@pytest.mark.parametrize("weight", ["uniform", "feather"])
def test_blend_does_not_depend_on_tiles(spark, monkeypatch, weight):
    frames, poses = _tilted(spark)
    whole = picture(_laid_out(frames, poses, 512, 512, weight))
    assert (picture(_laid_out(frames, poses, 96, 40, weight)) == whole).all()
    monkeypatch.setattr(ms, "CROWD", 2)  # sums in parts
    assert (picture(_laid_out(frames, poses, 96, 40, weight)) == whole).all()
    assert whole.any()


def test_wide_canvas_is_scaled_and_refused(spark):
    frames, poses = _tilted(spark)
    corners = ms.footprints(frames, poses)
    (free,) = ms.canvas(corners).collect()
    (tight,) = ms.canvas(corners, max_side=100).collect()
    assert free.scale == 1.0 and not free.refused
    assert max(tight.width, tight.height) in (99, 100, 101)
    assert abs(tight.scale - 100 / max(free.width, free.height)) < 1e-9
    (refused,) = ms.canvas(corners, max_side=None, refuse_side=50).collect()
    assert refused.refused
    assert _laid_out(frames, poses, 96, 64, max_side=None, refuse_side=50).count() == 0


def test_keypoints_do_not_depend_on_tiles(spark):
    frames = frames_table(spark, [ground(300, 420)])
    halo = keypoints.HALO
    for family in ("blob", "corner"):
        one, cut = (
            ft.extract_keypoints(im.to_tiles(frames, size, halo), family)
            .select(F.round("x", 3), F.round("y", 3), F.round("response", 3))
            .collect()
            for size in (1024, 128)
        )
        assert len(one) > 100
        assert len(set(one) ^ set(cut)) <= 0.02 * len(one), family


def test_tiles_and_assembly(spark):
    images = [ground(50, 70), ground(33, 20)]
    back = im.assemble(im.to_tiles(frames_table(spark, images), 16, 2)).orderBy("frame_idx").collect()
    for row, image in zip(back, images):
        assert row.pixels == image.tobytes()


def test_image_files(spark, tmp_path):
    folder = tmp_path / "photos"
    (folder / "sub").mkdir(parents=True)
    picture_of = {"b.PNG": ground(30, 40, 1), "a.png": ground(1000, 1400, 2), "sub/c.png": ground(9, 9)}
    for name, image in picture_of.items():
        (folder / name).write_bytes(sinks.png_bytes(image))
    (folder / "d.jpg").write_bytes(b"no image")
    (folder / "e.txt").write_text("text")
    names = sorted(r.name for r in im.scan_images(spark, str(folder)).collect())
    assert names == ["a.png", "b.PNG", "d.jpg"]
    whole = im.load_frames(spark, str(folder)).orderBy("frame_idx").collect()
    assert [(r.width, r.height) for r in whole] == [(1400, 1000), (40, 30)]
    assert whole[0].pixels == picture_of["a.png"].tobytes()
    frames = im.load_frames(spark, str(folder), box="by_count")
    rows = frames.orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.name, r.width, r.height) for r in rows] == [
        (0, "a.png", 600, 428), (1, "b.PNG", 40, 30)
    ]
    assert rows[1].pixels == picture_of["b.PNG"].tobytes()
    mean = np.frombuffer(rows[0].pixels, dtype=np.uint8).mean()
    assert abs(mean - picture_of["a.png"].mean()) < 1
    (counts,) = im.load_counts(im.scan_images(spark, str(folder)), frames).collect()
    assert (counts.found, counts.loaded) == (3, 2)
    assert im.scan_images(spark, str(tmp_path / "missing")).count() == 0
    assert im.scan_images(spark, str(folder / "a.png")).count() == 0
    assert im.load_frames(spark, str(folder / "sub" / "none")).count() == 0


def test_odd_file_names_stay_and_order(spark, tmp_path):
    names = ["a b.png", "a#1.png", "a!.png", "a%20c.png", "a+b.PNG", "ä.png"]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(sinks.png_bytes(ground(8, 9, k)))
    assert sorted(r.name for r in im.scan_images(spark, str(tmp_path)).collect()) == sorted(names)
    rows = im.load_frames(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [r.name for r in rows] == sorted(names)
    for r in rows:
        assert r.pixels == ground(8, 9, names.index(r.name)).tobytes()


def test_one_strip_is_spread_whatever_the_join(spark, monkeypatch):
    image = ground(64, 512)
    table = mosaic_table(spark, image, 16)
    box = ms.crop_box(table)
    whole, equal = picture(ms.crop(table, box)), picture(en.clahe(table))
    monkeypatch.setattr(ordering, "ATTACHED", 0)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # tiny partitions stay apart
    }
    kept = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        cropped = ms.crop(table, box)
        rows = cropped.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(rows) > 2
        assert (picture(cropped) == whole).all()
        assert (picture(en.clahe(table)) == equal).all()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_frames_that_cannot_be_laid_out_are_told(spark):
    good, flat = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0] * 9
    rows = [(0, 0, 0, good), (0, 1, 1, flat), (0, 2, 2, None), (0, 3, 3, [float("nan")] * 9)]
    poses = spark.createDataFrame(rows, "strip_id int, pos int, frame_idx int, h array<double>")
    frames = frames_table(spark, [ground(20, 30)] * 4)
    canvases = ms.canvas(ms.footprints(frames, poses.where("frame_idx = 0")))
    status = {r.frame_idx: r.status for r in ms.pose_status(poses, canvases).collect()}
    assert status == {0: "ok", 1: "singular transform", 2: "no transform", 3: "singular transform"}
    laid = ms.blend(im.to_tiles(frames, 16, 1), ms.shift(poses, canvases), 16)
    assert picture(laid).shape[:2] == (20, 30)


def test_a_large_canvas_is_kept(spark):
    corners = spark.createDataFrame(
        [(0, 0, 0, 0.0, 0.0), (0, 0, 1, 30000.0, 40.0)],
        "strip_id int, frame_idx int, corner int, x double, y double",
    )
    (row,) = ms.canvas(corners).collect()
    assert (row.width, row.height, row.scale, row.refused) == (30000, 40, 1.0, False)


def test_shrinking_by_whole_and_broken_factors():
    image = ground(40, 60)
    half = im.shrink_area(image, 20, 30).astype(float)
    blocks = image.reshape(20, 2, 30, 2, 3).mean((1, 3))
    assert np.abs(half - blocks).max() <= 0.5
    assert abs(im.shrink_area(image, 17, 23).mean() - image.mean()) < 1


def test_tile_images_and_variants(spark, tmp_path):
    image = ground(40, 50)
    table = mosaic_table(spark, image, 32)
    folder = sinks.write_tile_images(table, str(tmp_path / "tiles"))
    names = sorted(p.name for p in Path(folder).iterdir() if p.suffix == ".png")
    assert names == [f"mosaic_0_{y}_{x}.png" for y in (0, 1) for x in (0, 1)]
    (one,) = im.decode(spark, folder).where("name = 'mosaic_0_0_0.png'").collect()
    assert one.pixels == image[:32, :32].tobytes()
    every = en.variants(table, ms.crop(table, ms.crop_box(table)))
    sinks.write_mosaic(every, str(tmp_path / "out"))
    found = {r.variant for r in spark.read.parquet(str(tmp_path / "out")).select("variant").collect()}
    assert found == {
        "uncropped", "cropped", "sharpened", "enhanced", "bilateral", "nlmeans", "gaussian", "smooth_combo"
    }


def test_tile_images_are_seen_when_their_job_has_ended(spark, tmp_path):
    path = str(tmp_path / "tiles")
    assert sinks.read_tile_images(spark, path).count() == 0
    table = mosaic_table(spark, ground(40, 50), 32)
    broken = table.withColumn("bgr", F.when(F.expr("tx = 1 and ty = 1"), F.lit(b"x")).otherwise(F.col("bgr")))
    with pytest.raises(PySparkException):
        sinks.write_tile_images(broken.coalesce(1), path)
    assert not list(Path(path).glob("job-*/*.png")) and sinks.read_tile_images(spark, path).count() == 0
    sinks.write_tile_images(table, path)
    with pytest.raises(PySparkException):
        sinks.write_tile_images(broken.repartition(4), path)
    # a job that was lost before it could clean up
    lost = tmp_path / "tiles" / "job-0123"
    lost.mkdir()
    (lost / "mosaic_0_0_0.png").write_bytes(sinks.png_bytes(np.zeros((4, 4, 3), np.uint8)))
    (lost / "task-ab.list").write_text("mosaic_0_0_0.png")
    columns = ["strip_id", "ty", "tx", "w", "h", "bgr"]
    found = {tuple(r) for r in sinks.read_tile_images(spark, path).select(*columns).collect()}
    assert found == {tuple(r) for r in table.select(*columns).collect()} and len(found) == 4


def _flight(n, step=70, height=200, width=240, blank=()):
    scene = ground(step * (n - 1) + height, width)
    images = [scene[step * k : step * k + height] for k in range(n)]
    return scene, [np.full_like(im_, 128) if k in blank else im_ for k, im_ in enumerate(images)]


OPTIONS = {"min_matches": 10, "ratio": 0.6, "tile": 128, "tasks": 8}


def test_mosaic_of_a_flight_equals_the_scene(spark):
    scene, images = _flight(5)
    tables = om.mosaic(frames_table(spark, images), **OPTIONS)
    for pose in tables["poses"].collect():
        shift = np.array([1, 0, 0, 0, 1, 70.0 * pose.frame_idx, 0, 0, 1])
        corners = np.array([[0, 0, 1], [240, 0, 1], [240, 200, 1], [0, 200, 1]]).T
        a, b = (m.reshape(3, 3) @ corners for m in (np.array(pose.h), shift))
        assert np.abs(a[:2] / a[2] - b[:2] / b[2]).max() < 0.5 * max(pose.pos, 1)
    whole = picture(tables["cropped"])
    assert abs(whole.shape[0] - scene.shape[0]) <= 3 and abs(whole.shape[1] - 240) <= 3
    h, w = (min(a, b) - 6 for a, b in zip(whole.shape[:2], scene.shape))
    apart = np.abs(whole[6:h, 6:w].astype(int) - scene[6:h, 6:w])
    assert np.median(apart) <= 2
    assert tables["log"].report().count() == len(tables["log"].rows)


def test_blank_frame_is_skipped_and_a_gap_ends_the_strip(spark):
    _, images = _flight(5, step=40, blank={2})
    tables = om.mosaic(frames_table(spark, images), every_strip=False, **OPTIONS)
    assert [r.frame_idx for r in tables["poses"].orderBy("pos").collect()] == [0, 1, 3, 4]
    _, images = _flight(7, step=60, blank={2, 3, 4})
    tables = om.mosaic(frames_table(spark, images), **OPTIONS)
    strips = [(r.strip_id, r.frame_idx) for r in tables["poses"].orderBy("strip_id", "pos").collect()]
    assert strips == [(0, 0), (0, 1), (5, 5), (5, 6)]
    assert {r.strip_id for r in tables["cropped"].collect()} == {0, 5}


def test_nothing_to_lay_out(spark):
    assert om.mosaic(empty(spark, FRAMES), **OPTIONS)["cropped"].count() == 0
    assert om.mosaic(frames_table(spark, [ground(80, 80)]), **OPTIONS)["cropped"].count() == 0
    apart = [ground(120, 150, 1), ground(120, 150, 77)]
    assert om.mosaic(frames_table(spark, apart), **OPTIONS)["cropped"].count() == 0
