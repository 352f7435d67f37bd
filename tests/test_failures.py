"""A filter that fails on a tile gives no picture of it."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from aeromosaic.functions.failures import failures_in
from aeromosaic.operators import enhance as en
from aeromosaic.operators import mosaic as ms
from rasters import ground, mosaic_table

REACH = 4


def _wide_only():
    """A filter that fails on narrow tiles; made here, since workers don't have this module."""
    reach = REACH

    def run(image):
        if image.shape[1] < 32 + 2 * reach:
            raise ValueError("narrow tile")
        return image[reach:-reach, reach:-reach]

    return run


def test_a_tile_that_a_filter_fails_on_has_no_pixels(spark):
    tiles = mosaic_table(spark, ground(40, 50), 32)  # the second column is 18 wide
    rows = en.stencil_tried(tiles, REACH, {"same": (REACH, _wide_only())}).collect()
    assert {(r.tx, r.ty, r.bgr is None, r.covered is None, r.failed is None) for r in rows} == {
        (0, 0, False, False, True), (0, 1, False, False, True), (1, 0, True, True, False), (1, 1, True, True, False)
    }


def test_the_chained_filter_fails_rather_than_give_unfiltered_tiles(spark, monkeypatch):
    tiles = mosaic_table(spark, ground(40, 50), 32)
    monkeypatch.setattr(en, "_smoothers", lambda *sizes: {"smooth_combo": (REACH, _wide_only())})
    for made in (en.smooth_combo(tiles), en.smoothed(tiles)):
        with pytest.raises(PySparkException, match=r"tile 0/\d/1: narrow tile"):
            made.collect()


def test_variants_tell_failed_tiles_from_pictures(spark, monkeypatch):
    tiles = mosaic_table(spark, ground(40, 50), 32).union(mosaic_table(spark, ground(30, 32), 32, 1))
    monkeypatch.setattr(en, "_smoothers", lambda *sizes: {"smooth_combo": (REACH, _wide_only())})
    monkeypatch.setattr(en, "_sharpener", lambda: (REACH, _wide_only()))
    rows = en.variants_tried(tiles, ms.crop(tiles, ms.crop_box(tiles))).cache()
    assert rows.where(F.col("bgr").isNull() == F.col("failed").isNull()).isEmpty()
    made = {(r.variant, r.strip_id): r["count"] for r in rows.where("bgr is not null").groupBy("variant", "strip_id").count().collect()}
    assert made == {
        ("uncropped", 0): 4, ("cropped", 0): 4, ("sharpened", 0): 2, ("smooth_combo", 0): 2,
        ("uncropped", 1): 1, ("cropped", 1): 1, ("sharpened", 1): 1, ("enhanced", 1): 1, ("smooth_combo", 1): 1,
    }
    steps = {(r.step, r.item) for r in failures_in(rows).collect()}
    assert steps == {
        *[("filter sharpened", f"0/{y}/1") for y in (0, 1)], *[("filter smooth_combo", f"0/{y}/1") for y in (0, 1)],
        *[("filter enhanced", f"0/{y}/{x}") for y in (0, 1) for x in (0, 1)],
    }
