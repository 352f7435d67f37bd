"""Blank parts of a canvas in rows of many tiles give the boxes that blank tiles one by one give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeromosaic.operators import mosaic as ms
from aeromosaic.schemas import CANVAS, MOSAIC

SIZE = 3


def _strip(strip, tiles, width, height, rng, bright=0.8):
    rows = []
    for tx, ty in tiles:
        w, h = min(SIZE, width - tx * SIZE), min(SIZE, height - ty * SIZE)
        image = (rng.random((h, w, 1)) < bright).repeat(3, 2).astype(np.uint8) * 200
        place = (strip, tx, ty, tx * SIZE, ty * SIZE, w, h, width, height)
        rows.append((*place, bytearray(image.tobytes()), bytearray(bytes([1]) * (w * h))))
    return rows


def _canvas(strip, width, height, refused=False):
    return strip, 0, 0, width, height, 1.0, 0, refused


def _layouts(seed):
    rng = np.random.default_rng(seed)
    n = 14
    every = [(x, y) for x in range(n) for y in range(n)]
    ring = [(x, y) for x, y in every if max(abs(x - 6), abs(y - 6)) == 5]  # a large hole of blank areas
    broken = [t for t in ring if t != (6, 1)]
    comb = [(x, 2) for x in range(n)] + [(x, y) for x in (1, 6, 12) for y in range(3, 12)]
    eyes = [(x, y) for x, y in every if (max(abs(x - 4), abs(y - 6)) == 4 or max(abs(x - 10), abs(y - 6)) == 3)]
    some = [[every[k] for k in rng.choice(len(every), m, replace=False)] for m in (3, 5, 7, 9, 12, 20, 40, 60)]
    return [ring, broken, comb, eyes, *some, [(k, k) for k in range(n)], [(0, 0)], [(7, 13)], every]


@pytest.mark.parametrize("seed,bright", [(0, 1.0), (1, 0.6)])
def test_boxes_are_the_same(spark, seed, bright):
    rng, rows, canvases = np.random.default_rng(seed), [], []
    for strip, tiles in enumerate(_layouts(seed)):
        width, height = (int(v) for v in 13 * SIZE + rng.integers(1, SIZE + 1, 2))
        rows += _strip(strip, tiles, width, height, rng, bright)
        canvases.append(_canvas(strip, width, height))
    canvases += [_canvas(90, 20, 31), _canvas(91, 20, 31, True)]  # nothing laid out, and refused
    mosaic = spark.createDataFrame(rows, MOSAIC).cache()
    canvas = spark.createDataFrame(canvases, CANVAS)
    found = [ms.crop_box(ms.fill(mosaic, canvas, SIZE, merged=m)).orderBy("strip_id").collect() for m in (False, True)]
    assert found[0] == found[1] and len(found[0]) == len(canvases) - 1
    merged = ms.fill(mosaic, canvas, SIZE, merged=True).cache()
    assert merged.groupBy("strip_id").agg(F.sum(F.col("w") * F.col("h")).alias("n")).orderBy("strip_id").collect() == [
        (c[0], c[3] * c[4]) for c in canvases[:-1]
    ]


def test_a_slanted_flight_lists_few_blank_rows(spark):
    rng, counts = np.random.default_rng(0), []
    for n in (40, 80):
        side = n * SIZE
        mosaic = spark.createDataFrame(_strip(0, [(k, k) for k in range(n)], side, side, rng), MOSAIC)
        counts.append(ms.fill(mosaic, spark.createDataFrame([_canvas(0, side, side)], CANVAS), SIZE, merged=True).count())
    assert counts[1] < 2.1 * counts[0]
