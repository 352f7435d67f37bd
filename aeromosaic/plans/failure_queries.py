"""Failures as rows: files, detectors and filters that are made to fail, with their check SQL."""

from pyspark.sql import functions as F

from aeromosaic.functions.failures import failures_in, split
from aeromosaic.functions.ordering import settle
from aeromosaic.operators import enhance as en
from aeromosaic.operators import features as ft
from aeromosaic.plans import mosaic_queries as mq
from aeromosaic.plans import workload as wl
from aeromosaic.plans.feature_queries import brightest
from aeromosaic.sources import images as im
from aeromosaic.sources import sinks

LOW, TILE = 10, 16  # rows that frames are fitted into, and tiles of the small frames


def _even_frames_only(tiles):
    if (tiles.frame_idx % 2 == 1).any():
        raise ValueError("odd frame")
    return brightest(tiles)


def _full_width_only(image):
    if image.shape[1] < mq.SIZE + 4:
        raise ValueError("narrow tile")
    return image[2:-2, 2:-2]


def _failures(spark, sf_dir):
    """A third of the files is no image, a third shrinks to nothing; then a detector and a filter fail."""
    kind = F.col("frame_idx") % 3
    files = wl.scene_frames(spark, sf_dir).select(
        F.col("frame_idx").alias("strip_id"),
        F.lit(0).alias("tx"),
        F.lit(0).alias("ty"),
        F.when(kind == 1, 0).when(kind == 2, 1).otherwise(F.col("width")).alias("w"),
        F.when(kind == 1, 0).otherwise(F.col("height")).alias("h"),
        F.expr("substring(pixels, 1, CASE frame_idx % 3 WHEN 0 THEN 3 * width * height WHEN 1 THEN 0 ELSE 3 * height END)")
        .alias("bgr"),
    )
    written = sinks.write_tile_images(files, mq._new_folder(spark, "files"))
    loaded, unread = im.load_tried(spark, written, box=(1000, LOW))
    loaded = settle(loaded)
    found, missed = split(ft.extract_tried(im.to_tiles(loaded, TILE, 0), _even_frames_only))
    scene = wl.scene_mosaic(spark, sf_dir, mq.SIZE)
    filtered = settle(en.stencil_tried(scene, 2, {"same": (2, _full_width_only)}))

    def counted(step, rows, item):
        count = rows.groupBy(item.cast("string").alias("item")).agg(F.count("*").cast("string").alias("error"))
        return count.select(F.lit(step).alias("step"), "item", "error")

    rows = [
        unread, missed, failures_in(filtered), counted("loaded", loaded, F.col("name")),
        counted("found", found, F.col("frame_idx")), counted("filtered", filtered, F.col("variant")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


QUERIES = {"s7_failures": _failures}

ORACLES = {
    "s7_failures": f"""WITH RECURSIVE {wl.FRAMES_SQL},
    files AS (SELECT f, concat('mosaic_', f, '_0_0.png') AS name, f % 3 AS kind, height AS h,
                     CASE WHEN f % 3 = 2 THEN 1 ELSE width END AS w FROM fsize),
    scaled AS (SELECT *, least(1000::DOUBLE / w, {LOW}::DOUBLE / h, 1::DOUBLE) AS scale FROM files),
    sized AS (SELECT *, CAST(floor(w * scale) AS INT) AS nw, CAST(floor(h * scale) AS INT) AS nh FROM scaled),
    state AS (SELECT *, CASE WHEN kind = 1 THEN 'ValueError: not an image'
                             WHEN nw = 0 OR nh = 0 THEN 'ValueError: no pixels left' END AS error FROM sized),
    good AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS i FROM state WHERE error IS NULL),
    small AS (SELECT i, tx, ty FROM good, (SELECT unnest(range(200)) AS tx) a, (SELECT unnest(range(200)) AS ty) b
              WHERE tx * {TILE} < nw AND ty * {TILE} < nh),
    canvas AS (SELECT max(x) // {mq.SIZE} AS last, (max(x) + 1) % {mq.SIZE} > 0 AS narrow, max(y) // {mq.SIZE} AS low
               FROM cell)
    SELECT 'load' AS step, name AS item, error FROM state WHERE error IS NOT NULL
    UNION ALL SELECT 'keypoints', concat(i, '/', ty, '/', tx), 'ValueError: odd frame' FROM small WHERE i % 2 = 1
    UNION ALL SELECT 'filter same', concat('0/', ty, '/', last), 'ValueError: narrow tile'
              FROM canvas, (SELECT unnest(range(100000)) AS ty) t WHERE narrow AND ty <= low
    UNION ALL SELECT 'loaded', name, '1' FROM good
    UNION ALL SELECT 'found', CAST(i AS VARCHAR), CAST(count(*) AS VARCHAR) FROM small WHERE i % 2 = 0 GROUP BY i
    UNION ALL SELECT 'filtered', 'same', CAST((last + 1) * (low + 1) AS VARCHAR) FROM canvas""",
}
