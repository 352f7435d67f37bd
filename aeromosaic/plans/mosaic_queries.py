"""Source, canvas, blending and cropping queries with their check SQL."""

import uuid

from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle, shared_dir
from aeromosaic.operators import mosaic as ms
from aeromosaic.plans import workload as wl
from aeromosaic.sources import images as im
from aeromosaic.sources import sinks

# Small tiles, so that even the small tables make several.
SIZE, FRAME_TILE = 48, 32
BRIGHT = 180
SIDE, REFUSED = 64, 70


def _frames(spark, sf_dir):
    return settle(wl.scene_frames(spark, sf_dir))


def _poses(spark, sf_dir):
    return settle(wl.scene_poses(spark, sf_dir))


def _canvas(spark, sf_dir, frames, **options):
    return ms.canvas(ms.footprints(frames, _poses(spark, sf_dir)), **options)


def _placed(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    canvases = _canvas(spark, sf_dir, frames, max_side=None, refuse_side=None)
    shifted = ms.shift(_poses(spark, sf_dir), canvases)
    return im.to_tiles(frames, FRAME_TILE), shifted


def blended(spark, sf_dir, weight="uniform"):
    tiles, shifted = _placed(spark, sf_dir)
    return ms.blend(tiles, shifted, SIZE, weight)


def _blended_pixels(spark, sf_dir, weight="uniform"):
    return ms.pixels(blended(spark, sf_dir, weight)).drop("strip_id")


def _warped(spark, sf_dir, weight):
    tiles, shifted = _placed(spark, sf_dir)
    return ms.warp(ms.patches(tiles, shifted, SIZE), SIZE, weight).drop("strip_id")


def _warped_between(spark, sf_dir):
    """Frames laid half a pixel to the right and a quarter down: all weights are exact in binary."""
    frames = _frames(spark, sf_dir)
    poses = settle(wl.scene_poses(spark, sf_dir, 0.5, 0.25))
    shifted = ms.shift(poses, ms.canvas(ms.footprints(frames, poses)))
    cut = ms.patches(im.to_tiles(frames, FRAME_TILE), shifted, SIZE)
    return ms.warp(cut, SIZE, "uniform").drop("strip_id")


def _shift(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    shifted = ms.shift(_poses(spark, sf_dir), _canvas(spark, sf_dir, frames, max_side=SIDE, refuse_side=None))
    h = F.col("h")
    columns = [F.round(h[k], 6).alias(f"h{k}") for k in (0, 2, 4, 5)]
    return shifted.select("frame_idx", *columns, "width", "height")


def _assign(spark, sf_dir):
    tiles, shifted = _placed(spark, sf_dir)
    plain = tiles.drop("pixels").withColumnRenamed("h", "h0")
    return ms.assign_tiles(plain, shifted, SIZE).select("frame_idx", "tx", "ty", "cx", "cy")


def _scale_columns(df):
    return df.withColumn("scale", F.round("scale", 6))


def _grey(spark, sf_dir):
    px = ms.pixels(wl.scene_mosaic(spark, sf_dir))
    return px.select("x", "y", ms.grey(F.col("b"), F.col("g"), F.col("r")).alias("grey"))


def _crop_box(spark, sf_dir):
    return ms.crop_box(settle(wl.scene_mosaic(spark, sf_dir, SIZE)), BRIGHT)


def _crop(spark, sf_dir):
    tiles = wl.scene_mosaic(spark, sf_dir, SIZE)
    box = tiles.groupBy("strip_id").agg(
        F.lit(10).alias("x0"),
        F.floor(F.max("height") / 5).cast("int").alias("y0"),
        F.lit(60).alias("w"),
        F.floor(F.max("height") / 2).cast("int").alias("h"),
    )
    return ms.pixels(ms.crop(tiles, box)).select("x", "y", "b", "g", "r")


def _file_names(spark, sf_dir):
    """One made-up file name per page, with endings of all kinds."""
    page = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in wl.ENDINGS]), (page % 5 + 1).cast("int"))
    name = F.concat(F.lit("IMG_"), page.cast("string"), ending)
    return wl.read(spark, sf_dir, "pages").select("page_id", name.alias("name"))


def _formats(spark, sf_dir):
    return _file_names(spark, sf_dir).where(im.has_format(F.col("name"))).select("name")


def _numbered(spark, sf_dir):
    return im.number_frames(_formats(spark, sf_dir)).select("frame_idx", "name")


def _scales(spark, sf_dir):
    pages = wl.read(spark, sf_dir, "pages")
    sized = pages.select(
        "page_id",
        (F.col("page_id") * 37 % 900 + 300).alias("width"),
        (F.col("page_id") * 53 % 700 + 200).alias("height"),
        (F.col("page_id") % 40).alias("n_files"),
    )
    scale = im.fit_scale(F.col("width"), F.col("height"), F.col("n_files"))
    return sized.select("page_id", F.round(scale, 9).alias("scale"))


def _shrunk(spark, sf_dir):
    half = im.resize_area(wl.scene_frames(spark, sf_dir).withColumn("scale", F.lit(0.5)))
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    return _as_pixels(half.withColumn("frame_idx", number))


def _as_pixels(frames):
    """Pixels of whole frames in long form."""
    return ms.pixels(
        frames.select(
            F.col("frame_idx").alias("strip_id"),
            *[F.lit(0).alias(c) for c in ("tx", "ty", "x0", "y0")],
            F.col("width").alias("w"),
            F.col("height").alias("h"),
            "width",
            "height",
            F.col("pixels").alias("bgr"),
            F.expr("unhex(repeat('01', width * height))").alias("covered"),
        )
    ).select(F.col("strip_id").alias("frame_idx"), "x", "y", "b", "g", "r")


def _round_trip(spark, sf_dir):
    return _as_pixels(im.assemble(im.to_tiles(_frames(spark, sf_dir), FRAME_TILE, 3)))


def _new_folder(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _files_round_trip(spark, sf_dir):
    """Frames written as image files, then scanned, decoded and numbered again."""
    folder = _new_folder(spark, "frames")
    frames = _frames(spark, sf_dir)
    written = sinks.write_tile_images(
        frames.select(
            F.col("frame_idx").alias("strip_id"),
            F.lit(0).alias("tx"),
            F.lit(0).alias("ty"),
            F.col("width").alias("w"),
            F.col("height").alias("h"),
            F.col("pixels").alias("bgr"),
        ),
        folder,
    )
    return im.load_frames(spark, written)


def _decoded(spark, sf_dir):
    loaded = _files_round_trip(spark, sf_dir)
    written = F.regexp_extract("name", r"_(\d+)_", 1).cast("int").alias("written")
    sums = _as_pixels(loaded).groupBy("frame_idx").agg(
        *[F.sum(c).alias(f"sum_{c}") for c in "bgr"], F.count("*").alias("n")
    )
    return loaded.select("frame_idx", "name", written, "scale").join(sums, "frame_idx")


def _written(spark, sf_dir):
    """A table of two variants, written by partition and read back."""
    whole = wl.scene_mosaic(spark, sf_dir, SIZE)
    folder = _new_folder(spark, "mosaic")
    both = whole.withColumn("variant", F.lit("uncropped")).union(
        whole.where("tx = 0").withColumn("variant", F.lit("cropped"))
    )
    sinks.write_mosaic(both, folder)
    return (
        spark.read.parquet(folder)
        .groupBy("variant")
        .agg(F.sum(F.length("bgr").cast("long")).alias("n_bytes"), F.count("*").alias("n_tiles"))
    )


def _tile_images(spark, sf_dir):
    """Tiles written as images in two jobs, the second over some of the first, and read back."""
    whole = settle(wl.scene_mosaic(spark, sf_dir, SIZE))
    folder = _new_folder(spark, "tiles")
    sinks.write_tile_images(whole, folder)
    plain = F.expr("unhex(repeat('070707', w * h))")
    sinks.write_tile_images(whole.where("(tx + ty) % 2 = 1").withColumn("bgr", plain), folder)
    tiles = sinks.read_tile_images(spark, folder)
    place = [(F.col(c) * SIZE).alias(f"{t}0") for c, t in (("tx", "x"), ("ty", "y"))]
    covered = F.expr("unhex(repeat('01', w * h))").alias("covered")
    sizes = [F.lit(None).cast("int").alias(c) for c in ("width", "height")]
    return ms.pixels(
        tiles.select("strip_id", "tx", "ty", *place, "w", "h", *sizes, "bgr", covered)
    ).select("x", "y", "b", "g", "r")


def _overview(spark, sf_dir):
    view = ms.overview(wl.scene_mosaic(spark, sf_dir), 7)
    return view.select("x", "y", *[F.round(c, 6).alias(c) for c in "bgr"])


QUERIES = {
    "s1_scan_formats": _formats,
    "s2_number_frames": _numbered,
    "s3_decode": _decoded,
    "s4_fit_scale": _scales,
    "s5_resize_area": _shrunk,
    "s6_tiles_round_trip": _round_trip,
    "s8_write_mosaic": _written,
    "s9_tile_images": _tile_images,
    "s10_overview": _overview,
    "w1_footprints": lambda s, d: ms.footprints(
        _frames(s, d), wl.scene_poses(s, d)
    ).drop("strip_id"),
    "w2_canvas": lambda s, d: _canvas(s, d, _frames(s, d), max_side=None, refuse_side=None),
    "w3_fit_canvas": lambda s, d: _scale_columns(
        _canvas(s, d, _frames(s, d), max_side=SIDE, refuse_side=REFUSED)
    ),
    "w4_shift": _shift,
    "w5_assign_tiles": _assign,
    "w6_warp": lambda s, d: _warped(s, d, "uniform"),
    "w6_warp_between": _warped_between,
    "w7_weights": lambda s, d: _warped(s, d, "feather").select("frame_idx", "x", "y", "weight"),
    "w8_blend": lambda s, d: _blended_pixels(s, d),
    "w8_blend_feather": lambda s, d: _blended_pixels(s, d, "feather"),
    "w9_grey": _grey,
    "w10_crop_box": _crop_box,
    "w11_crop": _crop,
}

# Fixed values in the SQL below: image endings, and the boxes by number of files.
_FRAMES = f"WITH RECURSIVE {wl.FRAMES_SQL}"
_SCENE = f"WITH RECURSIVE {wl.SCENE_SQL}"
_CORNERS = """, corner AS (
  SELECT f AS frame_idx, c AS corner, CAST(dx + CASE WHEN c IN (1, 2) THEN width ELSE 0 END AS DOUBLE) AS x,
         CAST(dy + CASE WHEN c >= 2 THEN height ELSE 0 END AS DOUBLE) AS y
  FROM pose JOIN fsize USING (f) CROSS JOIN (SELECT CAST(unnest(range(4)) AS INT) AS c)),
bounds AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM corner),
canvas AS (
  SELECT CAST(trunc(lx - 0.5) AS INT) AS x_min, CAST(trunc(ly - 0.5) AS INT) AS y_min,
         CAST(trunc(hx + 0.5) - trunc(lx - 0.5) AS INT) AS width,
         CAST(trunc(hy + 0.5) - trunc(ly - 0.5) AS INT) AS height, lx, hx, ly, hy FROM bounds),
fitted AS (
  SELECT CASE WHEN width > 64 OR height > 64
              THEN least(1.0::DOUBLE, 64.0::DOUBLE / width, 64.0::DOUBLE / height)
              ELSE 1.0::DOUBLE END AS scale, lx, hx, ly, hy FROM canvas),
small AS (
  SELECT scale, CAST(trunc(scale * lx - 0.5) AS INT) AS x_min, CAST(trunc(scale * ly - 0.5) AS INT) AS y_min,
         CAST(trunc(scale * hx + 0.5) - trunc(scale * lx - 0.5) AS INT) AS width,
         CAST(trunc(scale * hy + 0.5) - trunc(scale * ly - 0.5) AS INT) AS height FROM fitted)
"""
_SEEN = """, seen AS (
  SELECT f AS frame_idx, x + dx AS x, y + dy AS y, b, g, r,
         CAST(least(x + 1, width - x, y + 1, height - y) AS DOUBLE) AS feather
  FROM fpx JOIN pose USING (f) JOIN fsize USING (f)),
shown AS (SELECT s.* FROM seen s, canvas c WHERE s.x < c.width AND s.y < c.height)
"""
_ON_CANVAS = _FRAMES + _CORNERS + _SEEN
_MEAN = """SELECT CAST(u.x AS INT) AS x, CAST(v.y AS INT) AS y, {b}, {g}, {r},
  CAST(count(frame_idx) > 0 AS INT) AS covered
  FROM (SELECT unnest(range((SELECT width FROM canvas))) AS x) u
  CROSS JOIN (SELECT unnest(range((SELECT height FROM canvas))) AS y) v
  LEFT JOIN shown s ON s.x = u.x AND s.y = v.y GROUP BY ALL"""


def _mean(weight):
    whole = "CAST(coalesce(floor(sum({c} * {w}) / sum({w})), 0) AS INT) AS {c}"
    return _ON_CANVAS + _MEAN.format(**{c: whole.format(c=c, w=weight) for c in "bgr"})


# the largest region of the picture ``cell`` that is brighter than BRIGHT, with its holes filled
CROP_BOX_SQL = """, dark AS (SELECT x, y FROM cell WHERE (b * 114 + g * 587 + r * 299 + 500) // 1000 <= 180),
    outside AS (
      SELECT x, y FROM dark, size
      WHERE x = 0 OR y = 0 OR x = width - 1 OR y = height - 1
      UNION
      SELECT d.x, d.y
      FROM (SELECT x + dx AS x, y + dy AS y FROM outside
            CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy)) o
      JOIN dark d USING (x, y)),
    inside AS (SELECT x, y FROM cell ANTI JOIN outside USING (x, y)),
    step AS (SELECT unnest([-1, 0, 1]) AS d),
    near AS (
      SELECT a.x, a.y, b.x AS x2, b.y AS y2
      FROM (SELECT x, y, p.d AS px, q.d AS py FROM inside CROSS JOIN step p CROSS JOIN step q) a
      JOIN inside b ON b.x = a.x + px AND b.y = a.y + py),
    spread AS (
      SELECT x, y, y * 100 + x AS label FROM inside
      UNION
      SELECT x2, y2, label FROM spread JOIN near USING (x, y)
      WHERE y2 * 100 + x2 > label),
    region AS (
      SELECT label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w,
             max(y) - min(y) + 1 AS h
      FROM (SELECT x, y, min(label) AS label FROM spread GROUP BY 1, 2) GROUP BY label)
    SELECT 0 AS strip_id, x0, y0, w, h, area FROM region ORDER BY area DESC, label LIMIT 1"""

ORACLES = {
    "s1_scan_formats": f"""WITH {wl.NAMES_SQL} SELECT name FROM names
        WHERE lower(regexp_extract(name, '\\.[^.]+$')) IN
              ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.tif')""",
    "s2_number_frames": f"""WITH {wl.NAMES_SQL}
        SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS frame_idx, name FROM names
        WHERE lower(regexp_extract(name, '\\.[^.]+$')) IN
              ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.tif')""",
    "s3_decode": _FRAMES
    + """SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS frame_idx, name, written,
                1.0::DOUBLE AS scale, sum_b, sum_g, sum_r, n
         FROM (SELECT concat('mosaic_', f, '_0_0.png') AS name, CAST(f AS INT) AS written,
                      CAST(sum(b) AS BIGINT) AS sum_b, CAST(sum(g) AS BIGINT) AS sum_g,
                      CAST(sum(r) AS BIGINT) AS sum_r, count(*) AS n FROM fpx GROUP BY f)""",
    "s4_fit_scale": """
        SELECT page_id, round(least(1.0::DOUBLE,
                 CASE WHEN n > 30 THEN 400 WHEN n > 20 THEN 500 ELSE 600 END / CAST(w AS DOUBLE),
                 CASE WHEN n > 30 THEN 300 WHEN n > 20 THEN 375 ELSE 450 END / CAST(h AS DOUBLE)), 9)
               AS scale
        FROM (SELECT page_id, page_id * 37 % 900 + 300 AS w, page_id * 53 % 700 + 200 AS h,
                     page_id % 40 AS n FROM pages)""",
    "s5_resize_area": _FRAMES
    + """, small AS (SELECT f, width, height, width // 2 AS nw, height // 2 AS nh FROM fsize),
         part AS (
           SELECT f, u.x AS tx, v.y AS ty,
                  (least((u.x + 1) * width / nw, p.x + 1) - greatest(u.x * width / nw, p.x)) * nw / width
                * (least((v.y + 1) * height / nh, p.y + 1) - greatest(v.y * height / nh, p.y)) * nh / height
                  AS w, b, g, r
           FROM fpx p JOIN small USING (f)
           JOIN (SELECT unnest(range(50)) AS x) u ON u.x < nw
                AND (u.x + 1) * width / nw > p.x AND u.x * width / nw < p.x + 1
           JOIN (SELECT unnest(range(20)) AS y) v ON v.y < nh
                AND (v.y + 1) * height / nh > p.y AND v.y * height / nh < p.y + 1)
         SELECT CAST(f AS INT) AS frame_idx, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y,
                CAST(floor(sum(b * w) + 0.5 + 1e-9) AS INT) AS b, CAST(floor(sum(g * w) + 0.5 + 1e-9) AS INT) AS g,
                CAST(floor(sum(r * w) + 0.5 + 1e-9) AS INT) AS r FROM part GROUP BY ALL""",
    "s6_tiles_round_trip": _FRAMES
    + """SELECT CAST(f AS INT) AS frame_idx, CAST(x AS INT) AS x, CAST(y AS INT) AS y,
                CAST(b AS INT) AS b, CAST(g AS INT) AS g, CAST(r AS INT) AS r FROM fpx""",
    "s9_tile_images": _SCENE
    + f"""SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, """
    + ", ".join(f"CAST(CASE WHEN (x // {SIZE} + y // {SIZE}) % 2 = 1 THEN 7 ELSE {c} END AS INT) AS {c}" for c in "bgr")
    + " FROM cell",
    "s8_write_mosaic": _SCENE
    + """SELECT 'uncropped' AS variant, count(*) * 3 AS n_bytes,
                3 * CAST(ceil((max(y) + 1) / 48) AS BIGINT) AS n_tiles FROM cell
         UNION ALL
         SELECT 'cropped', count(*) * 3, CAST(ceil((max(y) + 1) / 48) AS BIGINT)
         FROM cell WHERE x < 48""",
    "s10_overview": _SCENE
    + """SELECT CAST(x // 7 AS INT) AS x, CAST(y // 7 AS INT) AS y, round(avg(b), 6) AS b,
                round(avg(g), 6) AS g, round(avg(r), 6) AS r FROM cell GROUP BY 1, 2""",
    "w1_footprints": _FRAMES
    + _CORNERS
    + "SELECT CAST(frame_idx AS INT) AS frame_idx, corner, x, y FROM corner",
    "w2_canvas": _FRAMES
    + _CORNERS
    + """SELECT 0 AS strip_id, x_min, y_min, width, height, 1.0::DOUBLE AS scale,
                CAST(width AS BIGINT) * height * 12 AS est_bytes, false AS refused FROM canvas""",
    "w3_fit_canvas": _FRAMES
    + _CORNERS
    + """SELECT 0 AS strip_id, x_min, y_min, width, height, round(scale, 6) AS scale,
                CAST(width AS BIGINT) * height * 12 AS est_bytes,
                width > 70 OR height > 70 AS refused FROM small""",
    "w4_shift": _FRAMES
    + _CORNERS
    + """SELECT CAST(f AS INT) AS frame_idx, round(scale, 6) AS h0,
                round(scale * dx - x_min, 6) AS h2, round(scale, 6) AS h4,
                round(scale * dy - y_min, 6) AS h5, width, height
         FROM pose CROSS JOIN small""",
    "w5_assign_tiles": _FRAMES
    + _CORNERS
    + """, grid AS (
           SELECT f, dx, dy, tx, ty, least(32, s.width - 32 * tx) AS w, least(32, s.height - 32 * ty) AS h
           FROM pose JOIN fsize s USING (f)
           CROSS JOIN (SELECT unnest(range(4)) AS tx) CROSS JOIN (SELECT unnest(range(2)) AS ty)
           WHERE 32 * tx < s.width AND 32 * ty < s.height),
         box AS (
           SELECT g.*, greatest(dx + 32 * tx - 1, 0) AS x1, least(dx + 32 * tx + w, c.width - 1) AS x2,
                  greatest(dy + 32 * ty - 1, 0) AS y1, least(dy + 32 * ty + h, c.height - 1) AS y2
           FROM grid g CROSS JOIN canvas c)
         SELECT CAST(f AS INT) AS frame_idx, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty,
                CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy
         FROM box CROSS JOIN (SELECT unnest(range(3)) AS cx)
         JOIN (SELECT unnest(range((SELECT height // 48 + 1 FROM canvas))) AS cy)
           ON cy >= y1 // 48 AND cy <= y2 // 48
         WHERE cx >= x1 // 48 AND cx <= x2 // 48 AND x1 <= x2 AND y1 <= y2""",
    "w6_warp": _ON_CANVAS
    + """SELECT CAST(frame_idx AS INT) AS frame_idx, CAST(x AS INT) AS x, CAST(y AS INT) AS y,
                CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g, CAST(r AS DOUBLE) AS r,
                1.0::DOUBLE AS weight FROM shown""",
    "w6_warp_between": _FRAMES
    + ", between AS (SELECT f, dx + 0.5::DOUBLE AS dx, dy + 0.25::DOUBLE AS dy FROM pose)"
    + _CORNERS.replace("FROM pose JOIN", "FROM between JOIN")
    + """, part AS (
           SELECT CAST(f AS INT) AS frame_idx, CAST(x + p.dx + u.k AS INT) AS x, CAST(y + p.dy + v.k AS INT) AS y,
                  b, g, r, CASE WHEN v.k = 0 THEN 0.375::DOUBLE ELSE 0.125::DOUBLE END AS w
           FROM fpx JOIN pose p USING (f) CROSS JOIN (SELECT unnest([0, 1]) AS k) u
           CROSS JOIN (SELECT unnest([0, 1]) AS k) v),
         seen AS (SELECT frame_idx, x, y, sum(w) AS weight, sum(b * w) AS sb, sum(g * w) AS sg, sum(r * w) AS sr
                  FROM part GROUP BY frame_idx, x, y)
         SELECT frame_idx, s.x, s.y, sb * weight AS b, sg * weight AS g, sr * weight AS r, weight
         FROM seen s, canvas c WHERE s.x < c.width AND s.y < c.height""",
    "w7_weights": _ON_CANVAS
    + """SELECT CAST(frame_idx AS INT) AS frame_idx, CAST(x AS INT) AS x, CAST(y AS INT) AS y,
                feather AS weight FROM shown""",
    "w8_blend": _mean("1"),
    "w8_blend_feather": _mean("CAST(feather AS BIGINT)"),
    "w9_grey": _SCENE
    + "SELECT x, y, CAST((b * 114 + g * 587 + r * 299 + 500) // 1000 AS INT) AS grey FROM cell",
    "w10_crop_box": _SCENE + CROP_BOX_SQL,
    "w11_crop": _SCENE
    + """SELECT x - 10 AS x, CAST(y - height // 5 AS INT) AS y, b, g, r FROM cell CROSS JOIN size
         WHERE x >= 10 AND x < 70 AND y >= height // 5 AND y < height // 5 + height // 2""",
}
