"""Enhancement queries with their check SQL."""

from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle
from aeromosaic.operators import enhance as en
from aeromosaic.operators import mosaic as ms
from aeromosaic.plans import mosaic_queries as mq
from aeromosaic.plans import workload as wl
from aeromosaic.sources import images as im


def _scene(spark, sf_dir):
    return wl.scene_mosaic(spark, sf_dir, mq.SIZE)


def _pixels(mosaic):
    return ms.pixels(mosaic).select("x", "y", "b", "g", "r")


def _lab_round_trip(spark, sf_dir):
    return _pixels(en.from_lab(en.to_lab(_scene(spark, sf_dir))))


def _tables(spark, sf_dir):
    return en.clahe_tables(en.cell_histograms(_scene(spark, sf_dir))).drop("strip_id")


# Non-local means at their usual sizes take SQL minutes; these rows have smaller ones.
TEMPLATE, SEARCH = 3, 5
VARIANTS = (
    "uncropped", "cropped", "sharpened", "enhanced", "bilateral", "nlmeans", "gaussian", "smooth_combo",
)


def _variants(spark, sf_dir, **sizes):
    """Tiles, bytes and mean colour of every output variant."""
    whole = settle(_scene(spark, sf_dir))
    cropped = settle(ms.crop(whole, ms.crop_box(whole, mq.BRIGHT)))
    number = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant")).cast("int")
    rows = settle(en.variants(whole, cropped, **sizes).withColumn("strip_id", number))
    colours = ms.overview(rows, 1 << 20).select("strip_id", *[F.round(c, 6).alias(c) for c in "bgr"])
    sizes = rows.groupBy("strip_id", "variant").agg(
        F.sum(F.length("bgr").cast("long")).alias("n_bytes"), F.count("*").alias("n_tiles")
    )
    return sizes.join(colours, "strip_id").drop("strip_id")


def _summary(spark, sf_dir):
    return ms.mosaic_summary(_scene(spark, sf_dir))


def _frames_used(spark, sf_dir):
    """Bands of the scene, every fifth without a transform, every seventh with one that can't be turned round."""
    frames = settle(wl.scene_frames(spark, sf_dir))
    f, h = F.col("frame_idx"), F.col("h")
    flat = F.transform(h, lambda v: v * 0.0)
    poses = settle(
        wl.scene_poses(spark, sf_dir).withColumn("h", F.when(f % 5 != 4, F.when(f % 7 == 6, flat).otherwise(h)))
    )
    canvases = settle(ms.canvas(ms.footprints(frames, poses.where(f % 7 != 6))))
    laid = ms.blend(im.to_tiles(frames, mq.FRAME_TILE), ms.shift(poses, canvases), mq.SIZE)
    status = ms.pose_status(poses, canvases)
    return ms.mosaic_summary(laid, status).select("strip_id", "frames_used", "frames_left_out", "covered")


QUERIES = {
    "e1_gaussian": lambda s, d: _pixels(en.gaussian(_scene(s, d), 7)),
    "e2_gaussian_sigma": lambda s, d: _pixels(en.gaussian(_scene(s, d), 0, 3.0)),
    "e3_unsharp": lambda s, d: _pixels(en.unsharp(_scene(s, d))),
    "e4_to_lab": lambda s, d: _pixels(en.to_lab(_scene(s, d))),
    "e4_lab_round_trip": _lab_round_trip,
    "e5_clahe_tables": _tables,
    "e5_clahe": lambda s, d: _pixels(en.clahe(_scene(s, d))),
    "e6_bilateral": lambda s, d: _pixels(en.bilateral(_scene(s, d))),
    "e7_nlmeans": lambda s, d: _pixels(en.nlmeans(_scene(s, d))),
    "e7_nlmeans_small": lambda s, d: _pixels(en.nlmeans(_scene(s, d), template=TEMPLATE, search=SEARCH)),
    "e8_smooth_combo": lambda s, d: _pixels(en.smooth_combo(_scene(s, d))),
    "e8_smooth_combo_small": lambda s, d: _pixels(en.smooth_combo(_scene(s, d), TEMPLATE, SEARCH)),
    "e9_variants": _variants,
    "e9_variants_small": lambda s, d: _variants(s, d, template=TEMPLATE, search=SEARCH),
    "r2_mosaic_summary": _summary,
    "r2_frames_used": _frames_used,
}


def _mirrored(place, length):
    """A place beyond the picture taken back into it, mirrored at the first and last pixel."""
    turn = f"greatest(2 * {length} - 2, 1)"
    once = f"((({place}) % {turn} + {turn}) % {turn})"
    return f"CASE WHEN {once} >= {length} THEN {turn} - {once} ELSE {once} END"


def _blur(n, sigma):
    """Two passes with whole-number weights that add up to 65536, mirrored at the edges."""
    return f""", bell AS (
      SELECT d, exp(-(d * d) / (2 * {sigma}::DOUBLE * {sigma}::DOUBLE)) AS v
      FROM (SELECT unnest(range({-(n // 2)}, {n // 2 + 1})) AS d)),
    rounded AS (SELECT d, CAST(round_even(v / sum(v) OVER () * 65536, 0) AS BIGINT) AS w FROM bell),
    kernel AS (
      SELECT d, w + CASE WHEN d = 0 THEN 65536 - CAST(sum(w) OVER () AS BIGINT) ELSE 0 END AS w FROM rounded),
    across AS (
      SELECT c.x, c.y, sum(w * p.b) AS b, sum(w * p.g) AS g, sum(w * p.r) AS r
      FROM (SELECT x, y, w, {_mirrored("x + d", "width")} AS sx
            FROM cell CROSS JOIN kernel CROSS JOIN size) c
      JOIN cell p ON p.x = sx AND p.y = c.y GROUP BY c.x, c.y),
    blurred AS (
      SELECT c.x, c.y, CAST((sum(w * p.b) + 2147483648) // 4294967296 AS INT) AS b,
             CAST((sum(w * p.g) + 2147483648) // 4294967296 AS INT) AS g,
             CAST((sum(w * p.r) + 2147483648) // 4294967296 AS INT) AS r
      FROM (SELECT x, y, w, {_mirrored("y + d", "height")} AS sy
            FROM cell CROSS JOIN kernel CROSS JOIN size) c
      JOIN across p ON p.y = sy AND p.x = c.x GROUP BY c.x, c.y)"""


_LAB = """, linear AS (
  SELECT x, y, list_transform([r, g, b], lambda v: CASE WHEN v / 255 <= 0.04045 THEN v / 255 / 12.92
                      ELSE pow((v / 255 + 0.055) / 1.055, 2.4) END) AS c FROM cell),
xyz AS (
  SELECT x, y, (0.412453 * c[1] + 0.357580 * c[2] + 0.180423 * c[3]) / 0.950456 AS u,
         0.212671 * c[1] + 0.715160 * c[2] + 0.072169 * c[3] AS v,
         (0.019334 * c[1] + 0.119193 * c[2] + 0.950227 * c[3]) / 1.088754 AS w FROM linear),
f AS (
  SELECT x, y, v, list_transform([u, v, w], lambda t: CASE WHEN t > 0.008856 THEN cbrt(t)
                ELSE 7.787 * t + 16 / 116 END) AS f FROM xyz),
lab AS (
  SELECT x, y, CAST(round_even(2.55 * CASE WHEN v > 0.008856 THEN 116 * f[2] - 16
                      ELSE 903.3 * v END, 0) AS INT) AS b,
         CAST(least(255, greatest(0, round_even(500 * (f[1] - f[2]) + 128, 0))) AS INT) AS g,
         CAST(least(255, greatest(0, round_even(200 * (f[2] - f[3]) + 128, 0))) AS INT) AS r FROM f)"""

_TABLES = (
    _LAB
    + f""", wide AS (
  SELECT px, y AS py, b AS level
  FROM (SELECT px, {_mirrored("px", "width")} AS x
        FROM (SELECT unnest(range(8 * CAST(ceil(width / 8) AS INT))) AS px, width FROM size))
  JOIN lab USING (x)),
whole AS (
  SELECT px, v.py, level
  FROM (SELECT py, {_mirrored("py", "height")} AS y
        FROM (SELECT unnest(range(8 * CAST(ceil(height / 8) AS INT))) AS py, height FROM size)) v
  JOIN wide w ON w.py = v.y),
counts AS (
  SELECT py // CAST(ceil(height / 8) AS INT) AS cy, px // CAST(ceil(width / 8) AS INT) AS cx,
         level, count(*) AS n FROM whole, size GROUP BY 1, 2, 3),
areas AS (SELECT cy, cx, sum(n) AS area FROM counts GROUP BY 1, 2),
filled AS (
  SELECT cy, cx, l.level, area, coalesce(n, 0) AS n,
         greatest(floor(2.0 * area / 256), 1) AS most
  FROM areas CROSS JOIN (SELECT unnest(range(256)) AS level) l
  LEFT JOIN counts USING (cy, cx, level)),
excess AS (
  SELECT *, CAST(sum(greatest(n - most, 0)) OVER (PARTITION BY cy, cx) AS BIGINT) AS over FROM filled),
stepped AS (
  SELECT *, over % 256 AS rest, greatest(256 // greatest(over % 256, 1), 1) AS step FROM excess),
spread AS (
  SELECT *, least(n, most) + over // 256
         + CASE WHEN level % step = 0 AND level // step < rest THEN 1 ELSE 0 END AS k FROM stepped)
SELECT CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx, CAST(level AS INT) AS level,
       CAST(least(255, round_even(sum(k) OVER (PARTITION BY cy, cx ORDER BY level) * 255 / area, 0))
            AS INT) AS value
FROM spread"""
)

_TABLE_ROWS = _TABLES.replace("SELECT CAST(cy AS INT)", ", tables AS (SELECT CAST(cy AS INT)", 1) + ")"
_MIXED = (
    _TABLE_ROWS
    + """, spot AS (
  SELECT x, y, b, g, r, x / ceil(width / 8) - 0.5 AS px, y / ceil(height / 8) - 0.5 AS py
  FROM lab CROSS JOIN size),
corner AS (
  SELECT s.*, greatest(0, least(7, floor(px) + i)) AS cx, greatest(0, least(7, floor(py) + j)) AS cy,
         CASE WHEN i = 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END
         * CASE WHEN j = 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END AS w
  FROM spot s CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)),
flat AS (
  SELECT x, y, round_even(round(sum(w * value), 9), 0) AS b, g, r
  FROM corner c JOIN tables t ON t.cx = c.cx AND t.cy = c.cy AND t.level = c.b GROUP BY x, y, g, r)"""
)


def _back(source):
    """Lab of ``source`` (as b, g, r) back to colours."""
    white = (0.950456, 1.0, 1.088754)
    linear = ", ".join(
        "least(1, greatest(0, "
        + " + ".join(f"i{3 * k + n} * {v} * {w}" for n, (v, w) in enumerate(zip(("tx", "ty", "tz"), white)))
        + "))"
        for k in range(3)
    )
    coded = "CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4::DOUBLE) - 0.055 END"
    return f""", xyz_matrix AS (
      SELECT *, m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6) AS det
      FROM (VALUES (0.412453::DOUBLE, 0.357580::DOUBLE, 0.180423::DOUBLE, 0.212671::DOUBLE, 0.715160::DOUBLE,
                    0.072169::DOUBLE, 0.019334::DOUBLE, 0.119193::DOUBLE, 0.950227::DOUBLE))
           m(m0, m1, m2, m3, m4, m5, m6, m7, m8)),
    inverse AS (
      SELECT (m4 * m8 - m5 * m7) / det AS i0, (m2 * m7 - m1 * m8) / det AS i1, (m1 * m5 - m2 * m4) / det AS i2,
             (m5 * m6 - m3 * m8) / det AS i3, (m0 * m8 - m2 * m6) / det AS i4, (m2 * m3 - m0 * m5) / det AS i5,
             (m3 * m7 - m4 * m6) / det AS i6, (m1 * m6 - m0 * m7) / det AS i7, (m0 * m4 - m1 * m3) / det AS i8
      FROM xyz_matrix),
    tone AS (
      SELECT x, y, b / 2.55::DOUBLE AS l, g - 128.0::DOUBLE AS p, r - 128.0::DOUBLE AS q FROM {source}),
    level AS (
      SELECT *, CASE WHEN l <= 903.3 * 0.008856 THEN l / 903.3 ELSE pow((l + 16) / 116, 3) END AS ty,
             CASE WHEN l <= 903.3 * 0.008856 THEN 7.787 * l / 903.3 + 16 / 116
                  ELSE (l + 16) / 116 END AS fy FROM tone),
    shade AS (SELECT *, fy + p / 500 AS fx, fy - q / 200 AS fz FROM level),
    light AS (
      SELECT x, y, ty,
             CASE WHEN fx > 7.787 * 0.008856 + 16 / 116 THEN pow(fx, 3)
                  ELSE (fx - 16 / 116) / 7.787 END AS tx,
             CASE WHEN fz > 7.787 * 0.008856 + 16 / 116 THEN pow(fz, 3)
                  ELSE (fz - 16 / 116) / 7.787 END AS tz FROM shade),
    rgb AS (
      SELECT x, y, list_transform(list_transform([{linear}], lambda v: {coded}), lambda v:
             CAST(least(255, greatest(0, round_even(v * 255, 0))) AS INT)) AS c
      FROM light CROSS JOIN inverse)
    SELECT x, y, c[3] AS b, c[2] AS g, c[1] AS r FROM rgb"""


_BILATERAL = f""", near AS (
  SELECT x, y, dx, dy, {_mirrored("x + dx", "width")} AS sx, {_mirrored("y + dy", "height")} AS sy, b, g, r
  FROM cell CROSS JOIN size
  CROSS JOIN (SELECT unnest(range(-4, 5)) AS dx) CROSS JOIN (SELECT unnest(range(-4, 5)) AS dy)
  WHERE dx * dx + dy * dy <= 16),
weighed AS (
  SELECT n.x, n.y, p.b, p.g, p.r,
         exp(-0.5::DOUBLE * ((n.dx * n.dx + n.dy * n.dy) / 5625
           + pow((abs(p.b - n.b) + abs(p.g - n.g) + abs(p.r - n.r)) / 75, 2))) AS w
  FROM near n JOIN cell p ON p.x = n.sx AND p.y = n.sy)
SELECT x, y, CAST(round_even(sum(w * b) / sum(w), 0) AS INT) AS b,
       CAST(round_even(sum(w * g) / sum(w), 0) AS INT) AS g,
       CAST(round_even(sum(w * r) / sum(w), 0) AS INT) AS r FROM weighed GROUP BY x, y"""


def _non_local(h, template, search):
    """Non-local means in Lab: summed squares of shifted differences, weights in 1/65536 parts."""
    rt, rs = template // 2, search // 2
    far = rt + rs

    def summed(column, along, across):
        over = f"PARTITION BY dx, dy, {across} ORDER BY {along} ROWS BETWEEN {rt} PRECEDING AND {rt} FOLLOWING"
        return f"CAST(sum({column}) OVER ({over}) AS INT) AS {column}"

    def weight(column, planes):
        scale = template * template * planes * h * h
        return f"CAST(round_even(exp(-{column} / {scale}::DOUBLE) * 65536, 0) AS BIGINT)"

    def mean(value, w):
        return f"CAST((2 * sum({w} * {value}) + sum({w})) // (2 * sum({w})) AS INT)"

    return (
        _LAB
        + f""", column_of AS (
          SELECT px, {_mirrored("px", "width")} AS x
          FROM (SELECT CAST(unnest(range({-far}, width + {far})) AS INT) AS px, width FROM size)),
        row_of AS (
          SELECT py, {_mirrored("py", "height")} AS y
          FROM (SELECT CAST(unnest(range({-far}, height + {far})) AS INT) AS py, height FROM size)),
        beyond AS MATERIALIZED (
          SELECT px, py, b AS l, g AS p, r AS q FROM lab JOIN column_of USING (x) JOIN row_of USING (y)),
        offsets AS (
          SELECT dx, dy FROM (SELECT unnest(range({-rs}, {rs + 1})) AS dx)
          CROSS JOIN (SELECT unnest(range({-rs}, {rs + 1})) AS dy)),
        apart AS (
          SELECT c.px, c.py, dx, dy, o.l, o.p, o.q, (c.l - o.l) * (c.l - o.l) AS dl,
                 (c.p - o.p) * (c.p - o.p) + (c.q - o.q) * (c.q - o.q) AS dc
          FROM beyond c CROSS JOIN offsets JOIN beyond o ON o.px = c.px + dx AND o.py = c.py + dy
          CROSS JOIN size
          WHERE c.px BETWEEN {-rt} AND width + {rt - 1} AND c.py BETWEEN {-rt} AND height + {rt - 1}),
        wider AS (
          SELECT px, py, dx, dy, l, p, q, {summed("dl", "px", "py")}, {summed("dc", "px", "py")} FROM apart),
        patch AS (
          SELECT px, py, l, p, q, {summed("dl", "py", "px")}, {summed("dc", "py", "px")} FROM wider),
        weighed AS (
          SELECT px AS x, py AS y, l, p, q, {weight("dl", 1)} AS wl, {weight("dc", 2)} AS wc
          FROM patch CROSS JOIN size WHERE px BETWEEN 0 AND width - 1 AND py BETWEEN 0 AND height - 1),
        smooth AS (
          SELECT x, y, {mean("l", "wl")} AS b, {mean("p", "wc")} AS g, {mean("q", "wc")} AS r
          FROM weighed GROUP BY x, y)"""
        + _back("smooth")
    )


def _with(body, final=""):
    return mq._SCENE + body + " " + final


def _after(name, source, body, size="size"):
    """A named step: ``body`` with the picture ``source`` of the given size in the scene's place."""
    inner = f"WITH cell AS (SELECT x, y, b, g, r FROM {source})"
    if size != "size":
        inner += f", size AS (SELECT width, height FROM {size})"
    return f", {name} AS MATERIALIZED ({inner}{body})"


_SHARP = ", ".join(
    f"CAST(least(255, greatest(0, round_even(1.5 * c.{c} - 0.5 * s.{c}, 0))) AS INT) AS {c}"
    for c in "bgr"
)
_SMALL = _blur(7, 1.4) + " SELECT * FROM blurred"
_SHARPENED = _blur(19, 3.0) + f" SELECT c.x, c.y, {_SHARP} FROM cell c JOIN blurred s ON s.x = c.x AND s.y = c.y"
_NON_LOCAL = _non_local(10.0, TEMPLATE, SEARCH)
_COMBO = (
    _after("step1", "scene", _BILATERAL)
    + _after("step2", "step1", _NON_LOCAL)
    + _after("smooth_combo", "step2", _SMALL)
)

# the box is found by the SQL of w10; tiles are those of the uncropped grid that meet it
_BOX = ", box AS (WITH RECURSIVE cell AS (SELECT x, y, b, g, r FROM scene)" + mq.CROP_BOX_SQL + ")"
_VARIANTS = (
    ", scene AS (SELECT * FROM cell)"
    + _BOX
    + f""", cropped AS (
        SELECT x - x0 AS x, y - y0 AS y, s.b, s.g, s.r FROM scene s CROSS JOIN box
        WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h),
    small AS (SELECT w AS width, h AS height FROM box)"""
    + _after("sharpened", "cropped", _SHARPENED, "small")
    + _after("enhanced", "sharpened", _MIXED + _back("flat"), "small")
    + _after("bilateral", "scene", _BILATERAL)
    + _after("nlmeans", "scene", _NON_LOCAL)
    + _after("gaussian", "scene", _SMALL)
    + _COMBO
    + f""", tiles AS (
        SELECT 3 * CAST(ceil(height / {mq.SIZE}) AS BIGINT) AS whole,
               ((x0 + w - 1) // {mq.SIZE} - x0 // {mq.SIZE} + 1)
               * ((y0 + h - 1) // {mq.SIZE} - y0 // {mq.SIZE} + 1) AS part
        FROM box CROSS JOIN size)"""
    + " UNION ALL ".join(
        f"""SELECT '{v}' AS variant, 3 * count(*) AS n_bytes,
                   CAST(any_value({'part' if v in ('cropped', 'sharpened', 'enhanced') else 'whole'}) AS BIGINT)
                     AS n_tiles,
                   round(avg(b), 6) AS b, round(avg(g), 6) AS g, round(avg(r), 6) AS r
            FROM "{v}" CROSS JOIN tiles"""
        for v in ("scene", *VARIANTS[1:])
    ).replace("'scene' AS variant", "'uncropped' AS variant")
)

ORACLES = {
    "e1_gaussian": _with(_SMALL),
    "e2_gaussian_sigma": _with(_blur(19, 3.0), "SELECT * FROM blurred"),
    "e3_unsharp": _with(_SHARPENED),
    "e4_to_lab": _with(_LAB, "SELECT x, y, b, g, r FROM lab"),
    "e4_lab_round_trip": _with(_LAB, _back("lab")),
    "e5_clahe_tables": _with(_TABLES),
    "e5_clahe": _with(_MIXED, _back("flat")),
    "e6_bilateral": _with(_BILATERAL),
    "e7_nlmeans_small": _with(_NON_LOCAL),
    "e8_smooth_combo_small": _with(", scene AS (SELECT * FROM cell)" + _COMBO, "SELECT * FROM smooth_combo"),
    "e9_variants_small": _with(_VARIANTS),
    "r2_frames_used": mq._FRAMES
    + """SELECT 0 AS strip_id, count(*) FILTER (f % 5 <> 4 AND f % 7 <> 6) AS frames_used,
                count(*) FILTER (f % 5 = 4 OR f % 7 = 6) AS frames_left_out,
                (SELECT count(DISTINCT (x + dx) * 1000000 + y + dy) FROM fpx JOIN pose USING (f)
                 WHERE f % 5 <> 4 AND f % 7 <> 6) AS covered
         FROM pose""",
    "r2_mosaic_summary": _with(
        "",
        """SELECT 0 AS strip_id, CAST(width AS INT) AS width, CAST(height AS INT) AS height,
                  3 * CAST(ceil(height / 48) AS BIGINT) AS n_tiles,
                  CAST(width * height * 3 AS BIGINT) AS n_bytes,
                  CAST(width * height AS BIGINT) AS covered FROM size""",
    ),
}
