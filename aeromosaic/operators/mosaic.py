"""Canvas geometry, warping, blending, cropping: all on canvas tiles."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeromosaic.functions.geometry import apply_transform, bound, invertible, matmul
from aeromosaic.functions.ordering import attach, settle, settle_marked, spread, with_least
from aeromosaic.functions.raster import as_image, bilinear, label_regions, per_row

TILE = 512
NEAR = 1e-6  # depth, 1 at a frame that is seen from above, below which a frame is cut off
_SLACK = 1e-6
INT_MAX = 2**31 - 1
CROWD = 64  # patches on one tile that a single task adds up
_UNIT = float(1 << 20)  # sums are kept in whole units, so their order does not matter
_TILE = ["strip_id", "tx", "ty"]

_MOSAIC = pa.schema(
    [(c, pa.int32()) for c in ("strip_id", "tx", "ty", "x0", "y0", "w", "h", "width", "height")]
    + [("bgr", pa.binary()), ("covered", pa.binary())]
)


def _whole(value: Column) -> Column:
    """To int, cutting towards zero; what doesn't fit is flagged by the caller."""
    return F.greatest(F.least(value, F.lit(float(INT_MAX - 1))), F.lit(float(1 - INT_MAX))).cast("int")


def footprints(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Four corners of every posed frame on the canvas plane."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    zero = F.lit(0.0)
    corners = [(zero, zero), (w, zero), (w, h), (zero, h)]
    corner = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("corner"), x.alias("x"), y.alias("y"))
                for k, (x, y) in enumerate(corners)
            ]
        )
    ).alias("c")
    posed = frames.select("frame_idx", "width", "height").join(
        poses.where(F.col("h").isNotNull()).select("strip_id", "frame_idx", "h"), "frame_idx"
    )
    listed = posed.select("strip_id", "frame_idx", "h", corner)
    x, y = apply_transform(F.col("h"), F.col("c.x"), F.col("c.y"))
    return listed.select("strip_id", "frame_idx", "c.corner", x.alias("x"), y.alias("y"))


def canvas(corners: DataFrame, max_side: int = None, refuse_side: int = None) -> DataFrame:
    """One row per strip: origin, size, scale, bytes, and whether it is refused.

    Bounds are cut towards zero after widening by half a pixel. A canvas over
    max_side is scaled down as a whole (the canvas, not the frames); one that is
    still over refuse_side is flagged. Without limits, the default, only a canvas is
    flagged whose bounds are no numbers or don't fit an int.
    """
    raw = corners.groupBy("strip_id").agg(
        F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy")
    )
    wide = F.lit(-0.5), F.lit(0.5)

    def bounds(scale):
        low = [_whole(scale * F.col(c) + wide[0]) for c in ("lx", "ly")]
        high = [_whole(scale * F.col(c) + wide[1]) for c in ("hx", "hy")]
        return low, high

    (x, y), (x2, y2) = bounds(F.lit(1.0))
    w, h = (x2.cast("long") - x), (y2.cast("long") - y)
    scale = F.lit(1.0)
    if max_side is not None:
        scale = F.least(F.lit(1.0), F.lit(float(max_side)) / w, F.lit(float(max_side)) / h)
        scale = F.when((w > max_side) | (h > max_side), scale).otherwise(F.lit(1.0))
    sized = raw.withColumn("scale", scale)
    ends = [F.abs(F.col("scale") * F.col(c)) < INT_MAX - 1 for c in ("lx", "hx", "ly", "hy")]
    fits = ends[0] & ends[1] & ends[2] & ends[3]
    sized = sized.withColumn("fits", F.coalesce(fits, F.lit(False)))
    (x, y), (x2, y2) = bounds(F.col("scale"))
    sized = sized.select(
        "strip_id",
        x.alias("x_min"),
        y.alias("y_min"),
        (x2.cast("long") - x).alias("w"),
        (y2.cast("long") - y).alias("h"),
        "scale",
        "fits",
    )
    w, h = F.col("w"), F.col("h")
    refused = ~F.col("fits") | (w > INT_MAX) | (h > INT_MAX)
    if refuse_side is not None:
        refused = refused | (w > refuse_side) | (h > refuse_side)
    return sized.select(
        "strip_id",
        "x_min",
        "y_min",
        F.least(w, F.lit(INT_MAX)).cast("int").alias("width"),
        F.least(h, F.lit(INT_MAX)).cast("int").alias("height"),
        "scale",
        (w * h * 12).alias("est_bytes"),
        refused.alias("refused"),
    )


def shift(poses: DataFrame, canvases: DataFrame) -> DataFrame:
    """Poses onto the canvas: scaled, then moved to its origin.

    Refused canvases drop out, and transforms that can't be turned round; ``pose_status`` lists both.
    """
    scale, one, zero = F.col("scale"), F.lit(1.0), F.lit(0.0)
    onto = F.array(
        scale, zero, -F.col("x_min").cast("double"),
        zero, scale, -F.col("y_min").cast("double"),
        zero, zero, one,
    )
    usable = canvases.where(~F.col("refused"))
    usable = usable.select("strip_id", "scale", "x_min", "y_min", "width", "height")
    return attach(poses.where(invertible(F.col("h"))), usable, "strip_id").select(
        "strip_id", "frame_idx", matmul(onto, F.col("h")).alias("h"), "width", "height"
    )


def pose_status(poses: DataFrame, canvases: DataFrame) -> DataFrame:
    """(strip_id, frame_idx, status) of every pose: ok, or why its frame is not laid out."""
    flags = canvases.select("strip_id", "refused")
    listed = attach(poses.select("strip_id", "frame_idx", "h"), flags, "strip_id")
    status = (
        F.when(F.col("h").isNull(), "no transform")
        .when(~invertible(F.col("h")), "singular transform")
        .when(F.col("refused"), "canvas refused")
        .otherwise("ok")
    )
    return listed.select("strip_id", "frame_idx", status.alias("status"))


def facing(h: Column, width: Column, height: Column) -> Column:
    """The same projective map with positive depth at the centre of its frame."""
    depth = h[6] * (width / 2.0) + h[7] * (height / 2.0) + h[8]
    return F.when(depth < 0, F.transform(h, lambda v: -v)).otherwise(h)


def _visible(h: Column, corners: list) -> Column:
    """The image of a quad as a convex polygon, cut where its depth would be below NEAR."""
    points = F.array(
        *[
            F.struct(
                (h[0] * x + h[1] * y + h[2]).alias("x"),
                (h[3] * x + h[4] * y + h[5]).alias("y"),
                (h[6] * x + h[7] * y + h[8]).alias("d"),
            )
            for x, y in corners
        ]
    )

    def flat(x, y, d):
        return F.struct((x / d).alias("x"), (y / d).alias("y"))

    def edge(p, k, every):
        q = F.element_at(every, (k + 1) % 4 + 1)
        here = F.when(p["d"] >= NEAR, F.array(flat(p["x"], p["y"], p["d"]))).otherwise(F.array())
        share = (NEAR - p["d"]) / F.when(p["d"] == q["d"], 1.0).otherwise(q["d"] - p["d"])
        cut = flat(p["x"] + share * (q["x"] - p["x"]), p["y"] + share * (q["y"] - p["y"]), F.lit(NEAR))
        crossed = (p["d"] >= NEAR) != (q["d"] >= NEAR)
        return F.concat(here, F.when(crossed, F.array(cut)).otherwise(F.array()))

    return bound(points, lambda every: F.flatten(F.transform(every, lambda p, k: edge(p, k, every))))


def _band(polygon: Column, low: Column, high: Column) -> Column:
    """The x of a convex polygon's vertices between two heights and of its edges at either."""

    def edge(p, k):
        q = F.element_at(polygon, (k + 1) % F.size(polygon) + 1)

        def at(y):
            rise = F.when(p["y"] == q["y"], 1.0).otherwise(q["y"] - p["y"])
            x = p["x"] + (y - p["y"]) / rise * (q["x"] - p["x"])
            return F.when((p["y"] < y) != (q["y"] < y), F.array(x)).otherwise(F.array())

        inside = (p["y"] >= low) & (p["y"] <= high)
        return F.concat(F.when(inside, F.array(p["x"])).otherwise(F.array()), at(low), at(high))

    return F.flatten(F.transform(polygon, edge))


def assign_tiles(tiles: DataFrame, shifted: DataFrame, size: int = TILE) -> DataFrame:
    """Which canvas tiles each frame tile touches, joined by equality.

    The frame tile's quad is cut where it passes the horizon, so what is beyond has no place on the
    canvas. Tile rows come from the polygon's height; in each row the tiles come
    from the polygon's extent in that row, so a slanted quad lists no tile beside it. Keeps the
    columns of ``tiles``, those of the frame's size as frame_width and frame_height, and adds strip_id,
    h (of positive depth at the frame's centre), the canvas size and (cx, cy) of the canvas tile.
    """
    named = tiles.withColumnsRenamed({"width": "frame_width", "height": "frame_height"})
    posed = named.join(shifted, "frame_idx").withColumn(
        "h", facing(F.col("h"), F.col("frame_width"), F.col("frame_height"))
    )
    left, top = (F.col(c).cast("double") - 1 for c in ("x0", "y0"))
    right, low = (F.col("x0") + F.col("w")).cast("double"), (F.col("y0") + F.col("h0")).cast("double")
    corners = [(left, top), (right, top), (right, low), (left, low)]
    # a polygon through corners at the horizon has none
    seen = posed.withColumn("_polygon", _visible(F.col("h"), corners)).where(F.size("_polygon") > 2)

    def steps(least, most, side):
        """Numbers of the tiles that an interval meets, as an array, empty beside the canvas."""
        end = F.floor((F.col(side) - 1) / size)
        first = F.greatest(F.ceil((least - _SLACK - size + 1) / size), F.lit(0))
        last = F.least(F.floor((most + _SLACK) / size), end)
        return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(
            F.array().cast("array<int>")
        )

    height = F.transform("_polygon", lambda p: p["y"])
    rows = seen.withColumn("cy", F.explode(steps(F.array_min(height), F.array_max(height), "height")))
    band = _band(
        F.col("_polygon"), F.col("cy") * size - _SLACK, (F.col("cy") + 1) * size - 1 + _SLACK
    )
    across = rows.withColumn("_band", band).where(F.size("_band") > 0)
    found = across.withColumn("cx", F.explode(steps(F.array_min("_band"), F.array_max("_band"), "width")))
    return found.drop("_polygon", "_band")


_PATCH = pa.schema(
    [(c, pa.int32()) for c in ("strip_id", "tx", "ty", "frame_idx", "width", "height")]
    + [("frame_width", pa.int32()), ("frame_height", pa.int32())]
    + [(c, pa.int32()) for c in ("x0", "y0", "w", "h0", "bx", "by", "bw", "bh")]
    + [("h", pa.list_(pa.float64())), ("pixels", pa.binary())]
)
_PATCH_DDL = (
    "strip_id int, tx int, ty int, frame_idx int, width int, height int, frame_width int, "
    "frame_height int, x0 int, y0 int, w int, h0 int, bx int, by int, bw int, bh int, "
    "h array<double>, pixels binary"
)


def _cut_patch(size):
    """Keep only the source pixels the canvas tile can need."""

    def cut(row):
        tx, ty = row["cx"], row["cy"]
        xs = np.array([tx * size, min((tx + 1) * size, row["width"]) - 1], dtype=np.float64)
        ys = np.array([ty * size, min((ty + 1) * size, row["height"]) - 1], dtype=np.float64)
        try:
            back = np.linalg.inv(np.array(row["h"]).reshape(3, 3))
        except np.linalg.LinAlgError:  # shift leaves such frames out; a caller's own may come here
            return
        cx, cy = np.meshgrid(xs, ys)
        sx, sy, depth = back @ np.stack([cx.ravel(), cy.ravel(), np.ones(4)])
        bx, by, bw, bh = (row[c] for c in ("bx", "by", "bw", "bh"))
        x1, y1, x2, y2 = bx, by, bx + bw, by + bh
        if (depth > 1e-12).all() or (depth < -1e-12).all():
            sx, sy = sx / depth, sy / depth
            x1 = int(max(x1, np.floor(sx.min()) - 1))
            y1 = int(max(y1, np.floor(sy.min()) - 1))
            x2 = int(min(x2, np.floor(sx.max()) + 3))
            y2 = int(min(y2, np.floor(sy.max()) + 3))
        if x1 < x2 and y1 < y2:
            image = as_image(row["pixels"], bh, bw)[y1 - by : y2 - by, x1 - bx : x2 - bx]
            kept = {c: row[c] for c in _PATCH.names if c in row}
            kept.update(tx=tx, ty=ty, bx=x1, by=y1, bw=x2 - x1, bh=y2 - y1, pixels=image.tobytes())
            yield kept

    return cut


def patches(tiles: DataFrame, shifted: DataFrame, size: int = TILE) -> DataFrame:
    """Source rectangles cut per (canvas tile, frame tile) before anything is shuffled."""
    # a tile's own height is called h0 here, since h is the transform
    named = tiles.withColumnRenamed("h", "h0")
    assigned = assign_tiles(named, shifted, size).drop("tx", "ty")
    return assigned.mapInArrow(per_row(_cut_patch(size), _PATCH), _PATCH_DDL)


def warp_patch(row: dict, size: int, weight: str):
    """Weighted colours and weights this patch adds to its canvas tile, with their corner.

    Canvas pixels are mapped back to the frame. A pixel belongs to the frame tile
    that owns the whole part of its source position, so nothing is added twice.
    'uniform' multiplies the interpolated colour (zero outside) by its coverage;
    'feather' weighs by the distance to the frame edge.
    """
    x_first, y_first = row["tx"] * size, row["ty"] * size
    x_last = min(x_first + size, row["width"])
    y_last = min(y_first + size, row["height"])
    matrix = np.array(row["h"]).reshape(3, 3)
    back = np.linalg.inv(matrix).ravel()
    left, top = (row["x0"] - 1 if row["x0"] == 0 else row["x0"]), row["y0"] - (row["y0"] == 0)
    right, low = row["x0"] + row["w"], row["y0"] + row["h0"]
    ex, ey = np.array([left, right, right, left], float), np.array([top, top, low, low], float)
    u, v, d = matrix @ np.stack([ex, ey, np.ones(4)])
    if (d > 1e-9).all():
        x_first = max(x_first, int(np.clip(np.floor((u / d).min()), -2e9, 2e9)))
        y_first = max(y_first, int(np.clip(np.floor((v / d).min()), -2e9, 2e9)))
        x_last = min(x_last, int(np.clip(np.ceil((u / d).max()), -2e9, 2e9)) + 1)
        y_last = min(y_last, int(np.clip(np.ceil((v / d).max()), -2e9, 2e9)) + 1)
    if x_first >= x_last or y_first >= y_last:
        return None
    x, y = np.meshgrid(np.arange(x_first, x_last), np.arange(y_first, y_last))
    depth = back[6] * x + back[7] * y + back[8]
    safe = np.where(depth == 0, 1.0, depth)
    sx = np.where(depth == 0, -9.0, (back[0] * x + back[1] * y + back[2]) / safe)
    sy = np.where(depth == 0, -9.0, (back[3] * x + back[4] * y + back[5]) / safe)
    fw, fh = row["frame_width"], row["frame_height"]
    # whole-pixel positions must not fall to the pixel before through rounding
    sx, sy = (np.where(np.abs(s - np.rint(s)) < 1e-7, np.rint(s), s) for s in (sx, sy))
    own = (np.floor(sx) >= left) & (sx < right) & (np.floor(sy) >= top) & (sy < low)
    own &= (sx > -1) & (sx < fw) & (sy > -1) & (sy < fh)
    own &= matrix[2, 0] * sx + matrix[2, 1] * sy + matrix[2, 2] >= NEAR  # not beyond the horizon
    sx, sy = np.where(own, sx, -9.0), np.where(own, sy, -9.0)
    image = as_image(row["pixels"], row["bh"], row["bw"])
    if weight == "feather":
        value, _ = bilinear(image, row["bx"], row["by"], sx, sy, clamp=(fw, fh))
        w = np.minimum(np.minimum(sx + 1, fw - sx), np.minimum(sy + 1, fh - sy))
        w = np.where(own, w, 0.0)
    else:
        value, w = bilinear(image, row["bx"], row["by"], sx, sy)
        w = np.where(own, w, 0.0)
    colour = np.rint(value * w[..., None] * _UNIT).astype(np.int64)
    return x_first, y_first, colour, np.rint(w * _UNIT).astype(np.int64)


def _finished(sums, key, x0, y0, width, height):
    total, weights = sums[..., :3], sums[..., 3]
    mean = total / np.where(weights == 0, 1, weights)[..., None]
    bgr = np.clip(mean, 0, 255).astype(np.uint8)
    h, w = weights.shape
    names = dict(zip(_TILE, key), x0=x0, y0=y0, w=w, h=h, width=width, height=height)
    covered = (weights > 0).astype(np.uint8)
    return {**names, "bgr": bgr.tobytes(), "covered": covered.tobytes()}


_ADDED = pa.schema([*_MOSAIC, ("sums", pa.binary())])
_MOSAIC_DDL = (
    "strip_id int, tx int, ty int, x0 int, y0 int, w int, h int, width int, height int, "
    "bgr binary, covered binary"
)


def _rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


def _adder(size, weight):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for row in _rows_of(batches):
            if sums is None:
                key = [row[c] for c in _TILE]
                x0, y0 = row["tx"] * size, row["ty"] * size
                width, height, parts = row["width"], row["height"], row["parts"]
                shape = (min(size, height - y0), min(size, width - x0), 4)
                sums = np.zeros(shape, dtype=np.int64)
            try:
                found = warp_patch(row, size, weight)
            except Exception:  # a frame that cannot be warped is left out
                continue
            if found is not None:
                x, y, colour, w = found
                part = sums[y - y0 : y - y0 + w.shape[0], x - x0 : x - x0 + w.shape[1]]
                part[..., :3] += colour
                part[..., 3] += w
        if parts is None:
            done = _finished(sums, key, x0, y0, width, height)
        else:
            done = dict(zip(_TILE, key), x0=x0, y0=y0, w=shape[1], h=shape[0])
            done.update(width=width, height=height, sums=sums.tobytes())
        yield pa.RecordBatch.from_pylist([done], schema=_ADDED)

    return add


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = None
    for row in _rows_of(batches):
        part = np.frombuffer(row["sums"], dtype=np.int64).reshape(row["h"], row["w"], 4)
        sums = part.copy() if sums is None else sums + part
        last = row
    key = [last[c] for c in _TILE]
    done = _finished(sums, key, last["x0"], last["y0"], last["width"], last["height"])
    yield pa.RecordBatch.from_pylist([done], schema=_MOSAIC)


def blend(
    tiles: DataFrame, shifted: DataFrame, size: int = TILE, weight: str = "uniform"
) -> DataFrame:
    """The blended canvas tiles that a frame touches: sum of weighted colours over sum of weights.

    What no frame touches has no row; ``fill`` lists it. Patches are added as a stream per (tile, part).
    A tile has more than one part if very many patches lie on it; their sums are whole numbers, so parts
    and order do not change the result.
    """
    cut = settle(patches(tiles, shifted, size))  # counted, then added up
    load = cut.groupBy(*_TILE).agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowded = settle(load.select(*_TILE, F.ceil(F.sqrt(F.col("n"))).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("frame_idx", "bx", "by"), F.col("parts"))
    dealt = cut.join(crowded, _TILE, "left").withColumn("part", F.coalesce(part, F.lit(0)))
    keys = [*_TILE, "part"]
    added = spread(dealt, *keys).groupBy(*keys).applyInArrow(
        _adder(size, weight), f"{_MOSAIC_DDL}, sums binary"
    )
    if crowded.isEmpty():
        return added.drop("sums")
    added = settle(added)
    parts = added.where("sums is not null").drop("bgr", "covered")
    merged = parts.groupBy(*_TILE).applyInArrow(_merge, _MOSAIC_DDL)
    return added.where("sums is null").drop("sums").union(merged)


def fill(mosaic: DataFrame, canvases: DataFrame, size: int = TILE, merged: bool = False) -> DataFrame:
    """The mosaic with a row for each tile of the canvas that it lacks, of null pixels: blank ones.

    ``merged``, for ``crop_box``: only blank tiles beside others are listed one by one. The rest are rows of
    many tiles each, with a column ``rim`` (see ``_blank_areas``), so that their number grows with the tiles
    of the mosaic and not with the canvas.
    """
    usable = canvases.where(~F.col("refused") & (F.col("width") > 0) & (F.col("height") > 0))
    if merged:
        blank = _blank_areas(mosaic.select(*_TILE), usable, size)
        shown = mosaic.select(*_MOSAIC.names, F.lit(None).cast("array<long>").alias("rim"))
        return shown.unionByName(blank, allowMissingColumns=True)

    def steps(side):
        return F.explode(F.sequence(F.lit(0), F.floor((F.col(side) - 1) / size).cast("int")))

    blank = (
        usable.select("strip_id", "width", "height", steps("width").alias("tx"))
        .select("*", steps("height").alias("ty"))
        .join(mosaic.select(*_TILE), _TILE, "left_anti")
    )
    return mosaic.select(*_MOSAIC.names).unionByName(_placed(blank, size), allowMissingColumns=True)


def _placed(blank: DataFrame, size: int, tx2="tx", ty2="ty") -> DataFrame:
    """Rows of null pixels of the tiles (tx, ty) to (tx2, ty2)."""
    x0, y0 = F.col("tx") * size, F.col("ty") * size
    return blank.select(
        *_TILE, x0.alias("x0"), y0.alias("y0"),
        (F.least((F.col(tx2) + 1) * size, "width") - x0).alias("w"),
        (F.least((F.col(ty2) + 1) * size, "height") - y0).alias("h"),
        "width", "height", *[c for c in blank.columns if c == "rim"],
    )


def _blank_areas(tiles: DataFrame, usable: DataFrame, size: int) -> DataFrame:
    """Blank tiles of the canvas: one by one where they meet a tile, also by a corner; else in areas.

    An area is a run of tiles of a tile row, or, where rows have no tile and none beside them, all of these rows.
    Areas meet blank tiles only, and all blank tiles of a row between two tiles hang together. So one pixel tells
    that an area meets the blank tiles above or below it: the one where the area or the other area begins.
    ``rim`` lists such pixels of an area, its corners among them; it is null where the whole rim counts.
    """
    sized = settle(
        usable.select(
            "strip_id", "width", "height",
            *[F.floor((F.col(c) - 1) / size).cast("int").alias(n) for c, n in (("width", "ex"), ("height", "ey"))],
        )
    )
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    listed = (
        attach(tiles, sized.select("strip_id", "ex", "ey"), "strip_id")
        .select("strip_id", "ex", "ey", "tx", "ty", F.explode(near).alias("d"))
        .select("strip_id", "ex", "ey", (F.col("tx") + F.col("d.dx")).alias("tx"), (F.col("ty") + F.col("d.dy")).alias("ty"))
        .where("tx between 0 and ex and ty between 0 and ey")
        .distinct()
    )
    listed = settle(listed)

    def between(rows, keys, at, end):
        """Gaps first..last of the numbers ``at`` of each key, from 0 to its ``end``."""
        order = Window.partitionBy(*keys).orderBy(at)
        before = F.coalesce(F.lag(at).over(order), F.lit(-1)) + 1
        after = F.when(F.lead(at).over(order).isNull(), F.struct((F.col(at) + 1).alias("first"), F.col(end).alias("last")))
        gap = F.struct(before.alias("first"), (F.col(at) - 1).alias("last"))
        found = rows.select(*keys, "ex", F.array(gap, after).alias("gaps")).select(*keys, "ex", F.inline("gaps"))
        return found.where("first <= last")

    across = between(listed, ["strip_id", "ty"], "tx", "ex").selectExpr(
        "strip_id", "first AS tx", "ty", "last AS tx2", "ty AS ty2"
    )
    rows = listed.select("strip_id", "ty", "ex", "ey").distinct()
    none = sized.join(listed.select("strip_id").distinct(), "strip_id", "left_anti")
    lines = (
        between(rows, ["strip_id"], "ty", "ey")
        .unionByName(none.selectExpr("strip_id", "ex", "0 AS first", "ey AS last"))
        .selectExpr("strip_id", "0 AS tx", "first AS ty", "ex AS tx2", "last AS ty2")
    )
    areas = settle(across.unionByName(lines))
    # of each area, where the areas of the next tile rows begin within it
    sides = F.explode(
        F.array(
            F.struct(F.lit("low").alias("side"), F.col("ty2").alias("row"), (F.col("ty") - 1).alias("met")),
            F.struct(F.lit("top").alias("side"), F.col("ty").alias("row"), (F.col("ty2") + 1).alias("met")),
        )
    ).alias("s")
    ends = areas.select("strip_id", "tx", "ty", "tx2", sides)
    order = Window.partitionBy("strip_id", "side", "row").orderBy("tx", F.col("own").isNull())
    begun = (
        ends.select("strip_id", "s.side", "s.row", "tx", F.struct("tx", "ty", "tx2").alias("own"))
        .unionByName(ends.select("strip_id", "s.side", F.col("s.met").alias("row"), "tx"), allowMissingColumns=True)
        .withColumn("other", F.last("own", ignorenulls=True).over(order))
        .where(F.col("own").isNull() & (F.col("tx") <= F.col("other.tx2")))
        .groupBy("strip_id", F.col("other.tx").alias("tx"), F.col("other.ty").alias("ty"))
        .agg(F.collect_list(F.struct("side", (F.col("tx") * size).cast("long").alias("x"))).alias("met"))
    )
    x0, y0, wide = (F.col("tx") * size).cast("long"), (F.col("ty") * size).cast("long"), F.col("width").cast("long")
    x1 = F.least((F.col("tx2").cast("long") + 1) * size, wide) - 1
    y1 = F.least((F.col("ty2").cast("long") + 1) * size, F.col("height")) - 1
    met = F.coalesce("met", F.array().cast("array<struct<side:string,x:bigint>>"))
    others = F.transform(met, lambda m: F.when(m["side"] == "top", y0).otherwise(y1) * wide + m["x"])
    rim = F.array_distinct(F.concat(F.array(*[y * wide + x for y in (y0, y1) for x in (x0, x1)]), others))
    large = attach(areas.join(begun, ["strip_id", "tx", "ty"], "left"), sized, "strip_id").withColumn("rim", rim)
    alone = listed.join(tiles, _TILE, "left_anti")
    alone = attach(alone.select(*_TILE), sized, "strip_id")
    return _placed(alone, size).unionByName(_placed(large, size, "tx2", "ty2"), allowMissingColumns=True)


def grey(b: Column, g: Column, r: Column) -> Column:
    """Luma of a pixel, rounded."""
    return F.floor((b * 114 + g * 587 + r * 299 + 500) / 1000).cast("int")


def _grey_image(image: np.ndarray) -> np.ndarray:
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    return (b * 114 + g * 587 + r * 299 + 500) // 1000


def pixels(mosaic: DataFrame) -> DataFrame:
    """Long form: one row per pixel of the tiles that have any (strip_id, x, y, b, g, r, covered)."""
    names = ["strip_id", "x", "y", "b", "g", "r", "covered"]

    def listed(batches):
        for batch in batches:
            for row in _rows_of([batch]):
                if row["bgr"] is None:
                    continue
                image = as_image(row["bgr"], row["h"], row["w"])
                y, x = np.mgrid[0 : row["h"], 0 : row["w"]]
                seen = np.frombuffer(row["covered"], dtype=np.uint8)
                cells = [np.full(x.size, row["strip_id"]), x.ravel() + row["x0"], y.ravel() + row["y0"]]
                cells += [image[..., k].ravel() for k in range(3)] + [seen]
                arrays = [pa.array(c.astype(np.int32)) for c in cells]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return mosaic.mapInArrow(listed, ", ".join(f"{n} int" for n in names))


# --- crop: largest bright region with its holes filled ---

_REGION = pa.schema(
    [("strip_id", pa.int32()), ("tx", pa.int32()), ("ty", pa.int32()), ("region", pa.int64())]
    + [("n", pa.int64())]
    + [(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")]
    + [("outside", pa.bool_()), ("rim", pa.list_(pa.int64()))]
)
_REGION_DDL = (
    "strip_id int, tx int, ty int, region long, n long, x1 int, y1 int, x2 int, y2 int, "
    "outside boolean, rim array<long>"
)


def _tile_regions(threshold, eight):
    """Regions of one tile: dark ones (4-connected), or all but the outer dark (8-connected).

    A region is named by the reading-order number of its first pixel on the
    canvas. ``rim`` lists its pixels on the tile's edge, ``outside`` says whether
    it reaches the canvas edge. Dark regions without a rim are holes and not listed; of the
    others without one only the largest is, the first of equals.
    """

    def area(row):
        """The one region of a blank area of many tiles."""
        x, y, w, h, width, height = (row[c] for c in ("x0", "y0", "w", "h", "width", "height"))
        name = y * width + x
        if eight and name in (row["outer"] or []):
            return None
        box = {"x1": x, "y1": y, "x2": x + w - 1, "y2": y + h - 1}
        outside = x == 0 or y == 0 or x + w == width or y + h == height
        found = {c: row[c] for c in (*_TILE, "rim")}
        found.update(box, region=name, n=w * h, outside=outside)
        return pa.RecordBatch.from_pylist([found], schema=_REGION)

    def find(row):
        if row.get("rim") is not None:
            return area(row)
        h, w, width, height = row["h"], row["w"], row["width"], row["height"]
        if row["bgr"] is None:
            dark = np.ones((h, w), dtype=bool)
        else:
            dark = _grey_image(as_image(row["bgr"], h, w)) <= threshold
        mask = dark
        if eight:
            mask = ~dark
            if dark.any():
                image, runs = label_regions(dark, False)
                outer = np.isin(_names(runs, row), np.array(row["outer"] or [], dtype=np.int64))
                # a dark region that has no name among the outer ones is a hole
                mask = mask | ((image >= 0) & ~outer[image])
        if not mask.any():
            return None
        image, runs = label_regions(mask, eight)
        names = _names(runs, row)
        label, x1, x2, y = runs["label"], runs["start"], runs["end"], runs["row"]
        every, of = np.unique(label, return_inverse=True)

        def least(values):
            out = np.full(len(every), np.iinfo(np.int64).max)
            np.minimum.at(out, of, values)
            return out

        n = np.bincount(of, weights=x2 - x1 + 1).astype(np.int64)
        left, top, right, low = least(x1), least(y), -least(-x2), -least(-y)
        edge = np.zeros((h, w), dtype=bool)
        edge[[0, -1], :] = True
        edge[:, [0, -1]] = True
        ey, ex = np.nonzero(edge & mask)
        owner = np.searchsorted(every, image[ey, ex])
        order = np.argsort(owner, kind="stable")
        place = ((ey + row["y0"]) * np.int64(width) + ex + row["x0"])[order]
        lengths = np.bincount(owner, minlength=len(every))
        kept = lengths > 0
        if eight and not kept.all():
            kept[np.flatnonzero(~kept)[np.argmax(n[~kept])]] = True
        box = [left + row["x0"], top + row["y0"], right + row["x0"], low + row["y0"]]
        outside = (box[0] == 0) | (box[1] == 0) | (box[2] == width - 1) | (box[3] == height - 1)
        ends = np.r_[0, np.cumsum(lengths[kept])]
        columns = [np.full(kept.sum(), row[c]) for c in _TILE]
        columns += [c[kept] for c in (names[every], n, *box, outside)]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _REGION)]
        rims = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int64()))
        return pa.RecordBatch.from_arrays([*arrays, rims], schema=_REGION)

    def run(batches):
        for row in _rows_of(batches):
            found = find(row)
            if found is not None:
                yield found

    return run


def _names(runs, row):
    return (runs["row"] + row["y0"]) * np.int64(row["width"]) + runs["start"] + row["x0"]


def _joined_regions(regions: DataFrame, sizes: DataFrame, eight: bool) -> DataFrame:
    """(strip_id, region, root): tile regions that meet across tile edges share a root."""
    rim = regions.select("strip_id", "region", F.explode("rim").alias("place"))
    rim = attach(rim, sizes, "strip_id")
    x, y = F.col("place") % F.col("width"), F.floor(F.col("place") / F.col("width"))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if eight else [])
    onward = F.explode(
        F.array(
            *[
                F.when((x + dx >= 0) & (x + dx < F.col("width")), (y + dy) * F.col("width") + x + dx)
                for dx, dy in steps
            ]
        )
    )
    near = rim.select("strip_id", F.col("region").alias("a"), onward.alias("place"))
    edges = (
        near.where(F.col("place").isNotNull())
        .join(rim.select("strip_id", "place", F.col("region").alias("b")), ["strip_id", "place"])
        .where(F.col("a") != F.col("b"))
        .select("strip_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    return connected_roots(edges)


def connected_roots(edges: DataFrame) -> DataFrame:
    """(strip_id, region, root) of the nodes of an edge table (strip_id, u > v): smallest name.

    Alternates hooking to the smallest neighbour over larger and over smaller
    names; the number of rounds grows with the logarithm of the longest path. Ends
    when no edge is new, which is counted. A name with many neighbours is dealt by salts.
    """
    key = ["strip_id", "u"]
    edges, (left,) = settle_marked(edges, F.count("*"))
    while left:
        both = edges.union(edges.select("strip_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            with_least(both, key, "v", "m")
            .where("v > u")
            .select("strip_id", F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        small = (
            with_least(large, key, "v", "m")
            .select("strip_id", F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        new, (n,) = settle_marked(small, F.count("*"))
        # star edges replace others, so an equal set is one of equal size with nothing new
        same = n == left and new.join(edges, ["strip_id", "u", "v"], "left_anti").isEmpty()
        edges, left = new, 0 if same else n
    return edges.groupBy("strip_id", F.col("u").alias("region")).agg(F.min("v").alias("root"))


def _merged(regions: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = regions.join(roots, ["strip_id", "region"], "left")
    return rooted.withColumn("root", F.coalesce("root", "region"))


def crop_box(mosaic: DataFrame, threshold: int = 1) -> DataFrame:
    """Box of the largest bright region per strip: (strip_id, x0, y0, w, h, area).

    Dark regions that reach the canvas edge are outside; everything else,
    8-connected, is a region with its holes filled. Regions are found inside
    tiles and joined along tile edges. Tiles of null pixels are dark; those of no row are
    not looked at (``fill`` lists them, for this best ``merged``). Without any bright pixel the box is the
    whole canvas, with area 0. The mosaic is read more than once: give a written one.
    """
    sizes = mosaic.groupBy("strip_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    flat = mosaic.select(*_MOSAIC.names[:-1], *[c for c in mosaic.columns if c == "rim"])
    dark = settle(flat.mapInArrow(_tile_regions(threshold, False), _REGION_DDL))
    merged = _merged(dark, _joined_regions(dark, sizes, False))
    outer = merged.groupBy("strip_id", "root").agg(F.bool_or("outside").alias("out")).where("out")
    outer = (
        attach(merged, outer.select("strip_id", "root"), ["strip_id", "root"])
        .groupBy(*_TILE)
        .agg(F.collect_list("region").alias("outer"))
    )
    known = flat.join(outer, _TILE, "left")
    filled = settle(known.mapInArrow(_tile_regions(threshold, True), _REGION_DDL))
    whole = _merged(filled, _joined_regions(filled, sizes, True))
    totals = whole.groupBy("strip_id", "root").agg(
        F.sum("n").alias("area"),
        F.min("x1").alias("x1"),
        F.min("y1").alias("y1"),
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
    )
    best = totals.groupBy("strip_id").agg(
        F.max_by(F.struct("area", "x1", "y1", "x2", "y2"), F.struct(F.col("area"), -F.col("root"))).alias("b")
    )
    return sizes.join(best, "strip_id", "left").select(
        "strip_id",
        F.coalesce("b.x1", F.lit(0)).alias("x0"),
        F.coalesce("b.y1", F.lit(0)).alias("y0"),
        F.coalesce(F.col("b.x2") - F.col("b.x1") + 1, "width").alias("w"),
        F.coalesce(F.col("b.y2") - F.col("b.y1") + 1, "height").alias("h"),
        F.coalesce("b.area", F.lit(0)).alias("area"),
    )


def _trim(row):
    x1, y1 = max(row["x0"], row["cx"]), max(row["y0"], row["cy"])
    x2 = min(row["x0"] + row["w"], row["cx"] + row["cw"])
    y2 = min(row["y0"] + row["h"], row["cy"] + row["ch"])
    inside = np.s_[y1 - row["y0"] : y2 - row["y0"], x1 - row["x0"] : x2 - row["x0"]]
    bgr = covered = None
    if row["bgr"] is not None:
        bgr = as_image(row["bgr"], row["h"], row["w"])[inside].tobytes()
        covered = as_image(row["covered"], row["h"], row["w"], 1)[inside].tobytes()
    yield {
        "strip_id": row["strip_id"], "tx": row["tx"] - row["ftx"], "ty": row["ty"] - row["fty"],
        "x0": x1 - row["cx"], "y0": y1 - row["cy"], "w": x2 - x1, "h": y2 - y1,
        "width": row["cw"], "height": row["ch"],
        "bgr": bgr, "covered": covered,
    }


def crop(mosaic: DataFrame, boxes: DataFrame) -> DataFrame:
    """The part of each mosaic inside its box, counted from the box's corner."""
    box = boxes.select(
        "strip_id",
        F.col("x0").alias("cx"), F.col("y0").alias("cy"), F.col("w").alias("cw"), F.col("h").alias("ch"),
    )
    inside = (
        (F.col("x0") < F.col("cx") + F.col("cw")) & (F.col("x0") + F.col("w") > F.col("cx"))
        & (F.col("y0") < F.col("cy") + F.col("ch")) & (F.col("y0") + F.col("h") > F.col("cy"))
    )
    kept = attach(mosaic, box, "strip_id").where(inside)
    # the canvas tile with the box's corner: a tile at x0 with number tx tells the side of all

    def first(number, start, corner):
        there = F.floor(F.col(corner).cast("long") * F.col(number) / F.col(start))
        return F.when(F.col(number) > 0, there).otherwise(0).cast("int")

    kept = kept.withColumns({"ftx": first("tx", "x0", "cx"), "fty": first("ty", "y0", "cy")})
    return kept.mapInArrow(per_row(_trim, _MOSAIC), _MOSAIC_DDL)


def warp(cut: DataFrame, size: int = TILE, weight: str = "uniform") -> DataFrame:
    """Warped patches one by one, in long form: colour times weight and weight per canvas pixel.

    For looking at single frames; ``blend`` adds patches up without listing pixels.
    """
    names = ["strip_id", "frame_idx", "x", "y", "b", "g", "r", "weight"]

    def run(batches):
        for batch in batches:
            for row in _rows_of([batch]):
                found = warp_patch(row, size, weight)
                if found is None:
                    continue
                x0, y0, colour, w = found
                y, x = np.nonzero(w)
                cells = [np.full(len(x), row[c], dtype=np.int32) for c in names[:2]]
                cells += [(x + x0).astype(np.int32), (y + y0).astype(np.int32)]
                cells += [colour[y, x, k] / _UNIT for k in range(3)] + [w[y, x] / _UNIT]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names)

    ddl = "strip_id int, frame_idx int, x int, y int, b double, g double, r double, weight double"
    return cut.mapInArrow(run, ddl)


def overview(mosaic: DataFrame, k: int = 8) -> DataFrame:
    """Mean colour per k x k cell: (strip_id, x, y, b, g, r). Tiles add up their cells first.

    What has no tile counts as black, but cells of nothing else are not listed.
    """
    names = ["strip_id", "x", "y", "b", "g", "r", "width", "height"]

    def sums(batches):
        for batch in batches:
            for row in _rows_of([batch]):
                if row["bgr"] is None:
                    continue
                image = as_image(row["bgr"], row["h"], row["w"]).astype(np.int64)
                ys, xs = (np.arange(row[n]) + row[o] for n, o in (("h", "y0"), ("w", "x0")))
                wide = xs[-1] // k - xs[0] // k + 1
                cell = (ys // k - ys[0] // k)[:, None] * wide + (xs // k - xs[0] // k)[None, :]
                at = np.arange(cell[-1, -1] + 1)
                cells = [np.full(len(at), row["strip_id"]), at % wide + xs[0] // k, at // wide + ys[0] // k]
                cells += [np.bincount(cell.ravel(), weights=image[..., c].ravel()) for c in range(3)]
                cells += [np.full(len(at), row[c]) for c in names[6:]]
                arrays = [pa.array(c.astype(np.int64)) for c in cells]
                yield pa.RecordBatch.from_arrays(arrays, names)

    part = mosaic.mapInArrow(sums, ", ".join(f"{n} long" for n in names))
    sums = part.groupBy(*[F.col(c).cast("int").alias(c) for c in names[:3]]).agg(
        *[F.sum(c).alias(c) for c in "bgr"], *[F.max(c).alias(c) for c in names[6:]]
    )
    wide, high = (F.least((F.col(c) + 1).cast("long") * k, side) - F.col(c).cast("long") * k
                  for c, side in (("x", "width"), ("y", "height")))
    return sums.select(*names[:3], *[(F.col(c) / (wide * high)).alias(c) for c in "bgr"])


def mosaic_summary(mosaic: DataFrame, status: DataFrame = None) -> DataFrame:
    """Per strip: size, tiles, raw bytes and covered pixels.

    With the ``pose_status`` of the run also the frames laid out and the frames left out.
    """
    seen = F.length(F.translate(F.hex("covered"), "0", ""))  # bytes are 00 or 01
    summary = mosaic.groupBy("strip_id").agg(
        F.max("width").alias("width"),
        F.max("height").alias("height"),
        F.count("bgr").alias("n_tiles"),
        F.sum(F.length("bgr").cast("long")).alias("n_bytes"),
        F.sum(seen.cast("long")).alias("covered"),
    )
    if status is None:
        return summary
    used = status.groupBy("strip_id").agg(
        F.count_if(F.col("status") == "ok").alias("frames_used"),
        F.count_if(F.col("status") != "ok").alias("frames_left_out"),
    )
    return summary.join(used, "strip_id", "left")
