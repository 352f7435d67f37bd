"""Enhancement of tiled mosaics: stencils with a halo exchange, and tile-wise contrast."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeromosaic.functions import filters
from aeromosaic.functions.failures import FAILED, FAILED_FIELD, failure
from aeromosaic.functions.ordering import attach, settle, spread
from aeromosaic.functions.raster import as_image, per_row
from aeromosaic.schemas import MOSAIC

_TILE = ["strip_id", "tx", "ty"]
_PLACE = ["x0", "y0", "w", "h", "width", "height"]
_INTS = [(c, pa.int32()) for c in (*_TILE, *_PLACE)]
_MOSAIC = pa.schema([*_INTS, ("bgr", pa.binary()), ("covered", pa.binary())])
_PIECE = pa.schema(
    [(c, pa.int32()) for c in (*_TILE, "px", "py", "pw", "ph")]
    + [(c, pa.int32()) for c in _PLACE]
    + [("pixels", pa.binary()), ("covered", pa.binary())]
)
_PIECE_DDL = (
    "strip_id int, tx int, ty int, px int, py int, pw int, ph int, x0 int, y0 int, w int, h int, "
    "width int, height int, pixels binary, covered binary"
)


def _pieces(r):
    """The tile for itself, and its border strips for the neighbours that need them."""

    def cut(row):
        if row["bgr"] is None:
            piece = {c: None for c in _PIECE.names}
            piece.update({c: row[c] for c in (*_TILE, *_PLACE)}, px=row["x0"], py=row["y0"], pw=0, ph=0)
            yield piece
            return
        image = as_image(row["bgr"], row["h"], row["w"])
        x, y, w, h = (row[c] for c in ("x0", "y0", "w", "h"))
        spans = {-1: (0, r), 0: (0, max(w, h)), 1: (-r, None)}
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                own = dx == 0 and dy == 0
                if (dx < 0 and x == 0) or (dx > 0 and x + w == row["width"]):
                    continue
                if (dy < 0 and y == 0) or (dy > 0 and y + h == row["height"]):
                    continue
                rows, cols = (np.arange(n)[slice(*spans[d])] for n, d in ((h, dy), (w, dx)))
                part = image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
                piece = {c: None for c in _PIECE.names}
                piece.update(
                    strip_id=row["strip_id"], tx=row["tx"] + dx, ty=row["ty"] + dy,
                    px=x + int(cols[0]), py=y + int(rows[0]), pw=len(cols), ph=len(rows),
                    pixels=part.tobytes(),
                )
                if own:
                    piece.update({c: row[c] for c in (*_PLACE, "covered")})
                yield piece

    return cut


def _padded(rows: list[dict], r: int):
    """The tile's row and its pixels with r more on each side, mirrored at the canvas edge.

    No row for strips sent to a tile that does not exist, no pixels for a blank tile among blank ones.
    """
    own = next((row for row in rows if row["w"] is not None), None)
    rows = [row for row in rows if row["pixels"] is not None]
    if own is None or not rows:
        return own, None
    x, y, w, h = (own[c] for c in ("x0", "y0", "w", "h"))
    left, top = min(r, x), min(r, y)
    right, low = min(r, own["width"] - x - w), min(r, own["height"] - y - h)
    whole = np.zeros((top + h + low, left + w + right, 3), dtype=np.uint8)
    for row in rows:
        px, py = row["px"] - x + left, row["py"] - y + top
        part = as_image(row["pixels"], row["ph"], row["pw"])
        part = part[max(0, -py) :, max(0, -px) :]
        px, py = max(px, 0), max(py, 0)
        part = part[: whole.shape[0] - py, : whole.shape[1] - px]
        whole[py : py + part.shape[0], px : px + part.shape[1]] = part
    sides = ((r - top, r - low), (r - left, r - right), (0, 0))
    return own, np.pad(whole, sides, mode="reflect")


def _item(row):
    return "/".join(str(row[c]) for c in ("strip_id", "ty", "tx"))


def _filtered(mosaic, r, steps, kept):
    """Group function over the pieces of all tiles; a filter's failure is a row if ``kept``, else it is raised."""
    schema = pa.schema([*_MOSAIC, ("variant", pa.string()), FAILED_FIELD])

    def run(table: pa.Table) -> pa.Table:
        own, image = _padded(table.to_pylist(), r)
        if own is None:
            return schema.empty_table()
        place = {c: own[c] for c in (*_TILE, *_PLACE)}
        if image is None:
            return pa.Table.from_pylist([{**place, "variant": name} for name in steps], schema=schema)
        covered = own["covered"] or bytes(own["w"] * own["h"])
        done = []
        for name, (need, function) in steps.items():
            spare = r - need
            inner = image[spare : image.shape[0] - spare, spare : image.shape[1] - spare]
            step = f"filter {name}".strip()
            try:
                result = function(inner)
            except Exception as problem:
                if not kept:
                    raise RuntimeError(f"{step}, tile {_item(own)}: {problem}") from problem
                done.append({**place, "variant": name, "failed": failure(step, _item(own), problem)})
                continue
            done.append({**place, "bgr": result.tobytes(), "covered": covered, "variant": name})
        return pa.Table.from_pylist(done, schema=schema)

    pieces = mosaic.mapInArrow(per_row(_pieces(r), _PIECE), _PIECE_DDL)
    return spread(pieces, *_TILE).groupBy(*_TILE).applyInArrow(
        run, f"{MOSAIC}, variant string, {FAILED}"
    )


def stencil_tried(mosaic: DataFrame, r: int, steps: dict) -> DataFrame:
    """Apply filters that look r pixels around; one halo exchange for all of them.

    ``steps`` names functions from a padded image (r extra pixels per side, more
    than a function needs are cut off) to the inside. Result rows carry the name
    in ``variant``. Full tiles must be at least r wide. A tile that a filter fails on has a row
    without pixels that says so in ``failed``: it is no picture, and not a blank one either.
    A tile of null pixels is black; it stays null where all around it are.
    """
    return _filtered(mosaic, r, steps, True)


def stencil(mosaic: DataFrame, r: int, steps: dict) -> DataFrame:
    """The pictures of ``stencil_tried``, all of them: a filter that fails on a tile ends the job."""
    return _filtered(mosaic, r, steps, False).drop("failed")


def _one(mosaic, need, function):
    return stencil(mosaic, need, {"": (need, function)}).drop("variant")


def _blur(ksize, sigma):
    weights = filters.gaussian_weights(ksize, sigma)
    return len(weights) // 2, lambda image: filters.gaussian(image, weights)


def gaussian(mosaic: DataFrame, ksize: int = 7, sigma: float = 0.0) -> DataFrame:
    """Gaussian blur; ksize 0 takes the size from sigma."""
    return _one(mosaic, *_blur(ksize, sigma))


def _inside(image, r):
    return image[r : image.shape[0] - r, r : image.shape[1] - r]


def _sharpener(sigma=3.0):
    r, blur = _blur(0, sigma)
    return r, lambda image: filters.unsharp(_inside(image, r), blur(image))


def unsharp(mosaic: DataFrame, sigma: float = 3.0) -> DataFrame:
    """1.5 times the image minus half its blur."""
    return _one(mosaic, *_sharpener(sigma))


def bilateral(mosaic: DataFrame, d: int = 9, sigma_color=75.0, sigma_space=75.0) -> DataFrame:
    return _one(mosaic, d // 2, lambda image: filters.bilateral(image, d, sigma_color, sigma_space))


def nlmeans(mosaic: DataFrame, h=10.0, h_color=10.0, template=7, search=21) -> DataFrame:
    need = search // 2 + template // 2
    return _one(mosaic, need, lambda image: filters.nlmeans(image, h, h_color, template, search))


def _smoothers(template, search):
    """The four smoothing variants with the pixels they need around them."""
    r, blur = _blur(7, 0.0)
    need = search // 2 + template // 2

    def means(image):
        return filters.nlmeans(image, template=template, search=search)

    def combo(image):
        return blur(means(filters.bilateral(image)))

    return {
        "bilateral": (4, filters.bilateral),
        "nlmeans": (need, means),
        "gaussian": (r, blur),
        "smooth_combo": (4 + need + r, combo),
    }


def smooth_combo(mosaic: DataFrame, template: int = 7, search: int = 21) -> DataFrame:
    """Bilateral, then non-local means, then Gaussian, over one wide halo instead of three."""
    need, function = _smoothers(template, search)["smooth_combo"]
    return _one(mosaic, need, function)


def to_lab(mosaic: DataFrame) -> DataFrame:
    """The mosaic with L, a, b in place of b, g, r."""
    return _pointwise(mosaic, filters.to_lab)


def from_lab(mosaic: DataFrame) -> DataFrame:
    return _pointwise(mosaic, filters.from_lab)


def _pointwise(mosaic, function):
    def run(row):
        if row["bgr"] is None:
            yield row
            return
        yield {**row, "bgr": function(as_image(row["bgr"], row["h"], row["w"])).tobytes()}

    return mosaic.select(*_MOSAIC.names).mapInArrow(per_row(run, _MOSAIC), MOSAIC)


# --- contrast-limited adaptive histogram equalization of lightness ---


def _cells(x, length, n):
    """Cells of each coordinate and of its mirror images that fill the n cells, -1 for none."""
    cell = -(-length // n)
    turn = max(2 * length - 2, 1)
    found = []
    for k in range(-(-cell * n // turn)):
        for place, own in ((x + k * turn, (k == 0) | (x > 0) | (length == 1)), ((k + 1) * turn - x, x < length - 1)):
            found.append(np.where(own & (place < cell * n), place // cell, -1))
    return found


def cell_histograms(mosaic: DataFrame, grid: int = 8) -> DataFrame:
    """(strip_id, cy, cx, level, n): lightness counts per grid cell, added up per tile first.

    Cells are equal; the canvas is mirrored at its right and lower edge to fill them. What no
    tile shows is black.
    """
    names = ["strip_id", "cy", "cx", "level", "n"]
    schema = pa.schema([(c, pa.int32()) for c in names[:4]] + [("n", pa.int64())])

    def count(row):
        if row["bgr"] is None:
            return
        light = filters.to_lab(as_image(row["bgr"], row["h"], row["w"]))[..., 0].astype(np.int64)
        xs = _cells(np.arange(row["x0"], row["x0"] + row["w"]), row["width"], grid)
        ys = _cells(np.arange(row["y0"], row["y0"] + row["h"]), row["height"], grid)
        counts = np.zeros(grid * grid * 256, dtype=np.int64)
        for cy in ys:
            for cx in xs:
                place = (cy[:, None] * grid + cx[None, :]) * 256 + light
                used = (cy >= 0)[:, None] & (cx >= 0)[None, :]
                counts += np.bincount(place[used], minlength=len(counts))
        for k in np.nonzero(counts)[0]:
            cell, level = divmod(int(k), 256)
            values = [row["strip_id"], cell // grid, cell % grid, level, int(counts[k])]
            yield dict(zip(names, values))

    part = mosaic.mapInArrow(per_row(count, schema), "strip_id int, cy int, cx int, level int, n long")
    seen = part.groupBy("strip_id", "cy", "cx", "level").agg(F.sum("n").alias("n"))
    high, wide = (F.ceil(F.max(c) / grid) for c in ("height", "width"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    areas = (
        mosaic.groupBy("strip_id").agg((high * wide).alias("area"))
        .select("*", numbers.alias("cy")).select("*", numbers.alias("cx"))
    )
    shown = seen.groupBy("strip_id", "cy", "cx").agg(F.sum("n").alias("shown"))
    black = areas.join(shown, ["strip_id", "cy", "cx"], "left").select(
        "strip_id", "cy", "cx", F.lit(0).alias("level"), (F.col("area") - F.coalesce("shown", F.lit(0))).alias("n")
    )
    return seen.union(black.where("n > 0")).groupBy("strip_id", "cy", "cx", "level").agg(F.sum("n").alias("n"))


def clahe_tables(histograms: DataFrame, clip: float = 2.0) -> DataFrame:
    """(strip_id, cy, cx, level, value): equalizing tables after clipping and spreading the excess.

    The excess goes to all levels evenly, its rest to evenly spaced ones. A cell
    has 256 levels, so its window is small whatever the image.
    """
    cell = ["strip_id", "cy", "cx"]
    level, n = F.col("level"), F.col("n")
    every = (
        histograms.groupBy(*cell)
        .agg(F.sum("n").alias("area"))
        .select(*cell, "area", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("level"))
    )
    limit = F.greatest(F.floor(F.lit(clip) * F.col("area") / 256), F.lit(1))
    clipped = (
        every.join(histograms, [*cell, "level"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("limit", limit)
        .withColumn("excess", F.sum(F.greatest(n - F.col("limit"), F.lit(0))).over(Window.partitionBy(*cell)))
    )
    rest = F.col("excess") % 256
    step = F.greatest(F.floor(F.lit(256) / F.greatest(rest, F.lit(1))), F.lit(1))
    extra = F.when((level % step == 0) & (F.floor(level / step) < rest), 1).otherwise(0)
    given = F.least(n, F.col("limit")) + F.floor(F.col("excess") / 256) + extra
    below = Window.partitionBy(*cell).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(given).over(below)
    value = F.least(F.bround(total * 255 / F.col("area"), 0), F.lit(255)).cast("int")
    return clipped.select(*cell, "level", value.alias("value"))


def _two(value):
    """A byte as two hexadecimal digits."""
    return F.lpad(F.hex(value), 2, "0")


def clahe(mosaic: DataFrame, clip: float = 2.0, grid: int = 8) -> DataFrame:
    """Lightness equalized by the tables of the four nearest cells, mixed by distance.

    The tables lift black, so tiles of null pixels get some.
    """
    tables = (
        clahe_tables(cell_histograms(mosaic, grid), clip)
        .groupBy("strip_id")
        .agg(F.sort_array(F.collect_list(F.struct("cy", "cx", "level", "value"))).alias("t"))
        .select("strip_id", F.unhex(F.array_join(F.transform("t.value", _two), "")).alias("values"))
    )

    def near(x, length):
        place = x / -(-length // grid) - 0.5
        first = np.floor(place).astype(np.int64)
        return np.clip(first, 0, grid - 1), np.clip(first + 1, 0, grid - 1), place - first

    def run(row):
        pixels = row["bgr"] or bytes(3 * row["h"] * row["w"])
        image = filters.to_lab(as_image(pixels, row["h"], row["w"]))
        values = np.frombuffer(row["values"], np.uint8).astype(np.float64).reshape(grid, grid, 256)
        y1, y2, ay = near(np.arange(row["y0"], row["y0"] + row["h"]), row["height"])
        x1, x2, ax = near(np.arange(row["x0"], row["x0"] + row["w"]), row["width"])
        light, mixed = image[..., 0], 0.0
        for ys, wy in ((y1, 1 - ay), (y2, ay)):
            for xs, wx in ((x1, 1 - ax), (x2, ax)):
                mixed = mixed + values[ys[:, None], xs[None, :], light] * (wy[:, None] * wx[None, :])
        image[..., 0] = np.clip(np.rint(np.round(mixed, 9)), 0, 255)
        kept = {c: row[c] for c in _MOSAIC.names}
        kept["covered"] = kept["covered"] or bytes(row["h"] * row["w"])
        yield {**kept, "bgr": filters.from_lab(image).tobytes()}

    joined = attach(mosaic.select(*_MOSAIC.names), tables, "strip_id", grid * grid * 256)
    return joined.mapInArrow(per_row(run, _MOSAIC), MOSAIC)


def enhanced(cropped: DataFrame) -> DataFrame:
    """Variants of the cropped mosaic: sharpened, and sharpened with contrast."""
    sharp = settle(unsharp(cropped))  # a variant, and read twice for the other
    return sharp.withColumn("variant", F.lit("sharpened")).unionByName(
        clahe(sharp).withColumn("variant", F.lit("enhanced"))
    )


def enhanced_tried(cropped: DataFrame) -> DataFrame:
    """``enhanced`` with a column ``failed``, see ``stencil_tried``.

    Contrast tables are those of a whole strip: one that lacks a sharpened tile has no picture with
    contrast, and all its tiles say so.
    """
    need, function = _sharpener()
    sharp = settle(stencil_tried(cropped, need, {"sharpened": (need, function)}))
    broken = settle(sharp.where("failed is not null").select("strip_id").distinct())
    whole = sharp.join(F.broadcast(broken), "strip_id", "left_anti")
    lacking = sharp.join(F.broadcast(broken), "strip_id", "left_semi").select(
        *_TILE, *_PLACE, F.lit("enhanced").alias("variant"),
        F.struct(
            F.lit("filter enhanced").alias("step"),
            F.concat_ws("/", "strip_id", "ty", "tx").alias("item"),
            F.lit("ValueError: the strip has tiles that were not sharpened").alias("error"),
        ).alias("failed"),
    )
    contrast = clahe(whole).withColumn("variant", F.lit("enhanced"))
    return sharp.unionByName(contrast, allowMissingColumns=True).unionByName(lacking, allowMissingColumns=True)


def _smoothing(template, search):
    steps = _smoothers(template, search)
    return max(need for need, _ in steps.values()), steps


def smoothed(uncropped: DataFrame, template: int = 7, search: int = 21) -> DataFrame:
    """The four smoothing variants, all from one halo exchange."""
    return stencil(uncropped, *_smoothing(template, search))


def _all_variants(uncropped, cropped, *made):
    """The pictures as they are and those made of them; rows of neither pixels nor a failure are blank tiles."""
    every = uncropped.withColumn("variant", F.lit("uncropped")).unionByName(
        cropped.withColumn("variant", F.lit("cropped"))
    )
    for rows in made:
        every = every.unionByName(rows, allowMissingColumns=True)
    return every


def variants_tried(uncropped: DataFrame, cropped: DataFrame, template: int = 7, search: int = 21) -> DataFrame:
    """``variants`` with a column ``failed``, set in rows without pixels: tiles that a filter failed on.

    Blank tiles of both pictures are wanted as rows of null pixels and not given back as such.
    """
    smooth = stencil_tried(uncropped, *_smoothing(template, search))
    every = _all_variants(uncropped, cropped, enhanced_tried(cropped), smooth)
    return every.where(F.col("bgr").isNotNull() | F.col("failed").isNotNull())


def variants(uncropped: DataFrame, cropped: DataFrame, template: int = 7, search: int = 21) -> DataFrame:
    """Every output picture in one table, told apart by ``variant``.

    ``template`` and ``search`` are the sizes of non-local means. A filter that fails on a tile ends the job.
    """
    smooth = smoothed(uncropped, template, search)
    return _all_variants(uncropped, cropped, enhanced(cropped), smooth).where(F.col("bgr").isNotNull())
