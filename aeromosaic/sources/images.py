"""Reading a directory of aerial frames, shrinking them, and cutting them into tiles."""

import os

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.functions.failures import FAILED, split, succeeded, tried
from aeromosaic.functions.ordering import number_rows
from aeromosaic.functions.raster import as_image, per_row, shrink_area
from aeromosaic.schemas import FRAMES, TILES, empty

# File types read, and the box frames are fitted into by number of files.
FORMATS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif")
BOXES = ((30, 400, 300), (20, 500, 375), (0, 600, 450))

_FILES = "path string, name string, n_bytes long, modified timestamp"


def has_format(name: Column, formats=FORMATS) -> Column:
    """Whether a file name ends in one of the formats, in upper or lower case."""
    ending = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return ending.isin([f.lower() for f in formats])


def _glob(formats) -> str:
    """The formats as a file pattern, so that other files are not even listed as input."""
    endings = (
        "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in f) for f in formats
    )
    return "*{" + ",".join(endings) + "}"


def _loaded(reader, directory: str) -> DataFrame | None:
    """What a reader finds in a directory, or None if there is no such path."""
    try:
        return reader.load(directory)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _in_directory(path: Column, directory: str) -> Column:
    """Whether a file lies in the directory itself."""
    base = os.path.basename(os.path.normpath(directory))
    if base in ("", ".", ".."):
        return F.lit(True)
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1) == base


def plain_path(encoded: Column) -> Column:
    """A path as it was before its odd characters were written as %XX; + stands for itself."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def scan_images(spark: SparkSession, directory: str, formats=FORMATS) -> DataFrame:
    """Image files of a directory, not of its subdirectories.

    Only file facts are read, no content. A missing directory, a plain file or a
    directory without images gives an empty table.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", _glob(formats))
    files = _loaded(reader, directory)
    if files is None:
        return empty(spark, _FILES)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = files.select(
        "path",
        name.alias("name"),
        F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified"),
    ).where(has_format(name, formats))
    return found.where(_in_directory(F.col("path"), directory))


def number_frames(files: DataFrame) -> DataFrame:
    """Numbers 0, 1, ... in order of the file name."""
    return number_rows(files, ["name"], "frame_idx")


def fit_scale(width: Column, height: Column, n_files: Column) -> Column:
    """Scale that fits a frame into the box for this many files; frames never grow."""
    (many, *most), (some, *more), (_, *few) = BOXES
    wide, high = (
        F.when(n_files > many, most[k]).when(n_files > some, more[k]).otherwise(few[k])
        for k in range(2)
    )
    return F.least(wide / width, high / height, F.lit(1.0))


def _bgr(row):
    """Three colour channels from grey, colour or colour-with-alpha pixels."""
    image = as_image(row["pixels"], row["height"], row["width"], row["n_channels"])
    if row["n_channels"] == 1:
        image = np.repeat(image, 3, axis=2)
    return image[..., :3]


_FRAME = pa.schema(
    [("name", pa.string()), ("height", pa.int32()), ("width", pa.int32())]
    + [("n_channels", pa.int32()), ("scale", pa.float64()), ("pixels", pa.binary())]
)


def _resized(row):
    if row["height"] < 0:
        raise ValueError("not an image")
    image, scale = _bgr(row), row["scale"]
    h, w = row["height"], row["width"]
    if scale < 1.0:
        h, w = int(h * scale), int(w * scale)
        if not (h and w):
            raise ValueError("no pixels left")
        image = shrink_area(image, h, w)
    yield {
        "name": row["name"], "height": h, "width": w, "n_channels": 3,
        "scale": scale, "pixels": np.ascontiguousarray(image).tobytes(),
    }


def resize_tried(frames: DataFrame) -> DataFrame:
    """``resize_area`` with failures: what is no image, and frames that shrink to nothing."""
    rest = FRAMES.replace("frame_idx int, ", "")
    columns = [f.split()[0] for f in rest.split(", ")]
    run = tried("load", lambda row: row["name"], _resized, _FRAME)
    return frames.select(*columns).mapInArrow(run, f"{rest}, {FAILED}")


def resize_area(frames: DataFrame) -> DataFrame:
    """Frames shrunk by their ``scale`` column, each target pixel the mean of its area."""
    return succeeded(resize_tried(frames))


def decode(
    spark: SparkSession, directory: str, formats=FORMATS, keep_invalid: bool = False
) -> DataFrame:
    """Readable images of a directory: (name, height, width, n_channels, pixels) with BGR pixels.

    Files that are no image are left out, or with ``keep_invalid`` have sizes below zero.
    """
    reader = spark.read.format("image").option("dropInvalid", not keep_invalid)
    images = _loaded(reader.option("pathGlobFilter", _glob(formats)), directory)
    if images is None:
        return empty(
            spark, "name string, height int, width int, n_channels int, pixels binary"
        )
    origin = plain_path(F.col("image.origin"))
    return images.where(_in_directory(origin, directory)).select(
        F.regexp_extract(origin, r"([^/]+)$", 1).alias("name"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("pixels"),
    )


def load_tried(
    spark: SparkSession, directory: str, formats=FORMATS, box: tuple[int, int] | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The frames of a directory, scanned, decoded, shrunk and numbered; and the files that failed.

    Frames keep their size unless ``box`` is a width and height to fit them into, or
    "by_count", which takes the box from the number of files found (``BOXES``). The numbers
    run over the files that could be read. Pixels are written once, and only names are sorted.
    """
    raw, width, height = decode(spark, directory, formats, True), F.col("width"), F.col("height")
    if box is None:
        scale = F.lit(1.0)
    elif box == "by_count":
        files = scan_images(spark, directory, formats)
        raw = raw.withColumn("n_files", files.agg(F.count("*")).scalar())
        scale = fit_scale(width, height, F.col("n_files"))
    else:
        scale = F.least(F.lit(float(box[0])) / width, F.lit(float(box[1])) / height, F.lit(1.0))
    ready, failures = split(resize_tried(raw.withColumn("scale", scale)))
    numbers = number_frames(ready.select("name"))
    frames = numbers.join(ready, "name").select(
        "frame_idx", "name", "height", "width", "n_channels", "scale", "pixels"
    )
    return frames, failures


def load_frames(
    spark: SparkSession, directory: str, formats=FORMATS, box: tuple[int, int] | str | None = None
) -> DataFrame:
    """The frames of ``load_tried`` alone."""
    return load_tried(spark, directory, formats, box)[0]


def load_counts(files: DataFrame, frames: DataFrame) -> DataFrame:
    """One row: files found and frames loaded."""
    found = files.agg(F.count("*").alias("found"))
    return found.select("found", frames.agg(F.count("*")).scalar().alias("loaded"))


_TILE = pa.schema(
    [(f.split()[0], pa.binary() if f.endswith("binary") else pa.int32()) for f in TILES.split(", ")]
)


def to_tiles(frames: DataFrame, size: int = 512, halo: int = 1) -> DataFrame:
    """Frames cut into tiles of at most size x size plus ``halo`` pixels around, where they exist."""

    def cut(row):
        width, height = row["width"], row["height"]
        image = as_image(row["pixels"], height, width)
        for y in range(0, height, size):
            for x in range(0, width, size):
                w, h = min(size, width - x), min(size, height - y)
                x1, y1 = max(x - halo, 0), max(y - halo, 0)
                x2, y2 = min(x + w + halo, width), min(y + h + halo, height)
                yield {
                    "frame_idx": row["frame_idx"], "tx": x // size, "ty": y // size,
                    "x0": x, "y0": y, "w": w, "h": h,
                    "bx": x1, "by": y1, "bw": x2 - x1, "bh": y2 - y1,
                    "width": width, "height": height,
                    "pixels": image[y1:y2, x1:x2].tobytes(),
                }

    columns = ["frame_idx", "width", "height", "pixels"]
    return frames.select(*columns).mapInArrow(per_row(cut, _TILE), TILES)


def assemble(tiles: DataFrame) -> DataFrame:
    """Frames (frame_idx, width, height, pixels) put together again from their tiles."""
    schema = pa.schema(
        [("frame_idx", pa.int32()), ("width", pa.int32()), ("height", pa.int32())]
        + [("pixels", pa.binary())]
    )

    def join(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        width, height = rows[0]["width"], rows[0]["height"]
        whole = np.zeros((height, width, 3), dtype=np.uint8)
        for row in rows:
            x, y, w, h = (row[c] for c in ("x0", "y0", "w", "h"))
            part = as_image(row["pixels"], row["bh"], row["bw"])
            part = part[y - row["by"] :, x - row["bx"] :][:h, :w]
            whole[y : y + h, x : x + w] = part
        done = {"frame_idx": rows[0]["frame_idx"], "width": width, "height": height}
        return pa.Table.from_pylist([{**done, "pixels": whole.tobytes()}], schema=schema)

    return tiles.groupBy("frame_idx").applyInArrow(
        join, "frame_idx int, width int, height int, pixels binary"
    )
