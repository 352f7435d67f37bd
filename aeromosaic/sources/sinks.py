"""Writing mosaics: as a table, and as one PNG per tile."""

import posixpath
import struct
import time
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from aeromosaic.functions.raster import as_image
from aeromosaic.schemas import empty
from aeromosaic.sources.images import plain_path


def write_mosaic(mosaic: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One parquet table; outputs of different steps are told apart by ``variant``."""
    mosaic.write.mode(mode).partitionBy("variant").parquet(path)


def png_bytes(bgr: np.ndarray) -> bytes:
    """A colour image in PNG coding."""
    rgb = np.ascontiguousarray(bgr[..., ::-1])
    h, w = rgb.shape[:2]
    lines = np.zeros((h, 1 + 3 * w), dtype=np.uint8)
    lines[:, 1:] = rgb.reshape(h, 3 * w)

    def chunk(kind, body):
        check = zlib.crc32(kind + body)
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", check)

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", head)
        + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6))
        + chunk(b"IEND", b"")
    )


def _publish(system, path: str, data: bytes) -> None:
    """Write a file under a hidden name and give it its own in one move."""
    folder, name = posixpath.split(path)
    hidden = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, path)


@dataclass
class _Written(WriterCommitMessage):
    listing: str


class _TileWriter(DataSourceWriter):
    """Two phases: tasks fill the folder of their job, the commit publishes it by a manifest.

    Each task ends with a list of its files; the manifest names the lists of the tasks that
    count, one line a task, so neither files nor names go through the driver. File names follow
    from the tile, so a task that runs again replaces what it left.
    """

    def __init__(self, path, job):
        self.path, self.job = path, job

    def write(self, rows):
        system, root = fs.FileSystem.from_uri(self.path)
        folder = posixpath.join(root, f"job-{self.job}")
        system.create_dir(folder, recursive=True)
        names = []
        for row in rows:
            variant = row["variant"] if "variant" in row else "mosaic"
            names.append(f"{variant}_{row['strip_id']}_{row['ty']}_{row['tx']}.png")
            image = as_image(bytes(row["bgr"]), row["h"], row["w"])
            _publish(system, posixpath.join(folder, names[-1]), png_bytes(image))
        listing = f"task-{uuid.uuid4().hex}.list"
        _publish(system, posixpath.join(folder, listing), "\n".join(names).encode())
        return _Written(listing)

    def commit(self, messages):
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(posixpath.join(root, "manifests"), recursive=True)
        lines = "\n".join(f"job-{self.job}/{m.listing}" for m in messages if m)
        name = f"{time.time_ns():020d}-{self.job}.txt"
        _publish(system, posixpath.join(root, "manifests", name), lines.encode())

    def abort(self, messages):
        """Nothing of the job was published; its folder goes.

        Tasks that have not been stopped yet may still write to it. What they keep from being
        deleted is in no manifest, so no reader sees it.
        """
        system, root = fs.FileSystem.from_uri(self.path)
        folder = posixpath.join(root, f"job-{self.job}")
        for wait in (0.2, 1, 5):
            if system.get_file_info(folder).type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(folder)
            except OSError:
                time.sleep(wait)


class TileImages(DataSource):
    """Sink ``tileimages``: a mosaic table as one PNG per tile under a shared path."""

    @classmethod
    def name(cls):
        return "tileimages"

    def writer(self, schema, overwrite):
        return _TileWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex)


def write_tile_images(mosaic: DataFrame, path: str) -> str:
    """One PNG per tile, named by variant, strip, row and column; returns the folder they are in.

    Each call fills a folder of its own under ``path``. ``read_tile_images`` sees a call's files
    all at once, when it has ended, and nothing of a call that failed.
    """
    spark = mosaic.sparkSession
    spark.dataSource.register(TileImages)
    # a path without a scheme is one of the session's file system, not of each worker
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    target = system.makeQualified(place).toUri().toString().replace("file:/", "file:///", 1)
    keep = [c for c in ("variant", "strip_id", "tx", "ty", "w", "h", "bgr") if c in mosaic.columns]
    job = uuid.uuid4().hex
    mosaic.select(*keep).write.format("tileimages").option("job", job).mode("append").save(target)
    return f"{path}/job-{job}"


def committed_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(name, job) of the published files; of each name the one published last."""
    file = F.col("_metadata.file_path")
    try:
        manifests = spark.read.text(f"{path}/manifests")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, "name string, job string")
        raise
    at = F.regexp_extract(file, r"/(\d+)-[0-9a-f]+\.txt$", 1).alias("at")
    lists = manifests.select(F.col("value").alias("listing"), at).where("listing <> ''")
    files = spark.read.option("pathGlobFilter", "*.list").text(f"{path}/job-*")
    listing = F.regexp_extract(file, r"(job-[0-9a-f]+/task-[0-9a-f]+\.list)$", 1).alias("listing")
    named = files.select(F.col("value").alias("name"), listing).where("name <> ''").join(lists, "listing")
    return named.groupBy("name").agg(
        F.max_by(F.regexp_extract("listing", "^job-([0-9a-f]+)/", 1), "at").alias("job")
    )


def read_tile_images(spark: SparkSession, path: str) -> DataFrame:
    """(variant, strip_id, ty, tx, w, h, bgr) of the published tiles; a path without any is empty."""
    tiles = committed_tiles(spark, path)
    parts = r"^(.*)_(-?\d+)_(\d+)_(\d+)\.png$"
    place = [
        F.regexp_extract("name", parts, 1).alias("variant"),
        *[F.regexp_extract("name", parts, k).cast("int").alias(c) for k, c in enumerate(("strip_id", "ty", "tx"), 2)],
    ]
    reader = spark.read.format("image").option("pathGlobFilter", "*.png")
    try:
        images = reader.load(f"{path}/job-*")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, "variant string, strip_id int, ty int, tx int, w int, h int, bgr binary")
        raise
    origin = plain_path(F.col("image.origin"))
    found = images.select(
        F.regexp_extract(origin, r"([^/]+)$", 1).alias("name"),
        F.regexp_extract(origin, r"/job-([0-9a-f]+)/[^/]+$", 1).alias("job"),
        F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.data").alias("bgr"),
    )
    return found.join(tiles, ["name", "job"]).select(*place, "w", "h", "bgr")
