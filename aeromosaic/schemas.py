"""Table layouts. Every operator takes and returns one of these."""

from pyspark.sql import DataFrame, SparkSession

FRAMES_INDEX = "frame_idx int, path string, name string, n_bytes long, modified timestamp"
FRAMES = (
    "frame_idx int, name string, height int, width int, n_channels int, "
    "scale double, pixels binary"
)
# One row per rectangle of a frame: (x0, y0, w, h) is the part the tile owns,
# (bx, by, bw, bh) the part it carries pixels for (owned part plus halo).
TILES = (
    "frame_idx int, tx int, ty int, x0 int, y0 int, w int, h int, "
    "bx int, by int, bw int, bh int, width int, height int, pixels binary"
)
KEYPOINTS = (
    "frame_idx int, detector string, kp_id long, x double, y double, "
    "response double, descriptor array<float>, bits array<long>"
)
PAIRS = "i int, j int"
NEAREST = (
    "i int, j int, detector string, dir int, src_kp long, dst_kp long, "
    "distance double, error string"
)
MATCHES = "i int, j int, detector string, q_kp long, t_kp long, distance double"
PAIR_BEST = "i int, j int, detector string, n_matches long, score double, status string"
CHAIN = "strip_id int, pos int, frame_idx int"
CORRESPONDENCES = "i int, j int, m long, sx double, sy double, dx double, dy double"
LINKS = "i int, j int, model string, h array<double>, n_inliers long, spread double"
POSES = "strip_id int, pos int, frame_idx int, h array<double>"
CANVAS = (
    "strip_id int, x_min int, y_min int, width int, height int, scale double, "
    "est_bytes long, refused boolean"
)
# One row per canvas tile; width and height are those of the whole canvas.
MOSAIC = (
    "strip_id int, tx int, ty int, x0 int, y0 int, w int, h int, "
    "width int, height int, bgr binary, covered binary"
)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A frame of the given layout without rows (where a job has nothing to do)."""
    return spark.createDataFrame([], schema)
