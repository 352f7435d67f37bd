"""Operator inputs derived from the given tables.

Each function reads whole tables and gives one of the layouts of schemas.py; the
SQL constants beside them say the same in the dialect of the check engine.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import running_sum
from aeromosaic.schemas import FRAMES, MOSAIC

# Fixed parameters of the derived inputs.
RATIO, MIN_MATCHES, WINDOW = 0.95, 7, 3
PER_FRAME = 50
SCENE_WIDTH = 100

# Kinds of events.
EVENT_TYPES = ("view", "click", "signup", "purchase", "error")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- keypoints: 50 vectors make a frame, each giving a float and a bit descriptor ---

KEYPOINTS_SQL = """
kp AS (
  SELECT CAST(vec_id // 50 AS INT) AS f, vec_id % 50 AS k,
         list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 1000)) AS d,
         list_transform(embedding, lambda x: x > 0) AS s,
         CAST((vec_id * 37) % 600 AS DOUBLE) AS x, CAST((vec_id * 53) % 450 AS DOUBLE) AS y
  FROM embeddings),
frames AS (SELECT DISTINCT f AS frame_idx FROM kp)
"""


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    whole = F.transform(
        "embedding", lambda v: F.round(v.cast("double") * 1000).cast("float")
    )

    def word(first):
        part = F.slice("embedding", first + 1, 32)
        bit = F.transform(
            part, lambda v, k: F.when(v > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(2, k).cast("long")
        )
        return F.aggregate(bit, F.expr("0L"), lambda s, v: s + v)

    base = vectors.select(
        F.floor(F.col("vec_id") / PER_FRAME).cast("int").alias("frame_idx"),
        (F.col("vec_id") % PER_FRAME).alias("kp_id"),
        ((F.col("vec_id") * 37) % 600).cast("double").alias("x"),
        ((F.col("vec_id") * 53) % 450).cast("double").alias("y"),
        F.lit(1.0).alias("response"),
        whole.alias("floats"),
        F.array(word(0), word(32)).alias("words"),
    )
    kinds = F.explode(
        F.array(
            F.struct(
                F.lit("blob").alias("detector"),
                F.col("floats").alias("descriptor"),
                F.lit(None).cast("array<long>").alias("bits"),
            ),
            F.struct(
                F.lit("corner").alias("detector"),
                F.lit(None).cast("array<float>").alias("descriptor"),
                F.col("words").alias("bits"),
            ),
        )
    ).alias("kind")
    return base.select("*", kinds).select(
        "frame_idx", "kind.detector", "kp_id", "x", "y", "response", "kind.descriptor", "kind.bits"
    )


def keypoint_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.floor(F.col("vec_id") / PER_FRAME).cast("int").alias("frame_idx")
    return read(spark, sf_dir, "embeddings").select(frame).distinct()


# --- correspondences: the lines of a supplier are the matched points of one pair ---

CORRESPONDENCES_SQL = """
base AS (
  SELECT CAST(l_suppkey AS INT) AS i, CAST(l_suppkey + 1 AS INT) AS j,
         (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey AS m,
         l_partkey % 600 AS sx, (l_orderkey * 7) % 450 AS sy
  FROM lineitem),
corr AS (
  SELECT i, j, m, CAST(sx AS DOUBLE) AS sx, CAST(sy AS DOUBLE) AS sy,
         CAST(CASE WHEN (m * 7 + i) % 10 < 3 THEN (sx * 13 + m % 1000 * 29) % 600
              ELSE sx + i % 7 * 20 - 35 END AS DOUBLE) AS dx,
         CAST(CASE WHEN (m * 7 + i) % 10 < 3 THEN (sy * 11 + m % 1000 * 31) % 450
              ELSE sy + i % 5 * 3 END AS DOUBLE) AS dy
  FROM base)
"""


_HARD_STRAY = "(m * 7 + i) % 20 < 6 + list_extract([0, 6, 9, 11], i % 4 + 1)"
HARD_CORRESPONDENCES_SQL = CORRESPONDENCES_SQL.replace("(m * 7 + i) % 10 < 3", _HARD_STRAY)

_TILTED_STRAY = "(m * 7 + i) % 20 < CASE WHEN i % 8 = 0 THEN 14 ELSE 6 END"

TILTED_SQL = f"""
base AS (
  SELECT CAST(l_suppkey AS INT) AS i, CAST(l_suppkey + 1 AS INT) AS j,
         (l_orderkey * 10 + l_linenumber) * 1000003 + l_partkey AS m,
         l_partkey % 600 AS sx, (l_orderkey * 7) % 450 AS sy, (l_suppkey % 7 - 3) / 40.0::DOUBLE AS k,
         1 + l_suppkey % 3 / 50.0::DOUBLE AS s
  FROM lineitem),
truth AS (
  SELECT i, j, count(*) FILTER (NOT ({_TILTED_STRAY})) AS n_inliers, any_value(s) AS s, any_value(k) AS k
  FROM base GROUP BY i, j),
tilted AS (
  SELECT i, j, n_inliers, s * (1 - k * k) / (1 + k * k) AS h0, -s * 2 * k / (1 + k * k) AS h1,
         CAST(i % 7 * 20 - 35 AS DOUBLE) AS h2, s * 2 * k / (1 + k * k) AS h3,
         s * (1 - k * k) / (1 + k * k) AS h4, CAST(i % 5 * 3 AS DOUBLE) AS h5,
         (i % 5 - 2) / 100000.0::DOUBLE AS h6, (i % 4 - 1) / 100000.0::DOUBLE AS h7
  FROM truth)
"""


def _base(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("int").alias("i"),
        (F.col("l_suppkey") + 1).cast("int").alias("j"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000003 + F.col("l_partkey")).alias("m"),
        (F.col("l_partkey") % 600).alias("sx"),
        (F.col("l_orderkey") * 7 % 450).alias("sy"),
    )


def _stray(hard: bool):
    """Which correspondences are wrong: 3 in 10, or by pair 6, 12, 15 or 17 in 20."""
    i, m = F.col("i"), F.col("m")
    if not hard:
        return (m * 7 + i) % 10 < 3
    more = F.when(i % 4 == 0, 0).when(i % 4 == 1, 6).when(i % 4 == 2, 9).otherwise(11)
    return (m * 7 + i) % 20 < 6 + more


def tilted_correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs under a known rotation, scale and perspective; wrong correspondences miss by 5 pixels at least."""
    i, m, sx, sy = (F.col(c) for c in ("i", "m", "sx", "sy"))
    k, s = (i % 7 - 3) / 40, 1 + i % 3 / 50
    cos, sin = s * (1 - k * k) / (1 + k * k), s * 2 * k / (1 + k * k)
    depth = (i % 5 - 2) / 100000 * sx + (i % 4 - 1) / 100000 * sy + 1
    stray = (m * 7 + i) % 20 < F.when(i % 8 == 0, 14).otherwise(6)
    true, wrong = (cos * sx - sin * sy + (i % 7 * 20 - 35)) / depth, (sx * 13 + m % 1000 * 29) % 600
    dx = F.when(stray, F.when(F.abs(wrong - true) < 5, wrong + 60).otherwise(wrong)).otherwise(true)
    dy = F.when(stray, (sy * 11 + m % 1000 * 31) % 450).otherwise((sin * sx + cos * sy + i % 5 * 3) / depth)
    spots = zip((sx, sy, dx, dy), ("sx", "sy", "dx", "dy"))
    return _base(spark, sf_dir).select("i", "j", "m", *[c.cast("double").alias(n) for c, n in spots])


def line_correspondences(spark: SparkSession, sf_dir: str, hard: bool = False) -> DataFrame:
    i, m, sx, sy = (F.col(c) for c in ("i", "m", "sx", "sy"))
    stray = _stray(hard)
    dx = F.when(stray, (sx * 13 + m % 1000 * 29) % 600).otherwise(sx + i % 7 * 20 - 35)
    dy = F.when(stray, (sy * 11 + m % 1000 * 31) % 450).otherwise(sy + i % 5 * 3)
    spots = zip((sx, sy, dx, dy), ("sx", "sy", "dx", "dy"))
    return _base(spark, sf_dir).select("i", "j", "m", *[c.cast("double").alias(n) for c, n in spots])


# --- links: the events of a user are the links of one strip ---

LINKS_SQL = """
links AS (
  SELECT CAST(user_id AS INT) AS strip_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos,
         CAST(event_id AS INT) AS i, CAST(event_id + 1 AS INT) AS j,
         CAST(event_id % 13 - 6 AS INT) AS dx, CAST(event_id % 7 - 3 AS INT) AS dy,
         event_id % 23 = 0 AS broken
  FROM events)
"""


def event_links(spark: SparkSession, sf_dir: str, breaks: bool = True) -> DataFrame:
    """Shift links with a null transform where broken."""
    event = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("strip_id"),
        "event_id",
        (event % 13 - 6).cast("int").alias("dx"),
        (event % 7 - 3).cast("int").alias("dy"),
    )
    placed = running_sum(rows, ["strip_id"], "event_id", {"nth": F.lit(1)})
    one, zero = F.lit(1.0), F.lit(0.0)
    dx, dy = F.col("dx").cast("double"), F.col("dy").cast("double")
    h = F.array(one, zero, dx, zero, one, dy, zero, zero, one)
    return placed.select(
        "strip_id",
        (F.col("nth") - 1).cast("int").alias("pos"),
        event.cast("int").alias("i"),
        (event + 1).cast("int").alias("j"),
        "dx",
        "dy",
        (F.when(event % 23 != 0, h) if breaks else h).alias("h"),
    )


# --- candidates: two gated models per supplier ---

CANDIDATES_SQL = """
cand AS (
  SELECT CAST(s_suppkey AS INT) AS i, CAST(s_suppkey + 1 AS INT) AS j,
         s_suppkey % 41 AS h_inl, CAST((s_suppkey * 997) % 20000 AS DOUBLE) AS h_spread,
         (s_suppkey * 7) % 43 AS a_inl, CAST((s_suppkey * 613) % 21000 AS DOUBLE) AS a_spread
  FROM supplier)
"""


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("s_suppkey")
    base = read(spark, sf_dir, "supplier")

    def model(n_inliers, spread):
        return base.select(
            key.cast("int").alias("i"),
            (key + 1).cast("int").alias("j"),
            F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]).alias("h"),
            n_inliers.alias("n_inliers"),
            spread.cast("double").alias("spread"),
        )

    return model(key % 41, key * 997 % 20000), model(key * 7 % 43, key * 613 % 21000)


# --- scene: every order is one pixel; frames are overlapping windows of it ---

SCENE_SQL = """
px AS (
  SELECT CAST(o_orderkey % 100 AS INT) AS x, CAST(o_orderkey // 100 AS INT) AS y,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) % 256 AS INT) AS b,
         CAST(sum(o_custkey * 7 + o_orderkey * 13) % 256 AS INT) AS g,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT) // 256) % 256 AS INT) AS r
  FROM orders GROUP BY 1, 2),
size AS (SELECT 100 AS width, max(y) + 1 AS height FROM px),
cell AS (
  SELECT CAST(u.x AS INT) AS x, CAST(v.y AS INT) AS y, coalesce(b, 0) AS b,
         coalesce(g, 0) AS g, coalesce(r, 0) AS r
  FROM (SELECT unnest(range(100)) AS x) u
  CROSS JOIN (SELECT unnest(range((SELECT height FROM size))) AS y) v
  LEFT JOIN px ON px.x = u.x AND px.y = v.y)
"""

FRAMES_SQL = (
    SCENE_SQL
    + """,
fpx AS (
  SELECT f, (x - f * 3 % 20 + 100) % 100 AS x, y - 24 * f AS y, least(255, b + 3 * (f % 9)) AS b,
         least(255, g + 2 * (f % 5)) AS g, r
  FROM (SELECT *, y // 24 - k AS f FROM cell CROSS JOIN (SELECT unnest([0, 1]) AS k))
  WHERE f >= 0 AND y - 24 * f < 40),
fsize AS (SELECT f, 100 AS width, max(y) + 1 AS height FROM fpx GROUP BY f),
pose AS (SELECT f, f * 3 % 20 AS dx, 24 * f AS dy FROM fsize)
"""
)
FRAME_STEP, FRAME_HEIGHT = 24, 40


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form pixels (x, y, b, g, r)."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice")
    channel = {
        "b": F.sum(price) % 256,
        "g": F.sum(F.col("o_custkey") * 7 + key * 13) % 256,
        "r": F.sum(F.floor(price / 256)) % 256,
    }
    return (
        read(spark, sf_dir, "orders")
        .groupBy(
            (key % SCENE_WIDTH).cast("int").alias("x"),
            F.floor(key / SCENE_WIDTH).cast("int").alias("y"),
        )
        .agg(*[v.cast("int").alias(n) for n, v in channel.items()])
    )


def _painted(size_columns, key_columns, schema, ddl, out):
    """Group function: pixels (lx, ly, b, g, r) of one raster onto w x h."""

    def paint(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in [*key_columns, *size_columns]}
        w, h = (first[c] for c in size_columns)
        image = np.zeros((h, w, 3), dtype=np.uint8)
        lx, ly = (table.column(c).to_numpy() for c in ("lx", "ly"))
        for k, c in enumerate("bgr"):
            image[ly, lx, k] = table.column(c).to_numpy()
        return pa.Table.from_pylist([out(first, image)], schema=schema)

    return paint


def scene_mosaic(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """The scene as one mosaic of canvas tiles (a tile is the group, so groups are bounded)."""
    px = scene(spark, sf_dir)
    last = px.agg(F.max("y")).scalar()
    width, height = F.lit(SCENE_WIDTH), F.col("height")
    grid = (
        spark.range(1)
        .select(F.lit(0).alias("strip_id"), (last + 1).alias("height"))
        .select("*", F.explode(F.sequence(F.lit(0), F.floor((height - 1) / size).cast("int"))).alias("ty"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit((SCENE_WIDTH - 1) // size))).alias("tx"))
        .select(
            "strip_id", "tx", "ty", (F.col("tx") * size).alias("x0"), (F.col("ty") * size).alias("y0"),
            width.cast("int").alias("width"), height.cast("int").alias("height"),
        )
        .withColumn("w", F.least(F.lit(size), F.col("width") - F.col("x0")).cast("int"))
        .withColumn("h", F.least(F.lit(size), F.col("height") - F.col("y0")).cast("int"))
    )
    placed = px.select(
        F.floor(F.col("x") / size).cast("int").alias("tx"),
        F.floor(F.col("y") / size).cast("int").alias("ty"),
        (F.col("x") % size).alias("lx"),
        (F.col("y") % size).alias("ly"),
        "b", "g", "r",
    )
    keys = ["strip_id", "tx", "ty", "x0", "y0", "width", "height"]

    def out(first, image):
        seen = np.ones(image.shape[:2], dtype=np.uint8).tobytes()
        return {**first, "bgr": image.tobytes(), "covered": seen}

    schema = pa.schema(
        [(f.split()[0], pa.binary() if f.endswith("binary") else pa.int32()) for f in MOSAIC.split(", ")]
    )
    paint = _painted(["w", "h"], keys, schema, MOSAIC, out)
    return grid.join(placed, ["tx", "ty"]).groupBy("tx", "ty").applyInArrow(paint, MOSAIC)


def scene_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping bands of the scene, each turned round a little further and brighter than the last.

    Every pixel of the scene is in a band; columns that leave one on the left come in again on the right.
    """
    px = scene(spark, sf_dir)
    f, x, y = F.col("f"), F.col("x"), F.col("y")
    shift = f * 3 % 20
    seen = (
        px.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        .withColumn("f", (F.floor(y / FRAME_STEP) - F.col("k")).cast("int"))
        .where((f >= 0) & (y - FRAME_STEP * f < FRAME_HEIGHT))
        .select(
            f.alias("frame_idx"),
            F.pmod(x - shift, F.lit(SCENE_WIDTH)).cast("int").alias("lx"),
            (y - FRAME_STEP * f).cast("int").alias("ly"),
            F.least(F.lit(255), F.col("b") + 3 * (f % 9)).alias("b"),
            F.least(F.lit(255), F.col("g") + 2 * (f % 5)).alias("g"),
            "r",
        )
    )
    sized = seen.groupBy("frame_idx").agg((F.max("ly") + 1).alias("height")).select(
        "frame_idx", F.lit(SCENE_WIDTH).alias("width"), "height"
    )

    def out(first, image):
        return {
            **first, "name": f"window-{first['frame_idx']}", "n_channels": 3, "scale": 1.0,
            "pixels": image.tobytes(),
        }

    schema = pa.schema(
        [("frame_idx", pa.int32()), ("name", pa.string()), ("height", pa.int32())]
        + [("width", pa.int32()), ("n_channels", pa.int32()), ("scale", pa.float64())]
        + [("pixels", pa.binary())]
    )
    paint = _painted(["width", "height"], ["frame_idx"], schema, FRAMES, out)
    return seen.join(sized, "frame_idx").groupBy("frame_idx").applyInArrow(paint, FRAMES)


def scene_poses(spark: SparkSession, sf_dir: str, right: float = 0.0, down: float = 0.0) -> DataFrame:
    """Where each band lies: pure shifts, by ``right`` and ``down`` more if asked."""
    f = F.col("frame_idx")
    y = F.floor(F.floor(F.col("o_orderkey") / SCENE_WIDTH) / FRAME_STEP).cast("int")
    frames = read(spark, sf_dir, "orders").select(y.alias("frame_idx")).distinct()
    one, zero = F.lit(1.0), F.lit(0.0)
    h = F.array(
        one, zero, (f * 3 % 20).cast("double") + right,
        zero, one, (f * FRAME_STEP).cast("double") + down,
        zero, zero, one,
    )
    return frames.select(F.lit(0).alias("strip_id"), f.alias("pos"), "frame_idx", h.alias("h"))


# --- file names ---

# Name endings dealt out to pages.
ENDINGS = (".jpg", ".PNG", ".txt", ".TIFF", ".gif")
NAMES_SQL = """
names AS (
  SELECT page_id, concat('IMG_', page_id, ['.jpg', '.PNG', '.txt', '.TIFF', '.gif'][page_id % 5 + 1]) AS name
  FROM pages)
"""


# --- flight: every order is a block of the ground, frames are flown over it ---

BLOCK_PX, GROUND_BLOCKS = 4, 60
FLIGHT_WIDTH, FLIGHT_HEIGHT, FLIGHT_STEP = 224, 180, 60


def flight_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flight line with two thirds overlap and a little sideways drift over a ground of blocks."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice")
    ground = (
        read(spark, sf_dir, "orders")
        .groupBy(
            (key % GROUND_BLOCKS).cast("int").alias("cx"),
            F.floor(key / GROUND_BLOCKS).cast("int").alias("cy"),
        )
        .agg(
            (F.sum(price) % 256).cast("int").alias("b"),
            (F.sum(price + key) % 256).cast("int").alias("g"),
            (F.sum(F.floor(price / 3)) % 256).cast("int").alias("r"),
        )
    )
    step, rows = FLIGHT_STEP // BLOCK_PX, FLIGHT_HEIGHT // BLOCK_PX
    f, cy = F.col("f"), F.col("cy")
    seen = (
        ground.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows // step))).alias("k"))
        .withColumn("f", (F.floor(cy / step) - F.col("k")).cast("int"))
        .where((f >= 0) & (cy - step * f < rows))
        .select(f.alias("frame_idx"), "cx", (cy - step * f).alias("row"), "b", "g", "r")
    )
    schema = pa.schema(
        [("frame_idx", pa.int32()), ("name", pa.string()), ("height", pa.int32())]
        + [("width", pa.int32()), ("n_channels", pa.int32()), ("scale", pa.float64())]
        + [("pixels", pa.binary())]
    )

    def paint(table: pa.Table) -> pa.Table:
        frame = table.column("frame_idx")[0].as_py()
        x, y = table.column("cx").to_numpy(), table.column("row").to_numpy()
        blocks = np.zeros((y.max() + 1, GROUND_BLOCKS, 3), dtype=np.uint8)
        for k, c in enumerate("bgr"):
            blocks[y, x, k] = table.column(c).to_numpy()
        whole = blocks.repeat(BLOCK_PX, 0).repeat(BLOCK_PX, 1)
        drift = frame * 5 % 17
        image = np.ascontiguousarray(whole[:, drift : drift + FLIGHT_WIDTH])
        row = {
            "frame_idx": frame, "name": f"flight-{frame}", "height": image.shape[0],
            "width": FLIGHT_WIDTH, "n_channels": 3, "scale": 1.0, "pixels": image.tobytes(),
        }
        return pa.Table.from_pylist([row], schema=schema)

    return seen.groupBy("frame_idx").applyInArrow(paint, FRAMES)
