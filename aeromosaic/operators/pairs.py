"""Which frames are compared: adjacent, within a window, or all."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = 4096  # partners listed per row before the last explode of all_pairs


def adjacent_pairs(frames: DataFrame) -> DataFrame:
    """(i, i+1) for every frame with a successor. Empty below two frames."""
    return window_pairs(frames, 1)


def window_pairs(frames: DataFrame, w: int = 3) -> DataFrame:
    """i < j <= i+w. Skip-ahead chaining needs these pairs to exist.

    The candidates are listed per frame and kept where the partner exists: an
    equality join, never a range join.
    """
    ids = frames.select(F.col("frame_idx").alias("i"))
    partners = frames.select(F.col("frame_idx").alias("j"))
    wanted = ids.select(
        "i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.lit(w))).alias("j")
    )
    return wanted.join(partners, "j", "left_semi").select("i", "j")


def all_pairs(frames: DataFrame) -> DataFrame:
    """i < j over all frames, for frame numbers 0..n-1 as number_frames gives them.

    The result itself is quadratic. Rows are listed in runs so that no row
    carries a list of all partners and the runs spread over all tasks.
    """
    spark = frames.sparkSession
    last = frames.agg(F.max("frame_idx")).scalar()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        frames.select(F.col("frame_idx").alias("i"), last.alias("last"))
        .where(F.col("i") < F.col("last"))
        .select(
            "i",
            "last",
            F.explode(F.sequence(F.col("i") + 1, F.col("last"), F.lit(_RUN))).alias("first"),
        )
        .repartition(tasks, "i", "first")
    )
    end = F.least(F.col("first") + F.lit(_RUN - 1), F.col("last"))
    return runs.select("i", F.explode(F.sequence("first", end)).alias("j"))
