"""Descriptor matching: nearest two, ratio test, mutual check, scores, best detector."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeromosaic.functions.distance import nearest_both_ways
from aeromosaic.functions.ordering import spread
from aeromosaic.schemas import NEAREST

BLOCK = 2048
DETECTORS = ("blob", "corner")
_PAIR = ["i", "j", "detector"]
_SOURCE = [*_PAIR, "dir", "src_kp"]


def _dim(column: str):
    return F.coalesce(F.size(column), F.lit(0))


def comparable(pairs: DataFrame, kps: DataFrame) -> DataFrame:
    """Pairs and detectors that can be matched: both sides non-empty, equal descriptor length."""
    sides = kps.groupBy("frame_idx", "detector").agg(
        F.count("*").alias("n"),
        F.max(_dim("descriptor")).alias("dim"),
        F.max(_dim("bits")).alias("words"),
    )
    left = sides.withColumnsRenamed({"frame_idx": "i", "n": "n_i"})
    right = sides.withColumnsRenamed({"frame_idx": "j", "n": "n_j"})
    return (
        pairs.join(left, "i")
        .join(right, ["j", "detector", "dim", "words"])
        .select("i", "j", "detector", "dim", "words", "n_i", "n_j")
    )


def keypoint_blocks(kps: DataFrame, size: int = BLOCK) -> DataFrame:
    """Keypoints of a frame and detector packed into rows of at most ``size``.

    kp_id numbers the keypoints of a frame and detector, so the block needs no
    count and a frame with very many keypoints becomes many rows.
    """
    block = F.floor(F.col("kp_id") / size).alias("block")
    item = F.struct("kp_id", "descriptor", "bits")
    return (
        kps.groupBy("frame_idx", "detector", block)
        .agg(F.collect_list(item).alias("items"))
        .select(
            "frame_idx",
            "detector",
            "block",
            F.col("items.kp_id").alias("ids"),
            F.col("items.descriptor").alias("descriptor"),
            F.col("items.bits").alias("bits"),
        )
    )


def _matrix(column: pa.Array, row: int, dtype):
    cell = column[row].values
    if cell is None or len(cell) == 0 or cell.null_count:
        return None
    flat = cell.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(cell), -1).astype(dtype, copy=False)


def _nearest_in_blocks(batches):
    columns = ["i", "j", "detector", "dir", "src_kp", "dst_kp", "distance", "error"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    types += [pa.float64(), pa.string()]

    def table(i, j, detector, way, src, dst, distance, error=None):
        values = [i, j, detector, way, src, dst, distance, error]
        whole = [
            pa.array(v, type=t) if c in columns[4:7] else pa.repeat(pa.scalar(v, t), len(src))
            for v, t, c in zip(values, types, columns, strict=True)
        ]
        return pa.RecordBatch.from_arrays(whole, columns)

    for batch in batches:
        cols = {name: batch.column(name) for name in batch.schema.names}
        for row in range(batch.num_rows):
            key = [cols[c][row].as_py() for c in _PAIR]
            try:
                q_ids, t_ids = (cols[c][row].values.to_numpy() for c in ("q_ids", "t_ids"))
                q, t = (_matrix(cols[c], row, np.float32) for c in ("q_desc", "t_desc"))
                binary = q is None
                if binary:
                    q, t = (_matrix(cols[c], row, np.int64) for c in ("q_bits", "t_bits"))
                for found in nearest_both_ways(q_ids, q, t_ids, t, binary):
                    yield table(*key, *found)
            except Exception as problem:  # one bad pair must not end the job
                yield table(*key, -1, [None], [None], [None], str(problem))


def block_nearest(pairs: DataFrame, kps: DataFrame, size: int = BLOCK) -> DataFrame:
    """The two nearest keypoints per block pair, both directions from one distance table.

    Block numbers are joined before the descriptors, so every join key is one
    block and not one frame: the work of a crowded frame spreads evenly. Only
    two candidates per keypoint leave a block pair, never all its distances.
    """
    wanted = comparable(pairs, kps).select(*_PAIR)
    numbers = kps.select(
        "frame_idx", "detector", F.floor(F.col("kp_id") / size).alias("block")
    ).distinct()
    blocks = keypoint_blocks(kps, size)

    def side(table, frame, block):
        return table.withColumnsRenamed({"frame_idx": frame, "block": block})

    def packed(frame, block, prefix):
        names = {"ids": f"{prefix}_ids", "descriptor": f"{prefix}_desc", "bits": f"{prefix}_bits"}
        return side(blocks, frame, block).withColumnsRenamed(names)

    queries = (
        wanted.join(side(numbers, "i", "q_block"), ["i", "detector"])
        .join(side(numbers, "j", "t_block"), ["j", "detector"])
        .join(packed("i", "q_block", "q"), ["i", "detector", "q_block"])
    )
    target = ["j", "detector", "t_block"]
    tasks = spread(queries, *target).join(packed("j", "t_block", "t"), target)
    cells = [*_PAIR, "q_ids", "q_desc", "q_bits", "t_ids", "t_desc", "t_bits"]
    return tasks.select(*cells).mapInArrow(_nearest_in_blocks, NEAREST)


def knn2(nearest: DataFrame) -> DataFrame:
    """Two nearest per keypoint over all blocks, numbered 1 and 2; ties go to the lower id."""
    near = Window.partitionBy(*_SOURCE).orderBy("distance", "dst_kp")
    return (
        nearest.where(F.col("error").isNull())
        .withColumn("rank", F.row_number().over(near))
        .where(F.col("rank") <= 2)
        .select(*_SOURCE, "dst_kp", "distance", "rank")
    )


def ratio_test(knn: DataFrame, r: float = 0.8) -> DataFrame:
    """Nearest neighbours strictly closer than r times the second. One neighbour is not enough."""
    near = Window.partitionBy(*_SOURCE).orderBy("distance", "dst_kp")
    return (
        knn.withColumn("second", F.lead("distance").over(near))
        .where((F.col("rank") == 1) & (F.col("distance") < F.lit(r) * F.col("second")))
        .select(*_SOURCE, "dst_kp", "distance")
    )


def mutual(passing: DataFrame) -> DataFrame:
    """Matches that pass in both directions.

    One grouping by (query, target) sees both directions; a join would shuffle twice.
    """
    forward = F.col("dir") == 0
    return (
        passing.select(
            *_PAIR,
            F.when(forward, F.col("src_kp")).otherwise(F.col("dst_kp")).alias("q_kp"),
            F.when(forward, F.col("dst_kp")).otherwise(F.col("src_kp")).alias("t_kp"),
            "dir",
            "distance",
        )
        .groupBy(*_PAIR, "q_kp", "t_kp")
        .agg(F.count("*").alias("ways"), F.max("distance").alias("distance"))
        .where("ways = 2")
        .drop("ways")
    )


def pair_scores(matches: DataFrame) -> DataFrame:
    """Count, mean distance and count / (1 + mean) per pair and detector."""
    return (
        matches.groupBy(*_PAIR)
        .agg(F.count("*").alias("n_matches"), F.avg("distance").alias("mean_distance"))
        .withColumn("score", F.col("n_matches") / (1 + F.col("mean_distance")))
    )


def best_detector(
    pairs: DataFrame, scores: DataFrame, nearest: DataFrame = None, order=DETECTORS
) -> DataFrame:
    """The best detector of every pair; equal scores go to the first in ``order``.

    A pair without matches keeps a null detector and score 0. A pair without
    matches whose comparison failed (rows of ``nearest`` with an error) says so.
    """
    place = F.array_position(F.array(*[F.lit(d) for d in order]), F.col("detector"))
    place = F.when(place > 0, place).otherwise(F.lit(len(order) + 1))
    chosen = F.max_by(
        F.struct("detector", "n_matches", "score"), F.struct(F.col("score"), -place)
    ).alias("best")
    best = scores.where("score > 0").groupBy("i", "j").agg(chosen)
    result = pairs.join(best, ["i", "j"], "left")
    status = F.lit("ok")
    if nearest is not None:
        failed = nearest.where(F.col("error").isNotNull()).groupBy("i", "j")
        result = result.join(failed.agg(F.min("error").alias("error")), ["i", "j"], "left")
        failure = F.concat(F.lit("error: "), F.col("error"))
        status = F.when(
            F.col("best").isNull() & F.col("error").isNotNull(), failure
        ).otherwise(status)
    return result.select(
        "i",
        "j",
        F.col("best.detector").alias("detector"),
        F.coalesce(F.col("best.n_matches"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.col("best.score"), F.lit(0.0)).alias("score"),
        status.alias("status"),
    )


def best_matches(matches: DataFrame, best: DataFrame) -> DataFrame:
    """Matches of the chosen detector of each pair."""
    return matches.join(best.select(*_PAIR), _PAIR, "left_semi")


def match_report(best: DataFrame, min_matches: int = 10, names: DataFrame = None) -> DataFrame:
    """One VALID/INSUFFICIENT row per pair and one TOTAL row, from one grouping.

    ``names`` (frame_idx, name) adds name_i and name_j.
    """
    valid = F.col("n_matches") >= min_matches
    verdict = (
        F.when(F.grouping_id() > 0, F.lit("TOTAL"))
        .when(F.sum(valid.cast("int")) > 0, F.lit("VALID"))
        .otherwise(F.lit("INSUFFICIENT"))
    )
    report = (
        best.groupingSets([["i", "j"], []], "i", "j")
        .agg(
            verdict.alias("verdict"),
            F.coalesce(F.sum("n_matches"), F.lit(0)).alias("n_matches"),
            F.coalesce(F.sum(valid.cast("int")), F.lit(0)).alias("valid_pairs"),
            F.count("*").alias("n_pairs"),
        )
        .select("i", "j", "verdict", "n_matches", "valid_pairs", "n_pairs")
    )
    if names is None:
        return report
    for side in "ij":
        named = names.select(F.col("frame_idx").alias(side), F.col("name").alias(f"name_{side}"))
        report = report.join(named, side, "left")
    return report
