"""Ranks, running sums, joins and lineage cuts that do not need one task to see everything."""

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one key that a single window task may hold in running_sum.
BUCKET = 4096
# Bytes of a table that attach sends to every task, and the salts it deals a larger one to.
ATTACHED, SALTS = 32 << 20, 64
# Setting by which a query's shuffle files go when it ends, and not when the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, or one of its own in the warehouse."""
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/aeromosaic-{context.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_shared(spark: SparkSession) -> None:
    """Delete what settle has written in the warehouse; a configured folder is left to its owner."""
    folder = shared_dir(spark)
    if f"aeromosaic-{spark.sparkContext.applicationId}" in folder:
        _delete(spark, folder)


@contextmanager
def passing(spark: SparkSession):
    """Tables that settle writes inside are deleted at the end, except lasting ones.

    For a step whose result is written as a lasting table: nothing lazy that reads the others may leave
    the block. Shuffle files inside go as soon as the table they were made for is written.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    before = spark.conf.get(_CLEAN, "false")
    try:
        spark.conf.set(_CLEAN, "true")
        yield
    finally:
        spark.conf.set(_CLEAN, before)
        for path in scopes.pop():
            _delete(spark, path)


def new_table(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def settle(df: DataFrame, lasting: bool = False, path: str = None) -> DataFrame:
    """Write the rows to the shared folder (or to ``path``) and read them back: lineage ends here.

    A written table rather than ``checkpoint()``, since its size is then known
    to the optimizer and columns can still be pruned. ``lasting`` tables outlive ``passing``.
    """
    spark = df.sparkSession
    path = path or new_table(spark)
    scopes = getattr(_open, "scopes", None)
    if scopes and not lasting:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_marked(df: DataFrame, *marks: Column, **where) -> tuple[DataFrame, tuple]:
    """settle, with aggregates of the rows observed on the way (for loops that test for an end)."""
    seen = Observation()
    table = settle(df.observe(seen, *[m.alias(f"m{k}") for k, m in enumerate(marks)]), **where)
    return table, tuple(seen.get[f"m{k}"] for k in range(len(marks)))


class Runs:
    """A lasting table written run by run, each in a folder of its own, so that few runs are read without the rest."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, new_table(spark), None

    def at(self, run) -> str:
        return f"{self.path}/run-{run}"

    def add(self, df: DataFrame, run, write=settle) -> None:
        self.schema = write(df, lasting=True, path=self.at(run)).schema

    def read(self, runs) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self.at(run) for run in runs])

    def drop(self) -> None:
        _delete(self.spark, self.path)

    def whole(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows to the session's number of shuffle partitions, all of which are kept.

    For steps that take long per byte: adaptive execution would merge their small
    partitions into few tasks. A join or grouping on the same keys reuses it.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys)


def attach(rows: DataFrame, small: DataFrame, key: str | list[str], row_bytes: int = 64) -> DataFrame:
    """Inner join with a table that has one row for each key, where one key may own all rows.

    The small table is written, counted and sent to every task if it has at most ATTACHED bytes.
    Beyond that it is repeated for SALTS salts and the rows are dealt by key and salt, so that a
    key's rows spread either way.
    """
    keys = [key] if isinstance(key, str) else key
    small = settle(small)
    if small.count() * row_bytes <= ATTACHED:
        return rows.join(F.broadcast(small), keys)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return dealt.join(salted, [*keys, "_salt"]).drop("_salt")


def with_least(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The rows with the smallest ``value`` of their key, where one key may own most rows.

    Minima are taken by key and salt first, and go back to the rows by key and salt.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(F.min(value).alias("_least"))
    least = parts.groupBy(*keys).agg(F.min("_least").alias(out))
    known = parts.drop("_least").join(least, keys)
    return salted.join(known, [*keys, "_salt"]).drop("_salt")


def number_rows(df: DataFrame, order: list, out: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order with a distributed sort.

    The sorted rows are settled first so that partition numbers stay fixed;
    only one count per partition is summed in one place.
    """
    step = 1 << 33  # monotonically_increasing_id keeps the partition above bit 33
    rows = settle(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.floor(F.col("_id") / step))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    number = F.col("_offset") + F.col("_id") % step
    return (
        rows.join(offsets, "_part")
        .withColumn(out, number.cast("int"))
        .drop("_id", "_part", "_offset")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums along an integer order column, in two levels.

    Rows of a key are cut into buckets of ``BUCKET`` order values. Bucket totals
    are summed first (one row per bucket), then rows inside their bucket, so a
    key that owns most of the table is still spread over many tasks.
    """
    bucket = F.floor(F.col(order) / BUCKET)
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(
        *[F.sum(v).alias(f"_t_{name}") for name, v in values.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.join(totals, [*keys, "_bucket"])
    for name, value in values.items():
        summed = summed.withColumn(name, F.sum(value).over(inside) + F.col(f"_o_{name}"))
    return summed.drop("_bucket", *[f"_o_{n}" for n in values])


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str) -> DataFrame:
    """The first n rows of each key, numbered from 1.

    Spark limits each key before the shuffle only up to a threshold of n. Above
    it the keys are salted and limited once per salt first, so that a key with
    most of the rows never sorts in one task: the last step sees at most n rows
    per salt of it.
    """
    conf = df.sparkSession.conf
    threshold = int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    rows = df
    if n > threshold:
        salts = int(conf.get("spark.sql.shuffle.partitions"))
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = (
            rows.withColumn("_salt", F.spark_partition_id() % salts)
            .withColumn(rank, F.row_number().over(salted))
            .where(F.col(rank) <= n)
            .drop("_salt", rank)
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
