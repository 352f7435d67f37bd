"""What a step could not work on: rows carried beside its results and split off after one write.

A step that may fail on an item gives, in the same pass, its good rows with ``failed`` null and one
row per failure with ``failed`` set and all else null.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeromosaic.functions.ordering import settle

FAILURES = "step string, item string, error string"
FAILED = "failed struct<step:string,item:string,error:string>"
FAILED_FIELD = pa.field("failed", pa.struct([(c, pa.string()) for c in ("step", "item", "error")]))


def failure(step: str, item, problem: Exception) -> dict:
    return {"step": step, "item": str(item), "error": f"{type(problem).__name__}: {problem}"}


def tried(step: str, item, fn, schema: pa.Schema):
    """mapInArrow function from ``fn(row dict) -> iterable of row dicts``; where that raises, one
    row of failure named by ``item(row)`` takes the place of all rows of its item."""
    schema = schema.append(FAILED_FIELD)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                try:
                    rows = list(fn(row))
                except Exception as problem:
                    rows = [{"failed": failure(step, item(row), problem)}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def succeeded(rows: DataFrame) -> DataFrame:
    return rows.where("failed is null").drop("failed")


def failures_in(rows: DataFrame) -> DataFrame:
    return rows.where("failed is not null").select(*[F.col(f"failed.{f.split()[0]}") for f in FAILURES.split(", ")])


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, failures) of a step, which runs once."""
    table = settle(rows)
    return succeeded(table), failures_in(table)
