"""Helpers shared by the operators on texts: tables, words, and Arrow maps over one column."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]

#: A-Z to a-z, every other ASCII byte that is no digit or letter to a space; UTF-8 bytes stay.
TO_WORDS = bytes(
    0x20 if b in set(_SEPARATORS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in the struct __row, where no name meets one of ours."""
    others = [named(c) for c in docs.columns if c not in needed]
    return docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("__row"), *map(named, needed))


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``wrapped`` documents as they were."""
    return rows.select(
        *[(named(c) if c in rows.columns and c != "__row" else F.col("__row").getField(c)).alias(c) for c in columns]
    )


def letter_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(TO_WORDS).split()


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()


def field_list(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_texts(docs: DataFrame, keep: list[str], ddl: str, start, text: str = "text") -> DataFrame:
    """Columns ``keep`` beside new columns computed from the text column, batch by batch.

    ``start()`` runs once per task and returns a function from an Arrow string array
    to a list of Arrow arrays, one per column of ``ddl``. Only the columns named reach
    Python, so further columns of any name do no harm.
    """
    added = field_list(ddl)
    wanted = keep if text in keep else [*keep, text]
    schema = StructType([docs.schema[c] for c in keep] + added.fields)
    names, n, at = schema.names, len(keep), wanted.index(text)

    def run(batches):
        work = start()
        for batch in batches:
            made = work(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names)

    return docs.select(*[named(c) for c in wanted]).mapInArrow(run, schema)


def sha256_join(parts: list[str]) -> str:
    import hashlib

    return hashlib.sha256(",".join(parts).encode()).hexdigest()
