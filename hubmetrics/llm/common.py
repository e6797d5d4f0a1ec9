"""Helpers that several of the operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of one Arrow batch that a task holds at a time, so that long rows cannot fill a worker.
BATCH_BYTES = 16 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Byte map that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every ASCII byte that is neither a digit nor a letter turned into a blank.
ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a smaller bound already, and let workers find this package.

    On a cluster whose machines lack this folder, ship the package with ``--py-files``; the entry then does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    now = spark.conf.get(_BATCH_CONF, None)
    if now is None or not str(now).isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and everything beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_LOWER).split(b" ")


def fields(df: DataFrame, columns: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType, True) for c in columns]


def map_rows(
    df: DataFrame, keep: list[str], read: list[str], added: list[T.StructField],
    make: Callable[[], Callable[..., dict[str, list]]],
) -> DataFrame:
    """Add columns that Python computes batch by batch from the columns ``read``; ``keep`` passes through.

    ``make`` runs once in each task and returns a function from the lists of the read columns to lists of new values.
    Nothing is shuffled.
    """
    bound_batches(df.sparkSession)
    schema = T.StructType(fields(df, keep) + added)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            got = work(*[batch.column(batch.schema.get_field_index(f"_r{i}")).to_pylist() for i in range(len(read))])
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            columns += [pa.array(got[f.name], arrow.field(len(keep) + i).type) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    picked = df.select(*[F.col(c) for c in keep], *[F.col(c).alias(f"_r{i}") for i, c in enumerate(read)])
    return picked.mapInArrow(run, schema)


def emit_rows(
    df: DataFrame, read: list[str], out: list[T.StructField], make: Callable[[], Callable[..., Iterator[dict[str, list]]]],
) -> DataFrame:
    """Any number of rows per batch: ``make`` returns a function that yields dictionaries of equally long lists.

    A last call with no argument lets it flush what it has gathered.
    """
    bound_batches(df.sparkSession)
    schema = T.StructType(out)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()

        def as_batches(found):
            for got in found:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            yield from as_batches(work(*[batch.column(i).to_pylist() for i in range(len(read))]))
        yield from as_batches(work())

    return df.select(*read).mapInArrow(run, schema)


def crc_fold(id_column: Column, folds: int) -> Column:
    """The fold of a row: the CRC-32 of its id as text, modulo ``folds``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds
