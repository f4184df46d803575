"""What several operators share: reading, the shared work folder, and materialised tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship, spread

#: A word: a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, over all cores; any path that Spark's readers can open will do."""
    return spread(ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def fold(folds: int) -> Column:
    """The fold of a row: crc32 of its doc_id as text, modulo folds; a null doc_id counts as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def sliced(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to rows of about `most` bytes together, so that what is made of them stays small too."""
    for batch in batches:
        rows = max(1, most * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share."""
    return f"{shared_dir(spark)}/loomspark-{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage, so that lost executors cost a reread and not a recomputation, and
    it lets a table be used several times without computing it several times. The shuffle files of the write go
    with its end, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    _made.append(path)
    writer = df.write.option("compression", codec) if codec else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def written() -> int:
    """How many tables there are now, to clean up later ones only."""
    return len(_made)


def clean_up(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Remove the tables that operators have written so far, or those from first to last, once no result that reads them is needed any more."""
    gone = _made[first:last]
    del _made[first:last]
    while gone:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(gone.pop())
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def file_order(df: DataFrame) -> list[Column]:
    """Columns that tell the order in which df's rows were written, if df reads Parquet files as they are; else none."""
    columns = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        df.select(*columns)
    except AnalysisException:
        return []
    return columns


def columns_of(df: DataFrame) -> Iterator[list[np.ndarray]]:
    """The long columns of a bounded table, in pieces, fetched by the driver a partition at a time as packed bytes."""
    names = df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(packed, names=names)

    for r in df.mapInArrow(pack, ", ".join(f"`{n}` binary" for n in names)).toLocalIterator():
        yield [np.frombuffer(c, np.int64) for c in r]


def least_hashes(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of df, those whose key has the least hashes: a sample that is the same in every run.

    A first cut by the hash alone leaves a little more than is wanted, so that the sort for the last rows gets few
    rows from each task, however many tasks there are.
    """
    n = df.count()
    if n > 2 * most:
        df = df.where(F.xxhash64(key) < int(-(2**63) + 1.3 * most / n * 2**64))
    return df.orderBy(F.xxhash64(key), key).limit(most)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
