"""What the corpus operators share: reading, materialising, size-checked broadcasts and gapless ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a key table (a few longs each) up to which it is broadcast; beyond, the same join is shuffled.
BROADCAST_ROWS = 500_000

#: Bytes of a row group of an intermediate table.
ROW_GROUP_BYTES = 32_000_000

#: ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 500, size: int = 16_000_000) -> None:
    """Keep the batches that Python workers get small in rows and bytes, since one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"pulseloom-{os.getuid()}")
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read to the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors and go when they are discarded or the session's JVM ends. Row groups are small, as
    each task's writer holds one in memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pulseloom/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Exception):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.pulseloom_path = path
    if _scratches:
        _scratches[-1].append(out)
    return out


_scratches: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Discard on leaving all tables materialised within, but those handed to the function given."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratches.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scratches.pop()
        paths = {df.pulseloom_path for df in kept}
        for df in made:
            if df.pulseloom_path not in paths:
                discard(df)
            elif _scratches:
                _scratches[-1].append(df)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised result that no later step reads."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.pulseloom_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files of finished steps, which it does once the driver, its Python objects first,
    has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Hand memory that a Python worker has freed back to the system; workers live on for later tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check of the counted rows; beyond the limit the plan shuffles."""
    return F.broadcast(df) if rows <= limit else df


def chance(*key: Column | str) -> Column:
    """A number from 0 to 1 that a hash of the key decides, for samples that every run and partitioning draws alike."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)


def row_key(text: Column) -> Column:
    """128 bits of a text, to tell apart rows of one doc_id, or of none."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def merge_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text, row_key, copies) with rows alike in doc_id and text as one, and (doc_id, row_key, copies) of the
    repeated ones, None where there are none.

    Text is binary and never null. Only keys are counted, so a table without repeated rows is not shuffled; however many
    copies a row has, they are merged before the shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), row_key(F.col("text")).alias("row_key"))
    counts = rows.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    counts = materialize(counts, "copies")
    n = counts.count()
    if not n:
        return rows.withColumn("copies", F.lit(1).cast("long")), None
    once = rows.groupBy("doc_id", "row_key").agg(F.min("text").alias("text"))
    found = small(counts.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "copies"), n)
    once = once.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left")
    return once.select("doc_id", "text", "row_key", F.coalesce("copies", F.lit(1)).cast("long").alias("copies")), counts


#: Copies of a row that one task writes.
_SPREAD = 100_000


def spread_copies(rows: DataFrame, counts: DataFrame | None) -> DataFrame:
    """`rows` (doc_id, row_key, more) with as many copies of each as `merge_copies` merged."""
    if counts is None:
        return rows
    names = rows.columns
    found = small(counts.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("copies").alias("_copies")), counts.count())
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")), "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / _SPREAD))))
    here = F.least(F.lit(_SPREAD), F.col("_copies") - F.col("_part") * _SPREAD)
    many = rows.withColumn("_here", here)
    return many.withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_here").cast("int")))).select(*names)


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


#: Rows of a cell of `rank_in_groups`.
CELL_ROWS = 20_000


def placed(rows: DataFrame) -> DataFrame:
    """A materialised table with `_place`, a hash of where each row stands in its files, which every reading of them gives."""
    return rows.withColumn("_place", F.xxhash64(F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1), F.col("_metadata.row_index")))


def rank_in_groups(rows: DataFrame, key: str, order: list[str], name: str, counts: dict[int, int]) -> DataFrame:
    """Add `name` to a `placed` table: a gapless rank from 0 within each group of `key`, whatever share of the rows one holds.

    A group, of which `counts` tells the rows, is cut into cells of some `CELL_ROWS` by the rows' places; rows are numbered
    within a cell and cells are laid end to end, so no task sorts a whole group, be all its rows alike. Which row of a group
    has which rank depends on the files alone.
    """
    spark = rows.sparkSession
    cells = F.broadcast(spark.createDataFrame([(k, -(-n // CELL_ROWS)) for k, n in sorted(counts.items())], "_group long, _cells long"))  # a row a group
    rows = rows.join(cells, F.col(key) == F.col("_group")).withColumn("_cell", F.pmod("_place", "_cells")).drop("_group", "_cells")
    sizes = rows.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(key).alias("_group"), F.col("_cell").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_cell").orderBy(*order, "_place")))
    joined = numbered.join(sizes, (F.col(key) == F.col("_group")) & (F.col("_cell") == F.col("_at")))
    return joined.withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_cell", "_rn", "_before", "_group", "_at", "_place")
