"""Shared pieces: reading tables, durable intermediates, bounded Arrow batches and skew-proof numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows and bytes of an Arrow batch handed to Python: bounds a worker's memory also when texts are very long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._durable_path = path
    return back


def drop_durable(df: DataFrame) -> None:
    """Deletes what durable() wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._durable_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def grouped_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that are equal in their first ``width`` columns, streamed; the rows come without these."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, run in groupby(rows, key=lambda r: r[:width]):
        yield key, (r[width:] for r in run)


def map_columns(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """mapInArrow for functions of whole columns: make() is called once per task; its result gets the columns as Python
    lists and returns a list of output columns (Arrow arrays or lists)."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                columns = f(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, out, strict=True)], schema=out)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: A key with more than one HOT-th of all rows is hot: there are fewer than HOT of them.
HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right (a table with one row a key; ``weight``: at least left's rows of the key, of ``total``). No task
    gets all rows of a hot key: those keys, fewer than HOT, reach the driver, and right's rows of them are broadcast. left
    is read twice if there are any."""
    is_hot = F.col(weight) * HOT > total
    keys = [F.lit(r[0] if not isinstance(r[0], bytearray) else bytes(r[0])) for r in right.where(is_hot).select(on).collect()]
    if not keys:
        return left.join(right.drop(weight), on, how)
    among = F.coalesce(F.col(on).isin(keys), F.lit(False))
    hot = left.where(among).join(F.broadcast(right.where(is_hot).drop(weight)), on, how)
    return hot.unionByName(left.where(~among).join(right.where(~is_hot).drop(weight), on, how))


#: Slots of hashed keys, 64 of which are one broadcast row: 2^20 rows at most, however many keys there are.
SLOTS = 1 << 26


def in_slots(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose integer ``on`` may be among that of keys (null like any other), then all others. Neither is moved:
    the slots that keys take are broadcast as bits, so what shares a slot with a key counts as one, too."""
    slot = f"pmod(xxhash64(cast(`{on}` AS long)), {SLOTS}L)"
    word, bit = F.expr(f"{slot} div 64"), f"cast({slot} % 64 AS int)"
    taken = keys.select(word.alias("_word"), F.expr(f"shiftleft(1L, {bit})").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_taken"))
    held = df.withColumn("_word", word).join(F.broadcast(taken), "_word", "left")
    maybe = F.coalesce(F.expr(f"bit_get(_taken, {bit})"), F.lit(0).cast("tinyint")) == 1
    return held.where(maybe).select(*df.columns), held.where(~maybe).select(*df.columns)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Adds ``out``: a number from 0, gapless in each group, by hashed bucket and then by ``order``.

    A group of any size is spread over as many buckets as there are shuffle partitions: buckets are counted (partial
    sums before the shuffle), the counts are summed up per group, and rows are numbered within their bucket. With
    ``weight`` a row takes that many numbers and gets the first. Rows equal in ``order`` are interchangeable. Group
    columns are never null, so that the counts join by plain equality, without moving the rows again.
    """
    held = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(shuffle_width(df.sparkSession))))
    n = F.col(weight) if weight else F.lit(1).cast("long")
    sums = held.groupBy(*group, "_b").agg(F.sum(n).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*group, "_b").orderBy(*order)
    rank = F.coalesce(F.sum(n).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(inner).cast("long") - 1
    rows = held.withColumn("_r", rank)
    return rows.join(sums, [*group, "_b"]).withColumn(out, F.col("_r") + F.col("_base")).select(*df.columns, out)


def repeated(df: DataFrame, weight: str, out: str, step: int = 4096) -> DataFrame:
    """Each row ``weight`` times with ``out`` = 0, 1, ...; in two stages, so that no array holds more than a slice."""
    chunks = df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{weight}` - 1) div {step}"))))
    last = F.least((F.col("_c") + 1) * step, F.col(weight)) - 1
    return chunks.withColumn(out, F.explode(F.sequence(F.col("_c") * step, last))).drop("_c", weight)
