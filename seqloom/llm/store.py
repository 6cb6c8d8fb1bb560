"""Shared storage: where intermediate tables go, and stable chunks of a table.

Nothing here keeps state on one machine: an intermediate table is written to
the folder that the cluster names in ``spark.checkpoint.dir``, so losing an
executor loses no data. Only where that setting is absent (tests, a laptop) is
a folder of our own made, and then only in local mode.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one chunk. A chunk is what one sender handles at a time, so it bounds a worker's memory.
CHUNK_ROWS = 1024

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; made here only if the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        sc.setCheckpointDir(_own[sc.applicationId])
    return _own[sc.applicationId]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Write a table to the shared folder; the path."""
    path = fresh(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stored(), with the path, for drop()."""
    schema, path = df.schema, written(df, name)
    return df.sparkSession.read.schema(schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that are no longer needed."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has ended: it does so only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def chunked(df: DataFrame, cols: dict, rows: int = CHUNK_ROWS, numbered: str | None = None) -> DataFrame:
    """``cols`` (name -> Column over df) and ``_sender``, the chunk of each row; ``numbered``: a column that is to be the row's number in its file.

    A chunk is ``rows`` neighbouring rows of one Parquet file, so its name
    depends on the stored table alone: however a second scan splits the file,
    and whichever executor runs it, a row is in the same chunk. A table that
    isn't a Parquet scan is written to the shared folder first.
    """
    number = F.col("_metadata.row_index").cast("long").alias(numbered or "_row")
    named = [c.alias(n) for n, c in cols.items() if n != numbered]
    own = [number] if numbered else []
    sender = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / rows)).alias("_sender")
    try:
        out = df.select(*named, *own, sender)
        out.schema
        return out
    except AnalysisException as e:
        if "_metadata" not in str(e):
            raise
    again = stored(df.select(*named), "rows")
    return again.select(*[n for n in cols if n != numbered], *own, sender)


def numbered(df: DataFrame, name: str, column: str) -> DataFrame:
    """The rows with a number each, written; the upper bits of a number tell the task that wrote it, as picked() expects."""
    return stored(df.select(F.monotonically_increasing_id().alias(column), "*"), name)


def picked(rows: DataFrame, number: str, wanted: DataFrame, without: bool = False) -> DataFrame:
    """The rows of a numbered() table whose number is in ``wanted`` (or isn't): a semi-join (an anti-join) that shuffles only numbers.

    The numbers lie in the shared folder by the task that made them, so a scan
    of the rows reads its own, whatever their number in all.
    """
    spark = rows.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = F.shiftright(number, 33)
    ids = wanted.select(F.col(number).alias("number"), of.alias("sender"), F.pmod(of, F.lit(shards)).cast("int").alias("shard"))
    path = written(ids.repartition(shards, "shard").sortWithinPartitions("sender", "number"), "picked", "shard")

    @F.arrow_udf("boolean")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[int, np.ndarray] = {}
        for x in batches:
            ids = x.to_numpy()
            out = np.zeros(len(ids), bool)
            for s in np.unique(ids >> 33).tolist():
                if s not in known:
                    if len(known) > 4:
                        known.pop(next(iter(known)))
                    got = read_shard(path, s, s % shards)
                    known[s] = np.unique(got["number"].to_numpy()) if got is not None else np.zeros(0, np.int64)
                at = (ids >> 33) == s
                if len(known[s]):
                    k = np.minimum(np.searchsorted(known[s], ids[at]), len(known[s]) - 1)
                    out[at] = known[s][k] == ids[at]
            yield pa.array(out)
        known.clear()
        trim()

    hit = named(number)
    return rows.where(~hit if without else hit)


def trim() -> None:
    """Give memory that is free back to the system: a worker outlives its task and counts for its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def by_sender(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Join neighbouring rows of one chunk; chunks arrive one after another."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index("_sender")).to_numpy(zero_copy_only=False)
        cuts = [0, *((ids[1:] != ids[:-1]).nonzero()[0] + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if now is not None and ids[a] != now:
                yield int(now), pa.Table.from_batches(held)
                held = []
            now = ids[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield int(now), pa.Table.from_batches(held)
    held.clear()
    trim()


def read_shard(path: str, sender: int, shard: int) -> pa.Table | None:
    """A sender's rows of a table that was written by shard; read by an executor."""
    fs, root = pafs.FileSystem.from_uri(path)
    at = f"{root}/shard={shard}"
    info = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    found = [
        pq.read_table(x.path, filesystem=fs, filters=[("sender", "==", sender)], partitioning=None)
        for x in info
        if x.is_file and x.path.endswith(".parquet")
    ]
    return pa.concat_tables(found) if found else None
