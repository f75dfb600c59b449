"""The folder that the driver and all executors share, and how Python code on either side opens files there.

Every intermediate table or file goes below ``spark.checkpoint.dir``. Where a
local session has none (a laptop), ``LOCAL_DEFAULT`` is used; on a cluster that is an error, as
each machine would write to a disk of its own. Files that tasks
write themselves have a name of their own per attempt, and only the names in the
rows of committed tasks are ever read: a lost or repeated attempt leaves at most
an unused file behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_DEFAULT
    return (root if "://" in root or root.startswith("file:") else f"file://{root}").rstrip("/")


#: The folders named by :func:`work_dir` that :func:`release` has not removed.
_named: list[str] = []


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name for one run of an operator."""
    _named.append(f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _named[-1]


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the folders named since ``len(_named)`` was ``since``: for callers that have stored what they want of the results."""
    for path in _named[since:]:
        discard(spark, path)
    del _named[since:]


def named() -> int:
    """A place in the list of named folders, for :func:`release`."""
    return len(_named)


def fresh(taken, *stems: str) -> list[str]:
    """Names for columns that no column in ``taken`` has, in any case of letters."""
    taken, out = {c.lower() for c in taken}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: a cut in the lineage that outlives executors."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`work_dir` named."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def opened(uri: str):
    """(file system, path) for a URI; runs on executors."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def give_back() -> None:
    """Return what memory this Python worker holds free; runs on executors, whose workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def attempt_file(folder: str, suffix: str) -> str:
    """A file name that no other attempt uses, with its folder made; runs on executors."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, by: Column, within: list[str], order: list[Column], bins: int, name: str) -> DataFrame:
    """Number the rows of each ``within`` group from 0 without gaps, as column ``name``, with no task that holds a whole group.

    ``by`` is a hash whose ``bins`` residues split the groups. The rows of one
    residue are numbered by a window; a table of counts (groups x bins rows)
    gives what stands before each. Rows of a residue are ordered by ``order``.
    """
    from pyspark.sql import Window as W

    numbered = df.withColumn("_bin", F.pmod(by, F.lit(bins)))
    counts = numbered.groupBy(*within, "_bin").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*within).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*within, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = W.partitionBy(*within, "_bin").orderBy(*order)
    return (
        numbered.withColumn("_row", F.row_number().over(local) - 1)
        .join(starts, [*within, "_bin"])
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_bin", "_row", "_start")
    )


def rows_in(batches, *names: str):
    """The rows of Arrow batches as tuples of Python values; runs on executors."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batch_of(rows: list[tuple], **kinds: str):
    """An Arrow batch of rows; kinds: a column's name and Arrow type, in order."""
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.type_for_alias(k)) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def batches_of(rows, size: int = 4096, **kinds: str):
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(held, **kinds)
            held = []
    if held:
        yield batch_of(held, **kinds)
