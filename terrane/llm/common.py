"""What the operators of this package share: tables, shared storage, columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the row contracts: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset the context's checkpoint directory is used. Where there is
    neither, a temporary folder is made if the master is local (tests, a laptop):
    on a cluster no folder of one machine will do, so that is refused.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if not (found := sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='terrane-')}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Rows of a batch that is sent to a Python worker, where the session leaves Spark's own number.
BATCH = "2048"


def released() -> None:
    """Give back to the system what a worker has freed: it lives on, and its memory counts for its executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH rows; workers give their memory back when a task ends."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, BATCH)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(lean, schema)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage.

    A later failure of an executor re-reads these files and recomputes nothing
    that lies before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete the files of stages that nothing reads any more: all that came of them is staged itself."""
    for df in staged:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], name: str) -> str:
    """name, or a longer one that no column begins with, in any case of letters."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; JVM side."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def next_hashes(hashes: Column, k: int) -> Column:
    """Hashes of the k-windows of an array of longs, by doubling (log k passes).

    An array of fewer than k longs gives an empty one.
    """
    out, width = hashes, 1
    steps = []
    while width < k:
        step = min(width, k - width)
        steps.append(step)
        width += step

    def join(step: int):
        def of(h: Column) -> Column:
            left = F.greatest(F.size(h) - step, F.lit(0))
            return F.zip_with(F.slice(h, 1, left), F.slice(h, step + 1, left), lambda a, b: F.xxhash64(a, b))

        return of

    for step in steps:
        out = let(out, join(step))
    return out
