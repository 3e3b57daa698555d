"""What the training-data operators share: lineage cuts, sizes and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import remove, shared_root

__all__ = ["DOCUMENT_COLUMNS", "SEGMENT_BYTES", "bounded", "collect_garbage", "cut", "parts_for", "release", "row_key", "segments", "spread_join", "text_hashes", "trim"]

#: Columns of a documents table, in the order pipeline stages return them.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text that one step inside a Python worker looks at together.
SEGMENT_BYTES = 4 << 20


#: Rows (of a few numbers) that are broadcast at most; parts that a hot key is dealt to otherwise.
MOST_BROADCAST, SALTS = 200_000, 32
#: Share of the driver's heap that may be taken up when a table has been written.
HEAP_SHARE = 0.4
#: The folder of intermediate tables of each application.
FOLDERS: dict[str, str] = {}


def folder_of(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the process ends."""
    name = spark.sparkContext.applicationId
    if name not in FOLDERS:
        FOLDERS[name] = f"{shared_root(spark)}/tables-{name}-{uuid.uuid4().hex}"
        atexit.register(forget, spark, FOLDERS[name])
    return FOLDERS[name]


def forget(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows as a written table: lost executors cost no recomputation, and plans start from its true size.

    (What a checkpoint says of its size is the product of all joins before it, which no
    iteration can bear.)
    """
    path = f"{folder_of(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    collect_garbage(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Give what the driver took up for queries that are done back to the system: of its heap once it is much, outside it always.

    An iteration leaves plans, broadcasts and shuffles behind. Spark drops the latter two
    only when the driver's garbage is collected, which by itself happens when the heap is
    as large as it may be.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Have the driver's JVM give back what it freed outside its heap; one that can't keeps it.

    Compilers, class loaders and hundreds of threads allocate there for each query, in as many
    pools as the C library likes; what they free stays in these pools.
    """
    jvm = spark._jvm
    # The bean server's own class is closed to callers, its interface isn't.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JJavaError:
        return


def bounded(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def spread_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join in which a third of ``many`` may have one key: by broadcast, or with each key dealt to ``SALTS`` parts."""
    few = cut(few)
    if few.count() <= MOST_BROADCAST:
        return many.join(F.broadcast(few), key, how)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")
    return many.withColumn("__salt", part).join(salted, [key, "__salt"], how).drop("__salt")


def parts_for(rows: int, per_part: int) -> int:
    """How many parts of about ``per_part`` rows hold ``rows`` rows."""
    return max(1, math.ceil(rows / per_part))


def release() -> None:
    """Give memory that nothing uses back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def segments(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SEGMENT_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold about ``limit`` bytes of text each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        mean = max(1, batch.column(text).nbytes // n)
        step = max(1, limit // mean)
        for at in range(0, n, step):
            yield batch.slice(at, step)


def text_hashes(*columns: str) -> list[Column]:
    """``h1, h2``: 128 bits that stand for values, so that no two of a corpus' values meet by chance."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *columns).alias("h2")]


def row_key(*expressions: str) -> str:
    """SQL of 16 bytes that identify a row by the values of expressions; equal rows have equal keys."""
    listed = ", ".join(expressions)
    return f"unhex(concat(lpad(hex(xxhash64({listed})), 16, '0'), lpad(hex(xxhash64('second', {listed})), 16, '0')))"
