"""Shared helpers: scratch tables in the cluster's shared folder, text access,
order-preserving keys and bounded key filters."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import ship_package

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a new temporary folder, which is then set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="cadenza-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read and not the work
    above, and whatever was assigned to rows (row marks, shards) stays fixed.
    The folder is removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza-llm/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])).parquet(path)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with every nested field nullable."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def keep_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like :func:`keep`, in as many buckets of ``key`` as the session has shuffle partitions: joins and
    groupings on ``key`` find the rows in place."""
    spark = df.sparkSession
    full = f"cadenza_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/cadenza-llm/{full}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(full)
    _MADE.append((spark, path))
    return spark.table(full)


def clear() -> None:
    """Remove the scratch tables written by :func:`keep`."""
    while _MADE:
        spark, path = _MADE.pop()
        jsc = getattr(spark.sparkContext, "_jsc", None)
        if jsc is None:
            continue
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear()
    except Exception:  # noqa: BLE001  the session may be gone already at interpreter exit
        _MADE.clear()


#: Rows and bytes of an Arrow batch between Spark and a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def arrow_ready(spark: SparkSession) -> None:
    """Ship the package to Python workers and keep Arrow batches small: a batch lies in
    memory several times (JVM, socket, worker), and texts may be long."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def sortable(c: Column) -> Column:
    """16 hex digits whose string order is the order of the (signed) long; null first."""
    flipped = F.coalesce(c, F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))
    return F.lpad(F.hex(flipped), 16, "0")


def shield(docs: DataFrame, *own: str) -> DataFrame:
    """Only the columns an operator works on; all others wait in the struct ``_row``,
    where no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*rest or [F.lit(None).cast("int").alias("_")]).alias("_row"))


def unshield(df: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of ``docs``, in their order."""
    return df.select(*[F.col(c) if c in own else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


#: Key filters hold at most this many integers whatever the input (about 32 MB
#: as a broadcast relation): the proven bound under which they are broadcast.
FILTER_BUCKETS = 1 << 20


def bucket_of(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BUCKETS)).cast("int")


def in_buckets(df: DataFrame, bucket: Column, keys: DataFrame, name: str) -> DataFrame:
    """Add boolean ``name``: whether the row's ``bucket`` occurs in ``keys.b``.

    ``keys`` has at most ``FILTER_BUCKETS`` distinct integers, so it may be
    broadcast at any input size; the filter has false positives, never misses."""
    k = keys.select(F.col("b").alias("_fb")).distinct().withColumn(name, F.lit(True))
    return (df.withColumn("_b", bucket).join(F.broadcast(k), F.col("_b") == F.col("_fb"), "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(False))).drop("_b", "_fb"))
