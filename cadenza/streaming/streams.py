"""Structured Streaming versions of the incremental metrics.

Every stream reads a table (a directory or one file) as a file stream with
``trigger(availableNow=True)``: all data present now, in micro-batches of
``max_files`` files.  Each micro-batch writes its own partial result into the
partition ``batch_id`` of a table, so a replayed batch rewrites the same rows, and
no streaming state grows with the data.  The partial results are combined when
the result is read; the order of files does not matter.

Progress and partial results live in one folder per query and table under the
session's ``spark.checkpoint.dir`` (a shared folder on a cluster): a restarted
driver, or a later call, goes on behind the last committed batch and only reads
files it has not seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import scores, similarity
from cadenza.operators.usage import EVENT_TYPES
from cadenza.session import ensure_checkpoint_dir

MAX_FILES = 64
#: Schemas of the tables that are streamed: later files may differ in how they store a number, so the
#: schema is not taken from whichever file is listed first.  Other tables use a footer.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def _root(spark: SparkSession) -> str:
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def _workdir(spark: SparkSession, name: str, path: str) -> str:
    """The same folder for the same query and table."""
    return f"{_root(spark)}/streams/{name}-{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:16]}"


def _is_directory(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _source(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """File stream over a table directory, or over one file (the file source watches
    directories; a name filter selects the file)."""
    table = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
    schema = SCHEMAS.get(table) or spark.read.parquet(path).schema  # footer only
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if _is_directory(spark, path):
        return r.parquet(path)
    d, name = path.rstrip("/").rsplit("/", 1)
    return r.option("pathGlobFilter", name).parquet(d)


def _partials(spark: SparkSession, name: str, path: str, max_files: int,
              partial: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Run the stream over new files; the partial results of all batches so far."""
    base = _workdir(spark, name, path)

    def write(df: DataFrame, batch_id: int) -> None:
        partial(df).write.mode("overwrite").parquet(f"{base}/parts/batch_id={batch_id}")

    q = (_source(spark, path, max_files).writeStream.foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if not _exists(spark, f"{base}/parts"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/parts").drop("batch_id")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stream_usage(spark: SparkSession, events_path: str, max_files: int = MAX_FILES) -> DataFrame:
    """Per-day usage counters kept as events arrive.

    A batch adds one row per (day, user) with that user's event counts; distinct
    visitors of a day are its distinct users over all batches."""
    kinds = [F.count(F.when(F.col("event_type") == t, 1)).alias(f"n_{t}") for t in EVENT_TYPES]

    def partial(df: DataFrame) -> DataFrame:
        return df.groupBy(F.to_date(F.col("ts")).alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), *kinds)

    names = ["n_events", *[f"n_{t}" for t in EVENT_TYPES]]
    p = _partials(spark, "usage", events_path, max_files, partial,
                  "day date, user_id long, " + ", ".join(f"{n} long" for n in names))
    user = p.groupBy("day", "user_id").agg(*[F.sum(n).alias(n) for n in names])
    g = user.groupBy("day").agg(F.count("user_id").alias("n_users"), *[F.sum(n).alias(n) for n in names])
    return g.select("day", "n_events", "n_users", *names[1:])


def stream_batch_metrics(spark: SparkSession, conversations_path: str, max_files: int = MAX_FILES) -> DataFrame:
    """Running sums over generated outputs (assistant turns), final ratios: one row of
    sums per batch, added up and divided at the end."""
    schemes = F.array(F.lit("AABB"), F.lit("ABAB"), F.lit("ABBA"))

    def partial(df: DataFrame) -> DataFrame:
        outs = df.where(F.col("role") == "assistant").select(
            F.col("text").alias("output"),
            F.element_at(schemes, (F.pmod("conv_id", F.lit(3)) + 1).cast("int")).alias("rhyme_scheme"))
        return scores.batch_metric_parts(outs).agg(
            F.sum(F.col("pen").cast("double")).alias("pen"), F.sum(F.col("perfect").cast("double")).alias("perfect"),
            F.sum(F.col("rh").cast("double")).alias("rh"), F.count(F.lit(1)).alias("n"))

    p = _partials(spark, "batch_metrics", conversations_path, max_files, partial,
                  "pen double, perfect double, rh double, n long")
    s = p.agg(*[F.sum(c).alias(c) for c in ("pen", "perfect", "rh", "n")])
    return s.select(F.round(F.col("pen") / F.col("n"), 6).alias("avg_line_count_penalty"),
                    F.round(F.col("perfect") / F.col("n"), 6).alias("perfect_4_line_ratio"),
                    F.round(F.col("rh") / F.col("n"), 6).alias("avg_rhyme_accuracy"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_texts"))


def stream_novelty_gate(spark: SparkSession, conversations_path: str, index: DataFrame,
                        gate: float = 0.90, max_files: int = MAX_FILES) -> DataFrame:
    """Each new output scored against a fixed indexed corpus (stream-static): every
    micro-batch runs the batch near-copy plan, keyed by (conv_id, turn)."""
    def partial(df: DataFrame) -> DataFrame:
        keyed = df.where(F.col("role") == "assistant").select(F.struct("conv_id", "turn").alias("doc_id"), "text")
        s = similarity.novelty_score(keyed, index, gate=gate)
        return s.select("doc_id.conv_id", "doc_id.turn", "novelty", "passes")

    return _partials(spark, "novelty", conversations_path, max_files, partial,
                     "conv_id long, turn long, novelty double, passes boolean")
