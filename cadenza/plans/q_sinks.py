"""Sink queries: write into the shared folder, read back what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadenza.operators import corpus, sampling
from cadenza.plans import q_curate, q_lexicon
from cadenza.plans.registry import ORACLE, register
from cadenza.session import ensure_checkpoint_dir
from cadenza.sources.fixtures import documents


def _folder(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"


@register("sink_shards", ORACLE["train_test_split"])
def q_sink_shards(spark, sf):
    """Test, train and five pretrain shards, one folder each."""
    path = _folder(spark, "shards")
    lines = corpus.lines(documents(spark, sf)).select("doc_id", "line_no")
    rows = sampling.train_test_split(lines, ["doc_id", "line_no"])
    rows.write.partitionBy("split", "shard").parquet(path)
    back = spark.read.schema("doc_id long, line_no int, rn long, split string, shard int").parquet(path)
    return back.select("doc_id", "line_no", "rn", "split", "shard")


@register("pretrain_shards", f"""
WITH s AS ({ORACLE["train_test_split"]})
SELECT shard, count(*) AS n, min(rn) AS first_rn, max(rn) AS last_rn FROM s WHERE split = 'pretrain' GROUP BY shard""")
def q_pretrain_shards(spark, sf):
    """The contiguous pretrain shards (the remainder is in the last)."""
    lines = corpus.lines(documents(spark, sf)).select("doc_id", "line_no")
    r = sampling.train_test_split(lines, ["doc_id", "line_no"]).where("split = 'pretrain'")
    return r.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


def write_batches(rows, path: str, key: str = "batch_id") -> None:
    """Write the batches that ``path`` does not hold yet, one folder each: a run that
    was broken off goes on with the missing ones."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        done = spark.read.parquet(path).select(F.col(key).cast("long").alias(key)).distinct()
        rows = rows.join(done, key, "left_anti")
    rows.write.mode("append").partitionBy(key).parquet(path)


@register("sink_resumable_batches", ORACLE["row_batches"])
def q_sink_resumable_batches(spark, sf):
    """Batches of 15 requests written in two runs: the second finds the first one's."""
    path = _folder(spark, "batches")
    rows = q_curate.q_row_batches(spark, sf).withColumn("batch_id", F.col("batch_id"))
    bundle = rows.withColumn("folder", F.floor(F.col("batch_id") / 64))      # 64 batches a folder
    write_batches(bundle.where("folder % 2 = 0"), path, "folder")
    write_batches(bundle, path, "folder")
    return spark.read.schema("req_id long, batch_id long, folder long").parquet(path).select("req_id", "batch_id")


@register("sink_vocab", ORACLE["vocab_build"])
def q_sink_vocab(spark, sf):
    """The unit vocabulary written in id order as text, read back as (unit, id)."""
    path = _folder(spark, "vocab")
    v = q_lexicon.q_vocab_build(spark, sf)
    v.orderBy("id").select(F.concat_ws("\t", F.col("id").cast("string"), "unit").alias("value")).write.text(path)
    x = F.split("value", "\t", 2)
    return spark.read.text(path).select(x[1].alias("unit"), x[0].cast("long").alias("id"))
