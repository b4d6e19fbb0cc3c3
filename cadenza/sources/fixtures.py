"""Readers for the corpus tables (Parquet) and their column-pruned views.

Scans only select the columns an operator needs, so Parquet column pruning
(``ReadSchema``) and filter pushdown reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """``documents``, as its files are split.  Only where the session names a number in
    ``spark.cadenza.scanPartitions`` (local sessions do: the fixtures have one row group,
    hence one split) are its rows dealt out anew; on a cluster nothing is added."""
    df = table(spark, sf_dir, "documents", *(cols or ("doc_id", "text")))
    n = spark.conf.get("spark.cadenza.scanPartitions", None)
    return df.repartition(int(n)) if n else df
