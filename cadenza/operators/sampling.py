"""Reproducible ordering, sampling and splits.

Randomness is a seeded hash (``md5(key || ':' || seed)``), identical in every
engine, with the key as tie-break.  Global row numbers need no single-partition
window over the rows: a *bucket* that rises with the order (the first hash
digits, say) is counted, the counts become offsets, and rows are numbered inside
their bucket.  A row's bucket depends on its values alone, so evaluating the
input twice, or again after a lost executor, gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_hash(*keys: str, seed: int = 42) -> Column:
    parts = []
    for k in keys:
        parts += [F.col(k).cast("string"), F.lit(":")]
    return F.md5(F.concat(*parts, F.lit(str(seed))))


def global_row_number(df: DataFrame, order: list, bucket: list, name: str = "rn",
                      total: str | None = None) -> DataFrame:
    """Add a 1-based row number in ``order`` (a total order), and the row count as
    ``total`` if asked.

    ``bucket``: expressions that never fall along ``order`` and cut the rows into
    many parts.  One row per bucket is counted; the running sum goes over those
    counts only."""
    rows = df.withColumn("_bucket", F.struct(*[b.alias(f"b{i}") for i, b in enumerate(bucket)]))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    out = (rows.withColumn("_i", inside).join(offs, "_bucket")
           .withColumn(name, (F.col("_before") + F.col("_i")).cast("long")))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_bucket", "_i", "_before", "_all")


def _hash_order(df: DataFrame, keys: list[str], seed: int, total: str | None = None) -> DataFrame:
    """Rows numbered in seeded hash order (4,096 buckets of equal size)."""
    h = df.withColumn("_h", seeded_hash(*keys, seed=seed))
    order = [F.col("_h")] + [F.col(k) for k in keys]
    return global_row_number(h, order, [F.substring("_h", 1, 3)], total=total).drop("_h")


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Random permutation: ``new_index`` 0-based, old key and payload kept."""
    out = _hash_order(df, keys, seed)
    return out.withColumn("new_index", F.col("rn") - 1).drop("rn")


def train_test_split(df: DataFrame, keys: list[str], n_test: int = 1000, n_train: int = 10000,
                     n_shards: int = 5, seed: int = 42) -> DataFrame:
    """After a seeded shuffle: first ``n_test`` rows test, next ``n_train``
    train, the rest pretrain in ``n_shards`` contiguous shards (remainder in
    the last one)."""
    r = _hash_order(df.select(*keys), keys, seed, total="_total")
    per = F.floor((F.col("_total") - n_test - n_train) / n_shards)
    split = (F.when(F.col("rn") <= n_test, "test")
             .when(F.col("rn") <= n_test + n_train, "train").otherwise("pretrain"))
    shard = F.when(F.col("rn") > n_test + n_train,
                   F.when(per <= 0, F.lit(n_shards - 1)).otherwise(
                       F.least(F.floor((F.col("rn") - n_test - n_train - 1) / per), F.lit(n_shards - 1))))
    return r.select(*keys, "rn", split.alias("split"), shard.cast("int").alias("shard"))


def split_fraction(df: DataFrame, keys: list[str], frac: float = 0.9, seed: int = 42) -> DataFrame:
    """``floor(frac * n)`` seeded-random rows train, the rest test."""
    r = _hash_order(df.select(*keys), keys, seed, total="_total")
    return r.select(*keys, F.when(F.col("rn") <= F.floor(F.col("_total") * frac), "train")
                    .otherwise("test").alias("split"))


def rank_weights(keys: Column) -> Column:
    """``ARRAY<STRUCT<rank, key>>`` of an array of distinct keys: most spaces and letters first (spaces
    plus a fourth of the length), ties by key; rank r has the weight 1/r."""
    def size(k: Column) -> Column:
        return F.length(k) - F.length(F.replace(k, F.lit(" "), F.lit(""))) + F.floor(F.length(k) / 4)
    ordered = F.array_sort(F.transform(keys, lambda k: F.struct((-size(k)).alias("s"), k.alias("key"))))
    return F.transform(ordered, lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["key"].alias("key")))


def uniform(*keys: str, seed: int = 42) -> Column:
    """A number between 0 and 1, fixed by the keys and the seed."""
    return (F.conv(F.substring(seeded_hash(*keys, seed=seed), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def weighted_pick(rows: DataFrame, group: str, key: str, weight: Column, seed: int = 42) -> DataFrame:
    """One key per group with probability in proportion to its weight: the largest ``u ** (1 / weight)``
    (as a logarithm) wins.  The largest of parts is the largest of all, so tasks combine their rows before
    the shuffle and a hot group is one row per task."""
    score = F.log(uniform(group, key, seed=seed)) / weight
    return rows.groupBy(group).agg(F.max_by(F.col(key), F.struct(score.alias("s"), F.col(key).alias("k"))).alias(key), F.count("*").alias("n_keys"))
