"""Operator 2, exact deduplication by progressive refinement (SQL functions only).

1. Rows are grouped by the length of their normalised text.
2. Rows whose length occurs twice or more are grouped by (length, hash of the
   first characters).
3. Only rows whose (length, prefix hash) occurs twice or more get the hash of
   the whole text; they are grouped by (length, prefix hash, SHA-256).

Between the steps the surviving keys travel as a set of at most 2**20 bucket
numbers (a bound that does not depend on the input), so the texts stay where
they were read.  A bucket shared by chance only lets a row into the next,
exact, grouping.  All groupings combine before they shuffle; the final keys
are written before they are joined back, so that both sides of that join are
plain exchanges which adaptive execution can split when a third of all rows
have one text.

Normalisation replaces each run of ``[\\x20\\x09-\\x0D]`` by one space.
Cases: null text counts as empty, and empty texts are one group; of equal
texts the smallest doc_id stays (null doc_ids sort last; if all are null, the
group's rows all stay); rows that repeat the smallest doc_id of their group all
stay; an empty table gives an empty result; further columns pass through, and
columns named like the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bucket_of, in_buckets, keep, shield, text_of, unshield

PREFIX = 64


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_of(col), r"[\x20\x09-\x0D]+", " ")


def _marked(docs: DataFrame, prefix: int) -> DataFrame:
    """``docs`` with ``_len, _ph`` and ``_hash``: the whole text's SHA-256 where
    length and prefix hash both recur, else null."""
    n = docs.withColumn("_norm", normalised())
    sized = n.withColumn("_len", F.length("_norm")).withColumn("_ph", F.xxhash64(F.substring("_norm", 1, prefix)))
    narrow = keep(sized.select("_len", "_ph"), "exact-sizes")
    lens = (narrow.groupBy("_len").count().where("count > 1")
            .select(bucket_of(F.col("_len")).alias("b")))
    twice = in_buckets(narrow, bucket_of(F.col("_len")), lens, "_again").where("_again")
    pre = (twice.groupBy("_len", "_ph").count().where("count > 1")
           .select(bucket_of(F.col("_len"), F.col("_ph")).alias("b")))
    pre = keep(pre.distinct(), "exact-prefixes")
    marked = in_buckets(sized, bucket_of(F.col("_len"), F.col("_ph")), pre, "_again")
    return (marked.withColumn("_hash", F.when(F.col("_again"), F.sha2(F.col("_norm").cast("binary"), 256)))
            .drop("_norm", "_again"))


def _groups(rows: DataFrame) -> DataFrame:
    g = (rows.where(F.col("_hash").isNotNull()).groupBy("_len", "_ph", "_hash")
         .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
         .where("group_size > 1"))
    return keep(g, "exact-groups")


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One row per input row: its columns except ``text``, ``keep_id``,
    ``group_size`` and ``kept``."""
    docs = docs.drop("keep_id", "group_size", "kept")
    rows = keep(_marked(shield(docs, "doc_id", "text"), prefix).drop("text"), "exact-rows")
    g = _groups(rows)
    j = rows.join(g, ["_len", "_ph", "_hash"], "left")
    grouped = F.col("group_size").isNotNull()
    keep_id = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    rest = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return j.select("doc_id", *rest, keep_id.alias("keep_id"), size.alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep_id).alias("kept"))


def drop_exact(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Exactly one row of each group of equal texts (one with the smallest doc_id, nulls last), with the
    columns of ``docs``.  Only texts whose length and prefix recur are shuffled; of a group one row a
    task is."""
    own = ("doc_id", "text")
    key = ["_len", "_ph", "_hash"]
    rows = _marked(shield(docs, *own), prefix)
    g = _groups(rows.select("doc_id", *key))
    alone = rows.where(F.col("_hash").isNull())
    again = rows.where(F.col("_hash").isNotNull()).join(g, key, "left")
    single = again.where(F.col("group_size").isNull())
    chosen = again.where(F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    one = chosen.groupBy(*key).agg(F.first(F.struct("doc_id", "text", "_row")).alias("_one")).select("_one.*")
    parts = [unshield(x, docs, *own) for x in (alone, single, one)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
