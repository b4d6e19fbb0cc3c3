"""Prose requests: sampled chunks with an assigned rhyme scheme and metre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.sampling import seeded_hash, shuffle_rows

# Scheme blocks and alternating metres of the request table.
SCHEME_BLOCKS = [("AABB", 333), ("ABAB", 333), ("ABBA", 334)]
METRE_CYCLE = ["choreios", "iambos"]


def prose_requests(chunks: DataFrame, n: int = 1000, keys=("doc_id", "para_no", "sent_no"),
                   seed: int = 42) -> DataFrame:
    """``n`` chunks without replacement (seeded hash order, top-k), numbered
    0..n-1; scheme by row range, metre alternating even/odd rows.  The window
    runs over the ``n`` picked rows only."""
    h = seeded_hash(*keys, seed=seed)
    pick = chunks.withColumn("_h", h).orderBy("_h", *keys).limit(n)
    r = pick.withColumn("req_id", F.row_number().over(Window.orderBy("_h", *keys)) - 1)
    scheme = None
    lo = 0
    for name, size in SCHEME_BLOCKS:
        cond = F.col("req_id") < lo + size
        scheme = F.when(cond, name) if scheme is None else scheme.when(cond, name)
        lo += size
    scheme = scheme.otherwise(SCHEME_BLOCKS[-1][0])
    meter = F.element_at(F.array(*[F.lit(m) for m in METRE_CYCLE]),
                         (F.col("req_id") % len(METRE_CYCLE) + 1).cast("int"))
    return r.select(F.col("req_id").cast("long").alias("req_id"), *keys,
                    F.col("chunk").alias("text"), scheme.alias("rhyme_scheme"), meter.alias("meter"))


def all_requests(chunks: DataFrame, keys=("doc_id", "para_no", "sent_no"), seed: int = 42) -> DataFrame:
    """Every chunk as a request, numbered in seeded hash order; scheme by thirds of a
    thousand (the blocks of :func:`prose_requests`, again and again), metre alternating."""
    r = shuffle_rows(chunks.select(*keys, "chunk"), list(keys), seed).withColumnRenamed("new_index", "req_id")
    at = F.col("req_id") % sum(n for _, n in SCHEME_BLOCKS)
    scheme = F.when(at < SCHEME_BLOCKS[0][1], SCHEME_BLOCKS[0][0]).when(
        at < SCHEME_BLOCKS[0][1] + SCHEME_BLOCKS[1][1], SCHEME_BLOCKS[1][0]).otherwise(SCHEME_BLOCKS[2][0])
    meter = F.element_at(F.array(*[F.lit(m) for m in METRE_CYCLE]),
                         (F.col("req_id") % len(METRE_CYCLE) + 1).cast("int"))
    return r.select("req_id", *keys, F.col("chunk").alias("text"), scheme.alias("rhyme_scheme"), meter.alias("meter"))
