"""Near copies and soft matching.

Near-copy scoring is an inverted-index equi-join on character trigrams.  The
Jaccard value needs no second pass over the texts: with per-text distinct
shingle counts ``nA``, ``nB`` and the join's intersection count ``i``,
``|A ∪ B| = nA + nB - i``.  Join strategies are left to Spark: adaptive execution
broadcasts the index side when its measured bytes allow it and splits hot
shingles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators.corpus import settled


def distinct_docs(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Each distinct text once, represented by its smallest key.  Rows are grouped by
    a 256-bit digest; NULL texts are one group."""
    return (df.groupBy(F.sha2(F.col(text_col).cast("binary"), 256).alias("_digest"))
            .agg(F.first(text_col).alias(text_col), F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies"))
            .drop("_digest"))


def _shingle_rows(df: DataFrame, key: str, lower: bool, text_col: str = "text") -> DataFrame:
    # settle the array before its size is taken and it is exploded: an expression in the same select as the
    # generator is re-evaluated per generated row, and the filter derived for it per text
    a = settled(df.select(key, T.shingles(text_col, 3, lower=lower).alias("_sh")))
    a = a.select(key, F.size("_sh").alias("n"), "_sh")
    return a.select(key, "n", F.explode("_sh").alias("sh"))


def shared_shingle_counts(docs: DataFrame, index: DataFrame, doc_key: str = "doc_id",
                          item_key: str = "item_id", lower: bool = False) -> DataFrame:
    """(doc, item, shared, n_doc, n_item): distinct trigrams in common."""
    d = _shingle_rows(docs, doc_key, lower).withColumnRenamed("n", "n_doc")
    i = _shingle_rows(index, item_key, lower).withColumnRenamed("n", "n_item")
    return (d.join(i, "sh").groupBy(doc_key, item_key, "n_doc", "n_item")
            .agg(F.count(F.lit(1)).alias("shared")))


def top_shared(docs: DataFrame, index: DataFrame, n: int = 100, doc_key: str = "doc_id",
               item_key: str = "item_id") -> DataFrame:
    """The ``n`` indexed items sharing most case-sensitive trigrams with each
    doc (ties by item key).  ``row_number <= n`` is planned as a window group
    limit, pruned before the shuffle."""
    c = shared_shingle_counts(docs, index, doc_key, item_key, lower=False)
    w = Window.partitionBy(doc_key).orderBy(F.col("shared").desc(), F.col(item_key))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
        doc_key, item_key, "shared", "rank")


def novelty_score(docs: DataFrame, index: DataFrame, n: int | None = None, doc_key: str = "doc_id",
                  item_key: str = "item_id", gate: float = 0.90) -> DataFrame:
    """Max lower-case trigram Jaccard against all distinct indexed texts that share a
    trigram (with ``n``: only the ``n`` of :func:`top_shared`, a cut); ``passes`` when
    below ``gate``.  Texts without candidates score 0."""
    index = distinct_docs(index, item_key)
    lc = shared_shingle_counts(docs, index, doc_key, item_key, lower=True)
    jac = lc.select(doc_key, item_key,
                    (F.col("shared") / (F.col("n_doc") + F.col("n_item") - F.col("shared") + F.lit(1e-6)))
                    .alias("jac"))
    if n is not None:
        cand = top_shared(docs, index, n, doc_key, item_key).select(doc_key, item_key)
        jac = cand.join(jac, [doc_key, item_key], "left")
    best = jac.groupBy(doc_key).agg(F.max(F.coalesce("jac", F.lit(0.0))).alias("novelty"))
    out = docs.select(doc_key).join(best, doc_key, "left").select(
        doc_key, F.round(F.coalesce("novelty", F.lit(0.0)), 6).alias("novelty"))
    return out.withColumn("passes", F.col("novelty") < gate)


# ---------------------------------------------------------------------------
# soft token matching (vectors are an input table)
# ---------------------------------------------------------------------------
SOFT_SCHEMA = "cand long, ref long, side int, token long, best double"
SOFT_BLOCK = 512


def _soft_block(key, pdf):
    """Best cosine of every token of two blocks against the other block."""
    import numpy as np
    import pandas as pd

    def unit(side):
        x = np.stack(pdf.loc[pdf["side"] == side, "embedding"].to_numpy()).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if pdf["side"].nunique() < 2:
        return pd.DataFrame({c: [] for c in ("cand", "ref", "side", "token", "best")})
    sim = unit(0) @ unit(1).T
    out = []
    for side, best in ((0, sim.max(axis=1)), (1, sim.max(axis=0))):
        out.append(pd.DataFrame({"cand": int(key[0]), "ref": int(key[1]), "side": side,
                                 "token": pdf.loc[pdf["side"] == side, "token"].to_numpy(), "best": best}))
    return pd.concat(out)


def soft_match_score(vectors: DataFrame, pairs: DataFrame, bag_col: str = "label", token_col: str = "vec_id") -> DataFrame:
    """Greedy soft matching of two token-vector bags (candidate vs reference):
    precision = mean over candidate tokens of the best cosine against the
    reference tokens, recall the reverse, F1 their harmonic mean.

    ``pairs(cand, ref)`` names bag pairs.  Bags are cut into blocks of about
    ``SOFT_BLOCK`` tokens; each pair of blocks is one group with a bounded matrix, which
    gives every token its best match there; the maxima over blocks, then the means, are
    ordinary aggregates."""
    v = vectors.select(F.col(bag_col).cast("long").alias("bag"), F.col(token_col).cast("long").alias("token"), "embedding")
    size = v.groupBy("bag").agg(F.ceil(F.count(F.lit(1)) / SOFT_BLOCK).cast("int").alias("nb"))
    p = (pairs.join(size.select(F.col("bag").alias("cand"), F.col("nb").alias("nc")), "cand")
         .join(size.select(F.col("bag").alias("ref"), F.col("nb").alias("nr")), "ref"))

    def rows(side: int, name: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        x = p.join(v.withColumnRenamed("bag", name), name)
        return x.select("cand", "ref", F.lit(side).alias("side"), "token", "embedding",
                        F.pmod(F.xxhash64("token"), F.col(own)).cast("int").alias(mine),
                        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))
    both = rows(0, "cand", "nc", "nr", "i", "j").unionByName(rows(1, "ref", "nr", "nc", "j", "i"))
    part = both.groupBy("cand", "ref", "i", "j").applyInPandas(_soft_block, SOFT_SCHEMA)
    best = part.groupBy("cand", "ref", "side", "token").agg(F.max("best").alias("best"))
    g = best.groupBy("cand", "ref").agg(F.avg(F.when(F.col("side") == 0, F.col("best"))).alias("precision"),
                                        F.avg(F.when(F.col("side") == 1, F.col("best"))).alias("recall"))
    s = F.col("precision") + F.col("recall")
    return g.withColumn("f1", F.when(s != 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(F.lit(0.0)))
