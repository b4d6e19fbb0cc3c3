"""Corpus tables: poems -> lines -> words -> syllables.

All of these are narrow transformations (explode / posexplode / expressions):
a document's lines stay in the partition that read the document, so later
per-poem aggregations can reuse that placement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.profiles import LATIN, Profile


def lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line_no, text): newline / sentence pieces with at least one letter."""
    return cut_lines(docs, key, text_col).select(key, F.posexplode("_l").alias("line_no", "text"))


def cut_lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, _l ARRAY<STRING>): the verse lines, settled, as the filters that Spark derives for what explodes
    them would cut every text a second time."""
    return settled(docs.select(key, T.verse_lines(text_col).alias("_l")))


def poems(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan_poems: (key, lines ARRAY<STRING>, n_lines); documents without a
    verse line are skipped (the reference skips poems that fail to load)."""
    return (docs.select(key, T.verse_lines(text_col).alias("lines"))
            .where(F.size("lines") > 0)
            .withColumn("n_lines", F.size("lines")))


def words(line_df: DataFrame, prof: Profile | str = LATIN,
          keys=("doc_id", "line_no"), text_col: str = "text") -> DataFrame:
    """(keys, word_pos, word, n_vowels, stress) with the default stress rule."""
    w = line_df.select(*keys, F.posexplode(T.words(text_col)).alias("word_pos", "word"))
    w = w.withColumn("n_vowels", T.vowel_count("word", prof))
    return w.withColumn("stress", T.default_stress("n_vowels"))


def syllables(word_df: DataFrame, prof: Profile | str = LATIN,
              keys=("doc_id", "line_no", "word_pos")) -> DataFrame:
    """(keys, syl_pos, syllable, stressed)."""
    s = word_df.select(*keys, "stress", F.posexplode(T.syllables("word", prof)).alias("syl_pos", "syllable"))
    return s.select(*keys, "syl_pos", "syllable",
                    F.coalesce(F.col("syl_pos") + 1 == F.col("stress"), F.lit(False)).alias("stressed"))


def word_rows(df: DataFrame, *cols: str, text_col: str = "text") -> DataFrame:
    """(cols, word): the words of whole texts, found once (see :func:`cut_lines`)."""
    w = settled(df.select(*cols, T.words(text_col).alias("_w")))
    return w.select(*cols, F.explode("_w").alias("word"))


def tasks(spark) -> int:
    """Partitions for few bytes that are much work."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a one-element ``explode``: expressions above read the columns as values and
    are not merged with the (large) expressions that made them.  Nothing is shuffled or written."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_s")).select("_s.*")
