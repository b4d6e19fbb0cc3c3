"""Aggregate verse metrics (mini-batch sums and final ratios)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import rhyme


def nonblank_lines(text):
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def batch_metric_parts(outputs: DataFrame, text_col: str = "output", scheme_col: str = "rhyme_scheme") -> DataFrame:
    """Per text: |lines - 4|, 4-line flag, rhyme score of the first 4 lines."""
    x = outputs.select(nonblank_lines(F.col(text_col)).alias("ls"), F.col(scheme_col).alias("sc"))
    x = x.select("ls", "sc", rhyme.line_keys(F.slice("ls", 1, 4)).alias("keys"))
    return x.select(
        F.abs(F.size("ls") - 4).alias("pen"), (F.size("ls") == 4).cast("int").alias("perfect"),
        rhyme.scheme_rhyme_score(F.col("keys"), F.col("sc")).alias("rh"))


def batch_metrics(outputs: DataFrame, text_col: str = "output", scheme_col: str = "rhyme_scheme") -> DataFrame:
    """Sums of the parts divided by the number of texts (partial + final)."""
    p = batch_metric_parts(outputs, text_col, scheme_col)
    n = F.count(F.lit(1))
    return p.agg(F.round(F.sum("pen") / n, 6).alias("avg_line_count_penalty"),
                 F.round(F.sum("perfect") / n, 6).alias("perfect_4_line_ratio"),
                 F.round(F.sum("rh") / n, 6).alias("avg_rhyme_accuracy"),
                 n.alias("n_texts"))
