"""Counts, histograms, frequency lists, usage counters, accuracy tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import corpus, curate
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import LINES_CTE, PAIRS_CTE, clean_text_sql, filter_lines_sql, words_sql
from cadenza.sources.fixtures import documents, table


@register("value_counts", """
SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic""")
def q_value_counts(spark, sf):
    lab = table(spark, sf, "labels", "quality", "toxic")
    return lab.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@register("length_profile", f"""
WITH {PAIRS_CTE},
x AS (SELECT length(array_to_string({filter_lines_sql('output')}, chr(10))) AS verse,
             length({clean_text_sql('input')}) AS prose FROM pairs),
v AS (SELECT 'verse' AS kind, verse AS x FROM x UNION ALL SELECT 'prose', prose FROM x
      UNION ALL SELECT 'diff', verse - prose FROM x),
mm AS (SELECT kind, min(x) AS mn, max(x) AS mx FROM v GROUP BY kind)
SELECT v.kind, CAST(CASE WHEN mm.mx = mm.mn THEN 0 ELSE least(floor((v.x - mm.mn) * 40.0 / (mm.mx - mm.mn)), 39) END AS INTEGER) AS bin,
       count(*) AS n
FROM v JOIN mm USING (kind) GROUP BY ALL""")
def q_length_profile(spark, sf):
    """40-bin histograms of verse length, prose length and their difference."""
    conv = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    p = curate.request_output_pairs(conv)
    x = p.select(F.length(F.array_join(T.filter_lines("output"), "\n")).alias("verse"),
                 F.length(T.clean_text("input")).alias("prose"))
    v = x.select(F.explode(F.array(
        F.struct(F.lit("verse").alias("kind"), F.col("verse").alias("x")),
        F.struct(F.lit("prose").alias("kind"), F.col("prose").alias("x")),
        F.struct(F.lit("diff").alias("kind"), (F.col("verse") - F.col("prose")).alias("x")))).alias("v")
    ).select("v.kind", "v.x")
    mm = v.groupBy("kind").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    j = v.join(F.broadcast(mm), "kind")  # three rows
    b = F.when(F.col("mx") == F.col("mn"), 0).otherwise(
        F.least(F.floor((F.col("x") - F.col("mn")) * 40.0 / (F.col("mx") - F.col("mn"))), F.lit(39)))
    return j.groupBy("kind", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("word_freq", f"""
WITH {LINES_CTE},
w AS (SELECT unnest({words_sql('text')}) AS word FROM lines)
SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) > 1""")
def q_word_freq(spark, sf):
    """Corpus word counts above ``min_freq`` = 1 (partial counts map-side)."""
    w = corpus.lines(documents(spark, sf)).select(F.explode(T.words("text")).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


@register("usage_stats", """
WITH d AS (
  SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
         count(*) FILTER (WHERE event_type = 'view') AS n_view,
         count(*) FILTER (WHERE event_type = 'click') AS n_click,
         count(*) FILTER (WHERE event_type = 'signup') AS n_signup,
         count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase,
         count(*) FILTER (WHERE event_type = 'error') AS n_error
  FROM events GROUP BY CAST(ts AS DATE))
SELECT *, CAST(sum(n_events) OVER (ORDER BY day) AS BIGINT) AS events_to_date,
       CAST(row_number() OVER (ORDER BY day) AS BIGINT) AS active_days
FROM d""")
def q_usage_stats(spark, sf):
    """Per-day counters; running totals over the (small) per-day table."""
    from cadenza.operators.usage import daily_usage
    ev = table(spark, sf, "events", "ts", "user_id", "event_type")
    d = daily_usage(ev)
    w = Window.orderBy("day")  # one row per calendar day
    return d.select("*", F.sum("n_events").over(w).cast("long").alias("events_to_date"),
                    F.row_number().over(w).cast("long").alias("active_days"))


@register("accuracy_confusion", """
WITH j AS (SELECT l.quality AS label, CASE WHEN d.n_chars >= 2000 THEN 1 ELSE 0 END AS pred
           FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT label, pred, count(*) AS n FROM j GROUP BY label, pred)
SELECT label, pred, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS rate,
       round(sum(CASE WHEN label = pred THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS accuracy
FROM c""")
def q_accuracy_confusion(spark, sf):
    """Confusion matrix (normalised by true class) and accuracy of a rule-based
    quality prediction (``n_chars >= 2000``) against ``labels``."""
    lab = table(spark, sf, "labels", "doc_id", "quality")
    docs = table(spark, sf, "documents", "doc_id", "n_chars")
    j = lab.join(docs, "doc_id").select(F.col("quality").alias("label"),
                                        F.when(F.col("n_chars") >= 2000, 1).otherwise(0).alias("pred"))
    c = j.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    # at most 4 rows after the aggregate: the windows below run on those
    all_ = Window.partitionBy(F.lit(1))
    return c.select("label", "pred", "n",
                    F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6).alias("rate"),
                    F.round(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).over(all_)
                            / F.sum("n").over(all_), 6).alias("accuracy"))
