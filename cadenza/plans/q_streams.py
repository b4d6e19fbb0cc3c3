"""Streaming queries (availableNow runs; each equals its batch form)."""

from __future__ import annotations

from cadenza.plans.q_similarity import NOVELTY_SQL
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import clausula_ctes, last_word_sql
from cadenza.sources.fixtures import table
from cadenza.streaming import streams


@register("stream_usage", """
SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
       count(*) FILTER (WHERE event_type = 'view') AS n_view,
       count(*) FILTER (WHERE event_type = 'click') AS n_click,
       count(*) FILTER (WHERE event_type = 'signup') AS n_signup,
       count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase,
       count(*) FILTER (WHERE event_type = 'error') AS n_error
FROM events GROUP BY CAST(ts AS DATE)""")
def q_stream_usage(spark, sf):
    return streams.stream_usage(spark, f"{sf}/events.parquet")


@register("stream_batch_metrics", f"""
WITH req AS (SELECT conv_id, turn, text AS output, ['AABB', 'ABAB', 'ABBA'][conv_id % 3 + 1] AS rhyme_scheme
             FROM conversations WHERE role = 'assistant'),
nb AS (SELECT conv_id, turn, rhyme_scheme,
         list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM req),
ul AS (SELECT conv_id, turn, unnest(range(len(ls[1:4]))) AS i, unnest(ls[1:4]) AS line FROM nb),
src AS (SELECT conv_id, turn, i, line, {last_word_sql('line')} AS lw FROM ul),
{clausula_ctes('src', 'conv_id, turn, i, line')},
keys AS (SELECT conv_id, turn, list(clausula ORDER BY i) AS ks FROM cl GROUP BY conv_id, turn),
per AS (SELECT abs(len(r.ls) - 4) AS pen, CASE WHEN len(r.ls) = 4 THEN 1 ELSE 0 END AS perfect,
         CASE WHEN len(r.ls[1:4]) = 0 THEN 0.0 ELSE
           list_sum(list_transform(range(len(r.ls[1:4])), lambda i: len(list_filter(range(length(r.rhyme_scheme)),
             lambda j: j <> i % length(r.rhyme_scheme)
               AND substr(r.rhyme_scheme, j + 1, 1) = substr(r.rhyme_scheme, i % length(r.rhyme_scheme) + 1, 1)
               AND j < len(r.ls[1:4]) AND coalesce(k.ks[j + 1] = k.ks[i + 1], false))))) / len(r.ls[1:4]) END AS rh
       FROM nb r LEFT JOIN keys k USING (conv_id, turn))
SELECT round(sum(pen) / count(*), 6) AS avg_line_count_penalty,
       round(sum(perfect) / count(*), 6) AS perfect_4_line_ratio,
       round(sum(rh) / count(*), 6) AS avg_rhyme_accuracy, count(*) AS n_texts FROM per""")
def q_stream_batch_metrics(spark, sf):
    return streams.stream_batch_metrics(spark, f"{sf}/conversations.parquet")


_SRC = "(SELECT {'conv_id': conv_id, 'turn': turn} AS doc_id, text FROM conversations WHERE role = 'assistant')"


@register("stream_novelty_gate", f"""
SELECT doc_id.conv_id AS conv_id, doc_id.turn AS turn, novelty, passes FROM (
WITH {NOVELTY_SQL.replace("DOCS_SRC", _SRC)})""")
def q_stream_novelty_gate(spark, sf):
    index = table(spark, sf, "benchmark", "item_id", "text")
    return streams.stream_novelty_gate(spark, f"{sf}/conversations.parquet", index)
