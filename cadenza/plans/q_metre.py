"""Metre queries: line patterns, per-line metre errors, best metre per poem."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import corpus, correct, lexicon as L, metre
from cadenza.plans.q_lexicon import _DICT_SQL, stress_overrides, stress_sources
from cadenza.plans.registry import register
from cadenza.functions import text as T
from cadenza.plans.sqlbits import LINES_CTE, metre_coef_values, metre_ctes, pattern_sql, vowels_sql, words_sql
from cadenza.sources.fixtures import documents


@register("line_patterns", f"""
WITH {LINES_CTE}
SELECT doc_id, line_no, {pattern_sql('text')} AS pattern,
       CAST(length({pattern_sql('text')}) AS INTEGER) AS n_syl
FROM lines""")
def q_line_patterns(spark, sf):
    lines = corpus.lines(documents(spark, sf))
    return metre.line_patterns(lines).select("doc_id", "line_no", "pattern", "n_syl")


_LINE_ERR_SQL = f"""
WITH RECURSIVE {LINES_CTE},
lp AS (SELECT doc_id, line_no, {pattern_sql('text')} AS pattern FROM lines),
{metre_ctes('lp')}
SELECT lp.doc_id, lp.line_no, e.metre, CAST(e.strong AS INTEGER) AS strong,
       CAST(e.weak AS INTEGER) AS weak, e.template, e.failed
FROM lp JOIN pat_err e ON e.pattern = lp.pattern"""


@register("line_metre_errors", _LINE_ERR_SQL)
def q_line_metre_errors(spark, sf):
    lines = corpus.lines(documents(spark, sf))
    return metre.line_metre_errors(lines)


_POEM_METRE_SQL = f"""
WITH RECURSIVE {LINES_CTE},
lp AS (SELECT doc_id, line_no, {pattern_sql('text')} AS pattern FROM lines),
{metre_ctes('lp')},
coefs(metre, midx, coef, sum_coef) AS (VALUES {metre_coef_values()}),
le AS MATERIALIZED (SELECT lp.doc_id, lp.line_no, e.metre, e.strong, e.weak FROM lp JOIN pat_err e ON e.pattern = lp.pattern),
tot AS (SELECT doc_id, line_no, sum(strong) AS ss, sum(weak) AS ws FROM le GROUP BY doc_id, line_no),
norm AS (
  SELECT le.doc_id, le.metre,
    CASE WHEN tot.ss <> 0 THEN le.strong / tot.ss ELSE CAST(le.strong AS DOUBLE) END AS s,
    CASE WHEN tot.ws <> 0 THEN le.weak / tot.ws ELSE CAST(le.weak AS DOUBLE) END AS w
  FROM le JOIN tot USING (doc_id, line_no)),
nl AS (SELECT doc_id, count(*) AS num_lines FROM lines GROUP BY doc_id),
val AS (
  SELECT n.doc_id, c.metre, c.midx, nl.num_lines,
    round(c.sum_coef + (sum(n.s) + sum(n.w) / 2.0) * c.coef / nl.num_lines, 9) AS v
  FROM norm n JOIN coefs c USING (metre) JOIN nl USING (doc_id)
  GROUP BY n.doc_id, c.metre, c.midx, c.coef, c.sum_coef, nl.num_lines)
SELECT doc_id, metre, v AS score, CAST(num_lines AS BIGINT) AS num_lines
FROM val QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v, midx) = 1"""


@register("poem_metre", _POEM_METRE_SQL)
def q_poem_metre(spark, sf):
    lines = corpus.lines(documents(spark, sf))
    return metre.poem_metre(lines)


@register("too_complex_line", f"""
WITH {LINES_CTE}
SELECT doc_id, line_no, CAST(n_multi AS INTEGER) AS n_multi, n_multi >= 8 AS too_complex
FROM (SELECT doc_id, line_no, len(list_filter(list_transform({words_sql('text')}, lambda w: {vowels_sql('w')}),
                                      lambda k: k > 1)) AS n_multi FROM lines)""")
def q_too_complex_line(spark, sf):
    """Lines with 8 or more multi-vowel words are rejected."""
    lines = corpus.lines(documents(spark, sf))
    nv = F.transform(T.words("text"), lambda w: T.vowel_count(w))
    x = lines.select("doc_id", "line_no", F.size(F.filter(nv, lambda k: k > 1)).cast("int").alias("n_multi"))
    return x.withColumn("too_complex", F.col("n_multi") >= 8)


@register("exclude_metres", f"""
{_POEM_METRE_SQL.replace("SELECT doc_id, metre, v AS score, CAST(num_lines AS BIGINT) AS num_lines" + chr(10) + "FROM val QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v, midx) = 1",
  "SELECT doc_id, metre, score FROM (SELECT doc_id, metre, v AS score FROM val QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v, midx) = 1) WHERE metre NOT IN ('dolnik2', 'dolnik3') ORDER BY doc_id LIMIT 20")}""")
def q_exclude_metres(spark, sf):
    """Evaluation subset: poems whose metre is not a dolnik, first 20 by id
    (the limit is the feature)."""
    pm = metre.poem_metre(corpus.lines(documents(spark, sf)))
    return pm.where(~F.col("metre").isin("dolnik2", "dolnik3")).orderBy("doc_id").limit(20).select(
        "doc_id", "metre", "score")


@register("top_poems", f"""
{_POEM_METRE_SQL.replace("SELECT doc_id, metre, v AS score, CAST(num_lines AS BIGINT) AS num_lines" + chr(10) + "FROM val QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v, midx) = 1",
  "SELECT b.source, b.doc_id, b.score, CAST(b.rk AS INTEGER) AS rank FROM (SELECT d.source, p.doc_id, p.score, row_number() OVER (PARTITION BY d.source ORDER BY p.score, p.doc_id) AS rk FROM (SELECT doc_id, v AS score FROM val QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v, midx) = 1) p JOIN documents d USING (doc_id)) b WHERE b.rk <= 10")}""")
def q_top_poems(spark, sf):
    """Per source, the 10 poems that fit their best metre most closely
    (lowest classifier value, ties by id): a per-group top-k."""
    from pyspark.sql import Window
    from cadenza.sources.fixtures import table
    pm = metre.poem_metre(corpus.lines(documents(spark, sf)))
    src = table(spark, sf, "documents", "doc_id", "source")
    j = pm.join(src, "doc_id")
    w = Window.partitionBy("source").orderBy("score", "doc_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10).select(
        "source", "doc_id", "score", F.col("rank").cast("int"))


def _marked_stresses(spark, sf):
    """word -> stresses: all that the override feeds list, else the dictionary's."""
    over = stress_overrides(spark, sf)
    listed = over.groupBy("word").agg(F.sort_array(F.collect_set("stress")).alias("l"))
    dic = L.merge_stress_sources(stress_sources(spark, sf), over)
    return dic.join(listed, "word", "left").select("word", F.coalesce("l", F.array("stress")).alias("stresses"))


def _flag_lines(spark, sf):
    return correct.flag_lines(corpus.lines(documents(spark, sf)), _marked_stresses(spark, sf))


#: flag lines, their templates and the fixes of every (line, metre), syllable by syllable
_FIX_SQL = f"""{_DICT_SQL}, {LINES_CTE},
lw AS MATERIALIZED (SELECT doc_id, line_no, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, line_no, {words_sql('text')} AS ws FROM lines)),
marks AS MATERIALIZED (SELECT d.word, coalesce(o.l, [d.stress]) AS l FROM dict d LEFT JOIN (SELECT word, list(DISTINCT stress) AS l FROM ovr GROUP BY word) o USING (word)),
wn AS MATERIALIZED (SELECT lw.*, {vowels_sql('lw.word')} AS n, m.l FROM lw LEFT JOIN marks m USING (word)),
wf AS MATERIALIZED (SELECT doc_id, line_no, pos, n, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN CASE WHEN length(word) <= 3 THEN '0' ELSE '1' END
              ELSE array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(l, i) THEN '1' ELSE '0' END), '') END AS f FROM wn),
fl AS MATERIALIZED (SELECT doc_id, line_no, array_to_string(list(f ORDER BY pos), '|') AS flags,
              array_to_string(list(CASE WHEN n = 1 THEN 'A' ELSE translate(f, '10', 'SU') END ORDER BY pos), '') AS pattern FROM wf GROUP BY doc_id, line_no),
{metre_ctes('fl')},
dl AS MATERIALIZED (SELECT flags, any_value(pattern) AS pattern FROM fl GROUP BY flags),
dw AS MATERIALIZED (SELECT flags, pattern, unnest(range(len(a))) AS w, unnest(a) AS f FROM (SELECT flags, pattern, string_split(flags, '|') AS a FROM dl)),
dp AS MATERIALIZED (SELECT *, coalesce(sum(length(f)) OVER (PARTITION BY flags ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM dw),
sy AS MATERIALIZED (SELECT dp.flags, dp.w, x.i, length(dp.f) AS n, length(replace(dp.f, '0', '')) AS cnt, substr(dp.f, x.i + 1, 1) AS mark,
              e.metre, lower(substr(e.template, CAST(dp.at + x.i + 1 AS INT), 1)) AS place
       FROM dp, unnest(range(20)) AS x(i), pat_err e WHERE x.i < length(dp.f) AND e.pattern = dp.pattern AND NOT e.failed AND e.template <> ''),
fix AS MATERIALIZED (SELECT flags, metre, w, i AS syl, 'addition' AS kind, 0 AS src FROM sy WHERE cnt = 0 AND place = 's'
        UNION ALL SELECT a.flags, a.metre, a.w, b.i, CASE WHEN a.cnt = 1 THEN 'correction' ELSE 'resolution' END, a.i
        FROM sy a JOIN sy b USING (flags, metre, w) WHERE a.n > 1 AND a.mark = '1' AND a.place = 'u' AND b.i <> a.i AND b.place = 's'),
nfix AS MATERIALIZED (SELECT flags, metre, count(*) FILTER (WHERE kind = 'correction') AS c, count(*) FILTER (WHERE kind = 'resolution') AS r,
                count(*) FILTER (WHERE kind = 'addition') AS a FROM fix GROUP BY ALL),
coefs(metre, midx, coef, sum_coef) AS (VALUES {metre_coef_values()}),
le AS MATERIALIZED (SELECT fl.doc_id, fl.line_no, fl.flags, e.metre, e.strong + coalesce(n.c, 0) AS strong, e.weak
       FROM fl JOIN pat_err e USING (pattern) LEFT JOIN nfix n ON n.flags = fl.flags AND n.metre = e.metre),
sh AS MATERIALIZED (SELECT doc_id, line_no, metre, CASE WHEN sum(strong) OVER w <> 0 THEN strong / sum(strong) OVER w ELSE strong END AS s,
              CASE WHEN sum(weak) OVER w <> 0 THEN weak / sum(weak) OVER w ELSE weak END AS w
       FROM le WINDOW w AS (PARTITION BY doc_id, line_no)),
pm AS MATERIALIZED (SELECT doc_id, metre, round(c.sum_coef + (sum(s) + sum(w) / 2.0) * c.coef / count(*), 9) AS score, count(*) AS num_lines
       FROM sh JOIN coefs c USING (metre) GROUP BY doc_id, metre, c.sum_coef, c.coef, c.midx
       QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score, c.midx) = 1)"""


@register("poem_metre_corrected", f"""
WITH RECURSIVE {_FIX_SQL}
SELECT doc_id, metre, score, num_lines FROM pm""")
def q_poem_metre_corrected(spark, sf):
    """Best metre when every stress that would have to move counts as a strong error."""
    return correct.poem_metre_corrected(correct.shared(_flag_lines(spark, sf)))


@register("improved_stress", f"""
WITH RECURSIVE {_FIX_SQL},
used AS (SELECT fl.doc_id, fl.line_no, fl.flags, pm.metre FROM fl JOIN pm USING (doc_id)),
moved AS (SELECT flags, metre, w, syl FROM fix WHERE kind <> 'addition' QUALIFY row_number() OVER (PARTITION BY flags, metre, w ORDER BY src DESC, syl DESC) = 1),
added AS (SELECT flags, metre, w, list(syl) AS syls FROM fix WHERE kind = 'addition' GROUP BY ALL),
lm AS (SELECT DISTINCT flags, metre FROM used),
nw AS (SELECT dp.flags, lm.metre, dp.w, CASE WHEN dp.f = '' THEN '' ELSE array_to_string(list_transform(range(length(dp.f)), lambda i:
         CASE WHEN list_contains(coalesce(a.syls, []), i) THEN '1' WHEN m.syl IS NOT NULL THEN CASE WHEN m.syl = i THEN '1' ELSE '0' END
              ELSE substr(dp.f, CAST(i + 1 AS INT), 1) END), '') END AS f
       FROM dp JOIN lm USING (flags) LEFT JOIN moved m ON m.flags = dp.flags AND m.metre = lm.metre AND m.w = dp.w
       LEFT JOIN added a ON a.flags = dp.flags AND a.metre = lm.metre AND a.w = dp.w),
im AS (SELECT flags, metre, array_to_string(list(f ORDER BY w), '|') AS improved FROM nw GROUP BY flags, metre)
SELECT u.doc_id, u.line_no, u.flags, im.improved, CAST(coalesce(n.c, 0) AS INT) AS n_corrections, CAST(coalesce(n.r, 0) AS INT) AS n_resolutions,
       CAST(coalesce(n.a, 0) AS INT) AS n_additions
FROM used u JOIN im USING (flags, metre) LEFT JOIN nfix n ON n.flags = u.flags AND n.metre = u.metre""")
def q_improved_stress(spark, sf):
    """Stress flags of every line after the corrections of its poem's metre."""
    lines = correct.shared(_flag_lines(spark, sf))
    return correct.improved_stress(lines, correct.poem_metre_corrected(lines))
