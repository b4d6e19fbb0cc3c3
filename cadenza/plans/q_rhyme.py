"""Rhyme queries: endings, pairs, quatrains, markup, scheme scores, scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import corpus, curate, metre, rhyme
from cadenza.operators.requests import METRE_CYCLE
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import (LINES_CTE, REQ_PAIRS_CTE, SYL_RX, V, clausula_ctes,
                                   filter_lines_sql, last_word_sql, metre_ctes, pattern_sql)
from cadenza.sources.fixtures import documents, table

_PUNCT_CLASS = "[" + rhyme._re_escape(rhyme.PUNCT).replace("'", "''") + "]"


def rhyme_key_sql(line: str) -> str:
    toks = f"list_filter(string_split(regexp_replace({line}, '{_PUNCT_CLASS}', '', 'g'), ' '), lambda x: x <> '')"
    last = f"lower({toks}[-1])"
    syls = f"regexp_extract_all({last}, '{SYL_RX}')"
    return (f"CASE WHEN len({toks}) = 0 THEN NULL WHEN len({syls}) >= 2 "
            f"THEN {syls}[-2] || {syls}[-1] ELSE {last} END")


def _endings(spark, sf):
    return rhyme.line_endings(corpus.lines(documents(spark, sf)))


_ENDINGS_SQL = f"""{LINES_CTE},
src AS (SELECT doc_id, line_no, text, {last_word_sql('text')} AS lw FROM lines),
{clausula_ctes('src', 'doc_id, line_no, text')}"""


@register("rhyme_key", f"""
WITH {_ENDINGS_SQL}
SELECT doc_id, line_no, lw AS last_word, clausula, {rhyme_key_sql('text')} AS rhyme_key FROM cl""")
def q_rhyme_key(spark, sf):
    e = _endings(spark, sf)
    return e.select("doc_id", "line_no", "last_word", "clausula", rhyme.rhyme_key("text").alias("rhyme_key"))


_GROUPS_SQL = f"""{_ENDINGS_SQL},
fst AS (SELECT doc_id, clausula, min(line_no) AS first_line FROM cl WHERE clausula IS NOT NULL GROUP BY doc_id, clausula),
num AS (SELECT doc_id, clausula, first_line, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS rhyme_group FROM fst)"""


@register("rhyme_groups", f"""
WITH {_GROUPS_SQL}
SELECT c.doc_id, CAST(c.line_no AS BIGINT) AS line_no, c.clausula, CAST(n.rhyme_group AS BIGINT) AS rhyme_group
FROM cl c LEFT JOIN num n ON n.doc_id = c.doc_id AND n.clausula = c.clausula""")
def q_rhyme_groups(spark, sf):
    """Every line with the number of its rhyme group (by first appearance)."""
    return rhyme.rhyme_groups(documents(spark, sf)).select("doc_id", "line_no", "clausula", "rhyme_group")


@register("exact_rhyme_pairs", f"""
WITH {_GROUPS_SQL}
SELECT c.doc_id, CAST(lag(c.line_no) OVER w AS BIGINT) AS line_a, CAST(c.line_no AS BIGINT) AS line_b,
       CAST(n.rhyme_group AS BIGINT) AS rhyme_group
FROM cl c JOIN num n ON n.doc_id = c.doc_id AND n.clausula = c.clausula
WINDOW w AS (PARTITION BY c.doc_id, c.clausula ORDER BY c.line_no)
QUALIFY line_a IS NOT NULL""")
def q_exact_rhyme_pairs(spark, sf):
    """Each line linked to the line before it that rhymes, at any distance: with the
    group number this holds every pair, in as many rows as there are lines."""
    return rhyme.exact_rhyme_pairs(documents(spark, sf)).select("doc_id", "line_a", "line_b", "rhyme_group")


@register("near_rhyme_pairs", f"""
WITH {_ENDINGS_SQL}
SELECT a.doc_id, CAST(a.line_no AS BIGINT) AS line_a, CAST(b.line_no AS BIGINT) AS line_b,
       CAST(b.line_no - a.line_no AS INTEGER) AS gap
FROM cl a JOIN cl b ON a.doc_id = b.doc_id AND a.clausula = b.clausula AND b.line_no - a.line_no BETWEEN 1 AND 3""")
def q_near_rhyme_pairs(spark, sf):
    """Feature: rhyming lines within a window of three lines."""
    return rhyme.near_rhyme_pairs(documents(spark, sf)).select("doc_id", "line_a", "line_b", "gap")


_QUATRAIN_SQL = f"""{_ENDINGS_SQL},
win AS (SELECT doc_id, line_no AS start, clausula AS k0,
          lead(clausula, 1) OVER w AS k1, lead(clausula, 2) OVER w AS k2, lead(clausula, 3) OVER w AS k3,
          array_to_string([text, lead(text, 1) OVER w, lead(text, 2) OVER w, lead(text, 3) OVER w], chr(10)) AS stanza
        FROM cl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
valid AS (SELECT doc_id, start, stanza,
            CASE WHEN k0 IS NULL OR k1 IS NULL OR k2 IS NULL OR k3 IS NULL THEN NULL
                 WHEN k0 = k1 AND k2 = k3 AND k0 <> k2 THEN 'AABB'
                 WHEN k0 = k2 AND k1 = k3 AND k0 <> k1 THEN 'ABAB'
                 WHEN k0 = k3 AND k1 = k2 AND k0 <> k1 THEN 'ABBA' END AS scheme
          FROM win),
v AS (SELECT * FROM valid WHERE scheme IS NOT NULL),
greedy(doc_id, start, nxt) AS (
  SELECT doc_id, min(start), min(start) + 4 FROM v GROUP BY doc_id
  UNION ALL
  SELECT g.doc_id, min(v.start), min(v.start) + 4 FROM greedy g JOIN v ON v.doc_id = g.doc_id AND v.start >= g.nxt
  GROUP BY g.doc_id),
quatrains AS (SELECT v.doc_id, v.start, v.scheme, v.stanza FROM greedy g JOIN v USING (doc_id, start))"""


@register("quatrains", f"""
WITH RECURSIVE {_QUATRAIN_SQL}
SELECT doc_id, CAST(start AS BIGINT) AS start, scheme, stanza FROM quatrains""")
def q_quatrains(spark, sf):
    q = rhyme.poem_quatrains(documents(spark, sf))
    return q.select("doc_id", F.col("start").cast("long"), "scheme", "stanza")


def _markup_sql(lines: str, scheme: str) -> str:
    tag = (f"'<rhyme' || substr({scheme}, i % length({scheme}) + 1, 1) || '>' || {rhyme_key_sql('l')} || "
           f"'</rhyme' || substr({scheme}, i % length({scheme}) + 1, 1) || '> ' || l")
    return (f"array_to_string(list_filter(list_transform(range(len({lines})), lambda i: "
            f"(SELECT CASE WHEN {rhyme_key_sql('l')} IS NULL THEN NULL ELSE {tag} END "
            f"FROM (SELECT {lines}[i + 1] AS l))), lambda x: x IS NOT NULL), chr(10))")


@register("rhyme_markup", f"""
WITH RECURSIVE {_QUATRAIN_SQL},
ql AS (SELECT doc_id, start, scheme, unnest(range(4)) AS i, unnest(string_split(stanza, chr(10))) AS l FROM quatrains),
tagged AS (SELECT doc_id, start, i,
  CASE WHEN {rhyme_key_sql('l')} IS NULL THEN NULL ELSE
    '<rhyme' || substr(scheme, i % length(scheme) + 1, 1) || '>' || {rhyme_key_sql('l')} || '</rhyme'
    || substr(scheme, i % length(scheme) + 1, 1) || '> ' || l END AS t FROM ql)
SELECT doc_id, CAST(start AS BIGINT) AS start, string_agg(t, chr(10) ORDER BY i) AS markup
FROM tagged GROUP BY doc_id, start""")
def q_rhyme_markup(spark, sf):
    q = rhyme.poem_quatrains(documents(spark, sf))
    m = rhyme.rhyme_markup(F.split("stanza", "\n"), F.col("scheme"))
    return q.select("doc_id", F.col("start").cast("long"), F.array_join(m, "\n").alias("markup"))


# ---------------------------------------------------------------------------
# scoring of generated verse (requests = user turns; outputs = next assistant turn)
# ---------------------------------------------------------------------------
def requests_with_outputs(spark, sf):
    conv = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    p = curate.request_output_pairs(conv)
    schemes = F.array(F.lit("AABB"), F.lit("ABAB"), F.lit("ABBA"))
    return p.select(
        "conv_id", "turn", "input", "output",
        F.element_at(schemes, (F.pmod("conv_id", F.lit(3)) + 1).cast("int")).alias("rhyme_scheme"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "choreios").otherwise("iambos").alias("meter"),
        F.concat(F.lit("turn"), (F.col("turn") + 1).cast("string")).alias("model"))


_REQ_LINES_SQL = f"""{REQ_PAIRS_CTE},
rl AS (SELECT conv_id, turn, model, rhyme_scheme, meter, {filter_lines_sql('output')} AS all_lines FROM req),
rl8 AS (SELECT *, all_lines[1:8] AS ls FROM rl),
ul AS (SELECT conv_id, turn, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM rl8),
src AS (SELECT conv_id, turn, i, line, {last_word_sql('line')} AS lw FROM ul),
{clausula_ctes('src', 'conv_id, turn, i, line')},
keys AS (SELECT conv_id, turn, list(clausula ORDER BY i) AS ks FROM cl GROUP BY conv_id, turn),
rs AS (SELECT r.conv_id, r.turn, r.model, len(r.all_lines) AS n_all, len(r.ls) AS n,
         CASE WHEN len(r.ls) = 0 THEN 0.0 ELSE
           list_sum(list_transform(range(len(r.ls)), lambda i: len(list_filter(range(length(r.rhyme_scheme)),
             lambda j: j <> i % length(r.rhyme_scheme)
               AND substr(r.rhyme_scheme, j + 1, 1) = substr(r.rhyme_scheme, i % length(r.rhyme_scheme) + 1, 1)
               AND j < len(r.ls) AND coalesce(k.ks[j + 1] = k.ks[i + 1], false))))) / len(r.ls) END AS rhyme_score
       FROM rl8 r LEFT JOIN keys k USING (conv_id, turn))"""


def _rhyme_scores(spark, sf):
    r = requests_with_outputs(spark, sf)
    r = r.select("conv_id", "turn", "model", "rhyme_scheme", T.filter_lines("output").alias("ls"))
    r = r.select("conv_id", "turn", "model", "rhyme_scheme", F.size("ls").alias("n_all"),
                 rhyme.line_keys(F.slice("ls", 1, 8)).alias("keys"))
    return r.select("conv_id", "turn", "model", "n_all",
                    rhyme.scheme_rhyme_score(F.col("keys"), F.col("rhyme_scheme")).alias("rhyme_score"))


@register("rhyme_score", f"""
WITH {_REQ_LINES_SQL}
SELECT conv_id, turn, round(rhyme_score, 6) AS rhyme_score FROM rs""")
def q_rhyme_score(spark, sf):
    return _rhyme_scores(spark, sf).select("conv_id", "turn", F.round("rhyme_score", 6).alias("rhyme_score"))


@register("volume_score", f"""
WITH {REQ_PAIRS_CTE}
SELECT conv_id, turn, CAST(CASE WHEN len({filter_lines_sql('output')}) IN (4, 8) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS len_score
FROM req""")
def q_volume_score(spark, sf):
    r = requests_with_outputs(spark, sf)
    n = F.size(T.filter_lines("output"))
    return r.select("conv_id", "turn", F.when(n.isin(4, 8), 1.0).otherwise(0.0).alias("len_score"))


_METER_PARTS = f"""ml AS (SELECT conv_id, turn, meter, unnest({filter_lines_sql('output')}[1:8]) AS line FROM req),
mp AS (SELECT conv_id, turn, meter, {pattern_sql('line')} AS pattern FROM ml),
{metre_ctes('mp')},
ms AS (SELECT mp.conv_id, mp.turn,
          avg(CASE WHEN length(mp.pattern) > 0 THEN (coalesce(e.strong, 0) + coalesce(e.weak, 0)) / length(mp.pattern)
              ELSE 0.0 END) AS meter_score
       FROM mp LEFT JOIN pat_err e ON e.pattern = mp.pattern AND e.metre = mp.meter
       GROUP BY mp.conv_id, mp.turn),
msr AS (SELECT req.conv_id, req.turn, req.model, ms.meter_score FROM req LEFT JOIN ms USING (conv_id, turn))"""
_METER_SQL = REQ_PAIRS_CTE + ",\n" + _METER_PARTS


def _meter_scores(spark, sf):
    r = requests_with_outputs(spark, sf)
    return metre.meter_score(r, text_col="output", metre_col="meter", keys=("conv_id", "turn"), metres=list(METRE_CYCLE))


@register("meter_score", f"""
WITH RECURSIVE {_METER_SQL}
SELECT conv_id, turn, round(meter_score, 6) AS meter_score FROM msr""")
def q_meter_score(spark, sf):
    return _meter_scores(spark, sf).select("conv_id", "turn", F.round("meter_score", 6).alias("meter_score"))


@register("scorecard", f"""
WITH RECURSIVE {_REQ_LINES_SQL},
{_METER_PARTS}
SELECT rs.model, round(avg(rs.rhyme_score), 6) AS rhyme_score, round(avg(msr.meter_score), 6) AS meter_score,
       round(avg(CASE WHEN rs.n_all IN (4, 8) THEN 1.0 ELSE 0.0 END), 6) AS len_score,
       count(*) AS n_outputs
FROM rs LEFT JOIN msr USING (conv_id, turn) GROUP BY rs.model""")
def q_scorecard(spark, sf):
    """Per model: mean rhyme, metre and volume scores (semantic score: see
    ``soft_match_score``, which needs token vectors)."""
    rs = _rhyme_scores(spark, sf)
    ms = _meter_scores(spark, sf)
    j = rs.join(ms, ["conv_id", "turn"], "left")
    return j.groupBy("model").agg(
        F.round(F.avg("rhyme_score"), 6).alias("rhyme_score"),
        F.round(F.avg("meter_score"), 6).alias("meter_score"),
        F.round(F.avg(F.when(F.col("n_all").isin(4, 8), 1.0).otherwise(0.0)), 6).alias("len_score"),
        F.count(F.lit(1)).alias("n_outputs"))


@register("batch_metrics", f"""
WITH {REQ_PAIRS_CTE},
nb AS (SELECT conv_id, turn, output, rhyme_scheme,
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
def q_batch_metrics(spark, sf):
    """Partial sums per batch, final ratio: Spark's partial/final aggregate."""
    from cadenza.operators.scores import batch_metrics
    return batch_metrics(requests_with_outputs(spark, sf))


@register("scheme4", f"""
WITH {REQ_PAIRS_CTE},
nl AS (SELECT conv_id, turn, {filter_lines_sql('output')} AS ls FROM req WHERE len({filter_lines_sql('output')}) = 4),
ul AS (SELECT conv_id, turn, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM nl),
src AS (SELECT conv_id, turn, i, line, {last_word_sql('line')} AS lw FROM ul),
{clausula_ctes('src', 'conv_id, turn, i, line')},
k AS (SELECT nl.conv_id, nl.turn,
        coalesce(max(clausula) FILTER (WHERE i = 0), chr(1)) AS k0, coalesce(max(clausula) FILTER (WHERE i = 1), chr(2)) AS k1,
        coalesce(max(clausula) FILTER (WHERE i = 2), chr(3)) AS k2, coalesce(max(clausula) FILTER (WHERE i = 3), chr(4)) AS k3
      FROM nl LEFT JOIN cl USING (conv_id, turn) GROUP BY nl.conv_id, nl.turn),
f AS (SELECT conv_id, turn, k0 = k1 AS r01, k0 = k2 AS r02, k0 = k3 AS r03, k1 = k2 AS r12, k1 = k3 AS r13, k2 = k3 AS r23 FROM k)
SELECT conv_id, turn,
  CASE WHEN r01 AND r12 AND r23 THEN 'AAAA' WHEN r02 AND r13 THEN 'ABAB' WHEN r03 AND r12 THEN 'ABBA'
       WHEN r01 AND r23 THEN 'AABB' WHEN r01 AND r03 AND NOT r02 THEN 'AABA'
       WHEN r02 AND NOT r13 THEN 'A-A-' WHEN NOT r02 AND r13 THEN '-A-A' WHEN r12 AND NOT r01 AND NOT r23 THEN '-AA-'
       ELSE '----' END AS scheme,
  CAST(CASE WHEN r01 AND r12 AND r23 THEN 1.0 WHEN r02 AND r13 THEN 1.0 WHEN r03 AND r12 THEN 1.0
       WHEN r01 AND r23 THEN 1.0 WHEN r01 AND r03 AND NOT r02 THEN 1.0
       WHEN r02 AND NOT r13 THEN 0.75 WHEN NOT r02 AND r13 THEN 0.75 WHEN r12 AND NOT r01 AND NOT r23 THEN 0.75
       ELSE 0.5 END AS DOUBLE) AS factor
FROM f""")
def q_scheme4(spark, sf):
    """Scheme of the outputs that have exactly four lines."""
    r = requests_with_outputs(spark, sf).where(F.size(T.filter_lines("output")) == 4)
    r = r.select("conv_id", "turn", rhyme.line_keys(T.filter_lines("output")).alias("keys"))
    return rhyme.scheme4(r).select("conv_id", "turn", "scheme", "factor")


@register("rhyme_word_repeat", f"""
WITH {REQ_PAIRS_CTE},
ul AS (SELECT conv_id, turn, unnest({filter_lines_sql('output')}) AS line FROM req),
w AS (SELECT conv_id, turn, translate({last_word_sql('line')}, 'ё', 'е') AS lw FROM ul)
SELECT req.conv_id, req.turn, coalesce(count(DISTINCT w.lw) < count(w.lw), false) AS repeated
FROM req LEFT JOIN w USING (conv_id, turn) GROUP BY req.conv_id, req.turn""")
def q_rhyme_word_repeat(spark, sf):
    r = requests_with_outputs(spark, sf)
    return r.select("conv_id", "turn", rhyme.rhyme_word_repeat(T.filter_lines("output")).alias("repeated"))
