"""Alignment queries: best stress variants per line and ending, best metre and rhyme scheme per
poem, cyclic metre fit, similarity of the signatures of stress variants.

Poems are the verse lines of ``documents`` in groups of four (a rest of three is a couplet and a
single line); stress variants come from the lexicons of ``q_lexicon``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import align as A, lexicon as L
from cadenza.plans.q_lexicon import _DICT_SQL, stress_overrides, stress_sources
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import FOLD_FROM, FOLD_TO, V, verse_lines_sql, vowels_sql, words_sql
from cadenza.profiles import FEET
from cadenza.sources.fixtures import documents


def stress_options(spark, sf):
    src, over = stress_sources(spark, sf), stress_overrides(spark, sf)
    dic = L.merge_stress_sources(src, over)
    return A.variant_options(dic, src.unionByName(over))


_P1, _PM = math.log10(0.1), math.log10(0.95)
_FEET_VALUES = ", ".join(f"({i}, '{f}', {p})" for i, (_, f) in enumerate(FEET) for p in (0, 1))

_LINE_SQL = f"""arr AS MATERIALIZED (SELECT doc_id, {verse_lines_sql('text')} AS a FROM documents),
pl AS MATERIALIZED (SELECT doc_id, len(a) AS total, unnest(range(len(a))) AS i, unnest(a) AS line FROM arr),
line AS MATERIALIZED (SELECT doc_id, line, CASE WHEN i < total // 4 * 4 THEN i // 4 WHEN total % 4 = 3 AND i % 4 = 2 THEN total // 4 + 1 ELSE total // 4 END AS block,
                CASE WHEN i >= total // 4 * 4 AND total % 4 = 3 AND i % 4 = 2 THEN 0 ELSE i % 4 END AS li FROM pl),"""

#: options of the words of ``tok``
_OPTIONS_SQL = f"""listed AS MATERIALIZED (SELECT x.word, x.stress, {vowels_sql('x.word')} AS n, CASE WHEN x.stress = d.stress THEN 100 ELSE 99 END AS weight
           FROM (SELECT DISTINCT word, stress FROM u) x JOIN dict d ON d.word = x.word),
opt AS MATERIALIZED (SELECT word, n, stress AS s, weight FROM listed WHERE n > 1 AND stress BETWEEN 1 AND n
        UNION ALL SELECT word, {vowels_sql('word')}, ({vowels_sql('word')} + 1) // 2, 100 FROM (SELECT DISTINCT word FROM tok) WHERE {vowels_sql('word')} > 1 AND word NOT IN (SELECT word FROM dict)
        UNION ALL SELECT word, 0, 0, 100 FROM (SELECT DISTINCT word FROM tok) WHERE {vowels_sql('word')} = 0
        UNION ALL SELECT word, 1, 0, CASE WHEN length(word) <= 3 THEN 100 ELSE 70 END FROM (SELECT DISTINCT word FROM tok) WHERE {vowels_sql('word')} = 1
        UNION ALL SELECT word, 1, 1, CASE WHEN length(word) <= 3 THEN 95 ELSE 100 END FROM (SELECT DISTINCT word FROM tok) WHERE {vowels_sql('word')} = 1),
wo AS MATERIALIZED (SELECT word, n, any_value(n) || ':' || array_to_string(list(s || '/' || weight ORDER BY s), ',') AS o FROM opt GROUP BY word, n),"""

#: poems and their words with options; an independent walk over (state, last stressed word) per lattice
_POEM_SQL = f"""{_DICT_SQL},
{_LINE_SQL}
poem AS MATERIALIZED (SELECT doc_id, block, count(*) AS n_lines,
                bool_or(len(list_filter({words_sql('line')}, lambda w: {vowels_sql('w')} > 1)) >= 8) AS hard FROM line GROUP BY ALL),
tok AS MATERIALIZED (SELECT doc_id, block, li, unnest(range(len(ws))) AS k, unnest(ws) AS word FROM (
          SELECT doc_id, block, li, {words_sql('line')} AS ws FROM line JOIN poem USING (doc_id, block) WHERE NOT hard)),
{_OPTIONS_SQL}
ln AS MATERIALIZED (SELECT doc_id, block, li, array_to_string(list(o ORDER BY k), ' ') AS lattice, list(t.word ORDER BY k) AS ws, sum(n) AS n_syl
       FROM tok t JOIN wo USING (word) GROUP BY doc_id, block, li),
rep AS MATERIALIZED (SELECT lattice, min(struct_pack(d := doc_id, b := block, l := li)) AS r, any_value(len(ws)) AS size FROM ln GROUP BY lattice),
lw AS MATERIALIZED (SELECT lattice, size, t.k, t.word, wo.n, CAST(coalesce(sum(wo.n) OVER (PARTITION BY lattice ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
       FROM rep JOIN tok t ON t.doc_id = rep.r.d AND t.block = rep.r.b AND t.li = rep.r.l JOIN wo USING (word)),
modes(m, foot, p) AS (VALUES {_FEET_VALUES}),
want AS MATERIALIZED (SELECT m, p, list_transform(range(400), lambda i: CASE WHEN i < p THEN 0 ELSE CAST(substr(foot, CAST((i - p) % length(foot) + 1 AS INT), 1) AS INT) END) AS e FROM modes),
upto AS MATERIALIZED (SELECT m, p, e, list_transform(range(401), lambda i: coalesce(list_sum(e[1:i]), 0)) AS before FROM want),
loc AS MATERIALIZED (SELECT lattice, size, k, lw.n, o.s, a.m, a.p, log10(o.weight / 100)
               + CASE WHEN o.s > 0 AND a.e[lw.c + o.s] = 0 THEN {_P1!r} ELSE 0 END
               + (a.before[lw.c + lw.n + 1] - a.before[lw.c + 1] - CASE WHEN o.s > 0 THEN a.e[lw.c + o.s] ELSE 0 END) * {_PM!r} AS own
        FROM lw JOIN opt o USING (word) CROSS JOIN upto a),
walk(lattice, m, p, k, run, beat, tw, ts, score) AS (
  SELECT lattice, m, p, 0, 0, false, -1, 0, CAST(0 AS DOUBLE) FROM rep, modes
  UNION ALL
  SELECT lattice, m, p, k, run, beat, tw, ts, max(score) FROM (
    SELECT w.lattice, w.m, w.p, w.k + 1 AS k,
      CASE WHEN l.s > 0 THEN least(l.n - l.s, 4) ELSE least(w.run + l.n, 4) END AS run,
      CASE WHEN l.n = 0 THEN false ELSE l.s > 0 AND l.s = l.n END AS beat,
      CASE WHEN l.s > 0 THEN w.k ELSE w.tw END AS tw, CASE WHEN l.s > 0 THEN l.s ELSE w.ts END AS ts,
      w.score + l.own + CASE WHEN w.beat AND l.s = 1 THEN {_P1!r} ELSE 0 END
        + CASE WHEN w.run < 4 AND w.run + CASE WHEN l.s > 0 THEN l.s - 1 ELSE l.n END >= 4 THEN {_P1!r} ELSE 0 END
        + CASE WHEN l.s > 0 AND l.n - l.s >= 4 THEN {_P1!r} ELSE 0 END AS score
    FROM walk w JOIN loc l ON l.lattice = w.lattice AND l.k = w.k AND l.m = w.m AND l.p = w.p) x
  GROUP BY lattice, m, p, k, run, beat, tw, ts),
ended AS MATERIALIZED (SELECT w.lattice, w.m AS metre, w.p AS prefix, w.tw AS word, w.ts AS stress, round(max(w.score), 9) AS score
          FROM walk w JOIN rep r ON r.lattice = w.lattice AND w.k = r.size GROUP BY ALL),
lv0 AS MATERIALIZED (SELECT ln.*, e.metre, e.prefix, e.word, e.stress, e.score, ws[e.word + 1] AS tail, array_to_string(ws[e.word + 2:], '') AS rest
        FROM ln JOIN ended e USING (lattice)),
lv AS MATERIALIZED (SELECT * EXCLUDE (tail, rest), translate(CASE WHEN rest = '' AND length(core) = 1 AND length(tail) > 1 THEN substr(tail, length(tail) - 1, 1) ELSE '' END
              || core || rest, '{FOLD_FROM}', '{FOLD_TO}') AS ending
       FROM (SELECT *, array_to_string(regexp_extract_all(tail, '[{V}][^{V}]*')[stress:], '') AS core FROM lv0)),
kept AS MATERIALIZED (SELECT lv.*, n_lines FROM lv JOIN poem USING (doc_id, block) WHERE word >= 0
         QUALIFY n_lines <> 2 OR row_number() OVER (PARTITION BY doc_id, block, li, metre, prefix ORDER BY score DESC, word, stress) <= 2),
bt AS MATERIALIZED (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, block, li, metre, word, stress ORDER BY score DESC, prefix) = 1)"""


#: endings of whole four-line poems; lines of any length, so lattices have numbers and the feet are counted, not listed
_UPTO = "CASE WHEN {x} <= p THEN 0 ELSE ({x} - p) // length(foot) * length(replace(foot, '0', '')) + length(replace(substr(foot, 1, CAST(({x} - p) % length(foot) AS INT)), '0', '')) END"
_HIT = "CASE WHEN l.s > 0 THEN " + _UPTO.format(x="(l.c + l.s)") + " - " + _UPTO.format(x="(l.c + l.s - 1)") + " ELSE 0 END"
_TAIL_SQL = f"""{_DICT_SQL},
{_LINE_SQL}
poem AS MATERIALIZED (SELECT doc_id, block, count(*) AS n_lines FROM line GROUP BY ALL),
tok AS MATERIALIZED (SELECT doc_id, block, li, unnest(range(len(ws))) AS k, unnest(ws) AS word FROM (
          SELECT doc_id, block, li, {words_sql('line')} AS ws FROM line JOIN poem USING (doc_id, block) WHERE n_lines = 4)),
{_OPTIONS_SQL}
ln0 AS MATERIALIZED (SELECT doc_id, block, li, array_to_string(list(o ORDER BY k), ' ') AS lattice, list(t.word ORDER BY k) AS ws, sum(n) AS n_syl
       FROM tok t JOIN wo USING (word) GROUP BY doc_id, block, li),
rep AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT lattice, min(struct_pack(d := doc_id, b := block, l := li)) AS r, any_value(len(ws)) AS size FROM ln0 GROUP BY lattice)),
ln AS MATERIALIZED (SELECT ln0.* EXCLUDE (lattice), rep.id FROM ln0 JOIN rep USING (lattice)),
lw AS MATERIALIZED (SELECT id, t.k, t.word, wo.n, CAST(coalesce(sum(wo.n) OVER (PARTITION BY id ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
       FROM rep JOIN tok t ON t.doc_id = rep.r.d AND t.block = rep.r.b AND t.li = rep.r.l JOIN wo USING (word)),
lo AS MATERIALIZED (SELECT id, k, lw.n, c, o.s, log10(o.weight / 100) AS weight FROM lw JOIN opt o USING (word)),
modes(m, foot, p) AS (VALUES {_FEET_VALUES}),
walk(id, m, p, foot, k, run, beat, tw, ts, score) AS (
  SELECT id, m, p, foot, 0, 0, false, -1, 0, CAST(0 AS DOUBLE) FROM rep, modes
  UNION ALL
  SELECT id, m, p, foot, k, run, beat, tw, ts, max(score) FROM (
    SELECT id, m, p, foot, k + 1 AS k,
      CASE WHEN s > 0 THEN least(n - s, 4) ELSE least(run + n, 4) END AS run,
      CASE WHEN n = 0 THEN false ELSE s > 0 AND s = n END AS beat,
      CASE WHEN s > 0 THEN k ELSE tw END AS tw, CASE WHEN s > 0 THEN s ELSE ts END AS ts,
      score + weight + CASE WHEN s > 0 AND hit = 0 THEN {_P1!r} ELSE 0 END + (expected - hit) * {_PM!r}
        + CASE WHEN beat AND s = 1 THEN {_P1!r} ELSE 0 END
        + CASE WHEN run < 4 AND run + CASE WHEN s > 0 THEN s - 1 ELSE n END >= 4 THEN {_P1!r} ELSE 0 END
        + CASE WHEN s > 0 AND n - s >= 4 THEN {_P1!r} ELSE 0 END AS score
    FROM (SELECT w.*, l.n, l.s, l.weight, {_HIT} AS hit, {_UPTO.format(x="(l.c + l.n)")} - {_UPTO.format(x="l.c")} AS expected
          FROM walk w JOIN lo l ON l.id = w.id AND l.k = w.k) z) x
  GROUP BY id, m, p, foot, k, run, beat, tw, ts),
ended AS MATERIALIZED (SELECT w.id, w.m AS metre, w.p AS prefix, w.tw AS word, w.ts AS stress, round(max(w.score), 9) AS score
          FROM walk w JOIN rep r ON r.id = w.id AND w.k = r.size GROUP BY ALL),
bt AS MATERIALIZED (SELECT ln.*, e.metre, e.prefix, e.word, e.stress, e.score, ws[e.word + 1] AS tail, array_to_string(ws[e.word + 2:], '') AS rest
        FROM ln JOIN (SELECT * FROM ended WHERE word >= 0 QUALIFY row_number() OVER (PARTITION BY id, metre, word, stress ORDER BY score DESC, prefix) = 1) e USING (id))"""


@register("best_variant_per_tail", f"""
WITH RECURSIVE {_TAIL_SQL}
SELECT doc_id, CAST(block AS INT) AS block, CAST(li AS INT) AS line_no, metre, prefix, CAST(word AS INT) AS word, stress,
       translate(CASE WHEN rest = '' AND length(core) = 1 AND length(tail) > 1 THEN substr(tail, length(tail) - 1, 1) ELSE '' END
              || core || rest, '{FOLD_FROM}', '{FOLD_TO}') AS ending, CAST(n_syl AS INT) AS n_syl, round(score, 6) AS log_score
FROM (SELECT *, array_to_string(regexp_extract_all(tail, '[{V}][^{V}]*')[stress:], '') AS core FROM bt)""")
def q_best_variant_per_tail(spark, sf):
    """Every line of a four-line poem, however long: the best stress variant per metre and ending."""
    poems = A.blocks(documents(spark, sf))
    poems = poems.where(F.size("lines") == 4)
    v = A.best_variant_per_tail(poems, stress_options(spark, sf), paths=False)
    return v.select("doc_id", "block", "line_no", "metre", "prefix", "word", "stress", "ending", "n_syl", F.round("score", 6).alias("log_score"))


_L = [math.log10(x) for x in (0.1, 0.75, 0.5)]


@register("align_scores", f"""
WITH RECURSIVE {_POEM_SQL},
s1 AS (SELECT doc_id, block, metre, '' AS scheme, 1 AS rank, score FROM lv JOIN poem USING (doc_id, block) WHERE n_lines = 1 AND prefix = 0),
s2 AS (SELECT doc_id, block, metre, CASE WHEN a.ending = b.ending THEN 'AA' ELSE '--' END AS scheme, CASE WHEN a.ending = b.ending THEN 1 ELSE 0 END AS rank,
              round(a.score + b.score + CASE WHEN a.ending = b.ending THEN 0 ELSE {_L[1]!r} END, 9) AS score
       FROM bt a JOIN bt b USING (doc_id, block, metre) WHERE a.n_lines = 2 AND a.li = 0 AND b.li = 1),
c4 AS (SELECT doc_id, block, metre, a.score + b.score + c.score + d.score AS score,
              a.prefix + b.prefix + c.prefix + d.prefix AS px, [a.n_syl, b.n_syl, c.n_syl, d.n_syl] AS sz,
              a.ending = b.ending AS r01, a.ending = c.ending AS r02, a.ending = d.ending AS r03,
              b.ending = c.ending AS r12, b.ending = d.ending AS r13, c.ending = d.ending AS r23
       FROM bt a JOIN bt b USING (doc_id, block, metre) JOIN bt c USING (doc_id, block, metre) JOIN bt d USING (doc_id, block, metre)
       WHERE a.n_lines = 4 AND a.li = 0 AND b.li = 1 AND c.li = 2 AND d.li = 3),
r4 AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN {len(A.SCHEMES) - i}" for i, (c, _, _) in enumerate(A.SCHEMES))} END AS rank FROM c4),
s4 AS (SELECT doc_id, block, metre, {[s for _, s, _ in reversed(A.SCHEMES)]!r}[rank] AS scheme, rank,
              round(score + CASE WHEN px IN (1, 3) THEN {_L[0]!r} ELSE 0 END
                    + CASE WHEN len(list_distinct(sz)) > 2 OR (len(list_distinct(sz)) = 2 AND len(list_filter(sz, lambda x: x = sz[1])) <> 2) THEN {_L[0]!r} ELSE 0 END
                    + CASE WHEN rank = 1 THEN {_L[2]!r} WHEN rank <= 4 THEN {_L[1]!r} ELSE 0 END, 9) AS score FROM r4),
top AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s4)
        QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY score DESC, metre, rank DESC) = 1)
SELECT doc_id, CAST(block AS INT) AS block, CAST(n_lines AS INT) AS n_lines, {[n for n, _ in FEET]!r}[metre + 1] AS metre, scheme,
       round(t.score, 6) AS log_score, coalesce(round(pow(10.0::DOUBLE, t.score), 6), 0) AS score
FROM poem LEFT JOIN top t USING (doc_id, block)""")
def q_align_scores(spark, sf):
    """Every poem of one, two or four lines: best metre, rhyme scheme and score."""
    return A.align_scores(A.blocks(documents(spark, sf)), stress_options(spark, sf), paths=False)


def _cyclic_sql(foot: str) -> str:
    def fit(shift: int) -> str:
        want = f"CASE WHEN k <= {shift} THEN '0' ELSE substr('{foot}', CAST((k - 1 - {shift} + {len(foot)}) % {len(foot)} + 1 AS INT), 1) END"
        return (f"list_sum(list_transform(range(1, length(sig) + 1), lambda k: CASE WHEN {want} = '0' AND substr(sig, k, 1) = '1' THEN {math.log10(0.1)!r} "
                f"WHEN {want} = '1' AND substr(sig, k, 1) = '0' THEN {math.log10(0.9)!r} ELSE 0.0::DOUBLE END))")
    return fit(0) if foot[0] == "0" else f"CASE WHEN substr(sig, 1, 1) = '0' THEN greatest({fit(0)}, {fit(1)}) ELSE {fit(0)} END"


@register("cyclic_metre_fit", f"""
WITH l AS (SELECT doc_id, unnest({verse_lines_sql('text')}) AS line FROM documents),
sig AS (SELECT doc_id, array_to_string(list_transform({words_sql('line')}, lambda w: CASE WHEN {vowels_sql('w')} = 0 THEN '' ELSE
          repeat('0', ({vowels_sql('w')} + 1) // 2 - 1) || '1' || repeat('0', {vowels_sql('w')} - ({vowels_sql('w')} + 1) // 2) END), '') AS sig FROM l),
s AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS i, '{n}' AS metre, round(sum({_cyclic_sql(f)}), 6) AS log_score FROM sig WHERE sig <> '' GROUP BY doc_id" for i, (n, f) in enumerate(FEET))})
SELECT doc_id, metre, log_score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY log_score DESC, i) = 1""")
def q_cyclic_metre_fit(spark, sf):
    return A.cyclic_metre_fit(documents(spark, sf))
