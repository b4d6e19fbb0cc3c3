"""Stress chain queries: restored spellings, respellings, prefixes, the whole chain, collocations.

The dictionary is the ``benchmark`` vocabulary with default stresses; words of ``documents`` that it
lacks go down the chain.  Collocations are the n-grams of ``benchmark`` lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import chain as C, corpus
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import FOLD_FROM, FOLD_TO, LINES_CTE, verse_lines_sql, vowels_sql, words_sql
from cadenza.sources.fixtures import documents, table

_L = C.LATIN_CHAIN


def _words(df):
    return df.select(F.explode(T.words("text")).alias("word")).distinct()


def _dictionary(spark, sf):
    w = _words(table(spark, sf, "benchmark", "text")).withColumn("n", T.vowel_count("word")).where("n > 0")
    return w.select("word", T.default_stress("n").alias("stress"))


@register("yo_restore", f"""
WITH v AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents),
t AS (SELECT translate(word, '{FOLD_FROM}', '{FOLD_TO}') AS plain, count(*) AS n, min(word) AS restored FROM v GROUP BY plain),
c AS (SELECT DISTINCT translate(unnest({words_sql('text')}), '{FOLD_FROM}', '{FOLD_TO}') AS word FROM conversations)
SELECT c.word, coalesce(t.restored, c.word) AS restored FROM c LEFT JOIN t ON t.plain = c.word AND t.n = 1 AND t.restored <> t.plain""")
def q_yo_restore(spark, sf):
    """Words of conversations without their accents: restored where only one corpus word fits."""
    folded = F.translate("word", FOLD_FROM, FOLD_TO)
    plain = _words(table(spark, sf, "conversations", "text")).select(folded.alias("word")).distinct()
    return C.yo_restore(plain, C.restore_table(_words(documents(spark, sf)), folded))


def _candidate_sql() -> str:
    rows, k = [], 0

    def add(cond, kind, rule, spelling, more="0"):
        nonlocal k
        rows.append(f"SELECT word, {k} AS ord, '{kind}' AS kind, '{rule}' AS rule, {spelling} AS spelling, {more} AS add FROM missing WHERE {cond}")
        k += 1
    for a, b in _L.respellings:
        add(f"contains(word, '{a}')", "respelling", f"{a}>{b}", f"replace(word, '{a}', '{b}')")
    for a, b in _L.endings:
        add(f"ends_with(word, '{a}')", "ending", f"{a}>{b}", f"left(word, length(word) - {len(a)}) || '{b}'")
    add(f"regexp_matches(word, '[{_L.silent_end[1]}]{_L.silent_end[0]}$')", "silent", _L.silent_end[0], "left(word, length(word) - 1)")
    first = "list_filter(range(2, length(word) + 1), lambda i: substr(word, i, 1) = substr(word, i - 1, 1))[1]"
    add(f"{first} IS NOT NULL", "doubled", "xx>x", f"array_to_string(list_transform(range(1, length(word) + 1), lambda j: CASE WHEN j > 1 AND "
        f"substr(word, j, 1) = substr(word, ({first})::INT, 1) AND substr(word, j - 1, 1) = substr(word, j, 1) THEN '' ELSE substr(word, j, 1) END), '')")
    before = f"left(word, (strpos(word, '{_L.fixed}') - 1)::INT)"
    add(f"contains(word, '{_L.fixed}')", "fixed", _L.fixed, "NULL", f"{vowels_sql(before)} + 1")
    for p in _L.prefixes:
        add(f"starts_with(word, '{p}') AND length(word) > {len(p) + 2}", "prefix", p, f"substr(word, {len(p) + 1})", vowels_sql(f"'{p}'"))
    add(f"contains(word, '{_L.sign[0]}')", "sign", f"{_L.sign[0]}>{_L.sign[1]}", f"replace(word, '{_L.sign[0]}', '{_L.sign[1]}')")
    return " UNION ALL ".join(rows)


_CHAIN_SQL = f"""dic AS MATERIALIZED (SELECT word, ({vowels_sql('word')} + 1) // 2 AS stress FROM (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark) WHERE {vowels_sql('word')} > 0),
v AS MATERIALIZED (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents),
missing AS MATERIALIZED (SELECT word FROM v WHERE {vowels_sql('word')} > 1 AND word NOT IN (SELECT word FROM dic)),
cand AS MATERIALIZED ({_candidate_sql()}),
hit AS MATERIALIZED (SELECT c.word, c.ord, c.kind, c.rule, c.spelling, d.stress + c.add AS stress FROM cand c JOIN dic d ON d.word = c.spelling
        UNION ALL SELECT word, ord, kind, rule, spelling, add FROM cand WHERE spelling IS NULL),
best AS MATERIALIZED (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY word ORDER BY ord) = 1),
chain AS MATERIALIZED (SELECT v.word, CAST(CASE WHEN {vowels_sql('v.word')} = 0 THEN NULL ELSE coalesce(d.stress, b.stress, ({vowels_sql('v.word')} + 1) // 2) END AS INT) AS stress,
                 CASE WHEN {vowels_sql('v.word')} = 0 THEN NULL WHEN d.word IS NOT NULL THEN 'dictionary' ELSE coalesce(b.kind, 'default') END AS origin, b.rule, b.spelling
          FROM v LEFT JOIN dic d ON d.word = v.word LEFT JOIN best b ON b.word = v.word)"""


@register("stress_chain", f"WITH {_CHAIN_SQL} SELECT * FROM chain")
def q_stress_chain(spark, sf):
    """Every word of the corpus down the whole chain, with the origin of its stress."""
    return C.stress_chain(_words(documents(spark, sf)), _dictionary(spark, sf), _L)


@register("respelling_join", f"WITH {_CHAIN_SQL} SELECT word, spelling, rule, origin, stress FROM chain WHERE origin IN ('respelling', 'ending', 'silent', 'doubled', 'sign')")
def q_respelling_join(spark, sf):
    """Words that the dictionary knows under another spelling."""
    return q_stress_chain(spark, sf).where(F.col("origin").isin("respelling", "ending", "silent", "doubled", "sign")).select(
        "word", "spelling", "rule", "origin", "stress")


@register("prefix_join", f"WITH {_CHAIN_SQL} SELECT word, rule AS prefix, spelling AS rest, stress FROM chain WHERE origin = 'prefix'")
def q_prefix_join(spark, sf):
    """Words whose stress comes from what follows a productive prefix."""
    return q_stress_chain(spark, sf).where("origin = 'prefix'").select("word", F.col("rule").alias("prefix"), F.col("spelling").alias("rest"), "stress")


def collocations(spark, sf):
    """Pairs of neighbouring benchmark words that occur twice, and triples led by a word of one
    vowel.  The word with more vowels is stressed on its last one; an even pair has both variants."""
    b = table(spark, sf, "benchmark", "text").select(F.explode(T.verse_lines("text")).alias("line")).select(T.words("line").alias("w"))

    def grams(n):
        at = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return b.where(F.size("w") >= n).select(F.explode(F.transform(at, lambda i: F.slice("w", i, n))).alias("g")).groupBy("g").agg(F.count("*").alias("c"))

    def nv(i):
        return T.vowel_count(F.col("g")[i])
    two = grams(2).where("c >= 2").select("g", nv(0).alias("a"), nv(1).alias("b")).where("a + b > 0")
    two = two.select("g", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0), F.lit(1))).when(F.col("a") > F.col("b"), F.array(F.lit(0)))
                                    .otherwise(F.array(F.lit(1)))).alias("i"), "a", "b")
    two = two.select(F.array_join("g", " ").alias("words"), F.col("i").alias("ord"), F.col("i").alias("stressed_idx"), F.when(F.col("i") == 0, F.col("a")).otherwise(F.col("b")).alias("stress"))
    three = grams(3).select("g", *[nv(i).alias(f"n{i}") for i in range(3)]).where("n0 = 1")
    three = three.select("g", F.posexplode(F.array("n0", "n1", "n2")).alias("i", "stress")).where("stress > 0")
    three = three.select(F.array_join("g", " ").alias("words"), F.col("i").alias("ord"), F.col("i").alias("stressed_idx"), "stress")
    return two.unionByName(three)


@register("collocation_override", f"""
WITH RECURSIVE bl AS (SELECT {words_sql('line')} AS w FROM (SELECT unnest({verse_lines_sql('text')}) AS line FROM benchmark)),
g2 AS (SELECT w[i:i + 1] AS g FROM bl, unnest(range(1, len(w))) AS u(i)),
g3 AS (SELECT DISTINCT w[i:i + 2] AS g FROM bl, unnest(range(1, len(w) - 1)) AS u(i)),
p2 AS (SELECT g, {vowels_sql('g[1]')} AS a, {vowels_sql('g[2]')} AS b FROM g2 GROUP BY g HAVING count(*) >= 2),
c2 AS (SELECT array_to_string(g, ' ') AS words, i AS ord, i AS stressed_idx, CASE WHEN i = 0 THEN a ELSE b END AS stress
       FROM p2, unnest([0, 1]) AS u(i) WHERE a + b > 0 AND (a = b OR (a > b) = (i = 0))),
c3 AS (SELECT array_to_string(g, ' ') AS words, max(i) AS idx FROM (SELECT g, i, {vowels_sql('g[i + 1]')} AS n FROM g3, unnest([0, 1, 2]) AS u(i)
       WHERE {vowels_sql('g[1]')} = 1) WHERE n > 0 GROUP BY g),
{LINES_CTE},
lw AS MATERIALIZED (SELECT doc_id, line_no, {words_sql('text')} AS w FROM lines),
h3 AS (SELECT doc_id, line_no, i AS pos, 3 AS size, array_to_string(w[i + 1:i + 3], ' ') AS k FROM lw, unnest(range(0, len(w) - 2)) AS u(i)),
h2 AS (SELECT doc_id, line_no, i AS pos, 2 AS size, array_to_string(w[i + 1:i + 2], ' ') AS k FROM lw, unnest(range(0, len(w) - 1)) AS u(i)),
hit AS MATERIALIZED (SELECT doc_id, line_no, pos, size, k FROM h3 WHERE k IN (SELECT words FROM c3) UNION ALL SELECT doc_id, line_no, pos, size, k FROM h2 WHERE k IN (SELECT words FROM c2)),
per AS (SELECT doc_id, line_no, list(struct_pack(pos := pos, m := -size, k := k) ORDER BY pos, size DESC) AS h FROM hit GROUP BY ALL),
walk(doc_id, line_no, i, nxt, taken, h) AS (
  SELECT doc_id, line_no, 0, 0::BIGINT, false, h FROM per
  UNION ALL
  SELECT doc_id, line_no, i + 1, CASE WHEN h[i + 1].pos >= nxt THEN h[i + 1].pos - h[i + 1].m ELSE nxt END, h[i + 1].pos >= nxt, h FROM walk WHERE i < len(h)),
used AS (SELECT doc_id, line_no, h[i].pos AS pos, -h[i].m AS size, h[i].k AS k FROM walk WHERE taken)
SELECT doc_id, line_no, CAST(pos AS INT) AS pos, CAST(size AS INT) AS size, CAST(ord AS INT) AS ord, CAST(stressed_idx AS INT) AS stressed_idx, CAST(stress AS INT) AS stress
FROM used JOIN c2 ON size = 2 AND words = k
UNION ALL
SELECT doc_id, line_no, CAST(pos AS INT), CAST(size AS INT), CAST(idx AS INT), CAST(idx AS INT), CAST({vowels_sql('string_split(k, chr(32))[idx + 1]')} AS INT) FROM used JOIN c3 ON size = 3 AND words = k""")
def q_collocation_override(spark, sf):
    lines = corpus.lines(documents(spark, sf)).select("doc_id", "line_no", T.words("text").alias("words"))
    return C.collocation_override(lines, collocations(spark, sf))
