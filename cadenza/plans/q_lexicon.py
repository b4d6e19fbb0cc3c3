"""Lexicon queries: stress dictionary merge/conflicts/lookup, word lists,
edit-distance neighbours, cognate groups, unit vocabulary.

Lexicons are derived from the corpus tables: per-language word lists act as
the ranked stress sources (one stress rule per language), benchmark and user
turn words as the override feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import corpus, lexicon as L
from cadenza.operators.lookup import word_values
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import LINES_CTE, V, syllables_sql, vowels_sql, words_sql
from cadenza.sources.fixtures import documents, table

# Fixed values (ours): source priority per language, and the stress rule each
# language source applies ('first', 'last', 'penult' vowel).
LANG_SOURCES = [("en", 1, "first"), ("de", 2, "first"), ("fr", 3, "last"), ("es", 4, "penult")]
# Every other language, and text without one: last source, the default stress rule.
OTHER_SOURCE = 5


def _rule(rule: str, n):
    return {"first": F.lit(1), "last": n, "penult": F.greatest(n - 1, F.lit(1))}[rule]


def _rule_sql(rule: str, n: str) -> str:
    return {"first": "1", "last": n, "penult": f"greatest({n} - 1, 1)"}[rule]


def stress_sources(spark, sf):
    d = documents(spark, sf, "lang", "text")
    w = corpus.word_rows(d, "lang").distinct()
    w = w.withColumn("n", T.vowel_count("word")).where(F.col("n") > 0)
    lang_rank = None
    stress = None
    for lang, prio, rule in LANG_SOURCES:
        c = F.col("lang") == lang
        lang_rank = F.when(c, prio) if lang_rank is None else lang_rank.when(c, prio)
        stress = F.when(c, _rule(rule, F.col("n"))) if stress is None else stress.when(c, _rule(rule, F.col("n")))
    return w.select("word", stress.otherwise(T.default_stress("n")).cast("int").alias("stress"),
                    lang_rank.otherwise(OTHER_SOURCE).alias("priority")).distinct()


def stress_overrides(spark, sf):
    b = table(spark, sf, "benchmark", "text")
    c = table(spark, sf, "conversations", "role", "text").where(F.col("role") == "user")
    bw = corpus.word_rows(b).distinct() \
          .withColumn("n", T.vowel_count("word")).where(F.col("n") > 0) \
          .select("word", T.default_stress("n").alias("stress"), F.lit(1).alias("priority"))
    cw = corpus.word_rows(c).distinct() \
          .withColumn("n", T.vowel_count("word")).where(F.col("n") > 0) \
          .select("word", F.col("n").cast("int").alias("stress"), F.lit(2).alias("priority"))
    return bw.unionByName(cw)


_SRC_CASE_PRIO = " ".join(f"WHEN lang = '{l}' THEN {p}" for l, p, _ in LANG_SOURCES)
_SRC_CASE_STRESS = " ".join(f"WHEN lang = '{l}' THEN {_rule_sql(r, 'n')}" for l, _, r in LANG_SOURCES)
_DICT_SQL = f"""src0 AS (SELECT DISTINCT lang, unnest({words_sql('text')}) AS word FROM documents),
src AS (SELECT word, CAST(CASE {_SRC_CASE_STRESS} ELSE (n + 1) // 2 END AS INTEGER) AS stress,
               CASE {_SRC_CASE_PRIO} ELSE {OTHER_SOURCE} END AS priority
        FROM (SELECT *, {vowels_sql('word')} AS n FROM src0) WHERE n > 0),
ovb AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark),
ovc AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM conversations WHERE role = 'user'),
ovr AS (SELECT word, CAST(({vowels_sql('word')} + 1) // 2 AS INTEGER) AS stress, 1 AS priority FROM ovb WHERE {vowels_sql('word')} > 0
        UNION ALL
        SELECT word, CAST({vowels_sql('word')} AS INTEGER), 2 FROM ovc WHERE {vowels_sql('word')} > 0),
u AS (SELECT word, stress, 0 AS tier, priority FROM ovr UNION ALL SELECT word, stress, 1, priority FROM src),
dict AS (SELECT word, b.stress AS stress,
           CASE WHEN b.tier = 0 THEN 'override' ELSE 'source' || CAST(b.priority AS VARCHAR) END AS origin
         FROM (SELECT word, min(struct_pack(tier := tier, priority := priority, stress := stress)) AS b FROM u GROUP BY word))"""


@register("dictionary_merge", f"""
WITH {_DICT_SQL}
SELECT word, stress, origin FROM dict""")
def q_dictionary_merge(spark, sf):
    return L.merge_stress_sources(stress_sources(spark, sf), stress_overrides(spark, sf))


@register("dictionary_conflicts", f"""
WITH {_DICT_SQL}
SELECT word, count(DISTINCT stress) AS n_stresses,
       array_to_string(list_sort(list_distinct(list(CAST(stress AS VARCHAR)))), ',') AS stresses
FROM ovr GROUP BY word HAVING count(DISTINCT stress) > 1""")
def q_dictionary_conflicts(spark, sf):
    return L.stress_conflicts(stress_overrides(spark, sf))


@register("stress_lookup", f"""
WITH {_DICT_SQL}, {LINES_CTE},
tok AS (SELECT doc_id, line_no, unnest(range(len(ws))) AS word_pos, unnest(ws) AS word
        FROM (SELECT doc_id, line_no, {words_sql('text')} AS ws FROM lines))
SELECT t.doc_id, t.line_no, t.word_pos, t.word,
  CASE WHEN {vowels_sql('t.word')} = 0 THEN NULL ELSE CAST(coalesce(d.stress, ({vowels_sql('t.word')} + 1) // 2) AS INTEGER) END AS stress,
  CASE WHEN {vowels_sql('t.word')} = 0 THEN NULL ELSE coalesce(d.origin, 'default') END AS origin
FROM tok t LEFT JOIN dict d USING (word)""")
def q_stress_lookup(spark, sf):
    dic = L.merge_stress_sources(stress_sources(spark, sf), stress_overrides(spark, sf))
    toks = corpus.words(corpus.lines(documents(spark, sf))).select("doc_id", "line_no", "word_pos", "word")
    return L.stress_lookup(toks, dic).select("doc_id", "line_no", "word_pos", "word", "stress", "origin")


@register("word_union", f"""
SELECT DISTINCT word FROM (
  SELECT unnest({words_sql('text')}) AS word FROM documents
  UNION ALL SELECT unnest({words_sql('text')}) FROM benchmark
  UNION ALL SELECT unnest({words_sql('text')}) FROM conversations)""")
def q_word_union(spark, sf):
    parts = [documents(spark, sf), table(spark, sf, "benchmark", "text"), table(spark, sf, "conversations", "text")]
    u = None
    for p in parts:
        w = p.select(F.explode(T.words("text")).alias("word"))
        u = w if u is None else u.unionByName(w)
    return u.distinct()


def edit1_sql(a: str, b: str) -> str:
    """Character-level edit distance if at most 1, else NULL (DuckDB's
    ``levenshtein`` counts bytes, the reference counts characters)."""
    def dele(x, y):
        return (f"list_bool_or(list_transform(range(1, length({x}) + 1), "
                f"lambda i: substr({x}, 1, i - 1) || substr({x}, i + 1) = {y}))")
    return (f"CASE WHEN {a} = {b} THEN 0 "
            f"WHEN length({a}) = length({b}) AND len(list_filter(range(1, length({a}) + 1), "
            f"lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) = 1 THEN 1 "
            f"WHEN length({a}) = length({b}) + 1 AND {dele(a, b)} THEN 1 "
            f"WHEN length({b}) = length({a}) + 1 AND {dele(b, a)} THEN 1 END")


def _query_words(spark, sf):
    return table(spark, sf, "benchmark", "text").select(F.explode(T.words("text")).alias("word")).distinct()


def _vocab(spark, sf):
    return documents(spark, sf).select(F.explode(T.words("text")).alias("word")).distinct()


@register("nearest_words", f"""
WITH q AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark),
v AS (SELECT DISTINCT unnest({words_sql('text')}) AS other FROM documents),
c0 AS (SELECT word, other, {edit1_sql('word', 'other')} AS dist FROM q JOIN v
      ON length(other) BETWEEN length(word) - 1 AND length(word) + 1),
c AS (SELECT * FROM c0 WHERE dist IS NOT NULL)
SELECT word, other, CAST(dist AS INTEGER) AS dist, round(1 - dist / length(word), 6) AS score,
       CAST(row_number() OVER (PARTITION BY word ORDER BY round(1 - dist / length(word), 6) DESC, other) AS INTEGER) AS rank
FROM c QUALIFY rank <= 5""")
def q_nearest_words(spark, sf):
    """Brute-force oracle: every length-compatible pair; Spark: exact
    deletion-neighbourhood equi-join."""
    return L.nearest_words(_query_words(spark, sf), _vocab(spark, sf), n=5).select(
        "word", "other", F.col("dist").cast("int"), "score", F.col("rank").cast("int"))


_DEL_SQL = "list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))"


@register("cognate_groups", f"""
WITH v AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents),
v5 AS (SELECT word FROM v WHERE length(word) >= 5),
vv AS (SELECT word, unnest({_DEL_SQL}) AS d FROM v5),
e0 AS (SELECT DISTINCT a.word AS a, b.word AS b FROM vv a JOIN vv b USING (d) WHERE a.word <> b.word),
e AS (SELECT a, b FROM e0 WHERE ({edit1_sql('a', 'b')}) IS NOT NULL),
seeds AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark),
s5 AS (SELECT word FROM seeds WHERE length(word) >= 5),
h0 AS (SELECT word, word AS member, 0 AS hops FROM s5),
h1 AS (SELECT DISTINCT h.word, e.b AS member FROM h0 h JOIN e ON e.a = h.member),
h2 AS (SELECT DISTINCT h.word, e.b AS member FROM h1 h JOIN e ON e.a = h.member),
h3 AS (SELECT DISTINCT h.word, e.b AS member FROM h2 h JOIN e ON e.a = h.member),
allh AS (SELECT word, member, 0 AS hops FROM h0 UNION ALL SELECT word, member, 1 FROM h1
         UNION ALL SELECT word, member, 2 FROM h2 UNION ALL SELECT word, member, 3 FROM h3)
SELECT word, member, min(hops) AS hops FROM allh GROUP BY word, member""")
def q_cognate_groups(spark, sf):
    """Nodes within 3 undirected hops over one-edit links between corpus words
    of at least 5 letters, for every benchmark word (the seed itself at 0)."""
    v5 = _vocab(spark, sf).where(F.length("word") >= 5)
    # one direction per pair (ego_groups makes edges undirected); the filter
    # is pushed into the variant join
    edges = L.edit_neighbours(v5, v5).where(F.col("word") < F.col("other"))
    seeds = _query_words(spark, sf).where(F.length("word") >= 5)
    g = L.ego_groups(seeds, edges, 3)
    return g.groupBy("word", "member").agg(F.min("hops").alias("hops"))


def _units(df, col="text"):
    """The units of every distinct word; the readers ask for distinct units only."""
    w = corpus.word_rows(df, text_col=col).distinct()
    return corpus.settled(w.select(T.syllables("word").alias("us"))).select(F.explode("us").alias("unit"))


@register("vocab_build", f"""
WITH pu AS (SELECT DISTINCT unnest({syllables_sql('w')}) AS unit
            FROM (SELECT unnest({words_sql('text')}) AS w FROM documents)),
pr AS (SELECT DISTINCT unnest({syllables_sql('w')}) AS unit
       FROM (SELECT unnest({words_sql('text')}) AS w FROM conversations)),
extra AS (SELECT unit FROM pr WHERE unit NOT IN (SELECT unit FROM pu)),
ch AS (SELECT DISTINCT '##' || unnest(string_split(unit, '')) AS unit FROM extra),
units AS (SELECT unit FROM pu UNION SELECT unit FROM ch),
specials(unit, id) AS (VALUES {', '.join(f"('{u}', {i})" for i, u in enumerate(L.SPECIAL_UNITS))})
SELECT unit, CAST(id AS BIGINT) AS id FROM specials
UNION ALL
SELECT unit, CAST(row_number() OVER (ORDER BY unit) + 5 AS BIGINT) AS id FROM units
WHERE unit NOT IN (SELECT unit FROM specials)""")
def q_vocab_build(spark, sf):
    """Syllable units of the poems, plus ``##c`` characters of prose units
    (user/assistant turns) that the poems lack; ids in unit order after 6
    special units."""
    return L.vocab_build(_units(documents(spark, sf)),
                         _units(table(spark, sf, "conversations", "text")))


_VOCAB_UNITS_SQL = f"""pu AS (SELECT DISTINCT unnest({syllables_sql('w')}) AS unit
            FROM (SELECT unnest({words_sql('text')}) AS w FROM documents)),
pr AS (SELECT DISTINCT unnest({syllables_sql('w')}) AS unit
       FROM (SELECT unnest({words_sql('text')}) AS w FROM conversations)),
extra AS (SELECT unit FROM pr WHERE unit NOT IN (SELECT unit FROM pu)),
ch AS (SELECT DISTINCT '##' || unnest(string_split(unit, '')) AS unit FROM extra),
units AS (SELECT unit FROM pu UNION SELECT unit FROM ch),
specials(unit, id) AS (VALUES {', '.join(f"('{u}', {i})" for i, u in enumerate(L.SPECIAL_UNITS))}),
vocab AS (SELECT unit, CAST(id AS BIGINT) AS id FROM specials
          UNION ALL
          SELECT unit, CAST(row_number() OVER (ORDER BY unit) + 5 AS BIGINT) FROM units
          WHERE unit NOT IN (SELECT unit FROM specials))"""


@register("subword_units", f"""
WITH {_VOCAB_UNITS_SQL},
pu_all AS (SELECT DISTINCT unit FROM pu)
SELECT pr.unit, CASE WHEN p.unit IS NOT NULL THEN pr.unit ELSE
  array_to_string(list_transform(list_reverse(string_split(pr.unit, '')), lambda c: '##' || c), ' ') END AS encoded
FROM pr LEFT JOIN pu_all p ON p.unit = pr.unit""")
def q_subword_units(spark, sf):
    """Prose units (syllables of conversation turns): the whole unit when the
    poem vocabulary has it, else its characters reversed as ``##c``."""
    poem = _units(documents(spark, sf)).distinct()
    prose = _units(table(spark, sf, "conversations", "text")).distinct()
    j = prose.join(poem.withColumn("_in", F.lit(True)), "unit", "left")
    enc = F.array_join(F.transform(F.reverse(F.filter(F.split("unit", ""), lambda c: c != "")),
                                   lambda c: F.concat(F.lit("##"), c)), " ")
    return j.select("unit", F.when(F.col("_in"), F.col("unit")).otherwise(enc).alias("encoded"))


BLOCK = 32


@register("token_blocks", f"""
WITH {_VOCAB_UNITS_SQL},
du AS (SELECT doc_id, flatten(list_transform({words_sql('text')}, lambda w: {syllables_sql('w')})) AS us FROM documents),
pos AS (SELECT doc_id, unnest(range(len(us))) AS p, unnest(us) AS unit FROM du),
ids AS (SELECT pos.doc_id, pos.p, v.id FROM pos JOIN vocab v USING (unit))
SELECT doc_id, CAST(p // {BLOCK} AS BIGINT) AS block_no,
       array_to_string(list_concat(list(id ORDER BY p), list_transform(range({BLOCK} - count(*)), lambda x: 0)), ',') AS ids
FROM ids GROUP BY doc_id, p // {BLOCK}""")
def q_token_blocks(spark, sf):
    """Each document's unit ids (vocabulary join) cut into blocks of 32,
    right-padded with 0."""
    docs = documents(spark, sf)
    vocab = L.vocab_build(_units(docs), _units(table(spark, sf, "conversations", "text")))
    def ids(words):
        return words.join(L.word_units(words, vocab), "word").select("word", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("value"))
    texts = corpus.settled(docs.select("doc_id", T.words("text").alias("ws")))
    # documents of one id become one: by position, then by the ids as numbers
    g = word_values(texts, ["doc_id"], ids, order=lambda v: F.split(v, ",").cast("array<bigint>"))
    g = corpus.settled(g.select("doc_id", F.split("vals", "[|,]").alias("ids")))
    last = F.floor((F.size("ids") - 1) / BLOCK)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda b: F.slice("ids", (b * BLOCK + 1).cast("int"), BLOCK))
    g = g.select("doc_id", F.posexplode(cut).alias("block_no", "b"))
    pad = F.array_repeat(F.lit("0"), F.lit(BLOCK) - F.size("b"))
    return g.select("doc_id", F.col("block_no").cast("long").alias("block_no"), F.array_join(F.concat("b", pad), ",").alias("ids"))
