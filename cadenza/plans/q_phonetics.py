"""Phonetic queries: word and ending transcripts, listed, exact and fuzzy rhyme pairs in stanzas,
endings of the rhyme dictionary.  Stanzas are the four-line groups of ``documents``; the listed
rhymes are the last words of neighbouring ``benchmark`` lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import align, corpus, rhyme
from cadenza.operators import phonetics as P
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import FOLD_FROM, FOLD_TO, clausula_ctes, last_word_sql, verse_lines_sql, vowels_sql, words_sql
from cadenza.sources.fixtures import documents, table

LATIN = P.LATIN
_V, _C = LATIN.vowels, LATIN.consonants


def _seq_sql(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _single_sql(x: str) -> str:
    return _seq_sql(x, [(c * 2, c) for c in _C])


def _devoice_sql(x: str, last: bool) -> str:
    """Voiced letters before voiceless ones (and at the end), letter by letter."""
    voiced, less = "".join(LATIN.devoiced), "".join(LATIN.devoiced.values())
    end = f" OR i = length({x})" if last else ""
    return (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN strpos('{voiced}', substr({x}, i, 1)) > 0 AND "
            f"((i < length({x}) AND strpos('{LATIN.voiceless}', substr({x}, i + 1, 1)) > 0){end}) THEN translate(substr({x}, i, 1), '{voiced}', '{less}') ELSE substr({x}, i, 1) END), '')")


def _vocab_sql(table_name: str = "documents") -> str:
    return f"""v AS (SELECT DISTINCT word FROM (SELECT unnest({words_sql('text')}) AS word FROM {table_name}))"""


#: fd(word, stress, w): folded words; xw(word, stress, xword, clausula)
_XWORD_SQL = f"""fd AS (SELECT word, stress, translate(word, '{FOLD_FROM}', '{FOLD_TO}') AS w FROM ws),
pos AS (SELECT *, list_filter(range(1, length(w) + 1), lambda i: strpos('{_V}', substr(w, i, 1)) > 0)[stress] AS p FROM fd),
ph AS (SELECT word, stress, array_to_string(list_transform(range(1, length(w) + 1), lambda i: CASE
    WHEN i = p THEN '^' || translate(substr(w, i, 1), 'yœæ', 'iee')
    WHEN strpos('yeœæ', substr(w, i, 1)) > 0 AND i > 1 AND strpos('{_V}', substr(w, i - 1, 1)) = 0
      THEN CASE WHEN substr(w, i, 1) <> 'y' AND i = length(w) THEN 'e' ELSE 'i' END
    WHEN strpos('{_V}', substr(w, i, 1)) > 0 THEN translate(substr(w, i, 1), 'oœæ', 'aee')
    WHEN substr(w, i, 1) = 'g' AND i < length(w) AND strpos('pfkts', substr(w, i + 1, 1)) > 0 THEN 'k'
    WHEN i = length(w) THEN translate(substr(w, i, 1), 'dzgbv', 'tskpf') ELSE substr(w, i, 1) END), '') AS x FROM pos),
sg AS (SELECT word, stress, {_single_sql(_seq_sql('x', LATIN.word))} AS x FROM ph),
dv AS (SELECT word, stress, {_devoice_sql('x', False)} AS xword FROM sg),
xw AS (SELECT word, stress, xword, CASE WHEN strpos(xword, '^') = 0 THEN xword WHEN strpos(xword, '^') <> length(xword) - 1 THEN substr(xword, strpos(xword, '^'))
         WHEN strpos(xword, '^') = 1 THEN substr(xword, 2) ELSE substr(xword, strpos(xword, '^') - 1) END AS clausula FROM dv)"""

_DEFAULT = f"CASE WHEN {vowels_sql('word')} > 0 THEN ({vowels_sql('word')} + 1) // 2 END"


def _vocabulary(spark, sf):
    w = documents(spark, sf).select(F.explode(T.words("text")).alias("word")).distinct()
    return w.withColumn("stress", T.default_stress(T.vowel_count("word")))


@register("xword", f"""
WITH {_vocab_sql()}, ws AS (SELECT word, {_DEFAULT} AS stress FROM v), {_XWORD_SQL}
SELECT word, CAST(stress AS INT) AS stress, xword, clausula FROM xw""")
def q_xword(spark, sf):
    """Every word of the corpus: transcript with its stress mark, and its ending."""
    x = _vocabulary(spark, sf).withColumn("x", P.xword(F.col("word"), F.col("stress"), LATIN))
    return x.select("word", "stress", "x.xword", "x.clausula")


@register("phonetic_transcript", f"""
WITH {_vocab_sql()}, ws AS (SELECT word, {_DEFAULT} AS stress FROM v),
fd AS (SELECT word, translate(word, '{FOLD_FROM}', '{FOLD_TO}') AS w, stress FROM ws),
e AS (SELECT word, CASE WHEN stress IS NULL THEN w ELSE array_to_string(regexp_extract_all(w, '[{_V}][^{_V}]*')[stress:], '') END AS e FROM fd),
s AS (SELECT word, e, {_single_sql(_seq_sql('e', LATIN.pronounce))} AS x FROM e),
d AS (SELECT word, e, {_devoice_sql('x', True)} AS x FROM s)
SELECT word, e AS ending, regexp_extract(x, '^[^{_V}]*[{_V}]') || translate(substr(x, length(regexp_extract(x, '^[^{_V}]*[{_V}]')) + 1), 'oœæ', 'aee') AS transcript FROM d""")
def q_phonetic_transcript(spark, sf):
    """Every word of the corpus: its ending from the stressed vowel, and how that sounds."""
    w = F.translate("word", FOLD_FROM, FOLD_TO)
    segs = F.regexp_extract_all(w, F.lit(f"[{_V}][^{_V}]*"), 0)
    ending = F.when(F.col("stress").isNull(), w).otherwise(F.array_join(F.slice(segs, F.col("stress"), F.greatest(F.size(segs), F.lit(1))), ""))
    return _vocabulary(spark, sf).select("word", ending.alias("ending"), P.pronounce(ending, LATIN).alias("transcript"))


def _stanza_words(spark, sf):
    """``doc_id, block, line_no, word, stress, exact`` of the lines of four-line stanzas."""
    b = align.blocks(documents(spark, sf)).where(F.size("lines") == 4)
    b = corpus.settled(b.select("doc_id", "block", rhyme.line_ends("lines").alias("ws")))
    ends = F.zip_with("ws", rhyme.word_keys("ws"), lambda w, k: F.struct(w.alias("word"), T.default_stress(T.vowel_count(w)).alias("stress"), k.alias("exact")))
    b = corpus.settled(b.select("doc_id", "block", ends.alias("ends")))
    x = b.select("doc_id", "block", F.posexplode("ends").alias("line_no", "e")).select("doc_id", "block", "line_no", "e.*")
    return x.where("word <> '' AND stress IS NOT NULL")


def _listed(spark, sf):
    b = table(spark, sf, "benchmark", "text").select(T.verse_lines("text").alias("l"))
    b = b.select(F.explode(F.zip_with(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", F.lit(2), F.size("l")), lambda x, y: F.struct(
        rhyme.last_word(x).alias("word_a"), rhyme.last_word(y).alias("word_b")))).alias("p"))
    return b.select("p.*").where("word_a IS NOT NULL AND word_b IS NOT NULL AND word_a <> word_b").distinct()


def _rule_sql(a: str, b: str) -> str:
    """The clausula rules that can hold in this alphabet (no signs, no iotated vowels)."""
    def v(x): return f"strpos('{_V}', {x}) > 0"
    def c(x): return f"strpos('{_C}', {x}) > 0"
    def cy(x): return f"strpos('{_C}{LATIN.semivowel}', {x}) > 0"
    def e(x, i): return f"substr({x}, length({x}) - {i - 1}, 1)"       # i-th from the end
    def h(x, i): return f"left({x}, greatest(length({x}) - {i}, 0)::INT)"
    la, lb = f"length({a})", f"length({b})"
    return f"""(({la} > {lb} AND starts_with({a}, {b}) AND {c(e(a, 1))})
 OR ({la} = {lb} AND {la} >= 3 AND {h(a, 1)} = {h(b, 1)} AND {c(e(a, 2))} AND {v(e(a, 1))} AND {v(e(b, 1))})
 OR ({la} = 5 AND {lb} = 4 AND starts_with({a}, left({b}, 3)) AND {v(e(a, 2))} AND {e(a, 1)} = '{LATIN.semivowel}' AND {v(e(b, 1))})
 OR ({la} = 4 AND {lb} = 5 AND left({a}, 3) = left({b}, 3) AND {v(e(a, 1))} AND {v(e(b, 2))} AND {c(e(b, 1))})
 OR ({la} = {lb} AND {la} >= 4 AND {h(a, 2)} = {h(b, 2)} AND {v(e(a, 2))} AND {v(e(b, 2))} AND (({cy(e(a, 1))} AND {cy(e(b, 1))}) OR {e(a, 1)} = {e(b, 1)}))
 OR ({la} = 4 AND {lb} = 4 AND left({a}, 2) = '^e' AND left({b}, 2) = '^y' AND {c(f"substr({a}, 3, 1)")} AND substr({a}, 3, 1) = substr({b}, 3, 1) AND {v(e(a, 1))} AND {v(e(b, 1))}))"""


def _key_sql(x: str, pattern: str) -> str:
    rx = pattern.replace(":C:", _C).replace(":A:", _V) + "$"
    return f"CASE WHEN regexp_matches({x}, '{rx}') THEN regexp_extract({x}, '{rx}', 1) END"


def _pairs_sql(a: str, b: str) -> str:
    return " OR ".join(f"coalesce({_key_sql(f'{x}.xword', l)} = {_key_sql(f'{y}.xword', r)}, false)" for l, r in LATIN.pairs for x, y in ((a, b), (b, a)))


_STANZA_SQL = f"""arr AS (SELECT doc_id, {verse_lines_sql('text')} AS a FROM documents),
pl AS (SELECT doc_id, len(a) AS total, unnest(range(len(a))) AS i, unnest(a) AS line FROM arr),
sl AS (SELECT doc_id, i // 4 AS block, i % 4 AS line_no, {last_word_sql('line')} AS word FROM pl WHERE i < total // 4 * 4),
sw AS (SELECT *, ({vowels_sql('word')} + 1) // 2 AS stress FROM sl WHERE {vowels_sql('word')} > 0),
{clausula_ctes('sw', 'doc_id, block, line_no, word', 'word')},
ws AS (SELECT DISTINCT word, stress FROM sw), {_XWORD_SQL},
ln AS (SELECT cl.doc_id, cl.block, cl.line_no, cl.word, cl.clausula AS exact, x.xword, x.clausula FROM cl JOIN xw x ON x.word = cl.word),
ba AS (SELECT {verse_lines_sql('text')} AS a FROM benchmark),
bl AS (SELECT DISTINCT {last_word_sql('a[i]')} AS word_a, {last_word_sql('a[i + 1]')} AS word_b FROM ba, unnest(range(1, len(a))) AS u(i)),
listed AS (SELECT word_a, word_b FROM bl WHERE word_a <> word_b UNION SELECT word_b, word_a FROM bl WHERE word_a <> word_b),
rp AS (SELECT a.doc_id, a.block, a.line_no AS line_a, b.line_no AS line_b, a.word AS word_a, b.word AS word_b, l.word_a IS NOT NULL AS listed,
              CASE WHEN a.exact = b.exact THEN 'exact'
                   WHEN (length(a.clausula) >= 3 AND a.clausula = b.clausula) OR {_rule_sql('a.clausula', 'b.clausula')} OR {_rule_sql('b.clausula', 'a.clausula')}
                        OR {_pairs_sql('a', 'b')} THEN 'fuzzy' END AS kind
       FROM ln a JOIN ln b ON a.doc_id = b.doc_id AND a.block = b.block AND a.line_no < b.line_no
       LEFT JOIN listed l ON l.word_a = a.word AND l.word_b = b.word)"""


@register("fuzzy_rhyme_pairs", f"""
WITH {_STANZA_SQL}
SELECT doc_id, CAST(block AS INT) AS block, CAST(line_a AS INT) AS line_a, CAST(line_b AS INT) AS line_b, word_a, word_b, kind FROM rp WHERE kind IS NOT NULL""")
def q_fuzzy_rhyme_pairs(spark, sf):
    """Line pairs of every stanza that rhyme exactly or, failing that, loosely."""
    return P.rhyme_pairs(_stanza_words(spark, sf), p=LATIN)


@register("rhyme_override", f"""
WITH {_STANZA_SQL}
SELECT doc_id, CAST(block AS INT) AS block, CAST(line_a AS INT) AS line_a, CAST(line_b AS INT) AS line_b, word_a, word_b,
       CASE WHEN listed THEN 'listed' ELSE kind END AS kind FROM rp WHERE listed OR kind IS NOT NULL""")
def q_rhyme_override(spark, sf):
    """The same, where listed word pairs always rhyme."""
    return P.rhyme_pairs(_stanza_words(spark, sf), p=LATIN, listed=_listed(spark, sf))


def _keys_sql(word: str, stress: str) -> str:
    w = f"lower({word})"
    core = f"array_to_string(regexp_extract_all({w}, '[{_V}][^{_V}]*')[{stress}:], '')"
    marked = f"left({w}, (length({w}) - length({core}))::INT) || upper(left({core}, 1)) || substr({core}, 2)"
    return (f"list_filter(list_transform(range(2, length({w})), lambda n: right({marked}, n::INT)), "
            f"lambda e: left(e, 1) = upper(left({core}, 1)) OR substr(e, 2, 1) = upper(left({core}, 1)))")


_FOLDED = f"translate(word, '{FOLD_FROM}', '{FOLD_TO}')"


@register("rhyme_dictionary_keys", f"""
WITH ba AS (SELECT {verse_lines_sql('text')} AS a FROM benchmark),
bl AS (SELECT DISTINCT {last_word_sql('a[i]')} AS word_a, {last_word_sql('a[i + 1]')} AS word_b FROM ba, unnest(range(1, len(a))) AS u(i)),
listed AS (SELECT * FROM bl WHERE word_a <> word_b),
lw AS (SELECT word_a AS word FROM listed UNION SELECT word_b FROM listed),
lines AS (SELECT unnest({verse_lines_sql('text')}) AS line FROM documents),
dw AS (SELECT DISTINCT {last_word_sql('line')} AS word FROM lines),
allw AS (SELECT word FROM lw UNION SELECT word FROM dw WHERE word IS NOT NULL),
ks AS (SELECT word, unnest({_keys_sql(_FOLDED, f"(({vowels_sql('word')} + 1) // 2)")}) AS key FROM allw WHERE {vowels_sql('word')} > 0),
dict AS (SELECT DISTINCT a.key, b.key AS other FROM listed l JOIN ks a ON a.word = l.word_a JOIN ks b ON b.word = l.word_b)
SELECT k.word, count(DISTINCT k.key) AS n_keys, count(DISTINCT d.other) AS n_partners, max(k.key) AS last_key
FROM ks k JOIN dw ON dw.word = k.word LEFT JOIN dict d ON d.key = k.key GROUP BY k.word""")
def q_rhyme_dictionary_keys(spark, sf):
    """Rhyming words of all lines: their endings and the endings that the dictionary (the listed
    pairs' endings) names as partners of these."""
    def keys(df):
        folded = F.translate("word", FOLD_FROM, FOLD_TO)
        return df.select("word", F.explode(P.ending_keys(folded, T.default_stress(T.vowel_count("word")), LATIN)).alias("key"))
    listed = _listed(spark, sf)
    a = keys(listed.select(F.col("word_a").alias("word")).distinct()).withColumnRenamed("word", "word_a")
    b = keys(listed.select(F.col("word_b").alias("word")).distinct()).select(F.col("word").alias("word_b"), F.col("key").alias("other"))
    dic = listed.join(a, "word_a").join(b, "word_b").select("key", "other").distinct()
    words = documents(spark, sf).select(F.explode(T.verse_lines("text")).alias("line")).select(rhyme.last_word("line").alias("word")).where("word IS NOT NULL").distinct()
    x = keys(words).join(dic, "key", "left")
    return x.groupBy("word").agg(F.countDistinct("key").alias("n_keys"), F.countDistinct("other").alias("n_partners"), F.max("key").alias("last_key"))
