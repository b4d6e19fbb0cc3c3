"""Defect queries over the four-line stanzas of ``documents``: repetitions, poor rhymes, unequal lines, line
penalties, candidate ranks.

There is no tagger, so tags come from word lists and endings (``tagged``); stresses follow the
default rule, function words of one vowel stay unstressed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import align as A, corpus, defects as D, rhyme
from cadenza.plans.q_align import stress_options
from cadenza.plans.q_phonetics import _listed
from cadenza.plans.registry import ORACLE, register
from cadenza.plans.sqlbits import clausula_ctes, last_word_sql, verse_lines_sql, vowels_sql, words_sql
from cadenza.sources.fixtures import documents

# Ours: word lists and endings that stand in for a tagger on the Latin-script fixtures.
ADP = ["of", "in", "to", "de", "von", "zu", "sur", "en", "dans", "mit", "con"]
PRON = ["he", "it", "his", "er", "es", "il", "la", "se", "les", "ich", "lo"]
CONJ = ["and", "or", "und", "et", "ou", "y", "o"]
VERB_ENDS, ADV_ENDS, CONVERB_ENDS, LEMMA_ENDS = ["ing", "er", "en", "ar", "ed"], ["ly", "ment", "mente"], ["ing", "ant", "ando"], ["s", "es", "e", "n"]
VERB_RX, ADV_RX, CONVERB_RX, LEMMA_RX = (f"({'|'.join(e)})$" for e in (VERB_ENDS, ADV_ENDS, CONVERB_ENDS, LEMMA_ENDS))
CONSONANTS = "bcdfghjklmnpqrstvwxzçñß"
H = D.LATIN


def _ends_in(word, ends):
    return reduce(lambda a, b: a | b, [word.endswith(e) for e in ends])


def tagged(word, n):
    """A word's tags; ``n``, its vowels, is read several times: give a column or a lambda's field, as ``tagged_words`` does."""
    short = F.length(word) <= max(map(len, ADP + PRON + CONJ))       # longer words need not be looked for in the lists
    upos = (F.when(short & word.isin(*ADP), "ADP").when(short & word.isin(*PRON), "PRON").when(short & word.isin(*CONJ), "CCONJ")
            .when(_ends_in(word, VERB_ENDS), "VERB").when(_ends_in(word, ADV_ENDS), "ADV").otherwise("NOUN"))
    light = (n == 1) & word.isin(*ADP, *PRON, *CONJ)
    lemma = word
    for e in sorted(LEMMA_ENDS, key=len):       # the longest ending is asked first, as it begins first
        lemma = F.when(word.endswith(e), F.substring(word, F.lit(1), F.length(word) - len(e))).otherwise(lemma)
    return F.struct(word.alias("word"), lemma.alias("lemma"), upos.alias("upos"), _ends_in(word, CONVERB_ENDS).alias("converb"),
                    F.when((n == 0) | light, 0).otherwise(T.default_stress(n)).cast("int").alias("stress"), n.cast("int").alias("vowels"))


def tagged_words(words):
    """An array of words, tagged.  Lambdas share nothing, so the vowels of a word are counted in a step of their own."""
    counted = F.transform(words, lambda w: F.struct(w.alias("word"), T.vowel_count(w).alias("n")))
    return F.transform(counted, lambda x: tagged(x["word"], x["n"]))


def stanzas(spark, sf):
    """``doc_id, block, lines`` (tagged words), ``ends, scheme, counts`` of the four-line stanzas.  The lines are cut and
    tagged once; what a query does not read of the rest is not computed."""
    b = A.blocks(documents(spark, sf)).where(F.size("lines") == 4)
    x = corpus.settled(b.withColumn("lines", F.transform("lines", lambda l: tagged_words(T.words(l)))))
    keys = rhyme.word_keys(F.transform("lines", lambda l: F.element_at(l, -1)["word"]))
    x = rhyme.scheme4(x.withColumn("keys", keys)).drop("keys", "factor")
    counts = F.transform("lines", lambda l: F.aggregate(l, F.lit(0), lambda acc, w: acc + w["vowels"]))
    ends = F.transform("lines", lambda l: F.struct(F.element_at(l, -1)["word"].alias("word"), F.element_at(l, -1)["upos"].alias("upos")))
    return x.select("*", counts.alias("counts"), ends.alias("ends"))


def _list(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def _upos_sql(w: str) -> str:
    return (f"CASE WHEN {w} IN ({_list(ADP)}) THEN 'ADP' WHEN {w} IN ({_list(PRON)}) THEN 'PRON' WHEN {w} IN ({_list(CONJ)}) THEN 'CCONJ' "
            f"WHEN regexp_matches({w}, '{VERB_RX}') THEN 'VERB' WHEN regexp_matches({w}, '{ADV_RX}') THEN 'ADV' ELSE 'NOUN' END")


_STANZA = f"""sa AS (SELECT doc_id, {verse_lines_sql('text')} AS a FROM documents),
sl AS MATERIALIZED (SELECT doc_id, i // 4 AS block, i % 4 AS li, line FROM (SELECT doc_id, len(a) AS total, unnest(range(len(a))) AS i, unnest(a) AS line FROM sa) WHERE i < total // 4 * 4),
sw AS MATERIALIZED (SELECT doc_id, block, li, unnest(range(len(ws))) AS k, unnest(ws) AS word, len(ws) AS size FROM (SELECT doc_id, block, li, {words_sql('line')} AS ws FROM sl)),
tw AS MATERIALIZED (SELECT *, {_upos_sql('word')} AS upos, regexp_replace(word, '{LEMMA_RX}', '') AS lemma, regexp_matches(word, '{CONVERB_RX}') AS conv,
       {vowels_sql('word')} AS n, CASE WHEN {vowels_sql('word')} = 0 OR ({vowels_sql('word')} = 1 AND word IN ({_list(ADP + PRON + CONJ)})) THEN 0 ELSE ({vowels_sql('word')} + 1) // 2 END AS stress FROM sw),
le AS MATERIALIZED (SELECT doc_id, block, li, {last_word_sql('line')} AS word FROM sl),
{clausula_ctes('le', 'doc_id, block, li, word', 'word')},
rk AS MATERIALIZED (SELECT doc_id, block, list(clausula ORDER BY li) AS k, list(word ORDER BY li) AS ends FROM cl GROUP BY doc_id, block),
rf AS MATERIALIZED (SELECT *, coalesce(k[1] = k[2], false) AS r01, coalesce(k[1] = k[3], false) AS r02, coalesce(k[1] = k[4], false) AS r03, coalesce(k[2] = k[3], false) AS r12,
              coalesce(k[2] = k[4], false) AS r13, coalesce(k[3] = k[4], false) AS r23 FROM rk),
st AS MATERIALIZED (SELECT doc_id, block, ends, CASE {' '.join(f"WHEN {c} THEN '{s}'" for c, s, _ in A.SCHEMES)} END AS scheme FROM rf)"""

_REPEAT_SQL = f"""l1 AS MATERIALIZED (SELECT doc_id, block, li,
    count(*) FILTER (WHERE upos IN ({_list(D.CONTENT)})) > count(DISTINCT lemma) FILTER (WHERE upos IN ({_list(D.CONTENT)})) AS lemma,
    count(*) FILTER (WHERE upos IN ({_list(D.CONTENT + D.STRICT_CONTENT)})) > count(DISTINCT lemma) FILTER (WHERE upos IN ({_list(D.CONTENT + D.STRICT_CONTENT)})) AS strict_lemma,
    count(*) FILTER (WHERE length(word) >= 5) > count(DISTINCT upos || ':' || translate(word, '{H.fold[0]}', '{H.fold[1]}')) FILTER (WHERE length(word) >= 5) AS form,
    count(*) FILTER (WHERE upos = 'NOUN') > count(DISTINCT word) FILTER (WHERE upos = 'NOUN') AS noun,
    {' OR '.join(f"count(DISTINCT word) FILTER (WHERE word IN ({_list(t)})) = {len(t)}" for t in H.twins)} AS twin FROM tw GROUP BY ALL),
l2 AS MATERIALIZED (SELECT a.doc_id, a.block, bool_or(a.k + 1 = b.k) AS adjacent, bool_or(a.k + 2 = b.k AND m.word IN ({_list(H.between)}) AND a.word NOT IN ({_list(H.may_echo)})) AS echo
       FROM tw a JOIN tw b ON a.doc_id = b.doc_id AND a.block = b.block AND a.li = b.li AND a.word = b.word AND b.k - a.k IN (1, 2)
       JOIN tw m ON m.doc_id = a.doc_id AND m.block = a.block AND m.li = a.li AND m.k = a.k + 1 GROUP BY a.doc_id, a.block),
l3 AS MATERIALIZED (SELECT DISTINCT a.doc_id, a.block FROM tw a JOIN tw b ON a.doc_id = b.doc_id AND a.block = b.block AND a.li = b.li AND a.lemma = b.lemma
       WHERE a.upos = 'VERB' AND b.upos = 'VERB' AND a.conv AND NOT b.conv),
rp AS MATERIALIZED (SELECT st.doc_id, st.block, len(list_distinct(ends)) < len(ends) AS ending, bool_or(lemma) AS lemma, bool_or(strict_lemma) AS strict_lemma, bool_or(form) AS form,
       coalesce(any_value(adjacent), false) AS adjacent, coalesce(any_value(echo), false) AS echo, bool_or(noun) AS noun, bool_or(twin) AS twin, any_value(l3.doc_id) IS NOT NULL AS converb
       FROM st JOIN l1 USING (doc_id, block) LEFT JOIN l2 USING (doc_id, block) LEFT JOIN l3 USING (doc_id, block) GROUP BY st.doc_id, st.block, ends),
rr AS MATERIALIZED (SELECT *, ending OR lemma OR adjacent OR echo OR noun OR twin OR converb AS repeats FROM rp)"""


@register("repetition_flags", f"""
WITH {_STANZA}, {_REPEAT_SQL}
SELECT doc_id, CAST(block AS INT) AS block, ending, lemma, strict_lemma, form, adjacent, echo, noun, twin, converb, repeats, repeats OR strict_lemma OR form AS strictly FROM rr""")
def q_repetition_flags(spark, sf):
    x = corpus.settled(stanzas(spark, sf).select("doc_id", "block", "lines", F.transform("ends", lambda e: e["word"]).alias("ends")))
    x = corpus.settled(x.select("doc_id", "block", D.repetition(F.col("lines"), F.col("ends"), H).alias("f")))
    return x.select("doc_id", "block", "f.*", D.repeats(F.col("f")).alias("repeats"), D.repeats(F.col("f"), strict=True).alias("strictly"))


def _group_sql() -> str:
    out = []
    for g in H.groups:
        if g[0].startswith("~"):
            out.append("list_sum(list_transform(ends, lambda x: " + " + ".join(f"CASE WHEN regexp_matches(x, '^.+{e[1:]}$') THEN 1 ELSE 0 END" for e in g) + ")) > 1")
        else:
            out.append(f"len(list_intersect(ends, [{_list(g)}])) > 1")
    return " OR ".join(out)


_PAIR_VALUES = ", ".join(f"('{s}', {a}, {b})" for s, ps in D.SCHEME_PAIRS.items() for a, b in ps)
_POOR_SQL = f"""ba AS MATERIALIZED (SELECT {verse_lines_sql('text')} AS a FROM benchmark),
bl AS MATERIALIZED (SELECT DISTINCT {last_word_sql('a[i]')} AS word_a, {last_word_sql('a[i + 1]')} AS word_b FROM ba, unnest(range(1, len(a))) AS u(i)),
sp(scheme, a, b) AS (VALUES {_PAIR_VALUES}),
vp AS MATERIALIZED (SELECT DISTINCT doc_id, block FROM (SELECT doc_id, block, ends[a + 1] AS x, ends[b + 1] AS y FROM st JOIN sp USING (scheme))
       WHERE {_upos_sql('x')} = 'VERB' AND {_upos_sql('y')} = 'VERB'
         AND ({' OR '.join(f"(ends_with(x, '{e}') AND ends_with(y, '{e}'))" for e in H.verb_endings)} OR ends_with(x, y) OR ends_with(y, x))
         AND NOT EXISTS (SELECT 1 FROM bl WHERE word_a = x AND word_b = y AND word_a <> word_b)),
pf AS MATERIALIZED (SELECT doc_id, block, list_transform(ends, lambda x: translate(x, '{H.fold[0]}', '{H.fold[1]}')) AS w, ends FROM st),
pr AS MATERIALIZED (SELECT doc_id, block, len(list_distinct(w)) < 4 OR len(list_intersect(w, list_transform(w, lambda x: '{H.negation}' || x))) > 0 AS repeated,
       vp.doc_id IS NOT NULL AS verbs, {_group_sql()} AS grouped FROM pf LEFT JOIN vp USING (doc_id, block))"""


def _poor(x, spark, sf):
    return D.poor_rhyme(x, _listed(spark, sf), h=H)


@register("poor_rhyme", f"""
WITH {_STANZA}, {_POOR_SQL}
SELECT doc_id, CAST(block AS INT) AS block, repeated, verbs, grouped, repeated OR verbs OR grouped AS poor FROM pr""")
def q_poor_rhyme(spark, sf):
    return _poor(stanzas(spark, sf), spark, sf)


@register("syllable_defects", f"""
WITH {_STANZA},
ct AS (SELECT doc_id, block, list(n ORDER BY li) AS c FROM (SELECT doc_id, block, li, sum(n) AS n FROM tw GROUP BY ALL) GROUP BY ALL),
cd AS (SELECT doc_id, block, scheme, c, c[2] - c[1] AS d1, c[3] - c[1] AS d2, c[4] - c[1] AS d3, len(list_distinct(c)) AS kinds,
              list_max(c) - list_min(c) AS span, len(list_filter(c, lambda x: x = c[4])) AS same FROM ct JOIN st USING (doc_id, block))
SELECT doc_id, CAST(block AS INT) AS block, scheme, array_to_string(c, ',') AS counts, round(CASE WHEN kinds = 1 THEN 1.0
  WHEN scheme IN ('ABAB', 'A-A-', '-A-A') THEN CASE WHEN d2 = 0 AND d1 = d3 THEN 1 - 0.95 * abs(d2) WHEN d1 = 0 AND d2 = 0 THEN 1 - 0.90 * abs(d3) ELSE 0.5 END
  WHEN scheme IN ('ABBA', '-AA-') THEN CASE WHEN d3 = 0 AND d1 = d2 THEN 1 - 0.90 * abs(d1) ELSE 0.5 END
  WHEN kinds = 2 AND same = 2 THEN 1 - 0.85 * span WHEN kinds = 2 AND same = 1 THEN 1 - 0.80 * span ELSE 0.5 END::DOUBLE, 6) AS factor FROM cd""")
def q_syllable_defects(spark, sf):
    x = corpus.settled(stanzas(spark, sf).select("doc_id", "block", "scheme", "counts"))
    x = x.withColumn("factor", F.round(D.syllable_defects(F.col("counts"), F.col("scheme")), 6))
    return x.select("doc_id", "block", "scheme", F.array_join(x["counts"].cast("array<string>"), ",").alias("counts"), "factor")


_P = D.PENALTIES


@register("line_penalties", f"""
WITH {_STANZA},
jn AS (SELECT a.doc_id, a.block, a.li, count(*) FILTER (WHERE length(regexp_extract(a.word, '[{CONSONANTS}]*$')) + length(regexp_extract(b.word, '^[{CONSONANTS}]*')) > 5) AS cluster,
              count(*) FILTER (WHERE a.upos = 'ADP' AND a.stress > 0 AND b.upos = 'NOUN' AND b.stress > 0) AS adposition
       FROM tw a JOIN tw b ON a.doc_id = b.doc_id AND a.block = b.block AND a.li = b.li AND b.k = a.k + 1 GROUP BY ALL),
ag AS (SELECT doc_id, block, li, max(size) AS size, count(*) FILTER (WHERE stress > 0) AS stressed, sum(n) AS vowels,
              max(CASE WHEN k = 0 AND stress = 1 AND word = '{H.opening}' THEN 1 ELSE 0 END) AS opening,
              max(CASE WHEN k = size - 2 THEN upos END) AS up2, max(CASE WHEN k = size - 2 THEN stress END) AS s2, max(CASE WHEN k = size - 2 THEN n END) AS n2,
              max(CASE WHEN k = size - 1 THEN upos END) AS up1, max(CASE WHEN k = size - 1 THEN stress END) AS s1,
              array_to_string(list(CASE WHEN stress > 0 THEN repeat('0', stress - 1) || '1' || repeat('0', n - stress) ELSE repeat('0', n) END ORDER BY k), '') AS sig
       FROM tw GROUP BY doc_id, block, li),
fl AS (SELECT doc_id, CAST(block AS INT) AS block, CAST(li AS INT) AS line_no, CASE WHEN size >= 2 AND s1 = 0 AND s2 = 0 AND up2 = 'ADP' AND n2 > 0 AND up1 = 'PRON' THEN 1 ELSE 0 END AS weak_end,
              CASE WHEN stressed = 0 THEN 1 ELSE 0 END AS no_ending, CASE WHEN stressed = 0 THEN 1 ELSE 0 END AS no_stress, opening,
              CAST(coalesce(cluster, 0) AS INT) AS cluster, CAST(coalesce(adposition, 0) AS INT) AS adposition,
              CASE WHEN stressed = 1 AND (size > 2 OR (size = 2 AND up2 <> 'ADP')) AND vowels > 2 THEN 1 ELSE 0 END AS lonely,
              CASE WHEN ends_with(sig, '000') THEN 1 ELSE 0 END AS run
       FROM ag LEFT JOIN jn USING (doc_id, block, li))
SELECT *, round({' * '.join(f'pow({v}::DOUBLE, {k})' for k, v in _P.items())}, 9) AS factor FROM fl""")
def q_line_penalties(spark, sf):
    x = stanzas(spark, sf).select("doc_id", "block", F.posexplode("lines").alias("line_no", "l"))
    x = corpus.settled(x.select("doc_id", "block", "line_no", D.line_penalties(F.col("l"), CONSONANTS, H).alias("p")))
    return x.select("doc_id", "block", "line_no", *[F.col(f"p.{k}").alias(k) for k in _P], F.round("p.factor", 9).alias("factor"))


#: the alignment's own SQL, with the flags beside it
_RANK_SQL = (f"WITH {_STANZA}, {_REPEAT_SQL}, {_POOR_SQL}, al AS ({ORACLE['align_scores']})\n"
    "SELECT al.doc_id, al.block, al.scheme, rr.repeats, repeated OR verbs OR grouped AS poor,\n"
    "  CASE WHEN al.scheme <> '----' THEN round(al.score * CASE WHEN rr.repeats THEN 0.1 ELSE 1 END * CASE WHEN repeated OR verbs OR grouped THEN 0.1 ELSE 1 END\n"
    "    * CASE WHEN al.scheme <> 'ABAB' THEN 0.1 ELSE 1 END, 6) END AS short_rank,\n"
    "  CASE WHEN al.score >= 0.1 THEN round(al.score * CASE WHEN al.scheme = 'AAAA' THEN 0.5 ELSE 1 END * CASE WHEN rr.repeats THEN 0.5 ELSE 1 END\n"
    "    * CASE WHEN repeated OR verbs OR grouped THEN 0.5 ELSE 1 END, 6) END AS long_rank\n"
    "FROM al JOIN rr ON rr.doc_id = al.doc_id AND rr.block = al.block JOIN pr ON pr.doc_id = al.doc_id AND pr.block = al.block WHERE al.metre IS NOT NULL AND al.n_lines = 4")


@register("candidate_rank_score", _RANK_SQL)
def q_candidate_rank_score(spark, sf):
    """Aligned stanzas with their rank as short candidates (wanted scheme ABAB) and as parts of a long poem."""
    x = stanzas(spark, sf)
    # cut and tagged once for both readers: dealt by their keys, settled, so that neither makes a plan of its own of all below
    again = D.repeats(D.repetition(F.col("lines"), F.transform("ends", lambda e: e["word"]), H))
    x = corpus.settled(x.select("doc_id", "block", "ends", "scheme", again.alias("repeats")).repartition("doc_id", "block"))
    poems = A.blocks(documents(spark, sf)).where(F.size("lines") == 4)
    score = A.align_scores(poems, stress_options(spark, sf), paths=False).where("metre IS NOT NULL").select("doc_id", "block", "metre", "scheme", "score")
    flags = x.select("doc_id", "block", "repeats")
    j = score.join(flags, ["doc_id", "block"]).join(_poor(x, spark, sf).select("doc_id", "block", "poor"), ["doc_id", "block"])
    short = D.candidate_rank_score(F.col("score"), F.col("scheme"), F.col("repeats"), F.col("poor"), F.lit("ABAB"))
    long = D.long_rank_score(F.col("score"), F.col("scheme"), F.col("repeats"), F.col("poor"))
    return j.select("doc_id", "block", "scheme", "repeats", "poor", F.round(short, 6).alias("short_rank"), F.round(long, 6).alias("long_rank"))
