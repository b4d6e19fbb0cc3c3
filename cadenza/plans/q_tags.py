"""Queries on tagged words and lexicons: homographs, lemmas, caps, keywords, optional stresses, schemes of marked texts,
suggestions, rewrites.  Tags come from the word lists of ``q_defects``; the lexicon is the ``benchmark`` vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import align as A, corpus, curate, rhyme, tags as G
from cadenza.plans.q_align import stress_options
from cadenza.plans.q_curate import _pairs
from cadenza.plans.q_defects import ADP, CONJ, LEMMA_RX, PRON, _list, _upos_sql, tagged, tagged_words
from cadenza.plans.q_lexicon import _DICT_SQL, stress_overrides, stress_sources
from cadenza.plans.registry import ORACLE, register
from cadenza.plans.sqlbits import (
    LINES_CTE, PAIRS_CTE, clausula_ctes, last_word_sql, shingle_jaccard_sql, syllables_sql, verse_lines_sql, vowels_sql, words_sql,
)
from cadenza.sources.fixtures import documents, table

CASES = ["Nom", "Gen", "Dat"]


def _tokens(spark, sf):
    t = corpus.settled(corpus.lines(documents(spark, sf)).select("doc_id", "line_no", T.words("text").alias("ws")))
    t = t.select("doc_id", "line_no", F.posexplode("ws").alias("pos", "word"))
    return t.withColumn("t", tagged(F.col("word"), T.vowel_count("word")))


_TOK = f"""{LINES_CTE},
tk AS MATERIALIZED (SELECT doc_id, line_no, CAST(pos AS INT) AS pos, word, {_upos_sql('word')} AS upos, regexp_replace(word, '{LEMMA_RX}', '') AS lemma, {vowels_sql('word')} AS n FROM (
  SELECT doc_id, line_no, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, line_no, {words_sql('text')} AS ws FROM lines)))"""


def _listed_stresses(spark, sf):
    """Words with several listed stresses: ``word, ord, stress`` in stress order."""
    both = stress_sources(spark, sf).select("word", "stress").unionByName(stress_overrides(spark, sf).select("word", "stress")).distinct()
    g = both.groupBy("word").agg(F.sort_array(F.collect_list("stress")).alias("s")).where(F.size("s") > 1)
    return g.select("word", F.posexplode("s").alias("ord", "stress"))


@register("omograph_by_tags", f"""
WITH {_DICT_SQL}, {_TOK},
st AS (SELECT word, stress, row_number() OVER (PARTITION BY word ORDER BY stress) - 1 AS ord, count(*) OVER (PARTITION BY word) AS c FROM (SELECT DISTINCT word, stress FROM u)),
ts AS (SELECT word, ord, stress, no, tags FROM (SELECT * FROM st WHERE c > 1) s,
       (SELECT 0 AS par, i AS no, ['NOUN', 'Case=' || ['Nom', 'Gen', 'Ins', 'Acc', 'Dat', 'Loc'][i + 1]] AS tags FROM unnest(range(6)) AS x(i)
        UNION ALL SELECT 1, 0, ['VERB', 'Case=Gen'] UNION ALL SELECT 1, 1, ['ADV']) t WHERE par = ord % 2),
sc AS (SELECT k.doc_id, k.line_no, k.pos, k.word, s.stress, s.ord, s.no,
              len(list_intersect(s.tags, [k.upos, 'Case=' || ['Nom', 'Gen', 'Dat'][k.pos % 3 + 1]])) AS nb
       FROM tk k JOIN ts s ON s.word = k.word)
SELECT doc_id, line_no, pos, word, CASE WHEN nb > 0 THEN stress END AS stress FROM sc
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, pos ORDER BY nb DESC, ord, no) = 1""")
def q_omograph_by_tags(spark, sf):
    """Every token that has several listed stresses: the one whose tags fit best (nouns of every case, or genitive
    verbs and adverbs, in turn; a token's case goes by its place)."""
    omo = _listed_stresses(spark, sf).withColumn("tagsets", F.when(F.col("ord") % 2 == 0, F.array(F.lit("NOUN|Case=Every"))).otherwise(F.array(F.lit("VERB|Case=Gen"), F.lit("ADV"))))
    case = F.concat(F.lit("Case="), F.get(F.array(*[F.lit(c) for c in CASES]), F.col("pos") % 3))
    t = _tokens(spark, sf).select("doc_id", "line_no", "pos", "word", F.array(F.col("t.upos"), case).alias("tags"))
    return G.omograph_by_tags(t, omo).select("doc_id", "line_no", "pos", "word", "stress")


def _lexicon(spark, sf):
    """``form, lemma, pos, ord`` of the benchmark vocabulary: the tagged lemma, then the form itself."""
    w = table(spark, sf, "benchmark", "text").select(F.explode(T.words("text")).alias("form")).distinct()
    w = w.withColumn("t", tagged(F.col("form"), T.vowel_count("form")))
    return w.select("form", F.posexplode(F.array(F.col("t.lemma"), F.col("form"))).alias("ord", "lemma"), F.col("t.upos").alias("pos"))


_LEX = f"""bw AS (SELECT DISTINCT unnest({words_sql('text')}) AS form FROM benchmark),
lex AS (SELECT form, i AS ord, CASE WHEN i = 0 THEN regexp_replace(form, '{LEMMA_RX}', '') ELSE form END AS lemma, {_upos_sql('form')} AS pos FROM bw, unnest([0, 1]) AS x(i))"""


@register("lemma_lookup", f"""
WITH {_LEX}, w AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents),
f AS (SELECT form, lemma, pos FROM lex WHERE ord = 0), c AS (SELECT lemma, pos, count(DISTINCT form) AS n FROM lex GROUP BY ALL)
SELECT w.word, coalesce(f.lemma, w.word) AS lemma, coalesce(c.n, 1) AS n_forms FROM w LEFT JOIN f ON f.form = w.word LEFT JOIN c ON c.lemma = f.lemma AND c.pos = f.pos""")
def q_lemma_lookup(spark, sf):
    w = documents(spark, sf).select(F.explode(T.words("text")).alias("word")).distinct()
    return G.lemma_lookup(w, _lexicon(spark, sf)).select("word", "lemma", "n_forms")


@register("lexicon_forms", f"""
WITH {_LEX}, w AS (SELECT DISTINCT unnest({words_sql('text')}) AS form FROM documents)
SELECT form FROM w WHERE (regexp_replace(form, '{LEMMA_RX}', ''), {_upos_sql('form')}) IN (SELECT lemma, pos FROM lex)""")
def q_lexicon_forms(spark, sf):
    """Corpus words whose lemma and part of speech the benchmark lexicon names."""
    w = documents(spark, sf).select(F.explode(T.words("text")).alias("form")).distinct().withColumn("t", tagged(F.col("form"), T.vowel_count("form")))
    return G.lexicon_forms(w.select("form", "t.lemma", F.col("t.upos").alias("pos")), _lexicon(spark, sf))


@register("lemma_cap", f"""
WITH {_TOK}, c AS (SELECT doc_id, max(k) AS k FROM (SELECT doc_id, line_no, lemma, count(*) FILTER (WHERE upos IN ({_list(G.CAPPED)})) AS k FROM tk GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.k, 0) <= 2 AS good FROM documents d LEFT JOIN c USING (doc_id)""")
def q_lemma_cap(spark, sf):
    """Documents in which no sentence holds a content lemma more than twice."""
    s = F.transform(T.verse_lines("text"), lambda l: tagged_words(T.words(l)))
    d = corpus.settled(documents(spark, sf).select("doc_id", s.alias("s")))
    return d.select("doc_id", G.lemma_cap(F.col("s")).alias("good"))


@register("stop_words", f"""
SELECT word, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS word FROM documents) WHERE word NOT IN ({_list(ADP + PRON + CONJ)}) GROUP BY word""")
def q_stop_words(spark, sf):
    """Word counts without the words of the stopped classes."""
    classes = [("adposition", w) for w in ADP] + [("pronoun", w) for w in PRON] + [("conjunction", w) for w in CONJ]
    stop = spark.createDataFrame(classes, "class string, word string")        # fixed lists
    w = documents(spark, sf, "text").select(F.explode(T.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.join(F.broadcast(stop), "word", "left_anti")


@register("keyword_hits", f"""
WITH {PAIRS_CTE},
w AS (SELECT conv_id, turn, unnest({words_sql('input')}) AS word FROM pairs),
k AS (SELECT conv_id, turn, list(DISTINCT left(regexp_replace(word, '{LEMMA_RX}', ''), 4)) FILTER (WHERE {_upos_sql('word')} IN ({_list(G.KEYWORD)})) AS a,
             list(DISTINCT word) FILTER (WHERE length(word) > 2) AS b FROM w GROUP BY conv_id, turn)
SELECT p.conv_id, p.turn, CAST(len(coalesce(a, b, [])) AS INT) AS n_stems, coalesce(list_bool_or(list_transform({words_sql('p.output')}, lambda o:
       list_bool_or(list_transform(coalesce(a, b, []), lambda s: starts_with(o, s))))), false) AS hit
FROM pairs p LEFT JOIN k USING (conv_id, turn)""")
def q_keyword_hits(spark, sf):
    """Requests whose answer has a word that begins with one of the request's keyword stems."""
    p = _pairs(spark, sf)
    t = corpus.settled(p.select("conv_id", "turn", "output", tagged_words(T.words("input")).alias("t")))
    t = corpus.settled(t.select("conv_id", "turn", "output", G.keyword_stems(F.col("t")).alias("k")))
    return t.select("conv_id", "turn", F.size("k").alias("n_stems"), G.keyword_hit(F.col("k"), T.words("output")).alias("hit"))


@register("subtoken_keywords", f"""
WITH w AS (SELECT DISTINCT lang, unnest({words_sql('text')}) AS word FROM documents)
SELECT DISTINCT lang, u AS unit FROM (SELECT lang, ({syllables_sql('word')})[1] AS u FROM w) WHERE length(u) >= 3""")
def q_subtoken_keywords(spark, sf):
    """Per language list: the first unit of every word, if it has three letters, once."""
    w = documents(spark, sf, "lang", "text").select("lang", F.explode(T.words("text")).alias("word")).distinct()
    return w.select("lang", F.get(T.syllables("word"), F.lit(0)).alias("unit")).where(F.length("unit") >= 3).distinct()


OPTIONAL_WORDS = ["when", "quand", "cuando", "wenn", "ais"]


@register("optional_stress", f"""
WITH {_DICT_SQL}, {_TOK},
o AS (SELECT word, list(stress ORDER BY stress) AS s FROM (SELECT DISTINCT word, stress FROM ovr) GROUP BY word HAVING count(*) > 1),
x AS (SELECT tk.*, d.stress AS first, list_filter(o.s, lambda v: v <> d.stress)[1] AS second,
             (('0x' || substr(md5(doc_id || ':' || line_no || ':' || pos || ':5'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS h
      FROM tk LEFT JOIN dict d ON d.word = tk.word LEFT JOIN o ON o.word = tk.word)
SELECT doc_id, line_no, pos, word, CAST(CASE WHEN n = 0 THEN 0 WHEN second IS NOT NULL THEN CASE WHEN h <= 0.7 THEN first ELSE second END
  WHEN (upos IN ('PRON', 'ADV', 'DET') AND n = 1) OR upos IN ({_list(G.OPTIONAL)}) OR word IN ({_list(OPTIONAL_WORDS)}) THEN CASE WHEN h > 0.5 THEN first ELSE 0 END ELSE first END AS INT) AS stress FROM x""")
def q_optional_stress(spark, sf):
    """Every token's stress when function words may go without and two-way words may take their second stress."""
    from cadenza.operators import lexicon as L
    over = stress_overrides(spark, sf)
    dic = L.merge_stress_sources(stress_sources(spark, sf), over).select("word", F.col("stress").alias("first"))
    two = over.groupBy("word").agg(F.sort_array(F.collect_set("stress")).alias("s")).where(F.size("s") > 1)
    dic = dic.join(two, "word", "left").select("word", "first", F.get(F.filter("s", lambda v: v != F.col("first")), F.lit(0)).alias("second"))
    t = _tokens(spark, sf).join(dic, "word", "left")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_no").cast("string"), F.col("pos").cast("string"), F.lit("5"))), 1, 8), 16, 10)
         .cast("double") + 0.5) / 4294967296.0
    s = G.optional_stress(F.col("word"), F.col("t.upos"), F.col("t.vowels"), F.col("first"), F.col("second"), u, OPTIONAL_WORDS)
    return t.select("doc_id", "line_no", "pos", "word", s.cast("int").alias("stress"))


@register("strip_template_tags", f"WITH {LINES_CTE} SELECT doc_id, line_no, array_to_string({words_sql('text')}, ' ') || '!' AS text FROM lines")
def q_strip_template_tags(spark, sf):
    """Lines with a tag behind every word (``word|NOUN|lemma``), and without them again."""
    t = F.transform(T.words("text"), lambda w: F.concat_ws("|", w, F.lit("NOUN"), F.regexp_replace(w, LEMMA_RX, "")))
    lines = corpus.lines(documents(spark, sf)).select("doc_id", "line_no", F.concat(F.array_join(t, " "), F.lit("!")).alias("t"))
    return lines.select("doc_id", "line_no", G.strip_template_tags(F.col("t")).alias("text"))


_MARKED = f"""sa AS (SELECT doc_id, {verse_lines_sql('text')} AS a FROM documents),
pl AS (SELECT doc_id, len(a) AS total, unnest(range(len(a))) AS i, unnest(a) AS line FROM sa),
bl AS (SELECT doc_id, CASE WHEN i < total // 4 * 4 THEN i // 4 WHEN total % 4 = 3 AND i % 4 = 2 THEN total // 4 + 1 ELSE total // 4 END AS block, i, {last_word_sql('line')} AS word FROM pl),
{clausula_ctes('bl', 'doc_id, block, i, word', 'word')},
ks AS (SELECT doc_id, block, list(clausula ORDER BY i) AS k FROM cl GROUP BY ALL),
rf AS (SELECT *, coalesce(k[1] = k[2], false) AS r12, coalesce(k[1] = k[3], false) AS r13, coalesce(k[1] = k[4], false) AS r14, coalesce(k[2] = k[3], false) AS r23,
              coalesce(k[2] = k[4], false) AS r24, coalesce(k[3] = k[4], false) AS r34 FROM ks)"""


@register("scheme_from_markup", f"""
WITH {_MARKED}
SELECT doc_id, CAST(block AS INT) AS block, CAST(len(k) AS INT) AS n_lines, CASE WHEN len(k) = 2 THEN CASE WHEN r12 THEN 'AA' ELSE '--' END WHEN len(k) <> 4 THEN ''
  WHEN r12 AND r23 AND r34 THEN 'AAAA' WHEN r13 AND r24 AND NOT r12 AND NOT r34 THEN 'ABAB' WHEN r12 AND NOT r23 AND r34 THEN 'AABB' WHEN r12 AND NOT r23 AND r14 THEN 'AABA'
  WHEN r14 AND r23 AND NOT r12 AND NOT r34 THEN 'ABBA' WHEN NOT r12 AND r13 AND NOT r34 THEN 'A-A-' WHEN NOT r12 AND r24 AND NOT r23 THEN '-A-A' ELSE '----' END AS scheme FROM rf""")
def q_scheme_from_markup(spark, sf):
    """Rhyme scheme of every poem of one, two or four lines by the stricter table."""
    b = A.blocks(documents(spark, sf)).select("doc_id", "block", rhyme.line_keys("lines").alias("k"))
    b = corpus.settled(b)
    return b.select("doc_id", "block", F.size("k").alias("n_lines"), G.scheme_from_markup(F.col("k")).alias("scheme"))


@register("unseen_seeds", f"""
WITH RECURSIVE sd AS (SELECT DISTINCT {last_word_sql('line')} AS seed, (item_id % 3)::VARCHAR AS dom FROM (SELECT item_id, unnest({verse_lines_sql('text')}) AS line FROM benchmark)),
pool AS (SELECT domain, seed, row_number() OVER (PARTITION BY domain ORDER BY seed) - 1 AS no, count(*) OVER (PARTITION BY domain) AS n
         FROM (SELECT dom AS domain, seed FROM sd WHERE seed IS NOT NULL UNION SELECT 'common', seed FROM sd WHERE seed IS NOT NULL)),
us AS (SELECT user_id, (user_id % 3)::VARCHAR AS domain, count(*) AS events FROM events GROUP BY user_id),
hist AS (SELECT DISTINCT user_id, seed FROM us JOIN pool p ON p.domain = 'common' AND (p.no + user_id) % 7 < 2 AND p.no < 40),
k AS (SELECT us.user_id, us.domain, count(h.seed) AS k FROM us LEFT JOIN hist h USING (user_id) GROUP BY ALL),
ask AS (SELECT user_id, k, r AS rank, CASE WHEN r = 0 THEN domain ELSE 'common' END AS domain FROM k, unnest([0, 1]) AS x(r)),
c AS (SELECT a.user_id, a.rank, p.seed, ((p.no - ('0x' || substr(md5(a.user_id || ':' || a.domain || ':7'), 1, 8))::BIGINT) % p.n + p.n) % p.n AS i, p.n, a.k
      FROM ask a JOIN pool p ON p.domain = a.domain),
ok AS (SELECT user_id, seed, min(rank * 1000000 + i) AS o FROM c WHERE i < least(k + 3, n) AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.user_id = c.user_id AND h.seed = c.seed) GROUP BY ALL)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY o) AS INT) AS place, seed FROM ok QUALIFY place <= 3""")
def q_unseen_seeds(spark, sf):
    """Three suggestions for every user of ``events``: last words of benchmark lines, by domain, then from all."""
    b = table(spark, sf, "benchmark", "item_id", "text").select("item_id", F.explode(T.verse_lines("text")).alias("line"))
    sd = b.select((F.col("item_id") % 3).cast("string").alias("domain"), rhyme.last_word("line").alias("seed")).where("seed IS NOT NULL").distinct()
    pool = sd.unionByName(sd.select(F.lit("common").alias("domain"), "seed")).distinct()
    # numbered per domain by buckets of the first letters: counts become offsets
    from pyspark.sql import Window
    pool = pool.withColumn("_b", F.substring("seed", 1, 2))
    counts = pool.groupBy("domain", "_b").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("domain").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    sizes = counts.groupBy("domain").agg(F.sum("c").alias("n"))
    inside = F.row_number().over(Window.partitionBy("domain", "_b").orderBy("seed"))
    pool = pool.withColumn("r", inside).join(counts, ["domain", "_b"]).select("domain", "seed", (F.col("before") + F.col("r") - 1).alias("no"))
    users = table(spark, sf, "events", "user_id").distinct().withColumn("domain", (F.col("user_id") % 3).cast("string"))
    shown = users.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))).where((F.col("no") + F.col("user_id")) % 7 < 2)
    history = shown.select("user_id", "no").join(pool.where("domain = 'common'").select("no", "seed"), "no").select("user_id", "seed").distinct()
    return G.unseen_seeds(users, pool, history, sizes)


_TP = ORACLE["align_scores"]


def _prompt_sql() -> str:
    """The alignment's SQL over one-line poems: the lines of the answers."""
    body = _TP[len("WITH RECURSIVE"):]
    i = body.index("arr AS MATERIALIZED ("); j = body.index("poem AS MATERIALIZED (")
    lines = (f"{PAIRS_CTE},\narr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, conv_id, turn, input, {verse_lines_sql('output')} AS a FROM pairs),\n"
             "line AS MATERIALIZED (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS block, 0 AS li FROM arr),\n")
    core = body[:i] + lines + body[j:]
    cut = core.index("top AS (SELECT * FROM (SELECT * FROM s1")
    core = core[:core.index("s2 AS (")] + "top AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY score DESC, metre, rank DESC) = 1)"
    del cut
    return "WITH RECURSIVE" + core + f""",
cand AS (SELECT DISTINCT arr.conv_id, arr.turn, arr.input, line.line AS prompt, pow(10.0::DOUBLE, round(t.score, 6)) AS s FROM top t JOIN line USING (doc_id, block) JOIN arr USING (doc_id) WHERE t.metre = 1),
val AS (SELECT conv_id, turn, prompt, round(s * {shingle_jaccard_sql('prompt', 'input')}, 9) AS value FROM cand)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY value DESC, prompt) AS INT) AS rank, prompt, round(value, 6) AS value FROM val QUALIFY rank <= 5"""


@register("top_prompts", _prompt_sql())
def q_top_prompts(spark, sf):
    """Rewrites of a request are the lines of its answer: the five iambic ones with the highest product of alignment score
    and trigram likeness to the request."""
    p = _pairs(spark, sf).select("conv_id", "turn", "input", F.explode(F.array_distinct(T.verse_lines("output"))).alias("prompt"))
    poems = p.select("conv_id", "turn", "prompt", F.array("prompt").alias("lines"))
    a = A.align_scores(poems, stress_options(spark, sf), keys=("conv_id", "turn", "prompt"), paths=False).where("metre = 'iamb'")
    j = p.join(a.select("conv_id", "turn", "prompt", "log_score"), ["conv_id", "turn", "prompt"])
    value = F.round(F.pow(F.lit(10.0), "log_score") * curate.shingle_jaccard("prompt", "input"), 9)
    return G.top_prompts(j.withColumn("value", value), ["conv_id", "turn"]).withColumn("value", F.round("value", 6))
