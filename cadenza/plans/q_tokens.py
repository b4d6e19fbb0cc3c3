"""Token, n-gram and row-scan queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import corpus, rhyme
from cadenza.plans.q_corpus import _SIG_CTE, _WORDS_CTE
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import LINES_CTE, clausula_ctes, last_word_sql
from cadenza.sources.fixtures import documents, table

# Particles that keep a hyphenated word whole.
HYPHEN_PARTICLES = ["-нибудь", "-либо", "-как", "-ка", "-нибуть", "-где", "-чего", "-таки", "-что", "-какие", "-куда",
                    "-го", "-на", "-под", "во-", "в-", "по-", "кое-", "из-", "вот-", "ну-", "на-", "ни-", "ей-", "ой-", "эх-"]
# Token classes of the typed tokenizer, in order of choice.
TYPED = [("word", r"[\p{L}\-]+"), ("punctuation", r"[.,?:;!—]+"), ("endline", r"\n+"), ("space", r" +"),
         ("number", r"\p{Nd}+"), ("unknown", r"[^\p{L}\-.,?:;!—\n \p{Nd}]+")]
_TYPED_RX = "|".join(r for _, r in TYPED)
_KEEP_SQL = "[" + ", ".join(f"'{p}'" for p in HYPHEN_PARTICLES) + "]"


def _type_of(t):
    out = F.when(t == "-", "punctuation")
    for name, rx in TYPED:
        out = out.when(t.rlike(f"^(?:{rx})$"), name)
    return out


@register("tokenize_typed", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_TYPED_RX}') AS ts FROM documents),
u AS (SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM t)
SELECT doc_id, pos, token, CASE WHEN token = '-' THEN 'punctuation' {' '.join(f"WHEN regexp_full_match(token, '{r}') THEN '{n}'" for n, r in TYPED)} END AS type
FROM u""")
def q_tokenize_typed(spark, sf):
    """Typed tokens of whole texts; neighbours of one type are one token."""
    d = documents(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_TYPED_RX), 0)).alias("pos", "token"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", _type_of(F.col("token")).alias("type"))


def _with_one_row(df, one):
    """Attach the columns of an aggregate that has exactly one row."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")


_HYPHEN_SQL = "SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+(?:-\\p{L}+)*') AS ws FROM documents"


@register("split_hyphen_words", f"""
WITH h AS (SELECT doc_id, unnest(list_distinct(list_concat(ws, list_transform(ws, lambda w: w || '-' || ws[1])))) AS w
           FROM ({_HYPHEN_SQL}) WHERE len(ws) > 0),
k AS (SELECT doc_id, w, len(list_filter({_KEEP_SQL}, lambda p: contains(w, p) OR contains(p, w))) > 0 AS whole FROM h WHERE contains(w, '-'))
SELECT doc_id, w AS word, array_to_string(CASE WHEN whole THEN [w] ELSE string_split(w, '-') END, ' ') AS parts FROM k""")
def q_split_hyphen_words(spark, sf):
    """Hyphenated words (those of the text, and each word joined to the text's first one)
    cut at their hyphens, unless a particle occurs in them or they in one."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:-\p{L}+)*"), 0)
    d = documents(spark, sf).select("doc_id", ws.alias("ws")).where(F.size("ws") > 0)
    d = d.select("doc_id", F.concat("ws", F.transform("ws", lambda w: F.concat(w, F.lit("-"), F.col("ws")[0]))).alias("ws"))
    h = d.select("doc_id", F.explode(F.array_distinct("ws")).alias("word")).where(F.contains("word", F.lit("-")))
    whole = F.exists(F.array(*[F.lit(p) for p in HYPHEN_PARTICLES]),
                     lambda p: F.contains(F.col("word"), p) | F.contains(p, F.col("word")))
    return h.select("doc_id", "word", F.when(whole, F.col("word")).otherwise(F.replace("word", F.lit("-"), F.lit(" "))).alias("parts"))


@register("adjacent_words", f"""
WITH {_WORDS_CTE}
SELECT doc_id, line_no, CAST(word_pos AS BIGINT) AS word_pos, word, lead(word, 1) OVER w AS next_word, lead(word, 2) OVER w AS third_word
FROM words WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY word_pos)""")
def q_adjacent_words(spark, sf):
    """Pairs and triples of neighbouring words of a line, formed inside the row."""
    lines = corpus.lines(documents(spark, sf)).select("doc_id", "line_no", T.words("text").alias("ws"))
    ws = F.col("ws")
    near = F.transform(ws, lambda w, i: F.struct(w.alias("word"), F.get(ws, i + 1).alias("next_word"), F.get(ws, i + 2).alias("third_word")))
    x = lines.select("doc_id", "line_no", F.posexplode(near).alias("word_pos", "p"))
    return x.select("doc_id", "line_no", F.col("word_pos").cast("long").alias("word_pos"), "p.*")


@register("next_two_lines", f"""
WITH {LINES_CTE},
src AS (SELECT doc_id, line_no, text, {last_word_sql('text')} AS lw FROM lines),
{clausula_ctes('src', 'doc_id, line_no, text')}
SELECT a.doc_id, CAST(a.line_no AS BIGINT) AS line_a, CAST(b.line_no AS BIGINT) AS line_b,
       coalesce(a.clausula = b.clausula AND a.lw <> b.lw, false) AS rhymed
FROM cl a JOIN cl b ON a.doc_id = b.doc_id AND b.line_no - a.line_no BETWEEN 1 AND 2""")
def q_next_two_lines(spark, sf):
    """Each line with each of the next two, and whether different last words rhyme."""
    d = corpus.settled(corpus.cut_lines(documents(spark, sf)).select("doc_id", rhyme.line_ends("_l").alias("ws")))
    e = F.zip_with("ws", rhyme.word_keys("ws"), lambda w, k: F.struct(w.alias("w"), k.alias("k")))
    d = corpus.settled(d.select("doc_id", e.alias("e")))
    e = F.col("e")

    def pair(x, i, d):
        y = F.get(e, i + d)
        return F.struct(i.alias("a"), (i + d).alias("b"), F.coalesce((x["k"] == y["k"]) & (x["w"] != y["w"]), F.lit(False)).alias("rhymed"))
    both = F.transform(e, lambda x, i: F.transform(
        F.filter(F.array(F.lit(1), F.lit(2)), lambda d: i + d < F.size(e)), lambda d: pair(x, i, d)))
    x = corpus.settled(d.select("doc_id", F.flatten(both).alias("ps"))).select("doc_id", F.explode("ps").alias("p"))
    return x.select("doc_id", F.col("p.a").cast("long").alias("line_a"), F.col("p.b").cast("long").alias("line_b"), "p.rhymed")


@register("rap_density", f"""
WITH {LINES_CTE},
src AS (SELECT doc_id, line_no, text, {last_word_sql('text')} AS lw FROM lines),
{clausula_ctes('src', 'doc_id, line_no, text')},
pr AS (SELECT a.doc_id, count(*) AS n FROM cl a JOIN cl b ON a.doc_id = b.doc_id AND b.line_no - a.line_no BETWEEN 1 AND 2
       WHERE a.clausula = b.clausula AND a.lw <> b.lw GROUP BY a.doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE len(regexp_extract_all(lower(text), '\\p{{L}}+')) = 1) AS short FROM lines GROUP BY doc_id),
vc AS (SELECT doc_id, len(ws) AS n_words, len(list_distinct(ws)) AS n_kinds FROM (
  SELECT doc_id, flatten(list(regexp_extract_all(lower(text), '\\p{{L}}+'))) AS ws FROM lines GROUP BY doc_id))
SELECT ln.doc_id, CAST(coalesce(pr.n, 0) AS BIGINT) AS rhymes, CAST(ln.n_lines AS BIGINT) AS n_lines,
       CAST(ln.short AS BIGINT) AS one_word_lines, vc.n_kinds < vc.n_words // 2 AS degenerate,
       round(coalesce(pr.n, 0) / ln.n_lines - ln.short - CASE WHEN vc.n_kinds < vc.n_words // 2 THEN 100 ELSE 0 END, 6) AS density
FROM ln JOIN vc USING (doc_id) LEFT JOIN pr USING (doc_id)""")
def q_rap_density(spark, sf):
    """Rhymes between a line and the next two, per line, less the defects: one for each
    one-word line, 100 where the vocabulary is under half of the words."""
    d = documents(spark, sf).select("doc_id", T.verse_lines("text").alias("ls")).where(F.size("ls") > 0)
    d = d.select("doc_id", F.transform("ls", lambda x: T.words(x)).alias("ws"))
    end = F.transform("ws", lambda w: F.struct(F.try_element_at(w, F.lit(-1)).alias("w"), rhyme.clausula(F.try_element_at(w, F.lit(-1))).alias("k")))
    d = d.select("doc_id", "ws", end.alias("e"))
    e = F.col("e")
    hits = F.transform(e, lambda x, i: F.size(F.filter(F.array(F.lit(1), F.lit(2)), lambda d: F.coalesce(
        (F.get(e, i + d)["k"] == x["k"]) & (F.get(e, i + d)["w"] != x["w"]), F.lit(False)))))
    words = F.flatten("ws")
    d = d.select("doc_id", F.aggregate(hits, F.lit(0), lambda a, x: a + x).cast("long").alias("rhymes"),
                 F.size("ws").cast("long").alias("n_lines"),
                 F.size(F.filter("ws", lambda w: F.size(w) == 1)).cast("long").alias("one_word_lines"),
                 (F.size(F.array_distinct(words)) < F.floor(F.size(words) / 2)).alias("degenerate"))
    return d.withColumn("density", F.round(F.col("rhymes") / F.col("n_lines") - F.col("one_word_lines")
                                           - F.when(F.col("degenerate"), 100).otherwise(0), 6))


@register("signature_similarity", f"""
WITH {_SIG_CTE},
pr AS (SELECT doc_id, line_no, sig AS s1, lead(sig) OVER (PARTITION BY doc_id ORDER BY line_no) AS s2 FROM sg),
sh AS (SELECT doc_id, line_no, unnest([[s1, s2], ['0' || s1, s2], [s1, '0' || s2]]) AS p FROM pr WHERE s2 IS NOT NULL),
cut AS (SELECT doc_id, line_no, substr(p[1], 1, least(length(p[1]), length(p[2]))) AS a,
               substr(p[2], 1, least(length(p[1]), length(p[2]))) AS b FROM sh),
sc AS (SELECT doc_id, line_no, CASE WHEN length(replace(a, '0', '')) < 2 OR length(replace(b, '0', '')) < 2 THEN 0.0
         ELSE exp(-hamming(a, b)) END AS s FROM cut)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, round(max(s), 9) AS similarity FROM sc GROUP BY doc_id, line_no""")
def q_signature_similarity(spark, sf):
    """Stress signature of a line against the next one: best of three shifts, cut to the
    shorter, ``exp(-differences)``; 0 with fewer than two stresses on a side."""
    from cadenza.operators.metre import line_patterns
    s = line_patterns(corpus.lines(documents(spark, sf))).select("doc_id", "line_no", F.translate("pattern", "SUA", "101").alias("sig"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    p = s.withColumn("nxt", F.lead("sig").over(w)).where(F.col("nxt").isNotNull())
    zero = F.lit("0")

    def one(a, b):
        n = F.least(F.length(a), F.length(b))
        x, y = F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n)
        diff = F.length(F.replace(F.array_join(F.zip_with(F.split(x, ""), F.split(y, ""), lambda c, d: F.when(c == d, "").otherwise("x")), ""), F.lit(" "), F.lit("")))
        few = (F.length(F.replace(x, F.lit("0"), F.lit(""))) < 2) | (F.length(F.replace(y, F.lit("0"), F.lit(""))) < 2)
        return F.when(few, F.lit(0.0)).otherwise(F.exp(-diff))
    a, b = F.col("sig"), F.col("nxt")
    best = F.greatest(one(a, b), one(F.concat(zero, a), b), one(a, F.concat(zero, b)))
    return p.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.round(best, 9).alias("similarity"))


_BIGRAM_SQL = """w AS (SELECT l.quality, regexp_extract_all(lower(d.text), '\\p{L}+') AS ws FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT DISTINCT quality, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM w)"""


@register("key_conflict_drop", f"""
WITH {_BIGRAM_SQL}
SELECT gram, any_value(quality) AS quality FROM g GROUP BY gram HAVING count(*) = 1""")
def q_key_conflict_drop(spark, sf):
    """Word pairs of good and of poor documents; pairs present on both sides leave both."""
    lab = table(spark, sf, "labels", "doc_id", "quality")
    d = documents(spark, sf).select("doc_id", T.words("text").alias("ws")).join(lab, "doc_id")
    n = F.size("ws") - 1
    pairs = F.zip_with(F.slice("ws", F.lit(1), F.greatest(n, F.lit(0))), F.slice("ws", F.lit(2), F.greatest(n, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    g = d.select("quality", F.explode(F.array_distinct(pairs)).alias("gram"))
    return (g.groupBy("gram").agg(F.min("quality").alias("quality"), F.max("quality").alias("hi"))
            .where("quality = hi").select("gram", "quality"))


@register("union_parts", """
WITH u AS (SELECT 0 AS part, item_id AS key, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents)
SELECT part, key, row_number() OVER (ORDER BY part, key) - 1 AS new_index, length(text) AS n_chars FROM u""")
def q_union_parts(spark, sf):
    """Chunk tables one after the other, with a new index over all of them."""
    from cadenza.operators.sampling import global_row_number
    b = table(spark, sf, "benchmark", "item_id", "text").select(F.lit(0).alias("part"), F.col("item_id").alias("key"), "text")
    d = documents(spark, sf).select(F.lit(1).alias("part"), F.col("doc_id").alias("key"), "text")
    u = b.unionByName(d).select("part", "key", F.length("text").cast("long").alias("n_chars"))
    r = global_row_number(u, [F.col("part"), F.col("key")], [F.col("part"), F.floor(F.col("key") / 65536)])
    return r.select("part", "key", (F.col("rn") - 1).alias("new_index"), "n_chars")


@register("stress_key_valid", f"""
WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS key FROM documents)
SELECT key FROM w WHERE length(key) >= 2 AND regexp_full_match(key, '[a-zA-ZÀ-ÖØ-öø-ÿœŒß́̀][a-zA-ZÀ-ÖØ-öø-ÿœŒß́̀-]*[a-zA-ZÀ-ÖØ-öø-ÿœŒß́̀]')""")
def q_stress_key_valid(spark, sf):
    """Dictionary keys among the raw tokens: two or more signs, only letters of the
    profile's alphabet, hyphens and stress marks, no hyphen at an edge."""
    letters = "a-zA-ZÀ-ÖØ-öø-ÿœŒß" + T.STRESS_MARKS
    w = documents(spark, sf, "text").select(F.explode(F.split("text", r"\s+")).alias("key")).distinct()
    return w.where((F.length("key") >= 2) & F.col("key").rlike(f"^[{letters}][{letters}-]*[{letters}]$"))


@register("scan_line_samples", """
WITH s AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, trim(unnest(ls)) AS sample
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, sample, CAST(max(len(string_split_regex(sample, '\\s+'))) OVER () + 2 AS BIGINT) AS block_size
FROM s WHERE sample <> ''""")
def q_scan_line_samples(spark, sf):
    """One sample per non-blank line; the block size is the longest sample's tokens plus two."""
    s = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "s"))
    s = s.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim("s").alias("sample")).where("sample <> ''")
    top = s.agg((F.max(F.size(F.split("sample", r"\s+"))) + 2).cast("long").alias("block_size"))
    return _with_one_row(s, top)


@register("scan_labelled_tsv", """
WITH x AS (SELECT d.doc_id, l.quality, len(string_split_regex(trim(d.text), '\\s+')) AS n FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT quality, row_number() OVER (ORDER BY quality) - 1 AS class_idx FROM (SELECT DISTINCT quality FROM labels WHERE quality IS NOT NULL))
SELECT x.doc_id, c.class_idx, CAST(x.n AS BIGINT) AS n_tokens FROM x JOIN c USING (quality) WHERE x.n < 1024""")
def q_scan_labelled_tsv(spark, sf, max_tokens: int = 1024):
    """Labelled texts: the class is the place among the sorted distinct classes; texts of
    ``max_tokens`` or more are dropped (the rule of the reader)."""
    lab = table(spark, sf, "labels", "doc_id", "quality")
    classes = lab.select("quality").where("quality is not null").distinct()
    classes = classes.withColumn("class_idx", (F.row_number().over(Window.orderBy("quality")) - 1).cast("long"))  # one row per class
    n = documents(spark, sf).select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("n_tokens"))
    return n.where(F.col("n_tokens") < max_tokens).join(lab, "doc_id").join(F.broadcast(classes), "quality").select(
        "doc_id", "class_idx", "n_tokens")


@register("vocab_vectors", """
WITH v AS (SELECT e.vec_id, e.label, len(e.embedding) AS dim FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT vec_id, label, CAST(count(*) OVER () AS BIGINT) AS n_vectors, CAST(max(dim) OVER () AS BIGINT) AS dim FROM v""")
def q_vocab_vectors(spark, sf):
    """Vectors whose key is in the vocabulary (ids labelled good), with the header's count and dimension."""
    voc = table(spark, sf, "labels", "doc_id", "quality").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    v = table(spark, sf, "embeddings", "vec_id", "label", "embedding").join(voc, "vec_id", "left_semi")
    v = v.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))
    head = v.agg(F.count(F.lit(1)).alias("n_vectors"), F.max("dim").alias("dim"))
    return _with_one_row(v.drop("dim"), head)


@register("answers_join", """
WITH q AS (SELECT conv_id, turn, text AS input FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS output FROM conversations WHERE role = 'assistant')
SELECT coalesce(q.conv_id, a.conv_id) AS conv_id, coalesce(q.turn, a.turn) AS turn, q.input, a.output
FROM q FULL OUTER JOIN a ON q.conv_id = a.conv_id AND q.turn = a.turn""")
def q_answers_join(spark, sf):
    """Every source row (user turn) with its generated answer (the assistant turn right after it) by row
    key, full outer: sources without an answer and answers without a source stay."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return q.join(a, ["conv_id", "turn"], "full").select("conv_id", "turn", "input", "output")
