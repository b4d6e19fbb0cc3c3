"""Sample readers, space normalisation, weighted picks, stanzas with their poem's metre and with both markups,
the written scorecard, masked training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import corpus, normalize, rhyme, sampling, scans, stress
from cadenza.plans import q_metre, q_rhyme
from cadenza.plans.q_sinks import _folder
from cadenza.plans.registry import ORACLE, register
from cadenza.plans.q_rhyme import rhyme_key_sql
from cadenza.plans.sqlbits import seeded_hash_sql, verse_lines_sql, words_sql
from cadenza.sources.fixtures import documents, table

MARKER, BLOCK_SIZE = "The ", 1


@register("scan_marked_blocks", f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w(doc_id, ls, i, size, first, block, cut) AS (
  SELECT doc_id, ls, 0, 0, 0, 0, CAST(NULL AS STRUCT(b INTEGER, f INTEGER, n INTEGER)) FROM d
  UNION ALL
  SELECT doc_id, ls, i + 1,
    CASE WHEN i >= len(ls) OR starts_with(ls[i + 1], '{MARKER}') OR size > {5000 * BLOCK_SIZE} THEN 0 ELSE size + length(ls[i + 1]) END,
    CASE WHEN i >= len(ls) OR starts_with(ls[i + 1], '{MARKER}') OR size > {5000 * BLOCK_SIZE} THEN i + 1 ELSE first END,
    CASE WHEN (i >= len(ls) OR starts_with(ls[i + 1], '{MARKER}') OR size > {5000 * BLOCK_SIZE}) AND i > first THEN block + 1 ELSE block END,
    CASE WHEN (i >= len(ls) OR starts_with(ls[i + 1], '{MARKER}') OR size > {5000 * BLOCK_SIZE}) AND i > first
         THEN struct_pack(b := block, f := first, n := i - first) END
  FROM w WHERE i <= len(ls))
SELECT doc_id, CAST(cut.b AS INT) AS block, CAST(cut.f AS INT) AS first_line, CAST(cut.n AS INT) AS n_lines,
       md5(array_to_string(ls[cut.f + 1:cut.f + cut.n], chr(10))) AS text_md5 FROM w WHERE cut IS NOT NULL""")
def q_scan_marked_blocks(spark, sf):
    """Line blocks of every document, cut at lines that begin with a marker and at a bound of buffered characters."""
    b = scans.marked_blocks(documents(spark, sf), MARKER, BLOCK_SIZE)
    return b.select("doc_id", "block", "first_line", "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("scan_framed_samples", """
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, trim(unnest(ls)) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT * FROM l WHERE s <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS sample_no, s AS sample FROM k""")
def q_scan_framed_samples(spark, sf):
    """Each document as a frame stream (``<s>number#line</s>`` per line), read back."""
    frames = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.concat(F.lit("<s>"), i.cast("string"), F.lit("#"), l, F.lit("</s>"))), "")
    d = documents(spark, sf).select("doc_id", frames.alias("stream"))
    return d.select("doc_id", F.posexplode(scans.framed_samples(F.col("stream"))).alias("sample_no", "sample"))


@register("scan_multiline_samples", """
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, coalesce(sum(CASE WHEN ends_with(s, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM l)
SELECT doc_id, CAST(g AS INT) AS sample_no, string_agg(s, chr(10) ORDER BY i) AS sample FROM k GROUP BY doc_id, g HAVING bool_or(ends_with(s, '.'))""")
def q_scan_multiline_samples(spark, sf):
    """Samples of lines; a sample ends with the line that ends with a full stop."""
    return documents(spark, sf).select("doc_id", F.posexplode(scans.multiline_samples(F.col("text"), ".")).alias("sample_no", "sample"))


# Ours: listed words for the fixtures' languages.
_RULES = normalize.rules(indefinite=["the", "la", "de"], parts=["in", "an"], compounds=["en - an", "th - er", "de - la"], stems=["on* - an*"],
                         suffixes=("ka",), leading="re", indefinite_ending="to", vowels="aeiou")


@register("normalize_spaces", f"""
WITH w AS (SELECT doc_id, line_no, array_to_string({words_sql('line')}, ' - ') || ' , « x » ! " y " ; the - to' AS s
           FROM (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, {verse_lines_sql('text')} AS a FROM documents))),
p AS (SELECT doc_id, line_no, regexp_replace(replace(replace(regexp_replace(s, ' ([,.?!…;:])', '\\1', 'g'), '« ', '«'), ' »', '»'), '" ([^' || chr(10) || ']+) "', '"\\1"', 'g') AS s FROM w),
i AS (SELECT doc_id, line_no, regexp_replace(s, '(?i)((?:the|la|de)) - to', '\\1-to', 'g') AS s FROM p),
k AS (SELECT doc_id, line_no, regexp_replace(s, '(?i) - ka([^\\p{{L}}\\p{{N}}_]|$)', '-ka\\1', 'g') AS s FROM i)
SELECT doc_id, CAST(line_no AS INT) AS line_no, s AS text FROM k""")
def q_normalize_spaces(spark, sf):
    """Every verse line spaced out around hyphens and marks; marks, quotes and listed endings closed up again."""
    lines = corpus.lines(documents(spark, sf))
    noisy = F.concat(F.array_join(T.words("text"), " - "), F.lit(" , « x » ! \" y \" ; the - to"))
    rules = normalize.rules(indefinite=["the", "la", "de"], parts=[], compounds=[], stems=[], suffixes=("ka",), leading="", indefinite_ending="to", vowels="")
    return lines.select("doc_id", "line_no", normalize.normalize_spaces(noisy, rules).alias("text"))


@register("rank_weighted_pick", f"""
WITH l AS (SELECT doc_id, unnest({verse_lines_sql('text')}) AS line FROM documents),
k AS (SELECT DISTINCT doc_id, array_to_string({words_sql('line')}[-2:], ' ') AS key FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(key) - length(replace(key, ' ', '')) + length(key) // 4 DESC, key) AS rank FROM k),
u AS (SELECT *, ln((('0x' || substr({seeded_hash_sql('doc_id', 'key')}, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE) * rank AS s FROM r)
SELECT doc_id, arg_max(key, s) AS key, count(*) AS n_keys FROM u GROUP BY doc_id""")
def q_rank_weighted_pick(spark, sf):
    """One key per document, the last two words of one of its lines: ranked by words and length, weight 1/rank."""
    keys = F.array_distinct(F.transform(T.verse_lines("text"), lambda l: F.array_join(F.slice(T.words(l), F.greatest(F.size(T.words(l)) - 1, F.lit(1)), 2), " ")))
    d = documents(spark, sf).select("doc_id", F.explode(sampling.rank_weights(keys)).alias("k")).select("doc_id", "k.rank", "k.key")
    return sampling.weighted_pick(d, "doc_id", "key", 1.0 / F.col("rank"))


@register("stanza_metre_join", f"""
WITH q AS ({ORACLE['quatrains']}), m AS ({ORACLE['poem_metre']})
SELECT q.doc_id, q.start, q.scheme, m.metre FROM q LEFT JOIN m USING (doc_id)""")
def q_stanza_metre_join(spark, sf):
    """Every stanza with the metre of its poem."""
    q = q_rhyme.q_quatrains(spark, sf).select("doc_id", "start", "scheme")
    return q.join(q_metre.q_poem_metre(spark, sf).select("doc_id", "metre"), "doc_id", "left").select("doc_id", "start", "scheme", "metre")


@register("rhyme_stress_markup", f"""
WITH q AS ({ORACLE['quatrains']}), m AS ({ORACLE['stress_markup']}),
l AS (SELECT doc_id, start, scheme, i, string_split(stanza, chr(10))[i + 1] AS l FROM q, unnest(range(4)) AS u(i)),
t AS (SELECT l.doc_id, l.start, l.i, substr(scheme, l.i + 1, 1) AS x, {rhyme_key_sql('l')} AS k, m.markup
      FROM l JOIN m ON m.doc_id = l.doc_id AND m.line_no = l.start + l.i)
SELECT doc_id, start, string_agg('<rhyme' || x || '>' || k || '</rhyme' || x || '> ' || markup, chr(10) ORDER BY i) AS markup FROM t WHERE k IS NOT NULL GROUP BY doc_id, start""")
def q_rhyme_stress_markup(spark, sf):
    """Rhyme tags in front of the stress-marked lines of every stanza; both markups are made in the stanza's row."""
    q = q_rhyme.q_quatrains(spark, sf)
    lines, n = F.split("stanza", "\n"), F.length("scheme")
    tagged = F.transform(lines, lambda l, i: F.concat(
        F.lit("<rhyme"), F.substring(F.col("scheme"), F.pmod(i, n) + 1, F.lit(1)), F.lit(">"), rhyme.rhyme_key(l), F.lit("</rhyme"),
        F.substring(F.col("scheme"), F.pmod(i, n) + 1, F.lit(1)), F.lit("> "), stress.stress_markup(_mixed(l))))
    return q.select("doc_id", "start", F.array_join(F.array_compact(tagged), "\n").alias("markup"))


def _mixed(line):
    """Lines marked as in ``stress_markup``: acute, no and grave marks in turn, the last two words hyphenated."""
    turn = F.transform(T.words(line), lambda w, i: F.when(i % 3 == 0, stress.render_word(w)).when(i % 3 == 1, w)
                       .otherwise(F.translate(stress.render_word(w), stress.ACUTE, stress.GRAVE)))
    return F.regexp_replace(F.array_join(turn, " "), " ([^ ]+)$", "-$1")


@register("sink_scorecard", ORACLE["scorecard"])
def q_sink_scorecard(spark, sf):
    """The scorecard written as CSV with a header under the models' joined names, read back."""
    card = q_rhyme.q_scorecard(spark, sf)
    path = _folder(spark, "scorecard")
    card.write.option("header", True).csv(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in card.schema)
    return spark.read.schema(schema).option("header", True).csv(path)


# Shares of the masking rule.
TARGETS, MASKED, RANDOM = 0.15, 0.8, 0.5


@register("masked_training_rows", f"""
WITH t AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents)),
u AS (SELECT *, ('0x' || substr(md5(doc_id || ':' || pos || ':7'), 1, 8))::BIGINT AS a, ('0x' || substr(md5(doc_id || ':' || pos || ':7'), 9, 8))::BIGINT AS b,
             ('0x' || substr(md5(doc_id || ':' || pos || ':7'), 17, 8))::BIGINT AS c, ('0x' || substr(md5(doc_id || ':' || pos || ':7'), 25, 8))::BIGINT AS d FROM t)
SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN a < {int(TARGETS * 2**32)} THEN CASE WHEN b < {int(MASKED * 2**32)} THEN '<mask>' WHEN c < {int(RANDOM * 2**32)} THEN 'random' || d % 1000 ELSE token END ELSE token END AS input,
       CASE WHEN a < {int(TARGETS * 2**32)} THEN token END AS label FROM u""")
def q_masked_training_rows(spark, sf):
    """Every token with the masking rule: 15 % are targets; of those 80 % are masked, half of the rest become a random
    unit (``random`` and a number of a thousand), the others stay.  Seeded by document and place."""
    t = documents(spark, sf).select("doc_id", F.posexplode(T.words("text")).alias("pos", "token"))
    h = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.lit("7")))
    a, b, c, d = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    target = a < int(TARGETS * 2**32)
    changed = F.when(b < int(MASKED * 2**32), "<mask>").when(c < int(RANDOM * 2**32), F.concat(F.lit("random"), (d % 1000).cast("string"))).otherwise(F.col("token"))
    return t.select("doc_id", "pos", F.when(target, changed).otherwise(F.col("token")).alias("input"), F.when(target, F.col("token")).alias("label"))
