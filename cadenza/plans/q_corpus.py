"""Corpus table queries: poems, words, syllables, stress rendering, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import corpus, stress
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import LINES_CTE, V, pattern_sql, syllables_sql, verse_lines_sql, vowels_sql, words_sql
from cadenza.sources.fixtures import documents

_WORDS_CTE = f"""{LINES_CTE},
words AS (SELECT doc_id, line_no, unnest(range(len(ws))) AS word_pos, unnest(ws) AS word
          FROM (SELECT doc_id, line_no, {words_sql('text')} AS ws FROM lines))"""


@register("scan_poems", f"""
SELECT doc_id, CAST(len(arr) AS INTEGER) AS n_lines, array_to_string(arr, chr(10)) AS poem
FROM (SELECT doc_id, {verse_lines_sql('text')} AS arr FROM documents) WHERE len(arr) > 0""")
def q_scan_poems(spark, sf):
    p = corpus.poems(documents(spark, sf))
    return p.select("doc_id", "n_lines", F.array_join("lines", "\n").alias("poem"))


@register("verse_lines", f"""
WITH {LINES_CTE} SELECT doc_id, line_no, text FROM lines""")
def q_verse_lines(spark, sf):
    return corpus.lines(documents(spark, sf))


@register("vowel_count", f"""
WITH {_WORDS_CTE}
SELECT doc_id, line_no, word_pos, word, CAST({vowels_sql('word')} AS INTEGER) AS n_vowels FROM words""")
def q_vowel_count(spark, sf):
    w = corpus.words(corpus.lines(documents(spark, sf)))
    return w.select("doc_id", "line_no", "word_pos", "word", F.col("n_vowels").cast("int"))


@register("syllables", f"""
WITH {_WORDS_CTE},
sy AS (SELECT doc_id, line_no, word_pos, ({vowels_sql('word')} + 1) // 2 AS stress,
              unnest(range(len(ss))) AS syl_pos, unnest(ss) AS syllable
       FROM (SELECT *, {syllables_sql('word')} AS ss FROM words))
SELECT doc_id, line_no, word_pos, syl_pos, syllable, coalesce(syl_pos + 1 = stress AND stress > 0, false) AS stressed
FROM sy""")
def q_syllables(spark, sf):
    w = corpus.words(corpus.lines(documents(spark, sf)))
    return corpus.syllables(w)


_P = (f"(length(w) - length(array_to_string(regexp_extract_all(w, '[{V}][^{V}]*')"
      f"[({vowels_sql('w')} + 1) // 2:], '')) + 1)")
_RENDER_SQL = f"""{LINES_CTE},
rw AS (SELECT doc_id, line_no, list_transform({words_sql('text')}, lambda w:
         CASE WHEN {vowels_sql('w')} = 0 THEN w ELSE
           substr(w, 1, {_P}) || chr(769) || substr(w, {_P} + 1) END) AS rws
       FROM lines)"""


@register("stress_render", f"""
WITH {_RENDER_SQL}
SELECT doc_id, line_no, array_to_string(rws, ' ') AS stressed FROM rw""")
def q_stress_render(spark, sf):
    lines = corpus.lines(documents(spark, sf))
    return lines.select("doc_id", "line_no", stress.render_line("text").alias("stressed"))


def _tag_sql(w: str) -> str:
    a, g = "chr(769)", "chr(768)"
    return (f"CASE WHEN {vowels_sql(w)} = 0 THEN {w} ELSE "
            f"CASE WHEN strpos({w}, {a}) > 0 THEN '<S' || CAST({vowels_sql(f'split_part({w}, {a}, 1)')} AS VARCHAR) || '>' ELSE '' END || "
            f"CASE WHEN strpos({w}, {g}) > 0 THEN '<s' || CAST({vowels_sql(f'split_part({w}, {g}, 1)')} AS VARCHAR) || '>' ELSE '' END || "
            f"'<count' || CAST({vowels_sql(w)} AS VARCHAR) || '> ' || replace(replace({w}, {a}, ''), {g}, '') END")


# marked lines with every case: words with acute, without and with grave mark in turn, the last two hyphenated
_MIXED_SQL = f"""{_RENDER_SQL},
mx AS (SELECT doc_id, line_no, regexp_replace(array_to_string(list_transform(rws, lambda w, i:
         CASE i % 3 WHEN 1 THEN w WHEN 2 THEN replace(w, chr(769), '') ELSE replace(w, chr(769), chr(768)) END), ' '),
         ' ([^ ]+)$', '-\\1') AS stressed FROM rw)"""


@register("stress_markup", f"""
WITH {_MIXED_SQL}
SELECT doc_id, line_no, array_to_string(list_transform(string_split(stressed, ' '), lambda t:
    array_to_string(list_transform(string_split(t, '-'), lambda w: {_tag_sql('w')}), ' - ')), ' ') AS markup
FROM mx""")
def q_stress_markup(spark, sf):
    """Tags of marked lines; the input has primary, secondary and missing marks and
    hyphenated words in turn."""
    lines = corpus.lines(documents(spark, sf))
    turn = F.transform(stress.render_words(T.words("text")), lambda w, i: F.when(i % 3 == 0, w).when(i % 3 == 1, F.translate(w, stress.ACUTE, ""))
                       .otherwise(F.translate(w, stress.ACUTE, stress.GRAVE)))
    mixed = F.regexp_replace(F.array_join(turn, " "), " ([^ ]+)$", "-$1")
    r = corpus.settled(lines.select("doc_id", "line_no", mixed.alias("stressed")))
    return r.select("doc_id", "line_no", stress.stress_markup("stressed").alias("markup"))


@register("strip_diacritics", f"""
WITH {_RENDER_SQL}
SELECT doc_id, line_no, replace(replace(array_to_string(rws, ' '), chr(769), ''), chr(768), '') AS text FROM rw""")
def q_strip_diacritics(spark, sf):
    """Stress marks dropped from the rendered lines."""
    lines = corpus.lines(documents(spark, sf))
    return lines.select("doc_id", "line_no", T.strip_diacritics(stress.render_line("text")).alias("text"))


@register("syllable_encode", f"""
WITH {LINES_CTE}
SELECT doc_id, line_no, array_to_string(list_reverse(list_transform({words_sql('text')},
    lambda w: array_to_string(list_reverse({syllables_sql('w')}), ' '))), ' | ') AS encoded
FROM lines""")
def q_syllable_encode(spark, sf):
    lines = corpus.lines(documents(spark, sf))
    return lines.select("doc_id", "line_no", stress.syllable_encode("text").alias("encoded"))


@register("syllable_decode", f"""
WITH {LINES_CTE}
SELECT doc_id, line_no, array_to_string({words_sql('text')}, ' ') AS decoded FROM lines""")
def q_syllable_decode(spark, sf):
    """Decode of the encoded lines: equals the line's words joined by spaces."""
    lines = corpus.lines(documents(spark, sf))
    enc = lines.select("doc_id", "line_no", stress.syllable_encode("text").alias("encoded"))
    return enc.select("doc_id", "line_no", stress.syllable_decode("encoded").alias("decoded"))


# ---------------------------------------------------------------------------
# stress signatures (0/1 per syllable; one-syllable words count as stressed)
# ---------------------------------------------------------------------------
def _signature(spark, sf):
    from cadenza.operators import metre
    lp = metre.line_patterns(corpus.lines(documents(spark, sf)))
    return lp.select("doc_id", "line_no", F.translate("pattern", "SUA", "101").alias("sig"))


_SIG_CTE = f"""{LINES_CTE},
sg AS (SELECT doc_id, line_no, translate({pattern_sql('text')}, 'SUA', '101') AS sig FROM lines)"""


@register("unstressed_runs", f"""
WITH {_SIG_CTE}
SELECT doc_id, line_no, CAST(len(regexp_extract_all(sig, '0{{4,}}')) AS INTEGER) AS n_runs,
       round(pow(0.1, len(regexp_extract_all(sig, '0{{4,}}'))), 6) AS factor
FROM sg""")
def q_unstressed_runs(spark, sf):
    """Runs of four or more unstressed syllables; each multiplies by 0.1."""
    s = _signature(spark, sf)
    n = F.size(F.regexp_extract_all("sig", F.lit("0{4,}"), 0))
    return s.select("doc_id", "line_no", n.cast("int").alias("n_runs"),
                    F.round(F.pow(F.lit(0.1), n), 6).alias("factor"))


@register("stress_gaps", f"""
WITH {_SIG_CTE}
SELECT doc_id, line_no, array_to_string(list_sort(list_distinct(list_transform(
    string_split(sig, '1')[1:len(string_split(sig, '1')) - 1], lambda x: length(x)))), ',') AS gaps
FROM sg""")
def q_stress_gaps(spark, sf):
    """Distinct lengths of the unstressed runs before each stress."""
    s = _signature(spark, sf)
    parts = F.split("sig", "1")
    before = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    gaps = F.array_sort(F.array_distinct(F.transform(before, lambda x: F.length(x))))
    return s.select("doc_id", "line_no",
                    F.array_join(F.transform(gaps, lambda g: g.cast("string")), ",").alias("gaps"))


@register("edge_consonants", f"""
WITH {_WORDS_CTE}
SELECT doc_id, line_no, word_pos, word,
       CAST(length(regexp_extract(word, '^[^{V}]*')) AS INTEGER) AS lead_cons,
       CAST(length(regexp_extract(word, '[^{V}]*$')) AS INTEGER) AS trail_cons
FROM words""")
def q_edge_consonants(spark, sf):
    w = corpus.words(corpus.lines(documents(spark, sf)))
    from cadenza.profiles import LATIN
    nv = LATIN.non_vowel_class
    return w.select("doc_id", "line_no", "word_pos", "word",
                    F.length(F.regexp_extract("word", "^" + nv + "*", 0)).cast("int").alias("lead_cons"),
                    F.length(F.regexp_extract("word", nv + "*$", 0)).cast("int").alias("trail_cons"))


# Separators of the template tokenizer (besides white space).
TEMPLATE_SEPARATORS = "[+<>`~;.,?？!-…№”“„{}/'\"–—_:«»*]()）》"
_SEP_CLASS = "[\\s" + "".join("\\" + c if c in "[]-^" else c for c in TEMPLATE_SEPARATORS) + "]+"
_SEP_SQL = _SEP_CLASS.replace("'", "''")


@register("template_tokens", f"""
WITH {LINES_CTE}
SELECT doc_id, line_no, array_to_string(list_transform(list_filter(string_split_regex(text, '{_SEP_SQL}'), lambda x: x <> ''),
    lambda x: CASE WHEN strpos(x, '°') > 1 AND strpos(x, '°') < length(x) AND NOT regexp_matches(x, '[0-9]')
                   THEN lower(x) ELSE translate(lower(x), 'ё', 'е') END), ' ') AS tokens
FROM lines""")
def q_template_tokens(spark, sf):
    """Lower-case tokens split on the separator class, empties dropped; ё→е except in
    words with an inner degree sign and no digit."""
    def norm(x):
        at = F.instr(x, "°")
        keep = (at > 1) & (at < F.length(x)) & ~x.rlike("[0-9]")
        return F.when(keep, F.lower(x)).otherwise(F.translate(F.lower(x), "ё", "е"))
    lines = corpus.lines(documents(spark, sf))
    toks = F.transform(F.filter(F.split("text", _SEP_CLASS), lambda x: x != ""), norm)
    return lines.select("doc_id", "line_no", F.array_join(toks, " ").alias("tokens"))
