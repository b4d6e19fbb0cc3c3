"""Curation queries: prose/verse pairs, gates, repairs, chunking, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import corpus, curate, sampling
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import (LINES_CTE, PAIRS_CTE, clean_text_sql, filter_lines_sql,
                                   jaccard_sql, seeded_hash_sql, sentence_split_sql,
                                   shingle_jaccard_sql)
from cadenza.sources.fixtures import documents, table


def _pairs(spark, sf):
    conv = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return curate.request_output_pairs(conv)


@register("outputs_join", f"""
WITH {PAIRS_CTE}
SELECT conv_id, turn, input, output FROM pairs""")
def q_outputs_join(spark, sf):
    """Model output i paired with request i (assistant turn after a user turn)."""
    return _pairs(spark, sf).select("conv_id", "turn", "input", "output")


@register("word_jaccard", f"""
WITH {PAIRS_CTE}
SELECT conv_id, turn, round({jaccard_sql('input', 'output')}, 6) AS jaccard FROM pairs""")
def q_word_jaccard(spark, sf):
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn", F.round(curate.word_jaccard("input", "output"), 6).alias("jaccard"))


@register("shingle_jaccard", f"""
WITH {PAIRS_CTE}
SELECT conv_id, turn, round({shingle_jaccard_sql('input', 'output')}, 6) AS jaccard FROM pairs""")
def q_shingle_jaccard(spark, sf):
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn", F.round(curate.shingle_jaccard("input", "output"), 6).alias("jaccard"))


_VERSE = f"array_to_string({filter_lines_sql('output')}, chr(10))"
_INP = clean_text_sql("input")


@register("flag_bad_pairs", f"""
WITH {PAIRS_CTE},
x AS (SELECT conv_id, turn, {_VERSE} AS verse, {_INP} AS inp,
             {filter_lines_sql('output')} AS st, len({filter_lines_sql('output')}) AS n_lines
      FROM pairs)
SELECT conv_id, turn, round({jaccard_sql('inp', 'verse')}, 6) AS jac,
       length(verse) AS len_verse, length(inp) AS len_input,
       list_bool_or(list_transform(st, lambda l: contains(lower(inp), lower(l)))) AS copied,
       n_lines,
       (coalesce({jaccard_sql('inp', 'verse')}, 0) > 0.7 OR abs(length(verse) - length(inp)) > 250
        OR coalesce(list_bool_or(list_transform(st, lambda l: contains(lower(inp), lower(l)))), false)) AS bad
FROM x""")
def q_flag_bad_pairs(spark, sf):
    f = curate.flag_bad_pairs(_pairs(spark, sf))
    return f.select("conv_id", "turn", F.round("jac", 6).alias("jac"),
                    F.col("len_verse").cast("long").alias("len_verse"),
                    F.col("len_input").cast("long").alias("len_input"),
                    "copied", F.col("n_lines").cast("long").alias("n_lines"), "bad")


@register("not_four_lines", f"""
WITH {PAIRS_CTE}
SELECT conv_id, turn, CAST(len({filter_lines_sql('output')}) AS BIGINT) AS n_lines
FROM pairs WHERE len({filter_lines_sql('output')}) <> 4""")
def q_not_four_lines(spark, sf):
    p = _pairs(spark, sf)
    n = F.size(T.filter_lines("output")).cast("long")
    return p.select("conv_id", "turn", n.alias("n_lines")).where(F.col("n_lines") != 4)


@register("drop_missing_inputs", f"""
WITH {PAIRS_CTE}
SELECT conv_id, turn, new_input AS input FROM pairs WHERE new_input IS NOT NULL""")
def q_drop_missing_inputs(spark, sf):
    """Attach the rewrite candidate and drop rows where it is missing."""
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn", F.col("new_input").alias("input")).na.drop(subset=["input"])


_NEW = clean_text_sql("new_input")
_BAD = f"""(coalesce({jaccard_sql('inp', 'verse')}, 0) > 0.7 OR abs(length(verse) - length(inp)) > 250
        OR coalesce(list_bool_or(list_transform(st, lambda l: contains(lower(inp), lower(l)))), false))"""


@register("conditional_update", f"""
WITH {PAIRS_CTE},
x AS (SELECT conv_id, turn, new_input, {_VERSE} AS verse, {filter_lines_sql('output')} AS st, {_INP} AS inp, {_NEW} AS new FROM pairs),
y AS (SELECT conv_id, turn, inp, new, new_input IS NOT NULL AND {_BAD} AND coalesce(
        {jaccard_sql('inp', 'verse')} > {jaccard_sql('new', 'verse')}
        OR abs(length(verse) - length(inp)) > abs(length(verse) - length(new)), false) AS upd FROM x)
SELECT conv_id, turn, CASE WHEN upd THEN new ELSE inp END AS input, upd AS updated FROM y""")
def q_conditional_update(spark, sf):
    return curate.conditional_update(_pairs(spark, sf))


@register("clean_text", f"""
SELECT doc_id, {clean_text_sql('text')} AS text FROM documents""")
def q_clean_text(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", T.clean_text("text").alias("text"))


@register("filter_lines", f"""
WITH {PAIRS_CTE}
SELECT conv_id, turn, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
FROM (SELECT conv_id, turn, {filter_lines_sql('output')} AS ls FROM pairs)""")
def q_filter_lines(spark, sf):
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn", F.posexplode(T.filter_lines("output")).alias("line_no", "line"))


@register("strip_markup", f"""
WITH {LINES_CTE}
SELECT doc_id, line_no,
  regexp_replace(regexp_replace(translate(text, chr(769) || chr(768), ''),
    '<rhyme[AB]>.*?</rhyme[AB]>', '', 'g'), '<[Ss][0-9]+>|<count[0-9]+>', '', 'g') AS text
FROM lines""")
def q_strip_markup(spark, sf):
    """Markup and stress-mark removal over every verse line."""
    lines = corpus.lines(documents(spark, sf))
    return lines.select("doc_id", "line_no", T.strip_markup(T.strip_diacritics("text")).alias("text"))


@register("strip_trailing_punct", f"""
WITH {LINES_CTE}
SELECT doc_id, line_no, regexp_replace(text, '[.?,!:;…\\-\\s]+$', '') AS text FROM lines""")
def q_strip_trailing_punct(spark, sf):
    lines = corpus.lines(documents(spark, sf))
    return lines.select("doc_id", "line_no", T.strip_trailing_punct("text").alias("text"))


_TOKS = "string_split_regex(l, '[.?,!:;…\\-\\s]')"
_OKW = "[" + ", ".join(f"'{w}'" for w in curate.REPEAT_OK) + "]"
_LINE_BAD = (f"coalesce(list_bool_or(list_transform(range(1, len({_TOKS}) + 1), lambda i: "
             f"(i + 2 <= len({_TOKS}) AND {_TOKS}[i] = {_TOKS}[i + 2] AND {_TOKS}[i + 1] = 'и' "
             f"AND NOT list_contains({_OKW}, {_TOKS}[i])) OR (i + 1 <= len({_TOKS}) AND {_TOKS}[i] = {_TOKS}[i + 1]))), false)")


@register("three_line_ok", f"""
WITH {PAIRS_CTE},
x AS (SELECT conv_id, turn, list_transform(string_split(output, chr(10)),
        lambda l: translate(regexp_replace(trim(l), '[.?,!:;…\\-\\s]+$', ''), 'ё', 'е')) AS ls FROM pairs)
SELECT conv_id, turn, CASE WHEN len(ls) <> 3 THEN false ELSE NOT (ls[1] = ls[2] OR ls[2] = ls[3] OR ls[1] = ls[3]
  OR list_bool_or(list_transform(ls, lambda l: {_LINE_BAD}))) END AS ok
FROM x""")
def q_three_line_ok(spark, sf):
    p = _pairs(spark, sf)
    return p.select("conv_id", "turn", curate.three_line_ok("output").alias("ok"))


@register("sentence_chunks", f"""
WITH paras AS (
  SELECT doc_id, unnest(range(len(ps))) AS para_no, unnest(ps) AS para
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
s AS (
  SELECT doc_id, para_no, unnest(range(len(ss))) AS sent_no, trim(unnest(ss)) AS chunk
  FROM (SELECT doc_id, para_no, {sentence_split_sql('trim(para)')} AS ss FROM paras WHERE trim(para) <> ''))
SELECT doc_id, para_no, sent_no, chunk FROM s WHERE length(chunk) BETWEEN 100 AND 140""")
def q_sentence_chunks(spark, sf):
    return curate.sentence_chunks(documents(spark, sf)).select(
        "doc_id", "para_no", "sent_no", "chunk")


@register("scan_prose_head", """
SELECT doc_id, source, line_no, rtrim(line) AS text
FROM (SELECT doc_id, source, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents))
WHERE line_no < 20000""")
def q_scan_prose_head(spark, sf):
    """First N=20000 lines of each document, right-trimmed, keyed by source."""
    d = documents(spark, sf, "doc_id", "source", "text")
    x = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return x.where(F.col("line_no") < 20000).select(
        "doc_id", "source", F.col("line_no").cast("long").alias("line_no"), F.rtrim("line").alias("text"))


# ---------------------------------------------------------------------------
# sampling and splits (seeded md5 order, global row numbers without a
# single-partition window)
# ---------------------------------------------------------------------------
def _chunks(spark, sf):
    return curate.sentence_chunks(documents(spark, sf))


_CHUNKS_SQL = f"""paras AS (
  SELECT doc_id, unnest(range(len(ps))) AS para_no, unnest(ps) AS para
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)),
s AS (
  SELECT doc_id, para_no, unnest(range(len(ss))) AS sent_no, trim(unnest(ss)) AS chunk
  FROM (SELECT doc_id, para_no, {sentence_split_sql('trim(para)')} AS ss FROM paras WHERE trim(para) <> '')),
chunks AS (SELECT * FROM s WHERE length(chunk) BETWEEN 100 AND 140)"""

_CHUNK_KEYS = ["doc_id", "para_no", "sent_no"]
_CHUNK_HASH = seeded_hash_sql("doc_id", "para_no", "sent_no")


@register("sample_without_replacement", f"""
WITH {_CHUNKS_SQL}
SELECT doc_id, para_no, sent_no, chunk FROM chunks
ORDER BY {_CHUNK_HASH}, doc_id, para_no, sent_no LIMIT 1000""")
def q_sample_without_replacement(spark, sf):
    """1000 chunks drawn without replacement (seeded hash order; the limit is
    the feature: a top-k that Spark plans as TakeOrderedAndProject)."""
    c = _chunks(spark, sf)
    h = sampling.seeded_hash(*_CHUNK_KEYS)
    return c.orderBy(h, *_CHUNK_KEYS).limit(1000).select(*_CHUNK_KEYS, "chunk")


@register("assign_by_position", f"""
WITH {_CHUNKS_SQL},
pick AS (SELECT doc_id, para_no, sent_no, chunk,
                row_number() OVER (ORDER BY {_CHUNK_HASH}, doc_id, para_no, sent_no) - 1 AS req_id
         FROM chunks QUALIFY req_id < 1000)
SELECT req_id, chunk AS text,
       CASE WHEN req_id < 333 THEN 'AABB' WHEN req_id < 666 THEN 'ABAB' ELSE 'ABBA' END AS rhyme_scheme,
       CASE WHEN req_id % 2 = 0 THEN 'choreios' ELSE 'iambos' END AS meter
FROM pick""")
def q_assign_by_position(spark, sf):
    """Prose requests: scheme by row range 333/333/334, metre alternating."""
    from cadenza.operators.requests import prose_requests
    return prose_requests(_chunks(spark, sf)).select("req_id", "text", "rhyme_scheme", "meter")


_LINE_HASH = seeded_hash_sql("doc_id", "line_no")


@register("shuffle_rows", f"""
WITH {LINES_CTE}
SELECT doc_id, line_no, row_number() OVER (ORDER BY {_LINE_HASH}, doc_id, line_no) - 1 AS new_index
FROM lines""")
def q_shuffle_rows(spark, sf):
    lines = corpus.lines(documents(spark, sf)).select("doc_id", "line_no")
    return sampling.shuffle_rows(lines, ["doc_id", "line_no"]).select("doc_id", "line_no", "new_index")


@register("train_test_split", f"""
WITH {LINES_CTE},
r AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY {_LINE_HASH}, doc_id, line_no) AS rn,
             count(*) OVER () AS total FROM lines)
SELECT doc_id, line_no, rn,
  CASE WHEN rn <= 1000 THEN 'test' WHEN rn <= 11000 THEN 'train' ELSE 'pretrain' END AS split,
  CAST(CASE WHEN rn > 11000 THEN CASE WHEN (total - 11000) // 5 <= 0 THEN 4
       ELSE least((rn - 11001) // ((total - 11000) // 5), 4) END END AS INTEGER) AS shard
FROM r""")
def q_train_test_split(spark, sf):
    """Test 1000 / train 10000 / rest in 5 pretrain shards over verse lines."""
    lines = corpus.lines(documents(spark, sf)).select("doc_id", "line_no")
    return sampling.train_test_split(lines, ["doc_id", "line_no"])


@register("split_90_10", f"""
WITH {LINES_CTE},
r AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY {_LINE_HASH}, doc_id, line_no) AS rn,
             count(*) OVER () AS total FROM lines)
SELECT doc_id, line_no, CASE WHEN rn <= floor(total * 0.9) THEN 'train' ELSE 'test' END AS split FROM r""")
def q_split_90_10(spark, sf):
    lines = corpus.lines(documents(spark, sf)).select("doc_id", "line_no")
    return sampling.split_fraction(lines, ["doc_id", "line_no"], 0.9)


# ---------------------------------------------------------------------------
# training rows and batching of the prose requests
# ---------------------------------------------------------------------------
# Short metre names used in training prompts.
SHORT_METRES = [("iambos", "ямб"), ("choreios", "хорей"), ("dolnik3", "дольник"),
                ("amphibrachys", "амфибрахий"), ("anapaistos", "анапест"),
                ("daktylos", "дактиль"), ("dolnik2", "дольник")]
# Training prompt formats (with and without source text).
PROMPT_HEAD = "Преобразуй прозу в четверостишие с параметрами:\n Рифмовка: "
PROMPT_GEN_HEAD = "Напиши четверостишие с параметрами:\n Рифмовка: "
PROMPT_METRE = "\n Размер: "
PROMPT_TEXT = "\n Исходный текст: "

_REQ_SQL = f"""{_CHUNKS_SQL},
pick AS (SELECT doc_id, para_no, sent_no, chunk,
                row_number() OVER (ORDER BY {_CHUNK_HASH}, doc_id, para_no, sent_no) - 1 AS req_id
         FROM chunks),
req AS (SELECT req_id, chunk AS text,
          CASE WHEN req_id % 1000 < 333 THEN 'AABB' WHEN req_id % 1000 < 666 THEN 'ABAB' ELSE 'ABBA' END AS rhyme_scheme,
          CASE WHEN req_id % 2 = 0 THEN 'choreios' ELSE 'iambos' END AS meter FROM pick)"""


def _requests(spark, sf):
    from cadenza.operators.requests import all_requests
    return all_requests(_chunks(spark, sf))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SHORT_CASE = "CASE meter " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHORT_METRES) + " ELSE meter END"


@register("training_rows", f"""
WITH {_REQ_SQL}
SELECT req_id,
  {_sql_str(PROMPT_HEAD)} || rhyme_scheme || {_sql_str(PROMPT_METRE)} || {_SHORT_CASE} || {_sql_str(PROMPT_TEXT)} || text AS prompt,
  {_sql_str(PROMPT_GEN_HEAD)} || rhyme_scheme || {_sql_str(PROMPT_METRE)} || {_SHORT_CASE} || chr(10) AS generate_prompt
FROM req""")
def q_training_rows(spark, sf):
    """Training prompts per request (metre name through a small lookup table,
    broadcast: seven rows)."""
    r = _requests(spark, sf)
    names = spark.createDataFrame(SHORT_METRES, "meter string, short string")
    # a metre without a short name is written as it is
    j = r.join(F.broadcast(names), "meter", "left").withColumn("short", F.coalesce("short", "meter"))
    prompt = F.concat(F.lit(PROMPT_HEAD), F.col("rhyme_scheme"), F.lit(PROMPT_METRE), F.col("short"),
                      F.lit(PROMPT_TEXT), F.col("text"))
    gen = F.concat(F.lit(PROMPT_GEN_HEAD), F.col("rhyme_scheme"), F.lit(PROMPT_METRE), F.col("short"), F.lit("\n"))
    return j.select("req_id", prompt.alias("prompt"), gen.alias("generate_prompt"))


@register("row_batches", f"""
WITH {_REQ_SQL}
SELECT req_id, CAST(req_id // 15 AS BIGINT) AS batch_id FROM req""")
def q_row_batches(spark, sf):
    """Numbered groups of 15 requests (the unit of resumable batch writes)."""
    return _requests(spark, sf).select("req_id", F.floor(F.col("req_id") / 15).cast("long").alias("batch_id"))


@register("length_grouping", f"""
WITH {_REQ_SQL}
SELECT req_id, CAST((row_number() OVER (ORDER BY length(text), req_id) - 1) // 15 AS BIGINT) AS batch_id FROM req""")
def q_length_grouping(spark, sf):
    """Batches of 15 requests of similar length (sorted by length)."""
    r = _requests(spark, sf).withColumn("len", F.length("text"))
    # one length may hold many requests: its numbers are cut further
    n = sampling.global_row_number(r, [F.col("len"), F.col("req_id")],
                                   [F.col("len"), F.floor(F.col("req_id") / 65536)])
    return n.select("req_id", F.floor((F.col("rn") - 1) / 15).cast("long").alias("batch_id"))


# Fixed values (ours): verse formats and their line counts.
FORMATS = [("one_liner", 1), ("couplet", 2), ("quatrain", 4)]
# Control text that must not appear in a generated candidate.
CONTROL_TEXT = ["<pad>", "<s>", "</s>", "<unk>", "<mask>", "<nl>", "|"]


@register("line_count_ok", f"""
WITH {PAIRS_CTE},
f(format, n_lines) AS (VALUES {', '.join(f"('{a}', {b})" for a, b in FORMATS)}),
c AS (SELECT conv_id, turn, len(list_filter(list_transform(string_split(output, chr(10)), lambda x: trim(x)),
                                            lambda x: x <> '')) AS n FROM pairs)
SELECT c.conv_id, c.turn, f.format FROM c JOIN f ON f.n_lines = c.n""")
def q_line_count_ok(spark, sf):
    """Candidates whose non-empty line count equals a format's (broadcast
    join to the three-row format table)."""
    from cadenza.operators.scores import nonblank_lines
    p = _pairs(spark, sf).select("conv_id", "turn", F.size(nonblank_lines(F.col("output"))).alias("n"))
    f = spark.createDataFrame(FORMATS, "format string, n_lines int")
    return p.join(F.broadcast(f), p["n"] == f["n_lines"]).select("conv_id", "turn", "format")


@register("bad_substring", f"""
WITH {PAIRS_CTE}
SELECT conv_id, turn FROM pairs
WHERE NOT ({' OR '.join(f"contains(output, '{c}')" for c in CONTROL_TEXT)})""")
def q_bad_substring(spark, sf):
    """Candidates kept after dropping those that contain control text."""
    p = _pairs(spark, sf)
    bad = None
    for c in CONTROL_TEXT:
        cond = F.col("output").contains(c)
        bad = cond if bad is None else bad | cond
    return p.where(~bad).select("conv_id", "turn")
