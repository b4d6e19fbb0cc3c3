"""The registered queries of the subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_histogram_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.shard import histogram_shards
    s = histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query("op2_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.exact import exact_groups, normalised
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.withColumn("text_sha256", F.sha2(normalised().cast("binary"), 256))
    return exact_groups(d).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_file() -> str:
    """The public byte-level vocabulary (a parameter of the packing operator)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_min_slack_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.pack import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op7_ordinal_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.toxic import grades, score, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, grades(table(spark, sf_dir, "labels")))
    return score(docs, model).drop("text")


@query("op9_dart_minhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.near import near_classes
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_template_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.decon import flag_contaminated
    return flag_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op3_boosted_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.pii import KINDS, find_pii, of_kind, span_string
    r = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return r.select("doc_id", *n, F.sha2(span_string(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    span_string(F.col("spans")).alias("spans"))


def _op6_sql() -> str:
    from cadenza.llm.license import oracle
    return oracle()


@query("op6_dice_licenses", _op6_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.license import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_tool_call_linking")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.chat import link_calls
    return link_calls(table(spark, sf_dir, "conversations"))


@query("op10_kneser_ney_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.quality import quality, trusted_ids
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality(docs, trusted_ids(table(spark, sf_dir, "labels")))


#: CRC-32 in SQL: ``tab.t`` is the byte table, ``crc(bytes)`` folds it over a list of bytes
_CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def _crc(text: str) -> str:
    byte = f"(strpos('0123456789ABCDEF', hex(encode({text}))[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(encode({text}))[2 * i + 2]) - 1"
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), "
            "lambda c, b: xor(t[(xor(c & 255, b) + 1)::INT], c >> 8)), 4294967295)")


@query("op11_kd_spelling_variants", rf"""
WITH {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
low AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d,
               translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
        FROM runs WHERE length(r) >= 7 GROUP BY ALL),
hashed AS (SELECT w, n, {_crc("d || w")} AS h FROM low, tab),
lost AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM words, unnest(range(length(word))) AS u(i)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS k, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near),
form AS (SELECT w.word, w.n, coalesce(k, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
         FROM words w LEFT JOIN ranked x ON w.word = x.word AND x.r = 1),
up AS (SELECT word, form AS root FROM form WHERE form IS NOT NULL),
climb AS (WITH RECURSIVE c AS (SELECT word, root FROM up UNION ALL SELECT c.word, up.root FROM c JOIN up ON c.root = up.word) SELECT * FROM c)
SELECT f.word, f.form, coalesce((SELECT c.root FROM climb c WHERE c.word = f.word AND c.root NOT IN (SELECT word FROM up)), f.word) AS root,
       f.n, f.n_near, f.form_n
FROM form f
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.variants import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


_WORDS12 = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@query("op12_crc_resampling", rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, row_number() OVER () AS mark, {_WORDS12} AS ws FROM documents),
dw AS (SELECT mark, unnest(ws) AS w FROM d),
tw AS (SELECT unnest({_WORDS12}) AS w FROM benchmark),
bucket AS (SELECT w, {_crc("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw), tab),
s AS (SELECT b, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM tw JOIN bucket USING (w) GROUP BY b),
gain AS (SELECT x.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE /
                ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
         FROM unnest(range(10000)) AS x(b) LEFT JOIN s ON x.b = s.b LEFT JOIN t ON x.b = t.b),
sums AS (SELECT mark, sum(g)::BIGINT AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY mark),
scored AS (SELECT doc_id, mark, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM d LEFT JOIN sums USING (mark)),
drawn AS (SELECT mark, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= able * 10 // 100 THEN r END AS rank
FROM scored LEFT JOIN drawn USING (mark)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.resample import resample
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op13_fm_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(ws) - 11)) AS u(i)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN first USING (k), unnest(range(13)) AS v(j) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.substrings import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")
