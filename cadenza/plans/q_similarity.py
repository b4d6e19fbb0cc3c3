"""Near-copy and soft-match queries (documents vs the indexed benchmark)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import similarity as S
from cadenza.plans.registry import register
from cadenza.plans.sqlbits import shingles_chars_sql
from cadenza.sources.fixtures import documents, table


_NEAR_SQL = f"""bidx AS (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text),
dch AS MATERIALIZED (SELECT doc_id, {shingles_chars_sql("string_split(text, '')")} AS s,
                           {shingles_chars_sql("string_split(lower(text), '')")} AS sl FROM DOCS_SRC),
bch AS MATERIALIZED (SELECT item_id, {shingles_chars_sql("string_split(text, '')")} AS s,
                           {shingles_chars_sql("string_split(lower(text), '')")} AS sl FROM bidx),
dsh AS (SELECT doc_id, unnest(s) AS sh FROM dch),
bsh AS (SELECT item_id, unnest(s) AS sh FROM bch),
cs AS (SELECT d.doc_id, b.item_id, count(*) AS shared FROM dsh d JOIN bsh b USING (sh) GROUP BY d.doc_id, b.item_id),
top AS (SELECT doc_id, item_id, shared,
               row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS rank
        FROM cs QUALIFY rank <= 100)"""


def _index(spark, sf):
    return table(spark, sf, "benchmark", "item_id", "text")


_NEAR_SQL = _NEAR_SQL.replace("DOCS_SRC", "documents")


@register("shingle_candidates", f"""
WITH {_NEAR_SQL}
SELECT doc_id, item_id, shared FROM top""")
def q_shingle_candidates(spark, sf):
    idx = S.distinct_docs(_index(spark, sf), "item_id")
    return S.top_shared(documents(spark, sf), idx, 100).select("doc_id", "item_id", "shared")


@register("top_shared", f"""
WITH {_NEAR_SQL}
SELECT doc_id, item_id, shared, CAST(rank AS INTEGER) AS rank FROM top""")
def q_top_shared(spark, sf):
    idx = S.distinct_docs(_index(spark, sf), "item_id")
    return S.top_shared(documents(spark, sf), idx, 100)


NOVELTY_SQL = f"""bidx AS (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text),
dch AS MATERIALIZED (SELECT doc_id, {shingles_chars_sql("string_split(lower(text), '')")} AS sl FROM DOCS_SRC),
bch AS MATERIALIZED (SELECT item_id, {shingles_chars_sql("string_split(lower(text), '')")} AS sl FROM bidx),
dl AS (SELECT doc_id, len(sl) AS n_doc, unnest(sl) AS sh FROM dch),
bl AS (SELECT item_id, len(sl) AS n_item, unnest(sl) AS sh FROM bch),
lc AS (SELECT dl.doc_id, bl.item_id, dl.n_doc, bl.n_item, count(*) AS shared
       FROM dl JOIN bl USING (sh) GROUP BY dl.doc_id, bl.item_id, dl.n_doc, bl.n_item),
best AS (SELECT doc_id, max(shared / (n_doc + n_item - shared + 1e-6)) AS novelty FROM lc GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(best.novelty, 0.0), 6) AS novelty,
       round(coalesce(best.novelty, 0.0), 6) < 0.9 AS passes
FROM DOCS_SRC d LEFT JOIN best USING (doc_id)"""


@register("novelty_score", f"""
WITH {NOVELTY_SQL.replace("DOCS_SRC", "documents")}""")
def q_novelty_score(spark, sf):
    return S.novelty_score(documents(spark, sf), _index(spark, sf))


@register("distinct_docs", """
SELECT text, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text""")
def q_distinct_docs(spark, sf):
    return S.distinct_docs(documents(spark, sf), "doc_id").select("text", "doc_id", "n_copies")


_SOFT_SQL = """
WITH v AS (SELECT CAST(label AS BIGINT) AS label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
labs AS (SELECT DISTINCT label FROM v),
pairs AS (SELECT a.label AS cand, b.label AS ref FROM labs a JOIN labs b ON b.label = a.label + 1),
sims AS (SELECT p.cand, p.ref, x.vec_id AS xa, y.vec_id AS yb,
                list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) AS c
         FROM pairs p JOIN v x ON x.label = p.cand JOIN v y ON y.label = p.ref),
pr AS (SELECT cand, ref, avg(m) AS p FROM (SELECT cand, ref, xa, max(c) AS m FROM sims GROUP BY cand, ref, xa) GROUP BY cand, ref),
rc AS (SELECT cand, ref, avg(m) AS r FROM (SELECT cand, ref, yb, max(c) AS m FROM sims GROUP BY cand, ref, yb) GROUP BY cand, ref)
SELECT cand, ref, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1
FROM pr JOIN rc USING (cand, ref)"""


@register("soft_match_score", _SOFT_SQL)
def q_soft_match_score(spark, sf):
    """Bag ``label`` (candidate) against bag ``label + 1`` (reference)."""
    vec = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    labs = vec.select(F.col("label").cast("long").alias("cand")).distinct()
    pairs = labs.join(labs.select((F.col("cand") - 1).alias("cand"), F.col("cand").alias("ref")), "cand")
    out = S.soft_match_score(vec, pairs)
    return out.select("cand", "ref", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
