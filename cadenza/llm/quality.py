"""Operator 10, quality: interpolated modified Kneser-Ney model of character
four-grams, trained on trusted text.

Symbols are characters as they stand (every code point one of its own, no folding).
Training counts the four-grams of every trusted text (pre-aggregated per block,
then per gram).  Continuation counts, context totals and context types of each
order follow by grouping, and the interpolated probabilities by joining, order by
order, grams with their contexts and with their lower-order probabilities.  All
these tables are Spark tables sharded by gram; they grow with the trusted text, and
none of them is broadcast or collected.

The texts are written once, compressed, in blocks of about ``BLOCK_BYTES`` with the
distinct grams of each block, in buckets by block number; the numbers of a block's trusted texts and
later the probabilities of its grams come to it, so no text is shuffled.  For scoring, the distinct grams of all blocks meet the model by joins (a gram that
is not in it backs off to its context's weight and the lower order), and the
probabilities return to the blocks by gram.  So a join row is a (block, gram) and not
a (document, gram); a gram has at most one row in each block, so no key is hot.

Perplexity is per character.  A text is kept if its perplexity is at most the
``QUANTILE`` of the trusted texts of its language; ``basis`` says whether its language has any
(``language``) or not (``none``: there is no threshold and the text is kept).  A character that no
trusted text has is the unknown symbol, one more beside the seen ones.

Cases: null and empty texts have no perplexity and are kept (nothing speaks
against them); null language counts as a language of its own; without trusted
text the unknown symbol is the only one, every perplexity is 1 and everything is
kept; very long texts are scored whole; repeated rows are scored each; further
columns pass through.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import arrow_ready, keep, keep_bucketed, nullable, shield
from cadenza.llm.words import pieces

ORDER = 4
QUANTILE = 0.995
#: Bytes of text whose distinct grams are looked up together
BLOCK_BYTES = 16 << 20


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from counts of counts."""
    n = dict.fromkeys((1, 2, 3, 4), 0) | {r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n[1] or not n[2]:
        return 0.5, 0.75, 0.9
    y = n[1] / (n[1] + 2 * n[2])
    return (1 - 2 * y * n[2] / n[1], max(0.0, 2 - 3 * y * n[3] / n[2]), max(0.0, 3 - 4 * y * n[4] / n[3]) if n[3] else 0.9)


def _context(g: Column, k: int, symbols: int) -> Column:
    """A gram of order ``k`` without its last symbol."""
    return F.floor(g / symbols) if symbols else F.substring(g, 1, k - 1)


def _lower(g: Column, k: int, symbols: int) -> Column:
    """A gram of order ``k`` without its first symbol."""
    return g % symbols ** (k - 1) if symbols else F.substring(g, 2, k - 1)


def probabilities(c4: DataFrame, base: float, symbols: int = 0) -> list[tuple[DataFrame, DataFrame]]:
    """Per order 1 to 4: ``(g, p)`` interpolated probabilities of the seen grams and
    ``(ctx, gamma)`` weights of the lower order.  Grams are strings of characters, or numbers to
    the base ``symbols``; ``base`` is the probability below order 1."""
    counts = [c4]
    g = F.col("g")
    for k in range(ORDER - 1, 0, -1):            # grams of order k followed by how many left neighbours
        counts.insert(0, keep(counts[0].select(_lower(g, k + 1, symbols).alias("g")).groupBy("g")
                              .agg(F.count(F.lit(1)).alias("c")), f"quality-c{k}"))
    out, lower = [], None
    for k, c in enumerate(counts, 1):
        d = discounts(c)
        disc: Column = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = c.select("g", "c", _context(g, k, symbols).alias("ctx"), _lower(g, k, symbols).alias("low"), disc.alias("d"))
        ctx = keep(rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
                   .withColumn("gamma", F.col("mass") / F.col("total")), f"quality-x{k}")
        j = rows.join(ctx, "ctx")
        j = j.withColumn("q", F.lit(base)) if lower is None else j.join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
        lower = keep(j.select("g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")), f"quality-p{k}")
        out.append((lower, ctx.select("ctx", "gamma")))
    return out


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(distinct four-grams as strings, index of each character's gram, its text number)``
    of all texts (three borders before each), over the whole alphabet.
    A NUL character in a text counts as a border and is not predicted."""
    pad = "\0" * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    seen[0] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    rank = np.zeros(0x110000, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    s, size = rank[points], len(alphabet)
    m = max(0, len(s) - ORDER + 1)
    real = np.flatnonzero(s[ORDER - 1:] != 0)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
    text = np.repeat(np.arange(len(texts)), n)[ORDER - 1:][real]
    left, right = (s[:m] * size + s[1:m + 1])[real], (s[2:m + 2] * size + s[3:m + 3])[real]
    pairs, width = None, size * size
    if width > 2 ** 31:                          # too many symbols for one integer: rank the pairs that occur
        pairs = np.unique(np.concatenate([left, right]))
        left, right, width = np.searchsorted(pairs, left), np.searchsorted(pairs, right), len(pairs)
    g, at = np.unique(left * width + right, return_inverse=True)
    left, right = g // width, g % width
    if pairs is not None:
        left, right = pairs[left], pairs[right]
    chars = np.stack([alphabet[x] for x in (left // size, left % size, right // size, right % size)], axis=1)
    return np.ascontiguousarray(chars).view(f"<U{ORDER}").ravel(), at, text


def _pack(texts: list[str]) -> bytes:
    return zlib.compress(json.dumps(texts, ensure_ascii=False).encode("utf-8"))


def _unpack(raw: bytes) -> list[str]:
    return json.loads(zlib.decompress(raw))


def _blocks(cols: list[str]):
    """The rows with their block and number in it, and for each block a row with number -1
    that has its texts (compressed pieces) and its distinct grams, sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*cols, "block", "at", "texts", "grams"]

        def closing() -> pa.RecordBatch:
            grams = np.unique(np.concatenate(own)).tolist()
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.array([block]), pa.array([-1]),
                                               pa.array([packed], pa.list_(pa.binary())), pa.array([grams], pa.list_(pa.string()))], names)
        block, at, size, packed, own = uuid.uuid4().int >> 65, 0, 0, [], []
        for batch in batches:
            types = [batch.schema.field(c).type for c in cols]
            for part in pieces(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = len(texts)
                packed.append(_pack(texts))
                own.append(text_grams(texts)[0])
                size += sum(map(len, texts)) + 64 * n
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in cols), pa.array(np.full(n, block, np.int64)), pa.array(np.arange(at, at + n)),
                     pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.string()))], names)
                at += n
                if size >= BLOCK_BYTES:
                    yield closing()
                    block, at, size, packed, own = uuid.uuid4().int >> 65, 0, 0, [], []
        if packed:
            yield closing()
    return run


def blocks_of(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``block, at, texts, grams`` (see :func:`_blocks`), written once."""
    spark = docs.sparkSession
    arrow_ready(spark)
    cols = [c for c in docs.columns if c != "text"]
    own = T.StructType.fromDDL("block long, at long, texts array<binary>, grams array<string>")
    schema = nullable(T.StructType([*(f for f in docs.schema if f.name != "text"), *own]))
    # in buckets by block: what is joined to a block comes to it, its texts stay
    return keep_bucketed(docs.mapInArrow(_blocks(cols), schema), "quality_blocks", "block")


def _count_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            chosen = set(batch.column("chosen")[row].as_py())
            first = 0
            for raw in batch.column("texts").slice(row, 1).flatten():
                texts = _unpack(raw.as_py())
                g, at, _ = text_grams([t for i, t in enumerate(texts, first) if i in chosen])
                first += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(g.tolist(), pa.string()), pa.array(np.bincount(at, minlength=len(g)).astype(np.int64))], ["g", "n"])


def trusted_counts(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(g, c)``: the four-grams, as strings, of the texts whose id is in ``trusted``
    (``doc_id``), and their numbers."""
    t = trusted.select("doc_id").where("doc_id is not null").distinct()
    chosen = blocks.where("at >= 0").select("block", "at", "doc_id").join(t, "doc_id", "left_semi").groupBy("block").agg(
        F.collect_list("at").alias("chosen"))
    return (blocks.where("at = -1").select("block", "texts").join(chosen, "block").mapInArrow(_count_chosen, "g string, n long")
            .groupBy("g").agg(F.sum("n").alias("c")))


def _perplexities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            block, parts = batch.column("block")[row].as_py(), []
            for raw in batch.column("texts").slice(row, 1).flatten():
                texts = _unpack(raw.as_py())
                g, at, text = text_grams(texts)
                parts.append((g, at.astype(np.int32), text.astype(np.int32), len(texts)))
            grams = np.unique(np.concatenate([g for g, *_ in parts]))
            pos, found = batch.column("found").slice(row, 1).flatten().flatten()
            logp = np.zeros(len(grams))
            logp[pos.to_numpy()] = found.to_numpy()
            first = 0
            for g, at, text, size in parts:
                n = np.bincount(text, minlength=size)
                ppl = np.exp(-np.bincount(text, logp[np.searchsorted(grams, g)][at], size) / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, block, np.int64)), pa.array(np.arange(first, first + size)),
                                                  pa.array(ppl, mask=n == 0)], ["block", "at", "perplexity"])
                first += size


def log_probabilities(grams: DataFrame, orders: list[tuple[DataFrame, DataFrame]], base: float) -> DataFrame:
    """``(g, logp)`` of the distinct four-grams ``g``: those of the model, else the weight
    of the context (1 if the model has none) times the lower order."""
    p: Column = F.lit(base)
    d = grams
    for k, (seen, ctx) in enumerate(orders, 1):
        own = F.substring(F.col("g"), ORDER - k + 1, k)
        d = d.withColumn("_g", own).withColumn("_c", F.substring(own, 1, k - 1))
        ctx = ctx.select(F.col("ctx").alias("_c"), F.col("gamma").alias(f"_w{k}"))
        d = (d.join(seen.select(F.col("g").alias("_g"), F.col("p").alias(f"_p{k}")), "_g", "left")
             .join(F.broadcast(ctx) if k == 1 else ctx, "_c", "left").drop("_g", "_c"))     # order 1 has one context
        p = F.coalesce(F.col(f"_p{k}"), F.coalesce(F.col(f"_w{k}"), F.lit(1.0)) * p)
    return d.select("g", F.log(F.greatest(p, F.lit(1e-30))).alias("logp"))


def train(blocks: DataFrame, trusted: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], float]:
    """The tables of every order, and the probability of each symbol below order 1."""
    c4 = keep(trusted_counts(blocks, trusted), "quality-c4")
    base = 1.0 / (c4.select(F.substring("g", ORDER, 1).alias("s")).distinct().count() + 1)
    return probabilities(c4, base), base


def perplexity(blocks: DataFrame, model: tuple[list[tuple[DataFrame, DataFrame]], float]) -> DataFrame:
    """The rows of ``blocks`` with ``perplexity``."""
    own = blocks.where("at = -1")
    asked = own.select("block", F.posexplode("grams").alias("pos", "g"))
    logp = keep(log_probabilities(asked.select("g").distinct(), *model), "quality-logp")
    found = asked.join(logp, "g").groupBy("block").agg(F.collect_list(F.struct("pos", "logp")).alias("found"))
    texts = own.select("block", "texts").join(found, "block", "left")
    texts = texts.withColumn("found", F.coalesce("found", F.array().cast("array<struct<pos:int,logp:double>>")))
    scores = texts.mapInArrow(_perplexities, "block long, at long, perplexity double")
    rows = blocks.where("at >= 0").drop("texts", "grams")
    return rows.join(scores, ["block", "at"]).drop("block", "at")


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` without text, with ``perplexity``, ``threshold``, ``basis`` and ``kept``."""
    results = ("perplexity", "threshold", "basis", "kept")
    kept = ("doc_id", "lang", "text")
    blocks = blocks_of(shield(docs.drop(*results), *kept))
    rows = keep(perplexity(blocks, train(blocks, trusted)), "quality-scores")
    t = trusted.select("doc_id").where("doc_id is not null").distinct()
    known = rows.where("perplexity is not null").join(t, "doc_id", "left_semi")
    own = known.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("_q"))   # one row per language
    j = rows.join(F.broadcast(own.withColumnRenamed("lang", "_l")), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
    rest = [F.col(f"_row.`{c}`") for c in docs.columns if c not in kept + results]
    ok = F.col("perplexity").isNull() | F.col("_q").isNull() | (F.col("perplexity") <= F.col("_q"))
    basis = F.when(F.col("_q").isNull(), "none").otherwise("language")
    return j.select("doc_id", "lang", *rest, "perplexity", F.col("_q").alias("threshold"), basis.alias("basis"), ok.alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Labelled as good and not toxic."""
    return labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()
