"""Operator 12, target-distribution importance resampling.

Word features (runs of 1 to ``max_n`` words) fall into hashed buckets; a bucket's gain is
the log ratio of its smoothed share in the target to its share in the corpus, a document's
weight is the sum of its features' gains, and Gumbel noise on top makes the highest scores
a sample drawn without replacement in proportion to ``exp(weight)``.

The bucket hash is a CRC-32 taken of all features of a batch at once.  CRC is linear over
XOR: byte ``b`` with ``d`` bytes behind it contributes ``TABLE[d][b]`` whatever the other
bytes are, and the length alone adds a constant.  So contributions are looked up by (distance
from the end, byte) and folded with ``bitwise_xor.reduceat`` over the feature spans.  A span
longer than the table is cut into blocks from its end, which are folded one after the other
with the operator that moves a value over ``BLOCK`` bytes.

Two passes over the texts: bucket counts (summed inside each task, at most ``buckets`` rows
each), then scores.  Only the bucket counts and histograms of fixed size reach the driver.
The highest scores are found by a histogram that is refined until its border cell is small,
then range-sorted and numbered by partition offsets; no task sees all of them.

Cases: null text has no features (weight 0); null doc_id counts as the empty string in the
noise and sorts before all others among ties; repeated rows are drawn separately (equal
scores, any order); an empty corpus gives an empty result and an empty target only smooths;
features of any length are hashed whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_ready, keep
from cadenza.llm.words import pieces

BLOCK = 64           # bytes covered by the position table
POLYNOMIAL = 0xEDB88320
CELLS = 4096         # histogram cells of one refinement round

# bytes of words: digits, letters, and all bytes of characters beyond ASCII
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """``position[d, b]``: contribution of byte ``b`` with ``d`` bytes behind it;
    ``shift[j, v]``: what byte ``j`` of a value, being ``v``, becomes ``BLOCK`` bytes on."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)

    def over(x: np.ndarray) -> np.ndarray:      # one zero byte further
        return (x >> np.uint32(8)) ^ step[x & np.uint32(255)]
    position = np.empty((BLOCK, 256), dtype=np.uint32)
    position[0] = step
    for d in range(1, BLOCK):
        position[d] = over(position[d - 1])
    shift = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(BLOCK):
        shift = over(shift)
    return position, shift


@lru_cache(4096)
def length_constant(n: int) -> int:
    """CRC-32 of ``n`` zero bytes: all that the length contributes."""
    return zlib.crc32(bytes(n))


def crc32_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start:start + length]`` for every span (spans may overlap)."""
    position, shift = _tables()
    out = np.zeros(len(start), dtype=np.uint32)
    full = np.flatnonzero(length > 0)
    if not len(full):
        return out
    s, n = start[full].astype(np.int64), length[full].astype(np.int64)
    blocks = -(-n // BLOCK)
    first = np.cumsum(blocks) - blocks
    own = np.repeat(np.arange(len(full)), blocks)
    nth = np.arange(len(own)) - first[own]
    stop = s[own] + n[own] - BLOCK * (blocks[own] - 1 - nth)    # blocks are aligned with the end
    begin = np.maximum(s[own], stop - BLOCK)
    size = stop - begin
    at = np.cumsum(size) - size
    behind = np.repeat(at + size - 1, size) - np.arange(int(size.sum()))
    byte = data[np.repeat(begin - at, size) + np.arange(len(behind))]
    value = np.bitwise_xor.reduceat(position.ravel()[behind * 256 + byte], at)
    crc = value[first]
    for j in range(1, int(blocks.max())):
        more = np.flatnonzero(blocks > j)
        c = crc[more]
        moved = shift[0, c & 255] ^ shift[1, (c >> 8) & 255] ^ shift[2, (c >> 16) & 255] ^ shift[3, c >> 24]
        crc[more] = moved ^ value[first[more] + j]
    lengths, which = np.unique(n, return_inverse=True)
    constant = np.array([length_constant(int(x)) for x in lengths], dtype=np.uint32)
    out[full] = crc ^ constant[which]
    return out


def word_features(texts: pa.Array, max_n: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 1 to ``max_n`` consecutive words of each text, lower-cased in A-Z and joined by
    one space: ``(crc, text index, words per text)``, grouped by run length, in text order."""
    t = pa.array(texts, pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    t = t.fill_null("")
    bounds = np.frombuffer(t.buffers()[1], dtype=np.int64)[t.offset:t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = WORD_BYTE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    starts[edge] = inside[edge]                     # no word runs over the end of a text
    at = np.flatnonzero(starts)
    text = np.searchsorted(bounds, at, side="right") - 1
    words = np.bincount(text, minlength=len(t)).astype(np.int64)
    held = np.flatnonzero(inside)
    number = np.cumsum(starts)[held] - 1            # word of each byte
    length = np.bincount(number, minlength=len(at)).astype(np.int64)
    joined = np.full(len(held) + len(at), 32, dtype=np.uint8)
    joined[np.arange(len(held)) + number] = data[held]
    begin = np.cumsum(length + 1) - (length + 1)
    crc, owner = [], []
    for k in range(1, max_n + 1):
        m = max(0, len(at) - k + 1)
        ok = np.flatnonzero(text[:m] == text[k - 1:k - 1 + m])
        crc.append(crc32_spans(joined, begin[ok], begin[ok + k - 1] + length[ok + k - 1] - begin[ok]))
        owner.append(text[ok])
    return np.concatenate(crc), np.concatenate(owner), words


def bucket_counts(docs: DataFrame, buckets: int = 10_000, max_n: int = 1) -> dict[int, int]:
    """Features of all texts by bucket (at most ``buckets`` entries)."""
    arrow_ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for p in pieces(batch):
                crc, _, _ = word_features(p.column("text"), max_n)
                total += np.bincount(crc % buckets, minlength=buckets)
        b = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(total[b])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in rows.collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(((target.get(b, 0) + 1) * (s_all + buckets)) /
                                                ((corpus.get(b, 0) + 1) * (t_all + buckets))))
                     for b in range(buckets)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, fixed by document and seed."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = 2024, max_n: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    arrow_ready(docs.sparkSession)
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch):
                crc, owner, words = word_features(p.column("text"), max_n)
                n = np.bincount(owner, minlength=p.num_rows).astype(np.int64)
                weight = np.zeros(p.num_rows, dtype=np.int64)
                np.add.at(weight, owner, gain[crc % buckets])
                ids = p.column("doc_id").to_pylist()
                total = weight + np.array([noise(i, seed) for i in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(words), pa.array(n), pa.array(weight), pa.array(total)],
                    ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long, score long")


def border(scored: DataFrame, k: int, slack: int = 10_000) -> int:
    """A score at or above which there are at least ``k`` rows, and not many more than ``k``
    (at most ``slack`` more, unless that many share one score).  A round counts ``CELLS``
    equal cells; the cell that holds the k-th row is cut again."""
    ends = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi, above = ends["lo"], ends["hi"], 0       # rows above hi
    while True:
        width = (hi - lo) // CELLS + 1
        cell = F.floor((F.col("score") - F.lit(lo)) / F.lit(width))
        part = scored.where((F.col("score") >= lo) & (F.col("score") <= hi))
        counts = sorted(((r["cell"], r["count"]) for r in part.groupBy(cell.alias("cell")).count().collect()), reverse=True)
        for c, n in counts:
            if above + n >= k:
                break
            above += n
        lo, hi = lo + c * width, min(hi, lo + (c + 1) * width - 1)
        if width == 1 or above + n - k <= slack:
            return lo


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, max_n: int = 1, seed: int = 2024,
             min_words: int = 20, tenths: int = 1) -> DataFrame:
    """Draw ``tenths`` tenths of the documents of at least ``min_words`` words towards the
    target: ``doc_id, n_features, weight, score, rank`` of every row, ``rank`` 1, 2, ... from
    the highest score (ties to the smaller doc_id), null where not drawn."""
    gain = gains(bucket_counts(docs, buckets, max_n), bucket_counts(target, buckets, max_n), buckets)
    rows = keep(scores(docs, gain, seed, max_n).withColumn("mark", F.monotonically_increasing_id()), "resample-scores")
    able = rows.where(F.col("n_words") >= min_words)
    k = tenths * able.count() // 10
    out = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return rows.select(*out, undrawn)
    least = border(able, k)
    near = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    # the partition number and the place inside it make up the id of a sorted row
    ordered = keep(rows.where(near).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "mark")
                   .select(*out, F.monotonically_increasing_id().alias("at")), "resample-order")
    parts = F.shiftright("at", 33)
    counts = sorted((r["p"], r["n"]) for r in ordered.groupBy(parts.alias("p")).agg(F.count("*").alias("n")).collect())
    before, acc = {}, 0
    for p, n in counts:                             # one number a partition
        before[p] = acc
        acc += n
    offset = ordered.sparkSession.createDataFrame([(int(p), int(b)) for p, b in before.items()], "p long, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = (ordered.join(F.broadcast(offset), parts == F.col("p"))     # as many rows as sort partitions
             .select(*out, F.when(place <= k, place).cast("long").alias("rank")))
    return drawn.unionByName(rows.where(~near).select(*out, undrawn))
