"""Operator 13, substring dedup: a compressed FM-index per shard.

A window is ``width`` consecutive words.  Every window is filed under one of its ``gram``-word
runs, the one with the smallest hash (its anchor), so equal windows are filed alike wherever
they stand, and neighbouring windows that share an anchor form one segment.

1. Texts are packed into blocks of about ``BLOCK_BYTES`` and written, bucketed by block
   number: later joins bring small things to the blocks and never move a text.
2. Each block lists its anchors, one row for each whatever its copies.  Anchors seen in a
   single document cannot belong to a repeat and go.
3. The segments of the others go to the shard of their anchor.  An anchor with more than
   ``HOT`` occurrences would fill a shard, so its segments are cut into single windows, which
   go to the shard of their own words.  Copies within a block travel once.
4. A shard builds an FM-index of its distinct segments (suffix order, Burrows-Wheeler
   transform, wavelet matrix of packed bits with rank counts) and streams the segments
   through it: backward search adds one word in front, the interval is widened again to the
   class of all suffixes that agree on ``width`` words, and the smallest document of that
   class tells whether the window also starts in an earlier document.  Matches that reach
   the threshold are returned as word intervals of their block.
5. Blocks join their intervals and give one row per document.

No stage compares all documents with all others; the longest list for one key is the number
of blocks.  Words count as equal when their 128-bit hashes are equal.

Cases: null or empty texts have no words (hash of the empty string, nothing removed); texts
shorter than a window keep everything; a null doc_id is neither smaller nor larger than any
other, so such rows lose nothing and take nothing; rows that share a doc_id do not remove
each other's words (repeated rows stay alike); windows are judged on the input; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_ready, keep, keep_bucketed
from cadenza.llm.words import mix, pieces

BLOCK_BYTES = 4 << 20    # text of one block (a longer text is a block of its own)
HOT = 4096               # occurrences of an anchor beyond which its windows go their own ways
SHARD_SEGMENTS = 20_000  # segments of an average shard
CHUNK = 40 << 10         # intervals of one result row at most
ODD = np.uint64(0x9E3779B97F4A7C15)


# FM-index --------------------------------------------------------------------
class WaveletMatrix:
    """Rank over a sequence of symbols below ``2 ** levels``: one packed bit row per level,
    most significant bit first, with a count before every 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows, self.counts, self.zeros = levels, [], [], []
        s = symbols.astype(np.uint32)
        for level in range(levels - 1, -1, -1):
            bit = (s >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros((len(s) // 64 + 1) * 64, dtype=np.uint8)
            padded[:len(s)] = bit
            row = np.packbits(padded, bitorder="little").view(np.uint64)
            count = np.zeros(len(row), dtype=np.int64)
            np.cumsum(np.bitwise_count(row[:-1]), out=count[1:])
            self.rows.append(row)
            self.counts.append(count)
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.rows[level][word] & below)

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``lo`` and before ``hi``."""
        start = np.zeros_like(lo)
        for level in range(self.levels):
            bit = (symbol >> (self.levels - 1 - level)) & 1 == 1
            ones = [self._ones(level, i) for i in (start, lo, hi)]
            start, lo, hi = (np.where(bit, self.zeros[level] + o, i - o) for o, i in zip(ones, (start, lo, hi)))
        return lo - start, hi - start


class FMIndex:
    """FM-index over sequences of symbols (1 and up), each closed by symbol 0.

    Suffixes are sorted by their first ``depth`` symbols (a power of two), so intervals are
    exact for patterns of up to ``depth`` symbols.  ``label`` is one number per sequence; the
    smallest label of a class of suffixes that agree on ``width`` symbols is kept."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, label: np.ndarray, width: int):
        n = len(symbols) + len(lengths)
        close = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, dtype=np.int64)
        at = np.ones(n, dtype=bool)
        at[close] = False
        text[at] = symbols
        rank, done = text, 1
        while done <= width:                       # doubling: the order by 2 ** k symbols
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -done)
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], np.diff(key[order]) != 0])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            done *= 2
        # symbols that neighbours in the order have in common, up to ``width``
        agree, self.common = np.ones(n - 1, dtype=bool), np.zeros(n, dtype=np.int16)
        for j in range(width):
            t = np.roll(text, -j)[order]
            agree &= t[1:] == t[:-1]
            self.common[1:] += agree
        self._borders: dict[int, np.ndarray] = {}
        first = np.flatnonzero(self.common < width)      # classes of suffixes that agree on ``width``
        self.lo = np.repeat(first, np.diff(np.append(first, n)))
        self.hi = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.least = np.repeat(np.minimum.reduceat(label[owner][order], first), np.diff(np.append(first, n)))
        self.size, self.width = n, width
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])     # suffixes with a smaller first symbol
        self.bwt = WaveletMatrix(np.roll(text, 1)[order], max(1, int(text.max()).bit_length()))

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with ``symbol`` put in front."""
        a, b = self.bwt.rank(symbol, lo, hi)
        return self.before[symbol] + a, self.before[symbol] + b

    def widen(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``depth`` symbols of the suffixes at ``at``."""
        if depth not in self._borders:
            self._borders[depth] = np.append(np.flatnonzero(self.common < depth), self.size) if depth else np.array([0, self.size])
        border = self._borders[depth]
        i = np.searchsorted(border, at, side="right") - 1
        return border[i], border[i + 1]

    def stream(self, symbols: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of sequences against the index, from their ends to their
        starts: ``(sequence, start, matched, least)`` of every position where at least
        ``width`` symbols match; ``matched`` counts up to ``width``."""
        offset = np.cumsum(lengths) - lengths
        lo, hi = np.zeros(len(lengths), dtype=np.int64), np.full(len(lengths), self.size, dtype=np.int64)
        depth = np.zeros(len(lengths), dtype=np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            q = np.flatnonzero(lengths >= back)
            s = symbols[offset[q] + lengths[q] - back]
            known = s < len(self.before) - 1
            s = np.where(known, s, 0)
            a, b = self.step(s, lo[q], hi[q])
            lost = np.flatnonzero((a >= b) & known)
            while len(lost):                       # shorten the match from its end until it can be extended
                depth[q[lost]] -= 1
                for d in np.unique(depth[q[lost]]).tolist():
                    at = lost[depth[q[lost]] == d]
                    lo[q[at]], hi[q[at]] = self.widen(lo[q[at]], d)
                a[lost], b[lost] = self.step(s[lost], lo[q[lost]], hi[q[lost]])
                lost = lost[(a[lost] >= b[lost]) & (depth[q[lost]] > 0)]
            none = ~known | (a >= b)               # the symbol does not occur
            a, b = np.where(none, 0, a), np.where(none, self.size, b)
            depth[q] = np.where(none, 0, depth[q] + 1)
            full = depth[q] > self.width           # widen to the class of ``width`` symbols
            a, b = np.where(full, self.lo[np.minimum(a, self.size - 1)], a), np.where(full, self.hi[np.minimum(a, self.size - 1)], b)
            depth[q] = np.minimum(depth[q], self.width)
            lo[q], hi[q] = a, b
            hit = np.flatnonzero(depth[q] == self.width)
            if len(hit):
                yield q[hit], lengths[q[hit]] - back, depth[q[hit]], self.least[a[hit]]


# words, anchors, segments ------------------------------------------------------
def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``[^ \\t-\\r]+`` of every text: all words, and where each text's words begin (one more)."""
    t = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(t)
    n = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    flat = lists.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(t), 0))
    if empty.any():
        flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
        n = np.where(empty, 0, n)
    bounds = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=bounds[1:])
    return flat, bounds


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    enc = words.dictionary_encode()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.combine_chunks()
    return np.asarray(enc.indices, dtype=np.int64), enc.dictionary


def anchors(hashes: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, anchor value, anchor position)`` of every window, in order."""
    n, total = np.diff(bounds), len(hashes)
    if total < width:
        return (np.zeros(0, np.int64),) * 3
    span, m = width - gram + 1, total - width + 1
    g = np.zeros(total - gram + 1, dtype=np.uint64)
    for j in range(gram):
        g = mix(g * ODD + hashes[j:total - gram + 1 + j])
    # the low bits carry the place, so that a minimum names the one it came from
    low = np.uint64((1 << max(1, (span - 1).bit_length())) - 1)
    least = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    size = 1
    while size * 2 <= span:                         # minima over runs of 2, 4, 8 ... places
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:m], least[span - size:span - size + m])
    left = np.repeat(bounds[1:], n)[:m] - np.arange(m)
    start = np.flatnonzero(left >= width)           # a window lies in one text
    least = least[start]
    where = start + (((least & low) - start.astype(np.uint64)) & low).astype(np.int64)
    return start, (least & ~low).view(np.int64), where


def _hashes(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: mixed (byte, distance from the end) values, summed over each string."""
    v = vocabulary.cast(pa.large_string())
    bounds = np.frombuffer(v.buffers()[1], dtype=np.int64)[v.offset:v.offset + len(v) + 1]
    if not len(v):
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(v.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]].astype(np.uint64)
    bounds = bounds - bounds[0]
    size = np.diff(bounds)
    behind = (np.repeat(bounds[1:], size) - np.arange(len(data))).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(behind * ODD + data + np.uint64(1)), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64) * ODD)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as r:
        return r.read_next_batch()


# stages ------------------------------------------------------------------------
def blocks_of(docs: DataFrame) -> DataFrame:
    """``block`` (unique), ``payload`` (``doc_id, text`` of its rows), written in buckets by block."""
    spark = docs.sparkSession
    arrow_ready(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def one():
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_pack(
                pa.Table.from_batches(held).combine_chunks().to_batches()[0])], pa.binary())], ["block", "payload"])
        for batch in batches:
            for p in pieces(batch):
                if not p.num_rows:
                    continue
                held.append(pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("text").cast(pa.large_string())], ["doc_id", "text"]))
                size += held[-1].nbytes
                if size >= BLOCK_BYTES:
                    yield one()
                    held, size, block = [], 0, block + 1
        if held:
            yield one()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keep_bucketed(d.mapInArrow(pack, "block long, payload binary"), "substring_blocks", "block")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
            yield row, _unpack(row["payload"].as_py())
            pa.default_memory_pool().release_unused()


def anchor_rows(blocks: DataFrame, width: int, gram: int) -> DataFrame:
    """``anchor, block, n`` for every anchor of a block: its occurrences, negative if all of
    them are in one document."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, held in _each_block(batches):
            words, bounds = split_words(held.column("text"))
            index, vocabulary = word_codes(words)
            start, value, where = anchors(_hashes(vocabulary)[index], bounds, width, gram)
            known = ~np.asarray(held.column("doc_id").is_null())
            new = np.concatenate([[True], np.diff(where) != 0])[:len(where)]
            value, doc = value[new], np.searchsorted(bounds, where[new], side="right") - 1
            value, doc = value[known[doc]], doc[known[doc]]
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], np.diff(value) != 0])[:len(value)])
            n = np.diff(np.append(first, len(value)))
            several = doc[first] != doc[first + n - 1] if len(first) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(value[first]), pa.array(np.full(len(first), row["block"].as_py())),
                                              pa.array(np.where(several, n, -n).astype(np.int32))], ["anchor", "block", "n"])
    return blocks.mapInArrow(find, "anchor long, block long, n int")


def shared_anchors(rows: DataFrame) -> DataFrame:
    """``block, anchors, hot``: per block the anchors that stand in several documents, and
    those of them with more than ``HOT`` occurrences."""
    from pyspark.sql import Window
    w = Window.partitionBy("anchor")         # one row a block, whatever the copies
    many = (F.count("*").over(w) > 1) | (F.max("n").over(w) > 0)
    hot = F.sum(F.abs("n").cast("long")).over(w) > HOT
    return (rows.select("block", "anchor", many.alias("many"), hot.alias("hot")).where("many")
            .groupBy("block").agg(F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"),
                                  F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot")))


def segments(blocks: DataFrame, found: DataFrame, width: int, gram: int) -> DataFrame:
    """``key`` (anchor, or hash of a hot window), ``block``, ``words`` (joined by one space),
    ``least`` (smallest doc_id of the block that has them) and ``places``: (doc_id, row,
    first word) of every copy, as 64-bit integers."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, held in _each_block(batches):
            words, bounds = split_words(held.column("text"))
            index, vocabulary = word_codes(words)
            h = _hashes(vocabulary)[index]
            start, value, where = anchors(h, bounds, width, gram)
            hot = np.isin(value, np.asarray(row["hot"].values, dtype=np.int64))
            use = hot | np.isin(value, np.asarray(row["anchors"].values, dtype=np.int64))
            known = ~np.asarray(held.column("doc_id").is_null())
            doc = np.searchsorted(bounds, start, side="right") - 1
            use &= known[doc]
            start, value, where, hot, doc = (x[use] for x in (start, value, where, hot, doc))
            if not len(start):
                continue
            # a segment: windows in a row with one anchor; a hot window stands alone
            begins = np.concatenate([[True], (np.diff(where) != 0) | (np.diff(start) != 1) | hot[1:] | hot[:-1]])
            first = np.flatnonzero(begins)
            a, stop = start[first], start[np.append(first[1:], len(start)) - 1] + width
            key, doc = value[first], doc[first]
            # equal segments of the block are one row: 128 bits over the words
            two = np.zeros((2, len(a)), dtype=np.uint64)
            size = stop - a
            padded = np.concatenate([h, np.zeros(int(size.max()), np.uint64)])
            for j in range(int(size.max())):
                on = j < size
                for i, salt in enumerate((np.uint64(1), np.uint64(2))):
                    two[i] = np.where(on, mix(two[i] * ODD + mix(padded[a + j] + salt)), two[i])
            key = np.where(hot[first], two[0].view(np.int64), key)
            ids = np.asarray(held.column("doc_id").fill_null(0))[doc]
            order = np.lexsort((ids, size, two[1], two[0]))
            o = [x[order] for x in (two[0], two[1], size)]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(o[0]) != 0) | (np.diff(o[1]) != 0) | (np.diff(o[2]) != 0)]))
            places = np.stack([ids, doc, a - bounds[doc]], axis=1)[order].astype(np.int64)
            raw, cuts = places.tobytes(), np.append(head, len(order)) * 24
            one = order[head]
            n = size[one]
            at = np.repeat(a[one] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)),
                                             vocabulary.take(pa.array(index[at])).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[one]), pa.array(np.full(len(one), row["block"].as_py())), pc.binary_join(lists, " "),
                 pa.array(ids[order][head]), pa.array([raw[cuts[i]:cuts[i + 1]] for i in range(len(head))], pa.binary())],
                ["key", "block", "words", "least", "places"])
    joined = blocks.join(found, "block").select("block", "payload", "anchors", "hot")
    return joined.mapInArrow(cut, "key long, block long, words string, least long, places binary")


def match_shard(words: pa.Array, least: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index the distinct segments of a shard and stream them through the index:
    ``(segment, window start, smallest doc_id that has the window)``, in runs."""
    lists = pc.split_pattern(words, " ")
    lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    code, _ = word_codes(lists.flatten())
    index = FMIndex(code + 1, lengths, least, width)
    for seq, start, _, low in index.stream(code + 1, lengths):
        yield seq, start, low


def removed_in_shard(batch: pa.Table, width: int) -> pa.Table:
    """``block, spans``: (row, first word, end) of the words to remove, as 32-bit integers."""
    enc = batch.column("words").combine_chunks().dictionary_encode()
    enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
    seg = np.asarray(enc.indices, dtype=np.int64)
    least = np.full(len(enc.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, seg, batch.column("least").to_numpy())
    raw = [x.as_py() for x in batch.column("places")]
    count = np.array([len(x) // 24 for x in raw], dtype=np.int64)
    places = np.frombuffer(b"".join(raw), dtype=np.int64).reshape(-1, 3)
    segment = np.repeat(seg, count)                       # of each place
    block = np.repeat(batch.column("block").to_numpy(), count)
    by_seg = np.argsort(segment, kind="stable")
    begin = np.searchsorted(segment[by_seg], np.arange(len(least)))
    n_of = np.bincount(segment, minlength=len(least))
    out_place, out_start = [], []
    for q, start, low in match_shard(enc.dictionary, least, width):
        # all copies of the matched segments
        n = n_of[q]
        at = by_seg[np.repeat(begin[q] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        gone = places[at, 0] > np.repeat(low, n)
        out_place.append(at[gone])
        out_start.append(np.repeat(start, n)[gone])
    at = np.concatenate(out_place) if out_place else np.zeros(0, np.int64)
    start = np.concatenate(out_start) if out_start else np.zeros(0, np.int64)
    # neighbouring windows of a place become one interval
    order = np.lexsort((start, at, block[at]))
    at, start = at[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(start) != 1)])[:len(at)])
    last = np.append(first[1:], len(at))[:len(first)] - 1
    spans = np.stack([places[at[first], 1], places[at[first], 2] + start[first], places[at[first], 2] + start[last] + width],
                     axis=1).astype(np.int32)
    of = block[at[first]]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0])[:len(of)])
    ends = np.append(cuts[1:], len(of))[:len(cuts)]
    rows = [(int(of[a]), spans[x:min(x + CHUNK, b)].tobytes()) for a, b in zip(cuts, ends) for x in range(a, b, CHUNK)]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "spans": pa.array([r[1] for r in rows], pa.binary())})


def remove_repeats(docs: DataFrame, width: int = 13, gram: int = 4) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` of every row: without the words
    of windows that also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    blocks = blocks_of(docs)
    found = keep(shared_anchors(anchor_rows(blocks, width, gram)), "substring-anchors")
    n = found.agg(F.sum(F.size("anchors") + F.size("hot")).alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_SEGMENTS))
    seg = segments(blocks, found, width, gram).withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)))
    spans = (seg.groupBy("shard").applyInArrow(lambda t: removed_in_shard(t, width), "block long, spans binary")
             .groupBy("block").agg(F.collect_list("spans").alias("spans")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, held in _each_block(batches):
            words, bounds = split_words(held.column("text"))
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            got = b"".join(row["spans"].as_py() or ())
            s = np.frombuffer(got, dtype=np.int32).reshape(-1, 3).astype(np.int64)
            np.add.at(gone, bounds[s[:, 0]] + s[:, 1], 1)
            np.add.at(gone, bounds[s[:, 0]] + s[:, 2], -1)
            stays = np.cumsum(gone)[:-1] == 0
            kept = np.concatenate([[0], np.cumsum(stays)])[bounds]
            lists = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.filter(pa.array(stays)).cast(pa.string()))
            text = pc.binary_join(lists, " ")
            for x in range(0, len(text), 500):
                t = text[x:x + 500]
                yield pa.RecordBatch.from_arrays(
                    [held.column("doc_id")[x:x + 500], pa.array(np.diff(bounds)[x:x + 500]),
                     pa.array((np.diff(bounds) - np.diff(kept))[x:x + 500]),
                     pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in t]), t],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return (blocks.join(spans, "block", "left").select("block", "payload", "spans")
            .mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))
