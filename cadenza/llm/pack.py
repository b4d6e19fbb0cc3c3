"""Operator 4, packing by minimum bin slack.

1. Texts become token ids in Arrow batches (``tokenizers``; the vocabulary file
   is a parameter).  A text is cut where the tokenizer never merges (before white
   space; by the byte-level rule also between letters, digits and marks), each
   distinct chunk of a batch is looked up once, and chunks are encoded once per
   task and kept in a bounded table.  A document longer than the capacity is cut
   into full windows and a rest; shorter ones stay whole.
2. Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
   driver.  Each window is seeded with the longest remaining length; a bitset
   subset-sum over the remaining multiset of lengths gives every reachable fill,
   the fill closest to the capacity is traced back to counts of lengths, and that
   multiset is used for as many windows as the counts allow.  So the plan has a
   few thousand window patterns at any input size.
3. Pieces are numbered per length in parallel (length x 64 hash buckets, with
   offsets), and the number decides window and offset by a lookup in the plan.

Cases: null text counts as empty (one piece: the end id); a very long text is
cut; equal rows are separate documents; null doc_id is carried through; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_ready, keep
from cadenza.llm.words import pieces

CAPACITY = 2048
END_ID = 1
RANK_BUCKETS = 64
#: chunks, and bytes of them, kept between batches; the ones seen again stay
CACHE_CHUNKS, CACHE_BYTES = 200_000, 16 << 20
#: fixed values: Unicode white space, at whose runs a text may be cut for the tokenizer
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
WHITE = pa.array(list(SPACE), pa.string())
#: kinds of characters at which a text is cut; only what is a letter or mark beyond doubt has that kind
OTHER, LETTER, DIGIT, MARK, BREAK, BLANK = range(6)
KIND = np.zeros(0x3002, np.uint8)
for _kind, _of in ((MARK, [(0x21, 0x7E)]), (OTHER, [(0x27, 0x27)]), (DIGIT, [(0x30, 0x39)]),
                   (LETTER, [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x2AF), (0x400, 0x481), (0x48A, 0x52F)]),
                   (OTHER, [(0xD7, 0xD7), (0xF7, 0xF7)]), (BREAK, [(ord(c), ord(c)) for c in SPACE]), (BLANK, [(0x20, 0x20)])):
    for _a, _b in _of:
        KIND[_a:_b + 1] = _kind
#: whether a text is cut between a character of one kind and the next one: before white space, and
#: by the byte-level rule also behind white space other than blanks and between letters, digits and marks
COARSE = np.array([[a < BREAK <= b for b in range(6)] for a in range(6)])
FINE = COARSE | np.array([[a == BREAK > b or OTHER < min(a, b) and max(a, b) < BREAK and a != b for b in range(6)] for a in range(6)])


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions ``start[i] ... start[i] + n[i] - 1``, one run after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class ChunkEncoder:
    """Ids of texts, chunk by chunk, with a bounded table of the chunks seen.

    A text may be cut before white space, where the tokenizer never merges.  With the byte-level
    splitting rule it is cut as well between letters, digits and marks, since the rule has no
    token over such a border; the apostrophe and letters that are not surely ones bind.
    New chunks are encoded many at a time, as one text.  With a byte-level vocabulary every
    id stands for a known number of bytes, which tells where a chunk's ids end; with another
    one, chunks are encoded one by one."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(vocabulary)
        added = self.tok.get_added_tokens_decoder()
        self.bytes = np.zeros(1 + max(self.tok.get_vocab().values()), np.int64)
        for t, i in self.tok.get_vocab().items():
            self.bytes[i] = len(added[i].content.encode()) if i in added else len(t)
        self.added = [t.content for t in added.values()]
        rule = self.tok.pre_tokenizer
        self.fine = (self.tok.normalizer is None and isinstance(rule, pre_tokenizers.ByteLevel) and rule.use_regex
                     and not rule.add_prefix_space and not any(c in SPACE for t in self.added for c in t)
                     and not any(t.lstrip or t.rstrip or t.single_word for t in added.values()))
        self.reset()

    def reset(self) -> None:
        self.known = pa.array([], pa.string())   # chunk i has the ids pool[off[i]: off[i] + len[i]]
        self.off, self.len, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(0, np.uint32), 0

    def _trim(self) -> None:
        """Keep the chunks that came again; at most half of the table."""
        least, kept = 2, np.flatnonzero(self.hits >= 2)
        size = pc.binary_length(self.known).to_numpy()
        while len(kept) > CACHE_CHUNKS // 2 or size[kept].sum() > CACHE_BYTES // 2:
            least *= 2
            kept = np.flatnonzero(self.hits >= least)
        n, off = self.len[kept], self.off[kept]
        self.pool = self.pool[_runs(off, n)]
        self.known = self.known.take(pa.array(kept))
        self.off, self.len, self.hits, self.used = np.cumsum(n) - n, n, self.hits[kept] // 2, len(self.pool)

    def _one_by_one(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(chunks.to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for ids in got for x in ids), np.uint32, int(n.sum())), n

    def _together(self, chunks: pa.StringArray, lead: str, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """``lead``: nothing, or a token of its own that is put before every chunk and taken off its ids."""
        names = chunks.to_pylist()
        got = self.tok.encode_batch_fast([lead + lead.join(names[i:i + run]) for i in range(0, len(names), run)],
                                         add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        size = np.cumsum(pc.binary_length(chunks).to_numpy().astype(np.int64) + len(lead))
        ends = np.cumsum(self.bytes[ids])
        at = np.searchsorted(ends, size)
        if len(ends) == 0 or at[-1] >= len(ends) or (ends[at] != size).any():
            return self._one_by_one(chunks)
        n = np.diff(np.concatenate([[0], at + 1]))
        if lead:
            first = np.cumsum(n) - n
            if (self.bytes[ids[first]] != len(lead)).any():
                return self._one_by_one(chunks)
            ids, n = np.delete(ids, first), n - 1
        return ids, n

    def _learn(self, chunks: pa.StringArray) -> np.ndarray:
        """Take in new chunks; their places in the table."""
        opens, closes = (pc.is_in(pc.utf8_slice_codeunits(chunks, *at), value_set=WHITE).to_numpy(zero_copy_only=False)
                         for at in ((0, 1), (-1, None)))
        alone = closes if self.fine else closes | ~opens
        parts = [(how, np.flatnonzero(own)) for how, own in (
            (lambda c: self._together(c, ""), opens & ~alone), (lambda c: self._together(c, "\n"), ~opens & ~alone),
            (self._one_by_one, alone)) if own.any()]
        order = np.concatenate([part for _, part in parts])
        flat, n = map(np.concatenate, zip(*(how(chunks.take(pa.array(part))) for how, part in parts)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(self.off), len(self.off) + len(order))
        self.known = pa.concat_arrays([self.known, chunks.take(pa.array(order))])
        self.off = np.concatenate([self.off, self.used + np.cumsum(n) - n])
        self.len = np.concatenate([self.len, n])
        self.hits = np.concatenate([self.hits, np.zeros(len(n), np.int64)])
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(len(flat) + self.used // 2 + 1024, np.uint32)])
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        return place

    def _cuts(self, text: str, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions where a chunk starts in ``text``, that is texts one after the other, with their ``ends``;
        ``code``: its code points."""
        kind = KIND[np.minimum(code, len(KIND) - 1)]
        cut = np.zeros(len(kind), bool)
        cut[1:] = (FINE if self.fine else COARSE)[kind[:-1], kind[1:]]
        starts = np.concatenate([[0], ends[:-1]])
        if self.fine:
            white = kind >= BREAK
            last = np.zeros(len(kind), bool)     # the rule parts the last white space before something else from the rest
            last[:-1] = white[:-1] & ~white[1:]
            last[ends[ends > 0] - 1] = False
            cut[1:] |= last[1:] & white[:-1]
            if any(t in text for t in self.added):
                find = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).finditer
                for m in (m for a, b in zip(starts.tolist(), ends.tolist()) for m in find(text, a, b)):
                    cut[max(m.start() - 1, 0):m.end()] = False    # white space before it stays whole
        cut[starts[starts < len(cut)]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        if len(self.known) > CACHE_CHUNKS or self.known.nbytes > CACHE_BYTES:
            self._trim()
        text, ends = "".join(texts), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw, code = text.encode(), np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cuts = self._cuts(text, code, ends)
        at = np.append(cuts, len(text))
        if len(raw) > len(text):                 # places of characters in bytes
            size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            at = np.concatenate([[0], np.cumsum(size)])[at]
        chunks = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(at), pa.py_buffer(raw)).dictionary_encode()
        words = chunks.dictionary.cast(pa.string())
        found = pc.index_in(self.known, value_set=words).fill_null(-1).to_numpy()   # the hash table is of the fewer
        place, seen = np.full(len(words), -1), np.flatnonzero(found >= 0)
        place[found[seen]] = seen
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._learn(words.take(pa.array(new)))
        index = chunks.indices.to_numpy()
        self.hits[place] += np.bincount(index, minlength=len(place))
        idx = place[index]
        n = self.len[idx]
        ids = self.pool[_runs(self.off[idx], n)]
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(cuts, ends)]
        return ids, np.diff(np.concatenate([[0], upto]))


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> ChunkEncoder:
    """One encoder per Python worker, also across its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark deals out the cores
    return ChunkEncoder(vocabulary)


def _piece_rows(vocabulary: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch):
                docs = part.column("doc_id").to_pylist()
                ids, n = enc.encode([t or "" for t in part.column("text").to_pylist()])
                rows = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                at = 0
                for d, k in zip(docs, n.tolist()):
                    own = np.append(ids[at:at + k], np.uint32(END_ID)).astype("<u4")
                    at += k
                    for s in range(0, k + 1, capacity):
                        cut = own[s:s + capacity]
                        rows["doc_id"].append(d)
                        rows["start"].append(s)
                        rows["length"].append(len(cut))
                        rows["ids_crc32"].append(zlib.crc32(cut.tobytes()))
                        rows["doc_tokens"].append(k + 1)
                        if with_ids:
                            rows["ids"].append(cut.astype(np.int32))
                names = list(rows) if with_ids else list(rows)[:-1]
                types = [pa.int64()] * 5 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in zip(names, types)], names)
    return run


def tokenized(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, start, length, ids_crc32, doc_tokens[, ids]``."""
    arrow_ready(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(_piece_rows(vocabulary, capacity, with_ids), schema)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``: bitset
    subset-sum over lengths in falling order, then traced back."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for ell in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        steps.append((ell, reach))
        left, k = min(counts[ell], room // ell), 1
        while left > 0:
            k = min(k, left)
            reach |= (reach << (ell * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, {}
    for ell, before in reversed(steps):
        n = 0
        while not before >> target & 1:
            target -= ell
            n += 1
        if n:
            used[ell] = n
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Window patterns ``(number of windows, {length: pieces per window})`` that use
    every counted piece once."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        pattern = best_fill(rest, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        out.append((times, pattern))
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def _segments(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple]]:
    """length -> (first rank, end rank, first window, pieces per window, offset)."""
    seg: dict[int, list[tuple]] = {}
    used: dict[int, int] = {}
    window = 0
    for times, pattern in patterns:
        off = 0
        for x in sorted(pattern, reverse=True):
            n, r = pattern[x], used.get(x, 0)
            seg.setdefault(x, []).append((r, r + n * times, window, n, off))
            used[x] = r + n * times
            off += n * x
        window += times
    return seg


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, start, length, ids_crc32, ...``)."""
    spark = rows.sparkSession
    rows = rows.withColumn("_rb", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int"))
    per = keep(rows.groupBy("length", "_rb").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    # at most capacity rows reach the driver
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    seg = _segments(plan(counts, capacity))
    # as an Arrow table: a list of rows would pass through a second set of Python workers on every executor
    cell = pa.struct([(c, pa.int64()) for c in "abwno"])
    table = spark.createDataFrame(pa.table({
        "length": pa.array(list(seg), pa.int64()),
        "_seg": pa.array([[dict(zip("abwno", s)) for s in v] for v in seg.values()], pa.list_(cell))}))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_rb")
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.withColumn("_before", before).drop("_n")  # at most capacity x RANK_BUCKETS rows
    w = Window.partitionBy("length", "_rb").orderBy("doc_id", "start", "ids_crc32")
    ranked = (rows.withColumn("_rn", F.row_number().over(w))
              .join(F.broadcast(offsets), ["length", "_rb"])
              .withColumn("_r", F.col("_before") + F.col("_rn") - 1)
              .join(F.broadcast(table), "length"))
    found = ranked.withColumn("_s", F.filter("_seg", lambda s: (s["a"] <= F.col("_r")) & (F.col("_r") < s["b"]))[0])
    k = F.col("_r") - F.col("_s.a")
    return (found.withColumn("sequence_id", F.col("_s.w") + F.floor(k / F.col("_s.n")))
            .withColumn("offset", F.col("_s.o") + (k % F.col("_s.n")) * F.col("length"))
            .drop("_rb", "_rn", "_before", "_r", "_seg", "_s"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset``."""
    rows = keep(tokenized(docs, vocabulary, capacity, with_ids), "pack-pieces")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    return pack(rows, capacity).select(*cols, "sequence_id", "offset")
