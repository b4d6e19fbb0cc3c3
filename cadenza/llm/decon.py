"""Operator 5, benchmark decontamination by template canonicalisation.

Texts become templates: lower-case words, with typed placeholders for numbers,
for units after a number and for names (capitalised words that do not open a
sentence).  Names are also left as words in a second form, so that a copy with other
capitals is found as well.  A benchmark item is the set of its windows of eight template words.
A document's windows first meet a filter of 2**25 bits (a fixed size, whatever
the benchmark) inside the scan; the few survivors are hash-joined with the
benchmark's windows.  Windows that keep the same distance between document and
item form an alignment; within one, the values in the placeholders must map one
to one between item and document, so a question with new numbers and names is
caught and an accidental match of shape is not.  The mapping is the majority's: of several
values for one slot value the most frequent holds, and only the windows with another one are
dropped.  Windows whose slots equal the item's always count.  A document is contaminated by
an item when the remaining windows cover at least half of the item's, or when ``VERBATIM`` words
in a row stand in it unchanged.

Cases: null and empty texts have no windows; items of up to seven words have one window of all their
words, and those under ``SHORTEST`` words match only texts that consist of them; very long texts
are scanned whole; equal windows of an item count once; repeated rows get equal
results; an empty benchmark or table flags nothing; further columns are ignored
(``drop_contaminated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_ready, bucket_of, in_buckets, keep, shield, unshield
from cadenza.llm.words import pieces, windows

WIDTH, SHORTEST, COVER = 8, 5, 0.5
VERBATIM = 20      # words of an item in a row that give a document away whatever their share
FILTER_BITS = 25
#: fixed values: units of measure, as lower-case words
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres mg g kg t oz lb lbs gram grams kilogram kilograms ounce ounces pound pounds
ton tons ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours
day days week weeks month months year years hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar c f k usd eur gbp
dollar dollars euro euros cent cents percent""".split())

_U = np.uint64
_NUM, _UNIT, _NAME = (_U(xxhash.xxh64_intdigest(x)) for x in ("<number>", "<unit>", "<name>"))
_END, _POINT = "\x01", "\x02"


def templates(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, pa.Array, np.ndarray]:
    """``(forms, index of each template word's own word, words, offsets)`` of the texts; a
    form is (hash of each template word, is it a placeholder): names replaced, or left."""
    t = pc.replace_substring_regex(pc.fill_null(texts, ""), "[\x01\x02]", " ")
    for _ in range(2):  # decimal points, also in neighbouring digits
        t = pc.replace_substring_regex(t, r"([0-9])[.,]([0-9])", "\\1" + _POINT + "\\2")
    t = pc.replace_substring_regex(t, r"[.!?:\n]+", f" {_END} ")
    t = pc.ascii_trim(pc.replace_substring_regex(t, r"[^\p{L}\p{N}\x01\x02]+", " "), " ")
    lists = pc.split_pattern(t, " ")
    n = np.asarray(pc.list_value_length(lists), np.int64)
    enc = lists.flatten().dictionary_encode()
    idx, vocab = np.asarray(enc.indices, np.int64), enc.dictionary
    doc = np.repeat(np.arange(len(n)), n)
    first = np.zeros(len(idx), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    words = vocab.to_pylist()
    h = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in words), np.uint64, len(words))
    kind = np.fromiter((0 if w in ("", _END) else 2 if w[0].isdigit() and w.replace(_POINT, "").isdigit()
                        else 3 if w.lower() in UNITS else 4 if len(w) > 1 and w[0].isupper() and w[1:].islower()
                        else 1 for w in words), np.int8, len(words))
    k = kind[idx] if len(idx) else np.zeros(0, np.int8)
    before = np.concatenate([[0], k[:-1]]).astype(np.int8)
    opens = first | (before == 0)
    number, unit, name = k == 2, (k == 3) & (before == 2) & ~first, (k == 4) & ~opens
    left = h[idx] if len(idx) else np.zeros(0, np.uint64)
    left = np.where(number, _NUM, np.where(unit, _UNIT, left))
    real = k != 0
    forms = [(np.where(name, _NAME, left)[real], (number | unit | name)[real]), (left[real], (number | unit)[real])]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[real], minlength=len(n)))]).astype(np.int64)
    return forms, idx[real], vocab, offsets


def _slots(rows: np.ndarray, start: np.ndarray, width: np.ndarray, slot: np.ndarray, word: np.ndarray, vocab) -> pa.Array:
    """The words in the placeholders of the chosen windows, in order."""
    src = np.repeat(np.arange(len(rows)), width)
    at = np.arange(len(src)) - np.repeat(np.cumsum(width) - width, width) + start[src]
    hit = slot[at] if len(at) else np.zeros(0, bool)
    values = pc.utf8_lower(vocab.take(pa.array(word[at[hit]]))) if len(vocab) else pa.array([], pa.string())
    ends = np.concatenate([[0], np.cumsum(np.bincount(src[hit], minlength=len(rows)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h >> _U(64 - FILTER_BITS), (h >> _U(8)) & _U((1 << FILTER_BITS) - 1)


def _form_windows(forms, off: np.ndarray, width: int):
    """Windows of both forms (of the second: those that the first does not have)."""
    first = None
    for h, slot in forms:
        wh, text, pos = windows(h, off, width)
        ok = np.ones(len(wh), bool) if first is None else wh != first
        first = wh
        yield slot, wh[ok], text[ok], pos[ok]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            forms, word, vocab, off = templates(part.column("text"))
            n = np.diff(off)
            for slot, wh, item, pos in _form_windows(forms, off, WIDTH):
                width = np.minimum(n[item], WIDTH)
                b1, b2 = _bits(wh)
                yield pa.RecordBatch.from_arrays([
                    part.column("item_id").take(pa.array(item)), pa.array(wh.astype(np.int64)), pa.array(pos),
                    pa.array(width), pa.array(b1.astype(np.int64)), pa.array(b2.astype(np.int64)),
                    _slots(item, off[item] + pos, width, slot, word, vocab)],
                    ["item_id", "h", "idx", "width", "b1", "b2", "item_slots"])


def _doc_windows(bits: np.ndarray, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                forms, word, vocab, off = templates(part.column("text"))
                n = np.diff(off)
                for w in widths:
                    for slot, wh, doc, pos in _form_windows(forms, off, w):
                        ok = n[doc] >= w if w >= SHORTEST else n[doc] == w
                        for b in _bits(wh):
                            at = np.flatnonzero(ok)
                            b = b[at]
                            ok[at] = (bits[(b >> _U(6)).astype(np.int64)] >> (b & _U(63))) & _U(1) == 1
                        wh, doc, pos = wh[ok], doc[ok], pos[ok]
                        yield pa.RecordBatch.from_arrays([
                            part.column("k").take(pa.array(doc)), pa.array(wh.astype(np.int64)), pa.array(pos),
                            _slots(doc, off[doc] + pos, np.full(len(doc), w), slot, word, vocab)],
                            ["k", "h", "pos", "doc_slots"])
    return run


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``k`` (row key of a document), ``item_id``, ``coverage``, ``verbatim``: every document and
    item with a consistent window."""
    spark = docs.sparkSession
    arrow_ready(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _item_windows, "item_id long, h long, idx long, width long, b1 long, b2 long, item_slots array<string>")
    # a window that recurs in an item counts once, at its first place
    first = items.groupBy("item_id", "h").agg(F.min("idx").alias("idx"))
    items = keep(items.join(first, ["item_id", "h", "idx"]), "decon-items")
    n = items.groupBy("item_id").agg(F.countDistinct("idx").alias("n"))
    both = items.select(F.explode(F.array("b1", "b2")).alias("b")).distinct()
    cells = (both.groupBy(F.shiftright("b", 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("v")).collect())  # at most 2**19 rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    if cells:
        bits[np.array([r["cell"] for r in cells])] = np.array([r["v"] for r in cells], np.int64).view(np.uint64)
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())     # at most WIDTH numbers
    found = docs.select(_key().alias("k"), "text").mapInArrow(
        _doc_windows(bits, widths), "k long, h long, pos long, doc_slots array<string>")
    met = keep(found.join(items.select("item_id", "h", "idx", "item_slots"), "h")
               .select("k", "item_id", "idx", (F.col("pos") - F.col("idx")).alias("shift"), "item_slots", "doc_slots"),
               "decon-met")
    align = ["k", "item_id", "shift"]
    met = met.withColumn("same", F.coalesce(F.col("item_slots") == F.col("doc_slots"), F.lit(False)))
    pair = (met.where(F.size("item_slots") > 0)
            .select(*align, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("p"))
            .groupBy(*align, F.col("p.item_slots").alias("x"), F.col("p.doc_slots").alias("y")).agg(F.count(F.lit(1)).alias("n")))
    pair = keep(pair, "decon-pairs")
    clash = (pair.groupBy(*align).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("nx"),
                                      F.countDistinct("y").alias("ny"))
             .where("n > nx or n > ny").select(*align))
    # alignments with a clash: the pairs that are most frequent for both their values
    odd = pair.join(clash, align, "left_semi")
    by_x = odd.groupBy(*align, "x").agg(F.min(F.struct((-F.col("n")).alias("n"), "y")).alias("b")).select(*align, "x", F.col("b.y").alias("y"))
    by_y = odd.groupBy(*align, "y").agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("b")).select(*align, F.col("b.x").alias("x"), "y")
    right = by_x.join(by_y, [*align, "x", "y"]).withColumn("right", F.lit(True))
    window = [*align, "idx"]
    torn = met.join(clash, align, "left_semi").where(~F.col("same"))
    wrong = (torn.select(*window, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("p"))
             .select(*window, F.col("p.item_slots").alias("x"), F.col("p.doc_slots").alias("y"))
             .join(right, [*align, "x", "y"], "left").where(F.col("right").isNull()).select(*window).distinct().withColumn("wrong", F.lit(True)))
    good = (met.join(wrong, window, "left").where(F.col("same") | F.col("wrong").isNull())
            .groupBy(*window).agg(F.max("same").alias("same")))
    good = keep(good, "decon-windows")
    # unchanged windows in a row of one alignment
    islands = Window.partitionBy(*align).orderBy("idx")
    run = (good.where("same").withColumn("_g", F.col("idx") - F.row_number().over(islands))
           .groupBy(*align, "_g").agg(F.count(F.lit(1)).alias("n")).groupBy("k", "item_id").agg(F.max("n").alias("run")))
    seen = good.groupBy("k", "item_id").agg(F.countDistinct("idx").alias("seen")).join(n, "item_id")
    return (seen.join(run, ["k", "item_id"], "left")
            .select("k", "item_id", (F.col("seen") / F.col("n")).alias("coverage"),
                    (F.coalesce("run", F.lit(0)) >= VERBATIM - WIDTH + 1).alias("verbatim")))


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """``k, n_items, item_id, coverage`` of the documents to drop (best item; the smallest at ties)."""
    hit = overlaps(docs, benchmark).where((F.col("coverage") >= cover) | F.col("verbatim"))
    best = F.max(F.struct(F.col("coverage"), (-F.col("item_id")).alias("i")))
    return keep(hit.groupBy("k").agg(F.count(F.lit(1)).alias("n_items"), best.alias("_m"))
                .select("k", "n_items", (-F.col("_m.i")).alias("item_id"), F.col("_m.coverage").alias("coverage")),
                "decon-hits")


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """One row per input row: ``doc_id, contaminated, n_items, item_id, coverage``."""
    hits = contaminated(docs, benchmark, cover)
    return (docs.select("doc_id", _key().alias("k")).join(hits, "k", "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id",
                    F.coalesce("coverage", F.lit(0.0)).alias("coverage")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """``docs`` without contaminated rows; only rows that share a bucket with one are shuffled."""
    hits = contaminated(docs, benchmark, cover).select(F.col("k").alias("_k"))
    own = ("doc_id", "text")
    marked = in_buckets(shield(docs, *own).withColumn("_k", _key()), bucket_of(F.col("_k")),
                        hits.select(bucket_of(F.col("_k")).alias("b")), "_maybe")
    sure = marked.where(~F.col("_maybe"))
    rest = marked.where("_maybe").join(hits, "_k", "left_anti")
    return unshield(sure, docs, *own).unionByName(unshield(rest, docs, *own))
