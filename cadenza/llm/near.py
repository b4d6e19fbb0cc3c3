"""Operator 9, near-duplicates with DartMinHash.

Similarity is the (weighted) Jaccard of a text's shingles of five words, 0.8 or
more.  With ``weights="set"`` (the queries) each distinct shingle weighs one;
with ``"count"`` it weighs its number of occurrences.

1. Signatures.  Every element owns a plane of weight x rank that is cut into
   dyadic cells; hashing (element, cell) gives the number of darts in the cell
   (Poisson, by inversion) and, for each dart, its weight, rank and coordinate.
   A text keeps the darts below its element weights and below a rank chosen so
   that about ``k ln k + 3k`` darts remain whatever its length; the earliest dart
   of each coordinate is the signature.  If a coordinate got no dart, that text's
   rank bound is doubled.  Two signatures agree in a coordinate with probability
   equal to their weighted Jaccard.
2. Copies.  Texts with equal shingle weights are one node (combined before the
   shuffle); only nodes go on.
3. Banded joining.  20 bands of 4 coordinates.  Nodes that share a band form a
   bucket.  Buckets are cut into blocks of 512 rows and each pair of blocks is a
   separate group, so no task holds a whole hot bucket.  In a group the row nearest
   to the most common coordinates takes all rows whose signature agrees with it;
   what is left is compared with the others.  A group emits a spanning forest, not
   its pairs.  Signatures count as agreeing 4 standard deviations below 0.8.
4. Exact check.  Components of those links are clusters; a cluster's nodes (with
   their shingles, read only for them) again meet in pairs of blocks, and pairs
   whose signatures agree get their exact Jaccard, unless a chain of exact links
   joins them already.  Components of exact links are the classes.

Cases: null, empty and word-less texts have no shingles and are alone; a text of
fewer than five words has one shingle; repeated rows are copies; the class id is
the smallest doc_id of the class (null only if all are null); an empty table
gives an empty result; further columns are ignored (``drop_near`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_ready, bucket_of, in_buckets, keep, shield, unshield
from cadenza.llm.graph import components
from cadenza.llm.words import hashes, mix, pieces, windows, words

WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS, COORDS = 20, 4, 128          # bands use the first 80 coordinates, estimates all
BASE_RANK = 2.0 ** -6
BLOCK, EXACT_BLOCK = 512, 256
AGREE = int(COORDS * SIMILAR - 4 * math.sqrt(COORDS * SIMILAR * (1 - SIMILAR)))

_U = np.uint64


@lru_cache(maxsize=256)
def _poisson(area: float) -> np.ndarray:
    """Distribution function of the Poisson law, long enough for 53-bit uniforms."""
    top = int(area + 12 * math.sqrt(area) + 24)
    p = [math.exp(i * math.log(area) - area - math.lgamma(i + 1)) for i in range(top)]
    return np.minimum(np.cumsum(p), 1.0)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0 ** -53


def dart_signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int,
                    k: int = COORDS) -> np.ndarray:
    """``n_docs x k`` signature of weighted sets given as flat arrays (uint64 elements,
    positive weights, set numbers).  Sets without elements get zeros."""
    total = np.bincount(doc, weight, n_docs)
    sig = np.zeros((n_docs, k), np.uint64)
    bound = np.divide(k * (math.log(k) + 3), total, out=np.zeros(n_docs), where=total > 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        at = np.full(n_docs, -1, np.int64)
        at[todo] = np.arange(len(todo))
        mine = at[doc] >= 0
        el, we, do = element[mine], weight[mine], at[doc[mine]]
        keys, ranks, ids = _darts(el, we, do, bound[todo], k)
        best = np.full(len(todo) * k, np.inf)
        np.minimum.at(best, keys, ranks)
        first = ranks == best[keys]
        s = np.zeros(len(todo) * k, np.uint64)
        s[keys[first]] = ids[first]
        full = np.isfinite(best).reshape(-1, k).all(axis=1)
        sig[todo[full]] = s.reshape(-1, k)[full]
        todo = todo[~full]
        bound[todo] *= 2
    return sig


def _darts(el, we, do, bound, k):
    """Darts under the weights and rank bounds: (set x k + coordinate, rank, id)."""
    top_w, top_r = we.max(), bound.max()
    keys, ranks, ids = [], [], []
    wlo, whi, v = 0.0, 1.0, 0
    while wlo < top_w:
        rows_w = np.flatnonzero(we > wlo) if v else np.arange(len(el))
        rlo, rhi, r = 0.0, BASE_RANK, 0
        while rlo < top_r:
            rows = rows_w[bound[do[rows_w]] > rlo]
            if len(rows):
                cdf = _poisson((whi - wlo) * (rhi - rlo))
                cell = mix(el[rows] ^ _U((0xA0761D6478BD642F * (v * 4096 + r + 1)) % 2 ** 64))
                u = _uniform(cell)
                some = np.flatnonzero(u > cdf[0])
                n = np.searchsorted(cdf, u[some], side="left")
                src = np.repeat(some, n)
                j = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
                h = mix(cell[src] + _U(0x9E3779B97F4A7C15) * (j + 1).astype(np.uint64))
                rank = rlo + (rhi - rlo) * _uniform(mix(h ^ _U(0xE7037ED1A0B428DB)))
                at = rows[src]
                ok = rank < bound[do[at]]
                if whi > 1 or (we[rows] < 1).any():
                    ok &= wlo + (whi - wlo) * _uniform(mix(h ^ _U(0x8EBC6AF09C88C6E3))) < we[at]
                h, rank, at = h[ok], rank[ok], at[ok]
                coord = (mix(h ^ _U(0x589965CC75374CC3)) % _U(k)).astype(np.int64)
                keys.append(do[at] * k + coord)
                ranks.append(rank)
                ids.append(h)
            rlo, rhi, r = rhi, rhi * 2, r + 1
        wlo, whi, v = whi, whi * 2, v + 1
    return np.concatenate(keys), np.concatenate(ranks), np.concatenate(ids)


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: ``(48-bit hash, text number, occurrences)``, sorted by text and hash."""
    idx, vocab, off = words(texts)
    h, doc, _ = windows(hashes(vocab)[idx] if len(idx) else np.zeros(0, np.uint64), off, width)
    both, n = np.unique((doc.astype(np.uint64) << _U(48)) | (h >> _U(16)), return_counts=True)
    return both & _U((1 << 48) - 1), (both >> _U(48)).astype(np.int64), n


def _fingerprints(el, n, doc, n_docs):
    """Two order-free sums over (shingle, weight): equal for equal weighted sets."""
    a = mix(el * _U(0x9E3779B97F4A7C15) + n.astype(np.uint64))
    b = mix(a ^ _U(0xD6E8FEB86659FD93))
    out = np.zeros((2, n_docs), np.uint64)
    np.add.at(out[0], doc, a)
    np.add.at(out[1], doc, b)
    return out.astype(np.int64)


def _as_weights(n: np.ndarray, weights: str) -> np.ndarray:
    return n if weights == "count" else np.ones_like(n)


def _sign(weights: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                m = part.num_rows
                el, doc, n = shingles(part.column("text"), width)
                n = _as_weights(n, weights)
                fa, fb = _fingerprints(el, n, doc, m)
                sig = dart_signatures(el, n.astype(float), doc, m) if len(el) else np.zeros((m, COORDS), np.uint64)
                bands = np.empty((m, BANDS), np.uint64)
                for j in range(BANDS):
                    h = np.full(m, j + 1, np.uint64)
                    for c in range(ROWS):
                        h = mix(h * _U(0x9E3779B97F4A7C15) + sig[:, j * ROWS + c])
                    bands[:, j] = h
                sketch = (mix(sig) & _U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("th"), pa.array(fa), pa.array(fb),
                    pa.array(np.bincount(doc, n, m).astype(np.int64)),
                    pa.ListArray.from_arrays(np.arange(m + 1, dtype=np.int32) * BANDS,
                                             pa.array(bands.ravel().astype(np.int64))),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                ], ["doc_id", "th", "fa", "fb", "size", "bands", "sketch"])
    return run


def signatures(docs: DataFrame, weights: str = "set", width: int = WIDTH) -> DataFrame:
    """``doc_id, th`` (hash of the text: with doc_id, the row's key), ``fa, fb`` (fingerprint), ``size`` (total
    weight), ``bands``, ``sketch``."""
    arrow_ready(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("th"))
    return d.mapInArrow(_sign(weights, width), "doc_id long, th long, fa long, fb long, size long, bands array<long>, sketch binary")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, also across batch borders."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if t.num_rows == 0:
            continue
        new = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            c = np.asarray(t.column(k).combine_chunks())
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for x, y in zip(cuts, cuts[1:]):
            yield t.slice(x, y - x)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


class _Forest:
    def __init__(self, comp: np.ndarray):
        self.root = np.unique(comp, return_inverse=True)[1]

    def join(self, i: int, j: int) -> bool:
        a, b = self.root[i], self.root[j]
        if a == b:
            return False
        self.root[self.root == b] = a
        return True


def _centre(sk: np.ndarray) -> int:
    """The row that agrees most with the most common value of each coordinate."""
    score = np.zeros(len(sk), np.int64)
    for c in range(sk.shape[1]):
        score += np.bincount(sk[:, c], minlength=256)[sk[:, c]]
    return int(score.argmax())


def _links(sk: np.ndarray, size: np.ndarray, side: np.ndarray, forest: _Forest,
           exact: Callable[[int, int], bool] | None) -> Iterator[tuple[int, int]]:
    """Links that join different trees of ``forest``.  ``side``: rows of two different
    blocks need not meet their own side again (-1: one block)."""
    def near(i: int, others: np.ndarray) -> np.ndarray:
        ok = (sk[others] == sk[i]).sum(axis=1) >= AGREE
        ok &= (np.minimum(size[others], size[i]) >= SIMILAR * np.maximum(size[others], size[i]))
        return others[ok]

    def link(i: int, js: np.ndarray) -> Iterator[tuple[int, int]]:
        for j in js.tolist():
            if forest.root[i] != forest.root[j] and (exact is None or exact(i, j)):
                forest.join(i, j)
                yield i, j

    every = np.arange(len(sk))
    if len(sk) > 2:
        c = _centre(sk)
        yield from link(c, near(c, every[every != c]))
    # rows of the largest tree need no meeting among themselves: the others meet everything
    largest = np.bincount(forest.root).argmax()
    for i in every[forest.root != largest].tolist():
        others = every[(forest.root != forest.root[i]) & ((side != side[i]) | (side == -1))]
        if len(others):
            yield from link(i, near(i, others))


def _block_pairs(rows: DataFrame, key: str, count: str, block: int) -> DataFrame:
    """Give each row to every pair of blocks of its group that holds its own block."""
    nb = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int")
    return (rows.withColumn("_nb", nb).withColumn("_own", own)
            .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .withColumn("b1", F.least("_own", "_x")).withColumn("b2", F.greatest("_own", "_x"))
            .drop("_nb", "_x").withColumnRenamed(key, "g"))


def _meet(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in _grouped(batches, ["g", "b1", "b2"]):
            node = np.asarray(t.column("node").combine_chunks())
            if len(node) < 2:
                continue
            node, first = np.unique(node, return_index=True)
            if len(node) < 2:
                continue
            t = t.take(pa.array(first))
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
            size = np.asarray(t.column("size").combine_chunks())
            own = np.asarray(t.column("_own").combine_chunks())
            side = own if t.column("b1")[0].as_py() != t.column("b2")[0].as_py() else np.full(len(node), -1)
            check = None
            if exact:
                grams = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
                many = [np.frombuffer(x, np.int32) for x in t.column("times").to_pylist()]

                def check(i: int, j: int) -> bool:
                    _, x, y = np.intersect1d(grams[i], grams[j], assume_unique=True, return_indices=True)
                    both = int(np.minimum(many[i][x], many[j][y]).sum())
                    return both >= SIMILAR * (int(size[i]) + int(size[j]) - both)
            out += [(int(node[i]), int(node[j])) for i, j in _links(sk, size, side, _Forest(node), check)]
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)
    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                       pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def _met(rows: DataFrame, exact: bool) -> DataFrame:
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (rows.repartition(parts, "g", "b1", "b2").sortWithinPartitions("g", "b1", "b2")
            .mapInArrow(_meet(exact), "a long, b long"))


def _gram_rows(weights: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                m = part.num_rows
                el, doc, n = shingles(part.column("text"), width)
                n = _as_weights(n, weights)
                fa, fb = _fingerprints(el, n, doc, m)
                cut = np.searchsorted(doc, np.arange(m + 1)).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(fa), pa.array(fb),
                    pa.array([el[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([n[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                ], ["fa", "fb", "grams", "times"])
    return run


def _classes(docs: DataFrame, weights: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, ids)``: the signature rows, and for each fingerprint ``fa, fb, class_id, class_size, head``
    (whether it is the class's first: smallest doc_id, nulls last, then smallest fingerprint)."""
    sig = keep(signatures(docs, weights, width), "near-signatures")
    full = sig.where("size > 0")
    nodes = (full.groupBy("fa", "fb", "size").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()))
    nodes = keep(nodes, "near-nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    counts = keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    shared = rows.join(counts, "key").join(nodes.select("node", "size", "sketch"), "node")
    likely = keep(_met(_block_pairs(shared, "key", "n", BLOCK), False).distinct(), "near-likely")
    cluster = components(likely)                                  # node, label
    sizes = cluster.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    member = keep(cluster.join(sizes, "label").join(nodes.drop("bands", "copies"), "node"), "near-clusters")
    wanted = member.select(bucket_of(F.col("rep")).alias("b"))
    text = in_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                      bucket_of(F.col("doc_id")), wanted, "_in").where("_in").select("text")
    grams = text.mapInArrow(_gram_rows(weights, width), "fa long, fb long, grams binary, times binary")
    # copies of one node arrive together here; a node's shingles are needed once
    own = grams.groupBy("fa", "fb").agg(F.first("grams").alias("grams"), F.first("times").alias("times"))
    exact = _met(_block_pairs(member.join(own, ["fa", "fb"]), "label", "n", EXACT_BLOCK), True)
    label = components(keep(exact, "near-exact"))
    whole = nodes.select("node", "fa", "fb", "rep", "copies").join(label, "node", "left")
    whole = whole.withColumn("label", F.coalesce("label", "node"))
    first = F.struct(F.col("rep").isNull().alias("n"), "rep", "fa", "fb")
    best = whole.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.min(first).alias("_f"))
    head = (F.col("fa") == F.col("_f.fa")) & (F.col("fb") == F.col("_f.fb"))
    return sig, keep(whole.join(best, "label").select("fa", "fb", "class_id", "class_size", head.alias("head")), "near-ids")


def near_classes(docs: DataFrame, weights: str = "set", width: int = WIDTH) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size``."""
    sig, ids = _classes(docs, weights, width)
    out = sig.select("doc_id", "fa", "fb", (F.col("size") > 0).alias("_full"))
    joined = out.where("_full").join(ids, ["fa", "fb"]).select("doc_id", "class_id", "class_size")
    alone = out.where("not _full").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return joined.unionByName(alone)


def drop_near(docs: DataFrame, weights: str = "set", width: int = WIDTH) -> DataFrame:
    """Exactly one row of each class, with the columns of ``docs``: of the class's first fingerprint the row with
    the smallest doc_id (nulls last), then the smallest text hash.  Rows are told apart by (doc_id, text
    hash), so a text that only shares its doc_id with a dropped one stays; of rows that repeat both, one
    stays."""
    sig, ids = _classes(docs, weights, width)
    several = ids.where("class_size > 1")
    row = sig.where("size > 0").select("doc_id", "th", "fa", "fb").join(several, ["fa", "fb"])
    row = keep(row.groupBy("doc_id", "th", "fa", "fb", "head").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    stays = row.where("head").groupBy("fa", "fb").agg(F.min(order).alias("_s"))
    fate = (row.join(stays, ["fa", "fb"], "left")
            .withColumn("stays", F.coalesce(F.col("head") & F.col("doc_id").eqNullSafe(F.col("_s.doc_id")) & (F.col("th") == F.col("_s.th")), F.lit(False))))
    fate = keep(fate.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "stays"), "near-fate")
    # only rows whose bucket holds a key with a fate are shuffled
    own = ("doc_id", "text")
    key = (F.col("doc_id").cast("long"), F.col("th"))
    marked = in_buckets(shield(docs, *own).withColumn("th", _text_hash()), bucket_of(*key),
                        fate.select(bucket_of(F.col("_d"), F.col("_t")).alias("b")), "_maybe")
    sure = marked.where(~F.col("_maybe"))
    rest = marked.where("_maybe").join(fate, key[0].eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    free = rest.where(F.col("stays").isNull())
    once = rest.where("stays").groupBy("_d", "_t").agg(F.first(F.struct("doc_id", "text", "_row")).alias("_one")).select("_one.*")
    parts = [unshield(x, docs, *own) for x in (sure, free, once)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
