"""Operator 11, spelling variant grouping: k-d trees over letter-count vectors.

Words are points of ``DIMS`` letter counts (a to z, and the accented letters dealt over the
rest; merging counters can only shorten a distance).  One edit changes the counts by L1
distance at most two: a replaced letter is one count up and one down between words of equal
length, an added letter one count up between lengths ``l`` and ``l + 1``.  So there is one tree
per length, and a word searches its own length's tree and the next one's.

The search walks a tree with the two single steps that an edit may use: crossing a split
upwards spends the step up, crossing downwards the step down, and a box that would need more
is pruned.  The same walk runs twice.  A tree fitted on a bounded sample cuts each length into
cells of about ``CELL`` words (the sample shapes cells only: every word lies in one cell, and
visits each other cell whose box its steps reach); the cells are groups of one shuffle.  Inside
a cell a second tree of all its words prunes down to ``LEAF`` points, whose counts are compared
by dot products, and pairs within the distance are verified letter by letter.  Every pair is
met in exactly one cell.  A cell that turns out larger than ``4 * CELL`` (words with equal
counts cannot be split) is dealt into parts that its searchers all visit.

Only per-word sums leave a cell (number of near words, best near word), and roots are found by
pointer doubling: counts rise tenfold with each form, so 18 hops are the most there can be.

Cases: null or empty texts have no words; a null doc_id counts as the empty string in the
hash; repeated rows count again; ties of n go to the smallest word in code-point order; runs
of any length are kept whole; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import arrow_ready, keep
from cadenza.llm.resample import crc32_spans
from cadenza.llm.words import pieces

DIMS = 32            # letter counters
CELL = 16_384        # words of an average cell
LEAF = 256           # points of a leaf inside a cell
SAMPLE = 200_000     # words that shape the cells
FREE, GONE = -1, -2  # state of a step: not spent, not to be had; else the counter it was spent on
MIN_LETTERS = 7      # shortest word
COPYING = 31         # one in so many (document, run) loses a letter
RATIO = 10           # a form is so many times more frequent

#: counter of each Latin-1 letter
COUNTER = np.zeros(256, dtype=np.int64)
COUNTER[0x61:0x7B] = np.arange(26)
COUNTER[0xC0:] = 26 + np.arange(64) % (DIMS - 26)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC3] = True


# words --------------------------------------------------------------------------
def letter_runs(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with at least ``least`` letters, lower-cased
    in A-Z: UTF-8 values and the text of each.  (U+00C0 to U+00FF are byte C3 and one more.)"""
    t = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(t.buffers()[1], dtype=np.int64)[t.offset:t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == 0xC3
    inside = _LETTER[data] | second
    change = np.ones(len(data) + 1, dtype=bool)
    change[1:-1] = inside[1:] != inside[:-1]
    change[bounds] = True                        # no run crosses the end of a text
    cuts = np.flatnonzero(change)
    start, stop = cuts[:-1], cuts[1:]
    long = np.flatnonzero(inside[start] & (stop - start >= least)) if len(start) else np.zeros(0, np.int64)
    start, stop = start[long], stop[long]
    letters = np.concatenate([[0], np.cumsum(~second)])
    ok = letters[stop] - letters[start] >= least
    start, stop = start[ok], stop[ok]
    size = stop - start
    first = np.cumsum(size) - size
    flat = data[np.repeat(start - first, size) + np.arange(int(size.sum()))]
    words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.append(first, size.sum()).astype(np.int64)), pa.py_buffer(flat)])
    return words, np.searchsorted(bounds, start, side="right") - 1


def copied(runs: pa.Array, text: np.ndarray, ids: list) -> tuple[list[str], np.ndarray]:
    """Distinct words of a batch with their occurrences, some with a letter lost as the hash
    of document and run says."""
    if not len(runs):
        return [], np.zeros(0, np.int64)
    enc = runs.dictionary_encode()
    code, vocabulary = np.asarray(enc.indices, dtype=np.int64), enc.dictionary
    pair, n = np.unique(text * len(vocabulary) + code, return_counts=True)
    doc, code = pair // len(vocabulary), pair % len(vocabulary)
    prefix = [f"{'' if i is None else i}:".encode() for i in ids]
    plen = np.array([len(p) for p in prefix], dtype=np.int64)
    pat = np.cumsum(plen) - plen
    offs = np.frombuffer(vocabulary.buffers()[1], dtype=np.int64)[:len(vocabulary) + 1]
    source = np.concatenate([np.frombuffer(b"".join(prefix), dtype=np.uint8), np.frombuffer(vocabulary.buffers()[2], dtype=np.uint8)])
    a, b = plen[doc], (offs[1:] - offs[:-1])[code]
    total = a + b
    first = np.cumsum(total) - total
    size = np.stack([a, b], axis=1).ravel()
    begin = np.stack([pat[doc], plen.sum() + offs[:-1][code]], axis=1).ravel()
    at = np.cumsum(size) - size
    data = source[np.repeat(begin - at, size) + np.arange(int(size.sum()))]
    h = crc32_spans(data, first, total).astype(np.int64)
    lost = h % COPYING == 0
    counts = np.zeros(len(vocabulary), dtype=np.int64)
    np.add.at(counts, code[~lost], n[~lost])
    got = np.flatnonzero(counts)
    words, sums = vocabulary.take(pa.array(got)).to_pylist(), counts[got].tolist()
    for w, x, k in zip(vocabulary.take(pa.array(code[lost])).to_pylist(), h[lost].tolist(), n[lost].tolist()):
        i = x % len(w)
        if len(w) > MIN_LETTERS:
            words.append(w[:i] + w[i + 1:])
            sums.append(k)
    return words, np.array(sums, dtype=np.int64)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words with at least two occurrences."""
    arrow_ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in pieces(batch, size=4 << 20):
                words, n = copied(*letter_runs(p.column("text"), MIN_LETTERS), p.column("doc_id").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], ["word", "n"])

    return (docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2"))


# trees --------------------------------------------------------------------------
def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def counts(rows: np.ndarray) -> np.ndarray:
    at = np.arange(len(rows))[:, None] * DIMS + COUNTER[rows]
    return np.bincount(at.ravel(), minlength=len(rows) * DIMS).reshape(len(rows), DIMS)


class KdTree:
    """Splits at ``counter <= value``, each as even as one counter allows, down to leaves of
    at most ``leaf`` points (or points that are all alike)."""

    def __init__(self, x: np.ndarray, leaf: float):
        self.nodes: list[tuple[int, int, int, int]] = []    # counter, value, left, right; or -1, leaf number
        self.leaves: list[np.ndarray] = []
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            at, parent, side = todo.pop()
            node = len(self.nodes)
            if parent >= 0:
                self.nodes[parent] = (*self.nodes[parent][:2 + side], node, *self.nodes[parent][3 + side:])
            split = self._split(x[at]) if len(at) > leaf else None
            if split is None:
                self.nodes.append((-1, len(self.leaves), 0, 0))
                self.leaves.append(at)
            else:
                small = x[at, split[0]] <= split[1]
                self.nodes.append((*split, 0, 0))
                todo += [(at[~small], node, 1), (at[small], node, 0)]

    @staticmethod
    def _split(x: np.ndarray) -> tuple[int, int] | None:
        top = x.max(axis=0)
        best = None
        for value in range(int(top.max())):
            share = (x <= value).mean(axis=0)
            share[top <= value] = 1
            d = int(np.abs(share - 0.5).argmin())
            if 0 < share[d] < 1 and (best is None or abs(share[d] - 0.5) < best[0]):
                best = (abs(share[d] - 0.5), d, value)
            if value >= 8 and best is not None:
                break
        return None if best is None else best[1:]

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(x), dtype=np.int64)
        for leaf, q, _, _ in self.walk(x, np.full(len(x), GONE), np.full(len(x), GONE)):
            out[q] = leaf
        return out

    def walk(self, x: np.ndarray, up: np.ndarray, down: np.ndarray):
        """Leaves whose boxes lie within the steps left to each query: ``(leaf, queries,
        up, down)``; a query meets a leaf at most once."""
        todo = [(0, np.arange(len(x)), up, down)]
        while todo:
            node, q, u, d = todo.pop()
            if not len(q):
                continue
            counter, value, left, right = self.nodes[node]
            if counter < 0:
                yield value, q, u, d
                continue
            v = x[q, counter] + (u == counter) - (d == counter)
            small = v <= value
            rise = (v == value) & (u == FREE) & (d != counter)
            fall = (v == value + 1) & (d == FREE) & (u != counter)
            a, b = small | fall, ~small | rise
            todo.append((left, q[a], u[a], np.where(fall[a], counter, d[a])))
            todo.append((right, q[b], np.where(rise[b], counter, u[b]), d[b]))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_added(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether deleting one letter of ``long`` gives ``short``."""
    head = np.cumprod(short == long[:, :-1], axis=1, dtype=np.int8).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1)
    return head + tail >= short.shape[1]


def pairs_in_cell(home: list[str], same: list[str], shorter: list[str], up: np.ndarray, down: np.ndarray):
    """Near pairs of a cell as two index arrays into ``home + same + shorter``: home words
    among themselves, and visitors (with the steps left to them) with home words."""
    points = letters(home)
    x = counts(points)
    tree = KdTree(x, LEAF)
    xf, norm = x.astype(np.float32), (x * x).sum(axis=1).astype(np.float32)
    free = np.full(len(home), FREE)
    n_home, n_same = len(home), len(home) + len(same)
    out_q, out_p = [], []
    for words, base, u, d, reach, test in (
            (home, 0, free, free, 2, one_replaced), (same, n_home, up[:len(same)], down[:len(same)], 2, one_replaced),
            (shorter, n_same, up[len(same):], down[len(same):], 1, one_added)):
        if not words:
            continue
        rows = points if base == 0 else letters(words)
        y = x if base == 0 else counts(rows)
        yf, own = y.astype(np.float32), (y * y).sum(axis=1).astype(np.float32)
        for leaf, q, _, _ in tree.walk(y, u, d):
            p = tree.leaves[leaf]
            for s in range(0, len(q), 4096):
                part = q[s:s + 4096]
                for r in range(0, len(p), 4096):
                    block = p[r:r + 4096]
                    # integer vectors whose sums differ by reach - 2 or reach - 1: L1 <= reach is L2 squared <= reach
                    far = own[part][:, None] + norm[block][None, :] - 2 * (yf[part] @ xf[block].T)
                    i, j = np.nonzero(far <= reach)
                    i, j = part[i], block[j]
                    if base == 0:
                        i, j = i[i < j], j[i < j]
                    for c in range(0, len(i), 1 << 18):
                        a, b = i[c:c + (1 << 18)], j[c:c + (1 << 18)]
                        ok = test(rows[a], points[b])
                        out_q.append(a[ok] + base)
                        out_p.append(b[ok])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_q or none), np.concatenate(out_p or none)


def best_in_cell(cell: pa.Table) -> pa.Table:
    """``word, n, n_near, best_n, best`` of the words of a cell that have near words in it."""
    kind = cell.column("kind").to_numpy()
    order = np.argsort(kind, kind="stable")
    cell = cell.take(pa.array(order))
    kind = kind[order]
    words, n = cell.column("word").to_pylist(), cell.column("n").to_numpy()
    a, b = np.searchsorted(kind, [1, 2])
    if a == 0:                                   # visitors only
        q = p = np.zeros(0, np.int64)
    else:
        q, p = pairs_in_cell(words[:a], words[a:b], words[b:], cell.column("up").to_numpy()[a:].astype(np.int64),
                             cell.column("down").to_numpy()[a:].astype(np.int64))
    x, y = np.concatenate([q, p]), np.concatenate([p, q])
    place = np.empty(len(words), dtype=np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    o = np.lexsort((place[y], -n[y], x))
    x, y = x[o], y[o]
    first = np.flatnonzero(np.concatenate([[True], np.diff(x) != 0])[:len(x)])
    near = np.diff(np.append(first, len(x)))
    x, y = x[first], y[first]
    return pa.table({"word": pa.array([words[i] for i in x], pa.string()), "n": pa.array(n[x], pa.int64()), "n_near": pa.array(near, pa.int64()),
                     "best_n": pa.array(n[y], pa.int64()), "best": pa.array([words[i] for i in y], pa.string())})


def cell_trees(words: DataFrame, total: int) -> dict[int, KdTree]:
    """One tree per word length, from about ``SAMPLE`` words chosen by hash."""
    share = min(1.0, SAMPLE / max(1, total))
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word")
    by: dict[int, list[str]] = {}
    for r in picked.collect():
        by.setdefault(len(r["word"]), []).append(r["word"])
    out = {}
    for size, group in by.items():
        tree = KdTree(counts(letters(sorted(group))), max(8, CELL * share))
        tree.leaves = []                         # only the splits travel
        out[size] = tree
    return out


def search_rows(words: DataFrame, trees: dict[int, KdTree]) -> DataFrame:
    """``size, cell, part, kind, word, n, up, down``: each word at home (kind 0) and as a
    visitor of the other cells of its length (1) and of the next length (2)."""
    def by_length(batch: pa.RecordBatch):
        ws, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        size = np.array([len(w) for w in ws])
        for s in np.unique(size).tolist():
            at = np.flatnonzero(size == s)
            group = [ws[i] for i in at]
            yield s, group, n[at], counts(letters(group))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, group, _, x in by_length(batch):
                home = trees[s].home(x) if s in trees else np.zeros(len(group), np.int64)
                cell, k = np.unique(home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), s, np.int32)), pa.array(cell.astype(np.int32)), pa.array(k)],
                                                 ["size", "cell", "k"])

    # one row per cell; the trees on the driver are as large
    held = words.mapInArrow(homes, "size int, cell int, k long").groupBy("size", "cell").agg(F.sum("k").alias("k"))
    parts = {(r["size"], r["cell"]): -(-r["k"] // CELL) for r in held.where(F.col("k") > 4 * CELL).collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, group, n, x in by_length(batch):
                free, gone, all_ = np.full(len(group), FREE), np.full(len(group), GONE), np.arange(len(group))
                home = trees[s].home(x) if s in trees else np.zeros(len(group), np.int64)
                rows = []                        # size, cell, kind, word, up, down

                def visit(size, kind, u, d):
                    for leaf, q, uu, dd in (trees[size].walk(x, u, d) if size in trees else [(0, all_, u, d)]):
                        if kind == 1:
                            on = home[q] < leaf
                            q, uu, dd = q[on], uu[on], dd[on]
                        rows.append((size, leaf, kind, q, uu, dd))
                for leaf in np.unique(home).tolist():
                    q = np.flatnonzero(home == leaf)
                    rows.append((s, leaf, 0, q, free[q], free[q]))
                visit(s, 1, free, free)
                visit(s + 1, 2, free, gone)
                for size, leaf, kind, q, u, d in rows:
                    many = parts.get((size, leaf), 1)
                    own = np.array([hash_part(group[i], many) for i in q]) if many > 1 and kind == 0 else np.zeros(len(q), np.int64)
                    for part in range(many):
                        for k, on in ([(0, own == part), (1, own < part)] if kind == 0 else [(kind, np.ones(len(q), bool))]):
                            if on.any():
                                m = int(on.sum())
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(m, v, np.int32)) for v in (size, leaf, part)] + [pa.array(np.full(m, k, np.int8)),
                                     pa.array([group[i] for i in q[on]]), pa.array(n[q[on]]), pa.array(u[on].astype(np.int8)), pa.array(d[on].astype(np.int8))],
                                    ["size", "cell", "part", "kind", "word", "n", "up", "down"])

    return words.mapInArrow(route, "size int, cell int, part int, kind byte, word string, n long, up byte, down byte")


def hash_part(word: str, parts: int) -> int:
    import zlib
    return zlib.crc32(word.encode()) % parts


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, best_n, best`` of every row of ``words`` (``word, n``): how many others
    are one edit away, and the most frequent of them."""
    arrow_ready(words.sparkSession)
    trees = cell_trees(words, words.count())
    found = (search_rows(words, trees).groupBy("size", "cell", "part")
             .applyInArrow(best_in_cell, "word string, n long, n_near long, best_n long, best string"))
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"),
                        F.lit(None).cast("string").alias("best"))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return (found.unionByName(none).groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
            .select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` by pointer doubling over ``word, form``; chains end."""
    at = keep(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = keep(at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")),
                   "variant-roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus."""
    words = keep(vocabulary(docs), "variant-words")
    near = keep(near_words(words).withColumn("form", F.expr(f"CASE WHEN best_n >= {RATIO} * n THEN best END")), "variant-near")
    up = roots(near.where("form IS NOT NULL"))
    return (near.join(up, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                    F.expr("CASE WHEN form IS NOT NULL THEN best_n END").alias("form_n")))
