"""Operator 1, sharding: histogram sort.

Rows get a unique 192-bit sort key (text hash, doc_id, row mark), kept as 48
hex digits so that string order is key order.  The driver holds only candidate
boundaries: each round counts, across all partitions, the exact bytes in every
cell between neighbouring probes (partial aggregation, one row per cell
reaches the driver), keeps the probes that meet the tolerance and places new
ones inside the cells that still hold a target, between that cell's own
smallest and largest key.  A hot text narrows to its doc_id range in one round,
so it is split like any other.  With all splitters settled the rows are
exchanged once, by range, and numbered inside each range; a shard consists of
``m`` ranges, so that no task grows with the table.

Cases: null text counts as no bytes (size 1) and hashes as the empty text;
equal texts are neighbours in key order; repeated rows (same doc_id and text)
are told apart by the row mark and may fall on both sides of a splitter; null
doc_id sorts first; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import keep, sortable, text_of

PROBES = 7           # new probes per unsettled target and round
TREE = 160           # splitters of one CASE tree (larger methods are not compiled by the JVM)
DIGITS = 48


def _hex(k: int) -> str:
    return f"{k:0{DIGITS}X}"


def cell_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below ``key``: a balanced CASE tree, over every
    n-th splitter if there are many; the run in between is then counted."""
    n = -(-len(splitters) // TREE) if len(splitters) > TREE else 1
    coarse = splitters[n - 1::n]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(coarse[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    if n == 1:
        return tree(0, len(coarse))
    runs = [splitters[i * n:i * n + n - 1] for i in range(len(coarse) + 1)]
    arrays = F.array(*[F.array(*[F.lit(s) for s in r]).cast("array<string>") for r in runs])
    c = tree(0, len(coarse))
    return c * n + F.size(F.filter(F.element_at(arrays, c + 1), lambda s: s <= key))


def _histogram(rows: DataFrame, splitters: list[str]) -> list:
    return (rows.groupBy(cell_of(F.col("k"), splitters).alias("cell"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                 F.min("k").alias("lo"), F.max("k").alias("hi")).collect())


def find_splitters(rows: DataFrame, parts: int, tolerance: float, max_rounds: int = 64) -> list[str]:
    """``parts - 1`` ascending keys; the bytes strictly below the j-th are within
    ``tolerance * total / parts`` of ``j * total / parts``, or as near as a whole row
    allows.  ``rows``: ``k`` (unique hex key) and ``size``."""
    first = _histogram(rows, [])
    if not first or parts < 2:
        return []
    total, lo, hi = first[0]["bytes"], int(first[0]["lo"], 16), int(first[0]["hi"], 16)
    targets = [j * total / parts for j in range(1, parts)]
    tol = tolerance * total / parts
    below = {lo: 0, hi + 1: total}      # edge -> exact bytes of the rows with a smaller key
    cells = {lo: (lo, hi)}              # left edge -> smallest and largest key present
    done: dict[int, int] = {}           # target -> its splitter
    best: dict[int, int] = {}
    for _ in range(max_rounds):
        edges = sorted(below)
        sums = [below[e] for e in edges]
        probes: set[int] = set()
        for j, t in enumerate(targets):
            if j in done:
                continue
            i = bisect_right(sums, t) - 1                          # last edge with below <= t
            off, best[j] = min((abs(below[e] - t), e) for e in edges[i:i + 2])
            a, b = cells.get(edges[i], (0, 0))
            if off <= tol or a == b:    # near enough, or a single row: no boundary inside it
                done[j] = best[j]
                continue
            span = b - a
            probes.update(edges[i:i + 2])
            probes.update(a + max(1, span * q // (PROBES + 1)) for q in range(1, PROBES + 1))
            probes.add(b)
        if len(done) == len(targets):
            break
        asked = sorted(p for p in probes if lo < p <= hi)
        got = {r["cell"]: r for r in _histogram(rows, [_hex(p) for p in asked])}
        below, cells, acc = {}, {}, 0
        for c, edge in enumerate([lo, *asked]):
            below[edge] = acc
            if c in got:
                cells[edge] = (int(got[c]["lo"], 16), int(got[c]["hi"], 16))
                acc += got[c]["bytes"]
        below[hi + 1] = total
    return [_hex(done.get(j, best[j])) for j in range(len(targets))]


def histogram_shards(docs: DataFrame, n_shards: int = 16, tolerance: float = 5e-4,
                     rows_per_range: int = 1_000_000) -> DataFrame:
    """Shards of near equal bytes: ``doc_id, size, text_crc32, shard, slot``.

    ``slot`` is gapless from 0 inside a shard, in key order."""
    t = text_of()
    rows = keep(docs.select(
        "doc_id", (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.concat(sortable(F.xxhash64(t)), sortable(F.col("doc_id").cast("long")),
                 sortable(F.monotonically_increasing_id())).alias("k")), "shard-keys")
    m = max(1, -(-rows.count() // (n_shards * rows_per_range)))
    splitters = find_splitters(rows, n_shards * m, tolerance)
    ranged = rows.withColumn("part", cell_of(F.col("k"), splitters))
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # n_shards * m rows
    first, acc = [], 0
    for p in range(n_shards * m):
        acc = 0 if p % m == 0 else acc
        first.append(acc)
        acc += counts.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("part") + 1)
    w = Window.partitionBy("part").orderBy("k")
    return (ranged.withColumn("rn", F.row_number().over(w))
            .select("doc_id", "size", "text_crc32",
                    F.floor(F.col("part") / m).cast("int").alias("shard"),
                    (offset + F.col("rn") - 1).alias("slot")))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, tolerance: float = 5e-4) -> None:
    """Write whole rows by shard (``path/shard=N/``).  ``doc_id`` must be unique here."""
    sh = histogram_shards(docs, n_shards, tolerance).select("doc_id", "shard", "slot")
    docs.join(sh, "doc_id").write.partitionBy("shard").parquet(path)
