"""Alignment of poems with repeating feet: the best stress variants of every line, the best
metre and the rhyme scheme of a poem of one, two or four lines.

Each word has one or more stress variants with weights.  A line is a lattice of them; a
reading is one variant per word, and its score is the product of the word weights, 0.1 for
a stress where the foot has none, 0.95 for a missing one, 0.1 for two stresses in a row
across a word border and 0.1 for every run of four or more unstressed syllables.  Scores
are decimal logarithms here, so products are sums and equal scores stay equal.

Plan: lines are reduced to lattice strings (vowel counts and weighted stresses), equal
lattices are matched once.  :func:`lattice_variants` keeps, per metre, prefix and ending
(the last stressed word and what follows), the best reading only: what a reading
contributes further on depends on its trailing syllables alone, so six states per word
position hold all readings of a line, however many there are.  Poems then combine the few
endings of their lines inside their row; the best of all metres is taken by ``array_max``.

``FEET`` (``profiles``) are the five feet.  Prefix 1 puts one unstressed syllable in front.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators.corpus import cut_lines, settled, tasks
from cadenza.operators.lookup import word_values
from cadenza.operators.rhyme import FOLD_FROM, FOLD_TO
from cadenza.profiles import FEET, LATIN, Profile, profile as get_profile

# Factors of the alignment (stress off the foot, foot without stress, two stresses
# in a row, a run of unstressed syllables), and the longest line in words of several vowels.
EXTRA_STRESS, MISSING_STRESS, ADJACENT_STRESSES, UNSTRESSED_RUN = 0.1, 0.95, 0.1, 0.1
RUN = 4
TOO_COMPLEX = 8
# Factors of poem defects and rhyme schemes.
ODD_PREFIX, ODD_LENGTHS, COUPLET_FREE = 0.1, 0.1, 0.75
PER_PREFIX = 2      # endings kept per line, metre and prefix in couplets
MODES = [(m, p) for m in range(len(FEET)) for p in (0, 1)]
NONE = -1e9         # no reading

VARIANT = "struct<metre:int,prefix:int,word:int,stress:int,score:double,path:string>"


# ---------------------------------------------------------------------------
# words -> weighted stress variants
# ---------------------------------------------------------------------------
def short_word_options(word: Column, n: Column) -> Column:
    """Options of words whose stress no dictionary decides: none without vowels; words of one
    vowel may go either way, short ones (up to three letters) rather unstressed."""
    return (F.when(n == 0, "0:0/100").when((n == 1) & (F.length(word) <= 3), "1:0/100,1/95")
            .when(n == 1, "1:0/70,1/100"))


def variant_options(dictionary: DataFrame, listed: DataFrame, prof: Profile | str = LATIN) -> DataFrame:
    """``word, options`` for words of several vowels: the dictionary's stress at weight 1, every
    other listed stress (a shift of stress) at 0.99.  ``options`` is ``vowels:stress/percent,...``."""
    both = (dictionary.select("word", "stress", F.lit(100).alias("weight"))
            .unionByName(listed.select("word", "stress", F.lit(99).alias("weight"))))
    n = T.vowel_count("word", prof)
    # the rule is asked behind `settled`: pushed into one of the two scans of the listed words, it would make them two
    one = settled(both.groupBy("word", "stress").agg(F.max("weight").alias("weight")))
    one = one.where((n > 1) & F.col("stress").between(1, n))
    part = F.struct("stress", F.concat_ws("/", F.col("stress").cast("string"), F.col("weight").cast("string")).alias("o"))
    return (one.groupBy("word").agg(F.sort_array(F.collect_list(part)).alias("p"))
            .select("word", F.concat(n.cast("string"), F.lit(":"), F.array_join(F.col("p.o"), ",")).alias("options")))


# ---------------------------------------------------------------------------
# lattice -> best reading per metre, prefix and ending
# ---------------------------------------------------------------------------
def _feet(length: int) -> np.ndarray:
    """``[mode, syllable]``: whether a stress is expected."""
    out = np.zeros((len(MODES), length), dtype=np.int64)
    for i, (m, p) in enumerate(MODES):
        foot = [int(c) for c in FEET[m][1]]
        for s in range(p, length):
            out[i, s] = foot[(s - p) % len(foot)]
    return out


# States after a word: 0 ends stressed, 1..3 so many unstressed syllables at the end,
# 4 four or more (already paid for), 5 nothing unstressed at the end and no stress to collide with.
STATES = 6
_RUN_OF = np.array([0, 1, 2, 3, 4, 0])


def _step(n: np.ndarray, s: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
    """New state and log factor when a word of ``n`` vowels stressed at ``s`` (0: not) follows ``state``."""
    run = _RUN_OF[state]
    lead = np.where(s > 0, s - 1, n)
    cost = np.where((run < RUN) & (run + lead >= RUN), math.log10(UNSTRESSED_RUN), 0.0)
    if state == 0:
        cost = cost + np.where(s == 1, math.log10(ADJACENT_STRESSES), 0.0)
    tail = n - s
    cost = cost + np.where((s > 0) & (tail >= RUN), math.log10(UNSTRESSED_RUN), 0.0)
    new = np.where(s > 0, np.where(tail == 0, 0, np.minimum(tail, RUN)),
                   np.where(n == 0, 5 if state == 0 else state, np.minimum(run + n, RUN)))
    return new, cost


def _readings(lattices: list[str], paths: bool = True):
    """``lattice, word, stress, score, path`` of all endings; word -1: nothing stressed.  ``score`` has a column
    per mode, ``path`` is ``[ending, mode, word]`` (None without ``paths``)."""
    words = [[w.split(":") for w in x.split(" ")] if x else [] for x in lattices]
    N, K, M = len(words), max(map(len, words), default=0), len(MODES)
    size = np.array([len(w) for w in words])
    O = max((o.count(",") + 1 for w in words for _, o in w), default=1)
    n = np.zeros((N, K), dtype=np.int64)
    s = np.full((N, K, O), -1, dtype=np.int64)
    weight = np.full((N, K, O), NONE)
    for i, line in enumerate(words):
        for k, (vowels, options) in enumerate(line):
            n[i, k] = int(vowels)
            for j, o in enumerate(options.split(",")):
                a, b = o.split("/")
                s[i, k, j], weight[i, k, j] = int(a), math.log10(int(b) / 100)
    cursor = np.cumsum(n, axis=1) - n
    feet = _feet(int(n.sum(axis=1).max(initial=0)) + 1)
    total = np.concatenate([np.zeros((M, 1), np.int64), np.cumsum(feet, axis=1)], axis=1)
    modes = np.arange(M)

    def local(rows: np.ndarray, k, j) -> np.ndarray:
        """Log score of option j of word k in every mode, by itself."""
        c, m, st = cursor[rows, k], n[rows, k], s[rows, k, j]
        expected = (total[:, c + m] - total[:, c]).T
        hit = np.where(st[:, None] > 0, feet[:, np.maximum(c + st - 1, 0)].T, 0)
        extra = np.where(st[:, None] > 0, 1 - hit, 0)
        return weight[rows, k, j][:, None] + extra * math.log10(EXTRA_STRESS) + (expected - hit) * math.log10(MISSING_STRESS)

    best = np.full((K + 1, N, M, STATES), NONE)
    best[0, :, :, 5] = 0.0
    back = np.zeros((K + 1, N, M, STATES), dtype=np.int16) if paths else None
    for k in range(K):
        rows = np.flatnonzero(size > k)
        new, ptr = np.full((len(rows), M, STATES), NONE), np.zeros((len(rows), M, STATES), dtype=np.int16)
        for j in range(O):
            use = np.flatnonzero(s[rows, k, j] >= 0)
            part = rows[use]
            if not len(part):
                continue
            own = local(part, k, j)
            for state in range(STATES):
                to, cost = _step(n[part, k], s[part, k, j], state)
                value = best[k, part, :, state] + own + cost[:, None]
                at = (use[:, None], modes[None, :], to[:, None])
                old = new[at]
                more = value > old + 1e-9
                new[at] = np.where(more, value, old)
                if paths:
                    ptr[at] = np.where(more, j * STATES + state, ptr[at])
        best[k + 1, rows] = new
        if paths:
            back[k + 1, rows] = ptr
    # words that stay unstressed: from k on, their score and their syllables
    has_zero = (s == 0).any(axis=2) if K else np.zeros((N, 0), bool)
    zero = np.argmax(s == 0, axis=2) if K else np.zeros((N, 0), np.int64)
    free = np.ones((N, K + 1), dtype=bool)
    rest, syllables = np.zeros((K + 1, N, M)), np.zeros((N, K + 1), np.int64)
    for k in range(K - 1, -1, -1):
        free[:, k] = free[:, k + 1] & ((size <= k) | has_zero[:, k])
        syllables[:, k] = syllables[:, k + 1] + n[:, k]
        rows = np.flatnonzero((size > k) & free[:, k])
        rest[k] = rest[k + 1]
        rest[k, rows] += local(rows, k, zero[rows, k])

    def late_run(run: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.where((run < RUN) & (run + more >= RUN), math.log10(UNSTRESSED_RUN), 0.0)[:, None]
    # an ending: word i is the last stressed one; i = -1: none is
    lat, i, j = np.nonzero((s > 0) & free[:, 1:, None])
    bare = np.flatnonzero(free[:, 0])
    score, frm = np.zeros((len(lat), M)), np.zeros((len(lat), M), np.int64)
    if len(lat):
        options = np.stack([best[i, lat, :, st] + _step(n[lat, i], s[lat, i, j], st)[1][:, None] for st in range(STATES)], axis=-1)
        frm = (options + 1e-9 * np.arange(STATES, 0, -1)).argmax(axis=-1)
        score = np.take_along_axis(options, frm[..., None], -1)[..., 0] + local(lat, i, j) + rest[i + 1, lat]
        score = score + late_run(np.minimum(n[lat, i] - s[lat, i, j], RUN), syllables[lat, i + 1])
    none = rest[0, bare] + late_run(np.zeros(len(bare), np.int64), syllables[bare, 0])
    path = None
    if paths:
        path = np.zeros((len(lat) + len(bare), M, K), dtype=np.int64)
        at = frm
        path[np.arange(len(lat)), :, i] = s[lat, i, j][:, None]
        for k in range(K - 1, 0, -1):
            mine = np.flatnonzero(i >= k)
            ptr = back[k][lat[mine, None], modes[None, :], at[mine]].astype(np.int64)
            path[mine, :, k - 1] = s[lat[mine, None], k - 1, ptr // STATES]
            at[mine] = ptr % STATES
    return (np.concatenate([lat, bare]), np.concatenate([i, np.full(len(bare), -1)]),
            np.concatenate([s[lat, i, j], np.zeros(len(bare), np.int64)]), np.round(np.concatenate([score, none]), 9), path)


CELLS = 40_000      # words of lattices that are walked at a time


def _of_like_size(lattices: list[str], paths: bool) -> Iterator[np.ndarray]:
    """Positions of lattices, by number of words: a long line pads only lines of about its length."""
    size = np.array([x.count(" ") + 1 for x in lattices])
    order = np.argsort(size, kind="stable")
    first = 0
    while first < len(order):
        last = first + 1
        while last < len(order) and (last + 1 - first) * size[order[last]] ** (2 if paths else 1) <= CELLS:
            last += 1
        yield order[first:last]
        first = last


def _variants(batches):
    import pandas as pd
    for pdf in batches:
        every = pdf["lattice"].tolist()
        for some in _of_like_size(every, True):
            lattices = [every[x] for x in some]
            out: list[list] = [[] for _ in lattices]
            length = [len(x.split(" ")) if x else 0 for x in lattices]
            for lat, word, stress, score, path in zip(*_readings(lattices)):
                for mode, (m, p) in enumerate(MODES):
                    out[lat].append((m, p, int(word), int(stress), float(score[mode]), ",".join(map(str, path[mode, :length[lat]]))))
            yield pd.DataFrame({"lattice": lattices, "variants": [
                [dict(zip(("metre", "prefix", "word", "stress", "score", "path"), v)) for v in sorted(vs)] for vs in out]})


def lattice_variants(lattices: DataFrame) -> DataFrame:
    """``lattice, variants``: of each distinct lattice the best reading per metre, prefix and
    ending (``word``, ``stress`` of the last stressed word; -1 if none is stressed)."""
    return (lattices.select("lattice").distinct().repartition(tasks(lattices.sparkSession))      # few bytes, much work
            .mapInPandas(_variants, f"lattice string, variants array<{VARIANT}>"))


def _best(kind: np.ndarray, lat: np.ndarray, word: np.ndarray, stress: np.ndarray, score: np.ndarray, path) -> tuple:
    """Of the endings of ``_readings`` those that ``lattice_endings`` returns: ``lattice, word, stress``, ``[ending, metre]``
    prefix (-1: none), score and mode's path."""
    kind = kind[lat]
    metres = np.arange(len(FEET))
    # the best reading of the lattice, without prefix; of equal ones the last path
    line = np.flatnonzero(kind == ANY_ENDING)
    top = np.zeros((0, len(FEET)), np.int64)
    owner = np.unique(lat[line])
    if len(line):
        top = np.zeros((len(owner), len(FEET)), np.int64)
        for m in metres:
            by = [score[line, 2 * m], lat[line]]
            if path is not None:
                text = np.array([",".join(map(str, x)) for x in path[line, 2 * m]])
                by.insert(0, text)
            at = np.lexsort(by)
            ends = np.flatnonzero(np.append(np.diff(lat[line][at]) != 0, True))
            top[:, m] = line[at][ends]
    rest = np.flatnonzero((kind != ANY_ENDING) & (word >= 0))
    kept = np.ones((len(rest), len(MODES)), bool)
    few = np.flatnonzero(kind[rest] > 0)
    for mode in range(len(MODES)):
        r = rest[few]
        at = np.lexsort([stress[r], word[r], -score[r, mode], lat[r]])
        new = np.append(True, np.diff(lat[r][at]) != 0)[:len(at)]
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        kept[few[at], mode] = place < kind[r][at]
    pair = np.where(kept, score[rest], -np.inf).reshape(len(rest), len(FEET), 2)
    prefix = (pair[..., 1] > pair[..., 0]).astype(np.int64)
    value = pair.max(axis=2)
    prefix = np.where(np.isinf(value), -1, prefix)
    ending = np.concatenate([top, np.broadcast_to(rest[:, None], (len(rest), len(FEET)))])
    return (np.concatenate([owner, lat[rest]]), np.concatenate([np.full(len(owner), -1), word[rest]]),
            np.concatenate([np.zeros(len(owner), np.int64), stress[rest]]), np.concatenate([np.zeros_like(top), prefix]),
            np.concatenate([score[top, 2 * metres[None, :]], value]), ending)


def _endings(paths: bool):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            every, kinds = batch.column("lattice").to_pylist(), batch.column("kind").to_numpy()
            for some in _of_like_size(every, paths):
                lattices = [every[x] for x in some]
                found = _readings(lattices, paths)
                lat, word, stress, prefix, score, ending = _best(kinds[some], *found)
                at = np.lexsort([stress, word, lat])
                lat, word, stress, prefix, score, ending = (x[at] for x in (lat, word, stress, prefix, score, ending))
                text = [None] * prefix.size
                if paths:
                    long = [x.count(" ") + 1 for x in lattices]
                    mode = 2 * np.arange(len(FEET))[None, :] + np.maximum(prefix, 0)
                    text = [",".join(map(str, found[-1][e, m, :long[l]])) for e, m, l in
                            zip(ending.ravel(), mode.ravel(), np.repeat(lat, len(FEET)))]
                best = pa.StructArray.from_arrays([pa.array(prefix.ravel().astype(np.int32)), pa.array(score.ravel()), pa.array(text, pa.string())],
                                                  ["prefix", "score", "path"], mask=pa.array(prefix.ravel() < 0))
                best = pa.ListArray.from_arrays(pa.array(np.arange(0, prefix.size + 1, len(FEET), dtype=np.int32)), best)
                ends = pa.StructArray.from_arrays([pa.array(word.astype(np.int32)), pa.array(stress.astype(np.int32)), best], ["word", "stress", "best"])
                cut = np.searchsorted(lat, np.arange(len(lattices) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lattices), pa.array(kinds[some]), pa.ListArray.from_arrays(pa.array(cut), ends)],
                                                 ["lattice", "kind", "ends"])
    return run


# Kinds of endings that are asked of a line: all, or so many of each metre and prefix, or its best reading whatever its ending.
ALL_ENDINGS, ANY_ENDING = 0, -1
ENDS = "array<struct<word:int,stress:int,best:array<struct<prefix:int,score:double,path:string>>>>"


def lattice_endings(lattices: DataFrame, paths: bool = True) -> DataFrame:
    """``lattice, kind, ends`` of each distinct ``lattice, kind``: per ending the best reading of every metre (of equal
    scores the one without a prefix; NULL where ``kind`` leaves none).  Kind ``ANY_ENDING`` has one entry, word -1: the
    best reading without a prefix."""
    return (lattices.select("lattice", "kind").distinct().repartition(tasks(lattices.sparkSession))      # few bytes, much work
            .mapInArrow(_endings(paths), f"lattice string, kind int, ends {ENDS}"))


# ---------------------------------------------------------------------------
# poems
# ---------------------------------------------------------------------------
def blocks(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, block, lines``: the verse lines of a document in poems of four; a rest of three
    is a couplet and a single line."""
    d = cut_lines(docs, key, text_col).where(F.size("_l") > 0)
    full = F.floor(F.size("_l") / 4).cast("int")
    rest = F.size("_l") % 4
    fours = F.transform(F.sequence(F.lit(0), full), lambda b: F.slice("_l", b * 4 + 1, 4))
    tail = F.element_at(fours, full + 1)
    cut = F.when(rest == 0, F.slice(fours, F.lit(1), full)).when(
        rest == 3, F.concat(F.slice(fours, F.lit(1), full), F.array(F.slice(tail, 1, 2), F.slice(tail, 3, 1)))).otherwise(fours)
    d = settled(d.select(key, cut.alias("_b")))
    return d.select(key, F.posexplode("_b").alias("block", "lines"))


def too_complex(lines: Column, prof: Profile | str = LATIN) -> Column:
    p = get_profile(prof)

    def vowels(w: Column) -> Column:
        return F.length(F.regexp_replace(w, p.non_vowel_class, ""))
    return F.exists(lines, lambda l: F.size(F.filter(T.words(l), lambda w: vowels(w) > 1)) >= TOO_COMPLEX)


def line_lattices(poems: DataFrame, options: DataFrame, keys=("doc_id", "block"), prof: Profile | str = LATIN) -> DataFrame:
    """``keys, line_no, words, lattice`` of every line.  A word's options are decided once, by itself (no vowel
    or one) or from the options table; the default rule where that is silent."""
    own = [*keys, "line_no"]
    lines = poems.select(*keys, F.posexplode("lines").alias("line_no", "line"))
    x = settled(lines.select(*own, T.words("line").alias("ws")))

    def lattice(words: DataFrame) -> DataFrame:
        w = words.join(options.select("word", "options"), "word", "left").withColumn("c", T.vowel_count("word", prof))
        c = F.col("c")
        plain = F.concat(c.cast("string"), F.lit(":"), T.default_stress(c).cast("string"), F.lit("/100"))
        return w.select("word", "n", F.coalesce(short_word_options(F.col("word"), c), "options", plain).alias("value"))
    return word_values(x, own, lattice).select(*own, F.split("line", " ").alias("words"), F.translate("vals", "|", " ").alias("lattice"))


def ending_key(words: Column, word: Column, stress: Column, prof: Profile | str = LATIN) -> Column:
    """Canonical ending: from the stressed vowel of ``words[word]`` to the line's end, accents
    folded; with the stress on the line's last letter the letter before counts too."""
    p = get_profile(prof)
    w = F.get(words, word)
    segs = F.regexp_extract_all(w, F.lit(p.vowel_class + p.non_vowel_class + "*"), 0)
    core = F.array_join(F.slice(segs, stress, F.greatest(F.size(segs), F.lit(1))), "")
    rest = F.array_join(F.slice(words, word + 2, F.greatest(F.size(words), F.lit(1))), "")
    start = F.length(w) - F.length(core)
    bare = (F.length(rest) == 0) & (F.length(core) == 1) & (start > 0)
    return F.translate(F.concat(F.when(bare, F.substring(w, start, F.lit(1))).otherwise(F.lit("")), core, rest), FOLD_FROM, FOLD_TO)


def _line_endings(poems: DataFrame, options: DataFrame, keys: list[str], kind: Column, prof: Profile | str, paths: bool) -> DataFrame:
    """``keys, line_no, metre, prefix, word, stress, ending, n_syl, score, path``; ``kind`` over the columns of ``keys``."""
    lat = line_lattices(poems, options, keys, prof).withColumn("kind", kind)
    v = lat.join(lattice_endings(lat, paths), ["lattice", "kind"])
    n_syl = F.length(F.regexp_replace(F.array_join("words", ""), get_profile(prof).non_vowel_class, ""))
    x = v.select(*keys, "line_no", "words", n_syl.alias("n_syl"), F.explode("ends").alias("e"))
    ending = ending_key(F.col("words"), F.col("e.word"), F.col("e.stress"), prof)
    x = x.select(*keys, "line_no", "n_syl", "e.word", "e.stress", ending.alias("ending"), F.posexplode("e.best").alias("metre", "b")).where("b IS NOT NULL")
    return x.select(*keys, "line_no", "metre", "b.prefix", "word", "stress", "ending", "n_syl", "b.score", "b.path")


def best_variant_per_tail(poems: DataFrame, options: DataFrame, keys=("doc_id", "block"), per_prefix: int | None = None,
                          prof: Profile | str = LATIN, paths: bool = True) -> DataFrame:
    """``keys, line_no, metre, prefix, word, stress, ending, n_syl, score, path``: the best stress
    variant of a line per metre and ending; of equal scores the one without a prefix.
    ``per_prefix``: only so many endings of each metre and prefix are looked at.  Without ``paths``
    ``path`` is NULL."""
    return _line_endings(poems, options, list(keys), F.lit(per_prefix or ALL_ENDINGS), prof, paths)


# Schemes of four lines in the order they are tried, with their factor
SCHEMES = [("r01 AND r12 AND r23", "AAAA", 1.0), ("r02 AND r13", "ABAB", 1.0), ("r03 AND r12", "ABBA", 1.0),
           ("r01 AND r23", "AABB", 1.0), ("r01 AND r03 AND NOT r02", "AABA", 1.0), ("r02 AND NOT r13", "A-A-", 0.75),
           ("NOT r02 AND r13", "-A-A", 0.75), ("r12 AND NOT r01 AND NOT r23", "-AA-", 0.75), ("true", "----", 0.5)]
# Lines of each scheme that must share an ending.
PARTS = {"AAAA": [(0, 1, 2, 3)], "ABAB": [(0, 2), (1, 3)], "ABBA": [(0, 3), (1, 2)], "AABB": [(0, 1), (2, 3)], "AABA": [(0, 1, 3), (2,)],
         "A-A-": [(0, 2), (1,), (3,)], "-A-A": [(1, 3), (0,), (2,)], "-AA-": [(1, 2), (0,), (3,)], "----": [(0,), (1,), (2,), (3,)]}


def _joined(parts: list[Column], lines: list[tuple], paths: bool) -> Column:
    """Sum of parts; with ``paths`` a struct of the sum and the paths in line order."""
    if not paths:
        return reduce(lambda a, b: a + b, parts)
    score = F.round(reduce(lambda a, b: a + b, [p["score"] for p in parts]), 9)
    where = {i: p[f"p{i}"] for p, ls in zip(parts, lines) for i in ls}
    return F.when(score.isNotNull(), F.struct(score.alias("score"), *[where[i].alias(f"p{i}") for i in sorted(where)]))


def _of_parity(lines: list[tuple], parity: int) -> list[tuple]:
    """Which of the parts have an odd number of prefixes, so that all together have ``parity``."""
    return [odd for odd in itertools.product((0, 1), repeat=len(lines)) if sum(odd) % 2 == parity]


def _greatest(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def align_scores(poems: DataFrame, options: DataFrame, keys=("doc_id", "block"), prof: Profile | str = LATIN, paths: bool = True) -> DataFrame:
    """``keys, n_lines, metre, scheme, log_score, score, paths`` of every poem of one, two or
    four lines: the metre, stress variants (``paths``: stresses per word of each line) and
    rhyme scheme of the highest score.  Ties go to the earlier metre, then the scheme's name.
    Poems with a line of eight or more words of several vowels, or without a rhyming ending
    in every line, have no metre and score 0.  Without ``paths`` that column is left out.

    A scheme is the product of parts, lines that share an ending and lines that are free, and only
    the number of prefixes (odd or even) ties the parts together.  So each part's best is one maximum
    over the endings; no combination of the lines' endings is made.  Where a combination meets several
    schemes, the one that is tried first has the highest factor and rank, so the maximum finds it."""
    keys = list(keys)
    fine = poems.where(~too_complex(F.col("lines"), prof)).withColumn("_n", F.size("lines")).where(F.col("_n").isin(1, 2, 4))
    own = [*keys, "_n"]
    kind = F.when(F.col("_n") == 1, ANY_ENDING).when(F.col("_n") == 2, PER_PREFIX).otherwise(ALL_ENDINGS)
    v = _line_endings(fine, options, own, kind, prof, paths)

    def value(i: int) -> Column:
        return F.struct("score", F.col("path").alias(f"p{i}")) if paths else F.col("score")
    # the best of each line and prefix, of one ending
    first = [F.max(F.when((F.col("line_no") == i) & (F.col("prefix") == p), value(i))).alias(f"b{i}_{p}") for i in range(4) for p in (0, 1)]
    sizes = [F.max(F.when(F.col("line_no") == i, F.col("n_syl"))).alias(f"n{i}") for i in range(4)]
    e = v.groupBy(*own, "metre", "ending").agg(*first, *sizes)
    # the best of each part and parity, of all endings
    parts = sorted({p for ps in PARTS.values() for p in ps})

    def same_ending(part: tuple, parity: int) -> Column:
        lines = [(i,) for i in part]
        return _greatest([_joined([F.col(f"b{i}_{o}") for i, o in zip(part, odd)], lines, paths) for odd in _of_parity(lines, parity)])

    def name(part: tuple, parity: int) -> str:
        return "x" + "".join(map(str, part)) + f"_{parity}"
    top = [F.max(same_ending(p, o)).alias(name(p, o)) for p in parts for o in (0, 1)]
    g = e.groupBy(*own, "metre").agg(*top, *[F.max(f"n{i}").alias(f"n{i}") for i in range(4)])

    schemes = {"": [(0,)], "AA": [(0, 1)], "--": [(0,), (1,)]} | PARTS
    sums = [_greatest([_joined([F.col(name(p, o)) for p, o in zip(lines, odd)], lines, paths) for odd in _of_parity(lines, parity)]).alias(f"s{s}{parity}")
            for s, lines in schemes.items() for parity in (0, 1)]
    g = settled(g.select(*own, "metre", *[f"n{i}" for i in range(4)], *sums))

    def candidate(scheme: str, extra, odd_extra: float, rank: int) -> list[Column]:
        some, used = [F.col(f"`s{scheme}{parity}`") for parity in (0, 1)], sorted(sum(schemes[scheme], ()))
        if paths:
            scores = [F.round(x["score"] + extra + more, 9) for x, more in zip(some, (0.0, odd_extra))]
            given = [[F.array(*[x[f"p{i}"] for i in used]).alias("paths")] for x in some]
        else:       # nothing but the score to compare: one rounding
            scores, given = [F.round(F.greatest(some[0], some[1] + F.lit(odd_extra)) + extra, 9)], [[]]
        return [F.when(v.isNotNull(), F.struct(v.alias("log_score"), (-F.col("metre")).alias("m"), F.lit(rank).alias("rank"),
                                               F.lit(scheme).alias("scheme"), *more)) for v, more in zip(scores, given)]
    n = F.array(*[F.col(f"n{i}") for i in range(4)])
    uneven = (F.size(F.array_distinct(n)) > 2) | ((F.size(F.array_distinct(n)) == 2) & F.size(F.filter(n, lambda x: x == F.col("n0"))).isin(1, 3))
    lengths = F.when(uneven, math.log10(ODD_LENGTHS)).otherwise(0.0)
    one = candidate("", F.lit(0.0), 0.0, 1)
    two = candidate("AA", F.lit(0.0), 0.0, 1) + candidate("--", F.lit(math.log10(COUPLET_FREE)), 0.0, 0)
    four = [c for i, (_, s, x) in enumerate(SCHEMES) for c in candidate(s, lengths + math.log10(x), math.log10(ODD_PREFIX), len(SCHEMES) - i)]
    found = g.select(*own, F.when(F.col("_n") == 1, _greatest_of(one)).when(F.col("_n") == 2, _greatest_of(two)).otherwise(_greatest_of(four)).alias("b"))
    found = found.where("b IS NOT NULL").groupBy(*own).agg(F.max("b").alias("b"))
    found = found.select(*keys, "b.log_score", (-F.col("b.m")).alias("m"), "b.scheme", *(["b.paths"] if paths else []))
    lost = poems.select(*keys, F.size("lines").alias("_n")).where(F.col("_n").isin(1, 2, 4))
    r = lost.join(found, keys, "left")
    metre = F.get(F.array(*[F.lit(n) for n, _ in FEET]), F.col("m"))
    return r.select(*keys, F.col("_n").alias("n_lines"), metre.alias("metre"), "scheme", F.round("log_score", 6).alias("log_score"),
                    F.coalesce(F.round(F.pow(F.lit(10.0), "log_score"), 6), F.lit(0.0)).alias("score"), *(["paths"] if paths else []))


def _greatest_of(cols: list[Column]) -> Column:
    return F.array_max(F.array(*cols))


# ---------------------------------------------------------------------------
# signatures
# ---------------------------------------------------------------------------
# Factors of the cyclic fit (stress off the foot, foot without stress).
CYCLIC_EXTRA, CYCLIC_MISSING = 0.1, 0.9


def signature(line: Column, prof: Profile | str = LATIN) -> Column:
    """0/1 per vowel of a line, default stress; words of one vowel are stressed."""
    return F.translate(T.line_pattern_default(line, prof), "SAU", "110")


def _phases(sig: Column) -> Column:
    """``STRUCT``: how many of the syllables p, p + P, ... of a signature are stressed (``s``), how many are not (``u``), for
    every length P of a foot; and whether the line starts unstressed (``rise``)."""
    def picked(P: int, p: int) -> Column:
        return F.regexp_replace(sig, f".{{{p}}}(.).{{0,{P - p - 1}}}" + (f"|.{{1,{p}}}" if p else ""), "$1")
    sizes = [(P, p) for P in sorted({len(foot) for _, foot in FEET}) for p in range(P)]
    return F.struct(*[F.length(F.translate(picked(P, p), off, "")).alias(f"{kind}{P}{p}") for P, p in sizes for kind, off in (("s", "0"), ("u", "1"))],
                    (F.substring(sig, 1, 1) == "0").alias("rise"))


def cyclic_line_score(sig: Column, foot: str) -> Column:
    """Log score of a signature against a repeating foot; a line that starts unstressed may be
    shifted by one syllable when the foot starts stressed."""
    return _phase_score(_phases(sig), foot)


def _phase_score(line: Column, foot: str) -> Column:
    P = len(foot)

    def fit(shift: int) -> Column:
        want = [foot[(p - shift) % P] for p in range(P)]
        extra = sum((line[f"s{P}{p}"] for p in range(P) if want[p] == "0"), F.lit(0))
        missing = sum((line[f"u{P}{p}"] for p in range(P) if want[p] == "1"), F.lit(0))
        if shift and want[0] == "1":        # nothing is expected before the shifted foot, and nothing is there
            missing = missing - 1
        return extra * math.log10(CYCLIC_EXTRA) + missing * math.log10(CYCLIC_MISSING)
    if foot[0] == "0":
        return fit(0)
    return F.when(line["rise"], F.greatest(fit(0), fit(1))).otherwise(fit(0))


def cyclic_metre_fit(docs: DataFrame, key: str = "doc_id", text_col: str = "text", prof: Profile | str = LATIN) -> DataFrame:
    """``key, metre, log_score``: the foot whose repetition fits all verse lines best (sum of the
    lines' log scores, exact however many lines; ties to the earlier foot).  Lines without
    vowels add nothing."""
    sigs = F.filter(F.transform(T.verse_lines(text_col), lambda l: signature(l, prof)), lambda s: F.length(s) > 0)
    d = settled(docs.select(key, F.transform(sigs, _phases).alias("sigs"))).where(F.size("sigs") > 0)

    def total(foot: str) -> Column:
        return F.aggregate("sigs", F.lit(0.0), lambda acc, s: acc + _phase_score(s, foot))
    fits = [F.struct(F.round(total(foot), 6).alias("v"), F.lit(-i).alias("i"), F.lit(name).alias("metre")) for i, (name, foot) in enumerate(FEET)]
    best = F.array_max(F.array(*fits))
    return d.select(key, best.alias("b")).select(key, "b.metre", F.col("b.v").alias("log_score"))
