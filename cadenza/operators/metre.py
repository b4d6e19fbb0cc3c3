"""Metre matching: line S/U/A patterns against the nine metre templates.

Design (scale): lines of no vowel or of more than ``BORDER_SYLLABLES`` syllables get a
constant answer and never leave their row.  The other patterns are strings of at
most 20 letters over {S,U,A}, so the corpus has far fewer *distinct* patterns than
lines.  We

1. derive the pattern of every line in-row (no shuffle),
2. de-duplicate the short patterns (hash aggregate with map-side combine),
3. match each distinct pattern against the asked templates with a bounded frontier
   walk over sorted neighbours (Arrow batches; the same walk exists as a JVM
   higher-order expression, ``engine="expr"``, which took 12 times as long), and
4. join the result, one row per pattern, back on ``pattern``: both sides of that join
   are plain exchanges, so adaptive execution can split a hot pattern.

The templates are regular expressions over ``usUS``; each is compiled once on
the driver into a position automaton (a literal transition array folded into
the expression).  The frontier keeps, per (automaton node, strong, weak), only
the lexicographically smallest template text: that is enough to reproduce the
``min(strong, weak, text)`` winner, and it bounds the frontier by
nodes x (border+1)^2 whatever the pattern.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.profiles import BORDER_SYLLABLES, LATIN, METRES, Profile

METRE_NAMES = [m[0] for m in METRES]


# ---------------------------------------------------------------------------
# template -> position automaton
# ---------------------------------------------------------------------------
@lru_cache(maxsize=None)
def compile_template(template: str):
    """Return (chars, first, follow, s_index) of a template over ``usUS()*?``.

    ``chars[p]`` is the letter of position p, ``first`` the positions that may
    start a match, ``follow[p]`` the positions that may come after p, and
    ``s_index`` the position of the mandatory stressed slot (the only ``S``).
    """
    chars: list[str] = []
    follow: dict[int, set[int]] = {}

    def seq(i: int):
        nullable, first, last = True, set(), set()
        while i < len(template) and template[i] != ")":
            if template[i] == "(":
                n, f, l, i = seq(i + 1)
                i += 1
            else:
                p = len(chars)
                chars.append(template[i])
                follow[p] = set()
                n, f, l = False, {p}, {p}
                i += 1
            op = template[i] if i < len(template) and template[i] in "*?" else ""
            if op:
                i += 1
                if op == "*":
                    for x in l:
                        follow[x] |= f
                n = True
            for x in last:
                follow[x] |= f
            first = first | f if nullable else first
            last = l | last if n else set(l)
            nullable = nullable and n
        return nullable, first, last, i

    _, first, _, _ = seq(0)
    assert chars.count("S") == 1, template
    s_index = chars.index("S")
    return tuple(chars), frozenset(first), {k: frozenset(v) for k, v in follow.items()}, s_index


def transitions(template: str):
    """(src, dst, char) rows; src = -1 is the start state."""
    chars, first, follow, _ = compile_template(template)
    rows = [(-1, q, chars[q]) for q in sorted(first)]
    for p in sorted(follow):
        rows += [(p, q, chars[q]) for q in sorted(follow[p])]
    return rows


# A frontier state is one BIGINT:  key << 40 | text, with
#   key  = (node + 1) << 8 | strong << 4 | weak      (node = -1 is the start)
#   text = template letters so far, 2 bits each, codes S=0 U=1 s=2 u=3.
# Codes follow string order, and all texts of one step have the same length,
# so ascending BIGINT order is (node, strong, weak, text) order.
_CODES = "SUsu"
_TEXT_BITS = 40
_TEXT_MASK = (1 << _TEXT_BITS) - 1
_PATTERN_CHARS = "SUA"


def _moves_literal(template: str) -> str:
    """Element (node + 1) * 3 + ci + 1 (1-based) lists the moves out of
    ``node`` on pattern letter ``SUA[ci]`` as BIGINT ``(dst+1)<<10 | ds<<6 |
    dw<<2 | code``."""
    chars, first, follow, _ = compile_template(template)
    out = []
    for src in range(-1, len(chars)):
        succ = first if src < 0 else follow[src]
        for c in _PATTERN_CHARS:
            moves = []
            for q in sorted(succ):
                t = chars[q]
                ds = int(t.isupper() and t != c and c != "A")
                dw = int(t.islower() and t != c.lower() and c != "A")
                moves.append(str(((q + 1) << 10) | (ds << 6) | (dw << 2) | _CODES.index(t)))
            out.append("array(" + ",".join(f"CAST({m} AS BIGINT)" for m in moves) + ")"
                       if moves else "CAST(array() AS ARRAY<BIGINT>)")
    return "array(" + ", ".join(out) + ")"


def metre_match_expr(pattern: str, template: str, border: int) -> str:
    """SQL expression: STRUCT<strong INT, weak INT, t STRING, failed BOOLEAN>.

    Semantics per position i (char c of the pattern, letter t of the template):
    strong += (t upper, t != c, c != 'A'); weak += (t lower, t != lower(c),
    c != 'A').  Paths with strong+weak > border are cut.  If every path is cut
    at position i, the best accepted state of the previous step is taken and
    strong += n - i (failed).  An accepted state has passed the mandatory S.
    """
    _, _, _, s_index = compile_template(template)
    moves = _moves_literal(template)
    ci = f"CASE substr({pattern}, i, 1) WHEN 'S' THEN 0 WHEN 'U' THEN 1 ELSE 2 END"
    step = (
        f"filter(flatten(transform(acc.f, x -> transform(element_at({moves}, "
        f"CAST(shiftright(x, 48) * 3 + {ci} + 1 AS INT)), m -> "
        "shiftleft(shiftleft(shiftright(m, 10), 8) | ((shiftright(x, 40) & 255) + (shiftright(m, 2) & 255)), 40)"
        f" | (shiftleft(x & {_TEXT_MASK}, 2) | (m & 3))))), "
        f"y -> (shiftright(y, 44) & 15) + (shiftright(y, 40) & 15) <= {border})"
    )
    # keep the smallest text per key: sort, then drop repeats of the key
    dedup = (
        "transform(array(array_sort(" + step + ")), arr -> filter(arr, (x, j) -> j = 0 OR "
        "shiftright(get(arr, j - 1), 40) != shiftright(x, 40)))[0]"
    )
    body = (
        "CASE WHEN acc.cut >= 0 THEN acc ELSE "
        "transform(array(" + dedup + "), nf -> "
        "IF(size(nf) = 0, named_struct('f', acc.f, 'cut', i - 1), named_struct('f', nf, 'cut', -1)))[0] END"
    )
    walk = (
        f"aggregate(sequence(1, length({pattern})), "
        "named_struct('f', array(CAST(0 AS BIGINT)), 'cut', -1), "
        f"(acc, i) -> {body})"
    )
    # rank = strong << 44 | weak << 40 | text  (node dropped)
    best = (
        f"array_min(transform(filter(w.f, x -> shiftright(x, 48) >= {s_index + 1}), "
        f"x -> shiftleft(shiftright(x, 40) & 255, 40) | (x & {_TEXT_MASK})))"
    )
    n_used = f"IF(w.cut >= 0, w.cut, length({pattern}))"
    text = (f"array_join(transform(sequence({n_used} - 1, 0, -1), k -> "
            f"substr('{_CODES}', CAST((shiftright(b, 2 * k) & 3) + 1 AS INT), 1)), '')")
    result = (
        f"transform(array({walk}), w -> transform(array({best}), b -> named_struct("
        f"'strong', CAST(coalesce(shiftright(b, 44), 0) AS INT) + IF(w.cut >= 0, length({pattern}) - w.cut, 0), "
        "'weak', CAST(coalesce(shiftright(b, 40) & 15, 0) AS INT), "
        f"'t', IF(b IS NULL, '', {text}), "
        "'failed', w.cut >= 0 OR b IS NULL))[0])[0]"
    )
    n = f"length({pattern})"
    return (
        f"CASE WHEN {n} = 0 OR {n} > {BORDER_SYLLABLES} "
        "THEN named_struct('strong', 0, 'weak', 0, 't', '', 'failed', false) "
        f"ELSE {result} END"
    )


def all_metres_expr(pattern: str = "pattern") -> str:
    """ARRAY of 9 structs (metre, strong, weak, t, failed) in template order."""
    parts = []
    for name, template, border, _, _ in METRES:
        m = metre_match_expr(pattern, template, border)
        parts.append(f"transform(array({m}), r -> named_struct('metre', '{name}', "
                     "'strong', r.strong, 'weak', r.weak, 't', r.t, 'failed', r.failed))[0]")
    return "array(" + ", ".join(parts) + ")"


# ---------------------------------------------------------------------------
# prefix-sharing walk (Arrow batches of range-sorted distinct patterns)
# ---------------------------------------------------------------------------
_CI = {"S": 0, "U": 1, "A": 2}


@lru_cache(maxsize=None)
def _move_table(template: str):
    """moves[node + 1][ci] -> tuple of (dst, d_strong, d_weak, letter)."""
    chars, first, follow, s_index = compile_template(template)
    table = []
    for src in range(-1, len(chars)):
        succ = first if src < 0 else follow[src]
        row = []
        for c in _PATTERN_CHARS:
            row.append(tuple(
                (q, int(chars[q].isupper() and chars[q] != c and c != "A"),
                 int(chars[q].islower() and chars[q] != c.lower() and c != "A"), chars[q])
                for q in sorted(succ)))
        table.append(tuple(row))
    return tuple(table), s_index


class _Walker:
    """Frontier walk for one template that reuses the frontiers of the prefix
    shared with the previous (sorted) pattern: work grows with the number of
    distinct prefixes, not with patterns x length."""

    def __init__(self, template: str, border: int):
        self.moves, self.s_index = _move_table(template)
        self.border = border
        self.stack = [{(-1, 0, 0): ""}]
        self.prev = ""

    def match(self, p: str):
        n = len(p)
        if n == 0 or n > BORDER_SYLLABLES:
            return 0, 0, "", False
        k, m = 0, min(len(self.prev), n, len(self.stack) - 1)
        while k < m and self.prev[k] == p[k]:
            k += 1
        del self.stack[k + 1:]
        cut = -1
        moves, border = self.moves, self.border
        for i in range(k, n):
            cur: dict = {}
            ci = _CI.get(p[i], 2)
            for (node, s, w), t in self.stack[-1].items():
                for dst, ds, dw, ch in moves[node + 1][ci]:
                    s2, w2 = s + ds, w + dw
                    if s2 + w2 > border:
                        continue
                    key, t2 = (dst, s2, w2), t + ch
                    old = cur.get(key)
                    if old is None or t2 < old:
                        cur[key] = t2
            if not cur:
                cut = i
                break
            self.stack.append(cur)
        self.prev = p if cut < 0 else p[:cut]
        cands = [(s, w, t) for (node, s, w), t in self.stack[-1].items() if node >= self.s_index]
        b = min(cands) if cands else None
        if cut >= 0:
            return (b[0] if b else 0) + n - cut, b[1] if b else 0, b[2] if b else "", True
        return (b[0], b[1], b[2], False) if b else (0, 0, "", True)


PATTERN_SCHEMA = ("pattern string, strong array<int>, weak array<int>, template array<string>, "
                  "failed array<boolean>")


def _walk_partition(names: tuple[str, ...]):
    def run(batches):
        import pandas as pd
        walkers = [_Walker(tpl, border) for name, tpl, border, _, _ in METRES if name in names]
        for pdf in batches:
            pats = pdf["pattern"].tolist()
            found = [[w.match(p) for p in pats] for w in walkers]
            cols = {c: [[f[i][j] for f in found] for i in range(len(pats))]
                    for j, c in enumerate(("strong", "weak", "template", "failed"))}
            yield pd.DataFrame({"pattern": pats, **cols})
    return run


# ---------------------------------------------------------------------------
# tables
# ---------------------------------------------------------------------------
def line_patterns(lines: DataFrame, prof: Profile | str = LATIN, text_col: str = "text") -> DataFrame:
    """Add ``pattern`` (S/U/A per syllable, default stress) and ``n_syl``."""
    return (lines
            .withColumn("pattern", T.line_pattern_default(text_col, prof))
            .withColumn("n_syl", F.length("pattern").cast("int")))


def compute_parallelism(spark) -> int:
    """Partitions for byte-light, CPU-heavy stages (AQE would otherwise merge
    them into one task because their shuffle output is tiny)."""
    return max(spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def matchable(pattern) -> "F.Column":
    """Patterns that are matched at all; the others have no errors by definition."""
    return F.length(pattern).between(1, BORDER_SYLLABLES)


def pattern_matches(patterns: DataFrame, pattern_col: str = "pattern", metres: list[str] | None = None,
                    engine: str = "walk") -> DataFrame:
    """One row per distinct matchable pattern: arrays ``strong, weak, template, failed``
    in template order of the asked ``metres`` (all by default).

    ``engine="walk"``: patterns are range-partitioned and sorted so that each task walks
    neighbours and shares prefixes.  ``engine="expr"``: the same walk as one JVM
    higher-order expression per metre."""
    names = tuple(n for n in METRE_NAMES if metres is None or n in metres)
    d = patterns.select(F.col(pattern_col).alias("pattern")).where(matchable("pattern")).distinct()
    if engine == "expr":
        d = d.repartition(compute_parallelism(patterns.sparkSession))
        e = d.select("pattern", F.filter(F.expr(all_metres_expr("pattern")), lambda r: r["metre"].isin(*names)).alias("e"))
        return e.select("pattern", F.col("e.strong").alias("strong"), F.col("e.weak").alias("weak"),
                        F.col("e.t").alias("template"), F.col("e.failed").alias("failed"))
    d = d.repartitionByRange(compute_parallelism(patterns.sparkSession), "pattern").sortWithinPartitions("pattern")
    return d.mapInPandas(_walk_partition(names), PATTERN_SCHEMA)


def _per_metre(df: DataFrame, keep: list[str], metres: list[str] | None = None) -> DataFrame:
    """Rows of :func:`pattern_matches`, one per metre."""
    names = [n for n in METRE_NAMES if metres is None or n in metres]
    zipped = F.arrays_zip(F.array(*[F.lit(METRE_NAMES.index(n)) for n in names]).alias("metre_idx"),
                          F.array(*[F.lit(n) for n in names]).alias("metre"), "strong", "weak", "template", "failed")
    x = df.select(*keep, F.explode(zipped).alias("e"))
    return x.select(*keep, *[F.col(f"e.{c}").alias(c) for c in ("metre_idx", "metre", "strong", "weak", "template", "failed")])


def _with_matches(lines: DataFrame, table: DataFrame, constants: dict) -> DataFrame:
    """``lines`` with the columns of ``table`` (one row per matchable pattern); the patterns that it
    lacks get ``constants``.  One pass over the lines; unmatched ones are spread over keys that match nothing."""
    idle = F.concat(F.lit("-"), F.pmod(F.xxhash64(*[F.col(c) for c in lines.columns]), F.lit(4096)).cast("string"))
    key = F.when(matchable("pattern"), F.col("pattern")).otherwise(idle)
    j = lines.withColumn("_key", key).join(table.withColumnRenamed("pattern", "_key"), "_key", "left").drop("_key")
    return j.select(*lines.columns, *[F.coalesce(F.col(c), v).alias(c) for c, v in constants.items()])


def _zeros(n: int) -> dict:
    return {"strong": F.array_repeat(F.lit(0), n), "weak": F.array_repeat(F.lit(0), n), "template": F.array_repeat(F.lit(""), n),
            "failed": F.array_repeat(F.lit(False), n)}


def _constant(df: DataFrame) -> DataFrame:
    """The answer of patterns that are not matched, in the form of :func:`pattern_matches`."""
    n = len(METRES)
    return df.select("*", F.array_repeat(F.lit(0), n).alias("strong"), F.array_repeat(F.lit(0), n).alias("weak"),
                     F.array_repeat(F.lit(""), n).alias("template"), F.array_repeat(F.lit(False), n).alias("failed"))


def pattern_metre_errors(patterns: DataFrame, pattern_col: str = "pattern",
                         engine: str = "walk") -> DataFrame:
    """Distinct patterns -> one row per (pattern, metre) with the error record."""
    d = patterns.select(F.col(pattern_col).alias("pattern"))
    rest = _constant(d.where(~matchable("pattern")).distinct())
    return _per_metre(pattern_matches(d, engine=engine).unionByName(rest), ["pattern"])


def line_metre_errors(lines: DataFrame, prof: Profile | str = LATIN,
                      keys=("doc_id", "line_no")) -> DataFrame:
    """Per line and metre: strong, weak, template, failed."""
    lp = line_patterns(lines, prof).select(*keys, "pattern")
    every = _with_matches(lp, pattern_matches(lp), _zeros(len(METRES)))
    return _per_metre(every, list(keys)).drop("metre_idx")


def poem_metre(lines: DataFrame, prof: Profile | str = LATIN, key: str = "doc_id",
               line_key: str = "line_no") -> DataFrame:
    """Best-fitting metre per poem (classifier's two-step normalisation, argmin).

    Per line, strong (weak) errors are divided by their sum over the nine
    metres when that sum is not zero; per poem the normalised values are summed
    and ``sum_coef + (S + W/2) * coef / num_lines`` is minimised, ties going
    to template order.  All lines count in ``num_lines``; unmatched ones add 0.
    """
    lp = line_patterns(lines, prof).select(key, "pattern")

    def norm(errs: str):
        total = F.aggregate(errs, F.lit(0), lambda a, x: a + x)
        return F.transform(errs, lambda x: F.when(total != 0, x / total).otherwise(x.cast("double")))
    table = pattern_matches(lp).select("pattern", norm("strong").alias("s"), norm("weak").alias("w"))
    zero = F.array_repeat(F.lit(0.0), len(METRES))
    every = _with_matches(lp, table, {"s": zero, "w": zero})
    aggs = [F.count(F.lit(1)).alias("num_lines")]
    for i in range(len(METRES)):
        aggs += [F.sum(F.col("s")[i]).alias(f"s{i}"), F.sum(F.col("w")[i]).alias(f"w{i}")]
    g = every.groupBy(key).agg(*aggs)
    vals = []
    for i, (name, _, _, coef, sum_coef) in enumerate(METRES):
        v = F.lit(sum_coef) + (F.col(f"s{i}") + F.col(f"w{i}") / 2.0) * coef / F.col("num_lines")
        vals.append(F.struct(F.round(v, 9).alias("v"), F.lit(i).alias("i"), F.lit(name).alias("metre")))
    best = F.array_min(F.array(*vals))
    return g.select(key, best["metre"].alias("metre"), best["v"].alias("score"),
                    F.col("num_lines").cast("long").alias("num_lines"))


def meter_score(texts: DataFrame, text_col: str = "text", metre_col: str = "meter",
                keys=("req_id",), prof: Profile | str = LATIN, max_lines: int = 8,
                metres: list[str] | None = None) -> DataFrame:
    """Mean over a text's (first ``max_lines``) letter-bearing lines of
    (strong+weak)/syllables against the requested metre; lines without
    syllables add 0; NULL for a text without lines.  ``metres``: the names that
    may be requested (only these are matched; all by default)."""
    keys = list(keys)
    lines = texts.select(*keys, metre_col, F.posexplode(
        F.slice(T.filter_lines(text_col), 1, max_lines)).alias("line_no", "line"))
    lp = lines.select(*keys, F.col(metre_col).alias("_m"), T.line_pattern_default("line", prof).alias("pattern"))
    names = [n for n in METRE_NAMES if metres is None or n in metres]
    errs = pattern_matches(lp, metres=names).select("pattern", "strong", "weak")
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("_m")).cast("int") - 1
    per_line = (F.coalesce(F.get("strong", at), F.lit(0)) + F.coalesce(F.get("weak", at), F.lit(0))) / F.greatest(F.length("pattern"), F.lit(1))
    none = F.array().cast("array<int>")
    every = _with_matches(lp, errs, {"strong": none, "weak": none}).select(*keys, per_line.alias("v"))
    return texts.select(*keys).join(every.groupBy(*keys).agg(F.avg("v").alias("meter_score")), keys, "left")
