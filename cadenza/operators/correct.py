"""Metre with stress corrections: the classifier that also asks how many stresses would have to
move, and the improved stress marks.

A line is its words' stress flags (one 0/1 per vowel), joined by ``|``.  The template text that
:mod:`cadenza.operators.metre` keeps for the best path is the traceback: laid over the flags it
tells, word by word, which stresses stand on weak places.

- correction: the only stress of a word stands on a weak place and another vowel on a strong one;
- resolution: the same for a word with several stresses;
- addition: a word without stress has a vowel on a strong place.

Equal flag lines are matched and corrected once.  Stress lookups meet distinct words; the groups that
shuffle are lines, never whole poems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators.corpus import settled
from cadenza.operators.lookup import word_values
from cadenza.operators.metre import METRE_NAMES, matchable, pattern_matches
from cadenza.profiles import LATIN, METRES, Profile

SHORT = 3       # words of one vowel and so many letters at most carry no stress of their own


def flags_of(n: Column, stresses: Column) -> Column:
    """``n`` flags with a 1 at every listed vowel."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.array_contains(stresses, i), "1").otherwise("0")), "")


def flag_lines(lines: DataFrame, stresses: DataFrame, keys=("doc_id", "line_no"), text_col: str = "text",
               prof: Profile | str = LATIN) -> DataFrame:
    """``keys, words, flags`` of every line with a word.  ``stresses`` (one row a word: ``word, stresses
    ARRAY<INT>``) decides for words of several vowels, the default rule where it is silent.

    A word's flags are made once; :func:`~cadenza.operators.lookup.word_values` brings them to the lines."""
    keys = list(keys)

    def default_flags(n: Column) -> Column:
        s = T.default_stress(n)
        return F.concat(F.repeat(F.lit("0"), s - 1), F.lit("1"), F.repeat(F.lit("0"), n - s))
    count = T.vowel_count("word", prof)
    listed = stresses.select("word", flags_of(count, F.col("stresses")).alias("f")).where((count > 1) & (F.col("f") != default_flags(count)))

    def flags(words: DataFrame) -> DataFrame:
        x = words.join(listed, "word", "left").withColumn("c", T.vowel_count("word", prof))
        own = F.when(F.col("c") == 0, "").when(F.col("c") == 1, F.when(F.length("word") <= SHORT, "0").otherwise("1"))
        return x.select("word", "n", own.otherwise(F.coalesce("f", default_flags(F.col("c")))).alias("value"))
    x = settled(lines.select(*keys, T.words(text_col).alias("ws")))
    return word_values(x, keys, flags).select(*keys, F.split("line", " ").alias("words"), F.col("vals").alias("flags"))


def shared(lines: DataFrame, keys=("doc_id", "line_no")) -> DataFrame:
    """``keys, flags`` of flag lines that have several readers: dealt by their keys once.  Settled, since a reader's own
    columns and conditions would otherwise make another plan of all below, and another run."""
    return settled(lines.select(*keys, "flags").repartition(*keys))


def pattern_of(flags: Column) -> Column:
    """S/U/A picture of a flag line: A for words of one vowel."""
    words = F.split(flags, "\\|")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) == 1, "A").otherwise(F.translate(w, "10", "SU"))), "")


FIX = "array<struct<word:int,syllable:int,kind:string>>"


def fixes(flags: Column, template: Column) -> Column:
    """Corrections, resolutions and additions of a flag line under a template text, in word,
    stress and vowel order."""
    words = F.split(flags, "\\|")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<f:string,at:int>>").alias("out"))
    placed = F.aggregate(words, start, lambda acc, w: F.struct(
        (acc["at"] + F.length(w)).alias("at"), F.concat(acc["out"], F.array(F.struct(w.alias("f"), acc["at"].alias("at")))).alias("out")))["out"]
    none = F.array().cast(FIX)

    def of(w: Column, k: Column) -> Column:
        f, n = w["f"], F.length(w["f"])
        seg = F.lower(F.substring(template, w["at"] + 1, n))
        stressed = F.length(F.translate(f, "0", ""))
        at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

        def char(s: Column, i: Column) -> Column:
            return F.substring(s, i + 1, F.lit(1))

        def fix(i: Column, kind: Column) -> Column:
            return F.struct(k.alias("word"), i.alias("syllable"), kind.alias("kind"))
        add = F.transform(F.filter(at, lambda i: char(seg, i) == "s"), lambda i: fix(i, F.lit("addition")))
        kind = F.when(stressed == 1, "correction").otherwise("resolution")
        move = F.flatten(F.transform(F.filter(at, lambda i: (char(f, i) == "1") & (char(seg, i) == "u")), lambda i: F.transform(
            F.filter(at, lambda j: (j != i) & (char(seg, j) == "s")), lambda j: fix(j, kind))))
        return F.when(n == 0, none).when(stressed == 0, add.cast(FIX)).when(n > 1, move.cast(FIX)).otherwise(none)
    return F.flatten(F.transform(placed, of))


def single_stresses(flags: Column) -> Column:
    """``ARRAY<STRUCT<at, n, p>>``: the words of several vowels with one stress; where they begin in the line, their
    vowels, and the place of the stress in the line (from 1)."""
    words = F.split(flags, "\\|")
    sized = F.transform(words, lambda w: F.struct(w.alias("f"), F.length(w).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int,p:int>>").alias("out"))

    def one(acc: Column, w: Column) -> Column:
        single = (w["n"] > 1) & (F.length(F.translate(w["f"], "0", "")) == 1)
        item = F.struct(acc["at"].alias("at"), w["n"].alias("n"), (acc["at"] + F.instr(w["f"], "1")).alias("p"))
        return F.struct((acc["at"] + w["n"]).alias("at"), F.when(single, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(sized, start, one)["out"]


def n_corrections(single: Column, template: Column) -> Column:
    """How many of the ``fixes`` are corrections: a single stress on a weak place may go to each strong place of its word."""
    def of(w: Column) -> Column:
        seg = F.lower(F.substring(template, w["at"] + 1, w["n"]))
        return F.when(F.lower(F.substring(template, w["p"], F.lit(1))) == "u", F.length(seg) - F.length(F.translate(seg, "s", ""))).otherwise(0)
    return F.aggregate(single, F.lit(0), lambda acc, w: acc + of(w))


def _matched(lines: DataFrame) -> DataFrame:
    """``flags, strong, weak, template, failed`` (arrays by metre) of the distinct flag lines;
    ``strong`` counts corrections too."""
    d = lines.select("flags").distinct().withColumn("pattern", pattern_of(F.col("flags")))
    m = d.where(matchable("pattern")).join(pattern_matches(d), "pattern")
    bad = F.transform(F.arrays_zip("failed", "template"), lambda x: x["failed"] | (x["template"] == ""))
    m = m.withColumn("failed", bad)
    m = settled(m.select("flags", single_stresses(F.col("flags")).alias("single"), "strong", "weak", "template", "failed"))
    more = F.transform(F.arrays_zip("strong", "template", "failed"), lambda x: x["strong"] + F.when(x["failed"], 0).otherwise(
        n_corrections(F.col("single"), x["template"])))
    m = m.select("flags", more.alias("strong"), "weak", "template", "failed")
    n, zero = len(METRES), d.where(~matchable("pattern"))
    none = zero.select("flags", F.array_repeat(F.lit(0), n).alias("strong"), F.array_repeat(F.lit(0), n).alias("weak"),
                       F.array_repeat(F.lit(""), n).alias("template"), F.array_repeat(F.lit(True), n).alias("failed"))
    return m.unionByName(none)


def poem_metre_corrected(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, metre, score, num_lines`` from flag lines: errors per line are shares of their sum over
    the metres, corrections count as strong errors, the smallest weighted mean wins (ties to the
    earlier metre)."""
    x = lines.select(key, "flags").join(_matched(lines), "flags")

    def share(errs: str) -> Column:
        total = F.aggregate(errs, F.lit(0), lambda a, v: a + v)
        return F.transform(errs, lambda v: F.when(total != 0, v / total).otherwise(v.cast("double")))
    x = x.select(key, share("strong").alias("s"), share("weak").alias("w"))
    g = x.groupBy(key).agg(F.count("*").alias("num_lines"), *[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in "sw" for i in range(len(METRES))])
    values = [F.struct(F.round(F.lit(total) + (F.col(f"s{i}") + F.col(f"w{i}") / 2.0) * coef / F.col("num_lines"), 9).alias("v"),
                       F.lit(i).alias("i"), F.lit(name).alias("metre")) for i, (name, _, _, coef, total) in enumerate(METRES)]
    best = F.array_min(F.array(*values))
    return g.select(key, best["metre"].alias("metre"), best["v"].alias("score"), "num_lines")


def _fixes(lines: DataFrame, metres: DataFrame, kept: list[str], key: str) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(n) for n in METRE_NAMES]), F.col("metre")).cast("int") - 1
    m = _matched(lines).select("flags", "template", "failed")
    x = lines.join(metres.select(key, "metre"), key).join(m, "flags")
    f = F.when(F.get("failed", at), F.array().cast(FIX)).otherwise(fixes(F.col("flags"), F.get("template", at)))
    return x.select(*kept, f.alias("fixes"))


def stress_fixes(lines: DataFrame, metres: DataFrame, keys=("doc_id", "line_no"), key: str = "doc_id") -> DataFrame:
    """``keys, words, flags, fixes``: what each line would need in its poem's metre (``key, metre``)."""
    return _fixes(lines, metres, [*keys, "words", "flags"], key)


def improved_flags(flags: Column, found: Column) -> Column:
    """Flags after the fixes: a moved stress replaces all of its word's (the last fix wins), an
    added one joins them."""
    def word(f: Column, k: Column) -> Column:
        own = F.filter(found, lambda x: x["word"] == k)
        moved = F.filter(own, lambda x: x["kind"] != "addition")
        added = F.transform(F.filter(own, lambda x: x["kind"] == "addition"), lambda x: x["syllable"])
        to = F.get(moved, F.size(moved) - 1)["syllable"]
        i = F.sequence(F.lit(0), F.greatest(F.length(f) - 1, F.lit(0)))
        new = F.array_join(F.transform(i, lambda j: F.when(F.array_contains(added, j), "1").when(
            F.size(moved) > 0, F.when(j == to, "1").otherwise("0")).otherwise(F.substring(f, j + 1, F.lit(1)))), "")
        return F.when(F.length(f) == 0, f).otherwise(new)
    return F.array_join(F.transform(F.split(flags, "\\|"), word), "|")


def improved_stress(lines: DataFrame, metres: DataFrame, keys=("doc_id", "line_no"), key: str = "doc_id") -> DataFrame:
    """``keys, flags, improved, n_corrections, n_resolutions, n_additions`` of every line."""
    x = _fixes(lines, metres, [*keys, "flags"], key)

    def number(kind: str) -> Column:
        return F.size(F.filter("fixes", lambda y: y["kind"] == kind)).alias(f"n_{kind}s")
    return x.select(*keys, "flags", improved_flags(F.col("flags"), F.col("fixes")).alias("improved"),
                    number("correction"), number("resolution"), number("addition"))
