"""Stress rendering, stress markup tags and syllable encoding of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.profiles import LATIN, Profile, profile as get_profile

ACUTE, GRAVE = "\u0301", "\u0300"


def render_word(w, prof: Profile | str = LATIN, stress=None) -> Column:
    """Insert U+0301 after the stressed vowel (default rule unless ``stress``)."""
    return _rendered(w, _segments(w, prof), stress)


def _segments(w, prof: Profile | str) -> Column:
    p = get_profile(prof)
    return F.regexp_extract_all(w, F.lit(p.vowel_class + p.non_vowel_class + "*"), 0)


def _rendered(w: Column, segs: Column, stress=None) -> Column:
    k = F.size(segs)
    s = T.default_stress(k) if stress is None else stress
    pos = F.length(w) - F.length(F.array_join(F.slice(segs, s, F.greatest(k - s + 1, F.lit(1))), "")) + 1
    return F.when(k == 0, w).otherwise(
        F.concat(w.substr(F.lit(1), pos), F.lit(ACUTE), w.substr(pos + 1, F.lit(1 << 30))))


def render_words(words, prof: Profile | str = LATIN) -> Column:
    """Every word of an array with its mark (default rule).  Lambdas share nothing, so the segments of a word, then
    its stressed vowel's place, are arrays of their own and are found once a word."""
    k = (lambda x: F.size(x["segs"]))
    parts = F.transform(words, lambda w: F.struct(w.alias("w"), _segments(w, prof).alias("segs")))
    places = F.transform(parts, lambda x: F.struct(x["w"].alias("w"), F.when(k(x) > 0, F.length(x["w"]) + 1 - F.length(
        F.array_join(F.slice(x["segs"], F.shiftright(k(x) + 1, 1), k(x)), ""))).alias("at")))
    return F.transform(places, lambda x: F.when(x["at"].isNull(), x["w"]).otherwise(
        F.concat(F.substring(x["w"], F.lit(1), x["at"]), F.lit(ACUTE), F.substring(x["w"], x["at"] + 1, F.lit(1 << 30)))))


def render_line(line, prof: Profile | str = LATIN) -> Column:
    return F.array_join(render_words(T.words(line), prof), " ")


def stress_markup(stressed, prof: Profile | str = LATIN, add_count: bool = True) -> Column:
    """Tags before each word of a stressed line: ``<S{i}>`` per primary and ``<s{i}>``
    per secondary mark (i: the vowel that carries it, from 1), then ``<count{n}>`` (n
    vowels).  Hyphen parts are tagged one by one and joined by `` - ``; words without
    vowels stay as they are."""
    p = get_profile(prof)

    def vowels(x):
        return T.vowel_count(x, p)

    def marks(x, mark, letter):
        # per mark the vowels up to it: those of the part before it and of all earlier parts
        counts = F.transform(F.split(x["w"], mark), vowels)
        before = F.transform(F.slice(counts, 1, F.size(counts) - 1), lambda _, i: F.concat(
            F.lit(f"<{letter}"), F.aggregate(F.slice(counts, 1, i + 1), F.lit(0), lambda a, c: a + c).cast("string"), F.lit(">")))
        return F.when(F.contains(x["w"], F.lit(mark)), F.array_join(before, "")).otherwise(F.lit(""))

    def tags(x):
        cnt = F.concat(F.lit("<count"), x["n"].cast("string"), F.lit(">")) if add_count else F.lit("")
        return F.when(x["n"] > 0, F.concat(marks(x, ACUTE, "S"), marks(x, GRAVE, "s"), cnt))

    def tagged(ws):
        # a word's vowels, then its tags, are found once
        counted = F.transform(ws, lambda w: F.struct(w.alias("w"), vowels(w).alias("n")))
        done = F.transform(counted, lambda x: F.struct(x["w"].alias("w"), tags(x).alias("t")))
        return F.transform(done, lambda x: F.when(x["t"].isNull(), x["w"]).otherwise(
            F.concat(F.when(x["t"] == "", "").otherwise(F.concat(x["t"], F.lit(" "))), T.strip_diacritics(x["w"]))))

    return F.array_join(F.transform(F.split(stressed, " "), lambda t: F.array_join(tagged(F.split(t, "-")), " - ")), " ")


def syllable_encode(line, prof: Profile | str = LATIN) -> Column:
    """Words as syllables (space-separated, right to left) with ``|`` between
    words, also right to left."""
    return F.array_join(F.reverse(F.transform(
        T.words(line), lambda w: F.array_join(F.reverse(T.syllables(w, prof)), " "))), " | ")


def syllable_decode(encoded) -> Column:
    """Inverse of :func:`syllable_encode`."""
    return F.array_join(F.transform(F.reverse(F.split(encoded, r" \| ")),
                                    lambda w: F.array_join(F.reverse(F.split(F.trim(w), " ")), "")), " ")
