"""Defects of stanzas: repetitions, poor rhymes, unequal lines, penalties of a stressed line, and the
rank of a candidate.

A stanza is a small row (``lines``: an array of arrays of tagged words), so everything but the
lookup of listed rhymes is decided in place, without a shuffle.  A tagged word is
``STRUCT<word, lemma, upos, converb, stress, vowels>``; who makes the tags is the caller's
affair (``stress`` 0: unstressed).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.corpus import settled

TAGGED = "array<array<struct<word:string,lemma:string,upos:string,converb:boolean,stress:int,vowels:int>>>"
# Parts of speech whose lemma must not come back in a line; more of them when strict.
CONTENT, STRICT_CONTENT = ["NOUN", "PROPN", "ADJ", "VERB"], ["ADV", "PRON", "SYM"]
STRICT_LETTERS = 5


@dataclass(frozen=True)
class Habits:
    """Words of one language that the rules name."""
    between: list                # X and X
    may_echo: list               # X that may
    twins: list                  # spellings of one word
    negation: str
    verb_endings: list           # shared by a poor verb rhyme
    groups: list                 # words that rhyme poorly with each other; ``~x``: any word ending in x
    opening: str                 # particle that should not open a line stressed
    fold: tuple = ("ё", "е")
    adposition: str = "ADP"
    pronoun: str = "PRON"


# Fixed values of the Russian rules.
RU = Habits(
    between=["и", ",", "или", "иль", "аль", "да"],
    may_echo="вновь еще ещё снова опять дальше ближе сильнее слабее сильней слабей тише".split(" "),
    twins=[("поёт", "поет")], negation="не",
    verb_endings="ли ла ло л тся те лись лась лось лся тся ться шись".split(" "),
    groups=[x.split() for x in (
        "твой мой свой", "тебе мне себе", "него его", "твои свои", "наши ваши", "меня тебя себя", "мной тобой собой",
        "мною тобой собою", "нее ее неё её", "~шел ~шёл", "твоем твоём своем своём моем моём", "когда никогда навсегда кое-когда",
        "кто никто кое-кто", "где нигде везде", "каких никаких таких сяких", "какого никакого такого сякого",
        "какую никакую такую сякую", "сможем поможем можем", "смогу помогу могу",
        "поехал уехал наехал приехал въехал заехал доехал подъехал", "того чего ничего никого кого", "ждали ожидали",
        "подумать придумать думать продумать надумать удумать")],
    opening="и")

# Ours, for the Latin-script fixtures.
LATIN = Habits(
    between=["and", "or", "und", "oder", "et", "ou", "y", "o"], may_echo=["more", "mehr", "plus"], twins=[("ou", "où")],
    negation="in", verb_endings=["ing", "er", "en", "ar", "ed"],
    groups=[["the", "that", "this"], ["le", "la", "les"], ["der", "die", "das"], ["el", "los", "las"], ["~tion", "~sion"]],
    opening="et", fold=("éè", "ee"))


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def _repeats(items: Column) -> Column:
    return F.size(F.array_distinct(items)) < F.size(items)


def repetition(lines: Column, ends: Column, h: Habits = RU) -> Column:
    """``STRUCT`` of flags over all lines of a stanza.  ``ends``: the rhyming words.  ``form`` (words of five letters and
    more) and the wider lemma rule count only when a candidate is judged strictly."""
    def anywhere(rule) -> Column:
        return F.exists(lines, rule)

    def lemma(upos: list) -> Column:
        return anywhere(lambda l: _repeats(F.transform(F.filter(l, lambda w: w["upos"].isin(*upos)), lambda w: w["lemma"])))

    def pair(l: Column, step: int, test) -> Column:
        later = F.slice(l, step + 1, F.greatest(F.size(l), F.lit(1)))
        return F.exists(F.arrays_zip(F.transform(l, lambda w: w["word"]).alias("a"), F.transform(later, lambda w: w["word"]).alias("b"),
                                     F.transform(F.slice(l, 2, F.greatest(F.size(l), F.lit(1))), lambda w: w["word"]).alias("m")),
                        lambda x: F.coalesce((x["a"] == x["b"]) & test(x), F.lit(False)))
    form = anywhere(lambda l: _repeats(F.transform(F.filter(l, lambda w: F.length(w["word"]) >= STRICT_LETTERS),
                                                   lambda w: F.concat_ws(":", w["upos"], F.translate(w["word"], *h.fold)))))
    noun = anywhere(lambda l: _repeats(F.transform(F.filter(l, lambda w: w["upos"].isin("NOUN", "PROPN")), lambda w: w["word"])))
    adjacent = anywhere(lambda l: pair(l, 1, lambda x: F.lit(True)))
    echo = anywhere(lambda l: pair(l, 2, lambda x: x["m"].isin(*h.between) & ~x["a"].isin(*h.may_echo)))
    twin = anywhere(lambda l: _twins(l, h))
    converb = anywhere(lambda l: F.arrays_overlap(
        F.transform(F.filter(l, lambda w: (w["upos"] == "VERB") & w["converb"]), lambda w: w["lemma"]),
        F.transform(F.filter(l, lambda w: (w["upos"] == "VERB") & ~w["converb"]), lambda w: w["lemma"])))
    return F.struct(_repeats(ends).alias("ending"), lemma(CONTENT).alias("lemma"), lemma(CONTENT + STRICT_CONTENT).alias("strict_lemma"),
                    form.alias("form"), adjacent.alias("adjacent"), echo.alias("echo"), noun.alias("noun"), twin.alias("twin"),
                    F.coalesce(converb, F.lit(False)).alias("converb"))


def _twins(l: Column, h: Habits) -> Column:
    words = F.transform(l, lambda w: w["word"])
    return _any([F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in t]))) == len(t) for t in h.twins])


def repeats(flags: Column, strict: bool = False) -> Column:
    names = ["ending", "lemma", "adjacent", "echo", "noun", "twin", "converb"] + (["strict_lemma", "form"] if strict else [])
    return _any([flags[n] for n in names])


# The line pairs that a scheme says should rhyme.
SCHEME_PAIRS = {
    "ABAB": [(0, 2), (1, 3)], "A-A-": [(0, 2), (1, 3)], "-A-A": [(0, 2), (1, 3)], "ABBA": [(0, 3), (1, 2)],
    "AABA": [(0, 1), (0, 3)], "AABB": [(0, 1), (2, 3)], "AAAA": [(0, 1), (1, 2), (2, 3)], "----": [(0, 1), (1, 2), (2, 3)],
}


def scheme_pairs(scheme: Column) -> Column:
    """``ARRAY<STRUCT<a, b>>`` of line numbers."""
    out = F.array().cast("array<struct<a:int,b:int>>")
    c = None
    for name, pairs in SCHEME_PAIRS.items():
        value = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
        c = F.when(scheme == name, value) if c is None else c.when(scheme == name, value)
    return c.otherwise(out)


def poor_rhyme(stanzas: DataFrame, listed: DataFrame, keys=("doc_id", "block"), h: Habits = RU) -> DataFrame:
    """``keys, repeated, verbs, grouped, poor``.  ``stanzas``: ``keys``, ``ends``
    (``ARRAY<STRUCT<word, upos>>``, the rhyming words) and ``scheme``.

    Only verb pairs that would count are looked up among the ``listed`` rhymes (``word_a, word_b``); such
    pairs are excused.  A stanza waits in the row of its first pair (rows without pairs are spread over keys
    that match nothing), so that it is made once."""
    keys = list(keys)
    s = settled(stanzas.select(*keys, "ends", "scheme", F.transform("ends", lambda e: F.translate(F.lower(e["word"]), *h.fold)).alias("_w")))
    w, raw = F.col("_w"), F.transform("ends", lambda e: F.lower(e["word"]))
    negated = F.exists(w, lambda a: F.exists(w, lambda b: F.concat(F.lit(h.negation), a) == b))
    repeated = _repeats(w) | negated
    hits = []
    for group in h.groups:
        if group[0].startswith("~"):
            rx = [f"^.+{g[1:]}$" for g in group]
            n = F.aggregate(raw, F.lit(0), lambda acc, x: acc + sum((x.rlike(r).cast("int") for r in rx), F.lit(0)))
        else:
            n = F.size(F.array_intersect(raw, F.array(*[F.lit(g) for g in group])))
        hits.append(n > 1)

    def weak(p: Column) -> Column:
        a, b = F.get(F.col("ends"), p["a"]), F.get(F.col("ends"), p["b"])
        x, y = F.lower(a["word"]), F.lower(b["word"])
        shared = _any([x.endswith(e) & y.endswith(e) for e in h.verb_endings])
        return F.coalesce((a["upos"] == "VERB") & (b["upos"] == "VERB") & (shared | x.endswith(y) | y.endswith(x)), F.lit(False))
    verbs = F.transform(F.filter(scheme_pairs(F.col("scheme")), weak), lambda p: F.struct(
        F.lower(F.get(F.col("ends"), p["a"])["word"]).alias("a"), F.lower(F.get(F.col("ends"), p["b"])["word"]).alias("b")))
    s = settled(s.select(*keys, repeated.alias("repeated"), _any(hits).alias("grouped"), verbs.alias("v")))
    idle = F.when(F.size("v") == 0, F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("int") + 1).otherwise(0)
    q = s.select(*keys, "repeated", "grouped", idle.alias("_n"), F.posexplode_outer("v").alias("_i", "_p"))
    q = q.select(*keys, "repeated", "grouped", "_n", "_i", F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"))
    q = q.join(listed.select(F.col("word_a").alias("_a"), F.col("word_b").alias("_b"), F.lit(0).alias("_n")).distinct().withColumn("_l", F.lit(True)),
               ["_a", "_b", "_n"], "left")
    counts = (F.col("_i").isNotNull() & F.col("_l").isNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).cast("int")
    q = q.select(*keys, "repeated", "grouped", "_i", (F.max(counts).over(Window.partitionBy(*keys)) == 1).alias("verbs"))
    r = q.where(F.coalesce(F.col("_i"), F.lit(0)) == 0)
    return r.select(*keys, "repeated", "verbs", "grouped", (F.col("repeated") | F.col("verbs") | F.col("grouped")).alias("poor"))


def syllable_defects(counts: Column, scheme: Column) -> Column:
    """Factor of a quatrain for unequal syllable counts (an array of four); penalties over one turn
    it negative, as the rules have it."""
    n = [F.get(counts, i) for i in range(4)]
    d = [x - n[0] for x in n]
    equal = (d[1] == 0) & (d[2] == 0) & (d[3] == 0)
    half = F.lit(0.5)
    crossed = (F.when((d[0] == d[2]) & (d[1] == d[3]), 0.95 * F.abs(d[0] - d[2]))
               .when((d[0] == d[1]) & (d[1] == d[2]), 0.90 * F.abs(d[0] - d[3])).otherwise(half))
    ringed = F.when((d[0] == d[3]) & (d[1] == d[2]), 0.90 * F.abs(d[0] - d[1])).otherwise(half)
    two = F.size(F.array_distinct(counts)) == 2
    span = F.array_max(counts) - F.array_min(counts)
    same_as_last = F.size(F.filter(counts, lambda x: x == n[3]))
    other = F.when(two & (same_as_last == 2), 0.85 * span).when(two & (same_as_last == 1), 0.80 * span).otherwise(half)
    penalty = F.when(scheme.isin("ABAB", "A-A-", "-A-A"), crossed).when(scheme.isin("ABBA", "-AA-"), ringed).otherwise(other)
    return F.when(equal, F.lit(1.0)).otherwise(1.0 - penalty)


# Factors of the line penalties.
PENALTIES = {"weak_end": 0.5, "no_ending": 0.1, "no_stress": 0.01, "opening": 0.1, "cluster": 0.5, "adposition": 0.5, "lonely": 0.1, "run": 0.1}
CLUSTER = 5


def line_penalties(words: Column, consonants: str, h: Habits = RU) -> Column:
    """``STRUCT``: how often each rule holds for a line of tagged words (``weak_end`` ... ``run``), and
    ``factor``, the product of the penalties."""
    n = F.size(words)
    last, before, first = F.get(words, n - 1), F.get(words, n - 2), F.get(words, F.lit(0))
    stressed = F.size(F.filter(words, lambda w: w["stress"] > 0))

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")
    weak_end = yes((n >= 2) & (last["stress"] == 0) & (before["stress"] == 0) & (before["upos"] == h.adposition) & (before["vowels"] > 0)
                   & (last["upos"] == h.pronoun))
    later = F.slice(words, 2, F.greatest(n, F.lit(1)))
    pairs = F.filter(F.zip_with(words, later, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull())

    letters = F.lit(consonants)
    tails = F.transform(words, lambda w: F.length(w["word"]) - F.length(F.rtrim(w["word"], letters)))
    heads = F.transform(later, lambda w: F.length(w["word"]) - F.length(F.ltrim(w["word"], letters)))
    cluster = F.size(F.filter(F.zip_with(tails, heads, lambda a, b: a + b), lambda c: c > CLUSTER))
    adposition = F.size(F.filter(pairs, lambda p: (p["a"]["upos"] == h.adposition) & (p["a"]["stress"] > 0)
                                 & p["b"]["upos"].isin("NOUN", "PROPN") & (p["b"]["stress"] > 0)))
    vowels = F.aggregate(words, F.lit(0), lambda acc, w: acc + w["vowels"])
    lonely = yes((stressed == 1) & ((n > 2) | ((n == 2) & (before["upos"] != h.adposition))) & (vowels > 2))
    sig = F.array_join(F.transform(words, lambda w: F.when(w["stress"] > 0, F.concat(
        F.repeat(F.lit("0"), w["stress"] - 1), F.lit("1"), F.repeat(F.lit("0"), w["vowels"] - w["stress"]))).otherwise(F.repeat(F.lit("0"), w["vowels"]))), "")
    found = {"weak_end": weak_end, "no_ending": yes(stressed == 0), "no_stress": yes(stressed == 0),
             "opening": yes((first["stress"] == 1) & (F.lower(first["word"]) == h.opening)), "cluster": cluster, "adposition": adposition,
             "lonely": lonely, "run": yes(sig.endswith("000"))}
    # the counts are a step of their own: the factor reads them and does not find them again
    counts = F.array(F.struct(*[v.alias(k) for k, v in found.items()]))
    factor = (lambda f: reduce(lambda a, b: a * b, [F.pow(F.lit(PENALTIES[k]), f[k].cast("double")) for k in found]))
    return F.get(F.transform(counts, lambda f: F.struct(*[f[k].alias(k) for k in found], factor(f).alias("factor"))), F.lit(0))


# Factors of a candidate's rank, short and long form, and the threshold of the long form.
RANK_FACTORS = {"format": 0.1, "repeats": 0.1, "poor": 0.1}
LONG_FACTOR, LONG_THRESHOLD = 0.5, 0.1


def candidate_rank_score(score: Column, scheme: Column, repeats_: Column, poor: Column, wanted: Column | None = None) -> Column:
    """Score of a short candidate; a scheme other than the wanted one, repetition and poor rhyme cost a
    factor each.  NULL for candidates without rhyme."""
    s = score * F.when(repeats_, RANK_FACTORS["repeats"]).otherwise(1.0) * F.when(poor, RANK_FACTORS["poor"]).otherwise(1.0)
    if wanted is not None:
        s = s * F.when(wanted.isNotNull() & (scheme != wanted), RANK_FACTORS["format"]).otherwise(1.0)
    return F.when(scheme != "----", s)


def long_rank_score(score: Column, scheme: Column, repeats_: Column, poor: Column) -> Column:
    """Score of a stanza of a long poem: half for one rhyme throughout, for repetition and for poor rhyme; NULL below
    the threshold."""
    half = [F.when(c, LONG_FACTOR).otherwise(1.0) for c in (scheme == "AAAA", repeats_, poor)]
    return F.when(score >= LONG_THRESHOLD, score * half[0] * half[1] * half[2])
