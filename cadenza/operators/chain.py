"""The stress chain behind the dictionary: restored spellings, respellings, prefixes, collocations.

A word that the dictionary does not list gives one row per rule that applies to it, with the
spelling that the rule leads to and the rule's rank.  All rows meet the dictionary in a single
equi-join, and the smallest rank that hits wins (``min`` of a struct: map-side combined, no
window).  Rules are expressions over distinct words, so they cost nothing per token.

Collocations are looked up as n-gram keys; only hits return to their line, where a fold over
the line's hits keeps the first of overlapping ones, three words before two.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.profiles import LATIN, RU, Profile

# Substring respellings in the order they are tried.
RESPELLINGS = [
    ("тьса", "тся"), ("тьса", "ться"), ("ться", "тся"), ("юцца", "ются"), ("цца", "ться"), ("юца", "ются"),
    ("шы", "ши"), ("жы", "жи"), ("цы", "ци"), ("щю", "щу"), ("чю", "чу"), ("ща", "сча"), ("щя", "ща"), ("чя", "ча"),
    ("жэ", "же"), ("цэ", "це"), ("жо", "жё"), ("шо", "шё"), ("чо", "чё"), ("́чьк", "чк"), ("що", "щё"), ("щьк", "щк"),
    ("цк", "тск"), ("цца", "тся"), ("ъе", "ьё"), ("ье", "ъе"), ("сн", "стн"), ("цц", "тц"), ("цц", "дц"),
    ("чт", "чьт"), ("тьн", "тн"), ("зд", "сд"), ("тса", "тся"),
]
# Respelled endings.
RESPELLED_ENDINGS = [("иш", "ишь"), ("еш", "ешь"), ("еч", "ечь"), ("мса", "мся")]
# Productive prefixes in the order they are tried.
PREFIXES = ("спец сверх недо анти полу электро магнито не прото микро макро нано квази само слабо одно двух трех четырех "
            "пяти шести семи восьми девяти десяти одиннадцати двенадцати тринадцати четырнадцати пятнадцати шестнадцати "
            "семнадцати восемнадцати девятнадцати двадцати тридцами сорока пятидесяти шестидесяти семидесяти восьмидесяти "
            "девяносто сто тысяче супер лже мета").split()


@dataclass(frozen=True)
class Chain:
    """Rules of a language.  ``silent_end``: (letter, after these) dropped at a word's end;
    ``fixed``: a substring whose first vowel is stressed; ``sign``: (letter, its substitute)."""
    prof: Profile
    respellings: list
    endings: list
    prefixes: list
    silent_end: tuple = ("", "")
    fixed: str = ""
    sign: tuple = ("", "")
    fold: dict = field(default_factory=dict)


RU_CHAIN = Chain(RU, RESPELLINGS, RESPELLED_ENDINGS, PREFIXES, ("ь", "чшщ"), "ейш", ("ъ", "ь"))
# Ours: the same kinds of rules for the Latin-script fixtures.
LATIN_CHAIN = Chain(LATIN, [("ph", "f"), ("th", "t"), ("ck", "k"), ("ou", "u"), ("ea", "e"), ("ei", "ie"), ("an", "en"), ("ti", "si")],
                    [("s", ""), ("er", "re"), ("ing", "in")], ["anti", "over", "con", "re", "un", "in", "de", "an", "en", "er", "th"],
                    ("e", "hst"), "tion", ("k", "c"))

KINDS = ("respelling", "ending", "silent", "doubled", "fixed", "prefix", "sign")


def candidates(word: Column, c: Chain) -> Column:
    """``ARRAY<STRUCT<ord, kind, rule, spelling, add>>``: where each rule leads, in rule order.
    ``add`` vowels come before the spelling; the fixed rule needs no dictionary (``spelling`` is
    NULL, ``add`` is the stress)."""
    out = []

    def add(cond: Column, kind: str, rule: str, spelling: Column, more: Column | None = None) -> None:
        out.append(F.when(cond, F.struct(F.lit(len(out)).alias("ord"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"),
                                         spelling.alias("spelling"), (more if more is not None else F.lit(0)).cast("int").alias("add"))))
    for a, b in c.respellings:
        add(F.contains(word, F.lit(a)), "respelling", f"{a}>{b}", F.replace(word, F.lit(a), F.lit(b)))
    for a, b in c.endings:
        add(word.endswith(a), "ending", f"{a}>{b}", F.concat(F.substring(word, F.lit(1), F.length(word) - len(a)), F.lit(b)))
    if c.silent_end[0]:
        add(word.rlike(f"[{c.silent_end[1]}]{c.silent_end[0]}$"), "silent", c.silent_end[0], F.substring(word, F.lit(1), F.length(word) - 1))
    # the first doubled letter of the word; every run of that letter becomes one
    twice = F.regexp_extract(word, "(.)\\1", 1)
    segs = F.split(word, "")
    single = F.array_join(F.transform(segs, lambda x, i: F.when((i > 0) & (x == twice) & (F.get(segs, i - 1) == x), "").otherwise(x)), "")
    add(twice != "", "doubled", "xx>x", single)
    if c.fixed:
        add(F.contains(word, F.lit(c.fixed)), "fixed", c.fixed, F.lit(None).cast("string"),
            T.vowel_count(F.substring_index(word, c.fixed, 1), c.prof) + 1)
    for p in c.prefixes:
        add(word.startswith(p) & (F.length(word) - len(p) > 2), "prefix", p, F.substring(word, F.lit(len(p) + 1), F.length(word)),
            T.vowel_count(F.lit(p), c.prof))
    if c.sign[0]:
        add(F.contains(word, F.lit(c.sign[0])), "sign", f"{c.sign[0]}>{c.sign[1]}", F.replace(word, F.lit(c.sign[0]), F.lit(c.sign[1])))
    return F.array_compact(F.array(*out))


def restore_table(vocabulary: DataFrame, folded: Column) -> DataFrame:
    """``word, restored``: plain spellings that stand for exactly one marked word of the
    vocabulary and are no words themselves."""
    v = vocabulary.select("word", folded.alias("plain"))
    one = (v.groupBy("plain").agg(F.count("*").alias("n"), F.min("word").alias("restored"))
           .where((F.col("n") == 1) & (F.col("plain") != F.col("restored"))))
    return one.select(F.col("plain").alias("word"), "restored")


def yo_restore(words: DataFrame, table: DataFrame) -> DataFrame:
    """``words`` with ``restored``: the marked spelling, or the word itself."""
    return words.join(table, "word", "left").withColumn("restored", F.coalesce("restored", "word"))


def stress_chain(words: DataFrame, dictionary: DataFrame, chain: Chain = RU_CHAIN) -> DataFrame:
    """``word, stress, origin, rule, spelling`` of distinct ``words``: the dictionary first, then the
    first rule that leads to a listed spelling, then the default rule; no stress without vowels.
    ``origin`` is ``dictionary``, one of ``KINDS``, ``default`` or NULL."""
    w = words.select("word").distinct()
    n = T.vowel_count("word", chain.prof)
    own = dictionary.select("word", F.col("stress").alias("_s"))
    known = w.join(own, "word")
    missing = w.join(own, "word", "left_anti").withColumn("n", n)
    c = missing.where("n > 1").select("word", F.explode(candidates(F.col("word"), chain)).alias("c")).select("word", "c.*")
    hit = (c.where("spelling IS NOT NULL").join(own.withColumnRenamed("word", "spelling"), "spelling")
           .select("word", "ord", "kind", "rule", "spelling", (F.col("_s") + F.col("add")).alias("stress")))
    free = c.where("spelling IS NULL").select("word", "ord", "kind", "rule", "spelling", F.col("add").alias("stress"))
    best = hit.unionByName(free).groupBy("word").agg(F.min(F.struct("ord", "kind", "rule", "spelling", "stress")).alias("b"))
    rest = missing.join(best, "word", "left")
    some = F.col("n") > 0
    rest = rest.select("word", F.when(some, F.coalesce("b.stress", T.default_stress("n"))).cast("int").alias("stress"),
                       F.when(some, F.coalesce("b.kind", F.lit("default"))).alias("origin"), F.col("b.rule").alias("rule"), F.col("b.spelling").alias("spelling"))
    none = F.lit(None).cast("string")
    return known.select("word", F.col("_s").cast("int").alias("stress"), F.lit("dictionary").alias("origin"), none.alias("rule"), none.alias("spelling")).unionByName(rest)


# ---------------------------------------------------------------------------
# collocations
# ---------------------------------------------------------------------------
HITS = "array<struct<pos:int,size:int,variants:array<struct<ord:int,stressed_idx:int,stress:int>>>>"


def collocation_override(lines: DataFrame, collocations: DataFrame, keys=("doc_id", "line_no"), words_col: str = "words") -> DataFrame:
    """``keys, pos, size, ord, stressed_idx, stress`` of the collocations of each line, from left to
    right without overlap, three words before two.  ``collocations``: ``words`` (two or three,
    joined by a space), ``ord`` (listing order), ``stressed_idx``, ``stress``.  Of a listed triple the
    last variant holds; all variants of a pair are alternatives."""
    keys = list(keys)
    c = collocations.withColumn("size", F.size(F.split("words", " ")))
    v = F.sort_array(F.collect_list(F.struct("ord", "stressed_idx", "stress")))
    table = c.groupBy(F.col("words").alias("_k"), "size").agg(v.alias("variants"))
    table = table.withColumn("variants", F.when(F.col("size") == 3, F.slice("variants", -1, 1)).otherwise(F.col("variants"))).drop("size")
    w = F.col(words_col)

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        return F.transform(at, lambda i: F.struct(i.cast("int").alias("pos"), F.lit(n).alias("size"), F.array_join(F.slice(w, i + 1, n), " ").alias("k")))
    every = F.concat(F.when(F.size(w) >= 3, grams(3)).otherwise(F.slice(grams(3), 1, 0)), F.when(F.size(w) >= 2, grams(2)).otherwise(F.slice(grams(2), 1, 0)))
    g = lines.select(*keys, F.explode(every).alias("g"))
    hit = g.join(table, F.col("g.k") == F.col("_k")).select(*keys, F.col("g.pos").alias("pos"), (-F.col("g.size")).alias("m"), "variants")
    per = hit.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "m", "variants"))).alias("h"))
    init = F.struct(F.lit(0).alias("next"), F.array().cast(HITS).alias("out"))
    fold = F.aggregate("h", init, lambda acc, x: F.when(x["pos"] >= acc["next"], F.struct(
        (x["pos"] - x["m"]).alias("next"), F.concat(acc["out"], F.array(F.struct(x["pos"].alias("pos"), (-x["m"]).alias("size"),
                                                                                 x["variants"].alias("variants")))).cast(HITS).alias("out"))).otherwise(acc))
    x = per.select(*keys, F.explode(fold["out"]).alias("q")).select(*keys, "q.pos", "q.size", F.explode("q.variants").alias("v"))
    return x.select(*keys, "pos", "size", "v.ord", "v.stressed_idx", "v.stress")
