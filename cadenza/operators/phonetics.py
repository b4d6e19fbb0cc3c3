"""Phonetic transcripts of words, endings and the fuzzy rhyme rules.

Everything is a chain of column expressions over distinct words: ordered substitutions, then
context rules as regular expressions with look-around (one pass each, so a rule never sees its
own output), then devoicing.  A :class:`Phonetics` table holds one language's rules; ``RU`` has
the values of the rule set that the engine follows, ``LATIN`` our own for the fixture languages.

Fuzzy rhyme of two lines is decided inside the row of their poem: each line carries its
clausula and, per ending pair, what the pair's pattern captures; equal captures match.  No two
lines of different poems ever meet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.corpus import settled, tasks
from cadenza.operators.rhyme import FOLD_FROM, FOLD_TO

# Substitutions of the ending transcript, in order.
PRONOUNCE_SUBSTITUTIONS = [
    ("лнц", "нц"), ("сч", "щ"), ("ться", "ца"), ("тся", "ца"), ("тц", "ц"), ("жи", "жы"), ("ши", "шы"), ("ци", "цы"),
    ("жё", "жо"), ("це", "цэ"), ("чья", "ча"), ("чье", "чэ"), ("чьё", "чо"), ("чью", "чё"),
]
# Substitutions of the word transcript, in order.
XWORD_SUBSTITUTIONS = [("лнц", "нц"), ("сч", "щ"), ("ться", "ца"), ("тся", "ца"), ("тц", "ц")]

# Pairs of ending patterns that rhyme loosely (C: consonant, A: vowel), either way round.
FUZZY_ENDING_PAIRS = [
    (r"[бвгджзклмнпрстфхцчшщл]ь\^ер", r"\^е"),
    (r"л\^э", r"л\^эт"),
    (r"\^уж[уыэа]", r"\^уж[уыэа]"),
    (r"\^утам", r"\^уты"),
    (r"\^ады", r"\^аты"),
    (r"\^овый", r"\^овай"),
    (r"\^ымым", r"\^ымам"),
    (r"\^ыськы", r"\^ыскы"),
    (r"\^альцэ", r"\^альца"),
    (r"\^озин", r"\^озэ"),
    (r"\^убым", r"\^убам"),
    (r"\^ыскра", r"\^ыстра"),
    (r"\^ызар", r"\^ыза"),
    (r"\^анай", r"\^аный"),
    (r"\^очна", r"\^очный"),
    (r"\^юц[эа]", r"\^удц[аэ]"),
    (r"[:C:]\^ое", r"[:C:]\^оя"),
    (r"\^ает", r"\^ают"),
    (r"\^ывый", r"\^ыва"),
    (r"\^энья", r"\^энье"),
    (r"\^айна", r"\^айнай"),
    (r"\^овым", r"\^овам"),
    (r"\^авай", r"\^ава"),
    (r"\^([:A:][:C:]+)а", r"\^([:A:][:C:]+)э"),
    (r"\^ыны", r"\^ына"),
    (r"\^([:A:][:C:][:A:][:C:])а", r"\^([:A:][:C:][:A:][:C:])ам"),
    (r"\^ысил", r"\^ысыл"),
    (r"\^([:A:][:C:]{2,})э", r"\^([:A:][:C:]{2,})ай"),
    (r"\^([:A:][щч])ие", r"\^([:A:][щч])ые"),
    (r"([:C:])\^ою", r"([:C:])\^ое"),
    (r"\^([:A:][:C:])ай", r"\^([:A:][:C:])а"),
    (r"\^([:A:][жш])[эау]", r"\^([:A:][жш])[эау]"),
    (r"\^([:A:]ш)ин", r"\^([:A:]ш)ан"),
    (r"\^([:A:][:C:]+ь)э", r"\^([:A:][:C:]+ь)а"),
    (r"\^([:A:][:C:]+)[ыэ]", r"\^([:A:][:C:]+)[ыэ]"),
    (r"\^([:A:][:C:]+)[оуа]", r"\^([:A:][:C:]+)[оау]м"),
    (r"\^([:A:][:C:]+[ыэ])[й]", r"\^([:A:][:C:]+[ыэ])"),
    (r"([:C:]+\^[ыэ])[й]", r"([:C:]+\^[ыэ])"),
    (r"\^([:A:][:C:]+)[оуа][мн]", r"\^([:A:][:C:]+)[оау]"),
    (r"([:C:])\^[оуа]н", r"([:C:])\^[оау]"),
    (r"(\^[:A:][:C:]+)[оуа]", r"(\^[:A:][:C:]+)[оау]"),
]

# Ours: the same kinds of pairs for the Latin-script fixtures.
LATIN_ENDING_PAIRS = [
    (r"\^([:A:][:C:]+)[aiu]", r"\^([:A:][:C:]+)[aiu]"),
    (r"\^([:A:][:C:]+)[aiu]n", r"\^([:A:][:C:]+)[aiu]"),
    (r"([:C:])\^[aoe]n", r"([:C:])\^[aoe]"),
    (r"\^([:A:][:C:]{2,})e", r"\^([:A:][:C:]{2,})er"),
    (r"\^([:A:][:C:]+)es", r"\^([:A:][:C:]+)e"),
]


@dataclass(frozen=True)
class Phonetics:
    """Rules of one language.  ``reduced``: vowels changed wherever unstressed; ``after_consonant``:
    (letter, inside a word, at its end) changed unless it begins the word or follows a vowel or
    one of ``keepers``; ``stressed``: the stressed vowel, kept as it is after a vowel or
    ``glides`` if it is in ``iotated``; ``devoiced``: voiced to voiceless before ``voiceless``;
    ``last``: the word's last letter."""
    vowels: str
    consonants: str             # of the fuzzy rules
    ending_vowels: str          # of the fuzzy rules
    pronounce: list = field(default_factory=list)
    word: list = field(default_factory=list)
    reduced: dict = field(default_factory=dict)
    after_consonant: list = field(default_factory=list)
    keepers: dict = field(default_factory=dict)
    stressed: dict = field(default_factory=dict)
    iotated: str = ""
    glides: str = ""
    hush: tuple = ("", "", "")  # letter, becomes, before these
    devoiced: dict = field(default_factory=dict)
    voiceless: str = ""
    last: dict = field(default_factory=dict)
    soft: str = ""              # silent letter at a word's end, after these:
    soft_after: str = ""
    soft_devoiced: str = ""
    tail_last: dict = field(default_factory=dict)
    adjective: tuple = ("", "") # stressed ending of adjectives and determiners, as spoken
    reflexive: tuple = ()       # endings after the stressed vowel
    reflexive_as: str = ""
    alone: str = ""             # a one-letter word that stands for its vowel
    unstressed: dict = field(default_factory=dict)
    pairs: list = field(default_factory=list)
    softer: dict = field(default_factory=dict)      # vowel -> its iotated form
    semivowel: str = ""
    signs: str = ""
    fold: tuple = ("", "")


RU = Phonetics(
    vowels="уеыаоэёяию", consonants="бвгджзклмнпрстфхцчшщ", ending_vowels="аеёиоуыэюя",
    pronounce=PRONOUNCE_SUBSTITUTIONS, word=XWORD_SUBSTITUTIONS,
    reduced={"о": "а"}, after_consonant=[("и", "ы", "ы"), ("е", "и", "э"), ("я", "а", "а"), ("ё", "о", "о"), ("ю", "у", "у")],
    keepers={"и": "ь", "е": "ь", "я": "ь", "ю": "ь", "ё": ""},
    stressed={"е": "э", "я": "а", "ё": "о", "ю": "у", "и": "ы"}, iotated="еёюя", glides="ьъ",
    hush=("ж", "ш", "пфктс"), devoiced={"б": "п", "в": "ф", "г": "к", "д": "т", "ж": "ш", "з": "с"}, voiceless="кпстфх",
    last={"д": "т", "ж": "ш", "з": "с", "г": "х", "б": "п", "в": "ф"},
    soft="ь", soft_after="шч", soft_devoiced="бвгдз", tail_last={"ж": "ш", "в": "ф", "б": "п"},
    adjective=("ого", "ова"), reflexive=("ться", "тся"), reflexive_as="ца", alone="я",
    unstressed={"о": "а", "и": "ы", "ю": "у", "я": "а", "ё": "о", "е": "э"}, pairs=FUZZY_ENDING_PAIRS,
    softer={"э": "е", "у": "ю", "а": "я", "о": "ё"}, semivowel="й", signs="ьъ")

LATIN = Phonetics(
    vowels="aeiouyœæ", consonants="bcdfghjklmnpqrstvwxzçñß", ending_vowels="aeiouyœæ",
    pronounce=[("sch", "sh"), ("ph", "f"), ("qu", "k"), ("ck", "k"), ("th", "t"), ("tz", "z")],
    word=[("sch", "sh"), ("ph", "f"), ("qu", "k"), ("ck", "k"), ("th", "t"), ("tz", "z")],
    reduced={"o": "a", "œ": "e", "æ": "e"}, after_consonant=[("y", "i", "i"), ("e", "i", "e")], keepers={"y": "", "e": ""},
    stressed={"y": "i", "œ": "e", "æ": "e"}, hush=("g", "k", "pfkts"),
    devoiced={"b": "p", "v": "f", "g": "k", "d": "t", "z": "s"}, voiceless="kpstfh",
    last={"d": "t", "z": "s", "g": "k", "b": "p", "v": "f"}, unstressed={"o": "a", "y": "i", "œ": "e", "æ": "e"},
    tail_last={"b": "p", "v": "f"}, pairs=LATIN_ENDING_PAIRS, softer={"e": "y"}, semivowel="y", fold=(FOLD_FROM, FOLD_TO))

MARK = "\u0001"


def _replaced(s: Column, pairs: list) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _mapped(s: Column, letters: dict) -> Column:
    return F.translate(s, "".join(letters), "".join(letters.values())) if letters else s


def _where(s: Column, pattern: str, letters: dict) -> Column:
    """Letters mapped where ``pattern`` (one letter long, with look-around) matches: the matches
    are marked in one pass over the text as it was, then replaced."""
    s = F.regexp_replace(s, pattern, MARK + "$0")
    for a, b in letters.items():
        s = F.replace(s, F.lit(MARK + a), F.lit(b))
    return F.replace(s, F.lit(MARK), F.lit(""))


def single_consonants(s: Column, p: Phonetics) -> Column:
    return F.regexp_replace(s, f"([{p.consonants}])\\1", "$1")


def devoice_inside(s: Column, p: Phonetics) -> Column:
    return _where(s, f"[{''.join(p.devoiced)}](?=[{p.voiceless}])", p.devoiced)


def _soft_end(s: Column, p: Phonetics) -> Column:
    return _where(s, f"[{p.soft_devoiced}](?={p.soft}$)", {c: p.devoiced.get(c, c) for c in p.soft_devoiced}) if p.soft_devoiced else s


def pronounce(s: Column, p: Phonetics = RU) -> Column:
    """Transcript of a word's ending from its stressed vowel on."""
    s = F.coalesce(s, F.lit(""))
    if p.fold[0]:
        s = F.translate(s, *p.fold)
    if p.soft:
        s = F.regexp_replace(s, f"([жш]){p.soft}$", "$1")
    s = devoice_inside(single_consonants(_replaced(s, p.pronounce), p), p)
    s = _soft_end(_where(s, f"[{''.join(p.devoiced)}]$", p.devoiced), p)
    first = f"^[^{p.vowels}]*[{p.vowels}]"
    head = F.regexp_extract(s, first, 0)
    return F.concat(head, _mapped(F.substring(s, F.length(head) + 1, F.length(s) + 1), p.reduced))


def transcript_unstressed(s: Column, p: Phonetics = RU) -> Column:
    """Words without stress before or after the rhyming word."""
    s = F.coalesce(s, F.lit(""))
    if p.fold[0]:
        s = F.translate(s, *p.fold)
    return _where(_mapped(s, p.unstressed), f"[{''.join(p.tail_last)}]$", p.tail_last)


def _unstressed_vowels(s: Column, p: Phonetics, ends: bool) -> Column:
    s = _mapped(s, p.reduced)
    for letter, mid, end in p.after_consonant:
        before = f"(?<=[^{p.vowels}{p.keepers[letter]}])"
        if ends and end != mid:
            s = F.regexp_replace(s, f"{before}{letter}$", MARK if end == letter else end)
        s = F.regexp_replace(s, f"{before}{letter}", mid)
        s = F.replace(s, F.lit(MARK), F.lit(letter))
    return s


def xword(word: Column, stress: Column, p: Phonetics = RU, prefix: Column | None = None, tail: Column | None = None,
          adjective: Column | None = None) -> Column:
    """``STRUCT<xword, clausula>``: the word's transcript with ``^`` before the stressed vowel, and
    its ending from there (one letter earlier, two after a sign, when that vowel is the last)."""
    none = F.lit("")
    prefix, tail = prefix if prefix is not None else none, tail if tail is not None else none
    w = F.lower(word)
    if p.fold[0]:
        w = F.translate(w, *p.fold)
    segs = F.regexp_extract_all(w, F.lit(f"[{p.vowels}][^{p.vowels}]*"), 0)
    hit = F.coalesce((stress >= 1) & (stress <= F.size(segs)), F.lit(False))
    at = F.when(hit, stress).otherwise(F.lit(1))
    before = F.concat(F.regexp_extract(w, f"^[^{p.vowels}]*", 0), F.array_join(F.slice(segs, F.lit(1), at - 1), ""))
    own = F.coalesce(F.get(segs, at - 1), none)
    after = F.concat(F.substring(own, 2, 1 << 20), F.array_join(F.slice(segs, at + 1, F.greatest(F.size(segs), F.lit(1))), ""))
    v = F.substring(own, 1, 1)
    spoken = _mapped(v, p.stressed)
    vowel = spoken
    if p.iotated:
        vowel = F.when(before.rlike(f"[{p.glides}{p.vowels}]$") & v.isin(*p.iotated), v).otherwise(spoken)
    rest = _unstressed_vowels(F.concat(v, after), p, True)
    body = F.concat(_unstressed_vowels(before, p, False), F.lit("^"), vowel, F.substring(rest, 2, 1 << 20))
    if p.reflexive:
        body = F.when(after.isin(*p.reflexive), F.concat(_unstressed_vowels(before, p, False), F.lit("^"), spoken, F.lit(p.reflexive_as))).otherwise(body)
    if p.adjective[0]:
        is_adjective = adjective if adjective is not None else F.lit(False)
        body = F.when(is_adjective & (F.concat(v, after) == p.adjective[0]),
                      F.concat(_unstressed_vowels(before, p, False), F.lit("^" + p.adjective[1]))).otherwise(body)
    body = F.when(hit, body).otherwise(_unstressed_vowels(w, p, True))
    if p.hush[0]:
        body = _where(body, f"{p.hush[0]}(?=[{p.hush[2]}])", {p.hush[0]: p.hush[1]})
    body = _where(body, f"[{''.join(p.last)}]$", p.last)
    if p.soft:
        body = F.regexp_replace(body, f"^(.+[{p.soft_after}]){p.soft}$", "$1")
    x = F.concat(transcript_unstressed(prefix, p), body, transcript_unstressed(tail, p))
    x = _soft_end(devoice_inside(single_consonants(_replaced(x, p.word), p), p), p)
    mark = F.instr(x, "^")
    back = F.when(mark != F.length(x) - 1, 0).when(mark == 1, -1)      # nothing before the mark: the vowel alone
    if p.signs:
        back = back.when(F.substring(x, mark - 1, F.lit(1)).isin(*p.signs), 2)
    ending = F.when(mark == 0, x).otherwise(F.substring(x, mark - back.otherwise(1), F.length(x)))
    r = F.struct(x.alias("xword"), ending.alias("clausula"))
    if p.alone:
        bare = (word == p.alone) & (stress == 1) & (F.instr(F.lit(p.vowels), prefix) > 0)
        r = F.when(bare, F.struct(F.lit("^" + p.alone).alias("xword"), F.concat(prefix, F.lit("^" + p.alone)).alias("clausula"))).otherwise(r)
    return r


# ---------------------------------------------------------------------------
# fuzzy rhyme
# ---------------------------------------------------------------------------
def pair_keys(x: Column, p: Phonetics = RU) -> tuple[Column, Column]:
    """What the left (right) patterns of the ending pairs capture at the end of ``x``, '' if they
    capture nothing, NULL where they do not match."""
    def side(k: int) -> Column:
        out = []
        for pair in p.pairs:
            rx = pair[k].replace(":C:", p.consonants).replace(":A:", p.ending_vowels) + "$"
            out.append(F.when(x.rlike(rx), F.regexp_extract(x, rx, 1) if "(" in rx else F.lit("")))
        return F.array(*out)
    return side(0), side(1)


def _clausula_rules(a: Column, b: Column, p: Phonetics) -> Column:
    """The rules that look at two clausulas, ``a`` being the one named first."""
    C, V = p.consonants, p.ending_vowels

    def at(c: Column, i: int) -> Column:             # from the end
        return F.substring(c, F.length(c) + 1 + i, F.lit(1))

    def head(c: Column, i: int) -> Column:           # without the last i letters
        return F.substring(c, F.lit(1), F.greatest(F.length(c) - i, F.lit(0)))

    def within(c: Column, letters: str) -> Column:
        return c.isin(*letters) if letters else F.lit(False)

    def nth(c: Column, i: int) -> Column:
        return F.substring(c, i + 1, 1)
    la, lb = F.length(a), F.length(b)
    signs, soft = p.signs, p.softer
    return (
        ((la > lb) & a.startswith(b) & within(at(a, -1), C))
        | ((la == lb) & (head(a, 1) == head(b, 1)) & (la >= 3) & within(at(a, -2), C) & within(at(a, -1), V) & within(at(b, -1), V))
        | ((la == 5) & (lb == 4) & a.startswith(F.substring(b, 1, 3)) & within(at(a, -2), V) & (at(a, -1) == p.semivowel) & within(at(b, -1), V))
        | ((la == 4) & (lb == 5) & (F.substring(a, 1, 3) == F.substring(b, 1, 3)) & within(at(a, -1), V) & within(at(b, -2), V) & within(at(b, -1), C))
        | ((la == lb) & (la >= 4) & (head(a, 2) == head(b, 2)) & within(at(a, -2), V) & within(at(b, -2), V)
           & within(at(a, -1), C + p.semivowel) & within(at(b, -1), C + p.semivowel))
        | ((la == lb) & (la >= 4) & (head(a, 2) == head(b, 2)) & (at(a, -1) == at(b, -1)) & within(at(a, -2), V) & within(at(b, -2), V))
        | ((a == "^" + (p.alone or "\u0002")) & (lb == 4) & b.endswith((signs[:1] or "\u0002") + "^" + (p.alone or "\u0002")))
        | ((la >= 3) & (lb >= 3) & (F.substring(a, la - 1, F.lit(2)) == F.substring(b, lb - 1, F.lit(2))) & (at(a, -2) == "^")
           & within(at(a, -1), p.iotated) & within(at(b, -1), p.iotated) & within(at(a, -3), V + signs) & within(at(b, -3), V + signs))
        | ((la == lb) & (la >= 5) & (head(a, 1) == head(b, 1)) & within(at(a, -2), signs) & within(at(a, -1), V) & within(at(b, -1), V))
        | ((la == 3) & (lb == 3) & (nth(a, 0) == "^") & (nth(b, 0) == "^") & (nth(a, 1) == "э") & (nth(b, 1) == "е") & (nth(a, 2) == nth(b, 2)))
        | ((la == 4) & (lb == 4) & (nth(a, 0) == "^") & within(nth(a, 1), "".join(soft)) & (nth(b, 1) == _mapped(nth(a, 1), soft))
           & within(nth(a, 2), C) & (nth(a, 2) == nth(b, 2)) & within(at(a, -1), V) & within(at(b, -1), V))
    )


def fuzzy_match(a: Column, b: Column, p: Phonetics = RU) -> Column:
    """Whether two lines rhyme loosely.  ``a``, ``b``: structs of ``clausula`` and the two key
    arrays ``left``, ``right`` of :func:`pair_keys`."""
    ca, cb = a["clausula"], b["clausula"]

    def keyed(x: Column, y: Column) -> Column:
        return F.exists(F.zip_with(x, y, lambda i, j: F.coalesce(i == j, F.lit(False))), lambda e: e)
    return F.coalesce(((F.length(ca) >= 3) & (ca == cb)) | _clausula_rules(ca, cb, p) | _clausula_rules(cb, ca, p)
                      | keyed(a["left"], b["right"]) | keyed(a["right"], b["left"]), F.lit(False))


def rhyme_pairs(lines: DataFrame, keys=("doc_id", "block"), p: Phonetics = RU, listed: DataFrame | None = None) -> DataFrame:
    """``keys, line_a, line_b, word_a, word_b, kind`` of the rhyming line pairs of each group
    (small: a stanza).  ``lines``: ``keys, line_no, word`` (rhyming word), ``stress``, ``exact``
    (canonical clausula).  ``kind`` is the first of ``listed`` (word pairs, either way round),
    ``exact`` and ``fuzzy`` that holds."""
    keys = list(keys)
    xw = xword(F.col("word"), F.col("stress"), p)
    # each word is transcribed once; words are few bytes and much work, so they are dealt out, or else their small partitions
    # would be joined into a few
    words = lines.select("word", "stress").distinct().repartition(tasks(lines.sparkSession))
    words = settled(words.withColumn("x", xw))
    left, right = pair_keys(F.col("x.xword"), p)
    # settled again: the join below would else derive filters from these expressions, which takes longer than the query
    words = settled(words.select("word", "stress", F.col("x.clausula").alias("clausula"), left.alias("left"), right.alias("right")))
    d = lines.join(words, ["word", "stress"])
    g = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "word", "exact", "clausula", "left", "right"))).alias("l"))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice(F.col("l"), i + 2, F.size("l")), lambda b: F.struct(
        a["line_no"].alias("line_a"), b["line_no"].alias("line_b"), a["word"].alias("word_a"), b["word"].alias("word_b"),
        F.coalesce(a["exact"] == b["exact"], F.lit(False)).alias("exact"), fuzzy_match(a, b, p).alias("fuzzy")))))
    some = F.filter(pairs, lambda q: q["exact"] | q["fuzzy"]) if listed is None else pairs
    x = settled(g.select(*keys, some.alias("q"))).select(*keys, F.explode("q").alias("q")).select(*keys, "q.*")
    if listed is not None:
        both = listed.select(F.col("word_a").alias("_a"), F.col("word_b").alias("_b"))
        both = both.unionByName(listed.select(F.col("word_b").alias("_a"), F.col("word_a").alias("_b"))).distinct().withColumn("_l", F.lit(True))
        x = x.join(both, (F.col("word_a") == F.col("_a")) & (F.col("word_b") == F.col("_b")), "left").drop("_a", "_b")
    else:
        x = x.withColumn("_l", F.lit(None).cast("boolean"))
    kind = F.when(F.col("_l"), "listed").when(F.col("exact"), "exact").when(F.col("fuzzy"), "fuzzy")
    return x.select(*keys, "line_a", "line_b", "word_a", "word_b", kind.alias("kind")).where("kind IS NOT NULL")


def ending_keys(word: Column, stress: Column, p: Phonetics = RU) -> Column:
    """Endings of two letters and more, up to the whole word but its first letter, whose first or
    second letter is the stressed vowel (written large)."""
    w = F.lower(word)
    segs = F.regexp_extract_all(w, F.lit(f"[{p.vowels}][^{p.vowels}]*"), 0)
    core = F.array_join(F.slice(segs, stress, F.greatest(F.size(segs), F.lit(1))), "")
    start = F.length(w) - F.length(core)
    marked = F.concat(F.substring(w, F.lit(1), start), F.upper(F.substring(core, 1, 1)), F.substring(core, 2, 1 << 20))
    v = F.upper(F.substring(core, 1, 1))
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.length(w) - 1, F.lit(2))), lambda n: F.substring(marked, F.length(w) - n + 1, n))
    ok = F.filter(ends, lambda e: ((F.substring(e, 1, 1) == v) | (F.substring(e, 2, 1) == v)) & (F.length(e) < F.length(w)))
    return F.when((F.length(w) >= 3) & stress.between(1, F.size(segs)), ok).otherwise(F.array().cast("array<string>"))
