"""Alignment, corrections, phonetics, stress chain, defects, scans: brute force and hand-written rows."""
import collections
import itertools
import math
import random
import re

from pyspark.sql import functions as F

from cadenza.operators import align as A
from cadenza.operators import chain as C
from cadenza.operators import correct as K
from cadenza.operators import defects as D
from cadenza.operators import normalize as N
from cadenza.operators import phonetics as P
from cadenza.operators import sampling, scans, thesaurus
from cadenza.profiles import FEET

V = "aeiouyàâäáéèêëîïíôöóûùüúœæ"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


# alignment ---------------------------------------------------------------------
WORDS = {"banana": "3:1/99,2/100", "tomato": "3:2/100,3/99", "river": "2:1/100", "hotel": "2:1/99,2/100", "violet": "3:1/100,3/99"}


def options_of(w):
    n = sum(c in V for c in w)
    if n == 0:
        return 0, [(0, 1.0)]
    if n == 1:
        return 1, [(0, 1.0), (1, 0.95)] if len(w) <= 3 else [(0, 0.7), (1, 1.0)]
    if w in WORDS:
        return n, [(int(s), int(p) / 100) for s, p in (o.split("/") for o in WORDS[w].split(":")[1].split(","))]
    return n, [((n + 1) // 2, 1.0)]


def readings(line, foot, prefix):
    """(score, last stressed word, its stress, stresses) of every reading, by the definition."""
    words = re.findall(r"\w+", line.lower())
    opts = [options_of(w) for w in words]
    for choice in itertools.product(*[o for _, o in opts]):
        score, cursor, before, sig, last = 1.0, 0, None, "", (-1, 0)
        for k, ((n, _), (s, weight)) in enumerate(zip(opts, choice)):
            own = "".join("1" if i + 1 == s else "0" for i in range(n))
            for i, c in enumerate(own):
                at = cursor + i
                want = "0" if at < prefix else foot[(at - prefix) % len(foot)]
                score *= 0.1 if (want, c) == ("0", "1") else 0.95 if (want, c) == ("1", "0") else 1.0
            if before and own and before[-1] == "1" and own[0] == "1":
                score *= 0.1
            score *= weight
            cursor, before, sig = cursor + n, own, sig + own
            last = (k, s) if s else last
        score *= 0.1 ** len(re.findall("0{4,}", sig))
        yield score, *last, ",".join(str(s) for s, _ in choice)


def ending(line, word, stress):
    words = re.findall(r"\w+", line.lower())
    segs = re.findall(f"[{V}][^{V}]*", words[word])
    core, rest = "".join(segs[stress - 1:]), "".join(words[word + 1:])
    head = words[word][:len(words[word]) - len(core)]
    return (head[-1:] if not rest and len(core) == 1 else "") + core + rest


def brute_align(lines):
    if any(sum(sum(c in V for c in w) > 1 for w in re.findall(r"\w+", l.lower())) >= 8 for l in lines):
        return None
    best = None
    for m, (name, foot) in enumerate(FEET):
        if len(lines) == 1:
            found = [(round(math.log10(max(r[0] for r in readings(lines[0], foot, 0))), 9), 0, "")]
        else:
            per = []
            for l in lines:
                tails = {}
                for prefix in (0, 1):
                    by = {}
                    for r in readings(l, foot, prefix):
                        if r[1] >= 0 and (r[1:3] not in by or r[0] > by[r[1:3]] + 1e-12):
                            by[r[1:3]] = r[0]
                    kept = sorted(by.items(), key=lambda x: (-round(math.log10(x[1]), 9), x[0]))
                    for t, s in kept[:2] if len(lines) == 2 else kept:
                        if t not in tails or s > tails[t][0] + 1e-12:
                            tails[t] = (s, prefix, ending(l, *t))
                per.append(list(tails.values()))
            size = [sum(c in V for c in l.lower()) for l in lines]
            found = []
            for c in itertools.product(*per):
                s, e = math.prod(x[0] for x in c), [x[2] for x in c]
                if len(lines) == 2:
                    found.append((round(math.log10(s * (1 if e[0] == e[1] else 0.75)), 9), int(e[0] == e[1]), "AA" if e[0] == e[1] else "--"))
                    continue
                if sum(x[1] for x in c) in (1, 3):
                    s *= 0.1
                kinds = collections.Counter(size)
                if len(kinds) > 2 or 3 in kinds.values():
                    s *= 0.1
                r = {(i, j): e[i] == e[j] for i in range(4) for j in range(i + 1, 4)}
                rules = [(r[0, 1] and r[1, 2] and r[2, 3], "AAAA", 1), (r[0, 2] and r[1, 3], "ABAB", 1), (r[0, 3] and r[1, 2], "ABBA", 1),
                         (r[0, 1] and r[2, 3], "AABB", 1), (r[0, 1] and r[0, 3] and not r[0, 2], "AABA", 1), (r[0, 2] and not r[1, 3], "A-A-", 0.75),
                         (not r[0, 2] and r[1, 3], "-A-A", 0.75), (r[1, 2] and not r[0, 1] and not r[2, 3], "-AA-", 0.75), (True, "----", 0.5)]
                k = next(i for i, x in enumerate(rules) if x[0])
                found.append((round(math.log10(s * rules[k][2]), 9), 9 - k, rules[k][1]))
        for s, rank, scheme in found:
            if best is None or (s, -m, rank) > best[0]:
                best = ((s, -m, rank), name, scheme)
    return (best[1], best[2], round(best[0][0], 6)) if best else None


def test_align_brute(spark):
    rng = random.Random(3)
    pool = list(WORDS) + ["the", "of", "sun", "stone", "grr", "and", "light", "amor"]
    poems = []
    for i in range(60):
        n = (1, 2, 4)[i % 3]
        ends = [rng.choice(pool) for _ in range(2)]
        poems.append((i, 0, [" ".join([rng.choice(pool) for _ in range(rng.randrange(1, 4))] + [rng.choice(ends)]) for _ in range(n)]))
    poems += [(90, 0, ["banana " * 8]), (91, 0, ["grr", "grr"]), (92, 0, ["grr"]), (93, 1, ["the of the", "of the of", "sun", "and"])]
    options = spark.createDataFrame(list(WORDS.items()), "word string, options string")
    d = spark.createDataFrame(poems, "doc_id long, block int, lines array<string>")
    got = {(r["doc_id"], r["block"]): r for r in A.align_scores(d, options).collect()}
    assert len(got) == len(poems)
    for i, b, lines in poems:
        r, want = got[i, b], brute_align(lines)
        if want is None:
            assert r["metre"] is None and r["score"] == 0.0, lines
            continue
        assert (r["metre"], r["scheme"], r["log_score"]) == want, (lines, want)
        # the returned stresses have the line scores that they claim
        if len(lines) == 1:
            foot = dict(FEET)[r["metre"]]
            assert any(x[3] == r["paths"][0] and abs(math.log10(x[0]) - r["log_score"]) < 1e-6 for x in readings(lines[0], foot, 0))
        else:
            assert all(p in {x[3] for x in readings(l, "1", 0)} for p, l in zip(r["paths"], lines))


def test_blocks(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {chr(97 + j)}" for j in range(i))) for i in range(9)] + [(20, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["block"]): len(r["lines"]) for r in A.blocks(docs).collect()}
    assert got == {(1, 0): 1, (2, 0): 2, (3, 0): 2, (3, 1): 1, (4, 0): 4, (5, 0): 4, (5, 1): 1, (6, 0): 4, (6, 1): 2, (7, 0): 4, (7, 1): 2, (7, 2): 1, (8, 0): 4, (8, 1): 4}


def test_cyclic_fit(spark):
    def brute(sig, foot):
        def score(exp):
            return math.prod(0.1 if (e, s) == ("0", "1") else 0.9 if (e, s) == ("1", "0") else 1 for e, s in zip(exp, sig))
        long = foot * len(sig)
        return max(score(long), score("0" + long)) if foot[0] == "1" and sig[0] == "0" else score(long)
    sigs = ["1", "0", "0101", "1010", "100100", "010010010", "11111", "00000", "0011001"]
    d = spark.createDataFrame([(s,) for s in sigs], "sig string")
    for name, foot in FEET:
        for r in d.select("sig", A.cyclic_line_score(F.col("sig"), foot).alias("v")).collect():
            assert abs(10 ** r["v"] - brute(r["sig"], foot)) < 1e-9, (name, r["sig"])


# corrections -------------------------------------------------------------------
def brute_fixes(flags, template):
    out, at = [], 0
    for w, f in enumerate(flags.split("|")):
        seg = template[at:at + len(f)].lower()
        at += len(f)
        n = f.count("1")
        if n == 0:
            out += [(w, i, "addition") for i, c in enumerate(seg) if c == "s"]
        elif len(f) > 1:
            out += [(w, j, "correction" if n == 1 else "resolution") for i, c in enumerate(f) if c == "1" and seg[i] == "u"
                    for j, s in enumerate(seg) if j != i and s == "s"]
    return out


def brute_improved(flags, fixes):
    out = [list(f) for f in flags.split("|")]
    for w, i, kind in sorted(fixes, key=lambda x: x[2] == "addition"):
        if kind != "addition":
            out[w] = ["0"] * len(out[w])
        out[w][i] = "1"
    return "|".join("".join(f) for f in out)


def test_fixes_and_improved_flags(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        flags = "|".join("".join(rng.choice("001") for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(1, 6)))
        rows.append((flags, "".join(rng.choice("suSU") for _ in flags.replace("|", ""))))
    d = spark.createDataFrame(rows, "flags string, t string").withColumn("f", K.fixes(F.col("flags"), F.col("t")))
    for r in d.select("flags", "t", "f", K.improved_flags(F.col("flags"), F.col("f")).alias("i")).collect():
        want = brute_fixes(r["flags"], r["t"])
        assert [tuple(x) for x in r["f"]] == want
        assert r["i"] == brute_improved(r["flags"], want)


def test_corrected_metre(spark):
    """A line that only fits the iamb when a stress moves costs as much as a strong error."""
    rows = [(1, 0, ["x"], "01|01|01|01"), (1, 1, ["x"], "01|01|10|01"), (2, 0, ["x"], "10|10|10|1"), (3, 0, ["x"], ""), (4, 0, ["x"], "0|1|0")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, words array<string>, flags string")
    m = K.poem_metre_corrected(lines)
    got = {r["doc_id"]: r["metre"] for r in m.collect()}
    assert got[1] == "iambos" and got[2] == "choreios" and set(got) == {1, 2, 3, 4}
    im = {(r["doc_id"], r["line_no"]): r for r in K.improved_stress(lines, m).collect()}
    assert im[1, 1]["improved"] == "01|01|01|01" and im[1, 1]["n_corrections"] == 1
    assert im[1, 0]["improved"] == im[1, 0]["flags"] and im[3, 0]["improved"] == ""


# phonetics ---------------------------------------------------------------------
XWORDS = [
    ("мороз", 2, "мар^ос", "^ос"), ("сад", 1, "с^ат", "^ат"), ("мышь", 1, "м^ыш", "^ыш"), ("ружья", 2, "ружь^я", "жь^я"),
    ("смеётся", 2, "сми^оца", "^оца"), ("моя", 2, "ма^я", "а^я"), ("поэтом", 2, "па^этам", "^этам"), ("ответом", 2, "атв^этам", "^этам"),
    ("двери", 1, "дв^эры", "^эры"), ("верил", 1, "в^эрыл", "^эрыл"), ("нуле", 2, "нул^э", "л^э"), ("вперёд", 2, "фпир^от", "^от"),
    ("суббота", 2, "суб^ота", "^ота"), ("прожка", 1, "пр^ошка", "^ошка"), ("ель", 1, "^эль", "^эль"), ("на", None, "на", "на"), ("е", 1, "^э", "э"),
]


def test_xword_ru(spark):
    d = spark.createDataFrame([(w, n) for w, n, _, _ in XWORDS], "w string, n int").withColumn("x", P.xword(F.col("w"), F.col("n")))
    got = {r["w"]: (r["x"]["xword"], r["x"]["clausula"]) for r in d.collect()}
    assert got == {w: (x, c) for w, _, x, c in XWORDS}


def test_xword_special_cases(spark):
    r = one(spark, P.xword(F.lit("большого"), F.lit(2), adjective=F.lit(True)))
    assert r["xword"] == "бальш^ова"
    r = one(spark, P.xword(F.lit("я"), F.lit(1), prefix=F.lit("а")))
    assert (r["xword"], r["clausula"]) == ("^я", "а^я")
    r = one(spark, P.xword(F.lit("чему"), F.lit(2), tail=F.lit("же")))
    assert r["xword"] == "чим^ужэ" and r["clausula"] == "^ужэ"


HEARD = [("олнце", "онцэ"), ("аться", "аца"), ("обка", "опка"), ("оровод", "орават"), ("ожь", "ош"), ("едь", "еть"),
                                           ("астье", "астье"), ("ший", "шый"), ("", "")]


def test_pronounce_ru(spark):
    d = spark.createDataFrame(HEARD, "e string, h string").select("e", P.pronounce(F.col("e")).alias("p"))
    assert {r["e"]: r["p"] for r in d.collect()} == dict(HEARD)


FUZZY = [
    (("поэтом", 2), ("ответом", 2), True), (("верил", 1), ("двери", 1), True), (("моя", 2), ("ружья", 2), True), (("риска", 1), ("миске", 1), True),
    (("победа", 2), ("приеду", 2), True), (("нуле", 2), ("амулет", 3), True), (("кот", 1), ("дом", 1), False), (("синий", 1), ("осина", 2), True),
    (("пощады", 2), ("ограда", 2), True), (("стол", 1), ("река", 2), False), (("медведи", 2), ("соседе", 2), True),
]


def test_fuzzy_rhyme_ru(spark):
    d = spark.createDataFrame([(i, *x) for i, (a, b, _) in enumerate(FUZZY) for x in ((0, *a), (1, *b))], "i int, side int, w string, n int")
    x = P.xword(F.col("w"), F.col("n"))
    d = d.select("i", "side", x.alias("x"))
    left, right = P.pair_keys(F.col("x.xword"))
    d = d.select("i", "side", F.struct(F.col("x.clausula").alias("clausula"), left.alias("left"), right.alias("right")).alias("s"))
    j = d.where("side = 0").select("i", F.col("s").alias("a")).join(d.where("side = 1").select("i", F.col("s").alias("b")), "i")
    got = {r["i"]: (r["ab"], r["ba"]) for r in j.select("i", P.fuzzy_match(F.col("a"), F.col("b")).alias("ab"), P.fuzzy_match(F.col("b"), F.col("a")).alias("ba")).collect()}
    assert {FUZZY[i][:2]: v for i, v in got.items()} == {(a, b): (r, r) for a, b, r in FUZZY}


def test_listed_rhymes(spark):
    lines = spark.createDataFrame([(1, 0, 0, "кот", 1, "от"), (1, 0, 1, "дом", 1, "ом"), (1, 0, 2, "лом", 1, "ом"), (2, 0, 0, "дом", 1, "ом")],
                                  "doc_id long, block int, line_no int, word string, stress int, exact string")
    listed = spark.createDataFrame([("дом", "кот")], "word_a string, word_b string")
    got = {(r["line_a"], r["line_b"]): r["kind"] for r in P.rhyme_pairs(lines, listed=listed).collect()}
    assert got == {(0, 1): "listed", (1, 2): "exact"}
    assert {(r["line_a"], r["line_b"]) for r in P.rhyme_pairs(lines).collect()} == {(1, 2)}


def test_ending_keys_ru(spark):
    def brute(word, stress):
        cx, v = [], 0
        for c in word:
            if c in "аеёиоуыэюя":
                v += 1
                cx.append(c.upper() if v == stress else c)
            else:
                cx.append(c)
        w, s = "".join(cx), next((c for c in cx if c.isupper()), None)
        return [w[-n:] for n in range(2, len(w)) if s in (w[-n:][0], w[-n:][1])]
    rows = [("корова", 2), ("молоко", 3), ("дом", 1), ("ель", 1), ("я", 1)]
    d = spark.createDataFrame(rows, "w string, s int").select("w", P.ending_keys(F.col("w"), F.col("s")).alias("k"))
    assert {r["w"]: r["k"] for r in d.collect()} == {w: brute(w, s) for w, s in rows}


# stress chain ------------------------------------------------------------------
def test_stress_chain_ru(spark):
    dic = {"машина": 2, "стоишь": 2, "клавиш": 1, "щупать": 1, "герой": 2, "пьянка": 1, "детский": 1}
    want = {"машина": (2, "dictionary"), "машына": (2, "respelling"), "децкий": (1, "respelling"), "стоиш": (2, "ending"), "клавишь": (1, "silent"),
            "щщупать": (1, "doubled"), "сильнейший": (2, "fixed"), "антигерой": (4, "prefix"), "пъянка": (1, "sign"), "неведомо": (2, "default"),
            "дом": (1, "default"), "вж": (None, None)}
    words = spark.createDataFrame([(w,) for w in want] * 2, "word string")
    d = spark.createDataFrame(list(dic.items()), "word string, stress int")
    got = {r["word"]: (r["stress"], r["origin"]) for r in C.stress_chain(words, d).collect()}
    assert got == want


def test_restored_spellings(spark):
    v = spark.createDataFrame([("ёлка",), ("всё",), ("все",), ("лёд",), ("лед",), ("мёд",)], "word string")
    t = C.restore_table(v, F.translate("word", "ё", "е"))
    got = {r["word"]: r["restored"] for r in C.yo_restore(spark.createDataFrame([("елка",), ("все",), ("мед",), ("лес",)], "word string"), t).collect()}
    assert got == {"елка": "ёлка", "все": "все", "мед": "мёд", "лес": "лес"}


def test_collocations(spark):
    c = spark.createDataFrame([("a b", 0, 0, 1), ("a b", 1, 1, 2), ("b c", 0, 1, 1), ("a b c", 0, 0, 1), ("a b c", 1, 2, 3), ("d d", 0, 0, 1)],
                              "words string, ord int, stressed_idx int, stress int")
    lines = spark.createDataFrame([(1, 0, "x a b c a b".split()), (1, 1, "d d d".split()), (2, 0, ["a"]), (2, 1, []), (2, 2, "b c".split())],
                                  "doc_id long, line_no int, words array<string>")
    got = sorted(tuple(r) for r in C.collocation_override(lines, c).collect())
    assert got == [(1, 0, 1, 3, 1, 2, 3), (1, 0, 4, 2, 0, 0, 1), (1, 0, 4, 2, 1, 1, 2), (1, 1, 0, 2, 0, 0, 1), (2, 2, 0, 2, 0, 1, 1)]


# defects -----------------------------------------------------------------------
def w(word, upos="NOUN", lemma=None, stress=1, converb=False):
    return word, lemma or word, upos, converb, stress, sum(c in "аеёиоуыэюя" for c in word)


REPEATS = [
    ([w("любовь"), w("и", "CCONJ"), w("любовь")], "echo"), ([w("вновь", "ADV"), w("и", "CCONJ"), w("вновь", "ADV")], None),
    ([w("шёл", "VERB"), w("шёл", "VERB")], "adjacent"), ([w("поёт", "X"), w("он", "X"), w("поет", "X")], "twin"),
    ([w("любишь", "VERB", "любить"), w("ты", "X"), w("любя", "VERB", "любить", converb=True)], "converb"), ([w("дом"), w("лес")], None),
    ([w("красивый", "ADJ", "красивый"), w("лес"), w("красивая", "ADJ", "красивый")], "lemma"),
]


def test_repetition_ru(spark):
    d = spark.createDataFrame([(i, [line, [w("конец")]]) for i, (line, _) in enumerate(REPEATS)], f"i int, lines {D.TAGGED}")
    f = d.select("i", D.repetition(F.col("lines"), F.array(F.lit("раз"), F.lit("два"))).alias("f"))
    for r in f.select("i", "f.*", D.repeats(F.col("f")).alias("any")).collect():
        flag = REPEATS[r["i"]][1]
        assert r["any"] == (flag is not None) and (flag is None or r[flag]), REPEATS[r["i"]]
    assert d.select(D.repetition(F.col("lines"), F.array(F.lit("да"), F.lit("да")))["ending"].alias("e")).first()["e"]


COUNTS = [
    ([8, 8, 8, 8], "ABAB", 1.0), ([9, 8, 9, 8], "ABAB", 1.0), ([8, 8, 8, 6], "ABAB", -0.8), ([9, 8, 7, 8], "ABAB", 0.5), ([8, 9, 9, 8], "ABBA", 0.1),
    ([8, 9, 8, 8], "-AA-", 0.5), ([8, 8, 9, 9], "AABB", 0.15), ([8, 8, 8, 9], "AABB", 0.2), ([8, 9, 8, 8], "AABB", 0.5), ([7, 8, 9, 8], "----", 0.5)]


def test_syllable_defects(spark):
    d = spark.createDataFrame([(i, c, s) for i, (c, s, _) in enumerate(COUNTS)], "i int, c array<int>, s string")
    for r in d.select("i", D.syllable_defects(F.col("c"), F.col("s")).alias("f")).collect():
        assert abs(r["f"] - COUNTS[r["i"]][2]) < 1e-9, COUNTS[r["i"]]


def test_poor_rhyme_ru(spark):
    def ends(*xs):
        return [(x.split("/")[0], (x.split("/") + ["NOUN"])[1]) for x in xs]
    rows = [(1, ends("дом", "лес", "дом", "сад"), "----"), (2, ends("легко", "лес", "нелегко", "сад"), "A-A-"), (3, ends("ждали/VERB", "лес", "гадали/VERB", "сад"), "ABAB"),
            (4, ends("ждать/VERB", "лес", "подождать/VERB", "сад"), "ABAB"), (5, ends("витаю/VERB", "лес", "таю/VERB", "сад"), "ABAB"), (6, ends("твой", "лес", "мой", "сад"), "ABAB"),
            (7, ends("пришёл", "лес", "ушёл", "сад"), "ABAB"), (8, ends("ждали/VERB", "гадали/VERB", "лес", "сад"), "ABAB"), (9, ends("дом", "лес", "ком", "сад"), "ABAB")]
    d = spark.createDataFrame([(i, 0, e, s) for i, e, s in rows], "doc_id long, block int, ends array<struct<word:string,upos:string>>, scheme string")
    listed = spark.createDataFrame([("витаю", "таю")], "word_a string, word_b string")
    got = {r["doc_id"]: (r["repeated"], r["verbs"], r["grouped"]) for r in D.poor_rhyme(d, listed).collect()}
    y, n = True, False
    assert got == {1: (y, n, n), 2: (y, n, n), 3: (n, y, n), 4: (n, y, n), 5: (n, n, n), 6: (n, n, y), 7: (n, n, y), 8: (n, n, n), 9: (n, n, n)}


LINES = [
    ([w("дом"), w("лес")], 1.0), ([w("и", "CCONJ"), w("лес"), w("дом")], 0.1), ([w("дом", stress=0), w("лес", stress=0)], 0.001),
    ([w("лес"), w("для", "ADP", stress=0), w("них", "PRON", stress=0)], 0.5 * 0.1), ([w("по", "ADP"), w("домам", stress=2)], 0.5),
    ([w("взгляд", stress=1), w("лес")], 1.0), ([w("царств"), w("взгляд")], 0.5), ([w("что", stress=0), w("за", stress=0), w("недоразуменье", stress=5)], 0.1)]


def test_line_penalties_ru(spark):
    d = spark.createDataFrame([(i, [line]) for i, (line, _) in enumerate(LINES)], f"i int, lines {D.TAGGED}")
    for r in d.select("i", D.line_penalties(F.get("lines", F.lit(0)), "бвгджзйклмнпрстфхцчшщ").alias("p")).collect():
        assert abs(r["p"]["factor"] - LINES[r["i"]][1]) < 1e-12, (LINES[r["i"]], r)


def test_ranks(spark):
    f = [F.lit(0.8), F.lit("ABAB"), F.lit(True), F.lit(False)]
    assert abs(one(spark, D.candidate_rank_score(*f)) - 0.08) < 1e-12
    assert abs(one(spark, D.candidate_rank_score(*f, F.lit("AABA"))) - 0.008) < 1e-12
    assert one(spark, D.candidate_rank_score(F.lit(0.8), F.lit("----"), F.lit(False), F.lit(False))) is None
    assert one(spark, D.long_rank_score(F.lit(0.8), F.lit("AAAA"), F.lit(True), F.lit(True))) == 0.1
    assert one(spark, D.long_rank_score(F.lit(0.05), F.lit("ABAB"), F.lit(False), F.lit(False))) is None


# thesaurus ---------------------------------------------------------------------
def test_contrast_pairs(spark):
    opp = spark.createDataFrame([("hot", "cold"), ("up", "down")], "word string, other string")
    groups = spark.createDataFrame([("hot", "hot"), ("hot", "heat"), ("hot", "shared"), ("cold", "cold"), ("cold", "chill"), ("cold", "shared")], "word string, member string")
    got = {(r["word"], r["other"]) for r in thesaurus.contrast_pairs(opp, groups).collect()}
    half = {(a, b) for a in ("hot", "heat", "shared") for b in ("cold", "chill")} | {("up", "down")}
    assert got == half | {(b, a) for a, b in half}
    links = spark.createDataFrame([("hot", "cold", "opposite"), ("hot", "heat", "cognate"), ("x", "y", "z")], "word string, other string, rel string")
    neutral = spark.createDataFrame([("hot", "warm"), ("hot", "tepid")], "word string, neutral string")
    r = {x["word"] + x["other"]: (x["cognates"], x["contrast"], x["neutral"]) for x in thesaurus.related_words(
        links, groups, thesaurus.contrast_pairs(opp, groups), neutral).collect()}
    assert r == {"hotcold": (False, True, "tepid"), "hotheat": (True, False, "tepid"), "xy": (False, False, None)}


# scans, picks, spaces ------------------------------------------------------------
def test_marked_blocks_brute(spark):
    def reader(lines, bound):
        out, chunk, first = [], [], 0
        for i, l in enumerate(lines + ["#"]):
            if l.startswith("#") or sum(map(len, chunk)) > bound:
                if chunk:
                    out.append((first, chunk))
                chunk, first = [], i + 1
            else:
                chunk.append(l)
        return out
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice(["#", "", "ab", "x" * 900, "#z", "y" * 6000]) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    docs += [(100, None), (101, "\n".join(["w" * 40] * 20_000))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in scans.marked_blocks(d, "#", 1).orderBy("doc_id", "block").collect():
        got[r["doc_id"]].append((r["first_line"], r["text"].split("\n")))
    for i, t in docs:
        assert got.get(i, []) == reader((t or "").split("\n"), 5000), i


def test_samples(spark):
    assert one(spark, scans.framed_samples(F.lit("<s>a#one</s><s>two #x#y</s> </s>plain"))) == ["one", "x#y", "plain"]
    assert one(spark, scans.multiline_samples(F.lit("a\nb</s>\nc</s>\nrest"))) == ["a\nb</s>", "c</s>"]


def test_weighted_pick_frequencies(spark):
    g = spark.range(6000).select(F.col("id").alias("g"), F.explode(sampling.rank_weights(F.array(*[F.lit(k) for k in ("one two three", "b", "a long word")]))).alias("k"))
    assert [r["k"]["key"] for r in g.where("g = 0").collect()] == ["one two three", "a long word", "b"]
    picked = sampling.weighted_pick(g.select("g", "k.rank", "k.key"), "g", "key", 1.0 / F.col("rank"))
    n = collections.Counter(r["key"] for r in picked.collect())
    for key, weight in (("one two three", 6), ("a long word", 3), ("b", 2)):
        p = weight / 11
        assert abs(n[key] / 6000 - p) < 4 * math.sqrt(p * (1 - p) / 6000)


SPACES = [
    ("кто - то сказал , да .", "кто-то сказал, да."), ("Глянь - ка сюда", "Глянь-ка сюда"), ("по - новому", "по-новому"), ("Кто - нибудь", "Кто-нибудь"),
    ("Не ярко - красные", "Не ярко-красные"), ("« да »", "«да»"), ("тишина \" звучит \" всегда", "тишина \"звучит\" всегда"), ("из - за угла", "из-за угла"),
    ("Баба - Яга", "Баба-Яга"), ("Нью - Йорке", "Нью-Йорке"), ("он - она", "он - она"), ("из́ - за", "из́ - за"), ("ка́к - либо", "ка́к-либо"), ("a‌b", "a b")]


def test_normalize_spaces_ru(spark):
    d = spark.createDataFrame(SPACES, "t string, w string").select("t", N.normalize_spaces(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in d.collect()} == dict(SPACES)


def test_answers_join_is_whole(spark, tmp_path):
    from cadenza.plans.q_tokens import q_answers_join
    rows = [(1, 0, "user", "q0"), (1, 1, "assistant", "a0"), (1, 2, "user", "q2"), (2, 0, "assistant", "a"), (3, 6, "user", "q"), (3, 7, "assistant", "b"), (3, 8, "system", "s")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in q_answers_join(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, 0, "q0", "a0"), (1, 2, "q2", None), (2, -1, None, "a"), (3, 6, "q", "b")], key=repr)
