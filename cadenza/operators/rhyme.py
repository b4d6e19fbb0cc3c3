"""Rhyme: line endings, rhyme pairs, quatrain selection, scheme scores, markup.

Rhyme is decided on a canonical *clausula* string per line ending, so rhyme
detection is an equality (hashable) test.  Groups, near pairs and quatrains are found inside a
poem's row; ``exact_rhyme_pairs`` links each line to the nearest earlier one of its group,
which is linear in the number of lines however large a poem or a rhyme class is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators.corpus import settled
from cadenza.profiles import LATIN, Profile, profile as get_profile

# Accent folding applied to clausulas (Latin profile).
FOLD_FROM = "àâäáéèêëîïíôöóûùüú"
FOLD_TO = "aaaaeeeeiiiooouuuu"
# Punctuation removed before taking a line's last word
# (ASCII punctuation plus « » — …).
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»—…"
# Accepted quatrain schemes.
QUATRAIN_SCHEMES = ["AABB", "ABAB", "ABBA"]


def last_word(line) -> Column:
    """Last letter run of a line, lower case (NULL if none)."""
    w = T.words(line)
    return F.when(F.size(w) > 0, F.element_at(w, -1))


def clausula(word, prof: Profile | str = LATIN) -> Column:
    """Ending from the stressed vowel (default stress rule); with final stress
    the preceding letter is included.  Accents folded.  NULL without vowels.

    The stressed vowel is found through vowel-initial segments
    (``[V][^V]*``): the text from segment ``s`` on is the ending, which is the
    same position as "syllables before s plus the onset of syllable s"."""
    w = T._c(word)
    return _ending(w, _segments(w, prof))


def _segments(word: Column, prof: Profile | str) -> Column:
    p = get_profile(prof)
    return F.regexp_extract_all(word, F.lit(p.vowel_class + p.non_vowel_class + "*"), 0)


def _ending(w: Column, segs: Column) -> Column:
    k = F.size(segs)
    s = T.default_stress(k)
    tail = F.array_join(F.slice(segs, s, k), "")
    start = F.length(w) - F.length(tail) + 1
    start = F.when(s == k, F.greatest(start - 1, F.lit(1))).otherwise(start)
    return F.when(k > 0, F.translate(w.substr(start, F.lit(1 << 30)), FOLD_FROM, FOLD_TO))


def rhyme_key(line, n_syl: int = 2, prof: Profile | str = LATIN, use_all: bool = False) -> Column:
    """Last ``n_syl`` syllables of the line's last token (whole token if
    shorter, or with ``use_all``), lower-cased."""
    toks = F.filter(F.split(F.regexp_replace(T._c(line), "[" + _re_escape(PUNCT) + "]", ""), " "),
                    lambda x: x != "")
    last = F.lower(F.element_at(toks, -1))
    if use_all:
        return last
    syls = T.syllables(last, prof)
    return F.when(F.size(toks) == 0, F.lit(None)).when(
        F.size(syls) >= n_syl, F.array_join(F.slice(syls, -n_syl, n_syl), "")).otherwise(last)


def _re_escape(chars: str) -> str:
    return "".join("\\" + c if c in "[]\\^-" else c for c in chars)


def line_endings(lines: DataFrame, prof: Profile | str = LATIN, keys=("doc_id", "line_no"),
                 text_col: str = "text") -> DataFrame:
    x = lines.select(*keys, text_col, last_word(text_col).alias("last_word"))
    return x.withColumn("clausula", clausula("last_word", prof))


def _poem_keys(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """One row per poem: its lines' clausulas, in place (no shuffle)."""
    return docs.select(key, line_keys(T.verse_lines(text_col)).alias("keys"))


def rhyme_groups(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line_no, clausula, rhyme_group): lines with equal clausulas share a group,
    numbered by first appearance from 1; NULL without clausula.  The lines of a poem
    lie in one row, so nothing is shuffled."""
    p = _poem_keys(docs, key, text_col).withColumn("_kinds", F.array_distinct(F.array_compact("keys")))
    numbered = F.transform("keys", lambda k: F.struct(
        k.alias("clausula"), F.array_position("_kinds", k).cast("long").alias("rhyme_group")))
    x = p.select(key, F.posexplode(numbered).alias("line_no", "g"))
    return x.select(key, F.col("line_no").cast("long").alias("line_no"), "g.clausula", "g.rhyme_group")


def exact_rhyme_pairs(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line_a, line_b, rhyme_group): each line with the nearest earlier line that
    rhymes with it, however far.  Two lines rhyme exactly if they share the group.  A poem's lines are sorted
    by group inside its row, where neighbours of one group are the pairs: nothing is shuffled."""
    p = settled(_poem_keys(docs, key, text_col)).withColumn("_kinds", F.array_distinct(F.array_compact("keys")))
    numbered = F.transform("keys", lambda k, i: F.struct(F.array_position("_kinds", k).cast("long").alias("g"), i.cast("long").alias("i")))
    p = settled(p.select(key, F.array_sort(F.filter(numbered, lambda x: x["g"].isNotNull())).alias("s")))
    after = F.slice("s", F.lit(2), F.greatest(F.size("s"), F.lit(1)))
    pairs = F.filter(F.zip_with("s", after, lambda a, b: F.struct(a["i"].alias("line_a"), b["i"].alias("line_b"), a["g"].alias("g"), (a["g"] == b["g"]).alias("same"))),
                     lambda q: F.coalesce(q["same"], F.lit(False)))
    x = p.select(key, F.explode(pairs).alias("q"))
    return x.select(key, F.col("q.g").alias("rhyme_group"), F.col("q.line_b").alias("line_b"), F.col("q.line_a").alias("line_a"))


def near_rhyme_pairs(docs: DataFrame, window: int = 3, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, line_a, line_b, gap): rhyming lines up to ``window`` lines apart."""
    keys = F.col("keys")
    near = F.transform(keys, lambda k, i: F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(window)), lambda d: F.get(keys, i + d) == k),
        lambda d: F.struct(i.alias("a"), d.alias("gap"))))
    x = _poem_keys(docs, key, text_col).select(key, F.explode(F.flatten(near)).alias("p"))
    return x.select(key, F.col("p.a").cast("long").alias("line_a"),
                    (F.col("p.a") + F.col("p.gap")).cast("long").alias("line_b"), F.col("p.gap").alias("gap"))


def quatrain_scheme(k0, k1, k2, k3) -> Column:
    """Scheme of a 4-line window from the clausula keys (NULL = unrhymed)."""
    allnn = k0.isNotNull() & k1.isNotNull() & k2.isNotNull() & k3.isNotNull()
    return (F.when(~allnn, F.lit(None))
            .when((k0 == k1) & (k2 == k3) & (k0 != k2), "AABB")
            .when((k0 == k2) & (k1 == k3) & (k0 != k1), "ABAB")
            .when((k0 == k3) & (k1 == k2) & (k0 != k1), "ABBA"))


def quatrains(endings: DataFrame, key: str = "doc_id", order: str = "line_no",
              text_col: str = "text") -> DataFrame:
    """Greedy stanza selection: scan 4-line windows left to right; a window
    whose rhyme pattern is AABB/ABAB/ABBA is emitted and the scan jumps 4,
    otherwise it advances 1.

    Valid windows come from ``lead`` (parallel); only the greedy choice among a
    poem's valid starts is sequential: a fold over the sorted start positions
    of that poem (ints + the four lines of each valid window)."""
    w = Window.partitionBy(key).orderBy(order)
    ks = [F.col("clausula")] + [F.lead("clausula", d).over(w) for d in (1, 2, 3)]
    ts = [F.col(text_col)] + [F.lead(text_col, d).over(w) for d in (1, 2, 3)]
    win = endings.select(key, F.col(order).alias("start"), quatrain_scheme(*ks).alias("scheme"),
                         F.array_join(F.array(*ts), "\n").alias("stanza"))
    valid = win.where(F.col("scheme").isNotNull())
    g = valid.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "scheme", "stanza"))).alias("c"))
    init = F.struct(F.lit(-1).cast("long").alias("nxt"),
                    F.array().cast("array<struct<start:int,scheme:string,stanza:string>>").alias("out"))
    fold = F.aggregate("c", init, lambda acc, x: F.when(
        x["start"] >= acc["nxt"],
        F.struct((x["start"] + 4).cast("long").alias("nxt"), F.concat(acc["out"], F.array(x)).alias("out"))
    ).otherwise(acc))
    return g.select(key, F.explode(fold["out"]).alias("q")).select(
        key, F.col("q.start").alias("start"), F.col("q.scheme").alias("scheme"), F.col("q.stanza").alias("stanza"))


def poem_quatrains(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, start, scheme, stanza`` as :func:`quatrains`, inside each poem's row: no shuffle.  The starts of
    valid windows are found first; the greedy choice folds over those few numbers, and only chosen
    windows are given their lines."""
    p = settled(docs.select(key, T.verse_lines(text_col).alias("lines")).where(F.size("lines") >= 4))
    p = settled(p.select(key, "lines", line_keys(F.col("lines")).alias("k")))
    schemes = F.transform(F.sequence(F.lit(0), F.size("k") - 4), lambda i: F.struct(
        i.alias("start"), quatrain_scheme(*[F.get("k", i + d) for d in range(4)]).alias("scheme")))
    p = settled(p.select(key, "lines", F.filter(schemes, lambda x: x["scheme"].isNotNull()).alias("c")).where(F.size("c") > 0))
    kind = "array<struct<start:int,scheme:string>>"
    init = F.struct(F.lit(0).alias("next"), F.array().cast(kind).alias("out"))
    fold = F.aggregate("c", init, lambda acc, x: F.when(x["start"] >= acc["next"], F.struct(
        (x["start"] + 4).alias("next"), F.concat(acc["out"], F.array(x)).cast(kind).alias("out"))).otherwise(acc))
    q = p.select(key, "lines", F.explode(fold["out"]).alias("q"))
    return q.select(key, F.col("q.start").alias("start"), F.col("q.scheme").alias("scheme"),
                    F.array_join(F.slice("lines", F.col("q.start") + 1, 4), "\n").alias("stanza"))


def line_keys(lines, prof: Profile | str = LATIN) -> Column:
    """Clausula of every line of an array of lines.  Lambdas are interpreted and share nothing, so each step
    (last word, its segments, the ending) is an array of its own and is evaluated once a line."""
    return word_keys(line_ends(lines), prof)


def line_ends(lines) -> Column:
    """Last word of every line of an array of lines ('' if none), read from the line's end."""
    return F.transform(lines, lambda l: F.regexp_extract(F.lower(l), r"(?s)^(?:.*\P{L})?(\p{L}+)\P{L}*$", 1))


def word_keys(words, prof: Profile | str = LATIN) -> Column:
    """Clausula of every word of an array of words; the segments of a word are found once."""
    parts = F.transform(words, lambda w: F.struct(w.alias("w"), _segments(w, prof).alias("segs")))
    return F.transform(parts, lambda x: _ending(x["w"], x["segs"]))


def scheme_rhyme_score(keys, scheme) -> Column:
    """Hits between found rhyme links and scheme links, over the number of
    lines (0 without lines).  Line i is compared with scheme positions j of
    the same letter, j != i mod len(scheme), j < len(scheme).  ``keys`` is the
    array of line clausulas (see :func:`line_keys`)."""
    n = F.size(keys)
    L = F.length(scheme)

    def hits_of(i):
        p = F.pmod(i, L)
        return F.size(F.filter(F.sequence(F.lit(0), L - 1), lambda j: (
            (j != p) & (F.substring(scheme, j + 1, 1) == F.substring(scheme, p + 1, 1)) & (j < n)
            & F.coalesce(F.get(keys, j) == F.get(keys, i), F.lit(False)))))

    hits = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0),
                       lambda acc, i: acc + F.when(i < n, hits_of(i)).otherwise(0))
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def scheme4(df: DataFrame, keys_col: str = "keys") -> DataFrame:
    """Adds ``scheme`` and ``factor`` of a 4-line text from the six pairwise
    rhyme flags (first matching rule wins); ``keys_col`` holds line clausulas."""
    k = F.col(keys_col)

    def r(a, b):
        return F.coalesce(F.get(k, a) == F.get(k, b), F.lit(False))

    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    df = df.select("*", *[r(a, b).alias(f"_r{a}{b}") for a, b in pairs])
    r01, r02, r03, r12, r13, r23 = [F.col(f"_r{a}{b}") for a, b in pairs]
    rules = [
        (r01 & r12 & r23, "AAAA", 1.0), (r02 & r13, "ABAB", 1.0), (r03 & r12, "ABBA", 1.0),
        (r01 & r23, "AABB", 1.0), (r01 & r03 & ~r02, "AABA", 1.0),
        (r02 & ~r13, "A-A-", 0.75), (~r02 & r13, "-A-A", 0.75), (r12 & ~r01 & ~r23, "-AA-", 0.75),
    ]
    scheme, factor = None, None
    for cond, name, f in rules:
        scheme = F.when(cond, name) if scheme is None else scheme.when(cond, name)
        factor = F.when(cond, f) if factor is None else factor.when(cond, f)
    return df.select("*", scheme.otherwise("----").alias("scheme"), factor.otherwise(0.5).alias("factor")
                     ).drop(*[f"_r{a}{b}" for a, b in pairs])


def rhyme_markup(lines, scheme, n_syl: int = 2, prof: Profile | str = LATIN) -> Column:
    """``<rhymeX>key</rhymeX> line`` per line, X = scheme letter at i mod len;
    lines without tokens are dropped (their position still counts)."""
    L = F.length(scheme)
    tagged = F.transform(lines, lambda l, i: F.when(
        rhyme_key(l, n_syl, prof).isNotNull(),
        F.concat(F.lit("<rhyme"), F.substring(scheme, F.pmod(i, L) + 1, 1), F.lit(">"),
                 rhyme_key(l, n_syl, prof), F.lit("</rhyme"), F.substring(scheme, F.pmod(i, L) + 1, 1),
                 F.lit("> "), l)))
    return F.filter(tagged, lambda x: x.isNotNull())


def rhyme_word_repeat(lines) -> Column:
    """True when two lines end with the same word (ё folded to е)."""
    lw = F.filter(F.transform(lines, lambda l: F.translate(last_word(l), "ё", "е")), lambda x: x.isNotNull())
    return F.size(F.array_distinct(lw)) < F.size(lw)
