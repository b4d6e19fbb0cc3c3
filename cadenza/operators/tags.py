"""Operators on tagged words and lexicons: homographs by tags, lemmas and forms, caps, keywords, optional stresses,
schemes of marked texts, suggestions a user has not seen.

Lookups join on the word once per distinct entry: an entry carries all its variants as an array, and the choice
among them is made in the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The cases that ``Case=Every`` stands for.
CASES = ["Nom", "Gen", "Ins", "Acc", "Dat", "Loc"]
# Parts of speech counted by the lemma cap, and how often a lemma may come in a sentence.
CAPPED, CAP = ["PROPN", "NOUN", "VERB", "ADJ", "INTJ", "SYM"], 2
# Parts of speech whose stress is optional (the first list: words of one vowel only).
OPTIONAL_SHORT, OPTIONAL = ["PRON", "ADV", "DET"], ["PUNCT", "ADP", "PART", "SCONJ", "CCONJ", "INTJ"]
OPTIONAL_SHARE, FIRST_SHARE = 0.5, 0.7
# Parts of speech that give keywords, letters of a stem.
KEYWORD, STEM = ["NOUN", "PROPN", "ADJ", "VERB", "ADV"], 4
SUGGESTIONS = 3


def omograph_table(omographs: DataFrame) -> DataFrame:
    """``word, variants`` from ``word, ord, stress, tagsets`` (tags joined by ``|``), in listing order; a tag
    set with ``Case=Every`` becomes one for each case."""
    every = F.transform(F.array(*[F.lit(c) for c in CASES]), lambda c: F.concat(F.lit("Case="), c))
    sets = F.flatten(F.transform("tagsets", lambda t: F.when(F.contains(t, F.lit("Case=Every")), F.transform(
        every, lambda c: F.replace(t, F.lit("Case=Every"), c))).otherwise(F.array(t))))
    x = omographs.select("word", "ord", "stress", F.posexplode(sets).alias("no", "t"))
    item = F.struct("ord", "no", "stress", F.split("t", "\\|").alias("tags"))
    return x.groupBy("word").agg(F.sort_array(F.collect_list(item)).alias("variants"))


def omograph_by_tags(tokens: DataFrame, omographs: DataFrame) -> DataFrame:
    """``tokens`` (``word``, ``tags``) that are homographs, with ``stress``: of the variant whose tag set shares most
    tags, the first listed at ties; NULL if none shares any."""
    t = tokens.join(omograph_table(omographs), "word")
    scored = F.transform("variants", lambda v: F.struct(
        F.size(F.array_intersect(v["tags"], F.col("tags"))).alias("n"), (-v["ord"]).alias("o"), (-v["no"]).alias("k"), v["stress"].alias("stress")))
    best = F.array_max(scored)
    return t.withColumn("stress", F.when(best["n"] > 0, best["stress"])).drop("variants")


def lemma_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``words`` (``word``) with ``lemma`` (the first listed one, else the word) and ``n_forms`` (forms of that lemma and
    part of speech, else one).  ``lexicon``: ``form, lemma, pos, ord``."""
    first = lexicon.groupBy("form").agg(F.min(F.struct("ord", "lemma", "pos")).alias("f"))
    forms = lexicon.groupBy("lemma", "pos").agg(F.countDistinct("form").alias("n_forms"))
    x = words.join(first.withColumnRenamed("form", "word"), "word", "left").select(*words.columns, F.coalesce("f.lemma", "word").alias("lemma"), F.col("f.pos").alias("pos"))
    return x.join(forms, ["lemma", "pos"], "left").select(*words.columns, "lemma", F.coalesce("n_forms", F.lit(1)).alias("n_forms"))


def lexicon_forms(lexicon: DataFrame, entries: DataFrame) -> DataFrame:
    """``form`` of every lexicon row whose ``lemma, pos`` is a thesaurus entry."""
    return lexicon.join(entries.select("lemma", "pos"), ["lemma", "pos"], "left_semi").select("form").distinct()


def lemma_cap(sentences: Column) -> Column:
    """Whether no sentence (array of tagged words) has a content lemma more than ``CAP`` times."""
    def over(s: Column) -> Column:
        lemmas = F.transform(F.filter(s, lambda w: w["upos"].isin(*CAPPED)), lambda w: w["lemma"])
        return F.exists(F.array_distinct(lemmas), lambda l: F.size(F.filter(lemmas, lambda x: x == l)) > CAP)
    return ~F.exists(sentences, over)


def keyword_stems(words: Column) -> Column:
    """Four-letter stems of the content words of a request (tagged words); if there are none, its words of three
    letters and more."""
    stems = F.transform(F.filter(words, lambda w: w["upos"].isin(*KEYWORD)), lambda w: F.substring(w["lemma"], 1, STEM))
    plain = F.transform(F.filter(words, lambda w: F.length(w["word"]) > 2), lambda w: w["word"])
    return F.array_distinct(F.when(F.size(stems) > 0, stems).otherwise(plain))


def keyword_hit(stems: Column, words: Column) -> Column:
    """Whether any word begins with any stem."""
    return F.exists(words, lambda w: F.exists(stems, lambda s: w.startswith(s)))


def optional_stress(word: Column, upos: Column, vowels: Column, stress: Column, second: Column, u: Column, listed: list[str]) -> Column:
    """Stress of a token (0: none).  ``second``: the other stress of a two-way word, else NULL; such words take the first
    one in 70 of 100 cases.  Optional words (function words, one-vowel pronouns, adverbs and determiners, listed ones) are
    stressed every other time.  ``u``: the token's number between 0 and 1."""
    optional = (upos.isin(*OPTIONAL_SHORT) & (vowels == 1)) | upos.isin(*OPTIONAL) | word.isin(*listed)
    return (F.when(vowels == 0, 0).when(second.isNotNull(), F.when(u <= FIRST_SHARE, stress).otherwise(second))
            .when(optional, F.when(u > OPTIONAL_SHARE, stress).otherwise(0)).otherwise(stress))


def strip_template_tags(line: Column) -> Column:
    """A template line without its ``|tag`` suffixes."""
    return F.regexp_replace(line, r"\|[^ ,:;\-!?.—]*", "")


def scheme_from_markup(keys: Column) -> Column:
    """Rhyme scheme of a marked text of two or four lines from its line endings, by the stricter table; '' for other
    lengths."""
    def r(a: int, b: int) -> Column:
        return F.coalesce(F.get(keys, a - 1) == F.get(keys, b - 1), F.lit(False))
    four = (F.when(r(1, 2) & r(2, 3) & r(3, 4), "AAAA").when(r(1, 3) & r(2, 4) & ~r(1, 2) & ~r(3, 4), "ABAB")
            .when(r(1, 2) & ~r(2, 3) & r(3, 4), "AABB").when(r(1, 2) & ~r(2, 3) & r(1, 4), "AABA")
            .when(r(1, 4) & r(2, 3) & ~r(1, 2) & ~r(3, 4), "ABBA").when(~r(1, 2) & r(1, 3) & ~r(3, 4), "A-A-")
            .when(~r(1, 2) & r(2, 4) & ~r(2, 3), "-A-A").otherwise("----"))
    return F.when(F.size(keys) == 2, F.when(r(1, 2), "AA").otherwise("--")).when(F.size(keys) == 4, four).otherwise("")


def unseen_seeds(users: DataFrame, pool: DataFrame, history: DataFrame, sizes: DataFrame, seed: int = 7) -> DataFrame:
    """Up to three suggestions per user that the user has not seen: from the user's domain, then from the common pool.

    ``users``: ``user_id, domain``; ``pool``: ``domain, no`` (gapless from 0), ``seed``; ``history``: ``user_id, seed``
    (distinct); ``sizes``: ``domain, n``.  A user starts at a hashed place of a pool and looks at as many places in a row as
    the history is long, plus three: so many hold three unseen ones if there are three.  No user meets the whole pool."""
    seen = history.groupBy("user_id").agg(F.count("*").alias("k"))
    u = users.join(seen, "user_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    u = u.select("user_id", "k", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("domain").alias("d")),
                                                   F.struct(F.lit(1).alias("rank"), F.lit("common").alias("d")))).alias("p"))
    u = u.select("user_id", "k", F.col("p.rank").alias("rank"), F.col("p.d").alias("domain")).join(F.broadcast(sizes), "domain")    # one row a domain
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("user_id").cast("string"), "domain", F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    u = u.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("k") + SUGGESTIONS, F.col("n")) - 1)))
    u = u.withColumn("no", F.pmod(h + F.col("i"), F.col("n")))
    x = u.join(pool, ["domain", "no"]).join(history, ["user_id", "seed"], "left_anti")
    first = x.groupBy("user_id", "seed").agg(F.min(F.struct("rank", "i")).alias("at"))
    w = Window.partitionBy("user_id").orderBy("at")          # at most twice the history and six rows a user
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= SUGGESTIONS).select("user_id", "place", "seed")


def top_prompts(candidates: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The best ``n`` rewrites of each request (``keys``): ``keys, rank, prompt, value``; ``candidates`` hold ``prompt`` and
    ``value``.  Spark keeps the first n of each group before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.desc("value"), "prompt")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, "rank", "prompt", "value")
