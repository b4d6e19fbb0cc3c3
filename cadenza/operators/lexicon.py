"""Lexicons: stress dictionary merge and lookup, vocabulary, word graphs.

Dictionaries here grow with the corpus, so joins against them are shuffle
joins on the word (distinct words first, then joined back), never unchecked
broadcasts.  Hot words are split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators.corpus import settled
from cadenza.operators.sampling import global_row_number
from cadenza.profiles import LATIN, Profile

# Special units of the syllable vocabulary, ids 0..5.
SPECIAL_UNITS = ["<pad>", "<s>", "</s>", "<unk>", "<mask>", "<nl>"]


def merge_stress_sources(sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """sources(word, stress, priority): the smallest priority wins (earlier
    source).  overrides(word, stress, priority) always win over sources; among
    overrides the smallest priority wins, ties to the smaller stress."""
    o = overrides.select("word", "stress", F.lit(0).alias("tier"), "priority")
    s = sources.select("word", "stress", F.lit(1).alias("tier"), "priority")
    u = o.unionByName(s)
    best = F.min(F.struct("tier", "priority", "stress"))
    return u.groupBy("word").agg(best.alias("b")).select(
        "word", F.col("b.stress").alias("stress"),
        F.when(F.col("b.tier") == 0, F.lit("override")).otherwise(
            F.concat(F.lit("source"), F.col("b.priority").cast("string"))).alias("origin"))


def stress_conflicts(overrides: DataFrame) -> DataFrame:
    """Override words listed with more than one stress."""
    return overrides.groupBy("word").agg(
        F.countDistinct("stress").alias("n_stresses"),
        F.array_join(F.array_sort(F.collect_set(F.col("stress").cast("string"))), ",").alias("stresses")
    ).where(F.col("n_stresses") > 1)


HOT_WORDS = 1_000


def _resolved(words: DataFrame, dictionary: DataFrame, prof: Profile | str) -> DataFrame:
    r = words.join(dictionary, "word", "left").select("word", T.vowel_count("word", prof).alias("n_vowels"), "stress", "origin")
    some = F.col("n_vowels") > 0
    return r.select("word", F.when(some, F.coalesce("stress", T.default_stress("n_vowels"))).cast("int").alias("stress"),
                    F.when(some, F.coalesce("origin", F.lit("default"))).alias("origin"))


def stress_lookup(words: DataFrame, dictionary: DataFrame, prof: Profile | str = LATIN) -> DataFrame:
    """Stress of every token: dictionary hit, else the default rule; words
    without vowels get NULL.  Distinct words are resolved once and joined back.

    The ``HOT_WORDS`` most frequent words (a fixed number) are broadcast and their
    tokens spread over keys that match nothing; no other word can hold more than one
    token in ``HOT_WORDS``, so the shuffle join has no hot key."""
    n = words.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    top = n.orderBy(F.desc("_n"), "word").limit(HOT_WORDS).select("word")
    hot = _resolved(top, dictionary, prof).select("word", F.lit(True).alias("_hot"), F.col("stress").alias("_hs"), F.col("origin").alias("_ho"))
    tokens = words.drop("stress", "origin")
    t = tokens.join(F.broadcast(hot), "word", "left")
    idle = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*tokens.columns), F.lit(4096)).cast("string"))
    t = t.withColumn("_key", F.when(F.col("_hot"), idle).otherwise(F.col("word")))
    cold = _resolved(n.select("word"), dictionary, prof).withColumnRenamed("word", "_key")
    return t.join(cold, "_key", "left").select(
        *tokens.columns, F.when(F.col("_hot"), F.col("_hs")).otherwise(F.col("stress")).alias("stress"),
        F.when(F.col("_hot"), F.col("_ho")).otherwise(F.col("origin")).alias("origin"))


def deletion_variants(word_col: str = "word", max_dist: int = 1) -> F.Column:
    """The word and every string with up to ``max_dist`` characters deleted."""
    def cuts(w: F.Column) -> F.Column:
        dels = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
                           lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.lit(1 << 30))))
        return F.concat(F.array(w), dels)
    out = F.array(F.col(word_col))
    for _ in range(max_dist):
        out = F.array_distinct(F.flatten(F.transform(out, cuts)))
    return out


def edit_neighbours(left: DataFrame, right: DataFrame, max_dist: int = 1) -> DataFrame:
    """(word, other, dist) for Levenshtein distance <= ``max_dist``: two words within
    d edits share a variant with at most d deletions each, so an equi-join on variants
    finds every candidate exactly (no length-bucket all-pairs); candidates are verified
    with ``levenshtein(a, b, d)``."""
    lv = left.select("word", F.explode(deletion_variants("word", max_dist)).alias("v"))
    if left is right:       # one shuffle of the variants: those of more than one word have them all in a row
        both = lv.where("v IS NOT NULL").repartition("v").groupBy("v").agg(F.collect_set("word").alias("ws"))
        one = F.size("ws") == 1
        cand = both.select(F.explode("ws").alias("word"), F.when(one, F.array().cast("array<string>")).otherwise(F.col("ws")).alias("ws"))
        own = left.where("word IS NOT NULL").select("word", F.col("word").alias("other"))
        cand = cand.select("word", F.explode("ws").alias("other")).unionByName(own).distinct()
    else:
        rv = right.select(F.col("word").alias("other"), F.explode(deletion_variants("word", max_dist)).alias("v"))
        cand = lv.join(rv, "v").select("word", "other").distinct()
    d = F.levenshtein("word", "other", max_dist)
    return cand.select("word", "other", d.alias("dist")).where((F.col("dist") >= 0) & (F.col("dist") <= max_dist))


def nearest_words(queries: DataFrame, vocab: DataFrame, n: int = 5, max_dist: int = 1) -> DataFrame:
    """Vocabulary words within ``max_dist`` edits of each query word, best ``n``
    by ``1 - d / len(query)`` (ties by word)."""
    nb = edit_neighbours(queries, vocab, max_dist)
    nb = nb.withColumn("score", F.round(1 - F.col("dist") / F.length("word"), 6))
    w = Window.partitionBy("word").orderBy(F.col("score").desc(), F.col("other"))
    return nb.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


SEEDS_APART = "\u001f"       # between the seeds of a member


def ego_groups(seeds: DataFrame, edges: DataFrame, radius: int = 3) -> DataFrame:
    """(word, member, hops): nodes within ``radius`` undirected hops of each
    seed (the seed itself at 0).  A member has the seeds that reach it in one row, as a sorted string; a hop sends it to
    the member's neighbours, which keep what is new to them.  The edge list and each hop's frontier are checkpointed once
    (reliable ``checkpoint``); the visited pairs are the union of those frontiers and are never written again."""
    from cadenza.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(seeds.sparkSession)
    und = edges.select(F.col("word").alias("a"), F.col("other").alias("b")).unionByName(
        edges.select(F.col("other").alias("a"), F.col("word").alias("b"))).distinct().checkpoint()

    def seeds_of(texts: str) -> F.Column:
        return F.flatten(F.transform(texts, lambda x: F.split(x, SEEDS_APART)))
    reached = seeds.select("word", F.col("word").alias("member"), F.lit(0).alias("hops"))
    frontier = seeds.select(F.col("word").alias("member"), F.col("word").alias("seeds")).where("word IS NOT NULL").distinct()
    known = frontier.select("member", F.col("seeds").alias("old"))
    for h in range(1, radius + 1):
        step = frontier.join(und, frontier["member"] == und["a"]).select(F.col("b").alias("member"), F.col("seeds").alias("new"))
        g = step.unionByName(known, allowMissingColumns=True).repartition("member").groupBy("member").agg(
            F.collect_list("new").alias("new"), F.collect_list("old").alias("old")).where(F.size("new") > 0)
        g = g.select("member", F.array_except(seeds_of("new"), seeds_of("old")).alias("new")).where(F.size("new") > 0)
        frontier = g.select("member", F.array_join(F.array_sort("new"), SEEDS_APART).alias("seeds")).checkpoint()
        known = known.unionByName(frontier.select("member", F.col("seeds").alias("old")))
        reached = reached.unionByName(frontier.select(F.explode(F.split("seeds", SEEDS_APART)).alias("word"), "member", F.lit(h).alias("hops")))
    return reached


def vocab_build(poem_units: DataFrame, prose_units: DataFrame) -> DataFrame:
    """Unit vocabulary: the special units with ids 0..5, then every distinct
    poem unit and ``##c`` for each character of prose units missing from it,
    numbered in unit order from 6."""
    specials = set(SPECIAL_UNITS)
    pu = poem_units.select(F.col("unit")).distinct().where(~F.col("unit").isin(*specials))
    extra = prose_units.select("unit").distinct().join(pu, "unit", "left_anti")
    chars = extra.select(F.explode(F.split("unit", "")).alias("c")).where(F.col("c") != "") \
                 .select(F.concat(F.lit("##"), F.col("c")).alias("unit"))
    units = pu.unionByName(chars).distinct().where(~F.col("unit").isin(*specials))
    numbered = global_row_number(units, [F.col("unit")], [F.substring("unit", 1, 2)]).select(
        "unit", (F.col("rn") + len(SPECIAL_UNITS) - 1).alias("id"))
    spark = poem_units.sparkSession
    sp = spark.createDataFrame([(u, i) for i, u in enumerate(SPECIAL_UNITS)], "unit string, id long")
    return sp.unionByName(numbered)


def word_units(words: DataFrame, vocab: DataFrame, prof: Profile | str = LATIN) -> DataFrame:
    """``word, ids``: the unit ids of each distinct word, in order.  Units meet the vocabulary once per word and
    not once per token; words with a unit that it lacks get the ids of the others."""
    u = settled(words.select("word", T.syllables("word", prof).alias("us"))).select("word", F.posexplode("us").alias("i", "unit")).join(vocab, "unit")
    g = u.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("i", "id"))).alias("s"))
    return g.select("word", F.col("s.id").alias("ids"))
