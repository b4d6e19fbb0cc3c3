"""Dataset curation: prose/verse pairs, similarity gates, repairs, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import text as T

# Words allowed in an "X и X" repeat (three-line check).
REPEAT_OK = ["еще", "ещё", "снова", "вновь", "сильнее"]


def request_output_pairs(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, input, output, new_input): a user turn, the assistant
    turn right after it, and the next user turn (the candidate rewrite).

    ``lead`` over (conv_id ORDER BY turn): one shuffle on conv_id, linear."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = conv.select(
        "conv_id", "turn", "role", "text",
        F.lead("role", 1).over(w).alias("r1"), F.lead("text", 1).over(w).alias("t1"),
        F.lead("role", 2).over(w).alias("r2"), F.lead("text", 2).over(w).alias("t2"))
    return x.where((F.col("role") == "user") & (F.col("r1") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("input"), F.col("t1").alias("output"),
        F.when(F.col("r2") == "user", F.col("t2")).alias("new_input"))


def word_jaccard(a, b) -> Column:
    """|A∩B| / |A∪B| over lower-case whitespace words; NULL when both empty."""
    sa, sb = T.word_set(a), T.word_set(b)
    union = F.size(F.array_union(sa, sb))
    return F.when(union > 0, F.size(F.array_intersect(sa, sb)) / union)


def shingle_jaccard(a, b, n: int = 3) -> Column:
    """Character n-gram Jaccard, lower-cased, denominator + 1e-6."""
    sa, sb = T.shingles(a, n), T.shingles(b, n)
    return F.size(F.array_intersect(sa, sb)) / (F.size(F.array_union(sa, sb)) + F.lit(1e-6))


def flag_bad_pairs(pairs: DataFrame, jaccard_max: float = 0.7, len_gap_max: int = 250) -> DataFrame:
    """Pairs whose prose is too close to the verse: word-Jaccard above
    ``jaccard_max``, length gap above ``len_gap_max``, or one of the first four
    verse lines found verbatim (case-insensitive) in the prose."""
    verse_lines = T.filter_lines("output")
    verse = F.array_join(verse_lines, "\n")
    inp = T.clean_text("input")
    return (pairs.select(
        "conv_id", "turn",
        word_jaccard(inp, verse).alias("jac"),
        F.length(verse).alias("len_verse"), F.length(inp).alias("len_input"),
        F.exists(verse_lines, lambda l: F.lower(inp).contains(F.lower(l))).alias("copied"),
        F.size(verse_lines).alias("n_lines"))
        .withColumn("bad", (F.coalesce(F.col("jac"), F.lit(0.0)) > jaccard_max)
                    | (F.abs(F.col("len_verse") - F.col("len_input")) > len_gap_max)
                    | F.col("copied")))


def conditional_update(pairs: DataFrame, jaccard_max: float = 0.7, len_gap_max: int = 250) -> DataFrame:
    """Replace ``input`` of a flagged pair (the rule of :func:`flag_bad_pairs`) by
    ``new_input`` when that lowers the word-Jaccard with the verse or narrows the
    length gap; other pairs keep theirs.  One pass: the flag is computed in the row."""
    lines = T.filter_lines("output")
    verse = F.array_join(lines, "\n")
    inp, new = T.clean_text("input"), T.clean_text("new_input")
    gap = F.abs(F.length(verse) - F.length(inp))
    bad = ((F.coalesce(word_jaccard(inp, verse), F.lit(0.0)) > jaccard_max) | (gap > len_gap_max)
           | F.exists(lines, lambda l: F.lower(inp).contains(F.lower(l))))
    better = ((word_jaccard(inp, verse) > word_jaccard(new, verse))
              | (gap > F.abs(F.length(verse) - F.length(new))))
    update = F.coalesce(F.col("new_input").isNotNull() & bad & better, F.lit(False))
    return pairs.select("conv_id", "turn", F.when(update, new).otherwise(inp).alias("input"), update.alias("updated"))


def three_line_ok(text) -> Column:
    """Exactly three lines, no two equal after trailing punctuation strip and
    ё→е, no ``X и X`` repeat (exception list), no adjacent equal tokens."""
    lines = F.transform(F.split(T._c(text), "\n"),
                        lambda x: F.translate(T.strip_trailing_punct(F.trim(x)), "ё", "е"))
    toks = lambda l: F.split(l, r"[.?,!:;…\-\s]")
    ok_words = F.array(*[F.lit(w) for w in REPEAT_OK])

    def line_bad(l):
        t = toks(l)
        n = F.size(t)

        def at(i):  # 1-based, NULL when out of range
            return F.get(t, i - 1)

        x_and_x = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                           lambda i: F.coalesce((at(i) == at(i + 2)) & (at(i + 1) == F.lit("и"))
                                                & ~F.array_contains(ok_words, at(i)), F.lit(False)))
        adjacent = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                            lambda i: F.coalesce(at(i) == at(i + 1), F.lit(False)))
        return x_and_x | adjacent

    l0, l1, l2 = F.element_at(lines, 1), F.element_at(lines, 2), F.element_at(lines, 3)
    return F.when(F.size(lines) != 3, F.lit(False)).otherwise(
        ~((l0 == l1) | (l1 == l2) | (l0 == l2) | F.exists(lines, line_bad)))


def sentence_chunks(docs: DataFrame, min_len: int = 100, max_len: int = 140,
                    key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-blank paragraphs (lines) -> sentences -> keep min_len..max_len chars.

    Sentences end at ``[.?!;]`` + spaces before a capital, unless the three
    characters before the mark contain a capital in first or third place."""
    paras = docs.select(key, F.posexplode(F.split(T._c(text_col), "\n")).alias("para_no", "para"))
    paras = paras.where(F.trim("para") != "")
    sents = paras.select(key, "para_no", F.posexplode(
        F.split(F.trim("para"), r"(?<=[^\p{Lu}].[^\p{Lu}][.?!;]) +(?=\p{Lu})")).alias("sent_no", "s"))
    s = F.trim("s")
    return sents.select(key, "para_no", "sent_no", s.alias("chunk")).where(
        (F.length("chunk") >= min_len) & (F.length("chunk") <= max_len))
