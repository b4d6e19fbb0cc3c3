"""Steps of the line queries are evaluated once: plans cut, tag and mark a text in one place, and results stay."""

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import align as A
from cadenza.operators import corpus, defects as D, phonetics as P, rhyme, stress
from cadenza.plans import q_defects as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")


STANZA = "the sun is reading\nin the banana of of it\nen la maison reading, reading\nlemon banana and banana"


def corpus_dir(spark, tmp_path, *texts):
    docs(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "so reading\nnow leading")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_lines_are_cut_once(spark):                                       # F11, F19 to F24
    d = docs(spark, STANZA, None, "", "a\n\n7. b; c")
    assert plan(corpus.lines(d)).count("regexp_replace(text") == 1
    assert plan(A.blocks(d)).count("regexp_replace(text") == 1
    assert [r["text"] for r in corpus.lines(d).where("doc_id = 4").orderBy("line_no").collect()] == ["a", "b;", "c"]
    assert {(r["doc_id"], r["block"], len(r["lines"])) for r in A.blocks(d).collect()} == {(1, 0, 4), (4, 0, 2), (4, 1, 1)}


def test_stanza_is_made_once(spark, tmp_path):                            # F7, F9, F10, F17
    d = corpus_dir(spark, tmp_path, STANZA, "so reading\nnow leading\nno reading\nbut leading", "only one line")
    poor = Q.q_poor_rhyme(spark, d)
    assert plan(poor).count("regexp_replace(text") == 2                   # documents and the listed rhymes
    assert {(r["doc_id"], r["repeated"], r["verbs"], r["grouped"]) for r in poor.collect()} == {(1, True, True, False), (2, True, True, False)}
    for q in (Q.q_repetition_flags, Q.q_line_penalties, Q.q_syllable_defects):
        p = plan(q(spark, d))
        assert p.count("regexp_replace(text") == 1 and p.count("regexp_extract_all(lower(") == 1, q


def test_poor_rhyme_rows(spark):                                          # F7: repeated and null keys as before
    e = lambda *ws: [(w, "VERB") for w in ws]
    rows = [(1, 0, e("reading", "leading", "x", "y"), "AABB"), (1, 0, e("a", "b", "c", "d"), "AABB"), (None, 0, e("reading", "leading", "x", "y"), "AABB"),
            (2, 0, e("seeing", "being", "x", "y"), "AABB"), (3, 0, e("a", "b", "c", "d"), None)]
    s = spark.createDataFrame(rows, "doc_id long, block int, ends array<struct<word:string,upos:string>>, scheme string")
    listed = spark.createDataFrame([("seeing", "being"), ("seeing", "being")], "word_a string, word_b string")
    got = sorted((r["doc_id"] or 0, r["verbs"], r["poor"]) for r in D.poor_rhyme(s, listed, h=D.LATIN).collect())
    assert got == [(0, False, False), (1, True, True), (1, True, True), (2, False, False), (3, False, False)]


def test_tags(spark):                                                     # F22, F23, F26
    words = ["of", "reading", "mens", "ens", "houses", "une", "en", "n", "grr", "élan", "y", "and", "vraiment", "cantando", "s"]
    x = spark.createDataFrame([(words,)], "ws array<string>")
    got = x.select(F.explode(Q.tagged_words(F.col("ws"))).alias("t")).select("t.*").collect()
    one = x.select(F.explode("ws").alias("w")).select(
        F.regexp_replace("w", Q.LEMMA_RX, "").alias("lemma"), F.col("w").rlike(Q.VERB_RX).alias("verb"), F.col("w").rlike(Q.CONVERB_RX).alias("converb"),
        F.length(F.regexp_replace(F.lower("w"), "[^aeiouyàâäáéèêëîïíôöóûùüúœæ]", "")).alias("n")).collect()
    assert [r["word"] for r in got] == words
    assert [(r["lemma"], r["converb"], r["vowels"]) for r in got] == [(r["lemma"], r["converb"], r["n"]) for r in one]
    assert [r["upos"] for r in got] == ["ADP", "VERB", "NOUN", "NOUN", "NOUN", "NOUN", "ADP", "NOUN", "NOUN", "NOUN", "CCONJ", "CCONJ", "ADV", "NOUN", "NOUN"]
    assert [r["stress"] for r in got] == [0, 2, 1, 1, 2, 1, 0, 0, 0, 1, 0, 0, 2, 2, 0]
    # Spark evaluates lambdas as they stand: the vowels are counted in one place of the expression
    assert plan(x.select(Q.tagged_words(F.col("ws")))).count("translate(") <= 2


def test_marks_once(spark):                                               # F19, F20, F21
    x = spark.createDataFrame([("the banana grr elan y",), ("",), (None,)], "t string")
    line = stress.render_line(F.col("t"))
    assert [r[0] for r in x.select(line).collect()] == ["thé banána grr élan ý", "", None]
    assert plan(x.select(line)).count("regexp_extract_all(") <= 4         # words and their segments (a lambda is printed with its arguments)
    m = spark.createDataFrame([("bánàná grr so-ló",)], "t string").select(stress.stress_markup(F.col("t"))).collect()[0][0]
    assert m == "<S1><S3><s2><count3> banana grr <count1> so - <S1><count1> lo"


def test_line_ends(spark):                                                # F11, F24
    x = spark.createDataFrame([(["So it goes, 7...", "grr", "ÉLAN\n!", "12", "a-b", ""],)], "ls array<string>")
    ends, keys, old = x.select(rhyme.line_ends(F.col("ls")), rhyme.line_keys(F.col("ls")), F.transform("ls", lambda l: rhyme.clausula(rhyme.last_word(l)))).collect()[0]
    assert ends == ["goes", "grr", "élan", "", "b", ""] and keys == old


def test_words_are_dealt_out(spark):                                      # F12, F16
    words = ["banana", "banani", "lemon", "lemons", "sona", "sonu", "sona", "x", "tan", "tann", "tan", "ban"]
    lines = spark.createDataFrame([(1, i // 4, i % 4, w, 1, str(i)) for i, w in enumerate(words)],
                                  "doc_id long, block int, line_no int, word string, stress int, exact string")
    x = P.rhyme_pairs(lines, p=P.LATIN)
    assert "REPARTITION_BY_NUM" in plan(x)
    assert x.count() == P.rhyme_pairs(lines, p=P.LATIN, listed=spark.createDataFrame([], "word_a string, word_b string")).count() > 0


def test_cyclic_phases(spark):                                            # F14
    import itertools
    import math
    sigs = ["".join(s) for n in range(1, 8) for s in itertools.product("01", repeat=n)]
    x = spark.createDataFrame([(s,) for s in sigs], "sig string")
    feet = ["10", "01", "100", "010", "001"]
    got = {r["sig"]: r for r in x.select("sig", *[A.cyclic_line_score(F.col("sig"), f).alias(f) for f in feet]).collect()}
    for s in sigs:
        for f in feet:
            def fit(shift, s=s, f=f):
                want = ["0" if k < shift else f[(k - shift) % len(f)] for k in range(len(s))]
                return sum(math.log10(0.1) if (w, c) == ("0", "1") else math.log10(0.9) if (w, c) == ("1", "0") else 0 for w, c in zip(want, s))
            best = max(fit(0), fit(1)) if f[0] == "1" and s[0] == "0" else fit(0)
            assert abs(got[s][f] - best) < 1e-9, (s, f)
