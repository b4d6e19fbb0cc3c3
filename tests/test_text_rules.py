"""Hand-written rows (FIXTURES.md §3) and properties of the text operators."""
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import curate, rhyme, stress


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_syllables_profiles(spark):
    got = one(spark, T.syllables("w", "ru"), [("майка",), ("банька",), ("солнце",), ("в",)], "w string")
    assert [list(x) for x in got] == [["май", "ка"], ["бань", "ка"], ["со", "лнце"], ["в"]]
    got = one(spark, T.syllables("w", "latin"), [("tables",), ("strength",)], "w string")
    assert [list(x) for x in got] == [["ta", "bles"], ["strength"]]


def test_similarity_rows(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("a b c", "b c d"), ("ab", "ab")], "a string, b string")
    r = df.select(curate.shingle_jaccard("a", "b").alias("sj"), curate.word_jaccard("a", "b").alias("wj")).collect()
    assert r[0].sj == pytest.approx(1 / (3 + 1e-6))
    assert r[1].wj == pytest.approx(2 / 4)
    assert r[2].sj == 0.0


def test_jaccard_symmetric_bounded(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    pairs = curate.request_output_pairs(conv).select(F.col("input").alias("a"), F.col("output").alias("b"))
    r = pairs.select(curate.word_jaccard("a", "b").alias("ab"), curate.word_jaccard("b", "a").alias("ba"),
                     curate.shingle_jaccard("a", "b").alias("s1"), curate.shingle_jaccard("b", "a").alias("s2")).collect()
    for x in r:
        assert x.ab == x.ba and 0 <= x.ab <= 1
        assert x.s1 == x.s2 and 0 <= x.s1 <= 1


def test_quatrain_scan(spark):
    def run(groups):
        rows = [(1, i, f"l{i}", None if g is None else str(g)) for i, g in enumerate(groups)]
        df = spark.createDataFrame(rows, "doc_id long, line_no int, text string, clausula string")
        return sorted((r.start, r.scheme) for r in rhyme.quatrains(df).collect())
    assert run([1, 1, 2, 2, 3, 4, 3, 4]) == [(0, "AABB"), (4, "ABAB")]
    assert run([1, None, 1, 2, 1, 2]) == [(2, "ABAB")]


def test_quatrains_never_overlap(spark):
    from cadenza.operators import corpus
    lines = corpus.lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    q = rhyme.quatrains(rhyme.line_endings(lines)).collect()
    by_doc = {}
    for r in q:
        by_doc.setdefault(r.doc_id, []).append(r.start)
    for starts in by_doc.values():
        starts.sort()
        assert all(b - a >= 4 for a, b in zip(starts, starts[1:]))


def test_rhyme_score_rows(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"], "ABAB"), (["a", "a", "c", "d"], "ABAB")],
                               "keys array<string>, scheme string")
    r = [x[0] for x in df.select(rhyme.scheme_rhyme_score(F.col("keys"), F.col("scheme"))).collect()]
    assert r == [1.0, 0.0]


def test_three_line_check(spark):
    got = one(spark, curate.three_line_ok("t"), [("a\nb\na.",), ("x and\ny\nz",), ("one\ntwo",)], "t string")
    assert got == [False, True, False]


def test_strip_markup(spark):
    got = one(spark, T.strip_markup("t"), [("<rhymeA>ana</rhymeA> <S1><count2>word",)], "t string")
    assert got == [" word"]


def test_encode_decode_identity(spark):
    from cadenza.operators import corpus
    lines = corpus.lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    r = lines.select(F.array_join(T.words("text"), " ").alias("w"),
                     stress.syllable_decode(stress.syllable_encode("text")).alias("d"))
    assert r.where(F.col("w") != F.col("d")).count() == 0


def test_metre_errors_bounded_by_syllables(spark):
    from cadenza.operators import corpus, metre
    lines = corpus.lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    lp = metre.line_patterns(lines)
    e = metre.pattern_metre_errors(lp)
    bad = e.where((F.length("pattern") <= 20) & (F.col("strong") + F.col("weak") > F.length("pattern")))
    assert bad.count() == 0
