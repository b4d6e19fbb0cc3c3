"""Jobs that must not grow faster than their input."""
import time

from pyspark.sql import functions as F

from cadenza.operators import align as A, correct as K


def options(spark):
    return spark.createDataFrame([("banana", "3:1/99,2/100"), ("lemon", "2:1/100")], "word string, options string")


def test_long_line_beside_short_ones():
    """One long line does not pad the lattices that are walked with it."""
    short = [f"2:1/{100 - i % 7} 1:0/70,1/{50 + i % 50}" for i in range(2000)]
    every = [*short, " ".join(["1:0/70,1/100"] * 600)]
    began, ends = time.time(), 0
    for some in A._of_like_size(every, False):
        ends += len(A._readings([every[x] for x in some], False)[0])
    assert ends == 2000 * 2 + 601 and time.time() - began < 60
    assert all(len(some) == 1 or 2000 not in some for some in A._of_like_size(every, True))


def test_equal_lines_with_many_endings(spark):
    """Sixty endings a line: no combination of four of them is made."""
    line = " ".join(["sun light"] * 30)
    d = spark.createDataFrame([(1, 0, [line] * 4), (2, 0, [line] * 2)], "doc_id long, block int, lines array<string>")
    got = {r["doc_id"]: r for r in A.align_scores(d, options(spark), paths=False).collect()}
    assert got[1]["scheme"] == "AAAA" and got[2]["scheme"] == "AA"
    assert abs(got[1]["log_score"] - 2 * got[2]["log_score"]) < 1e-5


def test_paths_are_only_left_out(spark):
    lines = ["the banana of the sun", "lemon and sun", "banana lemon", "of stone and the sun"]
    d = spark.createDataFrame([(1, 0, lines), (2, 0, lines[:2]), (3, 0, lines[:1]), (None, 0, lines), (4, 0, lines), (4, 0, lines[:2])],
                              "doc_id long, block int, lines array<string>")
    o = options(spark)
    for f in (lambda paths: A.align_scores(d, o, paths=paths).drop("paths"), lambda paths: A.best_variant_per_tail(d, o, paths=paths).drop("path")):
        assert sorted(map(repr, f(True).collect())) == sorted(map(repr, f(False).collect()))
    # the reduced endings are those of the full table
    full = A.lattice_variants(A.line_lattices(d, o)).select("lattice", F.explode("variants").alias("v")).select("lattice", "v.*").collect()
    best = {}
    for r in full:
        k = (r["lattice"], r["metre"], r["word"], r["stress"])
        if r["word"] >= 0:
            best[k] = max(best.get(k, (-1e9, 0, "")), (r["score"], -r["prefix"], r["path"]))
    few = A.lattice_endings(A.line_lattices(d, o).withColumn("kind", F.lit(A.ALL_ENDINGS)))
    few = few.select("lattice", F.explode("ends").alias("e")).select("lattice", "e.word", "e.stress", F.posexplode("e.best").alias("metre", "b")).collect()
    assert {(r["lattice"], r["metre"], r["word"], r["stress"]): (r["b"]["score"], -r["b"]["prefix"], r["b"]["path"]) for r in few} == best


def test_flag_lines(spark):
    lines = spark.createDataFrame([(1, 0, "Lemon the  banana, grr sun stone banana"), (1, 1, "..."), (None, 0, "lemon"), (2, 0, "a banana"), (2, 0, "so lemon")],
                                  "doc_id long, line_no int, text string")
    marks = spark.createDataFrame([("lemon", [2]), ("banana", [1, 3]), ("stone", [1]), ("sun", [1])], "word string, stresses array<int>")
    got = {(r["doc_id"], r["line_no"]): (r["words"], r["flags"]) for r in K.flag_lines(lines, marks).collect()}
    assert got == {(1, 0): (["lemon", "the", "banana", "grr", "sun", "stone", "banana"], "01|0|101||0|10|101"), (None, 0): (["lemon"], "01"),
                   (2, 0): (["a", "so", "banana", "lemon"], "0|0|101|01")}


def test_corrections_cut_lines_once(spark):
    """The words are taken out of the lines in one place of the plan; all readers share it."""
    docs = spark.createDataFrame([(1, i, "lemon banana sun") for i in range(9)], "doc_id long, line_no int, text string")
    marks = spark.createDataFrame([("lemon", [2])], "word string, stresses array<int>")
    lines = K.shared(K.flag_lines(docs, marks))
    x = K.improved_stress(lines, K.poem_metre_corrected(lines))
    assert len(x.collect()) == 9
    plan = x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("regexp_extract_all") <= 2, plan.count("regexp_extract_all")
