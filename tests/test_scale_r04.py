"""Whole jobs: nothing is left out because it is long or frequent."""
import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as E


def tables(spark, folder, texts):
    """Tables of a few rows in ``folder``."""
    rows = [(i, t, ["en", "de", "fr", "es"][i % 4]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, "banana lemon")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 0, "user", "lemon sunset")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def oracle(folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    rel = con.execute(E.oracle_sql()[name])
    return [d[0] for d in rel.description], rel.fetchall()


def same_as_oracle(spark, folder, name):
    cols, rows = oracle(folder, name)
    got = [tuple(r) for r in E.queries()[name](spark, folder).select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
    return [dict(zip(cols, r)) for r in rows]


def test_long_lines_keep_their_variants(spark, tmp_path):
    """A line of many words of several vowels (500 syllables here) does not drop its poem."""
    long = " ".join(["banana lemon"] * 100) + " sun"
    short = ["the banana of the sun", "lemon and sun", "banana lemon", "a stone"]
    folder = tables(spark, tmp_path / "t", ["\n".join([long, *short[1:]]), "\n".join(short)])
    rows = same_as_oracle(spark, folder, "best_variant_per_tail")
    assert {(r["doc_id"], r["line_no"]) for r in rows} == {(d, i) for d in (0, 1) for i in range(4)}
    assert any(r["n_syl"] == 501 and r["word"] == 199 for r in rows)


def test_words_are_looked_up_where_they_are(spark):
    """Frequent and other words, rows of equal and of null keys, words without a value."""
    from cadenza.operators.lookup import word_values
    rows = [(1, ["a", "b", "a", "z"]), (2, ["c"]), (2, ["a", "b"]), (None, ["b"]), (3, []), (3, None), (4, ["", "b"])]
    d = spark.createDataFrame(rows, "k long, ws array<string>")

    def value(words):
        return words.select("word", "n", F.when(F.col("word") != "", F.concat(F.lit("v"), F.upper("word"))).otherwise("").alias("value"))
    for hot in (0, 1, 2, 100):
        got = {r["k"]: (r["line"], r["vals"]) for r in word_values(d, ["k"], value, hot=hot).collect()}
        assert got == {1: ("a b a z", "vA|vB|vA|vZ"), 2: ("a c b", "vA|vC|vB"), None: ("b", "vB"), 4: (" b", "|vB")}, hot
    # documents of one id are put together by the value where it says so
    x = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "k long, ws array<string>")
    ids = (lambda words: words.select("word", "n", F.when(F.col("word") == "a", "10,2").otherwise("9,7").alias("value")))
    assert word_values(x, ["k"], ids, order=lambda v: F.split(v, ",").cast("array<bigint>")).first()["vals"] == "9,7|10,2"


def _moved(df) -> str:
    """The plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_words_of_texts_stay_with_their_text(spark, tmp_path):
    """No row per word and position is made for the lookup of units and stresses."""
    folder = tables(spark, tmp_path / "t", ["banana lemon sun\nthe sun of stone", "lemon banana stone", "sun"])
    same_as_oracle(spark, folder, "token_blocks")
    same_as_oracle(spark, folder, "improved_stress")
    plan = _moved(E.queries()["token_blocks"](spark, folder))
    assert "MapInArrow" in plan and "posexplode(ws" not in plan


def test_corrections_are_counted(spark):
    from cadenza.operators import correct as K
    flags = ["01|0|101||0|10|101", "10|010|1|0", "", "0", "001|100|010", "1111|0000|0100"]
    places = ["usususususususus", "SUSUSUSUSUSUSUSU", "uuSuuSuuSuuSuuS", ""]
    d = spark.createDataFrame([(f, t) for f in flags for t in places], "flags string, template string")
    x = d.select("*", F.size(F.filter(K.fixes(F.col("flags"), F.col("template")), lambda y: y["kind"] == "correction")).alias("a"),
                 K.n_corrections(K.single_stresses(F.col("flags")), F.col("template")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in x) and sum(r["a"] for r in x) > 10


def test_stanzas_are_tagged_once(spark, tmp_path):
    """The rank's readers of the stanzas share one run of what tags them."""
    lines = "banana the lemon\nsun of the stone\nthe lemon banana\na stone of sun"
    folder = tables(spark, tmp_path / "t", [lines, lines.upper(), "\n".join(reversed(lines.split("\n")))])
    same_as_oracle(spark, folder, "candidate_rank_score")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        assert _moved(E.queries()["candidate_rank_score"](spark, folder)).count("CCONJ") == 1
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_contrasts_are_not_multiplied_out(spark):
    """Pairs come from buckets of members, each once, and only those that are asked for where some are."""
    from cadenza.operators import thesaurus as X
    opposites = spark.createDataFrame([("a", "ina"), ("b", "inb"), ("a", "ina"), ("ina", "x"), ("c", "c")], "word string, other string")
    groups = {"a": ["a", "b", "c"], "b": ["b", "a"], "ina": ["ina", "inb", "c"], "inb": ["inb", "ina"], "x": [], "c": ["q"]}
    g = spark.createDataFrame([(w, m, 1) for w, ms in groups.items() for m in ms], "word string, member string, hops int")
    whole = {w: {w, *ms} for w, ms in groups.items()}
    want = set()
    for l, r in {("a", "ina"), ("b", "inb"), ("ina", "x"), ("c", "c")}:
        for x in whole[l]:
            for y in whole[r] - whole[l]:
                want |= {(x, y), (y, x)}
    df = X.contrast_pairs(opposites, g)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "HashAggregate" not in plan
    asked = spark.createDataFrame([("a", "ina"), ("ina", "b"), ("b", "a"), ("no", "a"), (None, "a"), ("a", "ina")], "word string, other string")
    some = [tuple(r) for r in X.contrast_pairs(opposites, g, asked).collect()]
    assert len(some) == len(set(some)) and set(some) == want & {("a", "ina"), ("ina", "b"), ("b", "a")}


def test_pairs_of_buckets_in_pieces(monkeypatch):
    """A few pairs at a time give the same as all at once."""
    import pyarrow as pa
    from cadenza.operators import thesaurus as X
    t = pa.table({"member": list("abcdef"), "l": ["p", "p\u001fq", "", "q", "", "r"], "r": ["", "", "p", "p", "q\u001fr", ""]})
    run = (lambda: sorted((x, y) for b in X._cell_pairs(t, t, False) for x, y in zip(*(c.to_pylist() for c in b.columns))))
    every = run()
    monkeypatch.setattr(X, "PAIRS", 2)
    one = [(x, y) for x, y in [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("b", "e"), ("d", "e"), ("f", "e")]]
    assert run() == every == sorted(one + [(y, x) for x, y in one])


def test_groups_and_neighbours(spark):
    """Members of three hops once, with the least number of hops; neighbours of a list in itself as of two."""
    from cadenza.operators import lexicon as L
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("z", "z")], "word string, other string")
    seeds = spark.createDataFrame([("a",), ("e",), ("z",), ("n",)], "word string")
    got = sorted(tuple(r) for r in L.ego_groups(seeds, edges, 3).collect())
    assert got == sorted([("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("e", "e", 0), ("e", "d", 1), ("e", "c", 2),
                          ("e", "a", 3), ("e", "b", 3), ("z", "z", 0), ("n", "n", 0)])
    w = spark.createDataFrame([("ab",), ("ba",), ("abc",), ("b",), ("xyz",), (None,), ("",), ("ab",)], "word string")
    again = w.select("word")
    assert sorted(map(repr, L.edit_neighbours(w, w).collect())) == sorted(map(repr, L.edit_neighbours(w, again).collect()))
