"""Row numbers with a payload, streams over several files, whole verses, novelty over a large index."""
import os

import pytest
from pyspark.sql import functions as F

from cadenza.operators import corpus, curate, lexicon, metre, rhyme, sampling, similarity
from cadenza.streaming import streams

SF = "/root/testdata/sf0.01"


def test_row_number_keeps_payload(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    lines = corpus.lines(d)                                   # the verse text is the payload
    n = lines.count()
    r = sampling.shuffle_rows(lines, ["doc_id", "line_no"])
    s = r.agg(F.count("*").alias("n"), F.countDistinct("new_index").alias("d"), F.min("new_index").alias("lo"),
              F.max("new_index").alias("hi"), F.countDistinct("doc_id", "line_no").alias("k")).collect()[0]
    assert (s["n"], s["d"], s["lo"], s["hi"], s["k"]) == (n, n, 0, n - 1, n)
    assert r.join(lines, ["doc_id", "line_no", "text"]).count() == n
    plan = r._jdf.queryExecution().toString()
    assert "SPARK_PARTITION_ID" not in plan and "monotonically" not in plan


def test_row_number_order_and_ties(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, len int")
    r = sampling.global_row_number(df, [F.col("len"), F.col("id")], [F.col("len")], total="t").collect()
    want = {i: k + 1 for k, (_, i) in enumerate(sorted((i % 3, i) for i in range(100)))}
    assert {x["id"]: x["rn"] for x in r} == want and {x["t"] for x in r} == {100}


@pytest.fixture()
def unordered(spark, tmp_path):
    """Both tables as directories of four files, dealt by key and not by time."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartition(4, "user_id").write.parquet(f"{tmp_path}/events.parquet")
    cv = spark.read.parquet(f"{SF}/conversations.parquet")
    cv.repartition(4, "conv_id").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stream_usage_equals_batch_and_resumes(spark, unordered):
    from cadenza.operators.usage import daily_usage
    path = f"{unordered}/events.parquet"
    batch = rows(daily_usage(spark.read.parquet(path)))
    assert rows(streams.stream_usage(spark, path, max_files=1)) == batch
    base = streams._workdir(spark, "usage", path)
    root = base.removeprefix("file:")
    assert len([x for x in os.listdir(f"{root}/parts") if x.startswith("batch_id=")]) >= 4
    seen = sorted(os.listdir(f"{root}/checkpoint/commits"))
    assert rows(streams.stream_usage(spark, path, max_files=1)) == batch      # nothing read twice
    assert sorted(os.listdir(f"{root}/checkpoint/commits")) == seen
    more = spark.read.parquet(path).limit(7).withColumn("user_id", F.lit(10**9).cast("long"))
    more.coalesce(1).write.mode("append").parquet(path)                       # a later file is added
    assert rows(streams.stream_usage(spark, path, max_files=1)) == rows(daily_usage(spark.read.parquet(path)))


def test_stream_metrics_and_gate_equal_batch(spark, unordered):
    path = f"{unordered}/conversations.parquet"
    from cadenza.operators.scores import batch_metrics
    cv = spark.read.parquet(path).where("role = 'assistant'")
    schemes = F.array(F.lit("AABB"), F.lit("ABAB"), F.lit("ABBA"))
    outs = cv.select(F.col("text").alias("output"), F.element_at(schemes, (F.pmod("conv_id", F.lit(3)) + 1).cast("int")).alias("rhyme_scheme"))
    assert rows(streams.stream_batch_metrics(spark, path, max_files=1)) == rows(batch_metrics(outs))
    index = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = similarity.novelty_score(cv.select(F.struct("conv_id", "turn").alias("doc_id"), "text"), index)
    got = streams.stream_novelty_gate(spark, path, index, max_files=1)
    assert rows(got) == rows(want.select("doc_id.conv_id", "doc_id.turn", "novelty", "passes"))


def test_novelty_over_more_than_a_hundred_texts(spark):
    """The nearest text by Jaccard need not be among those sharing most trigrams."""
    docs = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    noise = "abcdefgh" + " qrstuvwx" * 30
    index = spark.createDataFrame([(i, f"{noise} {i}") for i in range(150)] + [(999, "abcdefg")], "item_id long, text string")
    got = similarity.novelty_score(docs, index).collect()[0]["novelty"]
    assert abs(got - 5 / (6 + 1e-6)) < 1e-5
    assert similarity.novelty_score(docs, index, 100).collect()[0]["novelty"] < got


def test_rhyme_groups_reach_any_distance(spark):
    d = spark.createDataFrame([(1, "\n".join(["la casa", "il mondo", "x y z", "una cosa", "bella rasa", "tondo"]))], "doc_id long, text string")
    g = {r["line_no"]: r["rhyme_group"] for r in rhyme.rhyme_groups(d).collect()}
    assert g[0] == g[4] and g[1] == g[5] and g[0] != g[1]
    p = {(r["line_a"], r["line_b"]) for r in rhyme.exact_rhyme_pairs(d).collect()}
    assert {(0, 4), (1, 5)} <= p
    assert not {(0, 4)} & {(r["line_a"], r["line_b"]) for r in rhyme.near_rhyme_pairs(d).collect()}


def test_conditional_update_leaves_good_pairs(spark):
    p = spark.createDataFrame([(1, 0, "a b c d", "one two\nthree", "one two three"), (2, 0, "same words here", "same words here", "other")],
                              "conv_id long, turn long, input string, output string, new_input string")
    got = {r["conv_id"]: (r["input"], r["updated"]) for r in curate.conditional_update(p).collect()}
    assert got == {1: ("a b c d", False), 2: ("other", True)}
    flagged = {r["conv_id"] for r in curate.flag_bad_pairs(p).where("bad").collect()}
    assert {k for k, v in got.items() if v[1]} <= flagged


def test_flag_reads_the_whole_verse(spark):
    verse = "\n".join(["aa bb", "cc dd", "ee ff", "gg hh", "copied line here"])
    p = spark.createDataFrame([(1, 0, "text with copied line here inside", verse, None)],
                              "conv_id long, turn long, input string, output string, new_input string")
    r = curate.flag_bad_pairs(p).collect()[0]
    assert r["copied"] and r["bad"] and r["len_verse"] == len(verse)


def test_edit_neighbours_two_edits(spark):
    words = ["haus", "maus", "mausi", "klaus", "baum", "b", "", "hase"]
    d = spark.createDataFrame([(w,) for w in words], "word string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    for k in (1, 2):
        got = {(r["word"], r["other"], r["dist"]) for r in lexicon.edit_neighbours(d, d, k).collect()}
        assert got == {(a, b, lev(a, b)) for a in words for b in words if lev(a, b) <= k}


def test_long_patterns_stay_out_of_the_matcher(spark):
    d = spark.createDataFrame([("US" * 30,), ("US" * 4,), ("",)], "pattern string")
    assert {r["pattern"] for r in metre.pattern_matches(d).collect()} == {"US" * 4}
    e = metre.pattern_metre_errors(d).where("pattern <> 'USUSUSUS'")
    assert e.count() == 18 and e.where("strong + weak > 0 or failed").count() == 0
    one = metre.pattern_matches(d, metres=["iambos"]).collect()[0]
    assert len(one["strong"]) == 1
