"""Work that fills an executor's memory for nothing: texts cut again for each stem length, a second set of Python workers."""
from cadenza.llm import pack, toxic


def test_training_cuts_a_text_once(spark, monkeypatch):
    seen = {}
    real = toxic.keep

    def kept(df, name):
        seen[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(toxic, "keep", kept)
    rows = [(1, "Gräßlich word, WORD a1"), (2, None), (3, ""), (4, " ... "), (5, "Gräßlich word, WORD a1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxic.train(docs, spark.createDataFrame([(i, i % 3) for i, _ in rows], "doc_id long, grade int"))
    assert seen["toxic-sample"].count("regexp_replace(") == 1


def test_features_are_words_and_their_beginnings(spark):
    rows = [(1, 0, "Gräßlich word, WORD a1 grä"), (2, 1, None), (3, 1, ""), (4, 2, " ... ")]
    got = {r["row"]: r["words"] for r in toxic._features(spark.createDataFrame(rows, "row long, grade int, text string")).collect()}
    assert got[1] == ["gräßlich", "word", "a1", "grä", "grä*", "wor*", "gräß*", "word*", "gräßl*", "gräßli*", "gräßlic*", "gräßlich*"]
    assert got[2] == got[3] == got[4] == []


def test_plan_of_windows_needs_no_python_worker(spark):
    rows = spark.sql("select id as doc_id, 0L as start, 1 + id * 7 % 50 as length, id as ids_crc32, 1 + id * 7 % 50 as doc_tokens from range(300)")
    packed = pack.pack(rows, 50)
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString()
    got = packed.collect()
    assert len(got) == 300
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 50 and sorted(filled) == list(range(len(filled)))


def test_nothing_to_pack(spark):
    none = pack.pack(spark.sql("select id as doc_id, id as start, id as length, id as ids_crc32, id as doc_tokens from range(0)"), 50)
    assert none.collect() == [] and {"sequence_id", "offset"} <= set(none.columns)
