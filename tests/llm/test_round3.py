"""Spelling variants, resampling and substring dedup against brute force and SQL; cases that operators once lost."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ("doc_id long, text string, `my col` string, `a.b` int, word string, n long, score long, rank long, mark long, block long, words string, "
       "size int, th long, shard int, kept string")


def frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash or hold signs."""
    return spark.createDataFrame([(i, t, "x", 1, "w", 2, 3, 4, 5, 6, "ws", 7, 8, 9, "k") for i, t in rows], ODD)


def odd_rows():
    rng = random.Random(5)
    passage = " ".join(f"pass{i % 23}age{i}" for i in range(60))
    long = " ".join(rng.choice(["Alpharing", "betatest", "GAMMAWORD", "délicieux", "kurz", "x1"]) for _ in range(9000))
    rows = [(1, f"start one {passage} end"), (2, f"other {passage}\n tail words"), (2, f"other {passage}\n tail words"), (None, f"{passage} null"), (3, passage),
            (4, None), (5, ""), (6, " \t\n "), (7, long), (8, long), (9, "a b c"), (10, "a b c"), (None, None), (3, "another text under a used id " * 3), (11, passage.upper())]
    return rows + [(i, f"wordform wordforms vordform {'wordform ' * 30} Überraschung überraschung") for i in range(20, 24)]


# 11 --------------------------------------------------------------------------
def brute_variants(rows):
    c = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                c[w] += 1
    n = {w: k for w, k in c.items() if k >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    others = {w: [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and near(w, v)] for w in n}
    form = {}
    for w in n:
        b = min(others[w], key=lambda v: (-n[v], v), default=None)
        form[w] = b if b and n[b] >= 10 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variants(df):
    from cadenza.llm.variants import spelling_variants
    return sorted((tuple(r) for r in spelling_variants(df).collect()), key=repr)


def test_variants(spark, monkeypatch):
    from cadenza.llm import variants as V
    rows = odd_rows()
    want = brute_variants(rows)
    assert len(want) > 4 and any(r[1] for r in want)
    assert variants(frame(spark, rows)) == want
    assert variants(frame(spark, rows).limit(0)) == []
    # chains, and one cell of anagrams that no split parts: dealt into parts
    rng = random.Random(1)
    words = ["abcdefgh", "abcdefgx", "abcdefxx", "abcdefxxx"]
    text = " ".join([words[0]] * 2000 + [words[1]] * 150 + [words[2]] * 12 + [words[3]])
    shuffled = ["".join(rng.sample("aabcdeffg", 9)) for _ in range(120)]
    more = [(i, text) for i in range(3)] + [(i, " ".join(shuffled)) for i in (4, 5)] + [(6, "é" * 300 + " " + "é" * 299), (7, "é" * 300 + " " + "é" * 299)]
    monkeypatch.setattr(V, "CELL", 4)
    want = brute_variants(more)
    assert variants(frame(spark, more)) == want and any(r[2] != r[1] and r[1] for r in want)


def test_variant_cells(spark, monkeypatch):
    """Small cells, so that most pairs are found by visitors."""
    from cadenza.llm import variants as V
    monkeypatch.setattr(V, "CELL", 60)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert variants(docs.limit(80)) == brute_variants([(r["doc_id"], r["text"]) for r in docs.limit(80).collect()])


def test_kd_walk():
    """Every point within one step up and one down is met, and each box at most once."""
    from cadenza.llm.variants import FREE, GONE, KdTree
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (600, 5))
    tree = KdTree(x, 8)
    assert sorted(np.concatenate(tree.leaves)) == list(range(600))
    met = collections.defaultdict(list)
    for leaf, q, _, _ in tree.walk(x, np.full(600, FREE), np.full(600, FREE)):
        for i in q:
            met[i].append(leaf)
    home = {p: k for k, leaf in enumerate(tree.leaves) for p in leaf}
    for i in range(0, 600, 7):
        assert len(met[i]) == len(set(met[i]))
        d = x - x[i]
        one = np.flatnonzero((d.sum(axis=1) == 0) & (np.abs(d).sum(axis=1) <= 2))
        assert {home[j] for j in one} <= set(met[i])
    up = collections.defaultdict(set)
    for leaf, q, _, _ in tree.walk(x, np.full(600, FREE), np.full(600, GONE)):
        for i in q:
            up[i].add(leaf)
    for i in range(0, 600, 7):
        d = x - x[i]
        assert {home[j] for j in np.flatnonzero((d.sum(axis=1) == 1) & (np.abs(d).sum(axis=1) == 1))} <= up[i]


# 12 --------------------------------------------------------------------------
def test_crc_spans():
    from cadenza.llm.resample import crc32_spans, word_features
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 63, 64, 65, 128, 129, 500, 4097]))) for _ in range(300)]
    data, n = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    start = np.cumsum(n) - n
    assert crc32_spans(data, start, n).tolist() == [zlib.crc32(p) for p in parts]
    over = np.maximum(start - 5, 0)                                     # overlapping spans
    assert crc32_spans(data, over, n).tolist() == [zlib.crc32(data[a:a + k].tobytes()) for a, k in zip(over, n)]
    texts = ["Héllo WORLD foo", "", None, "x", "a-b c", "É é 12ab " + "z" * 3000]
    crc, text, words = word_features(pa.array(texts), 3)
    own = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW)) for t in texts]
    assert words.tolist() == [len(w) for w in own]
    assert list(zip(crc.tolist(), text.tolist())) == [(zlib.crc32(" ".join(w[j:j + k]).encode()), i) for k in (1, 2, 3) for i, w in enumerate(own)
                                                      for j in range(len(w) - k + 1)]


def brute_resample(rows, target, least=20):
    def feats(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    s, t = (collections.Counter(zlib.crc32(w.encode()) % 10000 for x in xs for w in feats(x)) for xs in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        f = feats(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in (zlib.crc32(v.encode()) % 10000 for v in f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * 10 // 100], 1):
        r[4] = k
    return sorted((tuple(r) for r in out), key=repr)


def test_resample(spark):
    from cadenza.llm.resample import border, resample
    rows = odd_rows() + [(i, " ".join(f"tok{(i * j) % 97}" for j in range(15 + i % 30))) for i in range(100, 400)]
    target = ["tok1 tok2 tok3 alpharing", None, "", "tok5 " * 40]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in resample(frame(spark, rows), bench).select(*cols).collect()]
    assert sorted(got, key=repr) == brute_resample(rows, target)
    assert resample(frame(spark, rows).limit(0), bench).count() == 0
    got = [tuple(r) for r in resample(frame(spark, rows), bench.limit(0)).select(*cols).collect()]
    assert sorted(got, key=repr) == brute_resample(rows, [])
    # a far outlier does not blunt the border
    x = spark.range(20000).select(F.when(F.col("id") == 0, -10**12).otherwise(F.col("id") % 500).cast("long").alias("score"))
    least = border(x, 100, slack=50)
    assert 100 <= x.where(F.col("score") >= least).count() <= 150


# 13 --------------------------------------------------------------------------
def brute_repeats(rows, width=13):
    first, own = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in own:
        for i in range(len(w) - width + 1 if d is not None else 0):
            k = tuple(w[i:i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in own:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone) if not y).encode()).hexdigest()))
    return sorted(out, key=repr)


def repeats(df, **kw):
    from cadenza.llm.substrings import remove_repeats
    return sorted((tuple(r) for r in remove_repeats(df, **kw).drop("kept_text").collect()), key=repr)


def test_substrings(spark, monkeypatch):
    from cadenza.llm import substrings as S
    rows = odd_rows()
    want = brute_repeats(rows)
    assert sum(r[2] for r in want) > 9000
    assert repeats(frame(spark, rows)) == want
    assert repeats(frame(spark, rows).limit(0)) == []
    # a passage in a third of all rows, with other neighbours each time, in many blocks; its anchors are hot
    rng = random.Random(2)
    passage = [f"hot{i}" for i in range(40)]
    many = []
    for i in range(300):
        w = [f"u{rng.randrange(50)}" for _ in range(40)]
        many.append((i % 250, " ".join(w + passage + w[::-1]) if i % 3 == 0 else " ".join(w)))
    monkeypatch.setattr(S, "HOT", 20)
    monkeypatch.setattr(S, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(S, "CHUNK", 3)
    assert repeats(frame(spark, many).repartition(5)) == brute_repeats(many)
    assert repeats(frame(spark, many), width=5, gram=2) == brute_repeats(many, 5)


def test_fm_index():
    """Intervals of backward search against plain counting, and the matching statistics of a stream."""
    from cadenza.llm.substrings import FMIndex, WaveletMatrix
    rng = np.random.default_rng(4)
    s = rng.integers(0, 37, 500)
    w = WaveletMatrix(s, 6)
    sym, lo, hi = rng.integers(0, 37, 200), rng.integers(0, 501, 200), rng.integers(0, 501, 200)
    a, b = w.rank(sym, lo, hi)
    assert a.tolist() == [(s[:i] == x).sum() for x, i in zip(sym, lo)] and b.tolist() == [(s[:i] == x).sum() for x, i in zip(sym, hi)]
    seqs = [rng.integers(1, 4, n) for n in (30, 1, 0, 12, 25)]
    label = np.array([5, 1, 9, 2, 7])
    width = 4
    ix = FMIndex(np.concatenate(seqs), np.array([len(x) for x in seqs]), label, width)
    for n in (1, 2, 3, 4):
        for _ in range(30):
            p = rng.integers(1, 4, n)
            lo, hi = np.array([0]), np.array([ix.size])
            for c in p[::-1]:
                lo, hi = ix.step(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum((x[i:i + n] == p).all() for x in seqs for i in range(len(x) - n + 1))
    other = [rng.integers(1, 5, n) for n in (40, 9, 3, 0)]
    got, own = {}, np.concatenate([np.where(x > 3, 1, x) for x in other])
    for qs, st, matched, vs in ix.stream(own, np.array([len(x) for x in other])):
        assert (matched == width).all()
        got |= {(int(q), int(i)): int(v) for q, i, v in zip(qs, st, vs)}
    want = {}
    for q, x in enumerate([np.where(x > 3, 1, x) for x in other]):
        for i in range(len(x) - width + 1):
            ls = [label[k] for k, y in enumerate(seqs) if any((y[j:j + width] == x[i:i + width]).all() for j in range(len(y) - width + 1))]
            if ls:
                want[q, i] = min(ls)
    assert got == want


@pytest.mark.parametrize("name", ["op11_kd_spelling_variants", "op12_crc_resampling", "op13_fm_substring_dedup"])
def test_sql_round3(spark, name):
    import duckdb

    from cadenza.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name]).fetchall()
    cols = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted(want, key=repr)


# once lost -------------------------------------------------------------------
def test_dropping_tells_rows_apart(spark):
    from cadenza.llm.exact import drop_exact
    from cadenza.llm.near import drop_near
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(80))
    near = base + " gamma"
    rows = [(1, base), (2, near), (2, "some unrelated text that only shares its id with another row here"), (None, base + " delta"), (None, base + " delta"),
            (7, "first " + base), (8, "a lonely text with more than five words"), (8, "a lonely text with more than five words")]
    d = frame(spark, rows)
    left = sorted((r["doc_id"], r["text"]) for r in drop_near(d).collect())
    assert left == [(1, base), (2, rows[2][1]), (8, rows[6][1])] and drop_near(d).columns == d.columns
    again = drop_exact(d)
    assert again.columns == d.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in again.collect()) == collections.Counter(set(rows))
    same = frame(spark, [(None, "same"), (None, "same"), (4, "x  y"), (3, "x\ty"), (3, "x y")])
    assert sorted(repr(r["doc_id"]) for r in drop_exact(same).collect()) == ["3", "None"]


def test_decontamination_counts_what_is_left(spark):
    """One clashing name takes its windows along and no more; a long unchanged run counts by itself; short items whole."""
    from cadenza.llm.decon import flag_contaminated
    item = "Tell me how Anna met Anna near the old green harbour wall before the seven boats came back with salt and silver coins"
    long = " ".join(f"word{i}" for i in range(100))
    bench = spark.createDataFrame([(1, item), (2, long), (3, "short item here")], "item_id long, text string")
    rows = [(1, item), (2, item.replace("met Anna", "met Bert")), (3, " ".join(f"word{i}" for i in range(30, 55))), (4, " ".join(f"word{i}" for i in range(30, 45))),
            (5, "Short item here"), (6, "a short item here and more"), (7, None)]
    got = {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in flag_contaminated(frame(spark, rows), bench).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 2), 4: (False, None), 5: (True, 3), 6: (False, None), 7: (False, None)}


def test_chat_odd_json(spark):
    from cadenza.llm.chat import link_calls
    call = '{"tool_calls":[{"id":"c1","name":"summarize","arguments":{"text":"t","words":1,"ratio":NaN}}]}'
    m = spark.createDataFrame([(1, 0, "assistant", call), (1, 1, "tool", '{"tool_call_id":"a\\ud800","content":"x"}'), (1, 2, "tool", '{"tool_call_id":"c1","content":"\\udfff ok"}'),
                               (None, 0, "assistant", call), (None, None, "tool", '{"tool_call_id":"c1","content":1}')], "conv_id long, turn long, role string, text string")
    r = {(x["conv_id"], x["turn"], x["kind"]): x for x in link_calls(m, derive=False).collect()}
    c = r[1, 0, "call"]
    assert not c["valid"] and "ratio" in c["errors"] and "NaN" not in c["json"] and c["status"] == "linked"
    assert r[1, 1, "result"]["status"] == "orphan" and r[1, 1, "result"]["call_id"] == "a\\ud800"
    assert r[None, 0, "call"]["status"] == "unanswered" and r[None, None, "result"]["status"] == "orphan"


def test_odd_column_names(spark):
    """Column names with spaces and dots in the operators that pass columns on."""
    import corpus_pipeline
    from cadenza.llm.quality import quality, trusted_ids
    from cadenza.llm.toxic import drop_toxic, grades, train
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("my col", F.lit(1)).withColumn("a.b", F.struct(F.lit(2).alias("c d")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    q = quality(docs, trusted_ids(labels))
    assert {"my col", "a.b"} <= set(q.columns) and q.count() == docs.count()
    assert set(r["basis"] for r in q.select("basis").distinct().collect()) <= {"language", "none"}
    left = drop_toxic(docs, train(docs, grades(labels)))
    assert left.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns, name
    assert 0 < left.count() < docs.count()
