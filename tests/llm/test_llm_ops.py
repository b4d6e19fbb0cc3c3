"""Operators of cadenza.llm against brute force, round trips and edge cases."""
import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept int, k int, size string, severity string, grade int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, ties, a long text, clashing extra columns."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(6000))
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    rows = [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base.replace("alpha3 ", "other "), "en"),
            (4, None, None), (5, "", "en"), (None, "only one", "de"), (None, None, None), (6, long, "en"),
            (7, "a\t b\n c", "fr"), (8, "a b c", "fr"), (9, "mail x.y@z.org or 10.0.0.1, card 4111 1111 1111 1111, +1 (212) 555-0100", "en"),
            (10, "Released under the MIT License.", "en"), (11, "!!! ... ###", "en"), (12, "\x00\x01\x02 odd", "en")]
    return spark.createDataFrame([(i, t, l, "s", None, "clash", 7, 8, "clash", "clash", 9) for i, t, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


# 1 ---------------------------------------------------------------------------
def test_shards(spark, odd, docs):
    from cadenza.llm.shard import histogram_shards
    r = histogram_shards(docs, 16).toPandas()
    raw = dict(texts(docs))
    assert sorted(r.doc_id) == sorted(raw)
    for x in r.itertuples():
        b = raw[x.doc_id].encode()
        assert (x.size, x.text_crc32) == (len(b) + 1, zlib.crc32(b))
    by = r.groupby("shard")["size"].sum()
    assert set(r.shard) == set(range(16))
    assert (abs(by - r["size"].sum() / 16) <= r["size"].max()).all()
    for _, g in r.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    o = histogram_shards(odd, 4, rows_per_range=1).toPandas()
    assert len(o) == odd.count() and o["size"].sum() == sum(len(t.encode()) + 1 for _, t in texts(odd))
    for _, g in o.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert histogram_shards(odd.limit(0), 4).count() == 0


def test_shards_hot_key(spark):
    """A third of all rows are one text, with one doc_id: still split evenly."""
    from cadenza.llm.shard import histogram_shards
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"),
                                  F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    by = histogram_shards(df, 8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert len(by) == 8 and by.max() - by.min() <= 24


# 2 ---------------------------------------------------------------------------
def brute_exact(rows):
    g = collections.defaultdict(list)
    for i, t in rows:
        g[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    out = []
    for i, t in rows:
        m = g[re.sub(r"[\x20\x09-\x0D]+", " ", t)]
        ids = [x for x in m if x is not None]
        k = min(ids) if ids else None
        out.append((i, k, len(m), i == k))
    return out


def test_exact(odd, docs):
    from cadenza.llm.exact import drop_exact, exact_groups
    for d in (docs, odd, odd.limit(0)):
        r = exact_groups(d)
        same([tuple(x) for x in r.select("doc_id", "keep_id", "group_size", "kept").collect()], brute_exact(texts(d)))
        left = drop_exact(d)
        assert left.columns == d.columns
        same([x[0] for x in left.select("doc_id").collect()], [x[0] for x in brute_exact(texts(d)) if x[3]])
    assert {r["keep_id"] for r in drop_exact(odd).select("keep_id").collect()} == {"clash"}


# 3 ---------------------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_base(t):
    return [(i, m.start(), m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if passes(k, m.group())]


def test_pii_base(spark, odd, docs):
    from cadenza.llm.pii import find_pii
    hard = ["a@b.c_d@e.f x@y", "foo@bar@baz.com", "1.2.3.4.5.6.7.8.9 999.1.1.1 0001.2.3.4 00000000000000.1.1.1", "4111111111111111 4111-1111-1111-1111",
            "+1 (269) 555-3296 4524132264652876", "+1((((( +12", "é@é a.é@b.c", "9" * 3000 + " " + "a" * 3000 + "@" + "b." * 2000 + "c", "1 " * 4000, "1.2.3.4" * 500]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    for d in (extra, odd, docs, odd.limit(0)):
        got = find_pii(d).collect()
        want = collections.Counter((i, tuple(brute_base(t.replace("\x01", "\x03").replace("\x02", "\x03")))) for i, t in texts(d))
        assert collections.Counter((r["doc_id"], tuple((b["k"], b["s"], b["e"]) for b in r["base"])) for r in got) == want
        for r in got:
            assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_pii_boosting_adds_and_calibrates():
    from cadenza.llm.pii import fit_boosted
    rows = [(1 << 2 | 1 << 14, f, 400, 4) for f in (0, 1)] + [(1 << 2, f, 2, 300) for f in (0, 1)] + [(1 << 3, f, 0, 50) for f in (0, 1)]
    m = fit_boosted(rows, 0.9)
    a, b = m.scale

    def p(mask):
        s = 0.0
        for root, (lf, lv), (rf, rv) in m.trees:
            f, v = (rf, rv) if mask >> root & 1 else (lf, lv)
            s += v[mask >> f & 1]
        return 1 / (1 + np.exp(-(a * s + b)))
    assert p(1 << 2 | 1 << 14) >= m.threshold > p(1 << 2)
    assert abs(p(1 << 2 | 1 << 14) - 400 / 404) < 0.05
    assert fit_boosted([]) is None


def test_pii_added_span(spark):
    """A card swallowed by a failed phone match comes back as an added span; redaction covers it."""
    from cadenza.llm.pii import find_pii, redact
    card = "4111111111111111"
    rows = [(i, f"pay card {card} now and 1234567890123{i % 10}9 no") for i in range(60)]
    rows += [(999, f"call +1 (269) 555-3296 {card} today")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in find_pii(d).collect() if r["doc_id"] == 999][0]
    assert got["base"] == [] and (2, 23, 39) in [tuple(x) for x in got["spans"]]
    red = [r for r in redact(d).collect() if r["doc_id"] == 999][0]["redacted"]
    assert card not in red and "[card]" in red


# 4 ---------------------------------------------------------------------------
def test_packing(odd, docs):
    from tokenizers import Tokenizer

    from cadenza.llm.pack import pack_documents
    from cadenza.llm.queries import tokenizer_file
    tok = Tokenizer.from_file(tokenizer_file())
    for d in (docs, odd):
        r = pack_documents(d, tokenizer_file(), with_ids=True).toPandas()
        ids = collections.Counter()
        for i, t in texts(d):
            own = tok.encode(t, add_special_tokens=False).ids + [1]
            for s in range(0, len(own), 2048):
                ids[(i, s, tuple(own[s:s + 2048]), len(own))] += 1
        got = collections.Counter((None if np.isnan(x.doc_id) else int(x.doc_id), x.start, tuple(x.ids), x.doc_tokens) for x in r.itertuples())
        assert got == ids
        for _, g in r.sort_values("offset").groupby("sequence_id"):
            assert (g.offset.to_numpy() == g.length.cumsum().to_numpy() - g.length.to_numpy()).all() and g.length.sum() <= 2048
        n = r.sequence_id.nunique()
        assert sorted(r.sequence_id.unique()) == list(range(n)) and n <= -(-r.length.sum() // 2048) + 2
    assert pack_documents(odd.limit(0), tokenizer_file()).count() == 0


def test_subset_sum():
    from cadenza.llm.pack import best_fill, plan
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(1, 90))
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        used = best_fill(counts, room)
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[x] for x, n in used.items())
        cap = 60
        total = collections.Counter()
        for times, pattern in plan(counts, cap):
            assert sum(x * n for x, n in pattern.items()) <= cap
            for x, n in pattern.items():
                total[x] += n * times
        assert total == counts


def test_encoder_matches_tokenizer():
    from tokenizers import Tokenizer

    from cadenza.llm.pack import ChunkEncoder
    from cadenza.llm.queries import tokenizer_file
    tok, enc = Tokenizer.from_file(tokenizer_file()), ChunkEncoder(tokenizer_file())
    odd = ["", "a<|endoftext|> b  \n c   d", " ", "\n\n x\t\ty '  's don't I'll  ", "日本語 テスト²³ x²5 \x1c!a\x1c! é́  ",
           "a" * 5000, " <|endoftext|><|endoftext|>  q", "\U0001F600\U0001F600 x\r\n\r\n  y", "\xa0 x   y"]
    for _ in range(2):
        ids, n = enc.encode(odd)
        assert ids.tolist() == [i for t in odd for i in tok.encode(t, add_special_tokens=False).ids]
        assert n.tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in odd]


# 5 ---------------------------------------------------------------------------
def test_decontamination(spark, odd):
    from cadenza.llm.decon import drop_contaminated, flag_contaminated
    filler = " ".join(f"filler{i}" for i in range(40))
    q = "A train leaves with Anna at 40 km and returns with Anna after 15 hours in total, so how many wagons did it pull that day?"
    bench = spark.createDataFrame([(1, q), (2, None), (3, "too short one"), (4, "one two three four five six"), (5, "")], "item_id long, text string")
    rows = [(1, f"{filler}. {q} {filler}"), (2, f"{filler}. {q.replace('40', '77').replace('15', '3').replace('Anna', 'Bert')}"),
            (3, q.replace("with Anna at", "with Anna at").replace("returns with Anna", "returns with Carl")),    # Anna -> Anna and Carl
            (4, filler), (5, None), (6, ""), (7, q.upper()), (8, "x one two three four five six y"), (9, " ".join(q.split()[:9])), (1, f"{filler}. {q} {filler}"),
            (None, q)]
    d = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, coverage string, k int")
    got = collections.Counter((r["doc_id"], r["contaminated"], r["item_id"]) for r in flag_contaminated(d, bench).collect())
    assert got == collections.Counter({(1, True, 1): 2, (2, True, 1): 1, (3, True, 1): 1, (4, False, None): 1, (5, False, None): 1,
                                       (6, False, None): 1, (7, True, 1): 1, (8, True, 4): 1, (9, False, None): 1, (None, True, 1): 1})
    left = drop_contaminated(d, bench)
    assert left.columns == d.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 9]
    assert flag_contaminated(odd, bench.limit(0)).where("contaminated").count() == 0
    assert flag_contaminated(d.limit(0), bench).count() == 0


def test_decontamination_brute(spark, docs):
    from cadenza.llm.decon import flag_contaminated
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    def split(t):
        return re.findall(r"[^\W_]+", t.lower())
    items = {r["item_id"]: {tuple(w[j:j + 5]) for w in [split(r["text"])] for j in range(len(w) - 4)} for r in bench.collect()}
    want = {i for i, t in texts(docs) for w in [split(t)] for own in [{tuple(w[j:j + 5]) for j in range(len(w) - 4)}]
            if any(len(own & g) >= 0.5 * len(g) for g in items.values())}
    assert {r["doc_id"] for r in flag_contaminated(docs, bench).where("contaminated").collect()} == want


# 6 ---------------------------------------------------------------------------
def test_licenses(odd, docs):
    from cadenza.llm.license import TEMPLATE_BIGRAMS, TEMPLATES, bounds, scan_licenses

    def brute(t, cut=0.9):
        lines = re.sub(r"[\W_&&[^\n]]+", " ", t.lower()) if False else "".join(c if c.isalnum() or c == "\n" else " " for c in t.lower())
        ls = lines.split("\n")
        segs = list(enumerate(ls)) + ([(-1, lines.replace("\n", " "))] if len(ls) > 1 else [])
        best = []
        for n, s in segs:
            w = s.split()
            b = {f"{x} {y}" for x, y in zip(w, w[1:])}
            for i, g in enumerate(TEMPLATE_BIGRAMS):
                d = 2 * len(b & set(g)) / (len(b) + len(g))
                if d >= cut:
                    lo, hi = bounds(len(g), cut)
                    assert lo <= len(b) <= hi
                    best.append((d, -i, -n))
        return (TEMPLATES[-max(best)[1]][0], max(best)[0], -max(best)[2]) if best else (None, None, None)
    for d in (docs, odd, odd.limit(0)):
        got = [(r["doc_id"], r["license"], r["dice"], r["line"]) for r in scan_licenses(d).collect()]
        same(got, [(i, *brute(t)) for i, t in texts(d)])


# 7 ---------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    from cadenza.llm.toxic import grades, score, train
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0
    model = train(d, grades(lab.where(fit)))
    assert model.thresholds == sorted(model.thresholds)
    r = score(d, model).join(lab.where(~fit), "doc_id").select("rejected", "toxic").toPandas()
    assert (r.rejected == (r.toxic == 1)).mean() >= 0.93
    assert r.rejected[r.toxic == 0].mean() <= 0.02


def test_toxicity_edges(spark, odd, labels, docs):
    from cadenza.llm.toxic import drop_toxic, grades, score, train
    rows = [(i, f"idiot trash talk{i} here" if i % 5 == 0 else f"kind words number{i} here") for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)] + [(0, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    m = train(d, grades(lab))
    assert {"idiot", "trash"} <= set(m.weights)
    got = {r["doc_id"]: r["rejected"] for r in score(d, m).collect()}
    assert all(got[i] == (i % 5 == 0) for i in got)
    s = score(odd, m)
    assert s.count() == odd.count() and not s.where("rejected").count()
    assert drop_toxic(odd, m).columns == odd.columns and drop_toxic(odd, m).select("grade").distinct().collect()[0][0] == 9
    none = train(d, grades(lab.limit(0)))
    assert not score(d, none).where("rejected").count() and score(odd.limit(0), m).count() == 0


def test_ordinal_gradient_orders_grades():
    from cadenza.llm.toxic import fit_ordinal
    rng = np.random.default_rng(0)
    x = rng.random((600, 3)) < 0.4
    latent = x @ np.array([2.0, 4.0, 0.0]) + rng.logistic(size=600)
    grade = np.digitize(latent, [1.5, 4.0])
    rows, cols = np.nonzero(x)
    w, t = fit_ordinal(rows, cols, grade, 3, 3, l2=0.1)
    assert w[1] > w[0] > w[2] and t[0] < t[1] and abs(w[2]) < 0.8


# 8 ---------------------------------------------------------------------------
def test_chat(spark):
    from cadenza.llm.chat import link_calls
    def call(i, after=(), name="search", args=None):
        return {"id": i, "name": name, "arguments": {"query": "q", "words": 1} if args is None else args, "after": list(after)}
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [call("b", ["a"]), call("a"), call("c", ["b", "zzz"])]})),
            (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "ra"})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "rb"})),
            (1, 3, "tool", json.dumps({"tool_call_id": "nope", "content": {"y": 1, "x": 2}})),
            (2, 0, "assistant", json.dumps({"tool_calls": [call("x", ["y"]), call("y", ["x"]), call("z", args={"words": "1", "more": 2})]})),
            (3, 0, "user", None), (3, 1, "user", ""), (3, 2, "user", "{broken"), (None, None, None, None),
            (4, 0, "user", "hello there"), (4, 1, "assistant", "hi"), (4, 2, "user", "word " * 30), (4, 2, "user", "word " * 30)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, level string")
    r = link_calls(d).toPandas()
    c = r[(r.kind == "call") & (r.conv_id < 4)].set_index(["conv_id", "call_id"]).sort_index()
    assert c.loc[(1, "a")].status == "linked" and c.loc[(1, "a")].n_results == 2
    assert json.loads(c.loc[(1, "a")].result_json)["content"] == "ra"
    assert [c.loc[(1, x)].position for x in "abc"] == [0, 1, 2] and c.loc[(1, "c")].unknown_after == 1
    assert c.loc[(2, "x")].status == c.loc[(2, "y")].status == "cyclic" and c.loc[(2, "z")].position == 0
    assert c.loc[(2, "z")].errors == "missing query; unexpected more; words is no integer" and not c.loc[(2, "z")].valid
    assert c.loc[(1, "a")].json == '{"arguments":{"query":"q","words":1},"id":"a","name":"search"}'
    o = r[r.status == "orphan"]
    assert list(o.json) == ['{"content":{"x":2,"y":1},"tool_call_id":"nope"}']
    assert (r[r.conv_id == 3].kind == "message").sum() == 2
    four = r[(r.conv_id == 4) & (r.kind == "call")]
    assert sorted(four.position) == [0, 1, 2] and set(four.name) == {"search", "summarize"}
    assert link_calls(d.limit(0)).count() == 0


def test_chat_table(spark):
    """Derived calls of the whole table against a plain pass per conversation."""
    from cadenza.llm.chat import link_calls
    d = spark.read.parquet(f"{SF}/conversations.parquet")
    want = []
    by = collections.defaultdict(list)
    for x in d.collect():
        by[x["conv_id"]].append(x)
    for c, ms in by.items():
        answered = {m["turn"] - 1 for m in ms if m["role"] == "assistant"}
        for p, m in enumerate(m for m in sorted(ms, key=lambda m: m["turn"]) if m["role"] == "user"):
            want.append((c, m["turn"], p, "linked" if m["turn"] in answered else "unanswered"))
    got = link_calls(d).where("kind = 'call'").select("conv_id", "turn", "position", "status")
    same([tuple(x) for x in got.collect()], want)


# 9 ---------------------------------------------------------------------------
def brute_classes(rows, width=5, cut=0.8):
    sh = []
    for i, t in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        sh.append({tuple(w[j:j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sh[a] and sh[b] and len(sh[a] & sh[b]) >= cut * len(sh[a] | sh[b]):
                root[find(a)] = find(b)
    g = collections.defaultdict(list)
    for x, (i, _) in enumerate(rows):
        g[find(x)].append(i)
    out = []
    for x, (i, _) in enumerate(rows):
        m = g[find(x)]
        ids = [y for y in m if y is not None]
        out.append((i, min(ids) if ids else None, len(m)))
    return out


def test_near(spark, odd, docs):
    from cadenza.llm.near import drop_near, near_classes
    for d in (docs, odd):
        r = near_classes(d).select("doc_id", "class_id", "class_size").collect()
        same([tuple(x) for x in r], brute_classes(texts(d)))
    left = drop_near(odd)
    assert left.columns == odd.columns
    same([x["doc_id"] for x in left.collect()], [i for i, c, _ in brute_classes(texts(odd)) if i == c])
    assert near_classes(odd.limit(0)).count() == 0


def test_near_large_group(spark):
    """A group over several blocks: copies of one text with edits, and a chain of edits."""
    from cadenza.llm.near import near_classes
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 900):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            w[p] = f"e{i}_{p}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(x) for x in near_classes(d).collect()], brute_classes(rows))


def test_dart_signatures_estimate_weighted_jaccard():
    from cadenza.llm.near import dart_signatures
    rng = np.random.default_rng(1)
    n = 400
    el = rng.integers(0, 2**48, n).astype(np.uint64)
    wa, wb = rng.uniform(0.1, 6, n), rng.uniform(0.1, 6, n)
    wb[:250] = wa[:250]
    wb[380:] = 0
    k = 2048
    m = wb > 0
    sig = dart_signatures(np.concatenate([el, el[m]]), np.concatenate([wa, wb[m]]),
                          np.concatenate([np.zeros(n, np.int64), np.ones(m.sum(), np.int64)]), 2, k)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)
    assert (sig != 0).all()


# 10 --------------------------------------------------------------------------
def test_kneser_ney_brute(spark):
    """Probabilities against a direct recursive form of interpolated modified Kneser-Ney."""
    from cadenza.llm.quality import ORDER, discounts, probabilities
    import folded_model
    from folded_model import SYMBOLS, codes, gram_counts, table_of
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(folded_model)      # workers do not have the tests on their path
    tx = ["the cat sat on the mat, the cat ran.", "a cat and a hat", "the end of the hat", "", "ünïcode ÄÖ 12 $"]
    d = spark.createDataFrame([(t,) for t in tx], "text string")
    c4 = gram_counts(d).cache()
    table = table_of(probabilities(c4, 1.0 / SYMBOLS, SYMBOLS)).astype(np.float64)
    grams = collections.Counter()
    for t in tx:
        for g in codes([t])[0].tolist():
            s = []
            for _ in range(ORDER):
                s.append(g % SYMBOLS)
                g //= SYMBOLS
            grams[tuple(reversed(s))] += 1
    level = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        level[k] = collections.Counter({}) if False else collections.Counter(g[1:] for g in level[k + 1])

    def disc(k):
        n = collections.Counter(level[k].values())
        if not n[1] or not n[2]:
            return {1: 0.5, 2: 0.75, 3: 0.9}
        y = n[1] / (n[1] + 2 * n[2])
        return {1: 1 - 2 * y * n[2] / n[1], 2: max(0.0, 2 - 3 * y * n[3] / n[2]), 3: max(0.0, 3 - 4 * y * n[4] / n[3]) if n[3] else 0.9}
    ds = {k: disc(k) for k in level}
    assert abs(discounts(c4)[0] - ds[ORDER][1]) < 1e-12

    def prob(g):
        k = len(g)
        if k == 0:
            return 1.0 / SYMBOLS
        same_ctx = {x: c for x, c in level[k].items() if x[:-1] == g[:-1]}
        if not same_ctx:
            return prob(g[1:])
        total, dd = sum(same_ctx.values()), ds[k]
        gamma = sum(dd[min(c, 3)] for c in same_ctx.values()) / total
        c = same_ctx.get(g, 0)
        return (c - dd[min(c, 3)] if c else 0) / total + gamma * prob(g[1:])
    rng = np.random.default_rng(2)
    some = list(grams) + [tuple(rng.integers(0, SYMBOLS, 4).tolist()) for _ in range(100)]
    for g in some:
        i = 0
        for s in g:
            i = i * SYMBOLS + s
        assert abs(np.exp(table[i]) - max(prob(g), 1e-7)) < 4e-3 * max(prob(g), 1e-5) + 1e-6
    rows = np.exp(table.reshape(-1, SYMBOLS)).sum(axis=1)
    assert abs(rows[:3000] - 1).max() < 0.02


def test_quality(spark, odd, docs, labels):
    from cadenza.llm.quality import quality, trusted_ids
    r = quality(docs, trusted_ids(labels)).join(labels, "doc_id").toPandas()
    assert r.kept[r.quality == 1].mean() >= 0.97 and r.kept[r.quality == 0].mean() <= 0.5
    o = quality(odd, trusted_ids(labels).limit(0))
    assert o.count() == odd.count() and not o.where("not kept").count() and o.where("perplexity is null").count() == 3
    mixed = quality(docs.select("doc_id", "lang", "text").unionByName(odd.select("doc_id", "lang", "text")), trusted_ids(labels))
    assert mixed.where("doc_id = 4 and not kept").count() == 0
    assert quality(odd.limit(0), trusted_ids(labels)).count() == 0


# pipeline and SQL ------------------------------------------------------------
@pytest.mark.parametrize("name", ["op2_exact_dedup", "op6_dice_licenses"])
def test_sql(spark, name):
    import duckdb

    from cadenza.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE[name])
    at = [[d[0] for d in rel.description].index(c) for c in df.columns]
    same([tuple(r) for r in df.collect()], [tuple(r[i] for i in at) for r in rel.fetchall()])


def test_pipeline_against_brute_force(spark, docs):
    """Each stage judged on its own input; the last packs every id of what is left."""
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from cadenza.llm.common import keep
    from cadenza.llm.queries import tokenizer_file
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in bench]

    def leaked(t):
        w = re.findall(r"[^\W_]+", t.lower())
        own = {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
        return any(len(own & g) >= 0.5 * len(g) for g in items)
    for name, stage in P.STAGES[:-1]:
        out = keep(stage(spark, d, SF), "test-stage")
        assert out.columns == d.columns
        before, after = texts(d), sorted(i for i, _ in texts(out))
        if name == "toxicity":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
            gone = {i for i, _ in before} - set(after)
            assert len(gone) <= 0.2 * len(before) and len(gone & bad) >= 0.5 * len(bad)
        else:
            want = {"exact_dedup": lambda: [i for i, _, _, k in brute_exact(before) if k],
                    "near_dedup": lambda: [i for i, c, _ in brute_classes(before) if i == c],
                    "decontamination": lambda: [i for i, t in before if not leaked(t)]}[name]()
            assert after == sorted(want), name
        d = out
    r = P.STAGES[-1][1](spark, d, SF).toPandas()
    tok = Tokenizer.from_file(tokenizer_file())
    assert dict(r.groupby("doc_id").length.sum()) == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(d)}
    whole = P.run(spark, SF).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].to_numpy().tolist())) == sorted(map(tuple, r[key].to_numpy().tolist()))
