"""Cases that an operator once left out."""
import collections
import math

import numpy as np


# 10 --------------------------------------------------------------------------
def brute_perplexity(trusted, texts):
    """Interpolated modified Kneser-Ney over characters as they stand, by its recursive form."""
    pad = "\0" * 3
    level = {4: collections.Counter((pad + t)[i:i + 4] for t in trusted for i in range(len(t)))}
    for k in (3, 2, 1):
        level[k] = collections.Counter(g[1:] for g in level[k + 1])
    by_ctx = {k: collections.defaultdict(dict) for k in level}
    ds = {}
    for k, c in level.items():
        n = collections.Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        ds[k] = {1: 0.5, 2: 0.75, 3: 0.9} if y is None else {
            1: 1 - 2 * y * n[2] / n[1], 2: max(0.0, 2 - 3 * y * n[3] / n[2]), 3: max(0.0, 3 - 4 * y * n[4] / n[3]) if n[3] else 0.9}
        for g, m in c.items():
            by_ctx[k][g[:-1]][g] = m

    def prob(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        k, same = len(g), by_ctx[len(g)].get(g[:-1])
        if not same:
            return prob(g[1:])
        total, c = sum(same.values()), same.get(g, 0)
        return (c - ds[k][min(c, 3)] if c else 0) / total + sum(ds[k][min(x, 3)] for x in same.values()) / total * prob(g[1:])
    return [math.exp(-sum(math.log(prob((pad + t)[i:i + 4])) for i in range(len(t))) / len(t)) if t else None for t in texts]


def test_quality_whole_alphabet(spark):
    """Foreign scripts, capitals, digits and marks are told apart (they were one symbol each)."""
    from cadenza.llm.quality import blocks_of, perplexity, quality, text_grams, train
    rng = np.random.default_rng(3)
    words = "мороз солнце день чудесный ещё ты дремлешь друг прелестный пора красавица проснись открой сомкнуты негой взоры".split()
    good = [" ".join(rng.choice(words, 20)) for _ in range(60)]
    junk = ["".join(rng.choice(list("абвгдежзийклмнопрстуфхцчшщ"), 120)), "$$$ %%% ### @@@ " * 5, "漢字仮名" * 10, "ABC DEF " * 9, ""]
    d = spark.createDataFrame([(i, "ru", t) for i, t in enumerate(good + junk)], "doc_id long, lang string, text string")
    trusted = spark.createDataFrame([(i,) for i in range(55)], "doc_id long")
    blocks = blocks_of(d)
    got = {r["doc_id"]: r["perplexity"] for r in perplexity(blocks, train(blocks, trusted)).collect()}
    want = brute_perplexity(good[:55], good + junk)
    assert len(got) == len(want) and all((w is None and got[i] is None) or abs(got[i] / w - 1) < 1e-9 for i, w in enumerate(want))
    kept = {r["doc_id"]: r["kept"] for r in quality(d, trusted).collect()}
    assert all(kept[i] for i in range(55)) and not any(kept[i] for i in range(60, 64)) and kept[64]
    # more symbols than fit one integer
    wide = "".join(map(chr, range(0x20000, 0x20000 + 50_000)))
    g, at, text = text_grams([wide, "", "ab"])
    assert g[at].tolist() == [("\0\0\0" + t)[i:i + 4] for t in (wide, "ab") for i in range(len(t))] and set(text) == {0, 2}


# 8 ---------------------------------------------------------------------------
def test_long_chain_levels(spark):
    """A chain beyond 10,000 calls (the rest once counted as cyclic), joints, a cycle and what hangs on it."""
    from cadenza.llm.chat import _levels
    n = 10_050
    edges = [(1, f"c{i}", f"c{i - 1}") for i in range(1, n)] + [(1, "m", "c7"), (1, "m", f"c{n - 1}"), (1, "t", "m"),
             (2, "x", "y"), (2, "y", "x"), (2, "z", "x"), (2, "q", "z"), (2, "q", "r"), (2, "s", "s"), (2, "u", "r")]
    d = spark.createDataFrame(edges, "conv_id long, call_id string, parent string")
    calls = spark.createDataFrame(sorted({(c, x) for c, *xs in edges for x in xs}), "conv_id long, call_id string")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in _levels(d, calls).collect()}
    assert got == {(1, f"c{i}"): i for i in range(n)} | {(1, "m"): n, (1, "t"): n + 1, (2, "r"): 0, (2, "u"): 1}
