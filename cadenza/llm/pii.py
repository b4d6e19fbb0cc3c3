"""Operator 3, personal data: candidate gradient boosting (SQL functions only).

1. Base rules (email, ip, card, phone) find leftmost, non-overlapping matches per
   kind; matches that fail their check are dropped.  Base spans always stay.
2. Wider generators propose further spans, which may overlap base matches, failed
   matches and each other (a card number swallowed by a phone number that had too
   many digits, an obfuscated address, ...).
3. Each candidate becomes a mask of format and context features.  Training counts
   masks over all candidates: positive where a candidate is a base span, negative
   where it is a failed match or touches no match, unlabelled inside a failed match.
   That table (one row per mask, at most 2**17 by construction) is all the boosting
   needs; half of the documents fit the trees, the other half calibrates the margin
   (Platt) and sets the threshold: the lowest probability with the asked precision.
4. The trees become CASE expressions.  Accepted candidates that touch no base span
   are added; of those that overlap, the more probable one stays.

Text positions are code points: matches are wrapped in two control characters (any
in the text are replaced first, one for one), the text is split at them, and lengths
are summed.  The patterns are the given ones with possessive repeats and with a
start condition that only skips starts inside a run that cannot match, so that
long runs stay linear and nothing recurses.

Cases: null and empty texts give no spans; a table without candidates trains
nothing and keeps the base; repeated rows are found each; very long texts are
read whole; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import keep, text_of

KINDS = ("email", "ip", "card", "phone")
_A, _B, _C = "\u0001", "\u0002", "\u0003"
_SPANS = "array<struct<s:int,e:int,v:string,l:string>>"

#: fixed patterns of the base rules
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: generators of further candidates
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+"
             r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: fixed values: words that often stand before personal data
CUES = r"(?i)(mail|phone|tel|call|fax|mobile|contact|card|visa|pay|ip|host|addr|login)[^a-z]{0,4}$"


def spans_of(t: Column, pattern: str) -> Column:
    """All matches in order: start, end (code points), text, up to 16 characters before."""
    parts = F.split(F.regexp_replace(t, pattern, f"{_A}$0{_B}"), f"[{_A}{_B}]")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("pos"), F.lit("").alias("prev"),
                     F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = (acc["pos"] + F.length(x)).cast("int")
        one = F.array(F.struct(acc["pos"].alias("s"), end.alias("e"), x.alias("v"), acc["prev"].alias("l")))
        return F.struct((acc["i"] + 1).alias("i"), end.alias("pos"), F.substring(x, -16, 16).alias("prev"),
                        F.when(acc["i"] % 2 == 1, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))
    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast(_SPANS))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(d: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        y = F.when((F.length(d) - i) % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)
        return acc + y
    return F.when(F.length(d).between(1, 40), F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0) \
        .otherwise(F.lit(False))


def ip_ok(v: Column) -> Column:
    def small(x: Column) -> Column:
        y = F.regexp_replace(x, "^0+", "")          # of any length: compared as text first
        return (F.length(y) < 3) | ((F.length(y) == 3) & (y <= F.lit("255")))
    return F.forall(F.split(v, r"\."), small)


def valid(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    return {"email": F.lit(True), "ip": ip_ok(v), "card": n.between(13, 19) & luhn(digits(v)),
            "phone": n.between(9, 15)}[kind]


def _checked(kind: str):
    return lambda m: valid(kind, m["v"])


def _placed(i: int):
    return lambda m: F.struct(F.lit(i).alias("k"), m["s"].alias("s"), m["e"].alias("e"))


def of_kind(i: int):
    return lambda c: c["k"] == i


def _features(c: Column) -> list[Column]:
    """Boolean format and context features of a candidate (kind, v, l)."""
    v, left, n = c["v"], c["l"], F.length(digits(c["v"]))
    seps = F.length(F.regexp_replace(v, r"[^\x20().-]", ""))
    return [
        c["kind"] == "email", c["kind"] == "ip", c["kind"] == "card", c["kind"] == "phone",
        n <= 8, n.between(9, 12), n.between(13, 15), n > 16,
        seps == 0, seps >= 3,
        F.startswith(v, F.lit("+")), F.contains(v, F.lit("(")), F.contains(v, F.lit("@")), F.contains(v, F.lit(" ")),
        F.when(c["kind"] == "card", luhn(digits(v))).when(c["kind"] == "ip", ip_ok(v)).otherwise(F.lit(False)),
        left.rlike(r"[A-Za-z0-9+.-]$"), left.rlike(CUES),
    ]


N_FEATURES = 17


def _mask(c: Column) -> Column:
    out = F.lit(0)
    for i, f in enumerate(_features(c)):
        out = out + F.when(f, F.lit(1 << i)).otherwise(F.lit(0))
    return out.cast("int")


def _touches(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))


def _same(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] == c["s"]) & (b["e"] == c["e"]))


def found(docs: DataFrame) -> DataFrame:
    """``doc_id``, fold, base spans per kind and the candidates with mask and label."""
    t = F.translate(text_of(), _A + _B, _C + _C)
    d = docs.select("doc_id", t.alias("t"))
    d = d.select("doc_id", "t", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int").alias("fold"),
                 F.contains("t", F.lit("@")).alias("_at"), F.col("t").rlike("[0-9]").alias("_num"))
    none = F.array().cast(_SPANS)
    raw = {}
    for kind in KINDS:
        gate = F.col("_at") if kind == "email" else F.col("_num")
        raw[kind] = F.when(gate, spans_of(F.col("t"), BASE[kind])).otherwise(none).alias(f"raw_{kind}")
    wide = [F.when(F.col("_at") | F.col("t").contains("at") if kind == "email" else F.col("_num"),
                   spans_of(F.col("t"), WIDE[kind])).otherwise(none).alias(f"wide_{kind}") for kind in KINDS]
    d = d.select("doc_id", "fold", *raw.values(), *wide)
    for kind in KINDS:
        d = d.withColumn(f"base_{kind}", F.filter(f"raw_{kind}", _checked(kind)))

    def cand(kind: str) -> Column:
        r, b = F.col(f"raw_{kind}"), F.col(f"base_{kind}")

        def one(m: Column) -> Column:
            label = (F.when(_same(b, m), 1).when(_same(r, m), 0).when(_touches(r, m), F.lit(None)).otherwise(0))
            c = F.struct(F.lit(kind).alias("kind"), m["v"].alias("v"), m["l"].alias("l"))
            return F.struct(F.lit(KINDS.index(kind)).alias("k"), m["s"].alias("s"), m["e"].alias("e"),
                            _mask(c).alias("mask"), label.cast("int").alias("label"))
        return F.transform(f"wide_{kind}", one)

    def plain(kind: str) -> Column:
        return F.transform(f"base_{kind}", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))).alias(f"base_{kind}")
    return d.select("doc_id", "fold", *[plain(k) for k in KINDS], F.concat(*[cand(k) for k in KINDS]).alias("cands"))


class Boosted:
    """Depth-two trees on mask bits with a Platt scale and a threshold."""

    def __init__(self, trees: list[tuple], scale: tuple[float, float], threshold: float):
        self.trees, self.scale, self.threshold = trees, scale, threshold

    def probability(self, mask: Column) -> Column:
        def bit(i: int) -> Column:
            return mask.bitwiseAND(F.lit(1 << i)) != 0
        total = F.lit(0.0)
        for root, (left, lv), (right, rv) in self.trees:
            total = total + F.when(bit(root), F.when(bit(right), rv[1]).otherwise(rv[0])) \
                .otherwise(F.when(bit(left), lv[1]).otherwise(lv[0]))
        a, b = self.scale
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * total + F.lit(b))))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, lam: float) -> int:
    gain = [(g[c].sum() ** 2 / (h[c].sum() + lam) + g[~c].sum() ** 2 / (h[~c].sum() + lam)) for c in x.T]
    return int(np.argmax(gain))


def fit_boosted(rows: list[tuple[int, int, int, int]], precision: float = 0.95, rounds: int = 40,
                rate: float = 0.3, lam: float = 1.0) -> Boosted | None:
    """``rows``: (mask, fold, positive, negative).  Fold 0 fits, fold 1 calibrates
    (fold 0 again if fold 1 lacks a class)."""
    a = np.array(rows, np.int64).reshape(-1, 4)
    if a[:, 2].sum() == 0 or a[:, 3].sum() == 0:
        return None
    fit = a[a[:, 1] == 0]
    if len(fit) == 0 or fit[:, 2].sum() == 0 or fit[:, 3].sum() == 0:
        fit = a
    bits = lambda m: (m[:, None] >> np.arange(N_FEATURES)) & 1 == 1
    x, pos, neg = bits(fit[:, 0]), fit[:, 2].astype(float), fit[:, 3].astype(float)
    margin, trees = np.zeros(len(fit)), []

    def leaf(g, h):
        return float(rate * g.sum() / (h.sum() + lam))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        root = _split(x, g, h, lam)
        sides = []
        for side in (~x[:, root], x[:, root]):
            f = _split(x[side], g[side], h[side], lam) if side.any() else 0
            off, on = side & ~x[:, f], side & x[:, f]
            v = (leaf(g[off], h[off]), leaf(g[on], h[on]))
            margin += np.where(on, v[1], np.where(off, v[0], 0))
            sides.append((f, v))
        trees.append((root, sides[0], sides[1]))
    cal = a[a[:, 1] == 1]
    if len(cal) == 0 or cal[:, 2].sum() == 0 or cal[:, 3].sum() == 0:
        cal = a
    xc, m = bits(cal[:, 0]), np.zeros(len(cal))
    for root, (lf, lv), (rf, rv) in trees:
        m += np.where(xc[:, root], np.where(xc[:, rf], rv[1], rv[0]), np.where(xc[:, lf], lv[1], lv[0]))
    pos, neg = cal[:, 2].astype(float), cal[:, 3].astype(float)
    s, t = 1.0, 0.0
    for _ in range(200):                      # Platt scale by damped gradient steps
        p = 1 / (1 + np.exp(-(s * m + t)))
        r = (pos + neg) * p - pos
        s -= 0.5 * (r * m).sum() / ((pos + neg) * m * m + 1e-9).sum()
        t -= 0.5 * r.sum() / (pos + neg).sum()
    p = 1 / (1 + np.exp(-(s * m + t)))
    order = np.argsort(-p)
    share = np.cumsum(pos[order]) / np.maximum(np.cumsum(pos[order] + neg[order]), 1e-9)
    ok = np.flatnonzero(share >= precision)
    threshold = float(max(0.5, p[order][ok[-1]])) if len(ok) else math.inf
    return Boosted(trees, (float(s), float(t)), threshold - 1e-9)


def train(rows: DataFrame, precision: float = 0.95) -> Boosted | None:
    c = rows.select("fold", F.explode("cands").alias("c")).where("c.label is not null")
    table = (c.groupBy(F.col("c.mask").alias("mask"), "fold")
             .agg(F.sum("c.label").alias("pos"), F.sum(F.lit(1) - F.col("c.label")).alias("neg")))
    return fit_boosted([tuple(r) for r in table.collect()], precision)  # one row per mask: at most 2**17


def find_pii(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: arrays of (k: place in KINDS, s, e) in order."""
    rows = keep(found(docs), "pii-found")
    model = train(rows, precision)
    base = F.concat(*[F.transform(f"base_{kind}", _placed(i)) for i, kind in enumerate(KINDS)])
    rows = rows.select("doc_id", base.alias("base"), "cands")
    if model is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    scored = F.transform("cands", lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"),
                                                     model.probability(c["mask"]).alias("p")))
    good = F.filter(scored, lambda c: (c["p"] >= model.threshold) & ~_touches(F.col("base"), c))
    rows = rows.withColumn("good", good)
    better = F.filter("good", lambda c: ~F.exists("good", lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"]) & (
        (o["p"] > c["p"]) | ((o["p"] == c["p"]) & (o["k"] < c["k"])))))
    added = F.transform(better, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def span_string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(
        ":", F.element_at(names, c["k"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """``doc_id, spans`` and the text with each span replaced by its kind in brackets
    (``doc_id`` must be unique here)."""
    got = find_pii(docs, precision).select("doc_id", "spans")
    j = docs.join(got, "doc_id")
    order = F.array_sort(F.transform("spans", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        inside = c["s"] < acc["pos"]
        return F.when(inside, acc).otherwise(F.struct(c["e"].alias("pos"), F.concat(
            acc["out"], F.substring("text", acc["pos"] + 1, c["s"] - acc["pos"]), F.element_at(names, c["k"] + 1)).alias("out")))
    done = F.aggregate(order, start, step)
    return j.withColumn("_r", done).withColumn("redacted", F.concat(
        F.col("_r.out"), F.expr("substring(text, _r.pos + 1)"))).drop("_r")
