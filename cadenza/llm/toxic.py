"""Operator 7, toxicity: cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(t_k - w.x)`` with ordered thresholds ``t_k`` and one
weight vector shared by all of them; ``x`` marks which selected words and word
beginnings (of 3 to 8 letters, for inflected languages) a text has.  The
expected severity is the sum over k of ``P(grade > k)``.

Training uses at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id (all,
where there are fewer).  Their words and beginnings are counted by grade; those
with a significant chi-square are the features (at most ``FEATURES``).  The fit
runs over the sparse sample matrix of those features, a bounded table.  Scoring reads every
whole text once, in Arrow batches, and moves nothing.

Cases: null and empty texts have no features and get the base severity; a word
counts once per text, however long; labels without grade, or repeated for a
doc_id, are dropped or reduced to the highest grade; without labelled rows the
model has no features and rejects nothing; repeated rows are scored each;
further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import arrow_ready, keep, shield, text_of, unshield
from cadenza.llm.words import pieces, words

SAMPLE = 20_000
FEATURES = 4096
MIN_CHI2 = 15.0
MIN_SHARE = 0.5          # of the texts with a feature, this part must have grade TOP
MIN_TEXTS, PART_TEXTS = 3, 5e-4   # a feature is in so many sampled texts, and this part of them
TOP = 2                  # texts of this grade or above are the ones to reject
PRIOR_TEXTS = 8          # weight of the smoothing of log odds, in texts
STEMS = (3, 4, 5, 6, 7, 8)


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int,
                l2: float = 1.0, steps: int = 800, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """The cumulative-link model with the largest posterior (Adam).  ``rows, cols``: the
    ones of a sparse 0/1 matrix.  The prior of a weight is normal around the smoothed
    log odds ratio of its feature, so that one clear word counts even though most
    graded texts have several.  Thresholds are sums of exponentials, hence ordered."""
    n, k = len(grade), n_grades - 1
    share = np.array([(grade <= j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    t0 = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(k))
    free = np.concatenate([t0[:1], np.log(np.maximum(np.diff(t0), 1e-3))])
    bad = np.bincount(cols, grade[rows] >= TOP, n_features)
    good = np.bincount(cols, minlength=n_features) - bad
    odds = (grade >= TOP).mean().clip(1e-4, 1 - 1e-4)
    prior = np.log((bad + PRIOR_TEXTS * odds) / (good + PRIOR_TEXTS * (1 - odds))) - np.log(odds / (1 - odds))
    p = np.concatenate([prior, free])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, f = p[:n_features], p[n_features:]
        t = np.concatenate([f[:1], f[0] + np.cumsum(np.exp(f[1:]))])
        s = np.bincount(rows, w[cols], n)
        cut = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = _sigmoid(cut[grade + 1] - s), _sigmoid(cut[grade] - s)
        lik = np.maximum(hi - lo, 1e-12)
        ghi, glo = hi * (1 - hi) / lik, lo * (1 - lo) / lik       # d log lik / d upper, lower cut
        ds = ghi - glo                                            # d (-log lik) / d s
        gt = np.bincount(grade, -ghi, n_grades)[:k] + np.bincount(grade, glo, n_grades)[1:]
        gf = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(f[j]) for j in range(1, k)]])
        g = np.concatenate([np.bincount(cols, ds[rows], n_features) + l2 * (w - prior), gf]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    f = p[n_features:]
    return p[:n_features], np.concatenate([f[:1], f[0] + np.cumsum(np.exp(f[1:]))])


def distinct_words(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    t = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.array_distinct(F.filter(F.split(t, " "), lambda x: x != ""))


def feature_array(w: Column) -> Column:
    """The words of a column, and their beginnings (``abcd*``).  ``w`` is read once a stem length: it has to be
    a column of its own, since lambdas share nothing and would cut the text again each time."""
    def stems(n: int) -> Column:
        return F.transform(F.filter(w, lambda x: F.length(x) >= n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))
    return F.array_distinct(F.concat(w, *[stems(n) for n in STEMS]))


def _features(own: DataFrame) -> DataFrame:
    """``row, grade, words`` of ``row, grade, text``: each text is cut once."""
    cut = own.select("row", "grade", distinct_words(text_of()).alias("_w"))
    return cut.select("row", "grade", feature_array(F.col("_w")).alias("words"))


def _chain(x: str) -> list[str]:
    """The beginnings of a feature, longest first."""
    body, own = (x[:-1], len(x) - 1) if x.endswith("*") else (x, len(x) + 1)
    return [body[:n] + "*" for n in reversed(STEMS) if n < own and len(body) >= n]


def _strongest(chi2: dict[str, float]) -> list[str]:
    """Of nested features (a word and its beginnings) those with the largest
    chi-square; at a tie the longer one."""
    beaten = set()
    for x, c in chi2.items():
        for s in _chain(x):
            if s in chi2:
                beaten.add(x if chi2[s] > c else s)
    return [x for x in chi2 if x not in beaten]


def train(docs: DataFrame, labels: DataFrame, n_grades: int = 3, sample: int = SAMPLE,
          features: int = FEATURES) -> OrdinalModel:
    """``labels``: ``doc_id, grade`` (0 good ... TOP and above toxic)."""
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
           .groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most `sample` pairs of numbers: broadcast, so that texts stay where they are
    own = (docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
           .select(F.xxhash64("text").alias("row"), "grade", "text")
           .dropDuplicates(["row", "grade"]))       # a text with many copies teaches once, and its features are found after
    own = keep(_features(own), "toxic-sample")
    size = {r["grade"]: r["count"] for r in own.groupBy("grade").count().collect()}
    n, bad = sum(size.values()), sum(c for g, c in size.items() if g >= TOP)
    model = OrdinalModel({}, [35.0 + j for j in range(n_grades - 1)])
    if not bad or bad == n:
        return model
    seen = (own.select(F.explode("words").alias("word"), (F.col("grade") >= TOP).cast("int").alias("b"))
            .groupBy("word").agg(F.sum("b").alias("bad"), F.count(F.lit(1)).alias("df")))
    a, df = F.col("bad").cast("double"), F.col("df").cast("double")
    chi2 = n * F.pow(a * n - df * bad, 2) / (df * (n - df + 1e-9) * bad * (n - bad))
    least = max(MIN_TEXTS, int(np.ceil(n * PART_TEXTS)))
    top = (seen.where((F.col("df") >= least) & (a >= MIN_SHARE * df)).withColumn("chi2", chi2)
           .where(F.col("chi2") >= MIN_CHI2)
           .orderBy(F.desc("chi2"), "word").limit(features).select("word", "chi2").collect())
    vocab = {x: i for i, x in enumerate(_strongest({r["word"]: r["chi2"] for r in top}))}
    if not vocab:
        return model
    lit = F.array(*[F.lit(x) for x in vocab])
    got = own.select("grade", F.array_intersect("words", lit).alias("w")).collect()  # <= sample rows
    grade = np.array([min(r["grade"], n_grades - 1) for r in got])
    rows = np.repeat(np.arange(len(got)), [len(r["w"]) for r in got])
    cols = np.array([vocab[x] for r in got for x in r["w"]], dtype=np.int64)
    w, t = fit_ordinal(rows, cols, grade, len(vocab), n_grades)
    return OrdinalModel({x: float(w[i]) for x, i in vocab.items()}, [float(x) for x in t])


def _scores(model: OrdinalModel, cols: list[str]):
    t = np.array(model.thresholds)
    number = {x: i for i, x in enumerate(model.weights)}
    weight = np.array([*model.weights.values(), 0.0])
    none = len(number)

    def found(vocab: list[str]) -> np.ndarray:
        """Per word: the numbers of its features (the word, its beginnings) or ``none``."""
        out = np.full((1 + len(STEMS), len(vocab)), none, np.int64)
        out[0] = [number.get(x, none) for x in vocab]
        for j, n in enumerate(STEMS, 1):
            out[j] = [number.get(x[:n] + "*", none) if len(x) >= n else none for x in vocab]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                idx, vocab, off = words(part.column("text"))
                pair = []
                for feature in found(vocab.to_pylist()):
                    hit = np.flatnonzero(feature[idx] != none) if len(idx) else np.zeros(0, np.int64)
                    doc = np.searchsorted(off, hit, side="right") - 1
                    pair.append(doc * (none + 1) + feature[idx[hit]])
                pair = np.unique(np.concatenate(pair))
                s = np.bincount(pair // (none + 1), weight[pair % (none + 1)], part.num_rows)
                above = 1 - _sigmoid(t[None, :] - s[:, None])           # P(grade > k)
                by = np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1) * -1, axis=1)
                out = [part.column(c) for c in cols]
                out += [pa.array(above.sum(axis=1)), pa.array(above[:, TOP - 1]), pa.array(by.argmax(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, [*cols, "severity", "p_toxic", "grade"])
    return run


def score(docs: DataFrame, model: OrdinalModel, cut: float = 0.5) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``p_toxic`` (grade TOP or above),
    ``grade`` (most likely) and ``rejected`` (``p_toxic >= cut``)."""
    arrow_ready(docs.sparkSession)
    docs = docs.drop("severity", "p_toxic", "grade", "rejected")
    more = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType())]
    out = docs.mapInArrow(_scores(model, docs.columns), T.StructType([*docs.schema.fields, *more]))
    return out.withColumn("rejected", F.col("p_toxic") >= cut)


def grades(labels: DataFrame) -> DataFrame:
    """Ordered grades of the 0/1 labels: 0 good, 1 poor but not toxic, 2 toxic."""
    toxic, good = F.col("toxic"), F.coalesce(F.col("quality"), F.lit(1))
    return labels.select("doc_id", F.when(toxic == 1, 2).when(toxic == 0, 1 - good).alias("grade"))


def drop_toxic(docs: DataFrame, model: OrdinalModel, cut: float = 0.5) -> DataFrame:
    """The rows that are not rejected, with the columns of ``docs``."""
    own = ("doc_id", "text")
    return unshield(score(shield(docs, *own), model, cut).where("not rejected"), docs, *own)
