"""Toxicity: a classifier that is trained not to react to which group a text mentions.

A text's features are the distinct words in it (lower case) and their beginnings of four to six letters.
From a bounded sample of labelled documents, features that stand unevenly often in toxic and other
documents (by the log-likelihood ratio) are chosen; a logistic regression on them is fitted with a
counterfactual penalty: in each sampled sentence that names an identity term, the term is swapped for the
others of its group, and the squared change of the score (in logits) is added to the loss. So terms that
merely go along with toxic documents get weights that make no difference between groups.

Training reads at most ``SAMPLE`` documents of either label; scoring reads every whole text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.llm.common import durable, small_batches

#: Labelled documents of either label, features and counterfactual pairs that a fit uses at most.
SAMPLE, FEATURES, PAIRS = 2000, 4096, 20_000
#: Signed root of the log-likelihood ratio from which a feature is used.
EVIDENCE = 3.6
RIDGE, FAIRNESS, STEPS = 2e-4, 1.0, 400
THRESHOLD = 0.3
#: Identity terms by group: a term is swapped for the others of its line.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young", "elderly"),
    ("disabled", "blind", "deaf"),
)
_GROUP = {term: line for line in IDENTITIES for term in line}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[str]:
    """A word (in lower case) and its beginnings; the beginnings end in a star."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def swaps(text: str):
    """For each sentence that names identity terms: its features, and those after each swap."""
    for sentence in _SENTENCE.findall(text.lower()):
        words = set(_WORD.findall(sentence))
        for term in sorted(words & _GROUP.keys()):
            rest = words - {term}
            for other in _GROUP[term]:
                if other != term:
                    yield rest | {term}, rest | {other}


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _counted(batches):
    for batch in batches:
        seen = [Counter(), Counter()]
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen[toxic].update(features(text))
        names = [f for c in seen for f in c]
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([n for n in seen[0].values()] + [0] * len(seen[1]), pa.int64()),
            pa.array([0] * len(seen[0]) + [n for n in seen[1].values()], pa.int64())], ["feature", "clean", "toxic"])


def _designed(chosen):
    def run(batches):
        place = {f: k for k, f in enumerate(chosen)}
        for batch in batches:
            rows, labels, swapped = [], [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                rows.append(sorted(place[f] for f in features(text) if f in place))
                labels.append(toxic)
                pairs = set()
                for one, other in swaps(text):
                    a, b = ({place[f] for w in side for f in word_features(w) if f in place} for side in (one, other))
                    if a != b:
                        pairs.add((tuple(sorted(a - b)), tuple(sorted(b - a))))
                swapped.append([[list(x) for x in p] for p in sorted(pairs)])
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, pa.list_(pa.int32())), pa.array(labels, pa.int32()),
                pa.array(swapped, pa.list_(pa.list_(pa.list_(pa.int32()))))], ["features", "toxic", "swaps"])

    return run


def _sum_rows(at: list[list[int]], weights: np.ndarray) -> np.ndarray:
    size = np.array([len(x) for x in at])
    flat = np.fromiter((i for x in at for i in x), np.int64, int(size.sum()))
    return np.bincount(np.repeat(np.arange(len(at)), size), weights[flat], len(at))


def fit(rows: list[list[int]], labels: np.ndarray, swapped: list[tuple[list[int], list[int]]], width: int, share: float = 0.5, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression with the counterfactual penalty, by momentum descent.

    ``share`` is the share of label 1 among all labelled rows, of which these are a sample by label.
    """
    size = np.array([len(x) for x in rows])
    of = np.repeat(np.arange(len(rows)), size)
    flat = np.fromiter((i for x in rows for i in x), np.int64, int(size.sum()))
    left, right = [p[0] for p in swapped], [p[1] for p in swapped]
    ls, rs = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    lf, rf = (np.fromiter((i for x in side for i in x), np.int64, int(s.sum())) for side, s in ((left, ls), (right, rs)))
    lo, ro = (np.repeat(np.arange(len(swapped)), s) for s in (ls, rs))
    weight = np.where(labels == 1, share / max(1, labels.sum()), (1 - share) / max(1, (1 - labels).sum()))
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(of, w[flat], len(rows)) + b
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        grad = np.bincount(flat, miss[of], width) + RIDGE * w
        if len(swapped):
            change = np.bincount(lo, w[lf], len(swapped)) - np.bincount(ro, w[rf], len(swapped))
            change *= 2 * fairness / len(swapped)
            grad += np.bincount(lf, change[lo], width) - np.bincount(rf, change[ro], width)
        g = np.append(grad, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """The signed root of the log-likelihood ratio that a feature's share is the same in both labels."""
    share = (toxic + clean) / (n_toxic + n_clean)

    def part(k: int, n: int) -> float:
        return (k * math.log(k / (n * share)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - share))) if n > k and share < 1 else 0.0)

    ratio = 2 * (part(toxic, n_toxic) + part(clean, n_clean))
    return math.copysign(math.sqrt(max(0.0, ratio)), toxic * n_clean - clean * n_toxic)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> tuple[dict[str, float], float]:
    """Feature weights and the intercept, from labelled rows of ``docs`` for which ``learn`` holds.

    Rows with a null id, text or label, and labels other than 0 and 1, are not learnt from; of labels
    that repeat an id, the greatest counts. With no rows of one label the model is its base rate.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    all_of = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 0").orderBy(order).limit(SAMPLE).union(known.where("toxic = 1").orderBy(order).limit(SAMPLE))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = durable(texts.join(F.broadcast(picked), "doc_id").select("text", "toxic"), "labelled")  # 2 * SAMPLE ids
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return {}, -8.0 if not n_toxic else 8.0
    counts = rows.mapInArrow(_counted, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 3")
    share = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)

    def part(k: Column, n: int) -> Column:
        held = F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
        return held + F.when((k < n) & (share < 1), (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)

    strength = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(F.col("toxic"), n_toxic) + part(F.col("clean"), n_clean))))
    best = counts.withColumn("strength", strength).where(F.col("strength") >= EVIDENCE).orderBy(F.desc("strength"), "feature").limit(FEATURES)
    chosen = [r.feature for r in best.select("feature").collect()]
    terms = [f for line in IDENTITIES for term in line for f in word_features(term)]
    chosen = list(dict.fromkeys(chosen + terms))
    got = rows.mapInArrow(_designed(chosen), "features array<int>, toxic int, swaps array<array<array<int>>>").collect()  # bounded as above
    pairs = {(tuple(a), tuple(b)) for r in got for a, b in r.swaps}
    pairs = sorted(pairs, key=lambda pair: hashlib.sha256(repr(pair).encode()).digest())[:PAIRS]  # any of them alike
    w, b = fit([r.features for r in got], np.array([r.toxic for r in got]), pairs, len(chosen), all_of[1] / (all_of[0] + all_of[1]))
    return {f: float(x) for f, x in zip(chosen, w, strict=True) if x}, float(b)


def _scored(model):
    weights, base = model

    def run(batches):
        known: dict[str, list[str]] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found: set[str] = set()
                for word in set(_WORD.findall((text or "").lower())):
                    use = known.get(word)
                    if use is None:
                        if len(known) > 500_000:
                            known.clear()
                        use = known[word] = [f for f in word_features(word) if f in weights]
                    if use:
                        found.update(use)
                z = base + math.fsum(weights[f] for f in found)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; a null text counts as empty, a null id is not held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return rows.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic; all columns stay.

    Only ``text`` is looked at: a null one counts as empty, rows with null or repeated ids are rows like any
    other, equal texts go or stay together, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], ["doc_id", "text"])
            found = next(iter(_scored(model)([texts]))).column("score").to_numpy()
            yield batch.filter(pa.array(found < THRESHOLD))

    return docs.mapInArrow(run, schema)
