"""Language identification in two levels: the family first, then the language within it.

Features are the counts of hashed sequences of one to three characters (lower-case letters; whatever is no
letter counts as one blank), as shares of a text's sequences. A one-versus-rest linear classifier chooses
the family; in it, linear support vector machines, one for each pair of languages, vote, and the sum of
margins breaks ties. All are fitted on a bounded sample: at most ``SAMPLE`` documents, shared evenly by
the languages, or ``LEAST`` of each if that is more; every whole text is scored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termscan.llm.common import durable, mix64, small_batches

#: Documents that a fit shares among the languages, and most of one language; every language gets ``LEAST`` if it has them.
SAMPLE, PER_LANGUAGE, LEAST = 2400, 600, 20
BITS = 13
COST, STEPS = 1e-5, 150
UNKNOWN = "und"
#: Families of language codes; all other codes are in one family together.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "ur", "bn", "pa", "gu", "mr", "ne", "si"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_letters: dict[str, np.ndarray] = {}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], "other")


def _is_letter() -> np.ndarray:
    if "all" not in _letters:
        _letters["all"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters["all"]


def counts(text: str) -> np.ndarray | None:
    """Shares of the hashed sequences of a text; none if it has no letter."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = _is_letter()[code.astype(np.int64)]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint64(32))
    code = code[letter | np.concatenate([[True], letter[:-1]])]  # one blank for a run of others
    total = np.zeros(1 << BITS)
    h = code
    for n in (1, 2, 3):
        if n > 1:
            if len(code) < n:
                break
            h = h[:-1] * np.uint64(0x110000) + code[n - 1 :]
        total += np.bincount((mix64(h + np.uint64(n << 62)) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return total / np.sqrt((total * total).sum())


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _sparse(batches):
    for batch in batches:
        langs, at, value = [], [], []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            x = counts(text)
            if x is not None:
                some = np.flatnonzero(x)
                langs.append(lang)
                at.append(some.astype(np.int32))
                value.append(x[some].astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["lang", "at", "value"])


def separate(x: np.ndarray, side: np.ndarray) -> np.ndarray:
    """A linear support vector machine (squared hinge, sides of equal weight); the last weight is the intercept."""
    sign = np.where(side, 1.0, -1.0)
    weight = np.where(side, 0.5 / max(1, side.sum()), 0.5 / max(1, (~side).sum()))
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        short = np.maximum(0.0, 1 - sign * (x @ w[:-1].astype(x.dtype) + w[-1]))
        pull = 2 * short * sign * weight
        g = COST * w - np.append(pull.astype(x.dtype) @ x, pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


class Model:
    """Families, their languages, and the weights of each separation."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs_of = np.array(langs, object)
        kin = np.array([family(lang) for lang in langs], object)
        self.families = sorted(set(kin))
        self.languages = {f: sorted(set(langs_of[kin == f])) for f in self.families}
        columns = [separate(x, kin == f) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {f: list(itertools.combinations(range(len(self.languages[f])), 2)) for f in self.families}
        self.first = {}
        for f in self.families:
            self.first[f] = len(columns)
            for a, b in self.pairs[f]:
                one, two = self.languages[f][a], self.languages[f][b]
                rows = (langs_of == one) | (langs_of == two)
                columns.append(separate(x[rows], langs_of[rows] == one))
        self.weights = np.array(columns).T if columns else np.zeros(((1 << BITS) + 1, 0))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = counts(text) if text and self.families else None
        if x is None:
            return UNKNOWN, 0.0
        margin = x @ self.weights[:-1] + self.weights[-1]
        sure = lambda m: 1 / (1 + np.exp(-4 * m))
        name, score = self.families[0], 1.0
        if len(self.families) > 1:
            own = margin[: len(self.families)]
            order = np.argsort(-own, kind="stable")
            name, score = self.families[order[0]], sure((own[order[0]] - own[order[1]]) / 2)
        langs = self.languages[name]
        votes, sums = np.zeros(len(langs)), np.zeros(len(langs))
        for (a, b), m in zip(self.pairs[name], margin[self.first[name] :], strict=False):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(langs)), key=lambda k: (votes[k], sums[k], -k))
        near = [m if a == best else -m for (a, b), m in zip(self.pairs[name], margin[self.first[name] :], strict=False) if best in (a, b)]
        return langs[best], float(score * (sure(min(near)) if near else 1.0))


def train(docs: DataFrame, learn: Column | None = None) -> Model:
    """A model from ``text`` and non-null ``lang`` of the rows for which ``learn`` holds; none of them is no error."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        known = known.where(learn)
    heads = durable(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n_languages = heads.count()
    if not n_languages:
        return Model(np.zeros((0, 1 << BITS)), [])
    each = max(LEAST, min(PER_LANGUAGE, SAMPLE // n_languages))
    # a hash below a share of its range thins the rows before they are ordered
    share = F.least(F.lit(1.0), 4.0 * each / F.col("n"))
    own = known.select("doc_id", "lang").join(heads, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.floor(share * (1 << 30)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)))
    ids = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("doc_id", "lang")
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    rows = durable(texts.mapInArrow(_sparse, "lang string, at array<int>, value array<float>"), "sequences").collect()  # SAMPLE rows, or LEAST of each language
    rows = sorted(rows, key=lambda r: (r.lang, r.at))
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, r in enumerate(rows):
        x[k, r.at] = r.value
    return Model(x, [r.lang for r in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row.

    A text that is null or has no letter, and any text if no language was learnt, is ``und`` with score
    0. A null id is not held out. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # plain values: what is broadcast is read back without this package, which executors may lack
    shared = spark.sparkContext.broadcast(vars(model))

    def run(batches):
        own = Model.__new__(Model)
        vars(own).update(shared.value)
        for batch in batches:
            found = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
