"""Document fingerprints by consistent weighted sampling, all in built-in functions.

A text's terms are its tokens (lower case, parted by white space), weighted by how often they stand. For
each of ``SAMPLES`` samples a term gets r and c from Gamma(2, 1) and b from [0, 1), all from keyed
hashes of the term; with t = floor(ln w / r + b) its value is ln c - r (t - b + 1), and the sample is the
(term, t) of the least value. Two texts agree in a sample with the probability of their generalised
Jaccard similarity, the sum of the smaller weights over the sum of the greater ones.

A fingerprint is a string of 16 hexadecimal digits per sample: value and (term, t) in one number, so that
taking the least is taking a minimum of longs. A text without tokens has an empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termscan.llm.common import durable

SAMPLES = 32
#: Samples that one row of a term stands for.
CHUNK = 4
_DIGITS = 16
_LOW = (1 << 29) - 1


def _uniforms(term: Column, key: Column) -> list[Column]:
    """Three numbers in (0, 1), of 21 bits each, from one keyed hash."""
    h = F.xxhash64(term, key)
    bits = [F.shiftrightunsigned(h, shift).bitwiseAND((1 << 21) - 1) for shift in (0, 21, 42)]
    return [(x.cast("double") + F.lit(0.5)) / F.lit(float(1 << 21)) for x in bits]


def samples(term: Column, logs: dict[str, Column], first: Column, n: int) -> dict[str, list[Column]]:
    """For each weight, of which ``logs`` has the logarithm, the packed values of a term in ``n`` samples from ``first`` on."""
    out: dict[str, list[Column]] = {name: [] for name in logs}
    for k in range(n):
        u, v, b = _uniforms(term, 2 * (first + k))
        r = -F.log(u * v)
        u, v, _ = _uniforms(term, 2 * (first + k) + 1)
        ln_c = F.log(-F.log(u * v))
        for name, log_w in logs.items():
            t = F.floor(log_w / r + b)
            value = ((ln_c - r * (t - b + 1.0) + 128.0) * float(1 << 26)).cast("long")
            own = (term.bitwiseAND(_LOW) + t * 1_000_003).bitwiseAND(_LOW)
            out[name].append(value * (1 << 29) + own)
    return out


def fingerprints(
    rows: DataFrame, keys: list[str], texts: list[str], facts: dict[str, Column] | None = None, n: int = SAMPLES, pieces: dict[str, list[str]] | None = None
) -> DataFrame:
    """``keys``, one fingerprint ``fp_<text>`` per named text, and the ``facts``, longs that each row has.

    ``rows`` must be spread by the first key: then nothing is shuffled. Facts ride along as rows of a kind
    of their own, so the texts are read once and a row without tokens still has its result. Texts that
    share a piece, parted from the rest by white space, need it once: ``pieces`` tells for each column
    of text which of ``texts`` it belongs to. ``n`` is a multiple of ``CHUNK``: each term stands for
    that many samples per row, as code for all of them at once is too long to be compiled.
    """
    facts, pieces = facts or {}, pieces or {c: [c] for c in texts}
    token = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", -1), lambda w: w != "")
    marked = lambda c, i: F.transform(token(c), lambda w: F.struct(F.xxhash64(w).alias("term"), F.lit(i).alias("kind")))
    told = F.array(*[F.struct(x.cast("long").alias("term"), F.lit(-1 - k).alias("kind")) for k, x in enumerate([F.lit(0), *facts.values()])])
    each = F.explode(F.concat(told, *[marked(c, i) for i, c in enumerate(pieces)]))
    terms = rows.select(*keys, each.alias("t")).select(*keys, "t.*").withColumn("fact", F.least("kind", F.lit(0)))
    within = lambda c: F.col("kind").isin([i for i, of in enumerate(pieces.values()) if c in of])
    counted = terms.groupBy(*keys, "fact", "term").agg(*[F.sum(F.when(within(c), 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(texts)])
    logs = counted.select(*keys, "fact", "term", *[F.when(F.col(f"n{i}") > 0, F.log(F.col(f"n{i}").cast("double"))).alias(f"log{i}") for i in range(len(texts))])
    chunks = logs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n // CHUNK - 1))))
    packed = samples(F.col("term"), {c: F.col(f"log{i}") for i, c in enumerate(texts)}, F.col("chunk") * CHUNK, CHUNK)
    least = chunks.groupBy(*keys, "chunk").agg(
        *[F.min(x).alias(f"{c}_{k}") for c, xs in packed.items() for k, x in enumerate(xs)],
        *[F.max(F.when(F.col("fact") == -2 - k, F.col("term"))).alias(f) for k, f in enumerate(facts)])
    digits = lambda x: F.lpad(F.lower(F.hex(x)), _DIGITS, "0")
    parts = least.select(*keys, "chunk", *facts, *[
        F.when(F.col(f"{c}_0").isNull(), F.lit("")).otherwise(F.concat(*[digits(F.col(f"{c}_{k}")) for k in range(CHUNK)])).alias(f"fp_{c}")
        for c in texts])
    return parts.groupBy(*keys).agg(*[F.max(f).alias(f) for f in facts], *[
        F.concat(*[F.max(F.when(F.col("chunk") == k, F.col(f"fp_{c}"))) for k in range(n // CHUNK)]).alias(f"fp_{c}") for c in texts])


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree; 1 for two empty ones, 0 for one empty one."""
    piece = lambda x, k: F.substring(x, k * _DIGITS + 1, _DIGITS)
    same = sum((F.when(piece(a, k) == piece(b, k), 1).otherwise(0) for k in range(1, n)), F.when(piece(a, 0) == piece(b, 0), 1).otherwise(0))
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).otherwise(same / F.lit(float(n)))


def _ranges(docs: DataFrame, parts: int) -> Column:
    """The place of ``doc`` among ``parts`` ranges of about equal numbers of documents, by binary search."""
    split = docs.agg(F.percentile_approx("doc", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in split]).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in range(max(len(split), 1).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(bounds, at + step - 1) <= F.col("doc"), F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc, version, text`` with ``range``, ``next_doc`` and ``next_text``: the document of the next smaller id.

    After the last comes the first. Ids are cut into ranges, each ordered by itself; the last row of a
    range takes the first of the next range, of which there are as many as ranges. Rows with a null id
    are in no order: they follow themselves. Of rows that repeat an id, the smallest text stands for it.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc").where("doc IS NOT NULL")
    located = docs.withColumn("range", F.when(F.col("doc").isNull(), F.lit(-1) - F.pmod("version", F.lit(parts))).otherwise(_ranges(ids, parts)))
    heads = located.where("doc IS NOT NULL").groupBy("range").agg(F.max("doc").alias("head")).collect()  # one row per range
    ordered = sorted((r.range, r.head) for r in heads)
    after = [(here, ordered[k - 1][1]) for k, (here, _) in enumerate(ordered)]
    follow = spark.createDataFrame(after, "range int, head long")
    head_texts = docs.join(F.broadcast(follow), F.col("doc") == F.col("head")).groupBy("range", "head").agg(F.min("text").alias("head_text"))
    order = Window.partitionBy("range").orderBy(F.col("doc").desc(), F.col("text"))
    # equal ids stand together, smallest text first: the next row with another id is what follows
    located = located.repartition(parts, "range")  # small parts: what a task counts later must fit in memory
    rows = located.withColumns({"d1": F.lead("doc").over(order), "t1": F.lead("text").over(order)})
    repeated = ids.groupBy("doc").count().where("count > 1")
    if not repeated.isEmpty():
        located = located.dropDuplicates(["range", "doc", "version"])  # equal rows count once; spread by range already
        single = located.where("doc IS NOT NULL").groupBy("range", "doc").agg(F.min("text").alias("text"))
        lone = Window.partitionBy("range").orderBy(F.col("doc").desc())
        single = single.withColumns({"d1": F.lead("doc").over(lone), "t1": F.lead("text").over(lone)}).drop("text")
        rows = located.join(single, ["range", "doc"], "left")
    rows = rows.join(head_texts, "range", "left")
    alone = F.col("doc").isNull()
    return rows.select(
        "range", "doc", "version", "text",
        F.when(alone, F.col("doc")).otherwise(F.coalesce("d1", "head")).alias("next_doc"),
        F.when(alone, F.col("text")).when(F.col("d1").isNotNull(), F.col("t1")).otherwise(F.col("head_text")).alias("next_text"))


def edited_fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs``: fingerprints of its text and of its edited text, and what they are like.

    The edited text has its last third replaced by the start of the next document's. A null text counts
    as empty. Rows equal in id and text are equal in every column. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    rows = with_next(base)
    n_chars = F.length("text")
    cut = F.floor(n_chars / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, length(text) - floor(length(text) / 3))"), F.substring("next_text", F.lit(1), cut)))
    keys = ["range", "doc", "version"]
    sha = F.sha2("edited", 256)
    facts = {"n_chars": n_chars, "next_doc": F.col("next_doc"), "next_version": F.xxhash64("next_text")}
    facts |= {f"sha{k}": F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10) for k in range(4)}
    # both texts have the first words in common: those are read and counted once
    rows = rows.withColumn("common", F.regexp_extract(F.expr("left(text, length(text) - floor(length(text) / 3))"), r"(?s)^.*\s", 0))
    rest = lambda c: F.substring(c, F.length("common") + 1, F.length(c))
    rows = rows.withColumns({"own": rest("text"), "new": rest("edited")})
    pieces = {"common": ["text", "edited"], "own": ["text"], "new": ["edited"]}
    prints = durable(fingerprints(rows, keys, ["text", "edited"], facts, n, pieces), "prints")
    # one row per distinct id and text; rows that repeat both get it each
    own = base.select(F.col("doc").alias("d"), F.col("version").alias("v")).groupBy("d", "v").agg(F.count(F.lit(1)).alias("copies"))
    whole = prints.join(own, prints["doc"].eqNullSafe(F.col("d")) & (prints["version"] == F.col("v")))
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc", "version", "n_chars", "next_doc", "next_version",
        F.lower(F.concat(*[F.lpad(F.hex(F.col(f"sha{k}")), 16, "0") for k in range(4)])).alias("edited_sha256"),
        F.col("fp_text").alias("fingerprint"), F.col("fp_edited").alias("edited_fingerprint"))
    next_print = prints.select("doc", "version", F.col("fp_text").alias("next_print")).dropDuplicates(["doc", "version"])
    joined = whole.alias("a").join(
        next_print.alias("b"), (F.col("a.next_doc").eqNullSafe(F.col("b.doc"))) & (F.col("a.next_version") == F.col("b.version")), "left")
    return joined.select(
        F.col("a.doc").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), n).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_print", F.lit("")), n).alias("near_next"))
