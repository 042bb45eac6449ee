"""Personal data: high-recall generators propose spans, boosted trees judge them, calibrated thresholds select.

Base spans follow fixed patterns and checks and always stay. The generators also propose spelled-out
addresses (``name (at) host (dot) net``), dotted and bracketed numbers, and runs of digits with or without
a country code; proposals overlap, and one run may be proposed as several kinds. Gradient-boosted trees
see the format of a span and the words around it. They are fitted here, on spans that a rule writes
(known kind, genuine or not), so that a fit costs the same whatever is scanned; the threshold of each
kind is the lowest that reaches ``PRECISION`` on the fifth of them that is held out. Of overlapping
selected spans the most probable stays; one that overlaps a base span goes.

Everything is built-in functions and Spark's own trees; only spans are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.llm.common import durable

#: Kinds in the order in which spans are listed, and the base pattern of each. Loops are
#: possessive and start where a run of characters starts: same matches, time linear in the text.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of this has no base span of that kind.
GATE = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Proposals: (kinds, pattern, cheap test that must hold before).
_AT, _DOT = r"(?: ?(?:\(at\)|\[at\]|\{at\}|@) ?)", r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?|\.)"
GENERATORS = (
    (("email",), rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[A-Z0-9-]++(?:{_DOT}[A-Z0-9-]++)*+", r"@|(?i)[\(\[\{]at[\)\]\}]"),
    (("ip",), r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}+){3}(?![0-9.]?[0-9])", r"[0-9][\[(]?\.[\])]?[0-9]"),
    (("card", "phone"), r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[ ().\-/]{0,2}+[0-9]){6,18}+(?![0-9A-Za-z])", r"[0-9][ ().\-/]{0,2}[0-9]"),
)
#: Digits that a proposal of a kind has.
DIGITS = {"email": (0, 1 << 20), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}
CONTEXT = 24
TREES, DEPTH, SPANS, PRECISION = 12, 4, 4000, 0.98
NAMES = [
    "kind_no", "digits", "chars", "luhn", "plus", "brackets", "groups", "first", "blanks", "dashes", "dots", "slashes",
    "at", "spelled", "ending", "octets", "zero", "call", "pay", "net", "other", "glued",
]
_SPAN = "array<struct<lo:int,hi:int,s:string>>"


def _found(text: Column, pattern: Column) -> Column:
    """``(lo, hi, s)`` of the leftmost non-overlapping matches, in code points."""
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    step = F.slice(F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("s"), F.length(g).alias("gap"))), F.lit(1), F.size(hits))
    return F.aggregate(
        step, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["s"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("lo"), (acc["at"] + x["gap"] + F.length(x["s"])).alias("hi"), x["s"].alias("s")))).alias("out")),
        lambda acc: acc["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    one = lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + one(i) - F.when(one(i) > 9, 9).otherwise(0))
    return (F.length(digits) > 1) & (total % 10 == 0)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _valid(kind: str, s: Column) -> Column:
    digits = _digits(s)
    return {
        "email": F.lit(True),
        "ip": F.regexp_like(s, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "card": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False)),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def describe(text: Column, lo: Column, hi: Column, kind: Column) -> list[Column]:
    """What the trees see of a span, one double for each of ``NAMES``."""
    s = F.substring(text, lo + 1, hi - lo)
    before = F.lower(F.substring(text, F.greatest(lo - CONTEXT, F.lit(0)) + 1, F.least(lo, F.lit(CONTEXT))))
    around = F.concat(before, F.lit(" "), F.lower(F.substring(text, hi + 1, F.lit(CONTEXT))))
    digits = _digits(s)
    count = lambda p: F.regexp_count(s, F.lit(p))
    near = lambda p, where=around: F.regexp_like(where, F.lit(p))
    sizes = F.filter(F.split(s, "[^0-9]+", -1), lambda g: g != "")
    out = [
        F.array_position(F.array(*map(F.lit, KINDS)), kind), F.length(digits), F.length(s),
        F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False)),
        F.startswith(s, F.lit("+")), count(r"[()]"), F.size(sizes), F.length(F.coalesce(F.get(sizes, F.lit(0)), F.lit(""))),
        count(" "), count("-"), count(r"\."), count("/"), count("@"), count(r"(?i)[(\[{](?:at|dot)[)\]}]"),
        F.length(F.regexp_extract(s, r"(?i)(?:\.|[(\[{]dot[)\]}] ?)([a-z]+)$", 1)),
        F.regexp_like(F.regexp_replace(s, r"[\[\]()]", ""), F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")), F.startswith(digits, F.lit("0")),
        near(r"tel|phone|call|fax|mobile|cell|dial|ring"), near(r"card|visa|master|amex|credit|pay"), near(r"\bip\b|host|server|address|mail|contact"),
        near(r"version|\bv$|order|invoice|isbn|serial|total|page|section|date|build|token|\$|€|#"),
        near("[0-9a-z]$", before),
    ]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in out]


def written_spans(spark: SparkSession, n: int = SPANS) -> DataFrame:
    """``n`` labelled spans by rule: ``id, kind, text, lo, hi, label``; digits and words come from keyed hashes."""
    def pick(key: int, below: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(key)), F.lit(below))

    def some(key: int, size: int) -> Column:
        return F.lpad(pick(key, 10**size).cast("string"), size, "0")

    def word(key: int) -> Column:
        return F.get(F.array(*map(F.lit, ("anna", "j.doe", "lee", "office", "sales7", "north", "k_smith", "mira", "post", "web12"))), pick(key, 10).cast("int"))

    def octet(key: int, below: int = 256) -> Column:
        return pick(key, below).cast("string")

    body = F.concat(F.lit("4"), some(1, 14))
    check = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), luhn), F.lit(0))
    wrong = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda s: ~luhn(s)), pick(2, 9).cast("int"))
    four = lambda s, gap: F.regexp_replace(s, "(....)(?=.)", f"$1{gap}")
    quad = lambda gap, below=256: F.concat_ws(gap, *[octet(k, below) for k in (3, 4, 5, 6)])
    host = F.concat(word(7), F.lit("."), F.get(F.array(*map(F.lit, ("com", "org", "net", "example"))), pick(8, 4).cast("int")))
    cat, lit = F.concat, F.lit
    forms = [
        ("email", 1, cat(word(9), lit("@"), host)), ("email", 1, cat(word(9), lit(" (at) "), word(7), lit(" (dot) com"))),
        ("email", 1, cat(word(9), lit("[at]"), host)), ("email", 0, cat(word(9), lit("@"), word(7))),
        ("email", 0, cat(some(10, 2), lit(" @ "), some(11, 1), lit("."), some(12, 2))), ("email", 0, cat(word(9), lit("@"), some(11, 3))),
        ("ip", 1, quad(".")), ("ip", 1, quad("[.]")), ("ip", 0, cat(lit("3"), some(12, 2), lit("."), quad("."))),
        ("ip", 0, F.concat_ws(".", *[(pick(k, 600) + 256).cast("string") for k in (3, 4, 5, 6)])),
        ("card", 1, check), ("card", 1, four(check, " ")), ("card", 1, four(check, "-")), ("card", 0, wrong), ("card", 0, four(wrong, " ")),
        ("card", 0, cat(lit("+1 ("), some(13, 3), lit(") "), some(14, 3), lit("-"), some(15, 7))),
        ("card", 0, cat(some(13, 3), lit("-"), some(14, 3), lit("-"), some(15, 8))), ("card", 0, some(13, 13)), ("card", 0, cat(some(14, 4), lit("-"), some(15, 2), lit("-"), some(16, 2), lit(" "), some(17, 4))),
        ("phone", 1, cat(lit("+1 ("), some(13, 3), lit(") "), some(14, 3), lit("-"), some(15, 4))),
        ("phone", 1, cat(lit("+4"), some(13, 1), lit(" "), some(14, 2), lit(" "), some(15, 4), lit(" "), some(16, 4))),
        ("phone", 1, cat(lit("("), some(13, 3), lit(") "), some(14, 3), lit("-"), some(15, 4))),
        ("phone", 1, cat(some(13, 3), lit("-"), some(14, 3), lit("-"), some(15, 4))),
        ("phone", 0, cat(lit("20"), some(13, 2), lit("-0"), some(14, 1), lit("-1"), some(15, 1))), ("phone", 0, some(13, 12)),
        ("phone", 0, cat(some(13, 3), lit("."), some(14, 4), lit("/"), some(15, 3))), ("phone", 0, check), ("phone", 0, cat(some(13, 4), lit(" "), some(14, 4))),
    ]
    lead = {
        "email": ("mail me at ", "contact: ", "said ", "see ", "and "), "ip": ("server ", "from host ", "address ", "via ", "the "),
        "card": ("card ", "paid with ", "visa: ", "number ", "was "), "phone": ("call ", "tel. ", "phone: ", "fax ", "or "),
    }
    wary = ("version ", "order ", "invoice #", "serial ", "total ", "in ", "token ")
    form = pick(18, len(forms)).cast("int")
    chosen = F.get(F.array(*[F.struct(lit(k).alias("kind"), lit(y).alias("label"), s.alias("s")) for k, y, s in forms]), form)
    rows = spark.range(0, n, 1, 2).select("id", chosen.alias("x")).select("id", "x.*").where("s IS NOT NULL")
    good = F.element_at(F.create_map(*[z for k, v in lead.items() for z in (lit(k), F.array(*map(lit, v)))]), F.col("kind"))
    before = F.when((F.col("label") == 1) | (pick(19, 3) == 0), F.get(good, pick(20, 5).cast("int"))).otherwise(
        F.get(F.array(*map(lit, wary)), pick(21, len(wary)).cast("int")))
    rows = rows.withColumn("before", before)
    return rows.select(
        "id", "kind", F.concat("before", "s", F.lit(" on the way")).alias("text"), F.length("before").alias("lo"),
        (F.length("before") + F.length("s")).alias("hi"), F.col("label").cast("double").alias("label"))


def fit(spark: SparkSession, n: int = SPANS) -> tuple[object, dict[str, float]]:
    """The trees, and for each kind the lowest threshold with ``PRECISION`` on the held-out fifth."""
    rows = written_spans(spark, n)
    seen = describe(F.col("text"), F.col("lo"), F.col("hi"), F.col("kind"))
    rows = durable(rows.select("id", "kind", "label", *[x.alias(c) for c, x in zip(NAMES, seen, strict=True)]).repartition(1), "spans")
    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows.withColumnRenamed("kind", "of"))
    held = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(5)) == 0
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64).fit(rows.where(~held))
    proof = trees.transform(rows.where(held)).select("of", F.round(vector_to_array("probability")[1], 6).alias("p"), "label").collect()  # a fifth of n
    limits = {}
    for kind in KINDS:
        own = sorted(((r.p, r.label) for r in proof if r.of == kind), reverse=True)
        limits[kind], right = 1.1, 0.0
        for k, (p, label) in enumerate(own, 1):
            right += label
            if right / k >= PRECISION and (k == len(own) or own[k][0] < p):
                limits[kind] = p
    return trees, limits


def scan(docs: DataFrame, model: tuple[object, dict[str, float]] | None = None, text_col: str = "text") -> DataFrame:
    """``doc_id, version, base, extra`` for each distinct id and text: arrays of ``(kind, lo, hi)``.

    ``version`` is a hash of the text. A null text counts as empty. Base spans are in order of kind and
    place. An empty table gives no rows.
    """
    spark = docs.sparkSession
    trees, limits = model or fit(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast(_SPAN)
    for kind in KINDS:
        gate = F.regexp_like("text", F.lit("[0-9]")) if kind != "email" else F.lit(True)
        if GATE[kind]:
            gate = gate & F.contains("text", F.lit(GATE[kind]))
        rows = rows.withColumn(f"at_{kind}", F.when(gate, F.when(F.regexp_like("text", F.lit(BASE[kind])), _found(F.col("text"), F.lit(BASE[kind])))).otherwise(none))
    for k, (_, pattern, test) in enumerate(GENERATORS):
        rows = rows.withColumn(f"more_{k}", F.when(F.regexp_like("text", F.lit(test)), _found(F.col("text"), F.lit(pattern))).otherwise(none))
    empty = F.array().cast("array<struct<kind:string,lo:int,hi:int>>")
    base = F.concat(*[F.coalesce(_kept(kind), empty) for kind in KINDS])
    more = F.concat(*[
        F.coalesce(_proposed(k, kind), empty) for k, (kinds, _, _) in enumerate(GENERATORS) for kind in kinds])
    seen = lambda c: F.struct(c["kind"].alias("of"), c["lo"].alias("lo"), c["hi"].alias("hi"), *[
        x.alias(name) for name, x in zip(NAMES, describe(F.col("text"), c["lo"], c["hi"], c["kind"]), strict=True)])
    over = lambda a, b: (a["lo"] < b["hi"]) & (b["lo"] < a["hi"])
    rows = rows.select("doc_id", F.xxhash64("text").alias("version"), "text", base.alias("base"), more.alias("more"))
    fresh = F.filter("more", lambda c: ~F.exists("base", lambda b: over(b, c)))
    rows = rows.withColumn("more", F.when(F.size("more") > 0, fresh))
    rows = durable(rows.select("doc_id", "version", "base", F.when(F.size("more") > 0, F.transform("more", seen)).alias("more")), "proposed")
    rows = rows.dropDuplicates(["doc_id", "version"])
    each = rows.where("more IS NOT NULL").select("doc_id", "version", F.explode("more").alias("c")).select("doc_id", "version", "c.*")
    judged = trees.transform(VectorAssembler(inputCols=NAMES, outputCol="features").transform(each))
    p = F.round(vector_to_array("probability")[1], 6)
    limit = F.element_at(F.create_map(*[F.lit(z) for item in limits.items() for z in item]), F.col("of"))
    chosen = judged.withColumn("p", p).where(F.col("p") >= limit).groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set(F.struct((-F.col("p")).alias("p"), (F.col("lo") - F.col("hi")).alias("size"), "lo", "hi", F.col("of").alias("kind")))).alias("chosen"))
    best = F.aggregate("chosen", empty, lambda acc, c: F.when(F.exists(acc, lambda b: over(b, c)), acc).otherwise(
        F.concat(acc, F.array(F.struct(c["kind"].alias("kind"), c["lo"].alias("lo"), c["hi"].alias("hi"))))))
    chosen = chosen.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), best.alias("extra"))
    joined = rows.join(chosen, rows["doc_id"].eqNullSafe(F.col("__doc")) & (rows["version"] == F.col("__version")), "left")
    return joined.select("doc_id", "version", "base", F.coalesce("extra", empty).alias("extra"))


def _kept(kind: str) -> Column:
    """The base spans of a kind: matches that pass its check."""
    good = F.filter(f"at_{kind}", lambda x: _valid(kind, x["s"]))
    return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi")))


def _proposed(k: int, kind: str) -> Column:
    low, high = DIGITS[kind]
    fit_in = F.filter(f"more_{k}", lambda x: F.length(_digits(x["s"])).between(low, high))
    return F.transform(fit_in, lambda x: F.struct(F.lit(kind).alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi")))


def report(docs: DataFrame, model: tuple[object, dict[str, float]] | None = None) -> DataFrame:
    """One row per row of ``docs``: base counts by kind, a digest of the base spans, and all spans as text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"))
    found = scan(docs, model)
    place = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"])
    every = F.transform(F.array_sort(F.transform(F.concat("base", "extra"), lambda c: F.struct(place(c).alias("k"), c["lo"].alias("lo"), c["hi"].alias("hi"), c["kind"].alias("kind")))),
                        lambda c: F.struct(c["kind"].alias("kind"), c["lo"].alias("lo"), c["hi"].alias("hi")))
    written = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["lo"].cast("string"), c["hi"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = found.select(
        F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), *[number(kind) for kind in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"))
    rows = keys.join(told, keys["doc_id"].eqNullSafe(F.col("__doc")) & (keys["version"] == F.col("__version")))
    return rows.select("doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans")


def redact(docs: DataFrame, model: tuple[object, dict[str, float]] | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; a null text stays null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = scan(docs, model).select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), F.concat("base", "extra").alias("__spans"))
    rows = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__version")))
    order = F.array_sort(F.transform("__spans", lambda c: F.struct(c["lo"].alias("lo"), c["hi"].alias("hi"), c["kind"].alias("kind"))))
    step = F.aggregate(
        order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, c: F.when(c["lo"] < acc["at"], F.struct(F.greatest(acc["at"], c["hi"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
            c["hi"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, c["lo"] - acc["at"]), F.lit("<"), c["kind"], F.lit(">")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), step)).select(*docs.columns)
