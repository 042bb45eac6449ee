"""License scans: ordered signature rules behind a keyword prefilter, all in built-in functions.

A text is first reduced to its words (ASCII lower case), each between two blanks, so that punctuation
and line breaks cannot hide a phrase. Only rules whose keyword occurs run. A rule's matches become
intervals; an interval inside one of a rule of higher priority (or of the same priority and longer, or
equal and of an earlier rule) is suppressed. Rules are rows of data: one pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases that are always counted, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Characters of words, for both cases of the ASCII letters, and their complement.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Pieces of patterns over normalised words: each word stands between two blanks of its own.
_V = r"(?: (?:version|v|ver) )?"
_N1, _N2, _N3, _N4 = (rf"(?: v?{n} (?: 0 )?)" for n in "1234")
_THE = r"(?: the )?"


def _w(words: str) -> str:
    """Words as they stand in a normalised text."""
    return "".join(f" {w} " for w in words.split())


#: (label, keyword, name as a pattern). The order is the priority: special names before general ones.
_NAMES = [
    ("agpl-3.0", "affero", rf"(?:{_w('gnu')})?{_w('affero general public')} licen[cs]e {_V}{_N3}"),
    ("agpl", "affero", rf"(?:{_w('gnu')})?{_w('affero general public')} licen[cs]e "),
    ("lgpl-2.1", "lesser", rf"(?:{_w('gnu')})?{_w('lesser general public')} licen[cs]e {_V} v?2  1 "),
    ("lgpl-3.0", "lesser", rf"(?:{_w('gnu')})?{_w('lesser general public')} licen[cs]e {_V}{_N3}"),
    ("lgpl", "lesser", rf"(?:{_w('gnu')})?{_w('lesser general public')} licen[cs]e "),
    ("lgpl-2.0", "library", rf"(?:{_w('gnu')})?{_w('library general public')} licen[cs]e (?:{_V}{_N2})?"),
    ("gfdl", "documentation", rf"(?:{_w('gnu')})?{_w('free documentation')} licen[cs]e "),
    ("gpl-3.0", "public", rf"{_w('gnu general public')} licen[cs]e {_V}{_N3}"),
    ("gpl-2.0", "public", rf"{_w('gnu general public')} licen[cs]e {_V}{_N2}"),
    ("gpl-1.0", "public", rf"{_w('gnu general public')} licen[cs]e {_V}{_N1}"),
    ("gpl", "public", rf"(?:{_w('gnu')})?{_w('general public')} licen[cs]e "),
    ("gpl", "gnu", rf"{_w('gnu')} gpl "),
    ("mpl-2.0", "mozilla", rf"{_w('mozilla public')} licen[cs]e {_V}{_N2}"),
    ("mpl-1.1", "mozilla", rf"{_w('mozilla public')} licen[cs]e {_V} v?1  1 "),
    ("mpl", "mozilla", rf"{_w('mozilla public')} licen[cs]e "),
    ("epl-2.0", "eclipse", rf"{_w('eclipse public')} licen[cs]e {_V}{_N2}"),
    ("epl-1.0", "eclipse", rf"{_w('eclipse public')} licen[cs]e {_V}{_N1}"),
    ("epl", "eclipse", rf"{_w('eclipse public')} licen[cs]e "),
    ("edl-1.0", "eclipse", rf"{_w('eclipse distribution')} licen[cs]e "),
    ("eupl-1.2", "european", rf"{_w('european union public')} licen[cs]e {_V} v?1  2 "),
    ("eupl", "european", rf"{_w('european union public')} licen[cs]e "),
    ("cddl-1.0", "development", rf"{_w('common development and distribution')} licen[cs]e "),
    ("cpl-1.0", "common", rf"{_w('common public')} licen[cs]e "),
    ("ms-pl", "microsoft", rf"{_w('microsoft public')} licen[cs]e "),
    ("ms-rl", "microsoft", rf"{_w('microsoft reciprocal')} licen[cs]e "),
    ("apache-2.0", "apache", rf"{_w('apache')}(?: software )? licen[cs]e {_V}{_N2}"),
    ("apache-1.1", "apache", rf"{_w('apache')}(?: software )? licen[cs]e {_V} v?1  1 "),
    ("apache-1.0", "apache", rf"{_w('apache')}(?: software )? licen[cs]e {_V} v?1  0 "),
    ("apache", "apache", rf"{_w('apache')}(?: software )? licen[cs]e "),
    ("bsd-4-clause", "bsd", rf" (?:4|four)  clause  bsd (?: licen[cs]e )?| bsd  (?:4|four)  clause (?: licen[cs]e )?"),
    ("bsd-3-clause", "bsd", rf" (?:3|three)  clause  bsd (?: licen[cs]e )?| bsd  (?:3|three)  clause (?: licen[cs]e )?"),
    ("bsd-2-clause", "bsd", rf" (?:2|two)  clause  bsd (?: licen[cs]e )?| bsd  (?:2|two)  clause (?: licen[cs]e )?"),
    ("bsd-3-clause", "bsd", rf" (?:new|modified|revised)  bsd  licen[cs]e "),
    ("bsd-2-clause", "bsd", rf" (?:simplified|freebsd)  bsd  licen[cs]e "),
    ("0bsd", "bsd", rf" zero  clause  bsd | bsd  zero  clause "),
    ("bsd", "bsd", rf" bsd (?: style )? licen[cs]e "),
    ("isc", "isc", rf" isc  licen[cs]e "),
    ("mit-0", "mit", rf" mit  no  attribution "),
    ("mit", "mit", rf" mit (?: x11 )? licen[cs]e | mit  x11 "),
    ("x11", "x11", rf" x11  licen[cs]e "),
    ("zlib", "zlib", rf" zlib (?: libpng )? licen[cs]e "),
    ("libpng", "libpng", rf" libpng  licen[cs]e "),
    ("bsl-1.0", "boost", rf"{_w('boost software')} licen[cs]e (?:{_V}{_N1})?"),
    ("busl-1.1", "business", rf"{_w('business source')} licen[cs]e "),
    ("artistic-2.0", "artistic", rf" artistic  licen[cs]e {_V}{_N2}"),
    ("artistic", "artistic", rf" artistic  licen[cs]e "),
    ("wtfpl", "wtfpl", " wtfpl "),
    ("unlicense", "unlicense", rf"{_THE} unlicense "),
    ("ofl-1.1", "open", rf"(?: sil )?{_w('open font')} licen[cs]e "),
    ("odbl-1.0", "database", rf"{_w('open database')} licen[cs]e "),
    ("odc-by-1.0", "commons", rf"{_w('open data commons attribution')} licen[cs]e "),
    ("pddl-1.0", "domain", rf"{_w('public domain dedication')}(?: and )? licen[cs]e "),
    ("osl-3.0", "open", rf"{_w('open software')} licen[cs]e (?:{_V}{_N3})?"),
    ("afl-3.0", "academic", rf"{_w('academic free')} licen[cs]e (?:{_V}{_N3})?"),
    ("psf-2.0", "python", rf"{_w('python software foundation')} licen[cs]e "),
    ("python-2.0", "python", rf" python  licen[cs]e "),
    ("postgresql", "postgresql", rf" postgresql  licen[cs]e "),
    ("php-3.01", "php", rf" php  licen[cs]e "),
    ("ruby", "ruby", rf" ruby  licen[cs]e "),
    ("openssl", "openssl", rf" openssl  licen[cs]e "),
    ("ncsa", "illinois", rf" illinois (?: ncsa )?{_w('open source')} licen[cs]e "),
    ("upl-1.0", "universal", rf"{_w('universal permissive')} licen[cs]e "),
    ("sspl-1.0", "server", rf"{_w('server side public')} licen[cs]e "),
    ("elastic-2.0", "elastic", rf" elastic  licen[cs]e "),
    ("openrail", "openrail", r" (?:creativeml  )?open ?rail (?:  ?m )?| openrail "),
    ("llama", "community", r" llama  (?:[23] (?: [0-9]+ )?)? community  licen[cs]e "),
    ("cc0-1.0", "cc0", rf" cc0 (?:{_N1})?"),
    ("cc0-1.0", "zero", rf"{_w('creative commons zero')}"),
    ("copyleft-next", "copyleft", " copyleft  next "),
    ("copyleft", "copyleft", " copyleft "),
    ("public-domain", "domain", r" (?:in |into |to )?(?: the )? public  domain "),
    ("all-rights-reserved", "rights", " all  rights  reserved "),
    ("proprietary", "proprietary", r" proprietary  (?:licen[cs]e|software) | proprietary  and  confidential "),
]
_NAMES += [
    (f"cc-{tail}-{v[0]}.{v[1]}" if v else f"cc-{tail}", key,
     lead + "".join(f" {longer.get(t, t) if longer else t} " for t in tail.split("-")) + end)
    for key, lead, longer in (
        ("cc by", " cc ", {}),
        ("attribution", r" creative  commons (?:  ?licen[cs]e )?", {
            "by": "attribution", "nc": "non ?(?:  )?commercial", "sa": "share ?(?:  )?alike", "nd": "no ?(?:  )?deriv(?:ative)?s?(?: works)?"}),
    )
    for tail in ("by-nc-sa", "by-nc-nd", "by-nc", "by-sa", "by-nd", "by")
    for v, end in (
        ("40", r"(?: (?:international|version|licen[cs]e) )* v?4  0 "), ("30", r"(?: (?:unported|version|licen[cs]e) )* v?3  0 "),
        ("25", r"(?: (?:generic|version|licen[cs]e) )* v?2  5 "), ("20", r"(?: (?:generic|version|licen[cs]e) )* v?2  0 "), ("", ""),
    )
]

#: Words before a name: a grant or a tag says more than a bare name. (priority, share of the score, pattern)
_FORMS = [
    (4, 1.0, r" spdx  licen[cs]e  identifier "),
    (3, 0.95, r" (?:licensed|released|distributed|published|available|made  available|provided|covered|governed) "
              r"(?: and )?(?: (?:licensed|released|distributed) )? (?:under|by) (?: the )?(?: terms )?(?: of )?(?: the )?"),
    (2, 0.85, r" (?:subject|according)  to (?: the )?(?: terms )?(?: of )?(?: the )?| licen[cs]e (?: is )?(?: the )?"),
    (1, 0.7, ""),
]

#: SPDX identifiers as they read after normalisation, in tags only.
_TAGS = [
    "mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "cc0 1 0", "apache 2 0", "apache 1 1", "bsd 2 clause", "bsd 3 clause",
    "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later",
    "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "mpl 2 0", "epl 2 0", "bsl 1 0", "eupl 1 2",
    "cddl 1 0", "artistic 2 0", "ofl 1 1", "postgresql", "python 2 0", "cc by 4 0", "cc by sa 4 0", "cc by nc 4 0",
]


def rules() -> list[tuple[int, int, float, str, str, str]]:
    """``(order, priority, weight, label, keyword, pattern)``; each name in each form, then the tags."""
    found = [
        (priority, weight, label, keyword, (f"(?:{form})" if form else "") + f"(?:{name})")
        for priority, weight, form in _FORMS[1:]
        for label, keyword, name in _NAMES
    ]
    priority, weight, form = _FORMS[0]
    found += [
        (priority, weight, tag.replace(" only", "").replace(" or later", "+").replace(" ", "-"), "spdx", form + _w(tag))
        for tag in _TAGS
    ]
    return [(k, *rule) for k, rule in enumerate(found)]


#: A text without any of these has no match of any rule.
ROOTS = ("licen", "spdx", "copyleft", "public", "rights", "proprietary", "cc", "gnu", "bsd", "mit", "wtfpl", "creative", "rail")


def _normal(text: Column) -> Column:
    """The words in lower case, each between blanks of its own: ``' gnu  general '``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate(text, upper, lower)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, F.lit("  "))), F.lit(" "))


def _starts(text: Column, pattern: Column) -> Column:
    """Intervals ``(lo, hi)`` of the leftmost non-overlapping matches, counted in words."""
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    words = lambda s: F.regexp_count(s, F.lit("[^ ]+"))
    step = F.zip_with(hits, between, lambda hit, gap: F.struct(words(gap).alias("gap"), words(hit).alias("hit")))
    step = F.slice(step, F.lit(1), F.size(hits))
    return F.aggregate(
        step, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["hit"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("lo"), (acc["at"] + s["gap"] + s["hit"]).alias("hi")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _literal(spark: SparkSession, rows: list[tuple], names: list[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``license_words, license_base, license_spans`` added (a column of that name is replaced).

    ``license_words`` counts words, ``license_base`` has ``(lo, hi, label)`` of each place of a base
    phrase, ``license_spans`` the surviving detections ``(lo, hi, label, weight)`` in order of place.
    Places are counted in words from 0. A null text counts as empty: 0 words and empty arrays. Rows are
    treated one by one, so repeated rows, ties and an empty table need no rule.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)
    suspect = F.lit(False)
    for root in ROOTS:
        suspect = suspect | F.contains(low, F.lit(root))
    table = rules()
    keys = F.array(*[F.lit(k) for k in sorted({r[4] for r in table})])
    # the keyword as it can stand in a normalised text
    near = F.col("license_text")
    names = ["order", "priority", "weight", "label", "keyword", "pattern"]
    base = F.flatten(F.transform(
        F.filter(_literal(spark, [(f" {'  '.join(p.split())} ", label) for p, label in BASE], ["phrase", "label"]),
                 lambda b: F.contains(near, b["phrase"])),
        lambda b: F.transform(_starts(near, b["phrase"]), lambda s: F.struct(s["lo"], s["hi"], b["label"].alias("label")))))
    present = F.filter(keys, lambda k: F.contains(near, F.replace(k, F.lit(" "), F.lit("  "))))
    found = F.flatten(F.transform(
        F.filter(_literal(spark, table, names), lambda r: F.array_contains(F.col("license_keys"), r["keyword"])),
        lambda r: F.transform(
            F.when(F.regexp_like(near, r["pattern"]), _starts(near, r["pattern"])).otherwise(F.array().cast("array<struct<lo:int,hi:int>>")),
            lambda s: F.struct(s["lo"], s["hi"], r["priority"].alias("priority"), r["order"].alias("order"),
                               r["label"].alias("label"), r["weight"].alias("weight")))))
    raw = F.col("license_raw")
    inside = lambda a, b: (b["lo"] <= a["lo"]) & (a["hi"] <= b["hi"])
    wide = lambda a, b: (b["hi"] - b["lo"]) > (a["hi"] - a["lo"])
    kept = F.filter(raw, lambda a: ~F.exists(raw, lambda b: inside(a, b) & (
        (b["priority"] > a["priority"])
        | ((b["priority"] == a["priority"]) & (wide(a, b) | (~wide(a, b) & (b["order"] < a["order"])))))))
    none = "array<struct<lo:int,hi:int,label:string>>"
    spans = "array<struct<lo:int,hi:int,label:string,weight:double>>"
    return (
        docs.withColumn("license_words", F.regexp_count(text, F.lit(WORD)).cast("long"))
        .withColumn("license_text", F.when(suspect, _normal(text)))
        .withColumn("license_base", F.when(near.isNotNull(), base).otherwise(F.array().cast(none)))
        .withColumn("license_keys", F.when(near.isNotNull(), present))
        .withColumn("license_raw", F.when(F.size("license_keys") > 0, found))
        .withColumn("license_spans", F.coalesce(F.sort_array(F.transform(
            kept, lambda s: F.struct(s["lo"], s["hi"], s["label"], s["weight"]))), F.array()).cast(spans))
        .drop("license_text", "license_keys", "license_raw")
    )


def license_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts and places of the base phrases, labels, and a score.

    ``score`` is the highest weight of a surviving detection, at least 0.7 for a base phrase, else 0.
    """
    rows = scan(docs.select("doc_id", "text"))
    lows = F.transform("license_base", lambda s: s["lo"])
    base = F.transform("license_base", lambda s: s["label"])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size("license_base").cast("long").alias("n_base"),
        F.array_min(lows).cast("long").alias("first_word"), F.array_max(lows).cast("long").alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, F.transform("license_spans", lambda s: s["label"]))).alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("license_spans", lambda s: s["weight"])), F.lit(0.0)),
            F.when(F.size("license_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0)),
        ).alias("score"),
    )
