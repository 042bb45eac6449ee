"""Term catalogues, pair terms, redundancy and subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.errors import BadShape, DuplicateTerms
from termscan.session import small_enough_to_broadcast

# Partners are spelled out in chunks of this many ids, so no array outgrows it.
CHUNK = 4096


def term_catalog(df: DataFrame, sample: str) -> DataFrame:
    """``(term_id, term)`` of a wide table, by position, the sample column left out."""
    names = [c for c in df.columns if c != sample]
    if len(set(names)) != len(names):
        raise DuplicateTerms("repeated column names")
    return df.sparkSession.createDataFrame(list(enumerate(names)), "term_id long, term string")


def distinct_terms(long: DataFrame, term: str = "term_id") -> DataFrame:
    return long.select(term).distinct()


def lookup_terms(long: DataFrame, terms: Sequence) -> DataFrame:
    """The values of some terms, all in one filter that reaches the scan."""
    return long.filter(F.col("term_id").isin(list(terms)))


def open_terms(terms: DataFrame, closed: DataFrame) -> DataFrame:
    """Candidates: terms that are neither in the model nor skipped."""
    return terms.join(closed, "term_id", "left_anti")


def marker_names(chromosome: Column, name: Column) -> Column:
    """``Chr<chromosome>_<name>``."""
    return F.concat(F.lit("Chr"), chromosome.cast("string"), F.lit("_"), name)


def pair_list(terms: DataFrame, n_terms: int) -> DataFrame:
    """All pairs i < j of dense term ids with their names, in the order of a nested loop.

    Partners are counted up from ids in chunks, so there is no comparison of all terms with all;
    names come by equi-joins.
    """
    last = F.lit(n_terms - 1)
    firsts = terms.filter(F.col("term_id") < n_terms - 1).select(F.col("term_id").alias("term_a"), F.col("term").alias("name_a"))
    low = F.floor((F.col("term_a") + 1) / CHUNK)
    chunks = firsts.select("*", F.explode(F.sequence(low, F.floor(last / CHUNK))).alias("chunk"))
    start = F.greatest(F.col("term_a") + 1, F.col("chunk") * CHUNK)
    stop = F.least(last, (F.col("chunk") + 1) * CHUNK - 1)
    ids = chunks.select("term_a", "name_a", F.explode(F.sequence(start, stop)).alias("term_b"))
    seconds = terms.select(F.col("term_id").alias("term_b"), F.col("term").alias("name_b"))
    return ids.join(seconds, "term_b").select(
        "term_a", "term_b", "name_a", "name_b", F.concat_ws("_", "name_a", "name_b").alias("term")
    )


def pair_terms(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Products of listed pairs, per block: ``(term_a, term_b, block, values)``.

    ``vectors(term_id, block, values)``. For chosen pairs; scans over all pairs do not use it.
    """
    a = vectors.select(F.col("term_id").alias("term_a"), "block", F.col("values").alias("va"))
    b = vectors.select(F.col("term_id").alias("term_b"), "block", F.col("values").alias("vb"))
    product = F.zip_with("va", "vb", lambda x, y: x * y).alias("values")
    return pairs.join(a, "term_a").join(b, ["term_b", "block"]).select("term_a", "term_b", "block", product)


def pair_terms_wide(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """A wide table with one more column per pair, in one projection; no pairs leave it as it is."""
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    return df.selectExpr("*", *[f"{quoted(a)} * {quoted(b)} AS {quoted(a + '_' + b)}" for a, b in pairs])


def upper_triangle_index(n: Column) -> Column:
    """Positions of the strict upper triangle of an n x n matrix stored by rows."""
    rows = F.sequence(F.lit(0), n - 2)
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(
        F.flatten(F.transform(rows, lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: i * n + j)))
    )


def pair_features(values: Column) -> Column:
    """A vector followed by the products of its non-redundant pairs.

    Each entry multiplies the rest of the vector behind it.
    """
    n = F.size(values)
    rows = F.transform(values, lambda x, i: F.transform(F.slice(values, i + 2, n), lambda y: x * y))
    return F.concat(values, F.flatten(rows))


def fingerprints(long: DataFrame) -> DataFrame:
    """One row per term with a fingerprint of its values, added up map-side."""
    h = F.xxhash64("sample", F.col("value") + F.lit(0.0))
    return long.groupBy("term_id").agg(
        F.bit_xor(h).alias("h1"),
        F.sum(F.shiftrightunsigned(h, 40)).alias("h2"),
        F.count("*").alias("n"),
    )


#: Bytes of a term's record where such records are broadcast.
TERM_BYTES = 48


def _few(terms: DataFrame) -> DataFrame:
    """Small records of terms, broadcast if their counted size allows it."""
    return F.broadcast(terms) if small_enough_to_broadcast(terms.count() * TERM_BYTES) else terms


def redundant_terms(long: DataFrame) -> DataFrame:
    """``(kept, redundant)``: each redundant term with the first term of the same values.

    Terms meet by fingerprint. The values of all suspects of a group then meet by sample, added up map-side: in
    a group of equal terms the least and the largest value of every sample are the same. No pairs are made
    within a group, and nothing is joined by term but the small records. Only groups in which some
    sample differs, whose terms share no more than a fingerprint, are taken apart value by value. A missing
    value is equal to none.
    """
    # One small record per term.
    left = fingerprints(long).persist()
    first = left.groupBy("h1", "h2", "n").agg(F.min("term_id").alias("kept"), F.count("*").alias("members")).filter("members > 1")
    suspects = left.join(first, ["h1", "h2", "n"]).select("term_id", "kept", "members").persist()
    met = long.join(_few(suspects), "term_id").groupBy("kept", "members", "sample").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("values")
    )
    even = F.coalesce((F.col("low") == F.col("high")) & (F.col("values") == F.col("members")), F.lit(False))
    groups = met.groupBy("kept").agg(F.bool_and(even).alias("even")).persist()
    same = suspects.filter("term_id <> kept").join(groups.filter("even"), "kept").select("kept", F.col("term_id").alias("redundant"))
    mixed = groups.filter(~F.col("even")).select("kept")
    if mixed.isEmpty():
        return same
    apart = left.join(suspects.join(mixed, "kept").select("term_id"), "term_id")
    return same.unionByName(_taken_apart(long, apart))


def _taken_apart(long: DataFrame, left: DataFrame) -> DataFrame:
    """The same for the terms of ``left``, each compared with the first of its group, until no group is left over."""
    found: DataFrame | None = None
    left = left.persist()
    while True:
        first = left.groupBy("h1", "h2", "n").agg(F.min("term_id").alias("kept"), F.count("*").alias("members"))
        suspects = left.join(first.filter("members > 1"), ["h1", "h2", "n"]).filter("term_id <> kept")
        # The two value columns meet per kept term and sample.
        mine = long.join(_few(suspects.select("term_id", "kept")), "term_id").select("kept", "term_id", "sample", "value")
        theirs = long.join(_few(suspects.select(F.col("kept").alias("term_id")).distinct()), "term_id").select(
            F.col("term_id").alias("kept"), "sample", F.col("value").alias("other")
        )
        compared = (
            mine.join(theirs, ["kept", "sample"], "left")
            .groupBy("kept", "term_id")
            .agg(F.bool_and(F.coalesce(F.col("value") == F.col("other"), F.lit(False))).alias("same"))
            .persist()
        )
        same = compared.filter("same").select("kept", F.col("term_id").alias("redundant"))
        found = same if found is None else found.unionByName(same)
        differing = compared.filter(~F.col("same")).select("term_id")
        if differing.isEmpty():
            return found
        left = left.join(differing, "term_id")


def dedupe_terms(long: DataFrame) -> DataFrame:
    """Without redundant terms; the first of each group stays."""
    gone = redundant_terms(long).select(F.col("redundant").alias("term_id"))
    return long.join(_few(gone), "term_id", "left_anti")


def redundancy_check(long: DataFrame) -> DataFrame:
    """How many terms there are, and how many distinct value vectors."""
    all_terms = long.select("term_id").distinct().select(F.lit(1).alias("term"), F.lit(0).alias("gone"))
    gone = redundant_terms(long).select(F.lit(0).alias("term"), F.lit(1).alias("gone"))
    sums = all_terms.unionByName(gone).agg(F.sum("term").alias("n_terms"), F.sum("gone").alias("gone"))
    return sums.select("n_terms", (F.col("n_terms") - F.col("gone")).alias("n_distinct"), (F.col("gone") > 0).alias("redundant"))


def term_subset(terms: DataFrame, forced: Sequence[str], size: int, seed: int) -> DataFrame:
    """Forced terms plus a reproducible draw without replacement, ``size`` terms in all.

    Raises if a forced term does not exist, or ``size`` is less than theirs or more than there are terms.
    """
    known, found = terms.agg(F.count(F.lit(1)), F.count_if(F.col("term").isin(list(forced)))).first()
    if found < len(set(forced)):
        raise BadShape(f"{len(set(forced)) - found} of the forced terms do not exist")
    if not len(set(forced)) <= size <= known:
        raise BadShape(f"cannot draw {size} of {known} terms with {len(set(forced))} forced")
    must = terms.filter(F.col("term").isin(list(forced))).select("term", F.lit(True).alias("forced"))
    rest = terms.filter(~F.col("term").isin(list(forced)))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("term")))
    drawn = rest.orderBy(draw, "term").limit(max(0, size - len(set(forced)))).select("term", F.lit(False).alias("forced"))
    return must.unionByName(drawn)


def term_subsets(terms: DataFrame, forced: Sequence[str], plan: Sequence[tuple[int, int]]) -> DataFrame:
    """Subsets for several ``(size, seed)``: ``(size, seed, term, forced)``."""
    parts = [
        term_subset(terms, forced, size, seed).select(
            F.lit(size).alias("size"), F.lit(seed).alias("seed"), "term", "forced"
        )
        for size, seed in plan
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subset_log(subsets: DataFrame) -> DataFrame:
    """``(size, n_random, seed)`` of drawn subsets."""
    return subsets.groupBy("size", "seed").agg(F.count_if(~F.col("forced")).alias("n_random"))
