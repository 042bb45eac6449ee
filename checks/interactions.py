"""Catalogues, pair terms, redundancy and subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import N_TERMS, SQL_LONG, SQL_WIDE, SQL_Y1, emb, query, rounded, table, vectors, wide, wide_names
from termscan.operators import blocks, lasso, reshape, scan, terms, tiles
from termscan.session import DurableTable

_CATALOG = f"catalog AS (SELECT CAST(i AS BIGINT) AS term_id, 'e' || i AS term FROM range((SELECT max(len(embedding)) FROM embeddings)) t(i))"
_PAIRS = f"pairs AS (SELECT p.term_id AS term_a, q.term_id AS term_b, p.term AS name_a, q.term AS name_b, p.term || '_' || q.term AS term FROM catalog p JOIN catalog q ON p.term_id < q.term_id)"


def _long(spark, folder):
    return reshape.vectors_to_long(vectors(spark, folder), "sample", "values")


def _catalog(spark, folder):
    """The terms that the data has."""
    return terms.distinct_terms(_long(spark, folder)).select("term_id", F.concat(F.lit("e"), F.col("term_id").cast("string")).alias("term"))


@query(f"WITH {_CATALOG}, l AS ({SQL_LONG}) SELECT term_id, term, count(*) AS n FROM catalog JOIN l USING (term_id) GROUP BY term_id, term")
def term_catalog(spark, folder):
    """Columns of the wide table by position, with the number of their values."""
    table_ = wide(spark, folder)
    counts = reshape.wide_to_long(table_, "sample", wide_names()).groupBy("term").agg(F.count("value").alias("n"))
    return terms.term_catalog(table_, "sample").join(counts, "term").select("term_id", "term", "n")


@query(f"WITH l AS ({SQL_LONG}) SELECT DISTINCT term_id FROM l")
def term_names(spark, folder):
    return terms.distinct_terms(_long(spark, folder))


@query(f"WITH l AS ({SQL_LONG}) SELECT sample, term_id, round(value, 6) + 0.0 AS value FROM l WHERE term_id IN (3, 10, 63)")
def lookup_terms(spark, folder):
    found = terms.lookup_terms(_long(spark, folder), [3, 10, 63])
    return found.select("sample", "term_id", rounded("value").alias("value"))


@query("SELECT p_partkey, 'Chr' || p_size || '_' || p_name AS marker FROM part")
def marker_names(spark, folder):
    """Chromosome-style names; the part size stands in for the chromosome."""
    return table(spark, folder, "part").select("p_partkey", terms.marker_names(F.col("p_size"), F.col("p_name")).alias("marker"))


@query(f"WITH {_CATALOG}, {_PAIRS} SELECT * FROM pairs")
def pair_list(spark, folder):
    return terms.pair_list(_catalog(spark, folder), N_TERMS)


@query(
    f"WITH {_CATALOG}, {_PAIRS} SELECT term, false AS is_pair FROM catalog UNION ALL SELECT term, true FROM pairs"
)
def all_terms(spark, folder):
    """Single terms and pairs in one list."""
    catalog = _catalog(spark, folder)
    single = catalog.select("term", F.lit(False).alias("is_pair"))
    return single.unionByName(terms.pair_list(catalog, N_TERMS).select("term", F.lit(True).alias("is_pair")))


def _order_sums(f):
    """Length, sum, and the sum weighted by position, which shows the order."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return [
        F.size(f).cast("long").alias("n"),
        rounded(add(f)).alias("total"),
        rounded(add(F.transform(f, lambda x, i: x * i)), 3).alias("weighted"),
    ]


BLOCK = 256


@query(
    f"""WITH l AS ({SQL_LONG}), p AS (SELECT a.term_id AS term_a, b.term_id AS term_b, a.sample, a.value * b.value AS v
  FROM l a JOIN l b ON a.sample = b.sample AND a.term_id < b.term_id)
SELECT term_a, term_b, count(*) AS n, round(sum(v), 6) + 0.0 AS total, round(min(v), 8) + 0.0 AS low, round(max(v), 8) + 0.0 AS high
FROM p GROUP BY term_a, term_b"""
)
def pair_terms(spark, folder):
    """Product vectors of listed pairs, block by block, summed up per pair."""
    vec = reshape.term_vectors(_long(spark, folder), "sample", BLOCK).select("term_id", "block", "values")
    pairs = terms.pair_list(_catalog(spark, folder), N_TERMS).select("term_a", "term_b")
    made = terms.pair_terms(pairs, vec)
    add = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return (
        made.select("term_a", "term_b", F.size("values").alias("n"), add.alias("t"), F.array_min("values").alias("lo"), F.array_max("values").alias("hi"))
        .groupBy("term_a", "term_b")
        .agg(
            F.sum("n").cast("long").alias("n"),
            rounded(F.sum("t")).alias("total"),
            rounded(F.min("lo"), 8).alias("low"),
            rounded(F.max("hi"), 8).alias("high"),
        )
    )


@query(
    f"""WITH l AS ({SQL_LONG}), p AS (SELECT a.term_id AS term_a, b.term_id AS term_b, a.value * b.value AS v, y
  FROM l a JOIN l b ON a.sample = b.sample AND a.term_id < b.term_id JOIN (SELECT vec_id AS sample, {SQL_Y1} AS y FROM embeddings) o ON o.sample = a.sample)
SELECT term_a, term_b, CASE WHEN round(corr(v, y), 7) = 0 THEN 0.0 ELSE round(corr(v, y), 7) END AS r FROM p GROUP BY term_a, term_b"""
)
def pair_terms_long(spark, folder):
    """All pair products against the outcome, as correlations, from tile moments only."""
    ts = tiles.from_vectors(vectors(spark, folder), ("y",), pairs=True)
    rows = scan.scan_table(ts, {"y": scan.ModelState()}, pairs=True).filter(F.col("b") != scan.SINGLE)
    t = F.col("t_value")
    return rows.select(
        F.col("a").cast("long").alias("term_a"), F.col("b").cast("long").alias("term_b"), rounded(t / F.sqrt(t * t + F.col("df")), 7).alias("r")
    )


@query(
    f"""WITH l AS ({SQL_LONG}), p AS (SELECT a.sample, a.value * b.value AS v,
  row_number() OVER (PARTITION BY a.sample ORDER BY a.term_id, b.term_id) - 1 AS pos
  FROM l a JOIN l b ON a.sample = b.sample AND a.term_id < b.term_id)
SELECT sample, count(*) AS n, round(sum(v), 6) + 0.0 AS total, round(sum(v * pos), 3) + 0.0 AS weighted FROM p GROUP BY sample"""
)
def pair_terms_wide(spark, folder):
    """All pairs as new columns of the wide table in one projection, then summed up per sample."""
    names = wide_names()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    # Tables that really are wide, as files would be.
    source = DurableTable(wide(spark, folder), "wide").df
    out = DurableTable(terms.pair_terms_wide(source, pairs), "wide-pairs").df
    made = out.selectExpr("sample", "array(" + ", ".join(f"{a}_{b}" for a, b in pairs) + ") AS f")
    return made.select("sample", *_order_sums(F.col("f")))


@query(
    "SELECT n, CAST(i * n + j AS INTEGER) AS idx FROM (SELECT DISTINCT CAST(len(embedding) AS INTEGER) AS n FROM embeddings) s, range(64) a(i), range(64) b(j) WHERE i < j AND j < n"
)
def upper_triangle_index(spark, folder):
    sizes = table(spark, folder, "embeddings").select(F.size("embedding").alias("n")).distinct()
    return sizes.select("n", F.explode(terms.upper_triangle_index(F.col("n"))).alias("idx"))


@query(
    f"""WITH l AS ({SQL_LONG}), p AS (SELECT sample, term_id AS a, -1 AS b, value AS v FROM l
  UNION ALL SELECT a.sample, a.term_id, b.term_id, a.value * b.value FROM l a JOIN l b ON a.sample = b.sample AND a.term_id < b.term_id),
f AS (SELECT sample, v, CAST(row_number() OVER (PARTITION BY sample ORDER BY b >= 0, a, b) - 1 AS BIGINT) AS pos FROM p)
SELECT sample, count(*) AS n, round(sum(v), 6) + 0.0 AS total, round(sum(v * pos), 3) + 0.0 AS weighted FROM f GROUP BY sample"""
)
def pair_features(spark, folder):
    """Each sample's vector with all its pair products; the weighted sum shows their order."""
    f = vectors(spark, folder).select("sample", terms.pair_features(F.col("values")).alias("f"))
    return f.select("sample", *_order_sums(F.col("f")))


_BLOCKS = 4


@query(
    f"""WITH l AS ({SQL_LONG}), p AS (SELECT sample, term_id AS a, -1 AS b, value AS v FROM l
  UNION ALL SELECT a.sample, a.term_id, b.term_id, a.value * b.value FROM l a JOIN l b ON a.sample = b.sample AND a.term_id < b.term_id),
f AS (SELECT sample, v, CAST(row_number() OVER (PARTITION BY sample ORDER BY b >= 0, a, b) - 1 AS BIGINT) AS col FROM p)
SELECT sample % {_BLOCKS} AS block_id, col, count(*) AS n_rows, round(sum(v), 6) + 0.0 AS sum_x, round(sum(y), 5) + 0.0 AS sum_y
FROM f JOIN (SELECT vec_id AS sample, {SQL_Y1} AS y FROM embeddings) USING (sample) GROUP BY block_id, col"""
)
def design_blocks(spark, folder):
    """Row counts and column sums of dense blocks with all single and pair columns."""
    df = vectors(spark, folder).select("sample", "values", F.array("y").alias("ys"))
    made = blocks.design_blocks(df, N_TERMS, 1, F.pmod(F.col("sample"), F.lit(_BLOCKS)))
    sums = blocks.block_sums(made, 1)
    return sums.select("block_id", "col", "n_rows", rounded("sum_x").alias("sum_x"), rounded("sum_y", 5).alias("sum_y"))


def _with_copies(spark, folder):
    """Every term twice: ids from 64 repeat the ones before."""
    long = _long(spark, folder)
    return long.unionByName(long.withColumn("term_id", F.col("term_id") + N_TERMS))


_COPIES = f"""l AS ({SQL_LONG}), c AS (SELECT * FROM l UNION ALL SELECT sample, term_id + {N_TERMS}, value FROM l),
v AS (SELECT term_id, list(value ORDER BY sample) AS vec FROM c GROUP BY term_id),
g AS (SELECT term_id, min(term_id) OVER (PARTITION BY vec) AS kept FROM v)"""


@query(f"WITH {_COPIES} SELECT DISTINCT kept AS term_id FROM g")
def dedupe_terms(spark, folder):
    return terms.dedupe_terms(_with_copies(spark, folder)).select("term_id").distinct()


@query(f"WITH {_COPIES} SELECT kept, term_id AS redundant FROM g WHERE term_id <> kept")
def redundant_groups(spark, folder):
    return terms.redundant_terms(_with_copies(spark, folder))


@query(f"WITH {_COPIES} SELECT count(*) AS n_terms, count(DISTINCT kept) AS n_distinct, count(*) > count(DISTINCT kept) AS redundant FROM g")
def redundancy_check(spark, folder):
    return terms.redundancy_check(_with_copies(spark, folder))


# Forced terms, and (size, seed) of each draw.
FORCED = ["e5", "e7", "e3", "e10", "e20"]
DRAWS = [(10, 31), (20, 47), (40, 59)]
_DRAWN = " UNION ALL ".join(
    f"SELECT CAST({size} AS INTEGER) AS size, CAST({seed} AS INTEGER) AS seed, term, forced FROM (SELECT term, true AS forced FROM catalog WHERE term IN {tuple(FORCED)} "
    f"UNION ALL (SELECT term, false FROM catalog WHERE term NOT IN {tuple(FORCED)} ORDER BY md5('{seed}:' || term), term LIMIT {size - len(FORCED)}))"
    for size, seed in DRAWS
)


@query(f"WITH {_CATALOG} {_DRAWN}")
def term_subset(spark, folder):
    """Forced terms and a seeded draw of the rest, for several sizes."""
    return terms.term_subsets(_catalog(spark, folder), FORCED, DRAWS)


@query(f"WITH {_CATALOG} SELECT size, seed, count(*) FILTER (NOT forced) AS n_random FROM ({_DRAWN}) GROUP BY size, seed")
def subset_log(spark, folder):
    return terms.subset_log(terms.term_subsets(_catalog(spark, folder), FORCED, DRAWS))


@query("SELECT vec_id AS sample, CAST(list_position(embedding, list_min(embedding)) - 1 AS INTEGER) AS at FROM embeddings")
def arg_min(spark, folder):
    """Position of the first smallest entry of every vector."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample"), lasso.arg_min(emb()).alias("at"))


