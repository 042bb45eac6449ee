import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import CEMENT, vector_frame
from termscan.errors import DuplicateTerms
from termscan.functions.tdist import t_pvalue
from termscan.operators import blocks, reshape, terms


def _long(spark, x):
    return reshape.vectors_to_long(vector_frame(spark, x, {"y": np.zeros(len(x))}), "sample", "values")


def test_pair_names_in_order(spark):
    df = spark.createDataFrame([("row", 2.5, -1.5, 4.0)], "id string, u double, v double, w double")
    pairs = terms.pair_list(terms.term_catalog(df, "id"), 3).orderBy("term_a", "term_b").collect()
    assert [r.term for r in pairs] == ["u_v", "u_w", "v_w"]
    wide = terms.pair_terms_wide(df, [(r.name_a, r.name_b) for r in pairs])
    assert wide.columns == ["id", "u", "v", "w", "u_v", "u_w", "v_w"]
    assert wide.first()[4:] == pytest.approx((-3.75, 10.0, -6.0))
    assert terms.pair_terms_wide(df, []).columns == df.columns


def test_pair_list_over_chunk_edges(spark, monkeypatch):
    monkeypatch.setattr(terms, "CHUNK", 3)
    n = 11
    catalog = spark.createDataFrame([(i, f"t{i}") for i in range(n)], "term_id long, term string")
    got = {(r.term_a, r.term_b) for r in terms.pair_list(catalog, n).collect()}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n)}
    assert terms.pair_list(catalog, n).count() == n * (n - 1) // 2


def test_cement_pair_column(spark):
    x = np.array([CEMENT["x1"], CEMENT["x2"]]).T
    rows = [(i, j, float(x[i, j])) for i in range(9) for j in range(2)]
    long = spark.createDataFrame(rows, "pos long, term_id long, value double")
    vec = reshape.term_vectors(long, "pos", 4).select("term_id", "block", "values")
    pairs = spark.createDataFrame([(0, 1)], "term_a long, term_b long")
    made = terms.pair_terms(pairs, vec).orderBy("block").collect()
    assert [len(r["values"]) for r in made] == [4, 4, 1]
    assert [v for r in made for v in r["values"]] == [182, 29, 616, 31, 108, 987, 40, 726, 680]


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([("s", 2.0, 3.0)], "id string, `a.b` double, `c``d` double")
    assert terms.pair_terms_wide(df, [("a.b", "c`d")]).first()[3] == 6.0


def test_repeated_names_raise(spark):
    df = spark.createDataFrame([("s", 2.0, 3.0)], "id string, a double, b double").toDF("id", "a", "a")
    with pytest.raises(DuplicateTerms):
        terms.term_catalog(df, "id")


def _redundant(spark, x):
    return {(r.kept, r.redundant) for r in terms.redundant_terms(_long(spark, x)).collect()}


def test_redundant_terms_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, size=(30, 24)).astype(float)
    x[:, 8:16] = 1.0  # a third of all terms are the same
    x[:, 20] = x[:, 3]
    x[0, 21], x[0, 3], x[0, 20] = -0.0, 0.0, 0.0
    expected = set()
    seen = {}
    for j in range(x.shape[1]):
        key = tuple(x[:, j] + 0.0)
        if key in seen:
            expected.add((seen[key], j))
        else:
            seen[key] = j
    assert _redundant(spark, x) == expected
    kept = {r.term_id for r in terms.dedupe_terms(_long(spark, x)).select("term_id").distinct().collect()}
    assert kept == set(seen.values())
    check = terms.redundancy_check(_long(spark, x)).first()
    assert (check.n_terms, check.n_distinct, check.redundant) == (24, len(seen), True)


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    def same(long):
        one = F.lit(1).cast("long")
        return long.groupBy("term_id").agg(F.count("*").alias("n")).select("term_id", one.alias("h1"), one.alias("h2"), "n")

    monkeypatch.setattr(terms, "fingerprints", same)
    x = np.array([[1, 2, 1, 2, 3, 2], [4, 5, 4, 5, 6, 5]], dtype=float)
    assert _redundant(spark, x) == {(0, 2), (1, 3), (1, 5)}


def test_subsets(spark):
    catalog = spark.createDataFrame([(i, f"m{i}") for i in range(30)], "term_id long, term string")
    plan = [(10, 7), (20, 8), (10, 9)]
    rows = terms.term_subsets(catalog, ["m3", "m4"], plan).collect()
    for size, seed in plan:
        mine = [r.term for r in rows if (r.size, r.seed) == (size, seed)]
        assert len(mine) == len(set(mine)) == size and {"m3", "m4"} <= set(mine)
    a, b = ({r.term for r in rows if r.seed == s} for s in (7, 9))
    assert a != b
    log = {(r.size, r.seed): r.n_random for r in terms.subset_log(terms.term_subsets(catalog, ["m3", "m4"], plan)).collect()}
    assert log == {(10, 7): 8, (20, 8): 18, (10, 9): 8}


def test_small_array_functions(spark):
    df = spark.createDataFrame([([3.0, 1.0, 1.0],), ([],)], "v array<double>")
    from termscan.operators.lasso import arg_min

    assert [r[0] for r in df.select(arg_min(F.col("v"))).collect()] == [1, -1]
    n = spark.range(5).select(terms.upper_triangle_index(F.col("id").cast("int")).alias("v")).collect()
    assert [r.v for r in n] == [[], [], [1], [1, 2, 5], [1, 2, 3, 6, 7, 11]]
    one = df.limit(1).select(terms.pair_features(F.col("v"))).first()[0]
    assert one == [3.0, 1.0, 1.0, 3.0, 3.0, 1.0]


def test_t_pvalue_column(spark):
    df = spark.createDataFrame([(9.820, 3), (None, 3)], "t double, df int")
    got = [r[0] for r in df.select(t_pvalue(F.col("t"), F.col("df"))).collect()]
    assert got[0] == pytest.approx(0.0022447, abs=1e-6) and (got[1] is None or np.isnan(got[1]))


def test_design_blocks_hold_mains_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "RECORD_BYTES", 8 * 6 * 4)
    x = np.arange(30, dtype=float).reshape(10, 3) ** 1.5
    df = vector_frame(spark, x, {"y": np.arange(10)}).selectExpr("sample", "values", "array(y) AS ys").coalesce(1)
    made = blocks.design_blocks(df, 3, 1, F.lit(0)).collect()
    assert max(r.n_rows for r in made) <= 4 and sum(r.n_rows for r in made) == 10
    got = np.concatenate([np.frombuffer(r.x).reshape(r.n_rows, r.n_cols) for r in made])
    full = np.column_stack([x, x[:, 0] * x[:, 1], x[:, 0] * x[:, 2], x[:, 1] * x[:, 2]])
    assert np.allclose(got[np.lexsort(got.T)], full[np.lexsort(full.T)])


def test_missing_and_repeated_cells_raise(spark):
    rows = [(p, 0, float(p)) for p in range(6)]
    long = lambda r: spark.createDataFrame(r, "sample long, term_id long, value double")
    assert reshape.term_vectors(long(rows), "sample", 4).count() == 2
    for bad in (rows[:1] + rows[2:], rows + rows[2:3]):
        with pytest.raises(Exception, match="lacks a cell or has one twice"):
            reshape.term_vectors(long(bad), "sample", 4).collect()
    with pytest.raises(Exception, match="a cell occurs twice"):
        reshape.long_to_wide(long(rows + rows[2:3]), [0], term="term_id").collect()
    assert sorted(r[1] for r in reshape.long_to_wide(long(rows), [0], term="term_id").collect()) == [float(p) for p in range(6)]
