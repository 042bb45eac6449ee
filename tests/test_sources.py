import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import CEMENT, CEMENT_Y, vector_frame
from termscan.errors import BadShape, DuplicateTerms, NoTermEntered, SampleMismatch
from termscan.operators import grid, ols, reshape, samples
from termscan.plans import jobs
from termscan.sources import sinks, text


def _write(path, rows, sep="\t"):
    path.write_text("".join(sep.join(map(str, r)) + "\n" for r in rows))
    return str(path)


def _grid(cells):
    rows = {}
    for r in cells.collect():
        rows.setdefault(r.row, {})[r.col] = r.cell
    return [[rows[i][j] for j in sorted(rows[i])] for i in sorted(rows)]


TABLE = [["id", "a", "b", "c"], ["s1", "1", "2", "3"], ["s2", "4", "5", "6"]]


def test_regular_expression_delimiter(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("id ;a;  b\ns1;1 ; 2\n")
    assert _grid(grid.to_cells(text.read_delimited(spark, str(path), r"\s*;\s*"))) == [["id", "a", "b"], ["s1", "1", "2"]]


def test_lines_keep_file_order_over_splits(spark, tmp_path):
    n = 5000
    for part, lo in (("a", 0), ("b", n // 3)):
        hi = n // 3 if part == "a" else n
        (tmp_path / f"{part}.txt").write_text("".join(f"line{i}\n" for i in range(lo, hi)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = text.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = {r.row: r.line for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: f"line{i}" for i in range(n)}


def test_ragged_rows_raise(spark, tmp_path):
    path = _write(tmp_path / "r.txt", [*TABLE, ["s3", "7"]])
    with pytest.raises(BadShape):
        grid.to_cells(text.read_delimited(spark, path))
    with pytest.raises(Exception, match="ragged|MALFORMED|Malformed"):
        text.read_sample_major(spark, path).collect()
    with pytest.raises(Exception, match="ragged row 3"):
        text.read_sample_major_long(spark, path).values.collect()


def test_short_header_raises(spark, tmp_path):
    path = _write(tmp_path / "h.txt", [["id", "a"], ["s1", "1", "2"]])
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        text.read_sample_major(spark, path).collect()
    with pytest.raises(Exception, match="ragged row 1"):
        text.read_sample_major_long(spark, path).values.collect()


def test_missing_value_raises(spark, tmp_path):
    path = _write(tmp_path / "na.txt", [["id", "a"], ["s1", "NA"]])
    with pytest.raises(Exception, match="NA"):
        text.read_sample_major(spark, path).collect()
    with pytest.raises(Exception, match="NA"):
        text.read_sample_major_long(spark, path).values.collect()


def test_sample_major_forms(spark, tmp_path):
    path = _write(tmp_path / "t.txt", TABLE)
    df = text.read_sample_major(spark, path, drop=[2, 9])
    assert df.columns == ["id", "a", "c"] and [f.dataType.simpleString() for f in df.schema] == ["string", "double", "double"]
    assert sorted(map(tuple, df.collect())) == [("s1", 1.0, 3.0), ("s2", 4.0, 6.0)]
    turned = _write(tmp_path / "u.txt", [list(c) for c in zip(*TABLE)])
    df = text.read_sample_major(spark, turned, transpose=True)
    assert sorted(map(tuple, df.collect())) == [("s1", 1.0, 2.0, 3.0), ("s2", 4.0, 5.0, 6.0)]
    t = text.read_sample_major_long(spark, path, drop=[1])
    rows = {(r.sample, r.term): r.value for r in t.long().join(t.terms, "term_id").collect()}
    assert rows == {("s1", "b"): 2, ("s1", "c"): 3, ("s2", "b"): 5, ("s2", "c"): 6}


def test_term_major(spark, tmp_path):
    for mark in text.HEADER_MARKS:
        path = _write(tmp_path / f"{mark}.txt", [[mark, "s1", "s2"], ["a", 1, 2], ["b", 3, 4.5]])
        t = text.read_term_major(spark, path)
        assert {(r.sample, r.term_id): r.value for r in t.long().collect()} == {("s1", 0): 1, ("s2", 0): 2, ("s1", 1): 3, ("s2", 1): 4.5}
        assert {(r.term_id, r.term) for r in t.terms.collect()} == {(0, "a"), (1, "b")}
    with pytest.raises(BadShape):
        text.read_term_major(spark, _write(tmp_path / "none.txt", [["a", 1, 2]]))
    with pytest.raises(DuplicateTerms):
        text.read_term_major(spark, _write(tmp_path / "dup.txt", [["HeaderLine", "s1"], ["a", 1], ["a", 2]]))
    with pytest.raises(Exception, match="ragged row 1"):
        text.read_term_major(spark, _write(tmp_path / "rag.txt", [["HeaderLine", "s1", "s2"], ["a", 1]])).values.collect()


def test_marker_table(spark, tmp_path):
    rows = [["Samples", "allele", "chr", "pos", "cm", "s1", "s2"], ["m1", "A/G", 8, 1234, "NA", 0.5, 1], ["m2", "C/T", 9, 99, "1.5", 0, 0.25]]
    t, markers = text.read_marker_table(spark, _write(tmp_path / "m.txt", rows))
    assert [tuple(r) for r in markers.orderBy("term_id").collect()] == [(0, "m1", "A/G", 8, 1234, None), (1, "m2", "C/T", 9, 99, 1.5)]
    assert {(r.sample, r.term_id): r.value for r in t.long().collect()} == {("s1", 0): 0.5, ("s2", 0): 1, ("s1", 1): 0, ("s2", 1): 0.25}


def test_json_integers_become_doubles(spark, tmp_path):
    path = tmp_path / "j.json"
    path.write_text("".join(json.dumps({"y": 1.5, "Sample": f"i{i}", "x1": i}) + "\n" for i in range(3)))
    df = text.read_json_terms(spark, str(path))
    assert df.columns[0] == "Sample" and {f.dataType.simpleString() for f in df.schema[1:]} == {"double"}
    assert df.orderBy("Sample").first()["x1"] == 0.0


def test_convert_round_trip(spark, tmp_path):
    src = _write(tmp_path / "src.csv", TABLE, ",")
    jobs.convert_format(spark, src, str(tmp_path / "out"), ",", drop=[2], transpose=True)
    got = _grid(grid.to_cells(text.read_delimited(spark, str(tmp_path / "out"))))
    assert got == [["HeaderLine", "s1", "s2"], ["a", "1", "4"], ["c", "3", "6"]]
    t = text.read_term_major(spark, str(tmp_path / "out"))
    assert t.long().count() == 4


def test_transposing_twice_changes_nothing(spark, tmp_path):
    cells = grid.to_cells(text.read_delimited(spark, _write(tmp_path / "t.txt", TABLE)))
    assert _grid(grid.transpose(grid.transpose(cells))) == TABLE
    assert _grid(grid.transpose(cells)) == [list(c) for c in zip(*TABLE)]


def test_grid_selection(spark, tmp_path):
    cells = grid.to_cells(text.read_delimited(spark, _write(tmp_path / "t.txt", TABLE)))
    column = lambda df: [r.cell for r in df.orderBy("row").collect()]
    assert column(grid.select_column_named(cells, "b")) == ["b", "2", "5"]
    assert column(grid.select_column(cells, 1)) == ["a", "1", "4"]
    assert _grid(grid.drop_columns(cells, [0, 2, 7])) == [["a", "c"], ["1", "3"], ["4", "6"]]
    assert _grid(grid.head_rows(cells, 2)) == TABLE[:2]


def test_long_lines_join_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(grid, "PIECE", 3)
    cells = spark.createDataFrame([(0, i, f"c{i}") for i in reversed(range(10))], "row long, col long, cell string")
    assert grid.to_lines(cells, ",").first().line == ",".join(f"c{i}" for i in range(10))


def test_wide_and_long(spark):
    df = spark.createDataFrame([("s1", 1.0, 2.0), ("s2", 3.0, 4.0)], "sample string, a double, b double")
    long = reshape.wide_to_long(df, "sample", ["a", "b"])
    assert sorted(map(tuple, reshape.long_to_wide(long, ["a", "b"]).select("sample", "a", "b").collect())) == sorted(map(tuple, df.collect()))


def test_alignment(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sample string, v double")
    order = spark.createDataFrame([("b", 0), ("a", 1)], "sample string, pos int")
    assert [r.sample for r in samples.align_rows(left, order).collect()] == ["b", "a"]
    with pytest.raises(SampleMismatch, match="c missing in left"):
        samples.align_rows(left, order.unionByName(spark.createDataFrame([("c", 2)], order.schema)))
    with pytest.raises(SampleMismatch):
        samples.join_phenotype(left, left.filter("sample = 'a'"), strict=True)
    assert samples.join_phenotype(left.select("sample"), left.filter("sample = 'a'")).count() == 1
    one = left.withColumn("pos", F.when(F.col("sample") == "a", 0).otherwise(1))
    swapped = order.join(left, "sample").select("pos", "sample", F.col("v").alias("w"))
    with pytest.raises(Exception, match="row names differ"):
        samples.positional_join(one, swapped).collect()
    same = one.select("pos", "sample", F.col("v").alias("w"))
    assert samples.positional_join(one, same).count() == 2


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(100)] * 2, "term string").repartition(5)
    got = {r.term: r.term_id for r in text.dense_ids(df, "term", 7).collect()}
    assert got == {f"n{i:03d}": i for i in range(100)}


def test_stepwise_job(spark, tmp_path):
    names = [f"i{i + 1}" for i in range(9)]
    geno = _write(tmp_path / "g.txt", [["HeaderLine", *names], *[[k, *v] for k, v in CEMENT.items()]])
    pheno = _write(tmp_path / "p.txt", [["HeaderLine", *names], ["heat", *CEMENT_Y], ["cool", *[-v for v in CEMENT_Y]]])
    out = str(tmp_path / "out")
    frame = jobs.run_stepwise(spark, geno, pheno, out, pairs=False)
    heat = frame.filter("phenotype = 'heat'").orderBy("position").collect()
    assert [r.term for r in heat] == ["x2", "x1", "(Intercept)"] and [r.newest for r in heat] == [False, True, False]
    assert [r.estimate for r in heat] == pytest.approx([0.65914, 1.43143, 53.02180], abs=1e-5)
    cool = frame.filter("phenotype = 'cool'").orderBy("position").collect()
    assert [r.estimate for r in cool] == pytest.approx([-r.estimate for r in heat])
    lines = [r.value for r in spark.read.text(f"{out}/heat.summary").collect()]
    assert lines[0].startswith("Calculation time (in seconds): ") and f"Genotype File: {geno}" in lines
    assert "The Response variable: heat" in lines and any(line.startswith("x2 ") for line in lines)
    assert spark.read.parquet(f"{out}/model_terms").count() == frame.count()
    total = spark.read.json(f"{out}/total_time").first()
    assert total.minutes == pytest.approx(total.seconds / 60) and total.hours == pytest.approx(total.seconds / 3600)
    steps = spark.read.parquet(f"{out}/steps").filter("phenotype = 'heat'").orderBy("iteration").collect()
    assert [(r.term, r.event) for r in steps] == [("x2", "entered"), ("x1", "entered"), ("x3", "refused")]


def test_stepwise_job_checks_its_input(spark, tmp_path):
    names = [f"i{i + 1}" for i in range(9)]
    geno = _write(tmp_path / "g.txt", [["HeaderLine", *names], ["x3", *CEMENT["x3"]]])
    other = _write(tmp_path / "p.txt", [["HeaderLine", *names[:8], "zz"], ["heat", *CEMENT_Y]])
    with pytest.raises(SampleMismatch):
        jobs.run_stepwise(spark, geno, other, str(tmp_path / "o"))
    with pytest.raises(ValueError):
        jobs.run_stepwise(spark, geno, other, str(tmp_path / "o"), forward=2.0)
    pheno = _write(tmp_path / "q.txt", [["HeaderLine", *names], ["heat", *CEMENT_Y]])
    with pytest.raises(NoTermEntered):
        jobs.run_stepwise(spark, geno, pheno, str(tmp_path / "o"), forward=1e-6)


def test_elapsed(spark):
    assert sinks.elapsed_lines(7200.0)[2] == "Calculation time (in hours): 2.0"
    assert np.isclose(sinks.elapsed(spark.createDataFrame([(90.0,)], "seconds double")).first().minutes, 1.5)


def test_stepwise_job_with_samples_in_another_order(spark, tmp_path):
    names = [f"i{i + 1}" for i in range(9)]
    geno = _write(tmp_path / "g.txt", [["HeaderLine", *names], *[[k, *v] for k, v in CEMENT.items()]])
    pheno = _write(tmp_path / "p.txt", [["HeaderLine", *names[::-1]], ["heat", *CEMENT_Y[::-1]]])
    frame = jobs.run_stepwise(spark, geno, pheno, str(tmp_path / "out"), pairs=False)
    rows = frame.orderBy("position").collect()
    assert [r.term for r in rows] == ["x2", "x1", "(Intercept)"]
    assert [r.estimate for r in rows] == pytest.approx([0.65914, 1.43143, 53.02180], abs=1e-5)


def test_one_trait_without_terms_does_not_lose_the_others(spark, tmp_path):
    names = [f"i{i + 1}" for i in range(9)]
    noise = [1.0, -1.0, 1.0, -1.0, 1.0, -1.0, 1.0, -1.0, 0.0]
    geno = _write(tmp_path / "g.txt", [["HeaderLine", *names], *[[k, *v] for k, v in CEMENT.items()]])
    pheno = _write(tmp_path / "p.txt", [["HeaderLine", *names], ["noise", *noise], ["heat", *CEMENT_Y]])
    out = str(tmp_path / "out")
    with pytest.raises(NoTermEntered, match="noise"):
        jobs.run_stepwise(spark, geno, pheno, out, forward=0.01, backward=0.01, pairs=False)
    written = spark.read.parquet(f"{out}/model_terms")
    assert {r.phenotype for r in written.collect()} == {"heat"}
    assert any("x2" in r.value for r in spark.read.text(f"{out}/heat.summary").collect())


def test_sample_major_job_with_a_dropped_column(spark, tmp_path):
    """The same models as from term-major files; times and status of each trait in its own summary."""
    names = [f"i{i + 1}" for i in range(9)]
    rows = [["id", "note", *CEMENT], *[[n, "NA", *[CEMENT[c][i] for c in CEMENT]] for i, n in enumerate(names)]]
    geno = _write(tmp_path / "g.txt", rows)
    pheno = _write(tmp_path / "p.txt", [["id", "heat", "cool"], *[[names[i], CEMENT_Y[i], -CEMENT_Y[i]] for i in (8, 2, 5, 1, 0, 3, 4, 7, 6)]])
    out = str(tmp_path / "out")
    frame = jobs.run_stepwise(spark, geno, pheno, out, pairs=False, layout="samples", drop=[1])
    heat = frame.filter("phenotype = 'heat'").orderBy("position").collect()
    assert [r.term for r in heat] == ["x2", "x1", "(Intercept)"]
    assert [r.estimate for r in heat] == pytest.approx([0.65914, 1.43143, 53.02180], abs=1e-5)
    runs = {r.phenotype: r for r in spark.read.parquet(f"{out}/runs").collect()}
    assert set(runs) == {"heat", "cool"} and all(r.status == "threshold" and 0 < r.seconds == pytest.approx(60 * r.minutes) for r in runs.values())
    for t in runs:
        lines = [r.value for r in spark.read.text(f"{out}/{t}.summary").collect()]
        assert lines[0] == f"Calculation time (in seconds): {runs[t].seconds}" and "Search ended: threshold" in lines
    with pytest.raises(ValueError):
        jobs.run_stepwise(spark, geno, pheno, out, layout="columns")
    with pytest.raises(BadShape):
        text.read_sample_rows(spark, geno, [0])


def test_summary_lines_are_those_of_the_table(spark):
    rows = [("x1", 1, 2.5, 0.25, 10.0, 1e-9), ("(Intercept)", 2, -1234.5678, 1.5, -823.045, 0.0)]
    table = spark.createDataFrame(rows, "term string, position int, estimate double, std_error double, t_value double, p_value double")
    assert "\n".join(ols.summary_lines(table.collect(), "y")) + "\n" == ols.summary_text(table, "y")


def test_lasso_path_job(spark, tmp_path):
    """Six columns and their fifteen products at four penalties, against Spark's own solver."""
    from termscan.operators import lasso

    rng = np.random.default_rng(21)
    x = np.round(rng.normal(size=(60, 6)), 3)
    y = np.round(3 * x[:, 0] + 2 * x[:, 1] * x[:, 4] + 0.2 * rng.normal(size=60), 4)
    geno = _write(tmp_path / "g.txt", [["id", *[f"m{j}" for j in range(6)]], *[[f"s{i}", *x[i]] for i in range(60)]])
    pheno = _write(tmp_path / "p.txt", [["id", "other", "y"], *[[f"s{i}", 0, y[i]] for i in rng.permutation(60)]])
    out = str(tmp_path / "out")
    regs = [0.001, 0.01, 0.1, 1.0]
    got = jobs.run_lasso_path(spark, geno, pheno, out, regs, trait="y").collect()
    a, b = np.triu_indices(6, 1)
    full, names = np.column_stack([x, x[:, a] * x[:, b]]), [f"m{j}" for j in range(6)] + [f"m{i}_m{j}" for i, j in zip(a, b)]
    df = vector_frame(spark, full, {"y": y})
    for reg in regs:
        want = {r.term: r.estimate for r in lasso.lasso_ml(df, names, reg, tol=1e-13, max_iter=2000).collect() if abs(r.estimate) > 1e-6}
        mine = {r.term: r.estimate for r in got if r.reg == reg and abs(r.estimate) > 1e-6}
        assert mine == pytest.approx(want, abs=1e-4)
    assert {(r.term_a, r.term_b) for r in got if r.term == "m1_m4"} == {(1, 4)}
    fits = spark.read.parquet(f"{out}/fits").collect()
    assert sorted(r.reg for r in fits) == regs and all(r.converged for r in fits)
    with pytest.raises(ValueError):
        jobs.run_lasso_path(spark, geno, pheno, out, regs, trait="nothing")


def test_every_part_has_the_header_of_the_first(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    for k in range(2):
        _write(tmp_path / "ok" / f"part-{k}.txt", [["id", "a", "b"], [f"s{k}", 1, 2]])
    assert sorted(tuple(r) for r in text.read_sample_major(spark, str(tmp_path / "ok")).collect()) == [("s0", 1.0, 2.0), ("s1", 1.0, 2.0)]
    assert [r.b for r in text.read_sample_major(spark, str(tmp_path / "ok"), drop=[1]).collect()] == [2.0, 2.0]
    _write(tmp_path / "ok" / "part-2.txt", [["id", "b", "a"], ["s2", 2, 1]])
    with pytest.raises(Exception, match="header"):
        text.read_sample_major(spark, str(tmp_path / "ok")).collect()
