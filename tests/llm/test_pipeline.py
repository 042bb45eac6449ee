"""The stages on the smallest tables, each against what its input demands."""

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import plain_shingles

FOLDER = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in entry.queries()) == 1 for n in names) and "pipeline" in entry.queries()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        was, now = before.collect(), docs.collect()
        if name != "subwords":
            assert docs.columns == columns
        if name == "toxicity":
            toxic = dict(duckdb.sql(f"select doc_id, toxic from '{FOLDER}/labels.parquet'").fetchall())
            gone = {r.doc_id for r in was} - {r.doc_id for r in now}
            assert sum(toxic.get(i) == 0 for i in gone) <= 1
        if name == "line_dedup":
            kept = {r.doc_id for r in now}
            assert all(r.doc_id in kept or (r.text or "").strip() for r in was) and all((r.text or "").strip() or r.doc_id not in kept for r in now)
            lines = [x for r in now for x in r.text.split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
        if name == "jaccard_join":
            sets = [s for r in now if (s := plain_shingles(r.text))]
            assert not any(100 * len(x & y) >= 80 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
            assert sum(not plain_shingles(r.text) for r in was) == sum(not plain_shingles(r.text) for r in now)
        if name == "mixing":
            assert {r.doc_id for r in now} <= {r.doc_id for r in was}
            text = {r.doc_id: r.text or "" for r in was}
            assert all(r.text in text[r.doc_id] for r in now)
        if name == "subwords":
            assert len(now) == len(was) and all(r.lossless for r in now)
