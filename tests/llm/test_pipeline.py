import corpus_pipeline
from pyspark.sql import functions as F

from tabgauge.llm import neardup, quality
from test_decontaminate import brute_force as contaminated
from test_neardup import brute_force as components
from test_secrets import added, base

FOLDER = "/root/testdata/sf0.001"


def test_stages_as_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns(
        {"_id": F.lit("own"), "kept": F.lit(1)}
    )
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality_rules", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"
    ]
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in kept}

    def step(name, before):
        table = spark.createDataFrame(list(before.values()), docs.schema)
        out = stages[name](spark, table, FOLDER)
        assert out.columns == columns
        return {r.doc_id: r for r in out.collect()}

    assert {r.doc_id: r for r in stages["quality_rules"](spark, docs, FOLDER).collect()} == rows
    expected = components([(i, r.text) for i, r in rows.items()])
    found = step("near_duplicates", rows)
    rows = {i: r for i, r in rows.items() if expected[i][2]}
    assert found == rows
    found = step("decontamination", rows)
    rows = {i: r for i, r in rows.items() if not contaminated(r.text, items)[4]}
    assert found == rows
    found = step("secret_scan", rows)
    assert set(found) == set(rows)
    changed = 0
    for i, r in rows.items():
        spans = base(r.text) + added(r.text)
        new = found[i]
        assert new.n_chars == len(new.text) and new.lang == r.lang
        assert (new.text == r.text) == (not spans)
        assert not base(new.text)
        changed += bool(spans)
    assert changed
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_repeated_rows_stay_once(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text + " x"), (None, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, id int")
    found = sorted(map(tuple, neardup.distinct_documents(docs).collect()), key=repr)
    assert found == sorted([(1, text, 5), (None, "a b c d e f", 5), (3, None, 5), (3, None, 5)], key=repr)


def test_empty_table_through_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.collect() == []
