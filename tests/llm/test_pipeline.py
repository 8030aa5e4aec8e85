import importlib.util

import pytest
from pyspark.sql import functions as F

from .corpus import SCHEMA, documents
from .test_exact_dedup import brute_lines
from .test_omh import brute as brute_classes

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else pytest.skip("taken out", allow_module_level=True)


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(*r[:4], None if r[1] is None else len(r[1])) for r in documents(n=40)]
    rows += [(3000, "12 34", "en", "s", 5), (3001, "日本語 テスト " * 9, "en", "s", 70)]
    item = " ".join(f"bench{chr(97 + i)}mark" for i in range(20))
    rows.append((3002, f"Some text before {item} and after", "en", "s", 10))
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        after = [tuple(r) for r in docs.collect()]
        left[name] = (before, after)
        if name != "packing":
            assert docs.columns == columns
    before, after = left["language_id"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert {3000, 3001, 1001, 1002, 1003} <= gone and {r[0] for r in before if r[1] and r[0] not in (3000, 3001) and any(c.isalpha() for c in r[1])} <= {r[0] for r in after}
    before, after = left["line_dedup"]
    removed = brute_lines(before, 5)
    assert sorted((str(r[0]), r[1], r[4]) for r in after) == sorted((str(r[0]), t := "\n".join(s for n, s in enumerate(r[1].split("\n")) if n not in removed[r[0]]), len(t)) for r in before)
    before, after = left["near_dedup"]
    want = [min(c, key=lambda i: -1 if i is None else i) for c in brute_classes(before)]
    assert sorted(map(str, want)) == sorted(str(r[0]) for r in after)
    before, after = left["decontamination"]
    assert {r[0] for r in before} - {r[0] for r in after} == {3002}
    before, after = left["packing"]
    assert {r[0] for r in after} == {r[0] for r in before}


def test_stages_keep_columns_of_any_name(spark, folder):
    """Names that the stages use themselves come back as they were."""
    names = ["id", "removed", "__id", "__removed", "first_id", "hit_id", "kept", "t", "w", "class_id", "n_removed", "rate"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars")
    docs = docs.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in names])
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == docs.columns, name
        rows = left.collect()
        assert rows and all(r[n] == f"{n}{'null' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in names), name
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert 3002 not in {r["doc_id"] for r in out.collect()} and out.count() > 10


def test_entry_registers_the_queries():
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and sum(n.startswith("op") for n in e.queries()) == 10 and SCHEMA
