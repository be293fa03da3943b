import pytest

from tests.compare import assert_same
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_pipeline_equals_sql(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert_same(corpus_pipeline.run(spark, sf), corpus_pipeline.ORACLE_SQL, sf)


def test_stages_take_awkward_rows(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_ops import AWKWARD

    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"
    rows = [(i, t, None, f"s{i % 3}" if i % 5 else None, None, "x", "y") for i, t in enumerate(AWKWARD)] + [(None, "a b c d e f g h i j k", None, None, None, None, None)] * 2
    spark.createDataFrame([(1, "word0 word1"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "mixing":
                assert out.columns == docs.columns and out.schema["kept"] == docs.schema["kept"]
                assert {r["kept"] for r in out.collect()} <= {"y", None} and {r["size"] for r in out.collect()} <= {"x", None}
                out.write.mode("overwrite").parquet(f"{tmp_path}/{name}{len(data)}")
                docs = spark.read.parquet(f"{tmp_path}/{name}{len(data)}")
            else:
                assert {"taken", "target"} <= set(out.columns) and (out.count() > 0 or not data)
                assert {r["kept"] for r in out.collect()} <= {"y", None}


def test_line_dedup_without_n_chars(spark):
    from tidemark.llm import pipeline

    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (2, "a b"), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in pipeline.line_dedup(spark, docs, "").collect()] == [(1, "a b")]


def test_near_stage_finds_all_that_brute_force_finds_in_its_input(spark):
    """Recall of the near-duplicate stage on what the stages before it leave, with copies planted that differ on every line."""
    from tests.llm import brute
    from tidemark.llm import pipeline

    sf = "/root/testdata/sf0.01"
    docs = pipeline.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    made = [(100_000 + r["doc_id"], "\n".join(" ".join([f"x{r['doc_id']}", f"y{k}", *line.split(" ")]) for k, line in enumerate(r["text"].split("\n"))), r["lang"], r["source"], r["n_chars"]) for r in docs.collect() if len(r["text"]) > 400 * (1 + r["text"].count("\n"))][:40]
    rows = pipeline.line_dedup(spark, docs.unionByName(spark.createDataFrame(made, docs.schema)), sf).collect()
    left = spark.createDataFrame(rows, docs.schema)
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, left, sf).collect()}
    groups = brute.near_groups([(r["doc_id"], r["text"]) for r in rows], words=5)
    assert kept == {i for i, (_, component) in groups.items() if i == component}
    assert len(made) == 40 and len({r["doc_id"] for r in rows if r["doc_id"] >= 100_000} - kept) >= 30
