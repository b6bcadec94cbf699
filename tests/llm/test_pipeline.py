"""The pipeline and its stages on small tables, with odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import extract, langid, linededup, mixing, pieces, quality, registry, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines int, size string, fp long, row long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and long texts, repeated rows, and extra columns with awkward names."""
    path = tmp_path_factory.mktemp("odd")
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(i, f"{line}\nthe end of document number {i} is near and here it stops, as all things do.", "en", f"s{i % 3}", 9, 0.5, 1, "x", 1, 1) for i in range(12)]
    rows += [(3, rows[3][1], "en", "s0", 9, 0.5, 1, "x", 1, 1)] * 2
    rows += [(None, "a b c", None, None, None, None, None, None, None, None), (50, None, "fr", None, 0, None, 2, "y", 2, 2), (51, "", "de", "s1", 0, None, 2, "y", 2, 2), (52, "w " * 60_000, "en", "s2", 0, None, 2, "y", 2, 2), (53, "||| ### !!!\n" * 50, "en", "s1", 0, None, 2, "y", 2, 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if i == 53 else 1, i % 2) for i in [*range(12), 53, 54]] + [(None, 1, 0), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", "<p>x", "t"), (None, None, None, None), (1, "u", "<p>x", "t")], "page_id long, url string, html string, text string").write.parquet(f"{path}/pages.parquet")
    turns = [(1, 0, "user", "Hello.", 1, "x"), (1, 1, None, None, 2, None), (1, None, "assistant", "w " * 60_000, None, "y"), (1, 0, "user", "Hello.", 1, "x"), (None, None, None, None, None, None), (2, 7, "system", "", 0, "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pos long, block string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(1, [1.0, 2.0], 1, 0), (50, None, 1, 0), (None, [1.0, 2.0], None, 0), (101, [1.0, 2.0], None, 0)], "vec_id long, embedding array<double>, label int, dim int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_take_odd_rows_and_empty_tables(spark, folder, empty, name):
    table = {"op6": "pages", "op2": "embeddings"}.get(name.split("_")[0], "documents")
    got = registry.queries()[name](spark, folder)
    n = spark.read.parquet(f"{folder}/{table}.parquet").count()
    if name.startswith(("op5", "op13")):
        assert got.count() == 0
    elif name.startswith("op11"):
        assert {r.conv_id for r in got.collect()} == {1, 2, None}
    elif name.startswith("op7"):
        assert got.where("rank = 1").count() == n
    else:
        assert got.count() == n
    assert registry.queries()[name](spark, empty).count() == 0


def test_stages_keep_the_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns, name
        path = f"{folder}/stage-{name.replace(' ', '-')}"
        after.write.mode("overwrite").parquet(path)
        before = spark.read.parquet(path)
    lined = spark.read.parquet(f"{folder}/stage-line-dedup")
    assert lined.where(F.contains("text", F.lit("nine ten eleven"))).count() == 1
    assert lined.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert last.where("rank = 1").count() == before.count() and last.where("not round_trip").count() == 0


def test_quality_stage_drops_what_it_rejects(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, sf).select("doc_id").collect()}
    scores = {r.doc_id: r.predicted for r in quality.op1_quality(spark, sf).collect()}
    assert kept == {d for d, p in scores.items() if p}


def test_run_is_the_stages_in_order(spark, folder, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing sources", "sentencepiece"]
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_models_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc def")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, quality.train(docs, labels)).first().score == 0.5
    assert toxicity.scored(docs, toxicity.train(docs, labels)).first().score < 0.01
    assert langid.predicted(docs, langid.train(docs)).first().lang_pred == "und"


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", 7, 8, "k", "h", "m", 1, 2, 3)], "doc_id long, text string, source string, size int, n_lines int, s_key string, h string, __mine string, row int, lines int, fp int")
    for out in (linededup.deduplicated(spark, docs, counts=False), simhash.deduplicated(spark, docs), mixing.mixed(spark, docs).distinct()):
        assert [tuple(r) for r in out.collect()] == [(1, "a b c d", "s", 7, 8, "k", "h", "m", 1, 2, 3)]
    assert pieces.sampled(spark, docs).count() == 2
    page = spark.createDataFrame([(1, "<p>It is a long and good sentence, is it not.", "old", 5)], "page_id long, html string, text string, n_chars int")
    assert extract.extracted(page).first().text == "It is a long and good sentence, is it not."
