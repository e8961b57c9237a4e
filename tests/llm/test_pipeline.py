import corpus_pipeline
from peeratlas.llm import simhash
from peeratlas.llm.storage import cut

from .test_text_models import corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    rows = [(i, t, lang, f"src{i % 3}", len(t)) for i, t, lang, _, _, _ in corpus(300)]
    rows += [(1000 + i, rows[1][1], "aa", "src1", 0) for i in range(30)] + [(2000, "12 34", None, None, 5), (2001, None, None, "src0", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, q, 0) for i, *_, q in corpus(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, str(tmp_path)), "stage")
        assert after.columns == docs.columns
        kept[name] = {r.doc_id for r in after.collect()}
        docs = after
    bad = {i for i, q, _ in labels if not q}
    assert len(kept["quality classifier"] & bad) < 0.2 * len(bad) and len((kept["quality classifier"] & set(range(300))) - bad) > 0.97 * (300 - len(bad))
    assert not kept["language ID"] & {2000, 2001}
    groups = [r.component_id for r in simhash.near_duplicates(docs.distinct()).collect()]
    assert len(kept["SimHash near-dedup"] & {1, *range(1000, 1030)}) == 1 and groups
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and set(packed.doc_id) <= kept["mixing to target weights"]


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x", "s", 1)] * 3 + [(None, "other text of no id", "x", "s", 1)] * 2, DOCS)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.dedup(spark, docs, "").collect()) == ["1", "None"]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
