import corpus_pipeline
from tabloom.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pack_everything(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == names, name
        assert docs.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
