"""The pipeline's stages: what each keeps, and repeated or odd rows."""

import corpus_pipeline as pipeline
import public_tokenizers
import sentencepiece

DATA = "/root/testdata/sf0.001"


def _odd(spark, docs):
    rows = [
        (None, "Ohne Nummer steht der Text hier.", "de", None, 32), (900001, None, None, None, None), (900002, "", "en", "src1", 0),
        (900003, "12345 !!", "en", "src1", 8), (900004, "the and of it was", None, "src2", 17), (900004, "the and of it was", None, "src2", 17),
    ]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_stages_in_turn(spark):
    docs = _odd(spark, spark.read.parquet(f"{DATA}/documents.parquet"))
    columns, total = docs.columns, docs.count()
    held, counts = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        held = pipeline.settle(stage(spark, held, DATA), name)
        assert held.columns == columns and held.schema == docs.schema, name
        counts.append(held.count())
    # Null, empty and letterless texts go; lines are only cut; groups keep one; contaminated ones go.
    assert counts[0] == total - 3 and counts[1] == counts[0] and counts[1] > counts[2] >= counts[3]
    assert held.where("doc_id = 900004").count() == 2 and held.where("doc_id IS NULL").count() == 1
    out = pipeline.STAGES[-1][1](spark, held, DATA).collect()
    assert len(out) == counts[3] and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.PIECE_MODEL))
    texts = {r.doc_id: r.text for r in held.collect()}
    assert all(list(r.ids) == model.encode(texts[r.doc_id]) for r in out)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0, name


def test_whole_run(spark):
    rows = pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and rows.count() > 0
