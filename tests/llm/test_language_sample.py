"""The training sample of the language models holds every label."""

from __future__ import annotations

from ledgerline.llm import language


def test_every_label_is_learned_in_full(spark):
    rows = [(n * 100 + i, f"text of label {n}", f"l{n:03d}") for n in range(75) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.training_sample(docs)
    assert len(sample) == 75
    assert {text.count("\n") + 1 for text in sample.values()} == {language.TRAIN_DOCS}
