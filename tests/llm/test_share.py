"""The share that op2 keeps."""

from pagewright.llm import quality_classifier


def test_share_leaves_out_toxic(spark):
    docs = spark.createDataFrame([(i, f"word{i % 5} text {i}") for i in range(40)], "doc_id long, text string")
    rows = [(i, 1, 0 if i < 4 else 1) for i in range(8)] + [(8, 0, 0), (9, 1, None), (0, 1, 0), (0, 1, 0), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert quality_classifier.resample(docs, labels).where("kept").count() == 20  # 5 of 10 labelled documents
