"""Denied evidence that a rule still counts is found."""

from harrow.plans import portfolio


def test_denied_safety_is_found(spark, tmp_path):
    far = "stopped, but not because the independent committee in its long and careful review of all of the sites saw a safety concern with toxicity"
    rows = [(1, far), (2, "stopped due to a safety concern and toxicity"), (3, "no safety concern"), (4, None), (5, f"{far}. There was toxicity and an adverse event")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in docs.where(portfolio.denied_safety(docs["text"])).select("doc_id").collect()] == [1]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert portfolio.denied_evidence(spark, str(tmp_path)).first()[0] == 1
