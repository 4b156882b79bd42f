"""Text rules on judged reasons."""

import pytest
from pyspark.sql import functions as F

from harrow.functions import text
from harrow.operators import classify

#: Stated reasons with their judged label and reason.
JUDGED = [
    ("Per sponsor request. Premature closure was not prompted by any safety or efficacy concerns.", "NON_BIOLOGICAL", "OPERATIONAL"),
    ("Terminated due to lack of efficacy in interim analysis.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Study stopped because of unacceptable toxicity and serious adverse events.", "BIOLOGICAL_FAILURE", "SAFETY"),
    ("Terminated due to slow accrual and difficulty recruiting participants.", "NON_BIOLOGICAL", "OPERATIONAL"),
    ("Terminated due to business decision and portfolio prioritization; not related to safety.", "NON_BIOLOGICAL", "OPERATIONAL"),
    ("Stopped for futility after interim analysis showed no benefit.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Not due to safety concerns; terminated due to lack of efficacy.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Not due to efficacy; stopped because of safety concerns and adverse events.", "BIOLOGICAL_FAILURE", "SAFETY"),
    ("Reason not provided.", "UNCLEAR", "OTHER/UNKNOWN"),
    ("The study was ended for strategic reasons and changes in the external environment. The safety profile and risk benefit ratio remained unchanged.", "NON_BIOLOGICAL", "OPERATIONAL"),
    ("Efficacy concerns.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Safety concern.", "BIOLOGICAL_FAILURE", "SAFETY"),
    ("Insufficient efficacy.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Futility analysis.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Did not meet the primary endpoint.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Primary endpoint not met.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Unmet primary endpoint.", "BIOLOGICAL_FAILURE", "EFFICACY/FUTILITY"),
    ("Unacceptable toxicity.", "BIOLOGICAL_FAILURE", "SAFETY"),
    ("Adverse effects.", "BIOLOGICAL_FAILURE", "SAFETY"),
    ("Terminated due to slow accrual.", "NON_BIOLOGICAL", "OPERATIONAL"),
    ("Sponsor terminated the study due to non-safety reasons. Based on the data and the current competitive landscape, Sponsor made the decision to close the study.", "NON_BIOLOGICAL", "OPERATIONAL"),
    ("Pfizer decided terminating study for administrative reasons. The decision wasn't due to safety concerns or requests from regulatory authorities.", "NON_BIOLOGICAL", "OPERATIONAL"),
    ("The research was terminated voluntarily due to changes in the company's business strategy regarding the development of BGB-24714, rather than any safety issues.", "NON_BIOLOGICAL", "OPERATIONAL"),
    ("Emerging clinical data evaluated by Pfizer and shared with regulatory authorities indicates that the risk profile of voxelotor in people with SCD exceeds the benefits observed in previously generated global", "BIOLOGICAL_FAILURE", "SAFETY"),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = spark.createDataFrame([(j[0],) for j in JUDGED], "t string").select("t", classify.classify_reason(F.col("t")).alias("c")).collect()
    return {r["t"]: (r["c"]["label"], r["c"]["reason"]) for r in rows}


@pytest.mark.parametrize("t, label, reason", JUDGED)
def test_judged_reasons(judged, t, label, reason):
    assert judged[t] == (label, reason)


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_denial_ends_with_its_clause(spark):
    assert one(spark, classify.occurrences(F.col("t"), "toxicity"), "no delay; toxicity was seen") == 1
    assert one(spark, classify.occurrences(F.col("t"), "toxicity"), "no delay or toxicity was seen") == 0


def test_sentences_and_partial_dates(spark):
    assert one(spark, text.sentences(F.col("t")), "One. Two? Three") == ["One.", "Two?", "Three"]
    assert str(one(spark, text.partial_date(F.col("t")), "2020-05")) == "2020-05-01"
    assert one(spark, text.partial_date(F.col("t")), "soon") is None


def test_fallback_takes_what_says_something(spark):
    got = one(spark, classify.with_fallback(F.lit("Unknown."), F.lit(None).cast("string"), F.col("t")), "It was stopped due to lack of efficacy.")
    assert (got["c"]["label"], got["source"]) == ("BIOLOGICAL_FAILURE", 2)
