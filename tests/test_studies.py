"""Whole studies: fields, absent sections, broken lines, what a plan reads; export rows; arrays, postings, mentions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from harrow.operators import classify, comparison, study
from harrow.plans import studies as plans
from harrow.sources import index, studies, tables

from . import oracle

AREAS = {"Oncology": ("neoplasm", "cancer"), "Cardiology": ("heart",)}


def land(spark, tmp_path, *records):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return studies.land_studies(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_registry_fields_and_absent_sections(spark, tmp_path):
    whole = {
        "protocolSection": {"identificationModule": {"nctId": "NCT00000010"}, "contactsLocationsModule": {"locations": [{"country": "United States"}, {"country": " Germany"}, {"country": "Germany"}, {}]}},
        "derivedSection": {"conditionBrowseModule": {"meshes": [{"id": "D009369", "term": "Neoplasms"}]}},
    }
    counts = {r["rejected"]: r["n"] for r in land(spark, tmp_path, whole, {}, {"protocolSection": None, "derivedSection": None}, '{"protocolSection": {"identif', "not json", {"hasResults": "maybe"}).collect()}
    assert counts == {False: 3, True: 3}
    rows = {r["nct_id"]: r.asDict() for r in study.study_record(studies.landed(spark, str(tmp_path / "out")), AREAS).collect()}
    r = rows["NCT00000010"]
    assert (r["countries"], r["mesh_terms"], r["disease_area"], r["disease_areas_matched"], r["url"]) == ("Germany; United States", "Neoplasms", "Oncology", "Oncology", "https://clinicaltrials.gov/study/NCT00000010")
    assert {v for k, v in rows[""].items() if not k.startswith(("classification", "disease_area"))} == {""} and rows[""]["disease_area"] == "Other"
    assert sorted(r[0] for r in studies.rejected(spark, str(tmp_path / "out")).collect()) == ["not json", '{"hasResults": "maybe"}', '{"protocolSection": {"identif']


def test_records_carry_the_classification(spark, tmp_path):
    def one(i, why, summary=None):
        return {"protocolSection": {"identificationModule": {"nctId": f"NCT{i}"}, "statusModule": {"whyStopped": why}, "descriptionModule": {"briefSummary": summary}}}

    land(spark, tmp_path, one(1, "terminated due to lack of efficacy and futility"), one(2, "slow accrual"), one(3, "see description", "The trial was stopped due to toxicity and a safety concern."), one(4, None))
    got = {r["nct_id"]: r for r in study.study_record(studies.landed(spark, str(tmp_path / "out")), AREAS).collect()}
    texts = spark.createDataFrame([("NCT1", "terminated due to lack of efficacy and futility"), ("NCT2", "slow accrual")], "i string, t string")
    for r in texts.select("i", classify.classify_reason(F.col("t")).alias("c")).collect():
        assert (got[r["i"]]["classification_label"], got[r["i"]]["classification_reason"], got[r["i"]]["classification_source"]) == (r["c"]["label"], r["c"]["reason"], 0)
    assert (got["NCT3"]["classification_label"], got["NCT3"]["classification_source"]) == ("BIOLOGICAL_FAILURE", 1)
    assert got["NCT4"]["classification_label"] == "UNCLEAR"


def test_stop_dates_and_origins(spark, tmp_path):
    def one(i, status, pcd=None, kind=None, why="slow accrual"):
        return {"protocolSection": {"identificationModule": {"nctId": i}, "statusModule": {"overallStatus": status, "whyStopped": why, "primaryCompletionDateStruct": {"date": pcd, "type": kind}, "lastUpdatePostDateStruct": {"date": "2021-01"}}}}

    land(spark, tmp_path, one("a", "TERMINATED", "2020-05", "ACTUAL"), one("b", "SUSPENDED", "2020-05", "ESTIMATED"), one("c", "WITHDRAWN"), one("d", "COMPLETED", "2020-05", "ACTUAL"), one("e", None), one("f", "TERMINATED", None, "ACTUAL"))
    known = spark.createDataFrame([("a", "L", "R", "S"), ("d", "L", "R", "S")], "nct_id string, label string, reason string, source string")
    got = {r["nct_id"]: r for r in study.universe_record(studies.landed(spark, str(tmp_path / "out")), known, AREAS).collect()}
    facts = {i: (r["stop_date_estimate"], r["stop_date_basis"], r["classification_origin"], r["classification_outcome"]) for i, r in got.items()}
    assert facts == {
        "a": ("2020-05", "PRIMARY_COMPLETION_ACTUAL", "CANONICAL_SNAPSHOT", "L"), "b": ("2021-01", "LAST_UPDATE_POSTED", "UNIVERSE_CLASSIFIED", "NON_BIOLOGICAL"), "c": ("2021-01", "LAST_UPDATE_POSTED", "UNIVERSE_CLASSIFIED", "NON_BIOLOGICAL"),
        "d": (None, None, None, None), "e": (None, None, None, None), "f": ("2021-01", "LAST_UPDATE_POSTED", "UNIVERSE_CLASSIFIED", "NON_BIOLOGICAL"),
    }


def test_plans_read_named_leaves_only(spark):
    out = plans.landed(spark, str(oracle.DATA))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = study.study_record(studies.landed(spark, out), AREAS).select("nct_id", "countries")._jdf.queryExecution().toString()
    schema = plan.rsplit("ReadSchema: ", 1)[1].splitlines()[0]
    assert "nctId" in schema and "country" in schema
    assert not any(x in schema for x in ("whyStopped", "briefTitle", "armsInterventions", "meshes", "detailedDescription"))


def test_export_rows_of_sparse_records(spark):
    schema = """nct_id string, brief_title string, phases array<string>, overall_status string, start_date string, stop_date_estimate string, closed boolean, biological boolean, sponsor_group string,
        interventions array<struct<role:string,components:array<struct<name:string,label:string>>>>, enrollment_count long, classification_outcome string, classification_primary_reason string, classification_source string,
        why_stopped string, attribution string, attribution_basis string, endpoint_verdict string, endpoint_basis string, endpoint_undecided boolean"""
    drugs = [("COMPARATOR", [("b", "x"), (None, "a"), ("", "c"), (None, None)]), ("COMPARATOR", None), ("EXPERIMENTAL_ARM", [(f"d{i}", None) for i in range(9, 0, -1)])]
    full = ("n", " a  title " + "x" * 300, ["PHASE2", "PHASE3"], "COMPLETED", "2020-05-01", "2021-02-03", True, None, "s", drugs, 7, "o", "p", "REVIEWED_X", "why", None, None, "UNREADABLE", "posted", True)
    rows = {r["nct_id"]: r for r in study.export_rows(spark.createDataFrame([full, ("e", *[None] * 19)], schema)).collect()}
    assert tuple(rows["n"].asDict()) == study.EXPORT_COLUMNS
    r = rows["n"]
    assert len(r["title"]) == 200 and r["title"].startswith("a title x")
    assert (r["phase"], r["start"], r["stopped"], r["comparator_drugs"], r["experimental_drugs"], r["enrollment"], r["stop_classified_by"], r["why_stopped"], r["primary_endpoint"], r["endpoint_basis"]) == ("3", "2020-05", "2021-02", "a; b; c", "d1; d2; d3; d4; d5; d6", "7", "manual review", "", "NOT_ASSESSABLE", "")
    assert rows["e"].asDict() == dict.fromkeys(study.EXPORT_COLUMNS, "") | {"nct_id": "e", "phase": "2", "closed": "no", "biological_stop": "no"}


@pytest.mark.parametrize("n, per_file, pretty", [(0, 10, False), (1, 10, True), (95, 10, False), (95, 1000, True)])
def test_arrays_read_back_equal(spark, tmp_path, n, per_file, pretty):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f'say "{i}"\n', [i, None]) for i in range(n)], "id long, t string, items array<long>")
    tables.write_json_arrays(df, str(tmp_path / "out"), per_file, pretty)
    texts = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    arrays = [json.loads(t) for t in texts]
    assert sorted((x["id"], x["t"], x["items"]) for a in arrays for x in a) == [(r["id"], r["t"], r["items"]) for r in df.orderBy("id").collect()]
    assert len(arrays) == max(1, -(-n // per_file)) and (not pretty or n == 0 or "\n  " in texts[0])
    assert tables.read_json(spark, str(tmp_path / "out"), "id long, t string, items array<long>", lines=False).exceptAll(df).count() == 0


def test_postings_read_their_folders_only(spark, tmp_path):
    df = spark.createDataFrame([(i, [f"t{i % 40}", "common", None, "", "common"]) for i in range(400)], "id long, terms array<string>")
    index.write_index(df, str(tmp_path / "i"), "id", F.col("terms"))
    hits = index.postings(spark, str(tmp_path / "i"), ["t3", "t5", "none"])
    assert sorted(r["id"] for r in hits.collect()) == [i for i in range(400) if i % 40 in (3, 5)]
    plan = hits._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert hits.rdd.getNumPartitions() and index.postings(spark, str(tmp_path / "i"), []).count() == 0
    assert index.postings(spark, str(tmp_path / "i"), ["common"]).count() == 400


def plain_verdict(subject, classes, genes, mechanisms, modality):
    shared, same = set(genes) & set(subject.genes), bool(subject.modality) and modality == subject.modality
    of = lambda gs: {c for c, members in classes.items() if members & set(gs)}
    paths = sorted(of(genes) & of(subject.genes))
    if not genes and not mechanisms:
        return "unknown"
    if shared and (same or not subject.modality):
        return "closest"
    if shared or paths or set(mechanisms) & set(subject.mechanisms):
        return "related"
    return "weak" if same else "distant"


@pytest.mark.parametrize("subject", [comparison.Subject(["g1", "g2"], ["m1"], "x"), comparison.Subject(["g1"], [], ""), comparison.Subject([], ["m2"], "y"), comparison.Subject(["none"], [], "z")])
def test_comparison_equals_the_rules(spark, tmp_path, subject):
    classes = {"A": {"g1", "g3"}, "B": {"g2", "g4", "g5"}, "C": {"g6"}}
    assets = [(i, [f"g{j}" for j in range(1, 8) if (i >> j) % 5 == 0 and i % 3], [f"m{i % 4}"] if i % 5 else None, ["x", "y", "w"][i % 3], i % 7) for i in range(200)]
    lexicon = spark.createDataFrame([(c, g) for c, gs in classes.items() for g in gs], "class string, gene string")
    comparison.write_class_index(lexicon, str(tmp_path / "c"))
    df = spark.createDataFrame(assets, "id long, g array<string>, m array<string>, mod string, n int")
    comparison.write_asset_index(df, str(tmp_path / "a"), "id", F.col("g"), F.col("m"), F.array("mod"), F.col("n"))
    got = {r["asset"]: r["verdict"] for r in comparison.related_assets(spark, str(tmp_path / "a"), str(tmp_path / "c"), subject).collect()}
    for i, g, m, mod, _ in assets:
        want = plain_verdict(subject, classes, g, m or [], mod)
        assert got.get(i, want if want in ("distant", "unknown") else None) == want, i


def test_first_of_a_hot_key(spark):
    """One key with most rows: tasks keep k rows of it before the shuffle, and ties go by id."""
    rows = [("hot" if i % 10 else f"k{i % 7}", i, i % 13) for i in range(5000)] + [(None, -1, 99)]
    df = spark.createDataFrame(rows, "key string, id long, v int").repartition(8)
    best = comparison.first_per_key(df, "key", "id", [F.desc("v")], 20)
    assert best._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    got = {}
    for r in best.collect():
        got.setdefault(r["key"], []).append((r["rank"], r["id"]))
    for key in {k for k, *_ in rows if k}:
        want = sorted((i for k, i, _ in rows if k == key), key=lambda i: (-(i % 13), i))[:20]
        assert sorted(got[key]) == list(enumerate(want, 1))
    ids = spark.createDataFrame([("hot",), ("none",)], "who string")
    found = {r["who"]: [m["id"] for m in r["mentions"]] for r in comparison.mentions(ids, "who", df, "key", "id", [F.desc("v")], ["v"]).collect()}
    assert found == {"hot": [i for _, i in sorted(got["hot"])], "none": []}
