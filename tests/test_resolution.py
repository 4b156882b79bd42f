"""Roles, backbones and component status on small nested rows."""

from pyspark.sql import functions as F

from harrow.operators import resolution, results

IV = "array<struct<name:string,kind:string,arms:array<string>>>"
ARMS = "array<struct<label:string,type:string>>"


def design(spark, interventions, arms):
    df = spark.createDataFrame([(interventions, arms)], f"i {IV}, a {ARMS}")
    roles = F.transform(resolution.arm_types(F.col("i"), F.col("a")), lambda iv: resolution.role(iv))
    return df.select(roles.alias("r"), resolution.shared_backbone(F.col("i"), F.col("a")).alias("b")).first()


def test_roles_and_backbone(spark):
    arms = [("new plus old", "EXPERIMENTAL"), ("old", "ACTIVE_COMPARATOR")]
    got = design(spark, [("New", "DRUG", ["new plus old"]), ("Old", "DRUG", ["new plus old", "old"]), ("Placebo pill", "DRUG", ["old"]), ("Scan", "PROCEDURE", ["old"])], arms)
    assert got["r"] == ["EXPERIMENTAL", "BACKGROUND", "PLACEBO", "NON_DRUG"] and got["b"] == ["Old"]
    got = design(spark, [("Old", "DRUG", ["new plus old", "old"])], arms)
    assert got["b"] == []  # nothing else is tested


def test_components(spark):
    c = spark.createDataFrame([(1, "A"), (2, "b "), (3, "zz"), (4, "dup"), (5, "bare"), (6, None)], "id int, name string")
    names = spark.createDataFrame([("a", "E1"), ("B", "E2"), ("dup", "E1"), ("dup", "E3"), ("bare", "E4")], "name string, entity string")
    mech = spark.createDataFrame([("E1", "inhibits", "T1"), ("E1", "binds", "T2"), ("E2", "acts", None)], "entity string, mechanism string, target string")
    targets = spark.createDataFrame([("T1", "G2"), ("T2", "G1")], "target string, gene string")
    got = {r["id"]: (r["status"], r["genes"]) for r in resolution.component_status(c, "id", "name", names, mech, targets).collect()}
    assert got == {1: ("RESOLVED", ["G1", "G2"]), 2: ("NO_TARGET", []), 3: ("UNKNOWN", []), 4: ("AMBIGUOUS", []), 5: ("NO_MECHANISM", []), 6: ("UNKNOWN", [])}


def test_names(spark):
    df = spark.createDataFrame([("R-CHOP",), ("drug a + Drug B",), ("AB-1234 (xyz77)",)], "n string")
    got = [r[0] for r in df.select(resolution.expand_regimen(F.col("n"), {"R-CHOP": ["rituximab", "prednisone"]})).collect()]
    assert got[:2] == [["rituximab", "prednisone"], ["drug a", "drug b"]]
    assert df.select(resolution.research_codes(F.col("n")).alias("c")).collect()[2]["c"] == ["AB1234", "XYZ77"]
    issuers = spark.createDataFrame([("Acme Bio, Inc.", 1), ("Acme Bio Holdings Ltd", 2), ("Zed Pharma AG", 3)], "issuer string, cik int")
    got = {r["name"]: (r["cik"], r["method"]) for r in resolution.unique_prefix(spark.createDataFrame([("ACME BIO",), ("Acme Bio Other",), ("Zed Pharma International",)], "name string"), "name", issuers, "issuer", "cik").collect()}
    assert got == {"ACME BIO": (1, "exact"), "Acme Bio Other": (None, None), "Zed Pharma International": (3, "prefix")}


def test_three_valued_reading(spark):
    df = spark.createDataFrame([("<", 0.05), ("<", 0.06), (">", 0.05), (">", 0.01), ("=", 0.05), ("=", None)], "op string, v double")
    assert [r[0] for r in df.select(results.significant(F.col("v"), F.col("op"), F.lit(0.05))).collect()] == [True, None, False, None, True, None]


def test_landed_molecules_with_nulls_and_ties(spark):
    terms = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "term string")
    synonyms = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), (None, 5)], "name string, id int")
    parents = spark.createDataFrame([(1, 9), (2, 9), (2, 9), (3, None)], "id int, parent int")
    assert {r["term"]: r["molecule"] for r in resolution.one_parent(terms, "term", synonyms, parents).collect()} == {"a": 9, "b": None, "c": None, None: None}
    concepts = spark.createDataFrame([("x", 1, "IN"), ("y", 2, "BN"), ("z", 3, "BN"), ("w", 4, None)], "name string, id int, kind string")
    related = spark.createDataFrame([(2, 1), (2, 1), (3, 1), (3, 7)], "id int, ingredient int")
    assert {r["name"]: r["ingredient"] for r in resolution.single_ingredient(concepts, related).collect()} == {"x": 1, "y": 1, "z": None, "w": None}
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    bases, products = spark.createDataFrame([(2, 1)], "id int, base int"), spark.createDataFrame([(1,), (1,)], "id int")
    assert {r["id"]: r["marketed"] for r in resolution.marketed(ids, bases, products).collect()} == {1: True, 2: True, 3: False}


def test_resolved_records(spark):
    arms = [("new", "EXPERIMENTAL"), ("old", "ACTIVE_COMPARATOR")]
    rows = [(1, [("P", "DRUG", ["new"]), ("Q", "DRUG", ["new"])], arms), (2, [("Q", "DRUG", ["old"])], arms), (3, [("P", "DRUG", ["new"])], arms), (4, None, None)]
    designs = spark.createDataFrame(rows, f"id int, interventions {IV}, arms {ARMS}")
    names = spark.createDataFrame([("p", "E")], "name string, entity string")
    mech = spark.createDataFrame([("E", "acts", "T")], "entity string, mechanism string, target string")
    targets = spark.createDataFrame([("T", "G")], "target string, gene string")
    got = {r["id"]: (r["status"], r["drugs"], r["entities"], r["genes"]) for r in resolution.resolve_records(designs, "id", names, mech, targets).collect()}
    assert got == {1: ("PARTIAL", ["P", "Q"], ["E"], ["G"]), 2: ("NO_FOCUS", [], [], []), 3: ("RESOLVED", ["P"], ["E"], ["G"]), 4: ("NO_FOCUS", [], [], [])}
