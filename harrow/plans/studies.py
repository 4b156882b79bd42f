"""Whole studies (B2, B5, B17) and registry events (C14). An order is a study: its customer sponsors it, its lines are the
interventions, their suppliers' nations the sites; it lands as JSON lines, a part of which is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots, study
from ..sources import studies
from ..sources.scratch import folder
from .changes import DIFF, releases
from .reading import REASON, reasons
from .registry import query, table

LEXICON = {"Transport": ("automobile", "machinery"), "Home": ("household", "furniture"), "Works": ("building", "machinery")}
STATUS = "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'TERMINATED' ELSE 'WITHDRAWN' END WHEN o_orderstatus = 'O' THEN 'COMPLETED' ELSE 'RECRUITING' END"
DAY = "strftime(CAST(o_orderdate AS DATE) + INTERVAL ({n}) DAY, '%Y-%m-%d')"


def _day(days: int):
    return F.date_format(F.date_add(F.to_date("o_orderdate"), days), "yyyy-MM-dd")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text a study."""
    k = F.col("o_orderkey")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey").join(suppliers, "l_suppkey")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "BIOLOGICAL").when(F.col("l_linenumber") % 3 == 1, "DRUG")
    item = F.struct("l_linenumber", "p_name", kind.alias("kind"), F.concat(F.lit(" "), "n_name").alias("country"))
    lines = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey").join(lines, "o_orderkey", "left").join(reasons(spark, sf_dir).select("o_orderkey", "reason"), "o_orderkey")
    date = lambda d, t: F.struct(d.alias("date"), t.alias("type"))
    kinds = F.when(k % 2 == 0, "ACTUAL").otherwise("ESTIMATED")
    status = F.when(F.col("o_orderstatus") == "F", F.when(k % 2 == 0, "TERMINATED").otherwise("WITHDRAWN")).when(F.col("o_orderstatus") == "O", "COMPLETED").otherwise("RECRUITING")
    nct = F.concat(F.lit("NCT"), F.lpad(k.cast("string"), 8, "0"))
    phases = F.when(k % 4 == 1, F.array(F.lit("PHASE2"))).when(k % 4 == 2, F.array(F.lit("PHASE2"), F.lit("PHASE3"))).when(k % 4 == 3, F.array().cast("array<string>"))
    protocol = F.struct(
        F.struct(nct.alias("nctId"), F.when(k % 10 > 0, F.concat(F.lit("Study "), nct)).alias("briefTitle"), F.concat(F.lit("Official "), nct).alias("officialTitle")).alias("identificationModule"),
        F.struct(
            status.alias("overallStatus"), F.when(status.isin(*study.STOPPED), F.col("reason")).alias("whyStopped"), date(F.when(k % 3 == 0, F.substring(_day(0), 1, 7)).otherwise(_day(0)), F.lit("ACTUAL")).alias("startDateStruct"),
            F.when(k % 11 > 0, date(_day(200), kinds)).alias("primaryCompletionDateStruct"), date(_day(300), kinds).alias("completionDateStruct"), F.struct(_day(400).alias("date")).alias("lastUpdatePostDateStruct"),
        ).alias("statusModule"),
        F.when(k % 5 == 0, F.struct(F.lit("A summary.").alias("briefSummary"))).alias("descriptionModule"),
        F.struct(F.array(F.col("c_mktsegment"), F.when(k % 7 == 0, "Rare disease")).alias("conditions")).alias("conditionsModule"),
        F.struct(F.struct(F.col("c_name").alias("name"), F.when(k % 2 == 0, "INDUSTRY").alias("class")).alias("leadSponsor"), F.when(k % 3 == 0, F.array(F.struct(F.lit("A").alias("name")), F.struct(F.lit(None).cast("string").alias("name")), F.struct(F.lit("B").alias("name")))).alias("collaborators")).alias("sponsorCollaboratorsModule"),
        F.struct(F.when(k % 6 > 0, "INTERVENTIONAL").alias("studyType"), phases.alias("phases"), F.struct(F.lit("RANDOMIZED").alias("allocation")).alias("designInfo"), F.struct(F.floor(F.col("o_totalprice") / 1000).alias("count"), kinds.alias("type")).alias("enrollmentInfo")).alias("designModule"),
        F.struct(F.transform("items", lambda x: F.struct(x["p_name"].alias("name"), x["kind"].alias("type"))).alias("interventions")).alias("armsInterventionsModule"),
        F.struct(F.transform("items", lambda x: F.struct(x["country"].alias("country"))).alias("locations")).alias("contactsLocationsModule"),
    )
    derived = F.when(k % 4 == 0, F.struct(F.struct(F.array(F.struct(F.lit("D1").alias("id"), F.lit("Machinery").alias("term")), F.struct(F.lit("D2").alias("id"), F.lit(None).cast("string").alias("term"))).alias("meshes")).alias("conditionBrowseModule")))
    whole = F.to_json(F.struct(protocol.alias("protocolSection"), derived.alias("derivedSection"), (k % 6 == 0).alias("hasResults"), F.lit("ignored").alias("moreSections")))
    broken = F.when(k % 100 == 99, F.array(whole, F.substring(whole, 1, 60))).otherwise(F.array(whole))
    return rows.select(F.explode(broken).alias("value"))


def landed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the landed table. The lines are packed: as plain text they are some ten times what they hold."""
    lines, out = folder(spark), folder(spark)
    raw(spark, sf_dir).write.option("zlib.compress.level", "BEST_SPEED").text(lines, compression="gzip")
    studies.land_studies(spark, lines, out)
    return out


#: Areas by words in conditions and mesh terms: most words first, ties by name.
AREA = "CASE WHEN {m} AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') THEN {both} ELSE {one} END"
BASE_SQL = f"""i AS (SELECT l_orderkey, string_agg(p_name, '; ' ORDER BY l_linenumber, p_name) AS names, string_agg(CASE l_linenumber % 3 WHEN 0 THEN 'BIOLOGICAL' WHEN 1 THEN 'DRUG' END, '; ' ORDER BY l_linenumber, p_name) AS kinds,
    array_to_string(list_sort(list(DISTINCT n_name)), '; ') AS countries FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
  a AS (SELECT *, 'NCT' || lpad(o_orderkey::VARCHAR, 8, '0') AS nct, {STATUS} AS status, {REASON} AS reason,
    (c_mktsegment IN ('AUTOMOBILE', 'MACHINERY'))::INT + (o_orderkey % 4 = 0 AND c_mktsegment <> 'MACHINERY')::INT AS transport, (c_mktsegment IN ('HOUSEHOLD', 'FURNITURE'))::INT AS home,
    (c_mktsegment IN ('BUILDING', 'MACHINERY'))::INT + (o_orderkey % 4 = 0 AND c_mktsegment <> 'MACHINERY')::INT AS works FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN i ON l_orderkey = o_orderkey),
  b AS (SELECT *, list_transform(list_sort(list_filter([{{'n': -transport, 'a': 'Transport'}}, {{'n': -home, 'a': 'Home'}}, {{'n': -works, 'a': 'Works'}}], lambda x: x.n < 0)), lambda x: x.a) AS areas FROM a)"""


@query(
    "b02_flat_studies",
    f"""WITH {BASE_SQL} SELECT nct AS nct_id, CASE WHEN o_orderkey % 10 > 0 THEN 'Study ' ELSE 'Official ' END || nct AS brief_title, status AS overall_status, CASE WHEN status IN ('TERMINATED', 'WITHDRAWN') THEN reason ELSE '' END AS why_stopped,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Machinery' ELSE '' END AS mesh_terms, coalesce(countries, '') AS countries, CASE WHEN o_orderkey % 6 > 0 THEN 'INTERVENTIONAL' ELSE '' END AS study_type, CASE o_orderkey % 4 WHEN 1 THEN 'PHASE2' WHEN 2 THEN 'PHASE2; PHASE3' ELSE '' END AS phases,
    c_name AS lead_sponsor, CASE WHEN o_orderkey % 3 = 0 THEN 'A; B' ELSE '' END AS collaborators, c_mktsegment || CASE WHEN o_orderkey % 7 = 0 THEN '; Rare disease' ELSE '' END AS conditions, coalesce(names, '') AS intervention_names, coalesce(kinds, '') AS intervention_types,
    CASE WHEN o_orderkey % 3 = 0 THEN substring({DAY.format(n=0)}, 1, 7) ELSE {DAY.format(n=0)} END AS start_date, CASE WHEN o_orderkey % 11 > 0 THEN {DAY.format(n=200)} ELSE '' END AS primary_completion_date, {DAY.format(n=300)} AS completion_date, {DAY.format(n=400)} AS last_update_post_date,
    'https://clinicaltrials.gov/study/' || nct AS url, coalesce(areas[1], 'Other') AS disease_area, array_to_string(list_sort(areas), '; ') AS disease_areas_matched FROM b""",
)
def flat_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed studies as records. The classification columns follow rules that SQL can't say; tests hold them."""
    out = study.study_record(studies.landed(spark, landed(spark, sf_dir)), LEXICON)
    return out.drop("classification_label", "classification_reason", "classification_confidence", "classification_source")


@query("a17_rejected_lines", "SELECT count(*) AS n, min(60)::INTEGER AS chars FROM orders WHERE o_orderkey % 100 = 99")
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no study are kept beside the landed table."""
    bad = studies.rejected(spark, landed(spark, sf_dir))
    return bad.agg(F.count("*").alias("n"), F.max(F.length(studies.CORRUPT)).alias("chars"))


#: What the snapshot knows: studies of even number.
SNAPSHOT = "o_orderkey % 2 = 0"


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where(SNAPSHOT).select(F.concat(F.lit("NCT"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("nct_id"), F.when(F.col("o_orderkey") % 3 == 0, "BIOLOGICAL").otherwise("OPERATIONAL").alias("label"), F.lit("SAFETY").alias("reason"), F.when(F.col("o_orderkey") % 4 == 0, "REVIEWED_BY_HAND").otherwise("RULES").alias("source"))
    return study.universe_record(studies.landed(spark, landed(spark, sf_dir)), known, LEXICON)


UNIVERSE_SQL = f"""{BASE_SQL}, u AS (SELECT *, status IN ('TERMINATED', 'WITHDRAWN') AS stopped, o_orderkey % 11 > 0 AND o_orderkey % 2 = 0 AS actual, CASE WHEN o_orderkey % 2 = 0 THEN 'ACTUAL' ELSE 'ESTIMATED' END AS kind FROM b),
  v AS (SELECT *, CASE WHEN stopped THEN CASE WHEN actual THEN {DAY.format(n=200)} ELSE {DAY.format(n=400)} END END AS stop_date, CASE WHEN stopped THEN CASE WHEN {SNAPSHOT} THEN 'CANONICAL_SNAPSHOT' ELSE 'UNIVERSE_CLASSIFIED' END END AS origin FROM u)"""


@query(
    "b05_universe_rows",
    f"""WITH {UNIVERSE_SQL} SELECT nct AS nct_id, CASE WHEN o_orderkey % 10 > 0 THEN 'Study ' || nct END AS brief_title, status AS overall_status, CASE WHEN o_orderkey % 3 = 0 THEN substring({DAY.format(n=0)}, 1, 7) ELSE {DAY.format(n=0)} END AS start_date,
    CASE WHEN o_orderkey % 11 > 0 THEN {DAY.format(n=200)} END AS primary_completion_date, CASE WHEN o_orderkey % 11 > 0 THEN kind END AS primary_completion_date_type, kind AS completion_date_type, CASE o_orderkey % 4 WHEN 1 THEN 'PHASE2' WHEN 2 THEN 'PHASE2,PHASE3' ELSE '' END AS phases,
    'RANDOMIZED' AS allocation, CAST(floor(o_totalprice / 1000) AS BIGINT) AS enrollment_count, c_name AS lead_sponsor, CASE WHEN o_orderkey % 2 = 0 THEN 'INDUSTRY' END AS lead_sponsor_class, o_orderkey % 6 = 0 AS has_results, coalesce(areas[1], 'Other') AS disease_area, array_to_string(list_sort(areas), ',') AS areas,
    len(string_split(names, '; '))::INTEGER AS n_interventions, stop_date AS stop_date_estimate, CASE WHEN stopped THEN CASE WHEN actual THEN 'PRIMARY_COMPLETION_ACTUAL' ELSE 'LAST_UPDATE_POSTED' END END AS stop_date_basis, origin AS classification_origin,
    CASE WHEN origin = 'CANONICAL_SNAPSHOT' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'BIOLOGICAL' ELSE 'OPERATIONAL' END END AS snapshot_label, stopped AS labelled FROM v""",
)
def universe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed studies as universe rows; of the labels only those that the snapshot gives are in the SQL."""
    u = universe(spark, sf_dir)
    same = ["nct_id", "brief_title", "overall_status", "start_date", "primary_completion_date", "primary_completion_date_type", "completion_date_type", "allocation", "enrollment_count", "lead_sponsor", "lead_sponsor_class", "has_results", "disease_area", "stop_date_estimate", "stop_date_basis", "classification_origin"]
    label = F.when(F.col("classification_origin") == study.CANONICAL, F.col("classification_outcome"))
    items = F.when(F.size("arms_interventions.interventions") > 0, F.size("arms_interventions.interventions"))
    return u.select(*same, F.array_join("phases", ",").alias("phases"), F.array_join("disease_areas_matched", ",").alias("areas"), items.alias("n_interventions"), label.alias("snapshot_label"), F.col("classification_outcome").isNotNull().alias("labelled"))


ROLES = ("EXPERIMENTAL_ARM", "BACKGROUND_OR_BACKBONE", "COMPARATOR")


@query(
    "b17_cohort_export",
    f"""WITH {UNIVERSE_SQL}, d AS (SELECT l_orderkey, l_linenumber % 3 AS role, CASE WHEN l_linenumber = 2 THEN 'arm ' || p_name ELSE p_name END AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
    n AS (SELECT l_orderkey, role, array_to_string(list_sort(list(DISTINCT name))[1:6], '; ') AS names FROM d GROUP BY 1, 2),
    w AS (SELECT v.*, coalesce((SELECT names FROM n WHERE n.l_orderkey = o_orderkey AND role = 1), '') AS e, coalesce((SELECT names FROM n WHERE n.l_orderkey = o_orderkey AND role = 2), '') AS g, coalesce((SELECT names FROM n WHERE n.l_orderkey = o_orderkey AND role = 0), '') AS c,
          CASE o_orderkey % 5 WHEN 0 THEN 'MET' WHEN 1 THEN 'MISSED' WHEN 2 THEN 'MIXED' WHEN 3 THEN 'UNREADABLE' END AS said FROM v)
    SELECT nct AS nct_id, CASE WHEN o_orderkey % 10 > 0 THEN 'Study ' || nct ELSE '' END AS title, CASE WHEN o_orderkey % 4 = 2 THEN '3' ELSE '2' END AS phase, status, substring({DAY.format(n=0)}, 1, 7) AS start, CASE WHEN stopped THEN substring(stop_date, 1, 7) ELSE '' END AS stopped, c_name AS sponsor,
      e AS experimental_drugs, g AS background_drugs, c AS comparator_drugs, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS enrollment, CASE WHEN status <> 'RECRUITING' THEN 'yes' ELSE 'no' END AS closed, CASE WHEN stopped AND o_orderkey % 6 = 0 THEN 'yes' ELSE 'no' END AS biological_stop,
      CASE WHEN stopped AND {SNAPSHOT} THEN CASE WHEN o_orderkey % 3 = 0 THEN 'BIOLOGICAL' ELSE 'OPERATIONAL' END ELSE '' END AS stop_classification, CASE WHEN stopped AND {SNAPSHOT} THEN 'SAFETY' ELSE '' END AS stop_primary_reason,
      CASE WHEN stopped AND o_orderkey % 4 = 0 THEN 'manual review' WHEN stopped THEN 'rule' ELSE '' END AS stop_classified_by, CASE WHEN stopped THEN trim(reason) ELSE '' END AS why_stopped, CASE WHEN stopped AND o_orderkey % 3 = 0 THEN 'own_data' ELSE '' END AS stop_attribution, CASE WHEN stopped AND o_orderkey % 3 = 0 THEN 'textual' ELSE '' END AS attribution_basis,
      CASE WHEN status <> 'COMPLETED' OR said IS NULL THEN '' WHEN said <> 'UNREADABLE' THEN said WHEN o_orderkey % 2 = 0 THEN 'NOT_ASSESSABLE' ELSE '' END AS primary_endpoint, CASE WHEN status = 'COMPLETED' AND said IN ('MET', 'MISSED', 'MIXED') THEN 'posted' ELSE '' END AS endpoint_basis FROM w""",
)
def cohort_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe as a cohort's export. Labels that the rules give (no snapshot) are blanked, as SQL can't say them."""
    u = universe(spark, sf_dir).withColumn("k", F.substring("nct_id", 4, 8).cast("long"))
    k, stopped, canonical = F.col("k"), F.col("stop_date_basis").isNotNull(), F.col("classification_origin") == study.CANONICAL
    component = lambda i, n: F.struct(F.when(n == 2, "").otherwise(i["name"]).alias("name"), F.concat(F.lit("arm "), i["name"]).alias("label"))
    items = F.transform("arms_interventions.interventions", lambda i, at: F.struct(F.element_at(F.array(*map(F.lit, ("COMPARATOR", "EXPERIMENTAL_ARM", "BACKGROUND_OR_BACKBONE"))), (i["n"] % 3 + 1)).alias("role"), F.array(component(i, i["n"])).alias("components")))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("p_name").alias("name"))).alias("interventions"))
    u = u.drop("arms_interventions").join(lines.select("k", F.struct("interventions").alias("arms_interventions")), "k", "left")
    cohort = u.withColumns({
        "interventions": items, "closed": F.col("overall_status") != "RECRUITING", "biological": stopped & (k % 6 == 0), "sponsor_group": F.col("lead_sponsor"),
        "classification_outcome": F.when(canonical, F.col("classification_outcome")), "classification_primary_reason": F.when(canonical, F.col("classification_primary_reason")),
        "attribution": F.when(stopped & (k % 3 == 0), "own_data"), "attribution_basis": F.when(stopped & (k % 3 == 0), "textual"),
        "endpoint_verdict": F.when(k % 5 == 0, "MET").when(k % 5 == 1, "MISSED").when(k % 5 == 2, "MIXED").when(k % 5 == 3, "UNREADABLE"), "endpoint_basis": F.lit("posted"), "endpoint_undecided": k % 2 == 0,
    })
    return study.export_rows(cohort)


@query("c14_registry_events", f"{DIFF} SELECT id, CASE WHEN kind = 'new' THEN 'added' ELSE 'changed' END AS kind, array_to_string(fields, ',') AS fields FROM d WHERE kind = 'new' OR (kind = 'changed' AND list_contains(fields, 'status'))")
def registry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added records, and those in which a registry field changed, alone or beside a label."""
    d = snapshots.diff(*releases(spark, sf_dir), "id", ["status", "priority"])
    events = study.registry_events(d, snapshots.origin(F.col("changed_fields"), ["status"], ["priority"], []))
    return events.select("id", "kind", F.array_join("changed_fields", ",").alias("fields"))
