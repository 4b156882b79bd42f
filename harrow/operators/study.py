"""Whole studies to flat rows: the record of a stopped study, the row of the universe with its estimated stop date, and the
cohort's export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from .classify import area_scores, classify_reason, with_fallback
from .flatten import distinct_sorted, terms

#: Statuses of a stopped study, and where a record's page is.
STOPPED = ("TERMINATED", "SUSPENDED", "WITHDRAWN")
PAGE = "https://clinicaltrials.gov/study/"
CANONICAL, INLINE = "CANONICAL_SNAPSHOT", "UNIVERSE_CLASSIFIED"
ACTUAL_COMPLETION, LAST_UPDATE = "PRIMARY_COMPLETION_ACTUAL", "LAST_UPDATE_POSTED"
#: Columns of the cohort's export.
EXPORT_COLUMNS = (
    "nct_id", "title", "phase", "status", "start", "stopped", "sponsor", "experimental_drugs", "background_drugs", "comparator_drugs", "enrollment", "closed",
    "biological_stop", "stop_classification", "stop_primary_reason", "stop_classified_by", "why_stopped", "stop_attribution", "attribution_basis", "primary_endpoint", "endpoint_basis",
)
EXPORT_NAMES, EXPORT_TITLE, EXPORT_REASON = 6, 200, 400


def _leaf(path: str) -> Column:
    return F.col(f"protocolSection.{path}")


def _text(path: str) -> Column:
    return F.coalesce(_leaf(path), F.lit(""))


def _filled(items: Column) -> Column:
    """The entries that are neither null nor empty; a null list has none."""
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def _joined(items: Column) -> Column:
    return F.array_join(items, "; ")


def _meshes() -> Column:
    return _filled(terms(F.col("derivedSection.conditionBrowseModule.meshes"), "term"))


def _areas(lexicon: Mapping[str, Sequence[str]], preferred: str | None) -> Column:
    words = F.concat(_filled(_leaf("conditionsModule.conditions")), _meshes())
    return area_scores(F.lower(F.array_join(words, " ; ")), lexicon, preferred)


def study_record(studies: DataFrame, lexicon: Mapping[str, Sequence[str]], preferred: str | None = None) -> DataFrame:
    """studies (of sources.studies) -> the flat record: 20 base columns and the classification of the stop reason, which
    falls back on the descriptions. Absent sections and fields give empty texts and lists; the title falls back on the
    official one; site countries are distinct, trimmed and sorted. Only the leaves that are named here are read."""
    nct = _text("identificationModule.nctId")
    title = F.coalesce(F.nullif(_leaf("identificationModule.briefTitle"), F.lit("")), _text("identificationModule.officialTitle"))
    interventions = _leaf("armsInterventionsModule.interventions")
    countries = distinct_sorted(F.transform(_filled(terms(_leaf("contactsLocationsModule.locations"), "country")), lambda x: F.trim(x)))
    base = {
        "nct_id": nct, "brief_title": title, "overall_status": _text("statusModule.overallStatus"), "why_stopped": _text("statusModule.whyStopped"),
        "mesh_terms": _joined(_meshes()), "countries": _joined(countries), "study_type": _text("designModule.studyType"), "phases": _joined(_filled(_leaf("designModule.phases"))),
        "lead_sponsor": _text("sponsorCollaboratorsModule.leadSponsor.name"), "collaborators": _joined(_filled(terms(_leaf("sponsorCollaboratorsModule.collaborators"), "name"))),
        "conditions": _joined(_filled(_leaf("conditionsModule.conditions"))), "intervention_names": _joined(_filled(terms(interventions, "name"))), "intervention_types": _joined(_filled(terms(interventions, "type"))),
        "start_date": _text("statusModule.startDateStruct.date"), "primary_completion_date": _text("statusModule.primaryCompletionDateStruct.date"),
        "completion_date": _text("statusModule.completionDateStruct.date"), "last_update_post_date": _text("statusModule.lastUpdatePostDateStruct.date"),
        "url": F.when(nct != "", F.concat(F.lit(PAGE), nct)).otherwise(""),
    }
    found = with_fallback(_leaf("statusModule.whyStopped"), _leaf("descriptionModule.briefSummary"), _leaf("descriptionModule.detailedDescription"))
    out = studies.select(*[c.alias(n) for n, c in base.items()], _areas(lexicon, preferred).alias("_a"), found.alias("_c"))
    out = out.withColumns({"disease_area": F.col("_a.primary"), "disease_areas_matched": _joined(F.col("_a.matched"))})
    labels = {"classification_label": "_c.c.label", "classification_reason": "_c.c.reason", "classification_confidence": "_c.c.confidence", "classification_source": "_c.source"}
    return out.withColumns({n: F.col(c) for n, c in labels.items()}).drop("_a", "_c")


def universe_record(studies: DataFrame, snapshot: DataFrame, lexicon: Mapping[str, Sequence[str]], preferred: str | None = None) -> DataFrame:
    """studies and a snapshot (nct_id, label, reason, source) -> 23 base columns of the universe, the stop date of stopped
    studies with its basis, and their classification with its origin.

    A stop is dated by an actual primary completion, else by the last update. A stopped study that the snapshot knows
    keeps its labels (a snapshot has one row an id); another is classified here; one that was not stopped has none."""
    status = {f"{n}{suffix}": _leaf(f"statusModule.{s}.{f}") for n, s in (("start_date", "startDateStruct"), ("primary_completion_date", "primaryCompletionDateStruct"), ("completion_date", "completionDateStruct")) for suffix, f in (("", "date"), ("_type", "type"))}
    base = {
        "nct_id": _leaf("identificationModule.nctId"), "brief_title": _leaf("identificationModule.briefTitle"), "overall_status": _leaf("statusModule.overallStatus"), "why_stopped": _text("statusModule.whyStopped"),
        **status, "last_update_post_date": _leaf("statusModule.lastUpdatePostDateStruct.date"), "phases": F.coalesce(_leaf("designModule.phases"), F.array().cast("array<string>")),
        "allocation": _leaf("designModule.designInfo.allocation"), "enrollment_count": _leaf("designModule.enrollmentInfo.count"), "enrollment_type": _leaf("designModule.enrollmentInfo.type"),
        "lead_sponsor": _leaf("sponsorCollaboratorsModule.leadSponsor.name"), "lead_sponsor_class": _leaf("sponsorCollaboratorsModule.leadSponsor.class"),
        "conditions": F.coalesce(_leaf("conditionsModule.conditions"), F.array().cast("array<string>")), "mesh_terms": _meshes(),
        "has_results": F.col("hasResults"), "arms_interventions": _leaf("armsInterventionsModule"),
    }
    out = studies.select(*[c.alias(n) for n, c in base.items()], _areas(lexicon, preferred).alias("_a"))
    out = out.withColumns({"disease_area": F.col("_a.primary"), "disease_areas_matched": F.col("_a.matched")}).drop("_a")
    stopped = F.coalesce(F.col("overall_status").isin(*STOPPED), F.lit(False))
    actual = F.coalesce(F.col("primary_completion_date") != "", F.lit(False)) & F.coalesce(F.col("primary_completion_date_type") == "ACTUAL", F.lit(False))
    out = out.withColumns({
        "stop_date_estimate": F.when(stopped, F.when(actual, F.col("primary_completion_date")).otherwise(F.col("last_update_post_date"))),
        "stop_date_basis": F.when(stopped, F.when(actual, ACTUAL_COMPLETION).otherwise(LAST_UPDATE)),
    })
    known = snapshot.select(F.col("nct_id").alias("_id"), F.struct("label", "reason", "source").alias("_s"))
    out = out.join(known, (F.col("nct_id") == F.col("_id")) & stopped, "left")
    out = out.withColumn("_c", F.when(stopped & F.col("_s").isNull(), classify_reason(F.col("why_stopped"))))
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return out.withColumns({
        "classification_outcome": pick("_s.label", "_c.label"), "classification_primary_reason": pick("_s.reason", "_c.reason"),
        "classification_source": F.coalesce("_s.source", F.when(F.col("_c").isNotNull(), "RULES")), "classification_origin": F.when(F.col("_s").isNotNull(), CANONICAL).when(stopped, INLINE),
    }).drop("_id", "_s", "_c")


def _drugs(roles: Sequence[str]) -> Column:
    """The first names, in order, of components of interventions in a role; a component without a name has its label."""
    chosen = F.filter(F.col("interventions"), lambda i: i["role"].isin(*roles) & i["components"].isNotNull())
    names = F.flatten(F.transform(chosen, lambda i: F.transform(i["components"], lambda c: F.coalesce(F.nullif(c["name"], F.lit("")), c["label"]))))
    return _joined(F.slice(F.array_sort(F.array_distinct(_filled(names))), 1, EXPORT_NAMES))


def export_rows(cohort: DataFrame) -> DataFrame:
    """A cohort as the 21 columns of its export, all text, nothing null.

    cohort has nct_id, brief_title, phases, overall_status, start_date, stop_date_estimate, closed, biological, sponsor_group,
    interventions (role, components of name and label), enrollment_count, classification_outcome, classification_primary_reason,
    classification_source, why_stopped, attribution, attribution_basis, endpoint_verdict, endpoint_basis, endpoint_undecided. Endpoints
    count for completed studies only; an unreadable one with undecided results cannot be assessed."""
    c = F.col
    clip = lambda name, n: F.substring(collapse(F.coalesce(name, F.lit(""))), 1, n)
    yes = lambda name: F.when(F.coalesce(c(name), F.lit(False)), "yes").otherwise("no")
    month = lambda name: F.substring(c(name), 1, 7)
    completed = F.coalesce(c("overall_status") == "COMPLETED", F.lit(False))
    verdict = F.when(completed, c("endpoint_verdict"))
    source = F.coalesce("classification_source", F.lit(""))
    cells = [
        c("nct_id"), clip(c("brief_title"), EXPORT_TITLE), F.when(F.array_contains("phases", "PHASE3"), "3").otherwise("2"), c("overall_status"), month("start_date"), F.when(c("closed"), month("stop_date_estimate")),
        c("sponsor_group"), _drugs(["EXPERIMENTAL_ARM"]), _drugs(["BACKGROUND_OR_BACKBONE"]), _drugs(["COMPARATOR"]), c("enrollment_count").cast("string"), yes("closed"), yes("biological"),
        c("classification_outcome"), c("classification_primary_reason"), F.when(F.startswith(source, F.lit("REVIEWED")), "manual review").when(source != "", "rule"),
        F.when(~completed, clip(c("why_stopped"), EXPORT_REASON)), c("attribution"), c("attribution_basis"),
        F.when((verdict == "UNREADABLE") & c("endpoint_undecided"), "NOT_ASSESSABLE").when(verdict != "UNREADABLE", verdict), F.when(verdict.isin("MET", "MISSED", "MIXED"), c("endpoint_basis")),
    ]
    return cohort.select(*[F.coalesce(x, F.lit("")).alias(n) for n, x in zip(EXPORT_COLUMNS, cells, strict=True)])


def registry_events(diff: DataFrame, origin: Column) -> DataFrame:
    """Of a difference of two releases what a sponsor did: new rows as added, and changes of registry or mixed origin."""
    kind = F.when(F.col("kind") == "new", "added").when((F.col("kind") == "changed") & origin.isin("registry_event", "mixed"), "changed")
    return diff.withColumn("kind", kind).where(F.col("kind").isNotNull())
