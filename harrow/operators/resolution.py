"""Entity resolution: spellings, roles of an intervention, shared backbones, and component status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def modality(name: Column, kind: Column, rules: Sequence[tuple[str, str]], otherwise: str = "UNKNOWN") -> Column:
    """The first rule (pattern, modality) that the name, then the kind, matches."""
    out = F.lit(otherwise)
    for pattern, label in reversed(list(rules)):
        out = F.when(F.lower(F.concat_ws(" ", name, kind)).rlike(pattern), label).otherwise(out)
    return out


def split_components(name: Column) -> Column:
    """The parts of a combination ("a + b", "a plus b", "a / b", "a and b"), in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text.normalized(name), r"\s*(?:\+|/|\bplus\b|\band\b|,)\s*"), F.trim), lambda x: x != ""))


def expand_regimen(name: Column, regimens: Mapping[str, Sequence[str]]) -> Column:
    """The components of a regimen's acronym; any other name is split."""
    table = F.create_map(*[x for k, v in regimens.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.element_at(table, F.upper(F.trim(name))), split_components(name))


def research_codes(name: Column, not_codes: Sequence[str] = ()) -> Column:
    """Codes such as "AB-1234" in a name, upper case and sorted."""
    found = F.transform(F.regexp_extract_all(F.upper(name), F.lit(r"\b([A-Z]{2,5}-?[0-9]{2,7}[A-Z]?)\b"), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit("")))
    return F.sort_array(F.array_distinct(F.filter(found, lambda x: ~x.isin(*not_codes)))) if not_codes else F.sort_array(F.array_distinct(found))


def arm_types(interventions: Column, arms: Column) -> Column:
    """interventions<name, kind, arms: array<label>> with the sorted types of the arms they are in."""
    of = lambda iv: F.sort_array(F.array_distinct(F.transform(F.filter(arms, lambda a: F.array_contains(iv["arms"], a["label"])), lambda a: F.upper(a["type"]))))
    return F.transform(interventions, lambda iv: F.struct(iv["name"].alias("name"), iv["kind"].alias("kind"), iv["arms"].alias("arms"), of(iv).alias("types")))


def role(iv: Column, drug_kinds: Sequence[str] = ("DRUG", "BIOLOGICAL", "GENETIC", "COMBINATION_PRODUCT")) -> Column:
    """PLACEBO, NON_DRUG, EXPERIMENTAL (in an experimental arm only), BACKGROUND (also in a control
    arm), COMPARATOR (in control arms only), OTHER."""
    experimental = F.array_contains(iv["types"], "EXPERIMENTAL")
    control = F.exists(iv["types"], lambda t: t.rlike("COMPARATOR|CONTROL|NO_INTERVENTION"))
    return (
        F.when(F.lower(iv["name"]).rlike(r"\b(?:placebo|sham|vehicle)\b"), "PLACEBO")
        .when(~F.upper(iv["kind"]).isin(*drug_kinds), "NON_DRUG")
        .when(experimental & control, "BACKGROUND")
        .when(experimental, "EXPERIMENTAL")
        .when(control, "COMPARATOR")
        .otherwise("OTHER")
    )


def shared_backbone(interventions: Column, arms: Column) -> Column:
    """Names of drugs that are in every control arm and in another arm, in a design that tests
    something else: with at least one drug that no control arm has."""
    labels = lambda keep: F.transform(F.filter(arms, keep), lambda a: a["label"])
    is_control = lambda a: F.upper(a["type"]).rlike("COMPARATOR|CONTROL|NO_INTERVENTION")
    control, other = labels(is_control), labels(lambda a: ~is_control(a))
    tested = F.exists(interventions, lambda iv: ~F.arrays_overlap(iv["arms"], control) & F.arrays_overlap(iv["arms"], other))
    everywhere = lambda iv: (F.size(F.array_except(control, iv["arms"])) == 0) & F.arrays_overlap(iv["arms"], other)
    found = F.transform(F.filter(interventions, everywhere), lambda iv: iv["name"])
    return F.when((F.size(control) > 0) & tested, F.sort_array(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def component_status(components: DataFrame, key: str, name: str, names: DataFrame, mechanisms: DataFrame, targets: DataFrame) -> DataFrame:
    """components (key, name) -> key, name, status, entity, genes.

    names (name, entity), mechanisms (entity, mechanism, target), targets (target, gene). A name with
    several entities is AMBIGUOUS, with none UNKNOWN; then NO_MECHANISM, NO_TARGET, NO_GENE, and
    RESOLVED. The dimensions are reduced to one row per key before the joins, so none fans out."""
    entity = names.groupBy(text.normalized(F.col("name")).alias("_n")).agg(F.count_distinct("entity").alias("_k"), F.min("entity").alias("_e"))
    genes = targets.groupBy("target").agg(F.collect_set("gene").alias("_g"))
    reach = mechanisms.join(genes, "target", "left").groupBy(F.col("entity").alias("_e")).agg(F.count("mechanism").alias("_m"), F.count("target").alias("_t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_g", F.array().cast("array<string>")))))).alias("genes"))
    out = components.withColumn("_n", text.normalized(F.col(name))).join(entity, "_n", "left").join(reach, "_e", "left")
    status = (
        F.when(F.col("_k").isNull(), "UNKNOWN").when(F.col("_k") > 1, "AMBIGUOUS").when(F.coalesce("_m", F.lit(0)) == 0, "NO_MECHANISM")
        .when(F.col("_t") == 0, "NO_TARGET").when(F.size("genes") == 0, "NO_GENE").otherwise("RESOLVED")
    )
    return out.select(key, name, status.alias("status"), F.when(F.col("_k") == 1, F.col("_e")).alias("entity"), F.coalesce(F.when(F.col("_k") == 1, F.col("genes")), F.array().cast("array<string>")).alias("genes"))


def unique_prefix(names: DataFrame, name: str, issuers: DataFrame, issuer: str, identifier: str, words: int = 2) -> DataFrame:
    """name -> identifier: exact normalised name, else the one issuer that begins with the name's first
    words; null where several or none do. The prefix join is an equi-join on the first words."""
    norm = lambda c: text.organisation_key(F.col(c))
    first = lambda c: F.array_join(F.slice(F.split(c, " "), 1, words), " ")
    n = names.select(name, norm(name).alias("_n")).distinct().withColumn("_p", first(F.col("_n")))
    i = issuers.select(norm(issuer).alias("_i"), F.col(identifier).alias("_id"))
    exact = i.groupBy(F.col("_i").alias("_n")).agg(F.count_distinct("_id").alias("_k"), F.min("_id").alias("_x"))
    prefix = i.groupBy(first(F.col("_i")).alias("_p")).agg(F.count_distinct("_id").alias("_pk"), F.min("_id").alias("_px"))
    out = n.join(exact, "_n", "left").join(prefix, "_p", "left")
    how = F.when(F.col("_k") == 1, "exact").when(F.col("_k").isNull() & (F.col("_pk") == 1), "prefix")
    return out.select(name, F.when(how == "exact", F.col("_x")).when(how == "prefix", F.col("_px")).alias(identifier), how.alias("method"))


def one_parent(terms: DataFrame, term: str, synonyms: DataFrame, parents: DataFrame, out: str = "molecule") -> DataFrame:
    """Each term with the one parent that its exact synonyms (name, id) fold to over parents (id, parent; a null or
    missing parent: the id itself); null where none or several do. Both dimensions are reduced before the join."""
    of = parents.groupBy("id").agg(F.min("parent").alias("parent"))
    own = F.coalesce("parent", "id")
    found = synonyms.join(of, "id", "left").groupBy("name").agg(F.count_distinct(own).alias("_k"), F.min(own).alias("_p"))
    return terms.join(found, F.col(term) == F.col("name"), "left").select(term, F.when(F.col("_k") == 1, F.col("_p")).alias(out))


def mechanisms_with_genes(acts: DataFrame, targets: DataFrame) -> DataFrame:
    """acts (molecule, mechanism, target), targets (target, gene) -> molecule, mechanism, genes sorted."""
    genes = targets.groupBy("target").agg(F.collect_set("gene").alias("_g"))
    out = acts.distinct().join(genes, "target", "left").groupBy("molecule", "mechanism")
    return out.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_g")))).alias("genes"))


#: Kinds of concept that are ingredients themselves.
INGREDIENT_KINDS = ("IN", "PIN", "MIN")


def single_ingredient(concepts: DataFrame, related: DataFrame) -> DataFrame:
    """concepts (name, id, kind), related (id, ingredient) -> name, ingredient: the concept itself where it is an
    ingredient, else its one related ingredient; null where a name has none or several."""
    one = related.groupBy("id").agg(F.count_distinct("ingredient").alias("_k"), F.min("ingredient").alias("_i"))
    own = F.when(F.col("kind").isin(*INGREDIENT_KINDS), F.col("id")).when(F.col("_k") == 1, F.col("_i"))
    out = concepts.join(one, "id", "left").groupBy("name").agg(F.count_distinct(own).alias("_n"), F.min(own).alias("ingredient"))
    return out.select("name", F.when(F.col("_n") == 1, F.col("ingredient")).alias("ingredient"))


def class_names(classes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """classes (ingredient, kind, name) -> ingredient, the sorted names of classes of those kinds."""
    return classes.where(F.col("kind").isin(*kinds)).groupBy("ingredient").agg(F.array_sort(F.collect_set("name")).alias("classes"))


def marketed(ingredients: DataFrame, bases: DataFrame, products: DataFrame) -> DataFrame:
    """ingredients (id), bases (id, base), products (id) -> id, marketed: itself or its base has a product."""
    sold = products.select("id").distinct()
    own = ingredients.join(sold.withColumn("_own", F.lit(True)), "id", "left").join(bases.groupBy("id").agg(F.min("base").alias("base")), "id", "left")
    out = own.join(sold.select(F.col("id").alias("base"), F.lit(True).alias("_base")), "base", "left")
    return out.select("id", F.coalesce("_own", "_base", F.lit(False)).alias("marketed"))


def resolve_records(designs: DataFrame, key: str, names: DataFrame, mechanisms: DataFrame, targets: DataFrame) -> DataFrame:
    """designs (key, interventions, arms) -> key, drugs, entities, genes, status: the drugs that only experimental
    arms have, each resolved by itself. RESOLVED: all are; PARTIAL: some; UNRESOLVED: none; NO_FOCUS: there is no
    such drug. Equal drugs of many records are resolved once."""
    each = designs.select(key, F.explode(arm_types(F.col("interventions"), F.col("arms"))).alias("_i")).where(role(F.col("_i")) == "EXPERIMENTAL")
    each = each.select(key, F.col("_i.name").alias("name")).distinct()
    known = component_status(each.select("name").distinct().withColumn("_id", F.col("name")), "_id", "name", names, mechanisms, targets)
    done = F.col("status") == "RESOLVED"
    found = each.join(known.drop("_id"), "name").groupBy(key).agg(
        F.array_sort(F.collect_set("name")).alias("drugs"),
        F.array_sort(F.collect_set("entity")).alias("entities"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("genes")))).alias("genes"),
        F.count_if(done).alias("_done"),
        F.count("*").alias("_all"),
    )
    none = F.array().cast("array<string>")
    status = F.when(F.col("_all").isNull(), "NO_FOCUS").when(F.col("_done") == F.col("_all"), "RESOLVED").when(F.col("_done") > 0, "PARTIAL").otherwise("UNRESOLVED")
    return designs.select(key).join(found, key, "left").select(key, *[F.coalesce(c, none).alias(c) for c in ("drugs", "entities", "genes")], status.alias("status"))
