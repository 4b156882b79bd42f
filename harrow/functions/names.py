"""Names of drugs, organisations, genes and phases as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse

#: Salts and forms that are no part of a drug name, and words by which a text names no single drug.
SALTS = ("hydrochloride", "hcl", "mesylate", "maleate", "tosylate", "sodium", "citrate", "acetate")
DELIVERY = ("injection", "tablet", "tablets", "capsule", "capsules", "oral", "intravenous", "iv", "infusion", "solution", "cream", "gel", "low dose", "high dose")
NO_DRUG = ("placebo", "standard of care", "chemotherapy", "radiation", "surgery", "vehicle")


def _any(words: Sequence[str]) -> str:
    return "|".join(words)


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and the letters that compatibility decomposition leaves of them."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Marks are taken off Latin letters."""
    return F.translate(c, *_folding())


def clean_drug(c: Column) -> Column:
    """Without trade marks, what stands in parentheses, salts, forms and dose levels."""
    t = F.regexp_replace(F.regexp_replace(c, "[®™©]", ""), r"\([^)]*\)", " ")
    t = F.regexp_replace(t, rf"(?i)\b(?:{_any(DELIVERY)}|{_any(SALTS)}|dose level [0-9]+)\b", " ")
    return F.regexp_replace(collapse(t), "^[ ,;-]+|[ ,;-]+$", "")


def drug_key(c: Column, synonyms: Mapping[str, str] | None = None) -> Column:
    """One drug's key: lower case, no dose, form or salt. Null for a combination, a class of treatment,
    or what has no letter or fewer than three characters."""
    t = F.regexp_replace(F.lower(c), r"\([^)]*\)|\[[^\]]*\]|[®™]", " ")
    t = F.regexp_replace(t, r"\b[0-9]+(?:\.[0-9]+)?\s*(?:mg|mcg|ml|g|iu|%)(?:/[a-z0-9]+)?", " ")
    t = F.regexp_replace(t, rf"\b(?:{_any(DELIVERY)}|{_any(SALTS)})\b", " ")
    t = F.regexp_replace(collapse(t), r"^[\s,.;:-]+|[\s,.;:-]+$", "")
    for alias, name in (synonyms or {}).items():
        t = F.when(t == alias, name).otherwise(t)
    several = t.rlike(r"[+/,;&]| (?:and|plus|with|or|versus|vs) ")
    return F.when((F.length(t) >= 3) & t.rlike("[a-z]") & ~several & ~t.isin(*NO_DRUG), t)


def candidates(names: Column) -> Column:
    """Spellings to look up, in order: each name split at separators, then what stands inside its
    parentheses, then what stands outside; at least three characters, each once whatever its case."""
    pieces = F.flatten(F.transform(names, lambda n: F.split(n, r"(?i)[;,/+]|\s+(?:plus|and|with)\s+")))

    def spellings(piece: Column) -> Column:
        own = F.trim(piece)
        inner = F.transform(F.regexp_extract_all(own, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x))
        return F.concat(F.array(own), inner, F.array(F.trim(F.regexp_replace(own, r"\([^)]*\)", " "))))

    found = F.filter(F.flatten(F.transform(pieces, spellings)), lambda x: F.length(x) >= 3)
    empty = F.array().cast("array<string>")
    return F.aggregate(found, empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def components(name: Column) -> Column:
    """The partners of a combination, if each has at least three characters, else the name alone."""
    parts = F.filter(F.transform(F.split(name, r"(?i)\s*\+\s*|\s+(?:plus|and|with)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: F.length(p) >= 3), parts).otherwise(F.array(name))


def research_codes(text: Column, excluded: Sequence[str] = ("NCT", "PHASE", "COVID")) -> Column:
    """Codes such as "AB-1234": letters, then two digits or more; upper case, sorted, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]{2,5}[- ]?[0-9]{2,7})\b"), F.lit(1)), lambda m: F.upper(F.regexp_replace(m, r"\s+", "-")))
    return F.sort_array(F.array_distinct(F.filter(found, lambda m: ~m.rlike(f"^(?:{_any(excluded)})"))))


def genes(text: Column, known: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """Known symbols that stand as tokens, and those whose alias pattern matches; sorted."""
    tokens = F.filter(F.split(F.upper(text), "[^A-Z0-9-]+"), lambda t: t.isin(*known))
    named = F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(g)) for p, g in aliases.items()]))
    return F.sort_array(F.array_union(tokens, named))


def phase_label(phases: Column) -> Column:
    """["PHASE1", "PHASE2"] becomes "Phase 1/2"; early phase 1 counts as 1; empty without a phase."""
    numbers = F.transform(F.filter(phases, lambda p: F.contains(p, F.lit("PHASE"))), lambda p: F.replace(F.replace(p, F.lit("EARLY_PHASE1"), F.lit("PHASE1")), F.lit("PHASE"), F.lit("")))
    return F.when(F.size(numbers) > 0, F.concat(F.lit("Phase "), F.array_join(F.sort_array(F.array_distinct(numbers)), "/"))).otherwise("")


def query_string(lists: Mapping[str, Column], single: Mapping[str, Column]) -> Column:
    """"?a=x,y&b=1" from filled facets in their order; empty if nothing is set."""
    parts = [F.when(F.size(c) > 0, F.concat(F.lit(f"{k}="), F.url_encode(F.array_join(c, ",")))) for k, c in lists.items()]
    parts += [F.when(c != "", F.concat(F.lit(f"{k}="), F.url_encode(c))) for k, c in single.items()]
    joined = F.concat_ws("&", *parts)
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")


def split_modality(query: Column, words: Mapping[str, str]) -> Column:
    """struct(rest, modality): the first modality phrase is peeled off, unless nothing would be left."""
    tries = []
    for pattern, modality in words.items():
        rest = collapse(F.regexp_replace(query, f"(?i){pattern}", " "))
        tries.append(F.when(query.rlike(f"(?i){pattern}") & (rest != ""), F.struct(rest.alias("rest"), F.lit(modality).alias("modality"))))
    return F.coalesce(*tries, F.struct(query.alias("rest"), F.lit("").alias("modality")))


def unescaped(c: Column) -> Column:
    """Markdown escapes taken off, white space collapsed."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\([\[\]<>*_()#~`])", "$1"))


def review_key(c: Column) -> Column:
    """HTML entities and marks resolved, lower case, runs of anything but a-z and 0-9 one blank."""
    entities = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
    t = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), entities.items(), F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.lower(folded(t)), "[^a-z0-9]+", " "))
