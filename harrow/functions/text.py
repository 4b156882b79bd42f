"""Scalar text functions: Column -> Column, JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of delivery form that are no part of a drug name.
FORM_WORDS = ("tablet", "tablets", "capsule", "capsules", "injection", "oral", "solution", "infusion", "cream", "gel")
#: Legal suffixes of organisation names.
LEGAL_SUFFIXES = ("inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "ag", "sa", "plc", "bv", "nv", "ab", "as", "spa", "srl", "kg", "incorporated", "se", "kgaa", "oy", "kk", "pty", "lp", "llp")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def collapse(c: Column) -> Column:
    """White space runs become one blank; ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalized(c: Column) -> Column:
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def key_of(c: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def code_of(c: Column) -> Column:
    """A classification code: blanks, slashes and hyphens become one underscore; upper case."""
    return F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\s/-]+", "_"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clipped(c: Column, limit: int) -> Column:
    """At most limit characters; what is cut ends in an ellipsis."""
    t = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t)


def short_hash(c: Column, kind: str = "sha256", digits: int = 20) -> Column:
    h = F.sha2(c, 256) if kind == "sha256" else F.sha1(c)
    return F.substring(h, 1, digits)


def list_of(c: Column, separator: str = ";", upper: bool = False) -> Column:
    """The trimmed, non-empty entries of a delimited list."""
    entries = F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.upper(F.trim(x)) if upper else F.trim(x))
    return F.filter(entries, lambda x: x != "")


def first_of(c: Column, separator: str = ";") -> Column:
    return F.get(list_of(c, separator), 0)


def sentences(c: Column) -> Column:
    """Split behind . ! ? and white space."""
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def strict_sentences(c: Column) -> Column:
    """Split behind . ! ? and white space, only before a capital or a digit."""
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: s != "")


def sentence_around(c: Column, at: Column, limit: int = 220) -> Column:
    """The sentence that holds the character at a place (from 1), up to `limit` characters; null without a place. The
    part before is read backwards, so the time is linear."""
    before = F.reverse(F.regexp_extract(F.reverse(F.substring(c, F.lit(1), at - 1)), r"\A([^.!?]*)", 1))
    behind = F.regexp_extract(F.substring(c, at, F.length(c)), r"\A([^.!?]*[.!?]?)", 1)
    return F.when(at > 0, F.substring(F.trim(F.concat(before, behind)), 1, limit))


def first_sentence(c: Column, limit: int = 700) -> Column:
    return F.substring(F.get(sentences(c), 0), 1, limit)


def visible_text(c: Column) -> Column:
    """Markup stripped: script and style blocks, comments and tags become blanks."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return collapse(F.regexp_replace(t, r"(?s)<[^>]*>", " "))


def organisation_key(c: Column) -> Column:
    """Lower case without marks, parentheses and punctuation; up to three legal suffixes dropped."""
    from .names import folded

    t = F.regexp_replace(F.lower(folded(F.coalesce(c, F.lit("")))), r"\([^)]*\)", " ")
    t = collapse(F.regexp_replace(F.regexp_replace(t, r"[.,']", ""), r"[^a-z0-9]+", " "))
    for _ in range(3):
        t = F.regexp_replace(t, rf" (?:{'|'.join(LEGAL_SUFFIXES)})$", "")
    return t


def drug_name(c: Column) -> Column:
    """Doses, marks and delivery forms removed."""
    t = F.regexp_replace(F.lower(c), r"[®™©]|\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\b[0-9]+(?:\.[0-9]+)?\s*(?:mg|mcg|g|ml|iu|%)(?:/[a-z0-9]+)?", " ")
    return collapse(F.regexp_replace(t, rf"\b(?:{'|'.join(FORM_WORDS)})\b", " "))


def name_variants(name: Column) -> Column:
    """Ordered spellings: as it is, without parentheses, inside them, without blanks or hyphens."""
    base = normalized(name)
    out = F.array(base, collapse(F.regexp_replace(base, r"\([^)]*\)", " ")), F.regexp_extract(base, r"\(([^)]*)\)", 1), F.regexp_replace(base, "[ -]", ""))
    return F.array_distinct(F.filter(out, lambda x: F.length(x) >= 3))


def with_p_value(df: DataFrame, c: Column, name: str = "p") -> DataFrame:
    """df with a column struct(value, op) from forms like "<0.001", "P = .03", "0,04"; "NS" reads as p > 0.05. Named steps:
    what several parts need is computed once a row."""
    out = df.withColumn("_t", F.replace(F.lower(F.trim(c)), F.lit(","), F.lit(".")))
    t = F.col("_t")
    out = out.withColumns({"_sign": F.regexp_extract(t, r"([<>≤≥=])", 1), "_n": F.regexp_extract(t, r"([0-9]*\.?[0-9]+(?:e-?[0-9]+)?)", 1).try_cast("double"), "_ns": t.rlike(r"^(?:n\.?s\.?|not significant)$")})
    n, sign = F.col("_n"), F.col("_sign")
    out = out.withColumn("_value", F.when(F.col("_ns"), F.lit(0.05)).when((n >= 0) & (n <= 1), n))
    op = F.when(F.col("_ns"), ">").when(sign.isin("<", "≤"), "<").when(sign.isin(">", "≥"), ">").otherwise("=")
    return out.withColumn(name, F.struct(F.col("_value").alias("value"), F.when(F.col("_value").isNotNull(), op).alias("op"))).drop("_t", "_sign", "_n", "_ns", "_value")


def fraction(c: Column) -> Column:
    """A threshold like "5%" or "0.05" as a fraction in [0.0005, 0.3], else null."""
    n = F.regexp_extract(c, r"([0-9]*\.?[0-9]+)", 1).try_cast("double")
    v = F.when(c.contains("%"), n / 100).otherwise(n)
    return F.when(v.between(0.0005, 0.3), v)


def partial_date(c: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy; missing parts are the first; anything else is null."""
    t = F.trim(c)
    full = F.when(F.length(t) == 4, F.concat(t, F.lit("-01-01"))).when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(F.substring(t, 1, 10))
    return F.try_to_date(full, "yyyy-MM-dd")


def calendar_months(start: Column, end: Column) -> Column:
    """Whole calendar months between two dates; null if negative."""
    m = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.when(m >= 0, m)


def elapsed_months(start: Column, end: Column) -> Column:
    """Months of 30.4375 days."""
    return F.datediff(end, start) / F.lit(30.4375)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def shard_of(identifier: Column, shards: int = 256, prefix: str = "NCT") -> Column:
    """A stable shard, a power of two of them: the digits behind the prefix modulo shards, other ids by
    FNV-1a. Blanks around an id and its case do not matter; the last 18 digits decide the remainder."""
    own = F.upper(F.trim(identifier))
    digits = F.regexp_extract(own, rf"^{prefix}([0-9]+)$", 1)
    number = F.when(F.length(digits) > 0, F.right(digits, F.lit(18)).cast("long"))
    return F.coalesce(F.pmod(number, F.lit(shards)), F.pmod(fnv1a(own), F.lit(shards))).cast("int")


def keyword_hit(text: Column, keyword: str, whole_word: bool = False, not_after: tuple[str, ...] = ()) -> Column:
    """Whether a keyword stands in the (lower-case) text; as a whole word, or not as the end of
    a longer word that begins with one of not_after."""
    from re import escape

    head = r"\b" if whole_word else "".join(f"(?<!{escape(p)})" for p in not_after)
    return text.rlike(head + escape(keyword) + (r"\b" if whole_word else ""))


def singular_ones(c: Column, nouns: list[str]) -> Column:
    """"1 items" becomes "1 item", for the given nouns."""
    return F.regexp_replace(c, rf"(?<![0-9.,])1 ({'|'.join(nouns)})s\b", "1 $1")


def after_last(c: Column, marker: str) -> Column:
    """What follows the last marker; null without one."""
    return F.when(F.contains(c, F.lit(marker)), F.substring_index(c, marker, -1))
