"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a whole text, in ASCII lower case, and stops only at anchors: at-signs,
plus signs, digits, URL schemes and identifier cues. At each anchor a small deterministic
parser widens the match to its left and right boundary and validates it. The four base kinds
equal leftmost, non-overlapping matches of their patterns; further kinds only add spans.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
ADDED_KINDS = ("url", "ssn", "iban", "account", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
#: Cue words before an identifier, with the kind they announce.
CUES = {
    "ssn": "ssn", "social security": "ssn",
    "iban": "iban",
    "account": "account", "acct": "account", "passport": "account",
    "token": "secret", "api_key": "secret", "apikey": "secret", "password": "secret", "secret": "secret",
}
SCHEMES = ("http://", "https://", "ftp://", "mailto:")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_NUMERIC = re.compile(r"[0-9.]*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'(){}\[\]|\\^`]+")
_SSN = re.compile(r"\W{0,4}(?:number|no\.?|is)?\W{0,4}([0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4})(?![0-9])", re.I)
_IBAN = re.compile(r"\W{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Z0-9])")
# white space is taken once and in bounded runs: a cue before a long blank is read in constant time
_ACCOUNT = re.compile(r"(?:\s{1,8}+(?:number|no\.?))?\s{0,8}+[:#=]?\s{0,8}+([A-Z]{0,2}[0-9](?:-?[0-9]){5,16})(?![A-Za-z0-9])", re.I)
_SECRET = re.compile(r"[\"']?\s{0,8}+[:=]\s{0,8}+[\"']?([A-Za-z0-9+/_-]{16,}={0,2})[\"']?")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, (1, "digit"))
    a.add_word("@", (1, "at"))
    a.add_word("+", (1, "plus"))
    for s in SCHEMES:
        a.add_word(s, (len(s), "url"))
    for cue, kind in CUES.items():
        a.add_word(cue, (len(cue), kind))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def _lower(text: str) -> str:
    """A-Z in lower case and nothing else, so that offsets stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[int, int, str]]:
    """start, end (exclusive) in code points and kind, by start, then kind as listed."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    email_end = dotted_end = digits_end = phone_end = url_end = 0
    for end, (size, what) in _ANCHORS.iter(_lower(text)):
        at = end - size + 1
        if what == "digit":
            if at >= digits_end:
                m = _DIGITS.match(text, at)
                digits_end = m.end()
                number = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(number) <= 19 and luhn(number):
                    out.append((at, digits_end, "card"))
            if at >= dotted_end:
                # a maximal run of digits and dots holds whole matches only
                dotted_end = _NUMERIC.match(text, at).end()
                for m in _DOTTED.finditer(text, at, dotted_end):
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                        out.append((*m.span(), "ip"))
        elif what == "at":
            left = at
            while left > email_end and text[left - 1] in _LOCAL:
                left -= 1
            if left < at and (m := _DOMAIN.match(text, at)):
                email_end = m.end()
                out.append((left, email_end, "email"))
        elif what == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((at, phone_end, "phone"))
        elif what == "url":
            # tested first: schemes inside a URL would otherwise read its rest again and again
            if at >= url_end and (at == 0 or not text[at - 1].isalnum()) and (m := _URL.match(text, end + 1)):
                url_end = at + len(text[at : m.end()].rstrip(".,;:!?"))
                if url_end > end + 1:
                    out.append((at, url_end, "url"))
        elif at == 0 or not text[at - 1].isalnum():
            pattern = {"ssn": _SSN, "iban": _IBAN, "account": _ACCOUNT, "secret": _SECRET}[what]
            m = pattern.match(text, end + 1)
            if m and (what != "iban" or iban_valid(m[1])):
                out.append((*m.span(1), what))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in kinds)


_FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS] + [T.StructField(c, T.StringType()) for c in ("base", "spans")])


@F.pandas_udf(_FOUND)
def _scan(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        spans = find(t)
        kinds = [k for _, _, k in spans]
        rows.append((*(kinds.count(k) for k in BASE_KINDS), joined(spans, BASE_KINDS), joined(spans, KINDS)))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])


@F.pandas_udf(T.StringType())
def _redact(text: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        parts, at = [], 0
        for s, e, k in find(t):
            if k != "url" and e > at:
                parts += [t[at : max(s, at)], f"<{k.upper()}>" if s >= at else ""]
                at = e
        return "".join(parts) + t[at:]

    return pd.Series([one(t) for t in text], dtype=object)


def redact(text: Column) -> Column:
    """The text with each personal span replaced by its kind in angle brackets; overlapping
    spans count as one. URLs stay. Null stays null."""
    return _redact(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds, spans as text (base, and all).

    Null and empty texts have no spans. Rows are independent: repeated rows give repeated
    results, an empty table an empty one; other columns are ignored. No shuffle.
    """
    return docs.select(F.col(id_col).alias(id_col), _scan(F.col(text_col)).alias("p")).select(id_col, "p.*")


def op2_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
