"""Column builders for names, money, dates and free text of registers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles in person names, by the three rules that use them.
TITLES = "mr mrs ms miss mx dr sir dame lord lady rt hon honourable the rev reverend prof professor baroness baron earl viscount councillor cllr qc kc mp".split()
MATCH_TITLES = "mr mrs ms miss dr sir dame lord lady rt hon the honourable rev prof professor baroness earl councillor cllr qc kc mp".split()
# Legal forms.
LEGAL_FORMS = "the ltd limited plc llp llc lp inc incorporated cyf cyfyngedig".split()
# Classes of legal forms.
SUFFIX_CLASSES = (
    ("ltd", r"\b(ltd|limited|cyf|cyfyngedig)\b"),
    ("plc", r"\bplc\b"),
    ("llp", r"\bllp\b"),
    ("lp", r"\blp\b"),
    ("foreign", r"\b(llc|inc|incorporated|corp|corporation)\b"),
)
# Words that tell no company apart.
WEAK_WORDS = r"\b(the|company|co)\b"
# Legal forms of suppliers.
SUPPLIER_SUFFIXES = r"(?i)\b(limited|ltd|plc|public limited company|llp|l\.?l\.?p\.?|company|co|incorporated|inc|the)\b"
# Trailing words that say little.
GENERIC_TAIL = (
    "group holdings holding uk gb international global services service solutions capital partners partnership ventures trading "
    "investments management enterprises industries europe european finance financial"
).split()
# Words by which free text is told apart.
DIRECTOR_ROLE = r"(?i)\b(director|chairman|chair|chief executive|ceo|managing|partner|proprietor|owner)\b"
LEGAL_SUFFIX = r"(?i)\b(ltd|limited|plc|llp|lp|inc|company)\b"
COMPANY_HINT = r"(?i)\b(ltd|limited|plc|llp|inc|partnership|holdings|group|co)\b"
GB_ALIASES = ("united kingdom", "england", "scotland", "wales", "northern ireland", "great britain", "uk")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]", " ")


def _sorted_key(text: Column) -> Column:
    return F.array_join(F.array_sort(_words(text)), " ")


def person_key(name: Column) -> Column:
    """Sorted name words without titles; of adjacent titles, which share a blank, every second one stays."""
    return _sorted_key(F.regexp_replace(_plain(name), f"(^| )({'|'.join(TITLES)})( |$)", " "))


def organisation_key(name: Column) -> Column:
    """Sorted name words without legal forms."""
    return _sorted_key(F.regexp_replace(_plain(name), f"(^| )({'|'.join(LEGAL_FORMS)})( |$)", " "))


def person_token_key(name: Column) -> Column:
    """Sorted name words without any title."""
    return F.array_join(F.array_sort(F.filter(_words(_plain(name)), lambda w: ~w.isin(*TITLES))), " ")


def suffix_class(name: Column) -> Column:
    """The last class of legal form that a name shows, or ``none``."""
    text, found = _plain(name), F.lit("none")
    for kind, pattern in SUFFIX_CLASSES:
        found = F.when(text.rlike(pattern), kind).otherwise(found)
        text = F.regexp_replace(text, pattern, " ")
    return found


def company_base(name: Column) -> Column:
    """Sorted name words without legal forms and weak words."""
    text = _plain(name)
    for _, pattern in SUFFIX_CLASSES:
        text = F.regexp_replace(text, pattern, " ")
    return _sorted_key(F.regexp_replace(text, WEAK_WORDS, " "))


def compatible(a: Column, b: Column) -> Column:
    """Whether two suffix classes may be of one company."""
    return (a == b) | (a == "none") | (b == "none")


def match_name(name: Column) -> tuple[Column, Column]:
    """Surname and the sorted different forenames, from ``Last, First`` or ``Title First Last``."""
    text = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[.']", "")
    inverted = F.contains(text, F.lit(","))
    after = F.transform(_words(F.regexp_replace(F.substring(text, F.instr(text, ",") + 1, F.length(text)), "\\s+", " ")), lambda w: F.trim(w, F.lit(",")))
    before = F.filter(_words(F.regexp_replace(text, "\\s+", " ")), lambda w: ~w.isin(*MATCH_TITLES))
    last = F.when(inverted, F.trim(F.substring_index(text, ",", 1))).otherwise(F.coalesce(F.get(before, F.size(before) - 1), F.lit("")))
    first = F.when(inverted, after).otherwise(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))))
    return last, F.array_sort(F.array_distinct(F.filter(first, lambda w: (F.length(w) > 1) & ~w.isin(*MATCH_TITLES))))


def supplier_name(name: Column) -> Column:
    """Supplier name for strict comparison: HTML entities as characters, ``and`` for ``&``, no punctuation, no legal form."""
    text = F.replace(F.lower(unescaped(F.coalesce(name, F.lit("")))), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]+", " "), SUPPLIER_SUFFIXES, " ")
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def search_key(normalised: Column) -> Column:
    """The leading words up to the first generic one; the first word always."""
    return F.regexp_extract(normalised, f"^([^ ]*(?: (?!(?:{'|'.join(GENERIC_TAIL)})(?: |$))[^ ]+)*)", 1)


def money(text: Column) -> Column:
    """Pounds of a donation: empty is 0, unreadable null."""
    plain = F.trim(F.regexp_replace(text, "[£,]", ""))
    return F.when(plain == "", F.lit(0).cast("decimal(18,2)")).otherwise(plain.try_cast("decimal(18,2)"))


def declared_money(text: Column) -> Column:
    """Pounds of a declared interest: empty and unreadable are null."""
    return F.trim(F.regexp_replace(text, "[£,]", "")).try_cast("decimal(18,2)")


def contract_money(text: Column) -> Column:
    """Pounds of a contract: nothing at or below zero."""
    value = declared_money(text)
    return F.when(value > 0, value)


def short_money(text: Column) -> Column:
    """Pounds written with k, m or bn."""
    plain = F.lower(F.trim(F.regexp_replace(text, "[£,]", "")))
    number = F.regexp_extract(plain, "^([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")
    unit = F.regexp_extract(plain, "(bn|m|k)$", 1)
    return number * F.when(unit == "bn", 1e9).when(unit == "m", 1e6).when(unit == "k", 1e3).otherwise(1.0)


def register_date(text: Column) -> Column:
    """A date from DD/MM/YYYY, or from the first ten characters of an ISO time."""
    return F.coalesce(F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def strict_date(text: Column) -> Column:
    return F.try_to_date(text, "dd/MM/yyyy")


def seen_date(text: Column) -> Column:
    """A date from a news time's first eight digits, else the text."""
    found = F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")
    return F.coalesce(found.cast("string"), text)


def folded_country(country: Column) -> Column:
    return F.when(F.lower(F.trim(country)).isin(*GB_ALIASES), "GB").otherwise(country)


def plain_text(html: Column) -> Column:
    """Text of a piece of HTML without tags, white space collapsed; entities as ``unescaped`` leaves them."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "\\s+", " "))


def _unescape(text: pd.Series) -> pd.Series:
    import html

    return text.map(html.unescape, na_action="ignore")


def unescaped(text: Column) -> Column:
    """HTML entities as characters; Spark has no function for the named ones."""
    return F.pandas_udf(_unescape, "string")(text)


def closed_entities(text: Column) -> Column:
    """The four entities of markup as characters; one that its semicolon does not end stays as it is."""
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(by))
    return text


def without_descriptions(text: str) -> str:
    """``text`` without trailing parentheses whose content begins in lower case."""
    text = text.strip()
    while text.endswith(")"):
        depth, at = 0, len(text)
        while at:
            at -= 1
            depth += (text[at] == ")") - (text[at] == "(")
            if depth == 0:
                break
        inner = text[at + 1 : -1].strip()
        if depth or not inner[:1].islower():
            break
        text = text[:at].strip()
    return text


def _describe_away(text: pd.Series) -> pd.Series:
    return text.map(without_descriptions, na_action="ignore")


def described_away(text: Column) -> Column:
    """``without_descriptions`` for each text; balanced parentheses are beyond regular expressions."""
    return F.pandas_udf(_describe_away, "string")(text)


def employment(text: Column) -> tuple[Column, Column]:
    """Role and organisation of ``role, organisation (what it does)``; null without both."""
    line = described_away(F.trim(F.regexp_replace(text, "\\s+", " ")))
    org = F.trim(F.substring_index(line, ",", -1))
    role = F.trim(F.regexp_extract(line, "^(.*),[^,]*$", 1))
    good = F.contains(line, F.lit(",")) & (role != "") & org.rlike("[A-Za-z]")
    return F.when(good, role), F.when(good, org)


def shareholding(text: Column) -> Column:
    """The company of a shareholding: what follows the last `` of ``, with a legal form."""
    name = described_away(F.substring_index(F.trim(F.regexp_replace(text, "\\s+", " ")), " of ", -1))
    return F.when(name.rlike("[A-Za-z]") & name.rlike(LEGAL_SUFFIX), name)


def role_type(role: Column) -> Column:
    return F.when(role.rlike(DIRECTOR_ROLE), "DIRECTOR_OF").otherwise("ADVISER_TO")


def entity_type(name: Column, default: str) -> Column:
    return F.when(name.rlike(COMPANY_HINT), "company").otherwise(default)


def donor_type(status: Column) -> Column:
    return F.when(status == "Individual", "person").when(status.isin("Company", "Limited Liability Partnership"), "company").when(status == "Registered Political Party", "party").otherwise("organisation")


def recipient_type(kind: Column) -> Column:
    return F.when(kind == "Political Party", "party").otherwise("person")


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits by its product with their power of ten, as SQL engines round doubles.

    ``F.round`` goes by the decimal text instead, which differs where a number lies on a half.
    """
    power = 10.0**digits
    return F.round(x * power) / power
