"""Organization names and identifiers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate-form and noise words removed from comparison keys.
DOMESTIC_FORMS = ("INC", "INCORPORATED", "LLC", "LP", "LLP", "CORP", "CORPORATION", "CO", "COMPANY")
FOREIGN_FORMS = ("LTD", "LIMITED", "PLC", "GMBH", "SA", "AG", "NV", "BV", "PTE", "PVT", "AB", "SPA", "SRL", "OY", "AS")
NOISE_WORDS = ("THE", "DBA", "GROUP", "HOLDING", "HOLDINGS", "INTERNATIONAL", "INTL", "USA", "US")


def whole_words(words: tuple[str, ...]) -> str:
    """A pattern for any of ``words`` between boundaries of A-Z and 0-9, longest first."""
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    return r"(?<![A-Z0-9])(?:" + "|".join(longest_first) + r")(?![A-Z0-9])"


def upper_fold(name: Column) -> Column:
    """Upper case in which the sharp s is SS everywhere (engines differ on its capital)."""
    return F.upper(F.replace(name, F.lit("ß"), F.lit("ss")))


def collapse(text: Column) -> Column:
    """Runs of white space, Unicode's included, become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_name(name: Column, missing: str | None = None) -> Column:
    """Comparison key: upper case, '&' as AND, no punctuation, no corporate form.

    NULL stays NULL; ``missing='NONE'`` gives the key of the stringified value instead.
    """
    value = name if missing is None else F.coalesce(name, F.lit(missing))
    plain = F.regexp_replace(F.replace(upper_fold(value), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9 ]", " ")
    bare = F.regexp_replace(plain, whole_words(DOMESTIC_FORMS + FOREIGN_FORMS + NOISE_WORDS), " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def form_words(name: Column) -> Column:
    return F.split(F.regexp_replace(upper_fold(F.coalesce(name, F.lit(""))), "[^A-Z ]", " "), " +")


def entity_family(name: Column) -> Column:
    """'foreign' before 'domestic' before 'none', by the corporate forms in the name."""
    tokens = form_words(name)
    return (
        F.when(F.arrays_overlap(tokens, F.lit(list(FOREIGN_FORMS))), "foreign")
        .when(F.arrays_overlap(tokens, F.lit(list(DOMESTIC_FORMS))), "domestic")
        .otherwise("none")
    )


def stripped_key(name: Column, forms: tuple[str, ...], tags: str | None = None) -> Column:
    """Key for name lists with their own suffixes; ``tags`` (a pattern) goes first, as '/DE/' does."""
    value = upper_fold(F.coalesce(name, F.lit("")))
    if tags:
        value = F.regexp_replace(value, tags, " ")
    plain = F.regexp_replace(F.replace(value, F.lit("&"), F.lit(" AND ")), "[^A-Z0-9 ]", " ")
    plain = F.regexp_replace(plain, " +", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, whole_words(forms), " "), " +", " "))


# Suffixes of two more kinds of name list.
LIST_FORMS = ("INC", "INCORPORATED", "LLC", "L L C", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "D B A", "DBA")
ISSUER_FORMS = ("INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC", "LLC", "LP", "SA", "NV", "AG", "THE")


def list_key(name: Column) -> Column:
    return stripped_key(name, LIST_FORMS)


def issuer_key(name: Column) -> Column:
    return stripped_key(name, ISSUER_FORMS, r"/[A-Z]{2,3}/?")


def normalize_fei(value: Column) -> Column:
    """Establishment id: no trailing '.0', digits only, no leading zeros; NULL gives ''."""
    text = F.regexp_replace(F.trim(F.coalesce(value.cast("string"), F.lit(""))), r"\.0$", "")
    return F.regexp_replace(F.regexp_replace(text, r"\D", ""), "^0+", "")


def padded_key(value: Column, width: int = 6) -> Column:
    """Zero-padded textual key from a number or text; not a number gives NULL."""
    number = F.expr("NULL").cast("bigint") if value is None else value.try_cast("double").cast("bigint")
    return F.when(number.isNotNull(), F.lpad(number.cast("string"), width, "0"))


def slug(text: Column, length: int = 40, keep_case: bool = False) -> Column:
    body = text if keep_case else F.lower(text)
    dashed = F.regexp_replace(body, "[^A-Za-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, length), "-+$", "")


# Words that do not tell one firm from another.
GENERIC_WORDS = (
    "MEDICAL DEVICE DEVICES PHARMACEUTICAL PHARMACEUTICALS PHARMA LABORATORIES LABORATORY LABS HEALTH HEALTHCARE "
    "SYSTEMS TECHNOLOGY TECHNOLOGIES PRODUCTS SCIENCES SCIENTIFIC INDUSTRIES SERVICES SOLUTIONS AMERICA AMERICAN GLOBAL "
    "INTERNATIONAL CORPORATION COMPANY INCORPORATED LIMITED GROUP HOLDINGS"
).split()


def distinctive_words(name: Column, least: int = 4) -> Column:
    words = F.split(F.regexp_replace(upper_fold(F.coalesce(name, F.lit(""))), "[^A-Z0-9]+", " "), " ")
    return F.array_except(F.filter(words, lambda w: F.length(w) >= least), F.lit(GENERIC_WORDS))


def shares_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(distinctive_words(a), distinctive_words(b))


def document_url(root: str, cik: Column, accession: Column, document: Column) -> Column:
    number = cik.try_cast("bigint").cast("string")
    return F.concat_ws("/", F.lit(root), number, F.replace(accession, F.lit("-"), F.lit("")), document)


def joined(values: Column, separator: str = "; ") -> Column:
    """Non-null elements joined; nothing to join gives NULL."""
    present = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(present) > 0, F.array_join(present, separator))


def page_id(url: Column) -> Column:
    """The page number 'ucmNNN' in an address, else the address."""
    found = F.regexp_extract(url, r"ucm\d+", 0)
    return F.when(found != "", found).otherwise(url)


def case_in_url(url: Column) -> Column:
    """struct(case_id, dated) of an address that ends in '-<case>-<MMDDYYYY>'."""
    pattern = r"-(\d{5,7})-(\d{8})/?$"
    dated = F.try_to_timestamp(F.regexp_extract(url, pattern, 2), F.lit("MMddyyyy")).cast("date")
    return F.struct(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")).alias("case_id"), dated.alias("dated"))


def partition_tag(url: Column) -> Column:
    """'YYYYqN__part' of a bulk partition's address, so that equal part names of different quarters stay apart."""
    quarter = F.regexp_extract(url, r"/(\d{4}q\d)/", 1)
    part = F.regexp_extract(url, r"(\d{4}-of-\d{4})", 1)
    return F.concat_ws("__", quarter, part)


def mentions_place(text: Column, name: Column, code: Column, aliases: Column) -> Column:
    """Whether a text names a state (in full, or its code before a ZIP code) or any alias of a country."""
    padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}0-9]+", " "), F.lit(" "))
    full = F.contains(F.lower(padded), F.lower(F.concat(F.lit(" "), name, F.lit(" "))))
    zips = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2})\b\.?\s+\d{5}"), F.lit(1)), lambda c: c)
    coded = F.array_contains(zips, code)
    abroad = F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.contains(F.lower(text), F.lower(a)))
    return F.coalesce(full, F.lit(False)) | F.coalesce(coded, F.lit(False)) | abroad
