"""Text normalisation as column expressions (TX1-TX15)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tokens and markers that results depend on.
LEGAL_FORMS = (
    "ab", "ag", "and", "as", "assn", "association", "bhd", "bv", "co", "company", "corp", "corporation", "eurl", "gmbh", "huf", "inc",
    "incorporated", "kg", "limited", "llc", "llp", "lp", "ltd", "nv", "of", "ohg", "opc", "oy", "plc", "pllc", "private", "pte", "pvt", "sa",
    "sarl", "sas", "sasu", "sci", "scp", "sdn", "selarl", "sl", "snc", "society", "spa", "srl", "the", "trust",
)
ADDRESS_WORDS = (
    "apartment", "apt", "at", "av", "ave", "avenue", "bd", "behind", "beside", "bldg", "block", "blvd", "boulevard", "box", "building", "cir",
    "circle", "co", "colony", "court", "ct", "de", "des", "door", "dr", "drive", "du", "fl", "floor", "highway", "hn", "hwy", "la", "lane", "le",
    "les", "ln", "marg", "na", "nagar", "near", "nil", "no", "none", "nos", "null", "number", "of", "opp", "opposite", "parkway", "phase",
    "pkwy", "pl", "place", "plot", "po", "r", "rd", "road", "rue", "sector", "sq", "square", "st", "ste", "street", "suite", "ter", "terrace",
    "the", "trail", "trl", "unit", "way",
)
ALIAS = r"\b(?:a/?k/?a|f/?k/?a|d/?b/?a|formerly known as|now known as|trading as|t/a)\b"
DOMAIN_ENDS = r"\.(?:com|net|org|co|in|fr|io|biz|info)\b"
MARKS = "[\\u0300-\\u036f\\u0653-\\u0655\\u0670]"
LETTERS = "[^0-9a-z\\u0900-\\u0dff ]+"
NON_ASCII = "[^\\x00-\\x7f]"
#: ASCII characters that LETTERS matches, but for capitals, which are lower-cased before.
OTHER_ASCII = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c == " "))
#: What a text must hold for ALIAS to match it.
ALIAS_PARTS = ("aka", "fka", "dba", "/", "known as", "trading as")


def non_ascii(c: Column) -> Column:
    """Does the text hold a character outside ASCII? Those alone take more than a byte."""
    return F.length(c) != F.octet_length(c)


def _holding(c: Column, parts: Sequence[str], change: Callable[[Column], Column]) -> Column:
    """``change`` where the text holds one of the parts, without which the pattern can't match; else the text. The
    text is bound in a lambda, so that it is worked out once."""
    bound = lambda v: F.when(reduce(or_, (F.contains(v, F.lit(p)) for p in parts)), change(v)).otherwise(v)
    return F.get(F.transform(F.array(c), bound), F.lit(0))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKD", t))


def fold(c: Column) -> Column:
    """TX1: compatibility decomposition without combining marks. Only texts outside ASCII cross to Python with their
    characters; the others, which decompose to themselves, cross as nulls and never leave the JVM."""
    other = non_ascii(c)
    return F.when(other, F.regexp_replace(_decomposed(F.when(other, c)), MARKS, "")).otherwise(c)


def _letters(c: Column) -> Column:
    """Letters, digits and spaces: other ASCII characters are mapped one by one, which is many times cheaper than a
    pattern; texts with others get the pattern."""
    mapped = F.translate(F.replace(c, F.lit("&"), F.lit(" and ")), OTHER_ASCII, " " * len(OTHER_ASCII))
    return F.get(F.transform(F.array(mapped), lambda v: F.when(non_ascii(v), F.regexp_replace(v, LETTERS, " ")).otherwise(v)), F.lit(0))


def _spaced(c: Column) -> Column:
    """Runs of spaces as one; after ``_letters`` there is no other white space. Short runs need no pattern."""
    for change in (lambda v: F.replace(F.replace(v, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" ")), lambda v: F.regexp_replace(v, " {2,}", " ")):
        c = _holding(c, ["  "], change)
    return F.trim(c)


def name_form(c: Column) -> Column:
    """TX2-TX4: folded, lower case, what follows the first alias marker, domains opened, letters and digits only."""
    c = _holding(F.lower(fold(c)), ALIAS_PARTS, lambda v: F.regexp_replace(v, rf"^.*?{ALIAS}\s*:?\s*", ""))
    c = _holding(c, ["."], lambda v: F.regexp_replace(F.regexp_replace(v, r"\bwww\.", ""), DOMAIN_ENDS, " "))
    return _spaced(_letters(c))


def address_form(c: Column) -> Column:
    """TX5: folded, lower case, placeholders for nothing removed, letters and digits only."""
    c = _holding(F.lower(fold(c)), ["<"], lambda v: F.regexp_replace(v, r"<\s*null\s*>", " "))
    c = _holding(_letters(c), ("null", "none", "nil"), lambda v: F.regexp_replace(v, r"\b(?:null|none|nil)\b", " "))
    return _spaced(c)


def content_words(c: Column) -> Column:
    """TX6: words of a normalised name without legal forms, order and repeats kept."""
    return F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(*LEGAL_FORMS))


def name_words(c: Column) -> Column:
    """TX7."""
    return F.array_distinct(content_words(c))


def address_words(c: Column) -> Column:
    """TX8: telling words of a normalised address."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: (F.length(w) >= 2) & ~w.isin(*ADDRESS_WORDS) & ~w.rlike("^[0-9]+$")))


def address_numbers(c: Column) -> Column:
    """TX9: digit runs without leading zeros."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda d: F.ltrim(d, F.lit("0"))), lambda d: d != ""))


def joined(c: Column, sort: bool = True, sep: str = " ") -> Column:
    return F.array_join(F.array_sort(c) if sort else c, sep)


def comma_list(c: Column) -> Column:
    """TX14: a comma list to an array; the empty string has no elements."""
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


SCRIPTS = (
    "Devanagari", "Tamil", "Telugu", "Bengali", "Gujarati", "Kannada", "Malayalam", "Gurmukhi", "Oriya", "Arabic", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul",
)


def script(c: Column) -> Column:
    """TX12: writing system of the first letter; other letters count as LATIN, none as NONE. Han and Hangul are
    told apart by their Unicode scripts."""
    first = F.regexp_extract(c, "\\p{L}", 0)
    out = F.when(first == "", "NONE")
    for s in SCRIPTS:
        out = out.when(first.rlike(f"\\p{{Is{s}}}"), s.upper())
    return out.otherwise("LATIN")


def normalised(df: DataFrame) -> DataFrame:
    """TX10: what all views are made of: both normalised texts, and whether the raw ones are outside ASCII."""
    made = {"name_norm": name_form(F.col("business_name")), "addr_norm": address_form(F.col("business_address"))}
    return df.withColumns(made | {"name_nonascii": non_ascii(F.col("business_name")), "addr_nonascii": non_ascii(F.col("business_address"))})


def with_forms(df: DataFrame) -> DataFrame:
    """TX10, TX11: every normalised view of business_name and business_address."""
    return with_views(normalised(df))


def with_views(df: DataFrame, prefix: str = "") -> DataFrame:
    """TX11: the other views of normalised records, whose columns may have a prefix."""
    col = lambda name: F.col(prefix + name)

    def put(out: DataFrame, **made: Column) -> DataFrame:
        return out.withColumns({prefix + name: c for name, c in made.items()})

    out = put(df, name_toks=name_words(col("name_norm")), addr_toks=address_words(col("addr_norm")), addr_nums=address_numbers(col("addr_norm")))
    out = put(out, name_core=joined(content_words(col("name_norm")), sort=False), name_key=joined(col("name_toks")))
    without = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return put(out, name_core_nospace=without(col("name_core")), name_nospace=without(col("name_norm")))
