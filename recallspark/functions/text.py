"""Text functions as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that a lexical query built from messages leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "can", "could", "for", "from", "i", "in", "is", "it", "me",
    "my", "of", "on", "or", "please", "that", "the", "this", "to", "was", "we", "with", "would", "you", "your",
)
MOST_QUERY_TERMS = 12
#: Phrases that mean an answer abstains.
ABSTENTIONS = ("no information available", "not mentioned")
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def fold(text: Column) -> Column:
    """Case folding for text whose only full folding is the sharp s; casefold_nfkc covers the rest."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def casefold_nfkc(text: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, full case folding: identity of free text of any script."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


@F.pandas_udf(StringType())
def trimmed_nfkc(text: pd.Series) -> pd.Series:
    """NFKC, outer white space off, full case folding."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip().casefold())


@F.pandas_udf(StringType())
def trimmed_nfc(text: pd.Series) -> pd.Series:
    """NFC, outer white space off; case stays."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).strip())


@F.pandas_udf(StringType())
def collapsed_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else " ".join(t.casefold().split()))


#: What Unicode counts as white space among the ASCII characters.
_ASCII_SPACE = r"[\t-\r\x1c-\x20]+"


def _by_script(text: Column, plain: Column, other: Callable[[Column], Column]) -> Column:
    """plain for ASCII text, which stays in the JVM; only other text, in which normal forms can differ, is sent to the Arrow function."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(text.isNull() | ascii_only, plain).otherwise(other(F.when(~ascii_only, text)))


def _ascii_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_ASCII_SPACE}|{_ASCII_SPACE}$", "")


def trim_fold(text: Column) -> Column:
    """NFKC, trimmed, folded."""
    return _by_script(text, F.lower(_ascii_trim(text)), trimmed_nfkc)


def trim_nfc(text: Column) -> Column:
    return _by_script(text, _ascii_trim(text), trimmed_nfc)


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), 0)


def normalize(text: Column) -> Column:
    """Identity of memory texts and values: NFKC, Unicode white space collapsed, full case folding."""
    return _by_script(text, F.trim(F.regexp_replace(F.lower(text), _ASCII_SPACE, " ")), casefold_nfkc)


def gold_text(text: Column) -> Column:
    """Texts as gold terms are sought in them: case folded and white space collapsed, no other normal form."""
    return _by_script(text, F.trim(F.regexp_replace(F.lower(text), _ASCII_SPACE, " ")), collapsed_casefold)


def percent_encode(text: Column) -> Column:
    """RFC 3986 with - . _ ~ left as they are."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def like_literal(text: Column, needle: Column) -> Column:
    """Case-insensitive substring; wildcards in the needle mean themselves."""
    return F.contains(F.lower(text), F.lower(needle))


def query_terms(tokens: Column) -> Column:
    """The first MOST_QUERY_TERMS distinct tokens of two characters or more that are no stop words."""
    good = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))
    return F.slice(F.array_distinct(good), 1, MOST_QUERY_TERMS)


def normalize_answer(text: Column) -> Column:
    """Commas vanish, then lower case, articles to spaces, punctuation away, white space collapsed."""
    out = F.regexp_replace(F.lower(F.replace(text, F.lit(","), F.lit(""))), r"(?U)\b(a|an|the|and)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, PUNCTUATION, ""), r"(?U)\s+", " "))


def is_abstention(text: Column) -> Column:
    out = F.lit(False)
    for phrase in ABSTENTIONS:
        out = out | F.contains(F.lower(text), F.lit(phrase))
    return out


def strip_fence(text: Column) -> Column:
    """The lines between a first line of three backticks, with json or nothing after them, and a last line of three backticks; or the text."""
    body = F.trim(text)
    first = F.rtrim(F.lower(F.substring_index(body, "\n", 1)), F.lit(" \t\r"))
    lines = F.split(body, "\n")
    inside = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(first.isin("```", "```json") & (F.size(lines) > 2) & (F.element_at(lines, -1) == "```"), inside).otherwise(text)


def evidence_ids(raw: Column) -> Column:
    """Dialogue ids D<session>:<turn> in a text, without leading zeros, in order."""
    found = F.regexp_extract_all(raw, F.lit(r"D0*\d+:0*\d+"), 0)
    return F.transform(found, lambda x: F.regexp_replace(x, r"D0*(\d+):0*(\d+)", "D$1:$2"))


def evidence(raw: Column, known: Column) -> Column:
    """struct(resolved, unresolved): the ids of a text that an array of known ids holds, once each and in order, and the parts separated by
    white space or semicolons that give none."""
    parts = F.filter(F.split(raw, r"[\s;,]+"), lambda x: x != "")
    ids = F.transform(parts, lambda x: F.struct(x.alias("raw"), F.try_element_at(evidence_ids(x), F.lit(1)).alias("id")))
    ids = F.transform(ids, lambda x: F.struct(x["raw"].alias("raw"), F.when(F.array_contains(known, x["id"]), x["id"]).alias("id")))
    return F.struct(F.array_distinct(F.transform(F.filter(ids, lambda x: x["id"].isNotNull()), lambda x: x["id"])).alias("resolved"), F.transform(F.filter(ids, lambda x: x["id"].isNull()), lambda x: x["raw"]).alias("unresolved"))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")
