"""Logical identity of facts: predicates, subjects, values and fact keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, percent_encode, trim_fold, trim_nfc

#: Predicates and their cardinality.
SINGLE = ("name", "location", "timezone", "database_preference", "project_status")
MULTI = ("framework_preference", "programming_language", "skill", "interest", "works_on")
#: Other names of predicates.
ALIASES = {
    "preferred_database": "database_preference", "db_preference": "database_preference", "current_location": "location",
    "current_city": "location", "residence": "location", "home_location": "location", "lives_in": "location",
}


def _underscored(x: Column) -> Column:
    return F.regexp_replace(trim_fold(x), r"(?U)[\s\x1c-\x1f-]+", "_")


def resolve_predicate(name: Column) -> Column:
    """The registered predicate of a name or alias, or null."""
    plain = _underscored(name)
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), plain), plain)
    return F.when(known.isin(*SINGLE, *MULTI), known)


def is_single(predicate: Column) -> Column:
    return predicate.isin(*SINGLE)


def _filled(x: Column) -> Column:
    return F.when(x != "", percent_encode(x))


def subject_type(x: Column) -> Column:
    return _filled(_underscored(x))


def value_identity(x: Column) -> Column:
    return _filled(normalize(x))


def subject_id(x: Column) -> Column:
    return _filled(trim_nfc(x))


def fact_key(memory_type: Column, subject: Column, user: Column, predicate: Column, value: Column) -> Column:
    """type:id:predicate for single predicates, with the value's identity for others; null if anything is missing.

    Only subjects of type user have a canonical id, the user's.
    """
    kind, known = subject_type(subject), resolve_predicate(predicate)
    holder = F.when(kind == "user", subject_id(user))
    single = F.when(holder.isNotNull(), F.concat_ws(":", kind, holder, known))
    multi = F.when(holder.isNotNull() & value_identity(value).isNotNull(), F.concat_ws(":", kind, holder, known, value_identity(value)))
    return F.when((memory_type == "semantic") & known.isNotNull(), F.when(is_single(known), single).otherwise(multi))
