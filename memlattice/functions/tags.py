"""Tag lists and what they say of users."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlattice.schemas import PROFILE_ATTRIBUTES

_NONE = "array<string>"


def normalize_tags(tags: Column) -> Column:
    """Trimmed, without empties, each once in the order of first appearance; null is none."""
    t = F.coalesce(tags, F.array().cast(_NONE))
    return F.array_distinct(F.filter(F.transform(t, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))


def parse_tags(text: Column) -> Column:
    """Tags from a JSON list or a comma-separated text."""
    listed = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), _NONE)
    bare = F.split(F.regexp_replace(text, r"^\[|\]$", ""), ",")
    return normalize_tags(F.when(F.startswith(F.trim(text), F.lit("[")), F.coalesce(listed, bare)).otherwise(bare))


def is_user_id(tag: Column) -> Column:
    """Longer than five characters, neither all CJK nor all ASCII letters."""
    t = F.trim(tag)
    return (F.char_length(t) > 5) & ~t.rlike("^[一-鿿]+$") & ~t.rlike("^[A-Za-z]+$")


def is_attribute(tag: Column) -> Column:
    return tag.isin(*PROFILE_ATTRIBUTES)


def user_id(tags: Column) -> Column:
    """The user id among the tags if there is exactly one, else empty."""
    ids = F.filter(normalize_tags(tags), is_user_id)
    return F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).otherwise(F.lit(""))


def profile_attribute(tags: Column) -> Column:
    return F.coalesce(F.get(F.filter(normalize_tags(tags), is_attribute), F.lit(0)), F.lit(""))


def nickname(tags: Column) -> Column:
    return F.coalesce(F.get(F.filter(normalize_tags(tags), lambda t: ~is_user_id(t) & ~is_attribute(t)), F.lit(0)), F.lit(""))


def is_profile(tags: Column) -> Column:
    return (user_id(tags) != "") & (profile_attribute(tags) != "")


def session_user_id(tags: Column) -> Column:
    """The session cache's own rule: the first tag of six digits or more."""
    return F.coalesce(F.get(F.filter(normalize_tags(tags), lambda t: t.rlike("^[0-9]{6,}$")), F.lit(0)), F.lit(""))
