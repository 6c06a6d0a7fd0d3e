"""Quotas, dedupe and paging over ranked rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_of_each(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key, null being a key like others: one pass over the rows."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rn", rn).filter(F.col("__rn") <= most).drop("__rn")


def quota(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key; a null key is not limited.  Ranks below the limit are cut before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    limited = rows.filter(known).withColumn("__rn", rn).filter(F.col("__rn") <= most).drop("__rn")
    return limited.unionByName(rows.filter(~known))


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rn", rn).filter(F.col("__rn") == 1).drop("__rn")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of the ordered rows; numbers from 1, sizes 1 to 100."""
    size = max(1, min(100, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_info(rows: DataFrame, number: int, size: int) -> DataFrame:
    """(total, page, page_size, total_pages), one page at least."""
    size = max(1, min(100, size))
    total = F.count("*")
    pages = F.greatest(F.lit(1), F.ceil(total / F.lit(size)))
    return rows.agg(total.alias("total"), F.lit(max(1, number)).alias("page"), F.lit(size).alias("page_size"), pages.cast("long").alias("total_pages"))


def has_more_page(rows: DataFrame, order: list[Column], number: int, size: int, most: int = 500) -> DataFrame:
    """A page over at most ``most`` rows with has_more, told by one row beyond it."""
    skip = (max(1, number) - 1) * size
    w = Window.orderBy(*order)
    cut = rows.orderBy(*order).limit(min(most, skip + size + 1)).withColumn("rn", F.row_number().over(w))
    more = F.max("rn").over(Window.partitionBy()) > skip + size
    return cut.withColumn("has_more", more).filter(F.col("rn").between(skip + 1, skip + size)).drop("rn")


def capacity_evict(state: DataFrame, capacity: dict[str, int], default: int) -> DataFrame:
    """Session references that stay: the highest (priority, added_at) up to the capacity of their type."""
    order = [F.desc("priority"), F.desc("added_at"), F.desc("id")]
    rn = F.row_number().over(Window.partitionBy("session", "memory_type").orderBy(*order))
    cap = F.lit(default)
    for kind, n in capacity.items():
        cap = F.when(F.col("memory_type") == kind, n).otherwise(cap)
    return state.withColumn("__rn", rn).filter(F.col("__rn") <= cap).drop("__rn")


class Knowledge(NamedTuple):
    """Capacities of one type of reference: about no user, and about users, who share theirs equally (0: as many as there are)."""

    kind: str
    regular: int
    shared: int


def knowledge_capacity(state: DataFrame, knowledge: Knowledge) -> DataFrame:
    """References that stay when one type is split: those about no user up to a capacity by highest (priority, added_at), those about a user up to the user's
    equal share of another capacity by highest priority, the earliest added first.  Other types stay."""
    of_user = (F.col("memory_type") == knowledge.kind) & (F.coalesce("user_id", F.lit("")) != "")
    rows = state.withColumn("__own", F.when(of_user, 2).when(F.col("memory_type") == knowledge.kind, 1).otherwise(0))
    by_user = Window.partitionBy("session", "__own", "user_id").orderBy(F.desc("priority"), "added_at", "id")
    regular = Window.partitionBy("session", "__own").orderBy(F.desc("priority"), F.desc("added_at"), F.desc("id"))
    users = rows.filter("__own = 2").groupBy("session").agg(F.count_distinct("user_id").alias("__users"))
    ranked = rows.withColumn("__u", F.row_number().over(by_user)).withColumn("__r", F.row_number().over(regular)).join(users, "session", "left")
    share = F.lit(True) if knowledge.shared <= 0 else F.col("__u") <= F.floor(F.lit(knowledge.shared) / F.col("__users"))
    stays = F.when(F.col("__own") == 2, share).when(F.col("__own") == 1, F.col("__r") <= knowledge.regular).otherwise(True)
    return ranked.filter(stays).select(*state.columns)


def shared_capacity(state: DataFrame, total: int) -> DataFrame:
    """User profiles that stay: every user of a session has an equal whole share (one at least) of ``total``."""
    order = [F.desc("priority"), F.desc("added_at"), F.desc("id")]
    users = state.groupBy("session").agg(F.count_distinct("user_id").alias("__users"))
    rn = F.row_number().over(Window.partitionBy("session", "user_id").orderBy(*order))
    share = F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("__users")))
    return state.join(users, "session").withColumn("__rn", rn).filter(F.col("__rn") <= share).drop("__rn", "__users")


def admit(state: DataFrame, batch: DataFrame, total: int) -> DataFrame:
    """References of a batch that fit what is left of their user's share, in batch order (pos)."""
    have = state.groupBy("session", "user_id").agg(F.count("*").alias("__have"))
    both = state.select("session", "user_id").union(batch.select("session", "user_id"))
    users = both.groupBy("session").agg(F.count_distinct("user_id").alias("__users"))
    new = batch.join(state.select("session", "id"), ["session", "id"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("session", "user_id").orderBy("pos"))
    share = F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("__users")))
    rows = new.join(users, "session").join(have, ["session", "user_id"], "left").withColumn("__rn", rn)
    return rows.filter(F.col("__rn") <= share - F.coalesce("__have", F.lit(0))).drop("__rn", "__users", "__have")
