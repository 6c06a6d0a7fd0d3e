"""Browse, tag and profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions import tags as T
from memlattice.functions.text import like_pattern
from memlattice.operators.chat import users
from memlattice.operators.ranking import quota
from memlattice.operators.retrieval import scope_filter
from memlattice.schemas import PUBLIC


def keyword_filter(memories: DataFrame, keyword: str) -> DataFrame:
    """Memories with the keyword in judgment, reasoning or a tag, case aside."""
    p = like_pattern(keyword)
    hit = F.ilike("judgment", F.lit(p)) | F.ilike("reasoning", F.lit(p)) | F.exists("tags", lambda t: F.ilike(t, F.lit(p)))
    return memories.filter(F.coalesce(hit, F.lit(False)))


def overview(records: DataFrame, dimension: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row of table counts and the scopes in use."""
    a = records.agg(F.count("*").alias("records"), F.count_if("is_active").alias("active"), F.array_join(F.array_sort(F.collect_set("memory_scope")), ",").alias("scopes"))
    return a.crossJoin(dimension.agg(F.count("*").alias("tags"))).crossJoin(bridge.agg(F.count("*").alias("links")))


def tag_counts(dimension: DataFrame, bridge: DataFrame) -> DataFrame:
    """(id, name, memory_count), 0 for tags that nothing has."""
    n = bridge.groupBy("tag_id").agg(F.count("*").alias("n"))
    return dimension.join(n.withColumnRenamed("tag_id", "id"), "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("memory_count"))


def tags_in_query(dimension: DataFrame, query: str) -> DataFrame:
    """Tags whose name is part of the query, case aside."""
    return dimension.filter((F.trim("name") != "") & F.contains(F.lit(query.lower()), F.lower("name")))


def tag_hits(memories: DataFrame, dimension: DataFrame, bridge: DataFrame, query: str, scope: str, limit: int) -> DataFrame:
    """Memories by how many of the query's tags they have, then by strength and age."""
    hit = bridge.join(tags_in_query(dimension, query).select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    n = hit.groupBy(F.col("memory_id").alias("id")).agg(F.count_distinct("tag_id").alias("hit_count"))
    found = memories.filter(scope_filter(scope)).join(n, "id")
    return found.orderBy(F.desc("hit_count"), F.desc("strength"), F.desc("created_at"), "id").limit(limit)


def profiles(memories: DataFrame) -> DataFrame:
    """Memories that are profile entries, with user_id, attribute and nickname."""
    t = F.col("tags")
    return memories.filter(T.is_profile(t)).withColumn("user_id", T.user_id(t)).withColumn("attribute", T.profile_attribute(t)).withColumn("nickname", T.nickname(t))


def profile_recall(memories: DataFrame, users: list[str], scope: str, most: int = 30) -> DataFrame:
    """Profile entries of the users that the scope sees, active and recent ones first, up to ``most`` a user."""
    found = profiles(memories.filter(scope_filter(scope))).filter(F.col("user_id").isin(*users))
    order = [F.desc("is_active"), F.desc("updated_at"), F.col("id")]
    return quota(found, ["user_id"], order, most).orderBy(*order)


def session_profiles(turns: DataFrame, memories: DataFrame, scope: str = PUBLIC, most: int = 30) -> DataFrame:
    """(session, sender_id, latest_name and the profile entries) of the users who spoke in each session: ``most`` a user, active and recent ones first.

    Entries are cut to ``most`` a user before they meet the sessions.
    """
    found = profiles(memories.filter(scope_filter(scope)))
    best = quota(found, ["user_id"], [F.desc("is_active"), F.desc("updated_at"), F.col("id")], most)
    return users(turns).join(best, F.col("sender_id") == F.col("user_id")).drop("first_seq")


def profile_detail(memories: DataFrame, user: str) -> DataFrame:
    """All profile entries of one user, by attribute, active and recent ones first."""
    return profiles(memories).filter(F.col("user_id") == user).orderBy("attribute", F.desc("is_active"), F.desc("updated_at"), "id")


def tag_pair_memories(dimension: DataFrame, bridge: DataFrame) -> DataFrame:
    """Ids of memories with a user-id tag and an attribute tag: two semi joins, so nothing multiplies."""
    user = dimension.filter(T.is_user_id(F.col("name"))).select(F.col("id").alias("tag_id"))
    attribute = dimension.filter(T.is_attribute(F.col("name"))).select(F.col("id").alias("tag_id"))
    a = bridge.join(user, "tag_id", "left_semi").select("memory_id").distinct()
    b = bridge.join(attribute, "tag_id", "left_semi").select("memory_id").distinct()
    return a.join(b, "memory_id", "left_semi").select(F.col("memory_id").alias("id"))


def profile_stats(memories: DataFrame) -> DataFrame:
    """(user_id, memory_count, attributes as "name:count" list, nickname of the newest entry that has one)."""
    p = profiles(memories)
    per = p.groupBy("user_id", "attribute").agg(F.count("*").alias("n"), F.max(F.when(F.col("nickname") != "", F.struct("updated_at", "id", "nickname"))).alias("nick"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "attribute", "n"))), ",")
    return per.groupBy("user_id").agg(F.sum("n").alias("memory_count"), listed.alias("attributes"), F.coalesce(F.max("nick")["nickname"], F.lit("")).alias("nickname"))


def without_profiles(regular: DataFrame, profile_ids: DataFrame) -> DataFrame:
    """Recalled memories that are not shown as profile entries already."""
    return regular.join(profile_ids.select("id").distinct(), "id", "left_anti")


def by_type(memories: DataFrame) -> DataFrame:
    """Ranked memories (memory_type, rank, id) grouped by type, types in order of first appearance."""
    g = memories.groupBy("memory_type").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return g.select("memory_type", F.row_number().over(Window.orderBy("first")).alias("place"), F.array_join(F.col("x.id"), ",").alias("ids"))


def session_stats(state: DataFrame, capacity: dict[str, int], default: int) -> DataFrame:
    """(memory_type, current, capacity, usage, high, low) of the session references."""
    cap = F.lit(default)
    for kind, n in capacity.items():
        cap = F.when(F.col("memory_type") == kind, n).otherwise(cap)
    g = state.groupBy("memory_type").agg(F.count("*").alias("current"), F.count_if(F.col("priority") >= 5).alias("high"), F.count_if(F.col("priority") < 5).alias("low"))
    return g.withColumn("capacity", cap).withColumn("usage", F.round(F.col("current") / F.col("capacity"), 4))
