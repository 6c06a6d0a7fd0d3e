"""Chat records: filters, dedupe, participants and reflection batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.text import chat_age, content_text
from memlattice.operators.ranking import first_wins

# Sender ids and names that identify nobody.
NO_IDS = ("", "unknown", "none", "null", "0")
NO_NAMES = ("", "unknown", "none", "null", "未知", "未知用户", "用户")
# Words by which a message is known as a tool call.
TOOL_WORDS = ("tool_call", "function_call", "tool_use", "工具调用")
TURNS, IDLE_SECONDS = 6, 600.0


def gate(messages: DataFrame, least: int = 5) -> DataFrame:
    """Messages worth looking at: long enough and no command."""
    t = F.trim(F.coalesce("content", F.lit("")))
    return messages.filter((F.char_length(t) >= least) & ~F.startswith(t, F.lit("/")))


def unprocessed(messages: DataFrame) -> DataFrame:
    """Messages marked as not yet processed; without a mark they count as processed."""
    return messages.filter(F.coalesce(~F.col("is_processed"), F.lit(False)))


def identified(sender_id: Column, sender_name: Column) -> Column:
    """A valid id is enough; without one a valid name."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return ~low(sender_id).isin(*NO_IDS) | ~low(sender_name).isin(*NO_NAMES)


def no_tool_calls(messages: DataFrame) -> DataFrame:
    t = F.coalesce("content", F.lit(""))
    found = F.lit(False)
    for w in TOOL_WORDS:
        found = found | F.contains(t, F.lit(w))
    return messages.filter(~found)


def dedupe(messages: DataFrame) -> DataFrame:
    """One row a (session, role, sender, time to the microsecond, content), the first; in order of time."""
    keyed = messages.withColumn("__t", F.round("ts", 6))
    return first_wins(keyed, ["session", "role", "sender_id", "__t", "content"], [F.col("seq")]).drop("__t").orderBy("session", "ts", "seq")


def participants(messages: DataFrame) -> DataFrame:
    """(session, sender_id, sender_name): each sender once, under the first name."""
    return first_wins(messages.select("session", "sender_id", "sender_name", "seq"), ["session", "sender_id"], [F.col("seq")])


def users(messages: DataFrame) -> DataFrame:
    """(session, sender_id, first_seq, latest_name): latest non-empty name of each user, users in order of first appearance."""
    named = F.when(F.trim(F.coalesce("sender_name", F.lit(""))) != "", F.col("sender_name"))
    rows = messages.filter((F.col("role") == "user") & (F.coalesce("sender_id", F.lit("")) != ""))
    return rows.groupBy("session", "sender_id").agg(F.min("seq").alias("first_seq"), F.coalesce(F.max_by(named, F.when(named.isNotNull(), F.col("seq"))), F.lit("")).alias("latest_name"))


def last_unprocessed(messages: DataFrame) -> DataFrame:
    """(session, content): text of the last unprocessed message."""
    return unprocessed(messages).groupBy("session").agg(F.max_by(content_text(F.col("content")), F.col("seq")).alias("content"))


def chat_lines(messages: DataFrame, now: float) -> DataFrame:
    """(session, lines): messages in order, each as [id] name (age): text."""
    who = F.concat(F.lit("["), F.coalesce("sender_id", F.lit("")), F.lit("] "), F.coalesce("sender_name", "role"))
    line = F.concat(who, F.lit(" ("), chat_age(F.lit(now), F.col("ts")), F.lit("): "), content_text(F.col("content")))
    rows = messages.withColumn("line", line).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("x"))
    return rows.select("session", F.array_join(F.col("x.line"), "\n").alias("lines"))


def reflection_batches(turns: DataFrame, most: int = TURNS, idle: float = IDLE_SECONDS) -> DataFrame:
    """The batches that a live buffer would release, over a finished log (session, seq, ts): a run without a gap of ``idle`` seconds, in
    groups of ``most`` turns.  Adds batch_no, and trigger: count, or idle for a group that the gap (or the end) closed."""
    w = Window.partitionBy("session").orderBy("ts", "seq")
    gap = F.col("ts") - F.lag("ts").over(w) >= idle
    rows = turns.withColumn("__run", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r = Window.partitionBy("session", "__run").orderBy("ts", "seq")
    rows = rows.withColumn("__k", F.floor((F.row_number().over(r) - 1) / most))
    g = Window.partitionBy("session", "__run", "__k")
    rows = rows.withColumn("trigger", F.when(F.count("*").over(g) == most, "count").otherwise("idle"))
    rows = rows.withColumn("batch_no", F.dense_rank().over(Window.partitionBy("session").orderBy("__run", "__k")))
    return rows.drop("__run", "__k")
