"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order (by the MD5 of the id), offered up
to ``max_epochs`` times over.  A copy's virtual finish time is the number of words its
queue has served when the copy ends, divided by the queue's target.  All copies, ordered by virtual finish
time (then by source), are cut where the total budget, the words of all documents, is used up; a copy is
taken if at least half of it lies before the cut.  All queues share one virtual clock, so each is then at its
target, to within the copies in service.

The global order is a range partitioning by finish time.  Words are spread evenly over virtual time, so equal ranges of it hold
equal numbers of words; the totals of the ranges, summed up, tell in which one the budget is used up. Only that one has to be sorted
to find the last copy taken, and any other copy is before or after it.

The running word count of a queue is a distributed prefix sum: queues are cut into shuffle
buckets, bucket totals give offsets, and only rows of one (source, bucket) meet in a task,
so a source that holds a third of all rows is spread over all its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import WORD, Scratch, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 256


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> adds weight and target; water level found with running sums.

    Sources by code point, null last, take the weights in turn.  Targets are
    ``min(max_epochs * source_size, level * weight)`` with the level at which they sum to
    the sum of all sizes.  One row per source: the only single-partition step, over sources and
    never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    t = t.withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, keep=None) -> DataFrame:
    """Adds size, source_size, target, copies, taken and virtual_finish (of the first copy) to the columns to ``keep`` (default: all).

    Null text has size 0 and is never taken; null sources form one queue; rows that
    repeat an id are separate documents of the queue, and rows without id are shuffled by their text.  Columns with these names are replaced.
    """
    spark = docs.sparkSession
    added = ["size", "source_size", "target", "copies", "taken", "virtual_finish"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    n_buckets = max(1, min(1 << 16, math.ceil(docs.count() / ROWS_PER_BUCKET)))
    text = text_or_empty(text_col)
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(text))))
    # 28 bits of the key, scaled to the buckets, so that bucket order is key order
    bucket = F.floor(F.conv(F.substring("__key", 1, 7), 16, 10).cast("double") / float(1 << 28) * n_buckets).cast("int")
    sized = docs.select(*kept, F.col(source_col).alias("__source"), F.col(id_col).alias("__id"), word_count(text).alias("size"), key.alias("__key")).withColumn("__bucket", bucket)
    scratch = Scratch(spark, "mix")
    totals = scratch.save(sized.groupBy(F.col("__source").alias("source"), "__bucket").agg(F.sum("size").alias("words")))
    sizes = totals.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    same = F.col("o.source").eqNullSafe(F.col("t.source"))
    offsets = offsets.alias("o").join(targets.alias("t"), same, "left").select("o.source", "o.__bucket", "offset", "source_size", "target")
    offsets = scratch.save(offsets.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "offset", "source_size", "target"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__key", "__id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("__cum", F.sum("size").over(inside)).join(
        offsets, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")), "left"
    )
    end = F.col("offset") + F.col("__cum")
    placed = scratch.save(placed.select(*kept, "__source", "size", "source_size", "target", end.alias("__end")))
    finish = [F.when(F.col("size") > 0, (F.lit(e) * F.col("source_size") + F.col("__end")) / F.col("target")) for e in range(max_epochs)]
    every = placed.filter("size > 0").select("__source", "size", F.explode(F.array(*finish)).alias("vf"))
    before = cut(every, totals.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0], n_buckets)
    copies = sum((F.when(before(f, F.col("__source")), 1).otherwise(0) for f in finish), F.lit(0))
    return placed.select(
        *[F.col(c) for c in kept],
        "size",
        "source_size",
        "target",
        copies.cast("int").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        finish[0].alias("virtual_finish"),
    )


def cut(copies: DataFrame, budget: int, ranges: int) -> Callable[[Column, Column], Column]:
    """What tells of a copy (vf, __source, size), by finish time and source, whether it is before the cut at ``budget`` words.

    ``ranges`` equal ranges of virtual time up to 1, as many up to 2 and one beyond: their totals are a small table, and one range is sorted.
    """
    number = lambda vf: F.least(F.floor(vf * ranges), F.lit(2 * ranges)).cast("int")
    copies = copies.withColumn("range", number(F.col("vf")))
    so_far = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("so_far", so_far)
    last = totals.filter(F.col("so_far") >= budget).orderBy("range").first()
    if last is None:
        return lambda vf, source: F.lit(False)
    order = Window.partitionBy("range").orderBy("vf", F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = copies.filter(F.col("range") == last["range"]).withColumn("half", F.lit(last["so_far"] - last["words"]) + F.sum("size").over(order) - F.col("size") / 2)
    at = inside.filter(F.col("half") <= budget).orderBy(F.desc("vf"), F.col("__source").desc_nulls_first()).select("vf", "__source").first()

    def before(vf: Column, source: Column) -> Column:
        earlier = number(vf) < last["range"]
        if at is None:
            return earlier
        tie = F.lit(True) if at["__source"] is None else source.isNotNull() & (source <= F.lit(at["__source"]))
        return earlier | (vf < F.lit(at["vf"])) | ((vf == F.lit(at["vf"])) & tie)

    return before


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, a row for each copy taken, range-sorted by virtual finish time.  Nulls, ties and repeated rows as in mix_plan."""
    plan = mix_plan(docs.select(*docs.columns, F.struct(*docs.columns).alias("__row")), keep=["__row"], **options)
    per_epoch = F.when(F.col("target") > 0, F.col("source_size") / F.col("target"))
    out = plan.filter("copies > 0").withColumn("__e", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.orderBy(F.col("virtual_finish") + F.col("__e") * per_epoch).select("__row.*")
