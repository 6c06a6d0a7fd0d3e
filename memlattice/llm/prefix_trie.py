"""Prefix trie of conversations, as succinct level-order tries by prefix shard.

A conversation is a sequence of turns (role, text); it may start with turns of an older one (``grafts``).  A node is a distinct sequence of first d
turns.  It is named by a running SHA-256 over the turns' own (128 bits kept), taken in one pass over the turns of a conversation in order, so a long
conversation streams through its task.

* Equal prefixes become one row in a grouping with map-side sums: the node, with its members counted and the smallest one.
* A node is *heavy* if more than ``SHARD_TURNS`` turns hang below it (members times what is left of them).  The other nodes fall into subtrees whose tops have
  a heavy parent, or none.  Subtrees are hashed into shards of about ``SHARD_TURNS`` nodes each.
* A task builds the trie of its shard: nodes in level order, the LOUDS bits (a 1 for each child, then a 0), parents from the ranks of the ones.  Leaves and
  tokens are rolled up level by level from the deepest, with ``np.add.at``.
* Heavy nodes, the upper levels, are merged by Spark: shards give them the sums of their tops, and sums then climb by doubling steps (1, 2, 4 ... levels at a time),
  so that a chain of n heavy nodes takes log n joins of the small heavy table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch, text_or_empty, word_pattern_count

SHARD_TURNS = 50_000
SALTS = 32
#: Ids in a bucket of ends: so many at most are put into one string before the hash.
END_BUCKET = 4096
ROOT = bytes(16)
NONE = hashlib.sha256(b"").hexdigest()
NODE = "node binary, parent binary, depth long, conv long, n_convs long, words long"


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, label, words) of every turn: position from 1, 128 bits of the SHA-256 of role and text, words of the text.

    Turns are ordered by number (null first), then by role and text, null counting as empty.  Rows without conversation are left out.
    """
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text")
    )
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("pos"), F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("label"), word_pattern_count("text").alias("words"))


def grafts(own: DataFrame, base: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, convs): the turns of conversations rebuilt from the first ``taken`` (``most`` at the most) turns of the conversation ``base`` and their own later ones; and every
    conversation (conv, n: a bound of its turns).

    ``base`` and ``taken`` are columns over ``conv``.
    """
    convs = own.groupBy("conv").agg(F.max("pos").alias("own_n")).withColumn("base", base).withColumn("h", taken)
    heads = own.filter(F.col("pos") <= most).select(F.col("conv").alias("base"), "pos", "label", "words")
    grafted = convs.filter("h > 0").select("conv", "base", "h", "own_n").join(heads.filter(F.col("base").isNotNull()), "base").filter("pos <= h")
    mine = own.withColumn("h", taken).filter("pos > h")
    rows = grafted.select("conv", "pos", "label", "words").union(mine.select("conv", "pos", "label", "words"))
    return rows, convs.select("conv", (F.col("own_n") + F.col("h")).alias("n"))


def paths(rows: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, words, last) of every turn of (conv, pos, label, words): one pass in order, whatever a conversation's length."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, depth, name, held = None, 0, ROOT, None
        for b in batches:
            out = []
            for conv, label, words in zip(b["conv"].tolist(), b["label"], b["words"].tolist(), strict=True):
                if held is not None:
                    out.append((*held, conv != at))
                if conv != at:
                    at, depth, name = conv, 0, ROOT
                depth += 1
                parent, name = name, hashlib.sha256(name + label).digest()[:16]
                held = (conv, depth, name, parent, words)
            if out:
                yield pd.DataFrame(out, columns=["conv", "depth", "node", "parent", "words", "last"])
        if held is not None:
            yield pd.DataFrame([(*held, True)], columns=["conv", "depth", "node", "parent", "words", "last"])

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "pos")
    return ordered.mapInPandas(walk, "conv long, depth long, node binary, parent binary, words long, last boolean")


class Louds:
    """A level-order trie of nodes below a super-root, with its bits and the arrays of its labels.

    ``order`` are the rows in level order, ``bits`` a 1 for each child and a 0 at the end, the super-root first; node i (from 1) is the i-th 1.
    """

    def __init__(self, node: list[bytes], parent: list[bytes], depth: np.ndarray, rank: np.ndarray):
        at = {n: i for i, n in enumerate(node)}
        above = np.array([at.get(p, -1) for p in parent], np.int64)
        # tops may be of different depths: a level is the distance from the top
        level = np.zeros(len(node), np.int64)
        by_depth = np.argsort(depth, kind="stable")
        for rows in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
            level[rows] = np.where(above[rows] < 0, 0, level[above[rows]] + 1)
        by_level = np.argsort(level, kind="stable")
        self.levels, self.order, number, done = [], np.empty(len(node), np.int64), np.zeros(len(node), np.int64), 0
        for rows in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
            up = np.where(above[rows] < 0, 0, number[above[rows]])
            rows = rows[np.lexsort((rank[rows], up))]
            here = slice(done + 1, done + 1 + len(rows))
            self.order[done : done + len(rows)], number[rows] = rows, np.arange(here.start, here.stop)
            self.levels.append(here)
            done += len(rows)
        up = np.where(above[self.order] < 0, 0, number[above[self.order]])
        degree = np.bincount(up, minlength=len(node) + 1)
        self.bits = np.ones(len(node) + len(degree), bool)
        self.bits[np.cumsum(degree + 1) - 1] = False
        self.degree = degree[1:]

    def parents(self) -> np.ndarray:
        """Number of the parent of node 1, 2, ...: the zeros before its 1."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def roll_up(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees of a value a node (in level order), the deepest level first."""
        out = np.concatenate([[0], own])
        up = np.concatenate([[0], self.parents()])
        for level in reversed(self.levels[1:]):
            np.add.at(out, up[level], out[level])
        return out[1:]


def _shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    trie = Louds(list(rows["node"]), list(rows["parent"]), rows["depth"].to_numpy(), rows["conv"].to_numpy())
    r = rows.iloc[trie.order]
    conv, up = r["conv"].to_numpy(), trie.parents()
    n, words = r["n_convs"].to_numpy(), r["words"].to_numpy()
    return pd.DataFrame(
        {
            "node": r["node"], "parent": r["parent"], "top": up == 0, "conv_id": conv, "depth": r["depth"],
            "parent_conv_id": np.where(up == 0, r["above"].to_numpy(), conv[np.maximum(up, 1) - 1]),
            "n_convs": n, "n_children": trie.degree, "n_leaves": trie.roll_up((trie.degree == 0).astype(np.int64)), "saved_tokens": trie.roll_up((n - 1) * words),
        }
    )


SHARDED = "node binary, parent binary, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the (node, conv) that end there: ids are put into strings by ranges of ``END_BUCKET`` numbers, which a task hashes one after the other."""
    bucket = F.floor(F.col("conv") / F.lit(END_BUCKET)).alias("bucket")
    listed = members.groupBy("node", bucket).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h = None, None
        for b in batches:
            out = []
            for node, ids in zip(b["node"], b["ids"], strict=True):
                if node != at:
                    if at is not None:
                        out.append((at, h.hexdigest()))
                    at, h = node, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(at, h.hexdigest())], columns=["node", "ends_sha256"])

    return listed.repartition("node").sortWithinPartitions("node", "bucket").select("node", "ids").mapInPandas(digest, "node binary, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of (conv, pos, label, words), for all ``convs`` (conv, n >= its turns), turnless ones too.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256; no rows if there is no conversation.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "trie")
    walked = scratch.save(paths(rows))
    whole = walked.groupBy("conv").agg(F.max("depth").alias("n"))
    turnless = convs.join(whole, "conv", "left_anti").select(F.lit(ROOT).alias("node"), "conv")
    ended = ends(walked.filter("last").select("node", "conv").union(turnless))

    sized = walked.join(whole, "conv").withColumn("below", F.col("n") - F.col("depth") + 1)
    nodes = scratch.save(
        # a node has one parent, depth and last text
        sized.groupBy("node", "parent", "depth", "words").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum("below").alias("turns"))
    )
    heavy = nodes.filter(F.col("turns") > shard_turns)
    members = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    if not members["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    # the first light node on the way of every conversation is the top of its subtree; the last heavy one is above it
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    marks = heavy.select("node", F.col("conv").alias("heavy_conv"), salts.alias("salt"))
    marked = walked.select("conv", "depth", "node", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int").alias("salt")).join(marks, ["node", "salt"], "left")
    light = F.col("heavy_conv").isNull()
    tops = marked.groupBy("conv").agg(F.min(F.when(light, F.struct("depth", "node"))).alias("top"), F.max(F.when(~light, F.struct("depth", "heavy_conv"))).alias("above"))
    tops = tops.select("conv", F.col("top.node").alias("top_node"), F.col("top.depth").alias("top_depth"), F.coalesce("above.heavy_conv", F.lit(members["conv"])).alias("above"))
    total = nodes.count()
    shards = max(1, -(-total // shard_turns))
    placed = nodes.filter(F.col("turns") <= shard_turns).join(tops, "conv").withColumn("shard", F.pmod(F.xxhash64("top_node"), F.lit(shards)))
    done = scratch.save(placed.select("shard", "node", "parent", "depth", "conv", "n_convs", "words", "above").groupBy("shard").applyInPandas(_shard, SHARDED))

    upper = _upper(scratch, heavy, done.filter("top"), members)
    columns = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = done.select(*columns).union(upper.select(*columns))
    return every.join(ended, "node", "left").select(*columns[1:], F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def _upper(scratch: Scratch, heavy: DataFrame, tops: DataFrame, members) -> DataFrame:
    """Heavy nodes and the root with their sums, from the tops of the subtrees below them."""
    spark = heavy.sparkSession
    root = spark.createDataFrame([(ROOT, None, 0, members["conv"], members["n"], 0)], NODE)
    own = heavy.select("node", "parent", "depth", "conv", "n_convs", "words").union(root)
    below = tops.select("parent", "n_leaves", "saved_tokens").union(heavy.select("parent", F.lit(0).cast("long"), F.lit(0).cast("long")))
    below = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    names = own.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    base = own.join(below, "node", "left").join(names, "parent", "left").select(
        "node", "parent", "depth", F.col("conv").alias("conv_id"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved_tokens"),
    )
    base = scratch.save(base)
    deepest = base.agg(F.max("depth")).first()[0]
    sums, step = base.select("node", "n_leaves", "saved_tokens", F.col("parent").alias("up")), 1
    while step <= deepest:
        # what a node has summed so far goes to the node ``step`` above it, and pointers double
        given = sums.filter("up is not null").groupBy("up").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        further = sums.select(F.col("node").alias("up"), F.col("up").alias("next"))
        joined = sums.join(given.withColumnRenamed("up", "node"), "node", "left").join(further, "up", "left")
        new = scratch.save(
            joined.select("node", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.col("next").alias("up"))
        )
        scratch.drop(sums)
        sums, step = new, step * 2
    return base.drop("n_leaves", "saved_tokens").join(sums.select("node", "n_leaves", "saved_tokens"), "node")


def conversation_trie(turns: DataFrame, period: int = 20, modulus: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the conversations c, each rebuilt from the first h = crc32(c) % ``modulus`` turns of conversation ``c - c % period`` (all if fewer, none if absent) and its own turns after
    the first h.

    Null role and text are empty, a null turn comes first, turns of equal number go by role and text and repeated rows are turns of their own; rows without
    conversation are left out, other columns do not matter.  An empty table gives no rows.  ``%`` keeps the sign of c.
    """
    scratch = Scratch(turns.sparkSession, "turns")
    own = scratch.save(numbered_turns(turns, conv_col, turn_col, role_col, text_col))
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(modulus))
    rows, convs = grafts(own, F.col("conv") - F.col("conv") % period, h, modulus - 1)
    return trie(rows, convs, shard_turns)
