"""Removal of repeated passages by distributed prefix doubling.

The rank of the 2m bytes from a position is the pair of the ranks of m bytes there and m bytes on,
so ranks of 1, 2, 4, ... 64 bytes come by doubling.  A rank is named by a 64-bit hash of its pair, which
tasks agree on without exchange; sorting ranks, to see which are unique, is Spark's part:

* Round 1 sorts 32-byte ranks, of a sample of positions that depends on the bytes alone: every
  100-byte string chooses the position in it with the smallest 32-byte rank (its anchor), so equal strings choose alike
  and about 3 positions in 100 do for all.  Anchors with a unique rank are done: no string they stand for repeats.
  Ranks that repeat are paired with the rank of all the bytes that the anchor's strings span: where both repeat,
  all these strings do, and those not first are marked at once.
* Round 2 takes the anchors that are left, at the edges of repeats, in blocks of nine neighbouring strings.  It sorts the
  pairs of 64-byte ranks that make up the 92 bytes which a block's strings have in common; where such a pair repeats, the
  strings are told apart, at 100 bytes past the threshold, by their few other bytes.  Those not first are marked.

Ranks name bytes and are not trusted: every mark has an earlier occurrence, and runs of marks are only removed where the SHA-256 of the
bytes here and there is the same.

A task first settles what repeats within itself and sends one row for a rank, so a passage that a third of
all documents share costs each task one row.  Positions are (document, offset) and never lists of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch
from memlattice.llm.near_dedup import mix64

LENGTH = 100
GRAM = 32
#: 32-byte strings that begin in a 100-byte string.
WIDTH = LENGTH - GRAM + 1
LONG = 64
SHIFT = LENGTH - LONG
#: Bytes worked on at a time, and the positions a task gathers before it settles and sends them.
CHUNK = 1 << 18
FLUSH = 200_000

_U = np.uint64
_FIRST = mix64(np.arange(5001, 5257, dtype=np.uint64))


def _pair(x: np.ndarray, m: int) -> np.ndarray:
    """Ranks of 2m bytes from those of m."""
    y = x[:-m] * _U(0x9E3779B97F4A7C15) + (x[m:] ^ (x[m:] >> _U(31))) * _U(0xC2B2AE3D27D4EB4F)
    y ^= y >> _U(29)
    y *= _U(0xBF58476D1CE4E5B9)
    y ^= y >> _U(32)
    return y


def ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of 32 and of 64 bytes from every position that has as many."""
    x, m = _FIRST[data], 1
    while m < GRAM:
        x, m = _pair(x, m), 2 * m
    return x, _pair(x, m)


def _argmin(x: np.ndarray) -> np.ndarray:
    """For every position, the first smallest of the WIDTH values from there."""
    v, at, m = x, np.arange(len(x), dtype=np.int32), 1
    while 2 * m <= WIDTH:
        left = v[:-m] <= v[m:]
        v, at, m = np.where(left, v[:-m], v[m:]), np.where(left, at[:-m], at[m:]), 2 * m
    rest = WIDTH - m
    left = v[: len(v) - rest] <= v[rest:]
    return np.where(left, at[: len(at) - rest], at[rest:])


def pieces(keys: list, texts: list[bytes], chunk: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of about ``chunk`` bytes, each with (document, offset in it, begin, end) of its parts; the parts of a long
    document overlap so that each of its 100-byte strings is in one part."""
    buffer, parts, size = [], [], 0
    for key, text in zip(keys, texts, strict=True):
        at = 0
        while len(text) - at >= LENGTH:
            part = text[at : at + chunk + LENGTH - 1]
            parts.append((key, at, size, size + len(part)))
            buffer.append(part)
            size += len(part)
            at += chunk
            if size >= chunk:
                yield np.frombuffer(b"".join(buffer), np.uint8), parts
                buffer, parts, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(buffer), np.uint8), parts


def anchors(data: np.ndarray, parts: list) -> tuple[np.ndarray, ...]:
    """For each anchor: index of its part, first and last string that it stands for, its place, ranks of its 32 bytes and of the span."""
    r32, r64 = ranks(data)
    chosen = _argmin(r32)
    n = len(chosen)  # strings of 100 bytes in the buffer
    part = np.zeros(len(data) + 1, np.int32)
    begins = np.array([p[2] for p in parts])
    part[begins[1:]] = 1
    part = np.cumsum(part[:n], dtype=np.int32)
    ends = np.array([p[3] for p in parts])
    whole = np.arange(n) + LENGTH <= ends[part]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1]) | (whole[1:] != whole[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n) - 1
    lo, hi = lo[whole[lo]], hi[whole[lo]]
    span = mix64(r64[lo] ^ mix64(r64[hi + SHIFT])) * _U(0x9FB21C651E98DF25) + mix64(r64[lo + SHIFT] + mix64(r64[hi] ^ (hi - lo).astype(np.uint64)))
    return part[lo], lo, hi, chosen[lo].astype(np.int64), r32[chosen[lo]], mix64(span)


SETTLED, OPEN, ASK, TELL = 1, 2, 0, 3


def settle(rank: np.ndarray, span: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    """What a task knows of its anchors: SETTLED where it has seen the span before, OPEN where it has seen the
    rank with another span; then TELL, a row for others, says so.  All else it has to ASK."""
    order = np.lexsort((pos, doc, span, rank))
    rank, span, doc, pos = rank[order], span[order], doc[order], pos[order]
    n = len(rank)
    same_rank = np.zeros(n, bool)
    same_rank[1:] = rank[1:] == rank[:-1]
    same_span = same_rank.copy()
    same_span[1:] &= span[1:] == span[:-1]
    group = np.cumsum(~same_rank) - 1
    several = np.bincount(group, weights=~same_span) > 1
    state = np.where(same_span, SETTLED, np.where(several[group], OPEN, ASK))
    key = np.where(state == ASK, rank, mix64(doc.astype(np.uint64) ^ mix64(pos.astype(np.uint64))))
    tell = np.flatnonzero(~same_rank & several[group])
    # the first of the same span, which a settled anchor is a copy of
    like = np.where(state == SETTLED, np.maximum.accumulate(np.where(same_span, 0, np.arange(n))), -1)
    none = np.zeros(len(tell), np.int64)
    f = {
        "key": np.concatenate([key, rank[tell]]).view(np.int64),
        "span": np.concatenate([span, span[tell]]).view(np.int64),
        "doc": np.concatenate([doc, doc[tell]]),
        "pos": np.concatenate([pos, pos[tell]]),
        "state": np.concatenate([state, np.full(len(tell), TELL)]).astype(np.int8),
        "like_doc": np.concatenate([np.where(like < 0, 0, doc[like]), none]),
        "like_pos": np.concatenate([np.where(like < 0, 0, pos[like]), none]),
    }
    return pd.DataFrame(f)


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


#: First string of an anchor, places from there to the anchor and to its last string, in one number.
_BITS = 7
_LOW = (1 << _BITS) - 1


def _pack(first, to_anchor, to_last):
    return (first << 2 * _BITS) | (to_anchor << _BITS) | to_last


#: Neighbouring strings of an anchor that are looked at together in round 2, but for one.
REACH = 8
#: Rows that the last step hands on at a time.
SLICE = 1024


def _round_1(slim: DataFrame) -> DataFrame:
    """(doc, pos, open, like_doc, like_pos): strings that are marked, with an earlier occurrence of them, or open."""
    chunk, flush = CHUNK, FLUSH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for data, parts in pieces(b["doc"].tolist(), [_encode(t) for t in b["text"]], chunk):
                part, lo, hi, at, rank, span = anchors(data, parts)
                doc = np.array([p[0] for p in parts], np.int64)[part]
                move = np.array([p[1] - p[2] for p in parts], np.int64)[part]
                held.append((rank, span, doc, _pack(lo + move, at - lo, hi - lo)))
                n += len(lo)
                if n >= flush:
                    yield settle(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield settle(*map(np.concatenate, zip(*held, strict=True)))

    seen = slim.mapInPandas(run, "key long, span long, doc long, pos long, state byte, like_doc long, like_pos long")
    by_rank = Window.partitionBy("key")
    by_span = Window.partitionBy("key", "span").orderBy("doc", "pos")
    first = F.row_number().over(by_span) == 1
    like = [F.when(F.col("state") == SETTLED, F.col(f"like_{c}")).otherwise(F.first(c).over(by_span)).alias(f"like_{c}") for c in ("doc", "pos")]
    told = seen.withColumn("several", (F.max("state").over(by_rank) == TELL) | (F.min("span").over(by_rank) != F.max("span").over(by_rank)))
    told = told.select("doc", "pos", "state", "several", first.alias("first"), *like).filter(F.col("state") != TELL)
    left = told.withColumn("open", (F.col("state") == OPEN) | ((F.col("state") == ASK) & F.col("first") & F.col("several")))
    return left.filter("open or state = 1 or not first").select("doc", "pos", "open", "like_doc", "like_pos")


def blocks(data: np.ndarray, r64: np.ndarray, start: np.ndarray, to_anchor: np.ndarray, to_last: np.ndarray):
    """The strings of open anchors in blocks of REACH + 1, aligned with the anchor: two ranks of the bytes that all strings of a
    full block have, the REACH bytes before these and the REACH bytes after as numbers, begin of the common bytes, and how
    far before it the nearest and the farthest string of the block begin.

    A string is then its block's common bytes with some of the bytes on either side: comparing strings needs the text no more.
    """
    low, high = (to_anchor - to_last) // (REACH + 1), to_anchor // (REACH + 1)
    n = high - low + 1
    i = np.repeat(np.arange(len(start)), n)
    b = low[i] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    near = b * (REACH + 1)  # places from the nearest string of a full block to the anchor
    core = start[i] + to_anchor[i] - near
    k1 = np.maximum(to_anchor[i] - to_last[i] - near, 0)
    k2 = np.minimum(to_anchor[i] - near, REACH)
    x, y = r64[core], r64[core - REACH + SHIFT]
    c1 = mix64(x + mix64(y ^ b.astype(np.uint64)))
    c2 = mix64(mix64(x) ^ (y * _U(0x9FB21C651E98DF25)))
    padded = np.concatenate([np.zeros(REACH, np.uint64), data.astype(np.uint64), np.zeros(REACH, np.uint64)])
    left, right = np.zeros(len(core), np.uint64), np.zeros(len(core), np.uint64)
    for j in range(REACH):
        left |= padded[core - 1 - j + REACH] << _U(8 * j)
        right |= padded[core - REACH + LENGTH + j + REACH] << _U(8 * j)
    return i, c1, c2, left, right, core, k1, k2


def _round_2(opened: DataFrame) -> DataFrame:
    """(doc, start, last, like_doc, like_start): strings of open anchors that are not the first of their rank, and earlier occurrences of them."""
    chunk, flush = CHUNK, FLUSH

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            at = {d: np.sort(np.asarray(x, np.int64)) for d, x in zip(b["doc"], b["at"], strict=True)}
            for data, parts in pieces(b["doc"].tolist(), [_encode(t) for t in b["text"]], chunk):
                _, r64 = ranks(data)
                mine = []
                for doc, off, begin, _ in parts:
                    x = at[doc]
                    first = x >> 2 * _BITS
                    x = x[(first >= off) & (first < off + chunk)]
                    mine.append((x, np.full(len(x), doc), np.full(len(x), begin - off)))
                x, doc, move = map(np.concatenate, zip(*mine, strict=True))
                if not len(x):
                    continue
                i, c1, c2, left, right, core, k1, k2 = blocks(data, r64, (x >> 2 * _BITS) + move, x >> _BITS & _LOW, x & _LOW)
                held.append((c1, c2, left, right, doc[i], (core - move[i]) << 8 | k1 << 4 | k2))
                n += len(i)
                if n >= flush:
                    yield settle_blocks(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield settle_blocks(*map(np.concatenate, zip(*held, strict=True)))

    seen = opened.mapInPandas(run, "c1 long, c2 long, l long, r long, doc long, pos long, again boolean, like_doc long, like_core long")
    many = F.count("*").over(Window.partitionBy("c1", "c2")) > 1
    left = seen.withColumn("many", many).filter("again or many")
    core, near, far = F.shiftright("pos", 8), F.shiftright("pos", 4).bitwiseAND(F.lit(15)), F.col("pos").bitwiseAND(F.lit(15))
    whole = left.filter("again").select("doc", (core - far).alias("start"), (far - near).alias("last"), "like_doc", (F.col("like_core") - far).alias("like_start"))
    masks = F.array(*[F.lit((1 << 8 * k) - 1 if k < 8 else -1).cast("long") for k in range(REACH + 1)])
    each = left.filter("not again").select("c1", "c2", "l", "r", "doc", core.alias("core"), F.explode(F.sequence(near.cast("int"), far.cast("int"))).alias("k"))
    around = F.expr("l").bitwiseAND(masks[F.col("k")]).bitwiseOR(F.call_function("shiftleft", F.expr("r").bitwiseAND(masks[F.lit(REACH) - F.col("k")]), F.col("k") * 8))
    strings = each.select("c1", "c2", "k", around.alias("around"), "doc", (F.col("core") - F.col("k")).alias("at"))
    same = Window.partitionBy("c1", "c2", "k", "around").orderBy("doc", "at")
    alone = strings.select("doc", "at", F.row_number().over(same).alias("rn"), F.first("doc").over(same).alias("like_doc"), F.first("at").over(same).alias("like_start"))
    return whole.union(alone.filter("rn > 1").select("doc", F.col("at").alias("start"), F.lit(0).cast("long").alias("last"), "like_doc", "like_start"))


def settle_blocks(c1, c2, left, right, doc, pos) -> pd.DataFrame:
    """A row for each block; one that equals another of this task before it is known to come again, and goes under a key of its own."""
    order = np.lexsort((pos, doc, pos & 255, right, left, c2, c1))
    c1, c2, left, right, doc, pos = c1[order], c2[order], left[order], right[order], doc[order], pos[order]
    again = np.zeros(len(c1), bool)
    again[1:] = (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (pos[1:] & 255 == pos[:-1] & 255)
    c1 = np.where(again, mix64(doc.astype(np.uint64) ^ mix64(pos.astype(np.uint64))), c1)
    like = np.where(again, np.maximum.accumulate(np.where(again, 0, np.arange(len(c1)))), -1)
    cols = {"c1": c1.view(np.int64), "c2": c2.view(np.int64), "l": left.view(np.int64), "r": right.view(np.int64)}
    likes = {"like_doc": np.where(like < 0, 0, doc[like]), "like_core": np.where(like < 0, 0, pos[like] >> 8)}
    return pd.DataFrame({**cols, "doc": doc, "pos": pos, "again": again, **likes})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the bytes of every range that is asked for."""
    for b in batches:
        rows = []
        for doc, text, asked in zip(b["doc"], b["text"], b["asked"], strict=True):
            data = _encode(text)
            rows.extend((doc, r["start"], r["end"], hashlib.sha256(data[r["start"] : r["end"]]).digest()) for r in asked)
        yield pd.DataFrame(rows, columns=["doc", "start", "end", "digest"])


def _confirmed(marks: DataFrame, slim: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, start, end): what is marked, in runs of marks with the same earlier occurrence, where the bytes there are the same.

    Ranks only name bytes; here both sides are read.  A passage that many documents share is asked for once.
    """
    run = Window.partitionBy("doc", "like_doc", "shift").orderBy("start")
    rows = marks.select("doc", "like_doc", (F.col("like_start") - F.col("start")).alias("shift"), "start", (F.col("start") + F.col("last") + LENGTH).alias("end"))
    rows = rows.withColumn("reach", F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = scratch.save(rows.groupBy("doc", "like_doc", "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run"))
    there = runs.select(F.col("like_doc").alias("doc"), (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"))
    asked = runs.select("doc", "start", "end").union(there).distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("asked"))
    known = scratch.save(slim.select("doc", "text").join(asked, "doc").mapInPandas(_digests, "doc long, start long, end long, digest binary"))
    here = runs.join(known, ["doc", "start", "end"])
    other = known.select(F.col("doc").alias("like_doc"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("digest").alias("like"))
    at = [here["like_doc"] == other["like_doc"], here["start"] + here["shift"] == other["s"], here["end"] + here["shift"] == other["e"]]
    return here.join(other, at).filter("digest = like").select("doc", "start", "end")


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes are in one of the ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for i in range(0, len(whole), SLICE):
            b = whole.iloc[i : i + SLICE]
            rows = []
            for text, spans in zip(b["text"], b["spans"], strict=True):
                data = _encode(text)
                removed = runs = 0
                kept = data
                if spans is not None:
                    cover = covered(len(data), np.array([r["start"] for r in spans]), np.array([r["end"] for r in spans]))
                    removed, runs = int(cover.sum()), int(np.count_nonzero(np.diff(cover, prepend=False) & cover))
                    kept = np.frombuffer(data, np.uint8)[~cover].tobytes()
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], index=b.index)
            yield pd.concat([b[["doc", "id"]], out], axis=1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary, what remains).

    Texts are UTF-8 bytes, null ones empty; a text of fewer than 100 bytes is never touched.  "Earlier" follows the
    id, rows without id last; rows that repeat an id are ordered by their text's SHA-256, and equal ones in
    a fixed order of this run, so that all but one of them are removed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    odd = slim.groupBy("id").count().filter("id is null or count > 1")
    if odd.isEmpty():
        slim = slim.withColumn("doc", F.col("id"))
    else:  # places of the rows in a sort over all, which leaves the numbers of its partitions in order
        sort = slim.orderBy(F.col("id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256))
        slim = scratch.save(sort.withColumn("doc", F.monotonically_increasing_id()))
    found = scratch.save(_round_1(slim.select("doc", "text")))
    at = found.filter("open").groupBy("doc").agg(F.collect_list("pos").alias("at"))
    more = scratch.save(_round_2(slim.select("doc", "text").join(at, "doc")))
    first, last = F.shiftright("pos", 2 * _BITS), F.col("pos").bitwiseAND(F.lit(_LOW))
    marks = found.filter("not open").select("doc", first.alias("start"), last.alias("last"), "like_doc", F.shiftright("like_pos", 2 * _BITS).alias("like_start")).union(more)
    spans = _confirmed(marks, slim, scratch).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = slim.join(spans, "doc", "left")
    out = joined.mapInPandas(_finish, "doc long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
