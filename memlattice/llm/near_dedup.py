"""MinHash near-dedup as a signature-coordinate inverted join.

* A document's set of word shingles gives COORDINATES minima; (coordinate, value) is posted as
  one token.  Documents with the same set are one class from here on.
* Two sets with Jaccard J agree in each coordinate with probability J, so with J at the link's similarity or more in fewer than
  ``matches`` of 64 with a probability of MISSED at most (0.85: 36 matches, 7.5e-9).  Pairs below that count are not looked at.
* Prefix: tokens are ordered rarest first.  Classes that agree in ``matches`` tokens share
  one among their first COORDINATES - matches + 1, so only those are joined.  Tokens that one class alone has come first and need no
  posting; a class with fewer than ``matches`` shared tokens has no partner and is gone.
* Skip: for the pairs found, the rest of the lists is not merged; their collisions are counted on the two token lists.
* Pairs that pass are confirmed on the full sets.

Only connected components are wanted, so members of one posting list are first compared with its hub, the
class that shares most tokens with others.  Members that are then still in different components are all
compared with each other, by an exact prefix join on their full sets: a large group of near
copies costs a row a member, and no link is lost.

A token is heavy if it has more than a HEAVY-th of the shared postings, so there are at most HEAVY such tokens: what a join
by token needs of them travels to the postings, which stay where they are, and only the others are shuffled by token.
Pairs of members of one list are made in tiles of about TILE by TILE members, a task's share being tiles, not lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch
from memlattice.llm.components import connected_components

WORDS = 5
COORDINATES = 64
#: Jaccard of a link, and the probability at most with which a pair just there is missed.
SIMILARITY, MISSED = 0.85, 1e-8
#: Bytes of text that are hashed at a time, and documents whose sets a task holds before it hands them on.
CHUNK = 1 << 18
SLICE = 512
#: Heavy tokens at most, and the postings up to which a token is never one.
HEAVY, LIGHT = 100_000, 1_000
#: Members of a list on either side of a tile.
TILE = 1_000

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Link(NamedTuple):
    """What links two sets: coordinates that agree, and a Jaccard as a fraction of whole numbers."""

    matches: int
    above: int
    below: int


def link_at(similarity: float) -> Link:
    """A link of this Jaccard, with as many matches as MISSED allows."""
    j = Fraction(str(similarity))
    if not 0 < j <= 1:
        raise ValueError(f"similarity {similarity} is not in (0, 1]")
    below, matches = Fraction(0), 0
    while matches < COORDINATES:
        below += comb(COORDINATES, matches) * j**matches * (1 - j) ** (COORDINATES - matches)
        if below > MISSED:
            break
        matches += 1
    return Link(max(matches, 1), j.numerator, j.denominator)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_ODD = mix64(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64)) | _U(1)
_PLACE = mix64(np.arange(2001, 2001 + WORDS, dtype=np.uint64)) | _U(1)
_COORD = mix64(np.arange(3001, 3001 + COORDINATES, dtype=np.uint64))
_POWERS = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    """0x9E3779B97F4A7C15 to the powers 0 .. n - 1, modulo 2^64."""
    global _POWERS
    while len(_POWERS) < n:
        m = len(_POWERS)
        base = pow(0x9E3779B97F4A7C15, m, 1 << 64)
        _POWERS = np.concatenate([_POWERS, _POWERS * _U(base)])
    if _POWERS[1] == 1:
        p = [1]
        for _ in range(len(_POWERS) - 1):
            p.append(p[-1] * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        _POWERS = np.array(p, dtype=np.uint64)
    return _POWERS[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a buffer, lower-cased by ASCII."""
    b = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start = edge[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    length = np.append(edge, len(b))[1 : 2 * len(start) : 2] - start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    offset = np.arange(len(at)) - np.repeat(first, length)
    terms = _BYTE[b[at]] * _powers(int(length.max()))[offset]
    return start, mix64(np.add.reduceat(terms, first) ^ mix64(length.astype(np.uint64)))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: of every WORDS words, or of all of a shorter text."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        parts, size = [], 0
        while i < len(texts) and (not parts or size < CHUNK):
            parts.append((texts[i] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            i += 1
        start, h = word_hashes(b" ".join(parts))
        begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        cut = np.searchsorted(start, begin)
        n = len(h)
        if n >= WORDS:
            s = h[: n - WORDS + 1] * _PLACE[0]
            for k in range(1, WORDS):
                s = s + h[k : n - WORDS + 1 + k] * _PLACE[k]
            s = mix64(s)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a >= WORDS:
                out.append(np.unique(s[a : b - WORDS + 1]))
            elif b > a:
                short = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True)
                out.append(mix64(short ^ mix64(np.array([b - a], np.uint64))))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The posted tokens: each coordinate's minimum, marked with the coordinate."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[None, i : i + 2048] * _ODD[:, None]).min(1))
    return (mix64(low) ^ _COORD).view(np.int64)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), SLICE):
            yield b.iloc[i : i + SLICE]


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of sets, in two halves."""
    halves = ([mix64(s).sum(dtype=np.uint64) for s in sets], [mix64(s ^ _COORD[0]).sum(dtype=np.uint64) for s in sets])
    return tuple(np.array(x, np.uint64).view(np.int64) for x in halves)


def _sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            sets = shingle_sets(list(b["t"]))
            f1, f2 = _names(sets)
            yield pd.DataFrame({"id": b["id"], "n": [len(s) for s in sets], "f1": f1, "f2": f2, "sig": [signature(s) if len(s) else None for s in sets]})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return slim.mapInPandas(run, "id long, n long, f1 long, f2 long, sig array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted classes (node, id, f1, f2), from one of the documents with that id and set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            sets = shingle_sets(list(b["t"]))
            f1, f2 = _names(sets)
            yield pd.DataFrame({"id": b["id"], "f1": f1, "f2": f2, "shingles": [s.view(np.int64) for s in sets]})

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    found = slim.join(wanted.select("id").distinct(), "id", "left_semi").mapInPandas(run, "id long, f1 long, f2 long, shingles array<long>")
    return found.dropDuplicates(["id", "f1", "f2"]).join(wanted, ["id", "f1", "f2"]).select("node", "shingles")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n, node, least_id) of the documents that have an id and a set, node being its class; (id, n) of the others;
    and (node, component) of the classes that are linked with others, by the smallest id of all that are."""
    spark, link = docs.sparkSession, link_at(similarity)
    scratch = Scratch(spark, "near")
    signed = scratch.save(_sign(docs, id_col, text_col))
    usable = signed.filter("n > 0 and id is not null")
    classes = usable.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    # a class has a number of its own: documents that repeat an id may have different sets
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()))
    posts = classes.select("node", F.explode("sig").alias("tok"))
    shared, bound = _shared(posts, scratch)
    by_node = Window.partitionBy("node")
    ranked = shared.withColumn("own", F.count("*").over(by_node)).filter(F.col("own") >= link.matches)
    ranked = ranked.withColumn("rn", F.row_number().over(by_node.orderBy("freq", "tok")))
    # lists of the shared tokens; the first own - matches + 1 are what is left of the prefix
    lists = ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rn", "tok", "freq"))).alias("x"), F.sum("freq").alias("score"))
    lists = scratch.save(lists.select("node", F.col("x.tok").alias("toks"), F.col("x.freq").alias("freqs"), "score").join(classes.select("node", "n"), "node"))
    first = F.slice(F.arrays_zip("toks", "freqs"), F.lit(1), F.size("toks") - link.matches + 1)
    prefix = lists.select("node", "n", "score", F.explode(first).alias("p"))
    prefix = prefix.select("node", "n", "score", F.col("p.toks").alias("tok"), F.col("p.freqs").alias("freq"))
    # the hub of a list is the class that shares most with others
    lead = F.max_by(F.struct("node", "n"), F.struct("score", F.negate("node"))).alias("lead")
    hubs = prefix.groupBy("tok").agg(F.max("freq").alias("freq"), F.count("*").alias("k"), lead).filter("k > 1").drop("k")
    posted = scratch.save(_by_token(prefix, hubs, bound).select("node", "n", "tok", "freq", "lead"))
    star = posted.filter("node != lead.node").filter(_close(F.col("n"), F.col("lead.n"), link))
    star = star.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    wanted = classes.select("node", "id", "f1", "f2").join(posted.select("node").distinct(), "node", "left_semi")
    sets = scratch.save(_sets(docs, wanted, id_col, text_col))
    links = scratch.save(_confirm(star, lists, sets, link))
    roots = scratch.save(connected_components(links))
    labelled = posted.select("node", "tok", "freq").join(roots, "node", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "node"))
    apart = scratch.save(_apart(labelled, bound, sets, link, scratch).join(star, ["a", "b"], "left_anti"))
    more = scratch.save(_confirm(apart, lists, sets, link))
    if not more.isEmpty():
        roots = scratch.save(connected_components(links.union(more)))
    least = roots.join(classes.select("node", "id"), "node")
    least = roots.join(least.groupBy("root").agg(F.min("id").alias("component")), "root").select("node", "component")
    named = classes.select("f1", "f2", "n", "node", F.col("id").alias("least_id"))
    member = usable.join(named, ["f1", "f2", "n"]).select("id", "n", "node", "least_id")
    return member, signed.filter("not (n > 0 and id is not null)").select("id", "n"), least


def _close(a, b, link: Link):
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * link.below >= F.greatest(a, b) * link.above


def _shared(posts: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The postings of tokens that several nodes have, with their number ``freq``; and the number beyond which a token is heavy."""
    common = scratch.save(posts.groupBy("tok").agg(F.count("*").alias("freq")).filter("freq > 1"))
    bound = max(LIGHT, (common.agg(F.sum("freq")).first()[0] or 0) // HEAVY)
    heavy = F.broadcast(common.filter(F.col("freq") > bound))
    light = posts.join(heavy.select("tok"), "tok", "left_anti").join(common.filter(F.col("freq") <= bound), "tok")
    return light.unionByName(posts.join(heavy, "tok")), bound


def _by_token(posts: DataFrame, tokens: DataFrame, bound: int, how: str = "inner") -> DataFrame:
    """Postings joined with a row a token; both sides have its ``freq``.  At most HEAVY rows travel."""
    light, heavy = F.col("freq") <= bound, F.col("freq") > bound
    found = posts.filter(light).join(tokens.filter(light).drop("freq"), "tok", how)
    return found.unionByName(posts.filter(heavy).join(F.broadcast(tokens.filter(heavy).drop("freq")), "tok", how))


def _apart(labelled: DataFrame, bound: int, sets: DataFrame, link: Link, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) in different components that share a posting list and may be linked: all those that are.

    Sets with Jaccard j or more share one of their |a| - o + 1 and |b| - o + 1 rarest shingles, o being the overlap that j
    asks of their sizes.  What an edited copy has in common with its many relatives are frequent shingles, so copies
    that are too far from each other do not even meet here.
    """
    mixed = labelled.groupBy("tok").agg(F.max("freq").alias("freq"), F.min("root").alias("r"), F.max("root").alias("s")).filter("r != s").select("tok", "freq")
    members = _by_token(labelled, mixed, bound, "left_semi").select("node", "root").distinct()
    held = scratch.save(sets.join(members, "node"))
    posts = held.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("tok"))
    shared, bound = _shared(posts, scratch)
    by_node = Window.partitionBy("node")
    ranked = shared.withColumn("own", F.count("*").over(by_node)).withColumn("rn", F.row_number().over(by_node.orderBy("freq", "tok")))
    # place in the rarest-first order: shingles that the set has alone come before the shared ones
    ranked = ranked.withColumn("at", F.col("n") - F.col("own") + F.col("rn") - 1).filter(F.col("at") * link.below <= F.col("n") * (link.below - link.above))
    per_root = ranked.groupBy("tok", "root").agg(F.max("freq").alias("freq"), F.count("*").alias("m"))
    main = per_root.groupBy("tok").agg(F.max("freq").alias("freq"), F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main"), *_tiles("m"))
    main = main.filter("roots > 1").drop("roots")
    rest = _by_token(ranked, main, bound).withColumn("in_main", F.col("root") == F.col("main"))
    x = rest.filter("not in_main").select("tok", _own("rows").alias("i"), _every("columns").alias("j"), *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "at", "root")])
    y = rest.select("tok", _every("rows").alias("i"), _own("columns").alias("j"), "in_main", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "at", "root")])
    overlap = F.ceil((F.col("n_x") + F.col("n_y")) * F.lit(link.above) / F.lit(link.above + link.below))
    pair = (
        (F.col("root_x") != F.col("root_y"))
        & (F.col("in_main") | (F.col("node_x") < F.col("node_y")))
        & _close(F.col("n_x"), F.col("n_y"), link)
        & (F.col("at_x") + overlap <= F.col("n_x"))
        & (F.col("at_y") + overlap <= F.col("n_y"))
    )
    return x.join(y, ["tok", "i", "j"]).filter(pair).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _tiles(m: str) -> list[Column]:
    """Rows and columns of tiles of a list with ``m`` members a root: rows are of members outside the largest root, columns of all."""
    return [F.ceil(k / TILE).cast("int").alias(name) for k, name in ((F.sum(m) - F.max(m), "rows"), (F.sum(m), "columns"))]


def _own(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _confirm(pairs: DataFrame, lists: DataFrame, sets: DataFrame, link: Link) -> DataFrame:
    """The pairs whose token lists collide often enough and whose full sets are similar enough."""
    la = lists.select(F.col("node").alias("a"), F.col("toks").alias("ta"))
    lb = lists.select(F.col("node").alias("b"), F.col("toks").alias("tb"))
    matched = pairs.join(la, "a").join(lb, "b").filter(F.size(F.array_intersect("ta", "tb")) >= link.matches).select("a", "b")
    sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = matched.join(sa, "a").join(sb, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return both.filter(F.col("both") * link.below >= (F.col("na") + F.col("nb") - F.col("both")) * link.above).select("a", "b")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: its id, n_shingles, component_id and kept; sets of this Jaccard or more are linked.

    A null text, or one without words, has the empty set and links with nothing.  A text of fewer than five words
    has one shingle.  Rows without id link with nothing (component_id null, kept false).  Rows that repeat an id are each linked
    by their own text, so such an id may be in several components.  Ties cannot arise: components have one smallest id.
    """
    member, other, linked = near_components(docs, id_col, text_col, similarity)
    # rows without a set are kept out of the joins, where they would all have one key
    found = member.join(linked, "node", "left").select("id", "n", F.coalesce("component", "least_id").alias("component"))
    found = found.union(other.select("id", "n", F.col("id").alias("component")))
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(False)).alias("kept"),
    )
