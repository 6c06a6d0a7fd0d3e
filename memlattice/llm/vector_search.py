"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees under one priority queue a query.

Inner products become distances on a sphere: every vector is divided by the largest norm and gets one more coordinate,
``sqrt(1 - |x|^2)``; a query is scaled to length 1 and gets a 0 there.  The nearest point is then the one of largest inner product.

A tree cuts the space by hyperplanes of random direction at the median of a sample: ``SAMPLE_A_LEAF`` rows a leaf, as many leaves as
the rows need (``LEAF_ROWS`` each), so the sample is bounded by the planes, which travel with tasks and hold ``PLANE_BYTES`` at most.
Beyond that number of leaves these grow with the rows.  *Every* row is in one leaf of every tree.

A query is searched twice.  First in its home leaves, one a tree: the k-th best score there bounds the distance of its k-th
neighbour by r.  Then the nodes of all trees share one priority queue, by the largest margin (distance to a plane) crossed on the way;
leaves are taken until the margin exceeds ``reach * r / sqrt(dimensions)``.  A difference of length r has a spread of
``r / sqrt(dimensions)`` along a random direction, so ``reach`` sets the recall, not the number of rows: crowded regions are cut tightly,
rows without structure are searched widely.

Leaves that follow each other in a tree make up tiles of at most ``BLOCK`` rows; a larger leaf is cut by a hash into several, and
the queries of a tile into blocks.  A task holds one tile and one block, whatever a leaf or a popular query holds.  Candidates are ranked by their exact scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch
from memlattice.llm.embedding_dedup import usable

TREES = 4
LEAF_ROWS = 256
SAMPLE_A_LEAF = 8
PLANE_BYTES = 16 << 20
REACH = 0.9
BLOCK = 16384
QUERY_BLOCK = 4096
#: Queries that are scored or searched at a time.
SLICE = 256
FOUND = "query_id long, tau double, id long, score double"


class Forest:
    """Trees as arrays: planes and offsets; ``child[node]`` holds the two sides, a leaf as -1 - its number.  Leaves are numbered through all trees."""

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int = 17):
        self.rng = np.random.default_rng(seed)
        self.planes, self.offsets, self.child, self.roots, self.n_leaves, self.tree_of = [], [], [], [], 0, []
        for tree in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaves, tree))
        self.planes = np.array(self.planes, np.float32).reshape(-1, sample.shape[1])
        self.offsets, self.child = np.array(self.offsets), np.array(self.child, np.int64).reshape(-1, 2)
        self.tree_of = np.array(self.tree_of)
        del self.rng

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaves: float, tree: int) -> int:
        if leaves > 1 and len(rows) > 1:
            plane = self.rng.normal(size=sample.shape[1]).astype(np.float32)
            plane /= np.linalg.norm(plane)
            along = sample[rows] @ plane.astype(np.float64)
            at = float(np.median(along))
            above = along >= at
            if above.all():  # ties at the median: cut above it
                at = float(np.nextafter(at, np.inf))
                above = along >= at
            if above.any() and not above.all():
                node = len(self.planes)
                self.planes.append(plane)
                self.offsets.append(at)
                self.child.append((0, 0))
                self.child[node] = (self._grow(sample, rows[~above], leaves / 2, tree), self._grow(sample, rows[above], leaves / 2, tree))
                return node
        self.n_leaves += 1
        self.tree_of.append(tree)
        return -self.n_leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.planes.T.astype(np.float64) - self.offsets

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        each = np.arange(len(x))
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while (at := each[node >= 0]).size:
                n = node[at]
                along = np.einsum("ij,ij->i", x[at], self.planes[n].astype(np.float64))
                node[at] = self.child[n, (along >= self.offsets[n]).astype(int)]
            out[:, t] = -1 - node
        return out

    def search(self, margins: np.ndarray, limit: float) -> list[int]:
        """Leaves in order of the largest margin on the way to them, all trees in one queue, up to ``limit``."""
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found, child = [], self.child
        while queue and queue[0][0] <= limit:
            bound, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                heapq.heappush(queue, (max(bound, abs(m)), int(child[node, 0 if m >= 0 else 1])))
                node = int(child[node, 1 if m >= 0 else 0])
            found.append(-1 - node)
        return found


def _stack(blobs, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind).astype(np.float64).reshape(len(blobs), -1)


def _log_norm(x: np.ndarray) -> np.ndarray:
    """Binary logarithm of the norms, which may be out of the range of a double."""
    most = np.abs(x).max(axis=1)
    y = x / most[:, None]
    return np.log2(most) + 0.5 * np.log2((y * y).sum(axis=1))


def on_sphere(x: np.ndarray, top: float | None) -> np.ndarray:
    """Rows divided by the norm 2^top and lifted to the unit sphere; ``top`` None: queries, scaled to length 1 each."""
    own = _log_norm(x)
    most = np.abs(x).max(axis=1)
    y = (x / most[:, None]) * np.exp2(np.log2(most) - (own if top is None else top))[:, None]
    rest = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(1.0 - (y * y).sum(axis=1), 0.0))
    return np.column_stack([y, rest])


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, summed from the first component to the last: equal vectors have equal scores."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            out += x[:, j] * q[j]
    return np.where(np.isnan(out), -np.inf, out)


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, rough: np.ndarray, slack: float, k: int, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of the rows whose rough score (a matrix product's) is not -inf, none below tau."""
    at = np.flatnonzero(rough > -np.inf)
    if len(at) > k:
        at = at[rough[at] >= np.partition(rough[at], len(at) - k)[len(at) - k] - slack]
    at = at[rough[at] >= tau - slack]
    score = inner(x[at], q)
    order = np.lexsort((ids[at], -score))
    order = order[score[order] >= tau][:k]
    return ids[at][order], score[order]


class Tiles:
    """Leaves in their order cut into tiles: several small leaves of one tree, or one large leaf in ``width`` parts."""

    def __init__(self, rows: np.ndarray, tree_of: np.ndarray, block: int):
        self.tile, self.local, starts, size = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), [], 0
        for leaf, n in enumerate(rows):
            if not starts or tree_of[leaf] != tree_of[leaf - 1] or size + n > block:
                starts.append(leaf)
                size = 0
            size += n
            self.tile[leaf], self.local[leaf] = len(starts) - 1, leaf - starts[-1]
        held = np.add.reduceat(rows, starts) if starts else np.zeros(0, np.int64)
        self.width = np.maximum(1, -(-held // block))


def _score(index: DataFrame, asked: DataFrame, tiles: Tiles, kind: str, k: int) -> DataFrame:
    """(query_id, id, score) of the best k of every tile that a query visits: ``index`` (id, x, leaves), ``asked`` (id, x, tau, leaves)."""

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, leaves in enumerate(b["leaves"]):
                leaves = np.asarray(leaves, np.int64)
                tile = tiles.tile[leaves]
                out += [(i, int(t), tiles.local[leaves[tile == t]].astype(np.int32).tobytes()) for t in np.unique(tile)]
            if out:
                at, tile, local = zip(*out, strict=True)
                at = list(at)
                yield pd.DataFrame({"id": b["id"].to_numpy()[at], "x": b["x"].to_numpy()[at], "tau": b["tau"].to_numpy()[at], "tile": tile, "local": local})

    visiting = asked.mapInPandas(visits, "id long, x binary, tau double, tile int, local binary")
    counts = asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()  # a row for each leaf at most
    blocks = np.ones(len(tiles.width), np.int64)
    for c in counts:
        blocks[tiles.tile[c["leaf"]]] = max(blocks[tiles.tile[c["leaf"]]], -(-c["count"] // QUERY_BLOCK))
    width = tiles.width

    def deal_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = b["leaf"].to_numpy()
            tile = tiles.tile[leaf]
            times = blocks[tile]
            at = np.repeat(np.arange(len(b)), times)
            block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            part = b["h"].to_numpy()[at] % width[tile[at]]
            yield pd.DataFrame({"tile": tile[at], "part": part, "block": block, "id": b["id"].to_numpy()[at], "x": b["x"].to_numpy()[at], "local": tiles.local[leaf[at]]})

    def deal_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tile = b["tile"].to_numpy()
            times = width[tile]
            at = np.repeat(np.arange(len(b)), times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            got = {c: b[c].to_numpy()[at] for c in ("tile", "id", "x", "tau", "local")}
            yield pd.DataFrame(got | {"part": part, "block": b["h"].to_numpy()[at] % blocks[tile[at]]})

    h = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)).alias("h")
    place = "tile int, part long, block long"
    rows = index.select("id", "x", h, F.explode("leaves").alias("leaf")).mapInPandas(deal_rows, f"{place}, id long, x binary, local int")
    queries = visiting.select("*", h).mapInPandas(deal_queries, f"{place}, id long, x binary, tau double, local binary")

    def compare(key: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "tau": [], "id": [], "score": []})
        if not len(r) or not len(q):
            return none
        ids, x, local = r["id"].to_numpy(), _stack(r["x"], kind), r["local"].to_numpy()
        y, asks = _stack(q["x"], kind), q["id"].to_numpy()
        n_local = int(local.max()) + 1
        longest = np.sqrt((x * x).sum(axis=1)).max()
        out = []
        for i in range(0, len(y), SLICE):
            with np.errstate(over="ignore", invalid="ignore"):
                rough = y[i : i + SLICE] @ x.T
            rough = np.nan_to_num(rough, nan=-np.finfo(float).max, posinf=np.inf, neginf=-np.finfo(float).max)
            for j in range(len(rough)):
                seen = np.zeros(n_local, bool)
                mine = np.frombuffer(q["local"].iloc[i + j], np.int32)
                seen[mine[mine < n_local]] = True
                own = np.where(seen[local] & (ids != asks[i + j]), rough[j], -np.inf)
                slack = 4e-16 * x.shape[1] * longest * float(np.sqrt((y[i + j] * y[i + j]).sum()))
                got, score = best(x, ids, y[i + j], own, slack if np.isfinite(slack) else np.inf, k, q["tau"].iloc[i + j])
                out.append(pd.DataFrame({"query_id": asks[i + j], "tau": q["tau"].iloc[i + j], "id": got, "score": score}))
        return pd.concat(out) if out else none

    on = ["tile", "part", "block"]
    return rows.groupBy(*on).cogroup(queries.groupBy(*on)).applyInPandas(compare, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; what several trees found counts once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    once = found.repartition(F.col("query_id")).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, trees: int = TREES, reach: float = REACH, leaf_rows: int = LEAF_ROWS, block: int = BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for every row that ``is_query``, best first, ties to the smaller id.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without id, take no part.  Vectors of different
    length do not meet.  Of rows that repeat an id the smallest vector (by its bytes) takes part.  Scores are sums of products in double precision, in the
    order of the components; one that is not a number (an overflow to both sides) counts as -infinity.  Other columns do not matter.

    Of more than k + 1 equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so the others are not indexed.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "search")
    wide = dict(df.dtypes)[vec_col] != "array<float>"
    kind = "float64" if wide else "float32"
    rows = df.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("x")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blobs = [np.asarray(x, dtype=kind) for x in b["x"]]
            norm = [float(_log_norm(x.astype(np.float64)[None, :])[0]) for x in blobs]
            yield pd.DataFrame({"id": b["id"], "q": b["q"], "dim": [len(x) for x in blobs], "norm": norm, "x": [(x + 0.0).astype(kind).tobytes() for x in blobs]})

    packed = scratch.save(rows.mapInPandas(pack, "id long, q boolean, dim int, norm double, x binary"))
    if not packed.groupBy("id").count().filter("count > 1").isEmpty():
        packed = scratch.save(packed.groupBy("id").agg(F.min(F.struct("x", "q", "dim", "norm")).alias("r")).select("id", "r.q", "r.dim", "r.norm", "r.x"))
    indexed = packed
    crowded = packed.groupBy(F.md5("x").alias("m")).count().filter(F.col("count") > k + 1).select("m")
    if not crowded.isEmpty():
        marked = packed.withColumn("m", F.md5("x"))
        few = marked.join(crowded, "m", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
        for by in (["x", "salt"], ["x"]):
            few = few.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("n") <= k + 1)
        indexed = scratch.save(marked.join(crowded, "m", "left_anti").select(*packed.columns).union(few.select(*packed.columns)))
    found = None
    for s in packed.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy("dim").collect():
        mine = F.col("dim") == s["dim"]
        got = _search(scratch, packed.filter(mine & F.col("q")), indexed.filter(mine), s["n"], s["dim"], s["top"], kind, k, trees, reach, leaf_rows, block)
        found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _search(scratch: Scratch, asking: DataFrame, rows: DataFrame, n: int, dim: int, top: float, kind: str, k: int, trees: int, reach: float, leaf_rows: int, block: int) -> DataFrame:
    leaves = max(1, min(math.ceil(n / leaf_rows), PLANE_BYTES // (4 * trees * (dim + 1))))
    share = min(1.0, leaves * SAMPLE_A_LEAF / n)
    fit = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").collect()
    sample = on_sphere(_stack([bytes(x["x"]) for x in fit], kind), top) if fit else np.zeros((0, dim + 1))
    forest = Forest(sample, trees, leaves)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "x": b["x"], "leaves": list(forest.homes(on_sphere(_stack(b["x"], kind), top)))})

    index = scratch.save(rows.select("id", "x").mapInPandas(route, "id long, x binary, leaves array<long>"))
    held = np.zeros(forest.n_leaves, np.int64)
    for c in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # a row for each leaf at most
        held[c["leaf"]] = c["count"]
    tiles = Tiles(held, forest.tree_of, block)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "x": b["x"], "tau": -np.inf, "leaves": list(forest.homes(on_sphere(_stack(b["x"], kind), None)))})

    asked = "id long, x binary, tau double, leaves array<long>"
    near = _first(_score(index, asking.select("id", "x").mapInPandas(home, asked), tiles, kind, k), k)
    bound = scratch.save(near.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("tau")).filter(F.col("n") >= k))

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), SLICE):
                b = whole.iloc[i : i + SLICE]
                x = _stack(b["x"], kind)
                tau = b["tau"].fillna(-np.inf).to_numpy()
                with np.errstate(all="ignore"):
                    cos = np.sign(tau) * np.exp2(np.log2(np.abs(tau)) - _log_norm(x) - top)
                limit = np.where(np.isfinite(tau), reach * np.sqrt(np.maximum(2.0 - 2.0 * np.nan_to_num(cos), 0.0) / dim), np.inf)
                margins = forest.margins(on_sphere(x, None))
                yield pd.DataFrame({"id": b["id"], "x": b["x"], "tau": tau, "leaves": [forest.search(m, lim) for m, lim in zip(margins, limit, strict=True)]})

    wider = scratch.save(asking.select("id", "x").join(bound.select("id", "tau"), "id", "left").mapInPandas(widen, asked))
    return scratch.save(_first(_score(index, wider, tiles, kind, k), k))
