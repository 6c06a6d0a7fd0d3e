"""Embedding near-dedup: an exact metric range join on the unit sphere.

Two unit vectors have cosine >= c exactly if their distance is at most r = sqrt(2 - 2c).  Pivots,
a bounded sample of the vectors, cut the space into cells (a vector's home is the cell of its
nearest pivot).  A vector y can have partners in cell i only if

* d(y, p_i) - R_i <= r (triangle inequality; R_i is the radius of cell i), and
* (d(y, p_i)^2 - d(y, p_home)^2) / (2 d(p_i, p_home)) <= r (distance to the border between the cells),

so it is copied to those cells only.  Pivots grow with the vectors, one for ROWS_PER_PIVOT of them, so cells are small and their bounds
tight.  Neighbouring small cells make up a tile of at most BLOCK rows, a larger cell is cut by a hash of the id into several: a vector goes to a
tile once, if it reaches one of its cells, and so to as many as there are BLOCKs at most.  The two tiles of every pair that may hold partners meet in a
task of their own, which compares them by a matrix product in double precision.  Memory is bounded by two tiles, whatever a
cell holds, and by the MAX_PIVOTS pivots and their distances.  A task returns sums: partners of each vector, and a spanning forest of its
links, so a dense cluster of n vectors gives n rows and not n^2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlattice.llm.common import Scratch
from memlattice.llm.components import connected_components

THRESHOLD = 0.9
BLOCK = 4096
ROWS_PER_PIVOT = 64
#: Pivots travel with the tasks, as do the distances between them: 8 MB for so many.
MAX_PIVOTS = 1024
SLACK = 1e-6
#: Rows that are routed at a time.
SLICE = 1024


def usable(vec: str):
    """Neither null nor empty nor zero, all components there and finite."""
    x = F.col(vec)
    return (
        x.isNotNull()
        & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists(x, lambda v: v != 0)
    )


def _unit(blobs, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype=kind).astype(np.float64).reshape(len(blobs), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _chords(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))


class Tiles:
    """Cells in an order in which neighbours follow each other, cut into groups: several small cells in a tile, or one cell in several tiles."""

    def __init__(self, rows: np.ndarray, between: np.ndarray, block: int):
        left, self.order = np.ones(len(rows), bool), [0]
        left[0] = False
        while left.any():
            nearest = np.where(left, between[self.order[-1]], np.inf).argmin()
            left[nearest] = False
            self.order.append(int(nearest))
        starts, width, size = [], [], block + 1
        self.group = np.zeros(len(rows), np.int64)
        for place, cell in enumerate(self.order):
            if size + rows[cell] > block:
                starts.append(place)
                width.append(max(1, -(-int(rows[cell]) // block)))
                size = 0
            size += int(rows[cell])
            self.group[cell] = len(starts) - 1
        self.starts, self.width = np.array(starts), np.array(width)
        self.first = np.concatenate([[0], np.cumsum(self.width)])

    def own(self, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
        group = self.group[cell]
        return self.first[group] + h % self.width[group]

    def reached(self, near: np.ndarray) -> list[np.ndarray]:
        """For each row the tiles of the cells that it is near."""
        row, group = np.nonzero(np.logical_or.reduceat(near[:, self.order], self.starts, axis=1))
        width = self.width[group]
        tile = np.repeat(self.first[group], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        return np.split(tile, np.cumsum(np.bincount(row, weights=width, minlength=len(near)).astype(np.int64))[:-1])


def near_cells(d: np.ndarray, cell: np.ndarray, between: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Which cells may hold partners of the vectors, from their distances to the pivots: both bounds, and a vector's own cell."""
    each = np.arange(len(d))
    mine = d[each, cell][:, None]
    gap = between[cell]
    with np.errstate(divide="ignore", invalid="ignore"):
        border = np.where(gap > 1e-9, (d * d - mine * mine) / (2 * gap), -np.inf)
    near = (d - radius[None, :] <= r) & (border <= r)
    near[each, cell] = True
    return near


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links (rows by columns) connect, at most one a node."""
    rows, cols = np.nonzero(links.any(1))[0], np.nonzero(links.any(0))[0]
    m = links[np.ix_(rows, cols)]
    a, b = left[rows], right[cols]
    top = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        na = np.minimum(la, np.where(m, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(m, na[:, None], top).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    u, v = np.concatenate([a, b]), np.concatenate([la, lb])
    keep = u != v
    return u[keep], v[keep]


def embedding_links(df: DataFrame, id_col: str, vec_col: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) of the vectors that have links, and edges (a, b) that connect what links connect."""
    spark = df.sparkSession
    scratch = Scratch(spark, "embed")
    wide = dict(df.dtypes)[vec_col] != "array<float>"
    kind = "float64" if wide else "float32"
    rows = df.filter(usable(vec_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>" if wide else "array<float>").alias("x")
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "dim": [len(x) for x in b["x"]], "x": [np.asarray(x, dtype=kind).tobytes() for x in b["x"]]})

    packed = scratch.save(rows.mapInPandas(pack, "id long, dim int, x binary"))
    r = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + SLACK
    counts, edges = None, None
    for dim, n in sorted((x["dim"], x["count"]) for x in packed.groupBy("dim").count().collect()):
        part = packed.filter(F.col("dim") == dim)
        got = _links_of_dim(scratch, part, n, kind, threshold, r)
        c, e = got.filter("b is null").select("a", "n"), got.filter("b is not null").select("a", "b")
        counts, edges = (c, e) if counts is None else (counts.union(c), edges.union(e))
    if counts is None:
        counts, edges = spark.createDataFrame([], "a long, n long"), spark.createDataFrame([], "a long, b long")
    return counts.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links")), edges


def _links_of_dim(scratch: Scratch, part: DataFrame, n: int, kind: str, threshold: float, r: float) -> DataFrame:
    n_pivots = max(1, min(MAX_PIVOTS, -(-n // ROWS_PER_PIVOT)))
    chosen = part.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    pivots = _unit([bytes(x["x"]) for x in chosen], kind)
    between = _chords(pivots, pivots)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _chords(_unit(list(b["x"]), kind), pivots) if len(b) else np.zeros((0, n_pivots))
            cell = d.argmin(1)
            yield pd.DataFrame({"cell": cell, "d": d[np.arange(len(b)), cell]})

    stats = part.select("x").mapInPandas(home, "cell int, d double").groupBy("cell").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect()
    radius, rows = np.full(n_pivots, -np.inf), np.zeros(n_pivots, np.int64)
    for s in stats:  # one row for each pivot at most
        radius[s["cell"]], rows[s["cell"]] = s["r"], s["n"]
    tiles = Tiles(rows, between, BLOCK)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), SLICE):
                b = whole.iloc[i : i + SLICE]
                d = _chords(_unit(list(b["x"]), kind), pivots)
                cell = d.argmin(1)
                near = near_cells(d, cell, between, radius, r)
                yield pd.DataFrame({"id": b["id"], "x": b["x"], "tile": tiles.own(cell, b["h"].to_numpy()), "to": tiles.reached(near)})

    with_hash = part.select("id", "x", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)).alias("h"))
    routed = with_hash.mapInPandas(route, "id long, x binary, tile long, to array<long>").select("id", "x", "tile", F.explode("to").alias("to"))
    met = routed.select("id", "x", "tile", F.least("tile", "to").alias("p"), F.greatest("tile", "to").alias("q"))

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p, q = key
        tile = g["tile"].to_numpy()
        ids, x = g["id"].to_numpy(), _unit(list(g["x"]), kind)
        at, bt = tile == p, tile == q
        if not at.any() or not bt.any():
            return pd.DataFrame({"a": [], "b": [], "n": []})
        ia, ib = ids[at], ids[bt]
        links = (x[at] @ x[bt].T) >= threshold
        links &= ia[:, None] != ib[None, :]
        if not links.any():
            return pd.DataFrame({"a": [], "b": [], "n": []})
        na, nb = links.sum(1), links.sum(0)
        i = ia if p == q else np.concatenate([ia, ib])
        c = na if p == q else np.concatenate([na, nb])
        u, v = _forest(links, ia, ib)
        return pd.DataFrame(
            {"a": np.concatenate([i[c > 0], u]), "b": pd.array([None] * int((c > 0).sum()) + v.tolist(), dtype="Int64"), "n": np.concatenate([c[c > 0], np.zeros(len(u), np.int64)])}
        )

    return scratch.save(met.groupBy("p", "q").applyInPandas(compare, "a long, b long, n long"))


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Adds n_links, component_id and kept to every row of ``df``.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without id, link with
    nothing, as do vectors of different length.  Rows that repeat an id do not link with each other; their links are
    counted together.  Columns with the names added here are replaced.
    """
    counts, edges = embedding_links(df, id_col, vec_col, threshold)
    roots = connected_components(edges)
    rows = df.drop("n_links", "component_id", "kept")
    key = F.col(id_col).cast("long")
    counts, roots = counts.select(F.col("id").alias("__c"), F.col("n_links").alias("__n")), roots.select(F.col("node").alias("__v"), F.col("root").alias("__r"))
    out = rows.join(counts, key == F.col("__c"), "left").join(roots, key == F.col("__v"), "left")
    component = F.coalesce("__r", key)
    return out.select(
        *[F.col(c) for c in rows.columns],
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == key, F.lit(False)).alias("kept"),
    )
