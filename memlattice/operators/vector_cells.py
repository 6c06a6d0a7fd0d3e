"""Vectors stored by cell, so that a search for the highest cosines reads the cells that can hold them and no others.

Centres come from k-means (cosine) on a sample; every vector is in the cell of its nearest centre, and a cell knows its widest angle.  A search takes
the k-th best score of the cells around the query, then reads every cell whose angle to the query, less its width, still allows that score.  The
result is that of a full scan; how much is read depends on the data: clustered vectors are found in few cells, those without structure in most.
Vectors that are null or hold null or non-finite components are in no cell.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.functions import scoring
from memlattice.operators.retrieval import vector_top_k

#: Cells at most (their centres are on the driver and travel with tasks), sampled vectors a cell, and rows that are compared with all centres at once.
MOST_CELLS, SAMPLED, ROWS = 1024, 64, 4096
#: Cell of zero vectors and those of another dimension; every search reads it.
ODD = -1
#: Allowance for rounding of angles.
SLACK = 1e-6


def _finite(v: Column) -> Column:
    """Whether the vector has a length that is a number."""
    return F.coalesce(~F.exists(v, lambda x: x.isNull()) & (scoring.dot(v, v) < math.inf), F.lit(False))


def _regular(v: Column, dim: int) -> Column:
    return (F.size(v) == dim) & (scoring.dot(v, v) > 0)


def _nearest(centres: list[list[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, vector) with the cell of the nearest centre, the first of equals, and the angle to it: a product of matrices a batch."""

    def unit(x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        points = np.array(centres, dtype=float)
        dim, points = points.shape[1], unit(points).T
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                fits = np.flatnonzero(pc.list_value_length(b["vector"]).to_numpy(zero_copy_only=False) == dim)
                x = pc.list_flatten(b["vector"].take(pa.array(fits))).to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.einsum("ij,ij->i", x, x) > 0
                cosine = np.clip(unit(x[good]) @ points, -1.0, 1.0)
                best = cosine.argmax(axis=1)
                cell, angle = np.full(b.num_rows, ODD, dtype=np.int32), np.zeros(b.num_rows)
                cell[fits[good]], angle[fits[good]] = best, np.arccos(cosine[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([b["id"], b["vector"], pa.array(cell), pa.array(angle)], ["id", "vector", "cell", "angle"])

    return place


def _between(a: list[float], b: list[float]) -> float:
    size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b)) / size)))


class VectorCells:
    """An index in a folder of its own; building one anew leaves this one as it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str, vec_col: str, folder: str, cells: int | None = None) -> VectorCells:
        """Of (id, vector) rows; the dimension is that of most rows.  About sqrt(n) cells unless told, MOST_CELLS at most."""
        spark, path = vectors.sparkSession, f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector")).filter(_finite(F.col("vector")))
        sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim, n = (sizes["dim"], sizes["count"]) if sizes else (0, 0)
        cells = max(1, min(MOST_CELLS, cells or round(math.sqrt(n))))
        good = rows.filter(_regular(F.col("vector"), dim))
        sample = good.orderBy(F.xxhash64("vector")).limit(SAMPLED * cells).select(array_to_vector("vector").alias("features"))
        found = sample.select("features").limit(2).collect()
        if len(found) > 1 and cells > 1:
            centres = [[float(x) for x in c] for c in KMeans(k=cells, distanceMeasure="cosine", initMode="random", maxIter=8, seed=1).fit(sample).clusterCenters()]
        else:
            centres = [[float(x) for x in f["features"]] for f in found[:1]]
        table = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
        if centres:
            held = rows.mapInArrow(_nearest(centres), f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, cell int, angle double")
        else:
            held = rows.select("id", "vector", F.lit(ODD).alias("cell"), F.lit(0.0).alias("angle"))
        # one task writes a cell, several only where it holds much
        held.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
        facts = spark.read.schema("id string, angle double, cell int").parquet(f"{path}/cells").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width"))
        facts.join(F.broadcast(table), "cell", "left").write.parquet(f"{path}/facts")
        return cls(spark, path)

    def facts(self) -> list:
        """A row a cell: cell, n, width, centre."""
        return self.spark.read.parquet(f"{self.path}/facts").collect()

    def rows(self, cells: list[int]) -> DataFrame:
        return self.spark.read.schema("id string, vector array<double>, cell int").parquet(f"{self.path}/cells").filter(F.col("cell").isin(cells))

    def cells_for(self, query: list[float], k: int) -> list[int]:
        """The cells that can hold one of the k highest cosines."""
        facts = self.facts()
        if not any(query) or not all(map(math.isfinite, query)):
            return [f["cell"] for f in facts]
        angles = {f["cell"]: _between(query, f["centre"]) if f["centre"] is not None and len(f["centre"]) == len(query) else None for f in facts}
        always = [c for c, a in angles.items() if a is None]
        home, held = list(always), 0
        for f in sorted((f for f in facts if angles[f["cell"]] is not None), key=lambda f: angles[f["cell"]]):
            if held >= k:
                break
            home.append(f["cell"])
            held += f["n"]
        best = vector_top_k(self.rows(home), "id", "vector", query, k).collect()
        if len(best) < k:
            return [f["cell"] for f in facts]
        least = best[-1]["score"]
        reach = math.acos(max(-1.0, min(1.0, least))) + SLACK
        return always + [f["cell"] for f in facts if angles[f["cell"]] is not None and angles[f["cell"]] - f["width"] <= reach]

    def top_k(self, query: list[float], k: int, threshold: float = -1.0) -> DataFrame:
        """(id, score) as ``retrieval.vector_top_k`` gives them for all rows."""
        return vector_top_k(self.rows(self.cells_for(query, k)), "id", "vector", query, k, threshold)
