"""An approximate vector index as a partitioned Parquet table: a coarse quantiser, and its cells as partitions that hold every row.

``create`` fits centroids by MLlib's k-means on a bounded sample, or takes them; every row then goes to the cell of its nearest centroid by
cosine.  A search looks up the ``probes`` nearest cells of each query and opens those partitions only, so it reads about
``probes / cells`` of the rows; searching all cells is the exact search.  A cell of many rows is several files, dealt by row.

How many cells a recall takes depends on the data: ``tune`` measures it on some queries against the exact search, and the index keeps the number for its searches.

Only centroids are broadcast, ``MOST_CELLS`` of them at most.  Queries are handled in blocks of ``BLOCK_BYTES``, sorted by their nearest cell, so
that a block opens few cells.

Defined cases: rows without id or vector are left out.  Zero vectors lie in the first cell and have the score 0 with every query, as in the exact search;
so do vectors of another length than the query's.  Repeated ids are repeated rows.  Queries without vector have no results.  An index without rows has one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from larkspine.operators import paths
from larkspine.operators.topk import best_rows, vectors_of

MOST_CELLS = 4096
#: Rows that k-means is fitted on at most, and its rounds.
SAMPLE_ROWS, ROUNDS = 200_000, 10
#: Rows of a file of a cell, on average at most.
FILE_ROWS = 1 << 20
#: Bytes of queries that one pass over the opened cells handles.
BLOCK_BYTES = 16 << 20
PROBES = 8


def fitted(vectors: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """cell, centroid: spherical k-means of a sample of ``sample_rows`` of (doc_id, embedding), drawn by a hash of the row among vectors of the
    most frequent length."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    sizes = vectors.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    some = vectors.where(F.exists("embedding", lambda x: x != 0) & (F.size("embedding") == (sizes[0] if sizes else 0))).select("embedding", F.xxhash64("doc_id", "embedding").alias("draw"))
    sample = some.orderBy("draw").limit(sample_rows).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
    try:
        n = sample.count()
        if not n:
            return spark.createDataFrame([(0, None)], "cell int, centroid array<double>")
        model = KMeans(k=min(cells, n), seed=seed, maxIter=rounds, distanceMeasure="cosine", initSteps=2).fit(sample)
        found = [c.tolist() for c in model.clusterCenters()]
    finally:
        sample.unpersist()
    return spark.createDataFrame(list(enumerate(found)), "cell int, centroid array<double>")


class VectorIndex:
    """Tables under a folder: ``rows/cell=..`` (doc_id, embedding and other columns), ``centroids`` (cell, centroid)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, vectors: DataFrame, cells: int | None = None, centroids: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """Writes the index of (doc_id, embedding, ...); ``cells``: the square root of the number of rows unless told.  Readers see it
        when the centroids, written last, are there; an index that was there is dropped first."""
        paths.delete(self.spark, self.path)
        rows = vectors.where("doc_id is not null and embedding is not null")
        if centroids is None:
            cells = cells or int(np.sqrt(rows.count()))
            centroids = fitted(rows, max(1, min(cells, MOST_CELLS)), sample_rows)
        held = centroids.orderBy("cell").limit(MOST_CELLS + 1).collect()
        if len(held) > MOST_CELLS:
            raise ValueError(f"an index has {MOST_CELLS} cells at most")
        self._append(rows, [(r[0], r[1]) for r in held])
        rows.drop("cell").limit(0).withColumn("cell", F.lit(0)).coalesce(1).write.parquet(f"{self.path}/schema")
        self.spark.createDataFrame(held, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        return self

    def _append(self, rows: DataFrame, centroids: list[tuple[int, list[float] | None]], mode: str = "append") -> None:
        celled = assigned(rows, centroids)
        size = celled.groupBy("cell").count().collect()  # a row for each cell
        files = F.create_map(*[F.lit(x) for r in size for x in (r[0], r[1] // FILE_ROWS + 1)]) if size else F.create_map(F.lit(0), F.lit(1))
        dealt = celled.withColumn("_file", F.pmod(F.xxhash64("doc_id"), files[F.col("cell")]))
        wide = dealt.repartition(max(1, min(len(size), 512)), "cell", "_file").sortWithinPartitions("cell", "doc_id").drop("_file")
        wide.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/rows")

    def add(self, vectors: DataFrame) -> None:
        """Appends rows to the cells of the centroids that are there; ids that are there already are repeated."""
        self._append(vectors.where("doc_id is not null and embedding is not null"), self.centroids())

    def delete(self, ids: DataFrame) -> int:
        """Takes out the rows of (doc_id); only cells that hold some are written anew; their number."""
        gone = ids.select("doc_id").distinct()
        cells = [r[0] for r in self.rows().join(gone, "doc_id", "left_semi").select("cell").distinct().collect()]
        if cells:
            # Written beside the index and then put in place, so that no file is read while it is replaced.
            kept = self.rows().where(F.col("cell").isin(cells)).join(gone, "doc_id", "left_anti")
            kept.write.mode("overwrite").parquet(f"{self.path}/kept")
            back = self.spark.read.schema(kept.schema).parquet(f"{self.path}/kept")
            left = {r[0] for r in back.select("cell").distinct().collect()}
            back.repartition("cell").sortWithinPartitions("cell", "doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/rows")
            for cell in set(cells) - left:
                paths.delete(self.spark, f"{self.path}/rows/cell={cell}")
            paths.delete(self.spark, f"{self.path}/kept")
        return len(cells)

    def centroids(self) -> list[tuple[int, list[float] | None]]:
        return [(r[0], r[1]) for r in self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")

    def exists(self) -> bool:
        return paths.exists(self.spark, f"{self.path}/centroids/_SUCCESS")

    def drop(self) -> None:
        paths.delete(self.spark, self.path)

    def opened(self, cells: list[int], condition: Column | None = None) -> DataFrame:
        """The rows of some cells, under a condition on their columns: partitions and row groups are skipped by the scan."""
        some = self.rows().where(F.col("cell").isin(cells))
        return some if condition is None else some.where(condition)

    def tune(self, queries: DataFrame, k: int = 10, recall: float = 0.97) -> tuple[int, float]:
        """The least number of cells that hold a share of ``recall`` of the exact best ``k`` of some (query_id, embedding), and that share; searches
        use it from now on.  A sample of a few hundred queries will do; a little more than the recall that is wanted allows for its error."""
        centroids = self.centroids()
        exact = self.search(queries, k, len(centroids)).select("query_id", "doc_id").join(self.rows().select("doc_id", "cell"), "doc_id")
        asked = queries.where("embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
        order = nearest(asked, centroids, len(centroids)).select("query_id", F.posexplode("cells").alias("place", "cell"))
        at = dict(exact.join(order, ["query_id", "cell"]).groupBy("place").count().collect())  # a number for each cell at most
        total, seen, probes = sum(at.values()), 0, 0
        while probes < len(centroids) and (not total or seen < recall * total):
            seen, probes = seen + at.get(probes, 0), probes + 1
        self.spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/probes")
        return probes, seen / total if total else 1.0

    def probes(self) -> int:
        """Cells that a search opens unless told: what ``tune`` found, else ``PROBES``."""
        return self.spark.read.parquet(f"{self.path}/probes").first()[0] if paths.exists(self.spark, f"{self.path}/probes/_SUCCESS") else PROBES

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, condition: Column | None = None, min_score: float | None = None) -> DataFrame:
        """query_id, doc_id, score, rank: the best ``k`` by cosine among the ``probes`` nearest cells of each of (query_id, embedding)."""
        from larkspine.operators.retrieval import ranked

        centroids, probes = self.centroids(), probes or self.probes()
        asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
        near = nearest(asked, centroids, probes).sort(F.col("cells")[0], "query_id")
        out, held, size = None, [], 0
        for row in [*near.toLocalIterator(), None]:
            if row is not None:
                held.append(row)
                size += 8 * len(row[1])
            if held and (row is None or size >= BLOCK_BYTES):
                cells = sorted({c for r in held for c in r[2]})
                rows = self.opened(cells, condition).select("doc_id", F.col("embedding").cast("array<float>"), "cell")
                part = rows.mapInArrow(_searched(held, k), "query_id long, doc_id long, score double")
                out = part if out is None else out.unionByName(part)
                held, size = [], 0
        if out is None:
            out = self.spark.createDataFrame([], "query_id long, doc_id long, score double")
        return ranked(out if min_score is None else out.where(F.col("score") >= min_score), k)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def _similar(vectors: pa.Array, centres: np.ndarray) -> np.ndarray:
    """Cosine of rows with unit centres; 0 for rows of another length, and so for zero vectors."""
    fits, m = vectors_of(vectors, centres.shape[1])
    out = np.zeros((len(vectors), len(centres)))
    out[fits] = _unit(m) @ centres.T
    return out


def _centres(centroids: list) -> tuple[np.ndarray, np.ndarray]:
    size = max((len(c) for _, c in centroids if c), default=1)
    return np.array([n for n, _ in centroids]), _unit(np.array([c or [0.0] * size for _, c in centroids], float))


def assigned(rows: DataFrame, centroids: list) -> DataFrame:
    """The rows with the cell of their nearest centroid (ties: the first)."""
    held = rows.sparkSession.sparkContext.broadcast(_centres(centroids))
    at = rows.columns.index("embedding")

    def run(batches):
        cells, centres = held.value
        for batch in batches:
            best = [np.argmax(_similar(batch.column(at).slice(i, 1024), centres), axis=1) for i in range(0, batch.num_rows, 1024)]
            cell = cells[np.concatenate(best)] if best else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    plain = rows.drop("cell")
    at = plain.columns.index("embedding")
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("cell", IntegerType())]))


def nearest(queries: DataFrame, centroids: list, probes: int) -> DataFrame:
    """query_id, embedding, cells: the ``probes`` cells of the nearest centroids, nearest first (ties: in their order)."""
    held = queries.sparkSession.sparkContext.broadcast(_centres(centroids))

    def run(batches):
        cells, centres = held.value
        for batch in batches:
            order = np.argsort(-_similar(batch.column(1), centres), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([cells[o].tolist() for o in order], pa.list_(pa.int32()))], ["query_id", "embedding", "cells"])

    return queries.mapInArrow(run, "query_id long, embedding array<double>, cells array<int>")


def _searched(held: list, k: int):
    """Best rows of (doc_id, embedding, cell) for each query, among the rows of the query's cells."""
    sizes = {len(r[1]) for r in held}
    groups = []
    for size in sizes:  # queries of other lengths score 0 with these rows and are handled by themselves
        own = [r for r in held if len(r[1]) == size]
        by_cell: dict[int, list[int]] = {}
        for i, r in enumerate(own):
            for c in r[2]:
                by_cell.setdefault(c, []).append(i)
        groups.append((np.array([r[0] for r in own]), np.array([r[1] for r in own], float).reshape(len(own), size), {c: np.array(i) for c, i in by_cell.items()}))

    def run(batches):
        best = [best_rows(q, m, k) for q, m, _ in groups]
        for batch in batches:
            cell = batch.column(2).to_numpy()
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0, [True]])) if len(order) else []
            for a, z in zip(edges[:-1], edges[1:]):
                some = batch.take(pa.array(order[a:z]))
                for b, (_, _, by_cell) in zip(best, groups):
                    if (own := by_cell.get(int(cell[order[a]]))) is not None:
                        b.add(some.column(0).to_numpy(), some.column(1), own)
        for b in best:
            yield from b.rows()

    return run
