"""Approximate vector search: an inverted file of k-means cells with exact re-scoring.

Cells are learned on a bounded sample of unit vectors and every row is put into the lists of its ``SPILL`` nearest cells. A list
longer than ``CHUNK`` rows is cut into parts by the hash of the id, so no crowded cell lands in one task. Queries
go to the lists of their ``probes`` nearest cells only (and to all parts of those), are scored exactly there, and
the best of each are ranked together: one pass over the probed parts of the index, whatever the number of queries.

Results: rows without an id or a vector, or with one of length 0, are in no list and match nothing; queries like them have no rows; rows
that share an id count as its best one; ranks are by (cosine desc, id asc), cosines rounded to 9 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrain.functions.batches import over_batches
from casegrain.operators.similarity import SCORE_DIGITS, best_of
from casegrain.session import materialize

SAMPLE = 50_000         # rows that cells are learned on, at most
CELLS = 1024            # at most; about the square root of the rows, else
CHUNK = 20_000          # rows of a list, and queries, that meet in one task
SPILL = 2               # lists that hold a row: those of its nearest cells
PROBES = 0.4            # share of the cells that a query visits


def _unit(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of an array column, and which rows have one."""
    lists = values.to_pylist()
    width = max((len(v) for v in lists if v), default=1)
    some = np.array([v is not None and len(v) == width and all(x is not None for x in v) for v in lists], bool)
    m = np.zeros((len(lists), width))
    if some.any():
        m[some] = np.array([v for v, s in zip(lists, some) if s], np.float64)
    norm = np.linalg.norm(m, axis=1)
    some &= norm > 0
    return m / np.where(some, norm, 1)[:, None], some


def learn_cells(base: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None,
                seed: int = 7) -> np.ndarray:
    """Unit centroids (cells × width) of k-means on the ``SAMPLE`` rows with the least hash."""
    rows = base.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), id_col).alias("h"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n = base.count()
    if n > SAMPLE:      # the hash bounds the sample; no rows travel to be ranked
        rows = rows.where(F.col("h") / F.lit(2.0 ** 64) + 0.5 < F.lit(SAMPLE / n))
    unit = materialize(rows.withColumn("norm", norm).where("norm > 0").select(
        F.transform("v", lambda x: x / F.col("norm")).alias("v")), "vector-sample")
    count = unit.count()
    if not count:
        return np.zeros((0, 1))
    k = min(cells or max(1, min(CELLS, int(np.sqrt(n)))), count)
    if k < 2:
        return np.array([unit.first()["v"]])
    model = KMeans(k=k, seed=seed, maxIter=12, featuresCol="f").fit(unit.select(array_to_vector("v").alias("f")))
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _nearest(df: DataFrame, cells: np.ndarray, n: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, unit, cell): each row with its ``n`` nearest cells."""
    sent = df.sparkSession.sparkContext.broadcast(cells)        # at most CELLS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, some = _unit(batch.column("v"))
            rows = np.flatnonzero(some)
            if not len(rows) or not len(sent.value) or unit.shape[1] != sent.value.shape[1]:
                continue
            near = np.argpartition(-(unit[rows] @ sent.value.T), n - 1, axis=1)[:, :n] if n < len(sent.value) else np.broadcast_to(
                np.arange(len(sent.value)), (len(rows), len(sent.value)))
            again = np.repeat(rows, near.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(again)), pa.array(list(unit[again]), pa.list_(pa.float64())),
                 pa.array(near.ravel().astype(np.int32))], names=["id", "unit", "cell"])
    return over_batches(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")), run,
                        "id long, unit array<double>, cell int")


def build_index(base: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cells: np.ndarray | None = None,
                chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The written lists (id, unit, cell, part), the number of parts of each cell, and the cells."""
    cells = learn_cells(base, id_col, vec_col) if cells is None else cells
    dealt = materialize(_nearest(base, cells, SPILL, id_col, vec_col), "vector-cells")
    sizes = materialize(dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts")), "vector-parts")
    lists = dealt.join(F.broadcast(sizes), "cell").select(     # one row per cell
        "id", "unit", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    return materialize(lists, "vector-lists"), sizes, cells


def search(index: tuple[DataFrame, DataFrame, np.ndarray], queries: DataFrame, k: int = 5, probes: int | None = None,
           qid_col: str = "query_id", qvec_col: str = "query_vec", id_col: str = "vec_id", exclude_self: bool = True,
           chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, id, cosine): the k best rows of the lists that each query probes."""
    lists, sizes, cells = index
    probes = probes or max(1, int(np.ceil(PROBES * len(cells))))
    probed = _nearest(queries, cells, probes, qid_col, qvec_col).join(F.broadcast(sizes), "cell")
    groups = max(1, -(-queries.count() * probes // max(1, len(cells)) // chunk))     # about ``chunk`` queries a group
    probed = probed.select(F.col("id").alias("q"), "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                           F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("share"))
    rows = lists.select("id", "unit", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("share"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        qs, ids = left["q"].to_numpy(), right["id"].to_numpy()
        matrix = lambda t: t["unit"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        a, b = matrix(left), matrix(right)
        out = []
        step = max(1, (1 << 21) // len(ids))
        for lo in range(0, len(qs), step):
            cos = np.round(a[lo:lo + step] @ b.T, SCORE_DIGITS)
            if exclude_self:
                cos[ids == qs[lo:lo + step, None]] = -np.inf
            score, names = best_of(cos, np.broadcast_to(ids, cos.shape).copy(), k)
            some = np.isfinite(score)
            out.append((np.repeat(qs[lo:lo + step], some.sum(axis=1)), names[some], score[some]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    keys = ("cell", "part", "share")
    found = probed.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(best, "q long, id long, cosine double")
    found = found.groupBy("q", "id").agg(F.max("cosine").alias("cosine"))      # found in two lists
    w = Window.partitionBy("q").orderBy(F.col("cosine").desc(), F.col("id").asc())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("q").alias(qid_col), F.col("rank").cast("bigint").alias("rank"), F.col("id").alias(id_col), "cosine"))
