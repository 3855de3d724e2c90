"""Cosine k-nearest neighbours of a stated query set: exact, within groups, and by an index of inverted lists.

Queries and vectors are dealt into blocks of bounded size, and the blocks of both that belong together meet in one task, which
folds them to k vectors a query. Neither side passes through the driver, which sees counts (and the index's centroids) only.

Similarities of what is found are summed up pair by pair in one order, whatever block a pair was met in, and rounded to nine decimals, so
that results do not depend on the blocks. Equal similarities go to the smaller id.

Null vectors and vectors or queries without an id are left out; a repeated id is found once for each of its rows (once in all by the index);
a query alone with its own id has no neighbours; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, written

#: Bytes of the queries and of the vectors that meet in one task.
QUERY_BYTES, VECTOR_BYTES = 16 << 20, 64 << 20
#: Queries and vectors that meet in one matrix product.
QUERY_ROWS, VECTOR_ROWS = 1024, 4096
DECIMALS = 9

FOUND = "query_id long, vec_id long, similarity double"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Best:
    """The k best vectors of every query so far: larger similarity first (to nine decimals), then the smaller id."""

    def __init__(self, names: np.ndarray, matrix: np.ndarray, k: int, exclude_self: bool):
        self.names, self.matrix, self.k, self.exclude_self = names, matrix, k, exclude_self
        self.query, self.id, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: What a vector must reach to matter, by query.
        self.bar = np.full(len(names), -np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        rows = unit(rows)
        order = np.argsort(ids, kind="stable")
        low, high = np.searchsorted(ids, self.names, "left", order), np.searchsorted(ids, self.names, "right", order)
        slack = 2 * 10.0**-DECIMALS  # more than rounding and the product's order of sums can move a similarity
        for at in range(0, len(self.names), QUERY_ROWS):
            sims = self.matrix[at : at + QUERY_ROWS] @ rows.T
            if self.exclude_self:
                for q in np.flatnonzero(high[at : at + QUERY_ROWS] > low[at : at + QUERY_ROWS]):
                    sims[q, order[low[at + q] : high[at + q]]] = -np.inf
            bar = self.bar[at : at + QUERY_ROWS]
            if len(ids) > self.k and np.isinf(bar).any():  # the first vectors of these queries
                bar = np.maximum(bar, np.partition(sims, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            query, place = np.nonzero((sims >= bar[:, None] - slack) & (sims > -np.inf))
            self.merge(at + query, ids[place], self.exact(at + query, rows, place))

    def exact(self, query: np.ndarray, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = [np.rint((self.matrix[query[i : i + 65536]] * rows[place[i : i + 65536]]).sum(1) * 10.0**DECIMALS).astype(np.int64) for i in range(0, len(query), 65536)]
        return np.concatenate([np.zeros(0, np.int64), *out])

    def merge(self, query: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        query, ids, key = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.key, key])
        order = np.lexsort((ids, -key, query))
        query, ids, key = query[order], ids[order], key[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.id, self.key = query[rank < self.k], ids[rank < self.k], key[rank < self.k]
        last = rank[rank < self.k] == self.k - 1
        self.bar[self.query[last]] = self.key[last] / 10.0**DECIMALS

    def table(self) -> pa.Table:
        return pa.table({"query_id": self.names[self.query], "vec_id": self.id, "similarity": self.key / 10.0**DECIMALS})


def pieces(df: DataFrame, bytes_of: int) -> Column:
    """How many blocks a group of vectors is dealt into, as an aggregate."""
    return F.ceil(F.sum(8 * F.size("v") + 24) / bytes_of).cast("int")


def met(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool, query_bytes: int, vector_bytes: int) -> DataFrame:
    """query_id, vec_id, similarity: up to k for every query (id, v, grp) and block of the vectors (id, v, grp) of its group.

    Blocks go by the hash of id and vector, so that a common id, vector or group is dealt evenly. A group's queries go to each block of
    its vectors and the other way round: blocks, not pairs, are crossed.
    """
    asked, known = queries.groupBy("grp").agg(pieces(queries, query_bytes).alias("n_query")), vectors.groupBy("grp").agg(pieces(vectors, vector_bytes).alias("n_vector"))
    blocks = asked.join(known, "grp")
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(blocks, "grp").select("grp", dealt("n_query").alias("qb"), every("n_vector").alias("vb"), "id", "v")
    right = vectors.join(blocks, "grp").select("grp", every("n_query").alias("qb"), dealt("n_vector").alias("vb"), "id", "v")

    def fold(asked: pa.Table, known: pa.Table) -> pa.Table:
        best = Best(asked["id"].to_numpy(), unit(matrix_of(asked["v"])), k, exclude_self)
        if asked.num_rows:
            for at in range(0, known.num_rows, VECTOR_ROWS):
                part = known.slice(at, VECTOR_ROWS)
                best.add(part["id"].to_numpy(), matrix_of(part["v"]))
        return best.table()

    keys = ["grp", "qb", "vb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fold, FOUND)


def own(df: DataFrame, id_col: str, vector_col: str, group: Column) -> DataFrame:
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & group.isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), group.alias("grp"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", within: str | None = None, exclude_self: bool = True, query_bytes: int = QUERY_BYTES, vector_bytes: int = VECTOR_BYTES) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k most alike vectors of every query, among those that agree in `within` if it is given."""
    ship_package(queries.sparkSession)
    group = F.col(within) if within else F.lit(0)
    sides = (own(df, id_col, vector_col, group) for df in (queries, vectors))
    return ranked(met(*sides, k, exclude_self, query_bytes, vector_bytes), k)


def max_pool(near: DataFrame, owners: DataFrame, *, id_col: str = "vec_id", owner_col: str = "label") -> DataFrame:
    """query_id, owner, best_vec_id, similarity: the best vector of each owner (an equi-join and one aggregate)."""
    joined = near.join(owners.select(F.col(id_col).alias("vec_id"), F.col(owner_col).alias("owner")), "vec_id")
    best = joined.groupBy("query_id", "owner").agg(F.min_by(F.struct("vec_id", "similarity"), F.struct(-F.col("similarity"), "vec_id")).alias("x"))
    return best.select("query_id", "owner", F.col("x.vec_id").alias("best_vec_id"), F.col("x.similarity").alias("similarity"))


def similarity_to_owner(queries: DataFrame, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", owner_col: str = "label", vector_bytes: int = VECTOR_BYTES) -> DataFrame:
    """query_id, owner, similarity: the best cosine of each query with the other vectors of its own owner."""
    best = nearest(queries, vectors, 1, id_col=id_col, vector_col=vector_col, within=owner_col, vector_bytes=vector_bytes)
    return best.join(queries.select(F.col(id_col).alias("query_id"), F.col(owner_col).alias("owner")).distinct(), "query_id").select("query_id", "owner", "similarity")


def assigned(df: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """df (id, v) with lists: the n centroids that are most alike, ties to the smaller number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, VECTOR_ROWS):
                part = batch.slice(at, VECTOR_ROWS)
                sims = np.round(unit(matrix_of(part.column(1))) @ centroids.T, DECIMALS)
                out.append(np.argsort(-sims, axis=1, kind="stable")[:, :n].astype(np.int32))
            flat = np.concatenate(out) if out else np.zeros((0, n), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))
            yield pa.record_batch([*batch.columns, lists], names=["id", "v", "lists"])

    kind = df.schema["v"].dataType.simpleString()
    return df.select("id", "v").mapInArrow(run, f"id long, v {kind}, lists array<int>")


def centroids(vectors: DataFrame, n_lists: int, rounds: int, sample_rows: int, seed: int) -> np.ndarray:
    """Spherical k-means by rounds of Lloyd's method over a sample, by seeded hash, of at most sample_rows or so.

    A round assigns and adds up where the rows are; the driver sees n_lists sums a task and round.
    """
    order = F.xxhash64("id", "v", F.lit(seed))
    total = vectors.count()
    held = written(vectors.where(F.pmod(order, F.lit(1_000_003)) < 1_000_003 * min(1.0, sample_rows / max(total, 1))), "sample")
    first = held.orderBy(order, "id").limit(n_lists).select("v").toArrow()["v"]
    if not len(first):
        return np.zeros((0, 1))
    found = unit(matrix_of(first))
    for _ in range(rounds):
        old = found

        def sums(batches: Iterator[pa.RecordBatch], old: np.ndarray = old) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(old)
            for batch in batches:
                for at in range(0, batch.num_rows, VECTOR_ROWS):
                    rows = unit(matrix_of(batch.column(0).slice(at, VECTOR_ROWS)))
                    np.add.at(total, np.argmax(np.round(rows @ old.T, DECIMALS), axis=1), rows)
            used = np.flatnonzero(np.abs(total).sum(1))
            yield pa.record_batch([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["list", "s"])

        dims = old.shape[1]
        added = held.select("v").mapInArrow(sums, "list long, s array<double>").groupBy("list").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s")).toArrow()
        if added.num_rows:
            found = old.copy()
            found[added["list"].to_numpy()] = unit(matrix_of(added["s"]))
    return found


class Index:
    """Inverted lists of all vectors by coarse centroids: a written table of (grp, id, v), each vector in its `spill` nearest lists.

    The centroids, at most 4096 of them, are fitted to a sample of at most sample_rows rows; every row is in the index. A list of any length
    is searched in blocks.
    """

    def __init__(self, vectors: DataFrame, *, n_lists: int | None = None, spill: int = 2, rounds: int = 6, sample_rows: int = 200_000, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding"):
        ship_package(vectors.sparkSession)
        self.id_col, self.vector_col = id_col, vector_col
        rows = own(vectors, id_col, vector_col, F.lit(0)).drop("grp")
        n = n_lists or min(4096, max(1, int(rows.count() ** 0.5)))
        self.centroids = centroids(rows, n, rounds, sample_rows, seed)
        self.lists = written(assigned(rows, self.centroids, spill).select(F.explode("lists").alias("grp"), "id", "v"), "lists") if len(self.centroids) else None

    def search(self, queries: DataFrame, k: int, *, share: float = 0.4, exclude_self: bool = True, query_bytes: int = QUERY_BYTES, vector_bytes: int = VECTOR_BYTES) -> DataFrame:
        """query_id, vec_id, similarity, rank: the k most alike among the lists probed, a share of all; similarities are exact."""
        if self.lists is None:
            return queries.sparkSession.createDataFrame([], FOUND + ", rank int")
        probes = max(1, round(share * len(self.centroids)))
        asked = own(queries, self.id_col, self.vector_col, F.lit(0))
        probed = assigned(asked, self.centroids, probes).select("id", "v", F.explode("lists").alias("grp"))
        found = met(probed, self.lists, k, exclude_self, query_bytes, vector_bytes)
        return ranked(found.groupBy("query_id", "vec_id").agg(F.max("similarity").alias("similarity")), k)
