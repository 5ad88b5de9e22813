"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, padded to a power of two, goes through three rounds of random
signs and a fast Hadamard transform; its bucket in a table is the nearest
signed axis of the rotated space. A query probes, per table, the ``probes``
axes that its rotated form is nearest to. Every vector is indexed in all
``TABLES`` tables. Candidates meet their queries in groups (table, bucket),
cut into blocks of bounded size on both sides; a group returns each query's
best by exact inner products, in double precision, on the original vectors.

``probes`` is measured for each length of vectors: for up to ``SAMPLE``
queries of that length, drawn by a hash, the true neighbours are found by
brute force against all rows, and the smallest number of probes is taken that
finds ``RECALL`` of them.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows without an id, take no part; repeated ids count once
(the smallest vector, component by component); vectors meet only those of equal length. Of
equal vectors the ``k + 1`` smallest ids are indexed, which is all that a
result of k can hold, so that a vector with very many copies fills no bucket. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import materialize
from .batches import small_batches

TABLES = 4
SAMPLE = 64
RECALL = 0.95
BLOCK_POINTS, BLOCK_QUERIES = 8192, 2048


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Unit vectors after three rounds of signs and Hadamard transforms."""
    dim = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), dim))
    y[:, :x.shape[1]] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    signs = np.random.default_rng([table, dim]).choice([-1.0, 1.0], (3, dim))
    for s in signs:
        y, half = y * s, 1
        while half < dim:
            y = y.reshape(len(x), -1, 2, half)
            y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), dim)
            half *= 2
        y /= np.sqrt(dim)
    return y


def axes(x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """The ``probes`` nearest signed axes of each vector, nearest first."""
    y = rotated(x, table)
    both = np.concatenate((y, -y), 1)
    if probes == 1:
        return both.argmax(1)[:, None]
    return np.argsort(-both, 1, kind="stable")[:, :probes]


def vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(v) for v in batch.column("v").to_pylist()])
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = pa.array([np.asarray(v, "<f8").tobytes() for v in b.column("embedding").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), raw], ["vec_id", "v"])


def _hashed(probes: int | dict[int, int]):
    """Cells of every vector; ``probes`` for all or by length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                x = vectors(part.column("v"))
                n = probes[x.shape[1]] if isinstance(probes, dict) else probes
                for t in range(TABLES):
                    found = axes(x, t, n)
                    row = np.repeat(np.arange(len(x)), found.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t, np.int32)), pa.array(found.ravel().astype(np.int32)),
                         pa.array(np.full(len(row), x.shape[1], np.int32)), *[c.take(pa.array(row)) for c in part.columns]],
                        ["table", "bucket", "dim", "vec_id", "v"])
    return run


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of queries and points and exact scores of each query's k + 1 best (ties all kept)."""
    out: list[tuple] = []
    for a in range(0, len(q), 256):
        s = q[a:a + 256] @ x.T
        s[query_ids[a:a + 256, None] == ids[None]] = -np.inf
        least = np.partition(s, -(k + 1), 1)[:, -(k + 1)] if s.shape[1] > k + 1 else np.full(len(s), -np.inf)
        r, c = np.nonzero((s >= least[:, None] - 1e-9 * np.maximum(1, np.abs(least[:, None]))) & (s > -np.inf))
        out.append((r + a, c))
    r, c = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
    return r, c, np.einsum("ij,ij->i", q[r], x[c])


def _meet(k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, query_ids = points.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        r, c, s = _best(ids, vectors(points.column("v")), query_ids, vectors(queries.column("v")), k)
        return pa.table({"query_id": query_ids[r], "vec_id": ids[c], "score": s})
    return run


def _scanned(samples: dict[int, pa.Table], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = {n: (s.column("vec_id").to_numpy(), vectors(s.column("v"))) for n, s in samples.items()}
        held: dict[int, list] = {int(i): [] for query_ids, _ in by_length.values() for i in query_ids}
        for batch in batches:
            for part in _by_length(batch):
                x = vectors(part.column("v"))
                if x.shape[1] in by_length:
                    ids, (query_ids, q) = part.column("vec_id").to_numpy(), by_length[x.shape[1]]
                    for r, c, s in zip(*_best(ids, x, query_ids, q, k)):
                        held[int(query_ids[r])].append((-s, int(ids[c]), x[c].tobytes()))
            for i in held:
                held[i] = sorted(held[i])[:k]
        rows = [(i, -s, v, raw) for i, best in held.items() for s, v, raw in best]
        yield pa.RecordBatch.from_pydict({"query_id": [r[0] for r in rows], "score": [r[1] for r in rows], "vec_id": [r[2] for r in rows],
                                          "v": [r[3] for r in rows]}, schema=pa.schema(
            [("query_id", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64()), ("v", pa.binary())]))
    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probes_needed(points: DataFrame, queries: DataFrame, k: int, recall: float = RECALL, sample: int = SAMPLE) -> dict[int, int]:
    """By length of the queries, the smallest number of probes that finds ``recall`` of a sample's true neighbours."""
    size = F.octet_length("v")
    sizes = [r[0] for r in queries.select(size).distinct().collect()]  # one row a length
    drawn = {n // 8: queries.where(size == n).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow() for n in sizes}
    if not drawn:
        return {}
    true = _top(points.mapInArrow(_scanned(drawn, k), "query_id long, score double, vec_id long, v binary"), k).toArrow()  # k rows a query
    lengths = pc.divide(pc.binary_length(true.column("v")), 8)
    return {n: _probes_of(s, true.filter(pc.equal(lengths, n)), recall) for n, s in drawn.items()}


def _probes_of(drawn: pa.Table, true: pa.Table, recall: float) -> int:
    """Probes for vectors of one length, by its sampled queries and their true neighbours."""
    if not len(true):
        return 1
    where = {i: n for n, i in enumerate(drawn.column("vec_id").to_pylist())}
    query = np.array([where[i] for i in true.column("query_id").to_pylist()])
    q, x, places = vectors(drawn.column("v")), vectors(true.column("v")), []
    for t in range(TABLES):
        order = axes(q, t, 1 << 30)
        place = np.argsort(order, 1)
        places.append(place[query, axes(x, t)[:, 0]])
    first = np.sort(np.min(places, 0))
    return int(first[min(len(first) - 1, int(np.ceil(recall * len(first))) - 1)]) + 1


def search(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
           probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that satisfies ``is_query`` (on column vec_id)."""
    small_batches(rows.sparkSession, 2048)
    e = F.col("embedding")
    good = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    good = good.where("vec_id is not null and embedding is not null").where(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0))
    good = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    least = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = good.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1).drop("_n")
    packed = "vec_id long, v binary"
    points = materialize(indexed.mapInArrow(_packed, packed), "ann-points")
    queries = materialize(good.where(is_query).mapInArrow(_packed, packed), "ann-queries")
    probes = probes or probes_needed(points, queries, k)

    cells = "table int, bucket int, dim int, vec_id long, v binary"
    keys = ["table", "bucket", "dim"]
    p, q = points.mapInArrow(_hashed(1), cells), queries.mapInArrow(_hashed(probes), cells)
    n = p.groupBy(*keys).agg(F.count("*").alias("n_p")).join(q.groupBy(*keys).agg(F.count("*").alias("n_q")), keys)
    n = materialize(n.select(*keys, F.ceil(F.col("n_p") / BLOCK_POINTS).cast("int").alias("b_p"),
                             F.ceil(F.col("n_q") / BLOCK_QUERIES).cast("int").alias("b_q")), "ann-blocks")

    def blocked(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(own[-1])
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[-1])
        return side.join(n, keys).select(*keys, mine, copies, "vec_id", "v").select(*keys, "p", "q", "vec_id", "v")

    group = [*keys, "p", "q"]
    found = (blocked(p, "b_p", "b_q").groupBy(*group).cogroup(blocked(q, "b_q", "b_p").groupBy(*group))
             .applyInArrow(_meet(k), "query_id long, vec_id long, score double"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
