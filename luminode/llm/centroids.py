"""Centroid clustering of integer vectors: distances by table lookup.

In every round a table holds, for each dimension, integer value and centroid, the squared
difference; a vector's distances are sums of its rows of that table. All sums are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from luminode.llm.common import stored

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Integers beyond it are set to it: squared distances stay within 64 bits.
LARGEST = 1 << 27
#: Values of a table over a whole range; where values lie farther apart only those that occur are tabulated.
WIDE = 4096
ROWS = 8192


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x) of the vectors with exactly `dims` components, none null or non-finite."""
    column = F.col(embedding)
    if not isinstance(vectors.schema[embedding].dataType.elementType, (FloatType, DoubleType)):
        column = column.cast("array<double>")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            right = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy() == dims)
            ids, flat = ids.take(pa.array(right)), lists.take(pa.array(right)).flatten()
            values = flat.fill_null(float("nan")).to_numpy().astype(float).reshape(-1, dims)
            fine = np.isfinite(values).all(axis=1)
            q = np.floor(np.clip(values[fine], -LARGEST, LARGEST) * scale).clip(-LARGEST, LARGEST).astype(np.int32)
            offsets = pa.array(np.arange(0, q.size + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fine)), pa.ListArray.from_arrays(offsets, pa.array(q.ravel()))], ["vec_id", "q"])

    return vectors.select(F.col(vec_id).cast("long"), column).mapInArrow(turn, "vec_id long, q array<int>")


class Tables:
    """Squared differences to some centroids, tabulated once for all values between the least and the greatest met."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.low, self.high, self.table = centroids, 0, -1, None

    def _over(self, values: np.ndarray, d: int) -> np.ndarray:
        return (values[:, None] - self.centroids[None, :, d]) ** 2

    def distances(self, q: np.ndarray) -> np.ndarray:
        low, high = min(int(q.min()), self.low), max(int(q.max()), self.high)
        out = np.zeros((len(q), len(self.centroids)), np.int64)
        if high - low >= WIDE:
            for d in range(q.shape[1]):
                occurring, code = np.unique(q[:, d], return_inverse=True)
                out += self._over(occurring, d)[code]
            return out
        if self.table is None or low < self.low or high > self.high:
            self.low, self.high = low, high
            self.table = [self._over(np.arange(low, high + 1), d) for d in range(q.shape[1])]
        for d in range(q.shape[1]):
            out += self.table[d][q[:, d] - self.low]
        return out

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of equally near ones) and squared distance."""
        distance = self.distances(q)
        number = distance.argmin(axis=1)
        return number, distance[np.arange(len(q)), number]


def _blocks(batches: Iterator[pa.RecordBatch], column: int, dims: int):
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            batch = whole.slice(k, ROWS)
            yield batch, batch.column(column).flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of integer vectors (vec_id, q)."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(centroids)
        for batch, q in _blocks(batches, 1, dims):
            number, distance = tables.nearest(q)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "q").mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of each one's vectors; those without any stay."""
    dims, k = centroids.shape[1], len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total, count = Tables(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, q in _blocks(batches, 0, dims):
            number, _ = tables.nearest(q)
            count += np.bincount(number, minlength=k)
            for c in np.unique(number):
                total[c] += q[number == c].sum(axis=0)
        c, d = np.divmod(np.arange(k * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total.ravel()), pa.array(count[c])], ["c", "d", "total", "n"])

    parts = vectors.select("q").mapInArrow(run, "c int, d int, total long, n long")
    out = centroids.copy()
    # one row for each centroid and dimension, however many vectors there are
    for row in parts.groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
        out[row.c, row.d] = int(row.total) // row.n
    return out


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The vectors whose ids have the smallest sha256 of `seed:id`, in that order; fewer where there are fewer."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.orderBy(order.asc_nulls_last(), "q").limit(clusters).collect()
    return np.array([r.q for r in chosen], np.int64)


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Vectors of another length, or with null or non-finite components, and null ones are left out.
    Components become floor(scale * x), within LARGEST. Each round assigns every vector to the
    nearest centroid (squared distance; the smaller number of equally near ones) and moves centroids
    to the exact floor of the mean; a last assignment follows. Repeated rows count each; of rows that
    repeat an id among the first centroids the smaller vector comes first, a null id last. Without
    any vector there are no rows. Only the two named columns are read.
    """
    kept = stored(integers(vectors, vec_id, embedding, dims, scale), "integers")
    centroids = first_centroids(kept, clusters)
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    found = stored(assign(kept, centroids), "assigned")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    total = lambda x: F.lit(x).cast("long")
    return found.select("*", at([total(sums.get(c, 0)) for c in range(len(named))]).alias("cluster_inertia"), total(sum(sums.values())).alias("inertia"), at(map(F.lit, named)).alias("centroid_sha256"))


def oracle_sql() -> str:
    """The rows of op12, for engines with lists."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q AS w FROM v ORDER BY sha256('1:' || vec_id) LIMIT {CLUSTERS})""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, c := c)) AS b FROM (SELECT rid, c, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (q[i] - w[i]) * (q[i] - w[i])))::BIGINT AS d FROM v, c{r}) GROUP BY rid)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m, w) AS w FROM c{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM
 (SELECT b.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT rid, unnest(range({DIMS})) AS i, unnest(q) AS x FROM v) JOIN a{r} USING (rid) GROUP BY ALL) GROUP BY c) USING (c))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM (SELECT vec_id, b.c AS c, b.d AS d FROM v JOIN a{ROUNDS} USING (rid)) JOIN c{ROUNDS} USING (c)"""
    )
