"""Operator 12, centroid clustering over a vector-approximation (VA) file.

Vectors become whole numbers, floor(scale * x).  Beside the table of full vectors stands the VA
file: a row for each vector with a code of a few bits for each dimension, the cell of an even grid
between the dimension's smallest and largest value.  A round reads the VA file alone: lookup
tables give, for each dimension, cell and centroid, the least and the most that the dimension can
add to the squared distance, so a row's sums bound its distance to each centroid.  What a
reference point would add is taken off in every table: this shifts all distances of a vector
alike, so it changes no comparison, and intervals get narrower the nearer the centroids lie to
that point (their mean).  Where one interval lies below all others the nearest centroid is known.
Only rows whose intervals overlap, or whose cluster has changed, are joined with their full
vectors, which settle the distances exactly, ties to the smaller number.  The full vectors are a
table bucketed by row number: a round deals out the codes that ask for a vector, never the vectors.

Sums of a cluster are kept as whole numbers and moved along with the vectors that change their
cluster, so a vector that stays is not read to compute a mean.  Each task adds up its own moves; the
driver receives sums by centroid and dimension.  If no centroid moves the later rounds cannot
change anything and are left out.  After the last round all rows are assigned once more, and
every full vector is read for its exact distance.

Defined cases: vectors that are null, of another length, or hold null or non-finite components
take no part; a null id is clustered too, but never a starting centroid while others are left;
rows with equal ids are vectors of their own (equal hashes by the vector's components, so only
equal rows tie); fewer vectors than centroids start that many; other columns are not read; an
empty table gives an empty result.  Components beyond ``LIMIT`` after scaling, whose distances
would not fit 64 bits, raise an error.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporion.llm.common import materialize, partitions_for, ship_code
from emporion.session import drop_folder, drop_scratch, scratch_dir

DIM, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10  # fixed values
BITS = 8
LIMIT = 1 << 27
ROWS = 2048  # full vectors that are compared at a time
BUCKET_BYTES = 64 << 20
NO_CLUSTER = -2  # before the first round; -1 stands for intervals that overlap
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(table: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(rid, vec_id, v) of the vectors that take part; ``rid`` numbers the rows."""
    x = F.col(vector_col).cast("array<double>")
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return table.where(F.coalesce(fine, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _limits(batches):
    """The smallest and the largest value of each dimension in a task."""
    low = high = None
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0), len(b.column(0)[0]))
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64())) for x in (low, high)], ["low", "high"])


def grid(vectors: DataFrame, dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First value and width of the cells of each dimension."""
    tasks = vectors.select("v").mapInArrow(_limits, "low array<long>, high array<long>")
    ends = [f(F.col(c)[d]) for c, f in (("low", F.min), ("high", F.max)) for d in range(dim)]
    low, high = np.array(tasks.agg(*ends).first(), np.int64).reshape(2, dim)
    if max(-int(low.min()), int(high.max())) > LIMIT:
        raise ValueError(f"components beyond {LIMIT} after scaling: squared distances would not fit 64 bits")
    return low, -(-(high - low + 1) // (1 << bits))


def _approximate(low: np.ndarray, width: np.ndarray):
    def run(batches):
        for b in batches:
            cells = ((_matrix(b.column(1), len(low)) - low) // width).astype(np.uint8)
            none = np.full(len(cells), NO_CLUSTER, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array(none)], ["rid", "cells", "cluster"])

    return run


def tables_of(low: np.ndarray, width: np.ndarray, centroids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most of what a dimension adds, by (dimension, cell, centroid), less what the
    reference point would add.  This difference is linear in the value, so the cell's ends bound it."""
    ref = np.rint(centroids.mean(0)).astype(np.int64)
    first = low[:, None] + width[:, None] * np.arange(1 << bits)
    ends = [((e[:, :, None] - centroids.T[:, None, :]) ** 2) - ((e - ref[:, None]) ** 2)[:, :, None] for e in (first, first + width[:, None] - 1)]
    return np.minimum(*ends), np.maximum(*ends)


def intervals(cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the shifted distances, by (row, centroid)."""
    lo = np.zeros((len(cells), least.shape[2]), np.int64)
    hi = np.zeros_like(lo)
    for d in range(cells.shape[1]):
        lo += least[d][cells[:, d]]
        hi += most[d][cells[:, d]]
    return lo, hi


def _classify(least: np.ndarray, most: np.ndarray):
    """Adds ``nearest`` to rows of the VA file: the only centroid whose interval reaches as low as
    the lowest upper bound, or -1 where intervals overlap."""
    dim = least.shape[0]

    def run(batches):
        for b in batches:
            cells = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, dim)
            lo, hi = intervals(cells, least, most)
            near = lo <= hi.min(1)[:, None]
            known = np.where(near.sum(1) == 1, near.argmax(1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(known)], ["rid", "cells", "cluster", "nearest"])

    return run


def _exact(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances by (row, centroid); whole numbers throughout."""
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


SETTLED = "rid long, cells binary, cluster int, count long, total array<long>"


def _settle(centroids: np.ndarray):
    """Rows (rid, cells, cluster, nearest, v) get their cluster; at the end of a task come its moves,
    a row for each centroid: how many vectors it won or lost, and their sum."""
    k, dim = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                v = _matrix(part.column(4), dim)
                old, new = part.column(2).to_numpy(), part.column(3).to_numpy().copy()
                left = np.flatnonzero(new < 0)
                new[left] = _exact(v[left], centroids).argmin(1)
                for who, sign in ((old, -1), (new, 1)):
                    moved = np.flatnonzero((old != new) & (who >= 0))
                    np.add.at(count, who[moved], sign)
                    np.add.at(total, who[moved], sign * v[moved])
                none = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(new, pa.int32()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64()))],
                    ["rid", "cells", "cluster", "count", "total"],
                )
        moved = np.flatnonzero(count | total.any(1))
        if len(moved):
            n = len(moved)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(moved, pa.int32()), pa.array(count[moved]), pa.array(list(total[moved]), pa.list_(pa.int64()))],
                ["rid", "cells", "cluster", "count", "total"],
            )

    return run


def _measure(centroids: np.ndarray):
    """(vec_id, cluster, distance) of rows (nearest, vec_id, v)."""
    dim = centroids.shape[1]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                v, own = _matrix(part.column(2), dim), part.column(0).to_numpy().copy()
                left = np.flatnonzero(own < 0)
                own[left] = _exact(v[left], centroids).argmin(1)
                d = ((v - centroids[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(own, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def start(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


class Clustering:
    """The VA file of a table and the state of its clustering."""

    def __init__(self, table: DataFrame, k: int, dim: int, scale: int, bits: int, salt: str, id_col: str, vector_col: str):
        if not 1 <= bits <= 8:
            raise ValueError("bits must lie between 1 and 8")
        ship_code(table.sparkSession)
        self.bits, self.kept = bits, []  # kept: (settled rows, unsettled rows) that hold the state
        self.spark = table.sparkSession
        self._write_vectors(whole_vectors(table, dim, scale, id_col, vector_col), dim)
        self.centroids = start(self.vectors, k, salt)
        if len(self.centroids):
            self.low, self.width = grid(self.vectors, dim, bits)
            file = self.vectors.select("rid", "v").mapInArrow(_approximate(self.low, self.width), "rid long, cells binary, cluster int")
            self.state = materialize(file, "va-file")
            self.kept = [self.state]
            self.count = np.zeros(len(self.centroids), np.int64)
            self.total = np.zeros(self.centroids.shape, np.int64)

    def _write_vectors(self, vectors: DataFrame, dim: int) -> None:
        """The full vectors, bucketed by ``rid`` under the shared folder.  Fewer buckets than shuffle
        partitions would make Spark deal them out again."""
        buckets = partitions_for(vectors.count() * 8 * (dim + 2), BUCKET_BYTES, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.name, self.path = f"va_vectors_{uuid.uuid4().hex}", scratch_dir(self.spark, "va-vectors")
        vectors.repartition(buckets, "rid").write.bucketBy(buckets, "rid").option("path", self.path).format("parquet").saveAsTable(self.name)
        self.vectors = self.spark.table(self.name)

    def drop(self) -> None:
        """Delete the state and the full vectors once nothing reads them."""
        for done in self.kept:
            drop_scratch(done)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_folder(self.spark, self.path)

    def classified(self) -> DataFrame:
        tables = tables_of(self.low, self.width, self.centroids, self.bits)
        return self.state.mapInArrow(_classify(*tables), "rid long, cells binary, cluster int, nearest int")

    def round(self) -> bool:
        """One assignment and new centroids; whether any of them moved."""
        marked = materialize(self.classified(), "va-marked")
        fetch = marked.where("nearest <> cluster").hint("shuffle_hash").join(self.vectors.select("rid", "v"), "rid")
        settled = materialize(fetch.select("rid", "cells", "cluster", "nearest", "v").mapInArrow(_settle(self.centroids), SETTLED), "va-settled")
        moves = settled.where("rid IS NULL")
        sums = [F.sum(F.col("total")[d]) for d in range(self.total.shape[1])]
        for c, count, *total in moves.groupBy("cluster").agg(F.sum("count"), *sums).collect():  # k rows
            self.count[c] += count
            self.total[c] += np.array(total, np.int64)
        for old in self.kept:  # nothing reads the state before any more
            drop_scratch(old)
        self.kept = [marked, settled]
        same = marked.where("nearest = cluster").select("rid", "cells", "cluster")
        self.state = same.unionByName(settled.where("rid IS NOT NULL").select("rid", "cells", "cluster"))
        means = np.where(self.count[:, None] > 0, self.total // np.maximum(self.count, 1)[:, None], self.centroids)
        moved = bool((means != self.centroids).any())
        self.centroids = means
        return moved

    def assigned(self) -> DataFrame:
        """(vec_id, cluster, distance) of every vector to the centroids as they are now."""
        rows = self.classified().select("rid", "nearest").hint("shuffle_hash").join(self.vectors, "rid").select("nearest", "vec_id", "v")
        return rows.mapInArrow(_measure(self.centroids), "vec_id long, cluster int, distance long")


def cluster(
    table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, bits: int = BITS,
    salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector that takes part: ``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256`` after ``rounds`` rounds and a last assignment."""
    spark = table.sparkSession
    c = Clustering(table, k, dim, scale, bits, salt, id_col, vector_col)
    if not len(c.centroids):
        c.drop()
        return spark.createDataFrame([], OUT)
    for _ in range(rounds):
        if not c.round():
            break
    rows = materialize(c.assigned(), "va-assigned")
    c.drop()
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.centroids.tolist()]

    def of(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)

    return rows.select(
        "vec_id", "cluster", "distance", of([inertia.get(i, 0) for i in range(len(digests))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )
