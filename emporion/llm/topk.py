"""Operator 10, exact top-k search with a pivot-distance index.

Vectors become whole numbers, floor(scale * x).  The largest inner product is the nearest point
once every candidate has a further coordinate that brings all to the same norm: the squared
distance to a query is then |q|^2 + R - 2 q.x, with R the largest squared norm.

Index: equal vectors are one class (with its k + 1 smallest ids, each at most k times, all that
can ever be among a query's best k).  A class belongs to its nearest pivot; the classes of a pivot, sorted by their
distance from it, are cut into annuli, each stored in packed pages of at most ``page_rows``
rows.  Pivots are a bounded sample; they steer the search and never its result.

Search: for a block of queries the annuli are sorted by the lower bound that the triangle
inequality gives, |d(q, pivot) - distance|, and expanded from the nearest in rounds of growing
width; a query stops when its next annulus cannot hold anything as near as its k-th best.  Every
row of the table is a candidate and is skipped by a bound only.  All tasks read the annuli's
outlines (a pivot and two distances each); there are at most ``MOST_ANNULI`` and as many more
as pivots, since an annulus of a large table spans several stored pages.

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros; an empty vector scores 0 with everything; of
rows with equal ids each is a candidate, and of a query id all its rows ask together (the best
pairs of any of them), none of them being a candidate for that id; a null id takes no part; fewer
candidates than k give all; other columns are not read; an empty table gives an empty result.
Components and scores must fit 64-bit numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporion.llm.common import materialize, ship_code
from emporion.session import drop_scratch

SCALE, TOP_K, EVERY = 256, 5, 50  # fixed values
PIVOTS = 64
PAGE_ROWS = 2048
MOST_ANNULI = 100_000
QUERY_ROWS = 256
FIRST_ANNULI = 4
GROWTH = 4


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that take part; ``v`` are whole numbers without zeros at the
    end, so that equal classes have equal arrays."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
    fine = fine & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    rows = table.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    last = F.size("v") - F.array_position(F.reverse(F.transform("v", lambda c: c != 0)), True) + 1
    return rows.withColumn("v", F.when(F.array_contains(F.transform("v", lambda c: c != 0), True), F.slice("v", 1, last.cast("int"))).otherwise(F.array().cast("array<long>")))


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): every different vector with its k + 1 smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def classes_of_repeated(rows: DataFrame, k: int) -> DataFrame:
    """As :func:`classes_of`, where ids may have several rows: the k + 1 smallest ids, each as often as
    it has the vector, at most k times."""
    few = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = few.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("x"))
    return held.select("v", F.flatten(F.transform("x", lambda x: F.array_repeat(x["vec_id"], x["n"]))).alias("ids"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of a matrix, filled up with zeros."""
    lens = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(lens), dim), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _apart(points: np.ndarray, norm_left: np.ndarray, pivots: np.ndarray, pivot_left: np.ndarray) -> np.ndarray:
    """Distances of points to pivots, both with their further coordinate (given squared)."""
    a, b = points.astype(np.float64), pivots.astype(np.float64)
    cross = a @ b.T + np.sqrt(norm_left)[:, None] * np.sqrt(pivot_left)[None, :]
    square = ((a * a).sum(1) + norm_left)[:, None] + ((b * b).sum(1) + pivot_left)[None, :] - 2 * cross
    return np.sqrt(np.maximum(square, 0))


def build_index(classes: DataFrame, dim: int, most: int, pivots: np.ndarray, page_rows: int, pages: int) -> DataFrame:
    """(annulus, pivot, low, high, vectors, ids, id_counts): the index, one row a page;
    ``pages`` pages make an annulus."""
    p_left = np.maximum(0, most - (pivots.astype(np.float64) ** 2).sum(1))

    def place(batches):
        for b in batches:
            x = _matrix(b.column(0), dim)
            left = np.maximum(0, most - (x.astype(np.float64) ** 2).sum(1))
            d = _apart(x, left, pivots, p_left)
            near = d.argmin(1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int64()), pa.array(d[np.arange(len(x)), near])], ["v", "ids", "pivot", "r"])

    def pack(batches):
        held, n, pivot, serial, page = [], 0, None, -1, 0
        task = TaskContext.get().partitionId()

        def flush():
            t = pa.Table.from_batches(held)
            v = pa.concat_arrays(t["v"].chunks)
            ids = pa.concat_arrays(t["ids"].chunks)
            r = t["r"].to_numpy()
            x = _matrix(v, dim)
            cols = [
                pa.array([(task << 32) + serial]), pa.array([pivot]), pa.array([r.min()]), pa.array([r.max()]),
                pa.array([x.tobytes()], pa.binary()), pa.array([ids.flatten().to_numpy().tobytes()], pa.binary()),
                pa.array([ids.value_lengths().to_numpy().astype(np.int64).tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["annulus", "pivot", "low", "high", "vectors", "ids", "id_counts"])

        for b in batches:
            own = b.column(2).to_numpy()
            edge = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for s, e in zip(edge, edge[1:]):
                while s < e:
                    if held and (int(own[s]) != pivot or n >= page_rows):
                        yield flush()
                        held, n = [], 0
                    if not held:
                        page = page + 1 if int(own[s]) == pivot and page + 1 < pages else 0
                        serial += page == 0
                    pivot = int(own[s])
                    take = min(e - s, page_rows - n)
                    held.append(b.slice(s, take))
                    n += take
                    s += take
        if held:
            yield flush()

    placed = classes.mapInArrow(place, "v array<long>, ids array<long>, pivot long, r double")
    packed = placed.repartitionByRange("pivot", "r").sortWithinPartitions("pivot", "r")
    schema = "annulus long, pivot long, low double, high double, vectors binary, ids binary, id_counts binary"
    return materialize(packed.mapInArrow(pack, schema), "topk-index")


def _scored(keep: int, most: int | None, dim: int, exact_float: bool):
    """The ``keep`` best rows of a page for every query that asks for it, at most ``most`` of one id."""

    def run(batches):
        for b in batches:
            out_q, out_best = [], []
            for vectors, ids, counts, qids, q in zip(*(b.column(i).to_pylist() for i in range(5))):
                x = np.frombuffer(vectors, np.int64).reshape(-1, dim)
                q = np.frombuffer(q, np.int64).reshape(-1, dim)
                ids, counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
                first = np.cumsum(counts) - counts
                if exact_float:
                    score = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
                else:
                    score = q @ x.T
                for qid, row in zip(np.frombuffer(qids, np.int64).tolist(), score):
                    if most is None and len(row) > keep:  # classes at least as good as the last to keep
                        few = np.flatnonzero(row >= np.partition(row, len(row) - keep)[len(row) - keep])
                    else:
                        few = np.arange(len(row))
                    n = counts[few]
                    who = ids[np.repeat(first[few] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    own = np.repeat(row[few], n)
                    order = np.lexsort((who, -own))
                    if most is not None:  # the first rows of each id
                        by = np.argsort(who[order], kind="stable")
                        first_of = np.concatenate([[True], np.diff(who[order][by]) != 0])
                        nth = np.arange(len(by)) - np.maximum.accumulate(np.where(first_of, np.arange(len(by)), 0))
                        order = order[np.sort(by[nth < most])]
                    order = order[:keep]
                    out_q.append(qid)
                    out_best.append([{"minus": -int(own[i]), "id": int(who[i])} for i in order.tolist()])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_best, BEST)], ["qid", "best"])

    return run


BEST = pa.list_(pa.struct([("minus", pa.int64()), ("id", pa.int64())]))
BEST_SQL = "array<struct<minus:long,id:long>>"


def _asker(outlines: np.ndarray, most: int, dim: int, keep: int, width: int):
    """For queries (qid, v, d, best, upto), ``d`` their distances to the pivots: the next annuli
    of each that may hold one of its best, as rows (annulus, qids, queries)."""
    annulus, pivot = outlines["annulus"], outlines["pivot"]
    low, high = outlines["low"], outlines["high"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(at, QUERY_ROWS)
                qid, q = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                norm = (q.astype(np.float64) ** 2).sum(1)
                d = part.column(2).flatten().to_numpy().reshape(len(q), -1)
                slack = 1e-6 * (1 + np.sqrt(norm + most))
                asked: dict[int, list[int]] = {}
                for i, (best, upto) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
                    bound = np.maximum(0, np.maximum(low - d[i, pivot], d[i, pivot] - high))
                    order = np.lexsort((annulus, bound))[upto : upto + width]
                    if len(best) >= keep:  # the last to keep is known: annuli beyond it are passed over
                        reach = np.sqrt(max(0.0, norm[i] + most + 2.0 * best[keep - 1]["minus"])) + slack[i]
                        order = order[bound[order] <= reach]
                    for a in order.tolist():
                        asked.setdefault(a, []).append(i)
                if asked:
                    keys = list(asked)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(annulus[keys]), pa.array([qid[asked[a]].tobytes() for a in keys], pa.binary()), pa.array([q[asked[a]].tobytes() for a in keys], pa.binary())],
                        ["annulus", "qids", "q"],
                    )

    return run


def top_k(
    table: DataFrame, k: int = TOP_K, every: int = EVERY, n_pivots: int = PIVOTS, page_rows: int = PAGE_ROWS, first: int = FIRST_ANNULI,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every query, a row whose id is
    divisible by ``every``."""
    spark = table.sparkSession
    ship_code(spark)
    rows = materialize(whole_vectors(table, id_col, vector_col, scale), "topk-rows")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    count, dim, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    # A query's own rows are left out at the end: so many more than k are kept, and no more of any id.
    again = min(k, rows.groupBy("vec_id").count().agg(F.max("count")).first()[0])
    keep = k + again
    classes = materialize(classes_of(rows, k) if again == 1 else classes_of_repeated(rows, k), "topk-classes")
    sample = classes.orderBy(F.xxhash64("v")).limit(n_pivots).select("v").collect()  # at most n_pivots rows
    pivots = np.array([list(r["v"]) + [0] * (dim - len(r["v"])) for r in sample], np.int64)
    p_left = np.maximum(0, most - (pivots.astype(np.float64) ** 2).sum(1))
    pages = -(-count // (MOST_ANNULI * page_rows))
    index = build_index(classes, dim, most, pivots, page_rows, pages)
    lines = index.groupBy("annulus").agg(F.first("pivot"), F.min("low"), F.max("high")).collect()  # bounded by MOST_ANNULI
    kinds = [("annulus", np.int64), ("pivot", np.int64), ("low", np.float64), ("high", np.float64)]
    outlines = np.array([tuple(r) for r in lines], kinds)

    asked = rows.where(F.col("vec_id") % every == 0)

    def measure(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(at, QUERY_ROWS)
                q = _matrix(part.column(0), dim)
                d = _apart(q, np.zeros(len(q)), pivots, p_left)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(d), pa.list_(pa.float64()))], ["v", "d"])

    state = asked.select("v").distinct().mapInArrow(measure, "v array<long>, d array<double>")
    state = state.select(F.monotonically_increasing_id().alias("qid"), "v", "d", F.array().cast(BEST_SQL).alias("best"), F.lit(0).cast("long").alias("upto"))
    state = materialize(state, "topk-state")  # fixes the numbers of the queries and their distances
    score = _scored(keep, k if again > 1 else None, dim, float(most) < 2**52)
    ask_schema, hit_schema = "annulus long, qids binary, q binary", f"qid long, best {BEST_SQL}"
    width, upto = first, 0
    while upto < len(outlines):
        ask = materialize(state.mapInArrow(_asker(outlines, most, dim, keep, width), ask_schema), "topk-asks")
        if ask.isEmpty():
            break
        met = index.select("annulus", "vectors", "ids", "id_counts").join(ask, "annulus").select("vectors", "ids", "id_counts", "qids", "q")
        hits = met.mapInArrow(score, hit_schema).groupBy("qid").agg(F.flatten(F.collect_list("best")).alias("more"))
        upto += width
        joined = state.join(hits, "qid", "left").withColumn("all", F.array_sort(F.concat("best", F.coalesce("more", F.array().cast(BEST_SQL)))))
        every_id = F.filter("all", lambda x, i: F.size(F.filter(F.slice("all", 1, i), lambda y: y["id"] == x["id"])) < k) if again > 1 else F.col("all")
        before = state
        state = materialize(joined.select("qid", "v", "d", F.slice(every_id, 1, keep).alias("best"), F.lit(upto).cast("long").alias("upto")), "topk-state")
        drop_scratch(ask)  # nothing reads the round before any more
        drop_scratch(before)
        width *= GROWTH
    drop_scratch(index)
    drop_scratch(classes)
    found = asked.join(state.select("v", "best"), "v")
    mine = F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, k)
    found = found.select(F.col("vec_id").alias("query_id"), F.posexplode(mine).alias("pos", "hit"))
    found = found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
    if again > 1:  # several rows of a query id: the best pairs of all of them
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found
