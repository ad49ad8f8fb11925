"""Operator 13, approximate nearest neighbours by largest inner product: a hierarchical navigable
small-world graph for each shard, stored as flat neighbour arrays, with shard results merged.

Shards: equal vectors are one node (with the k + 1 smallest ids, all that can ever be among a
query's best k), so a vector that fills a third of the table does not cut the graph apart; nodes
are dealt out by a hash of the vector into shards of about ``shard_rows``, which grows with the root
of the rows (up to SHARD_BYTES of vectors), since every query visits every shard.

Graph: a task builds the graph of one shard.  Levels are drawn from a hash of the vector; nodes are
numbered from the highest level down, so level l is a flat array of neighbour numbers for the
first so many nodes, -1 where there is none.  Nodes go in by blocks: each block is searched for in
the graph so far, level by level, and its own nodes are compared with one another; neighbours
are chosen so that none is nearer to another chosen one than to the node, filled up with the next
best, and get links back, pruned the same way.  Inner products become distances by one further
coordinate that brings all vectors of the shard to one norm; the search itself needs none.

Search: blocks of queries are sent to every shard, where a whole block walks the graph in step
with a beam of ``ef`` nodes a query, fewer (down to SHARD_EF) where many shards share a query's best.  Scores are inner products of the original vectors in double
precision, added up in a fixed order, so equal vectors have equal scores in every shard.  A
shard's best are one packed row a block; the merge keeps a running best for each block.

Defined cases: vectors that are null, zero (or empty) or hold null or non-finite components take no
part; a null id takes no part; shorter vectors count as filled up with zeros; rows that are equal
in id and vector count once; of several vectors of one id each is a candidate, each is asked for,
and none is an answer for that id; ties go to the smaller id; fewer candidates than k give all;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporion.llm.common import materialize, partitions_for, ship_code
from emporion.llm.topk import classes_of

TOP_K, EVERY = 20, 20  # fixed values
SHARD_ROWS, SHARD_ROOT = 4096, 160  # rows of a shard: so many, or the root of so many times all rows if that is more
SHARD_BYTES = 32 << 20  # vectors of a shard that is over SHARD_ROWS
LINKS = 16  # neighbours of a node, twice as many on the lowest level
BUILD_EF, EF, SHARD_EF = 96, 128, 96
EXPAND = 4  # nodes of a beam whose neighbours are looked at together
BLOCK = 256  # nodes or queries that walk in step
QUERIES_A_TASK = 1 << 16  # queries that one task takes to a shard


# ---- the graph ----------------------------------------------------------------------------
def search_level(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` best nodes that walks from ``entry`` (query, node; -1 none) find, and their inner
    products, best first; -1 and -inf where there are fewer."""
    b, n = len(q), len(links)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)
    ids = np.full((b, ef), -1, np.int64)
    sim = np.full((b, ef), -np.inf, np.float32)
    entry = entry[:, :ef]
    ids[:, : entry.shape[1]] = entry
    sim[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("bed,bd->be", x[entry], q), -np.inf)
    r, c = np.nonzero(entry >= 0)
    seen[r, entry[r, c]] = True
    open_ = ids >= 0
    step = min(EXPAND, ef)
    while True:
        rank = np.where(open_, sim, -np.inf)
        top = np.argpartition(-rank, step - 1, axis=1)[:, :step] if step < ef else np.broadcast_to(np.arange(ef), rank.shape)
        go = np.take_along_axis(rank, top, 1) > -np.inf
        act = np.flatnonzero(go.any(1))
        if not len(act):
            break
        top, go = top[act], go[act]
        node = np.where(go, ids[act[:, None], top], -1)
        open_[act[:, None], top] = False
        new = np.where((node >= 0)[:, :, None], links[node], -1).reshape(len(act), -1)
        new.sort(1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        fresh = (new >= 0) & ~seen[act[:, None], new]
        r, c = np.nonzero(fresh)
        seen[act[r], new[r, c]] = True
        near = np.full(new.shape, -np.inf, np.float32)
        near[r, c] = np.einsum("nd,nd->n", x[new[r, c]], q[act[r]])
        both = np.concatenate([sim[act], near], 1)
        best = np.argpartition(-both, ef - 1, axis=1)[:, :ef]
        sim[act] = np.take_along_axis(both, best, 1)
        ids[act] = np.where(sim[act] > -np.inf, np.take_along_axis(np.concatenate([ids[act], new], 1), best, 1), -1)
        open_[act] = np.take_along_axis(np.concatenate([open_[act], fresh], 1), best, 1)
    order = np.argsort(-sim, axis=1, kind="stable")
    return ids[rows[:, None], order], sim[rows[:, None], order]


def chosen(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the candidates (row, node; -1 none) of each row: best first, those that are
    nearer to one chosen before than to the row only if there is room left."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    out = np.full((len(cand), most), -1, np.int64)
    for at in range(0, len(cand), BLOCK):
        own, s = cand[at : at + BLOCK], sim[at : at + BLOCK]
        v = x[own]
        pair = v @ v.transpose(0, 2, 1)
        real = (own >= 0) & (s > -np.inf)
        taken = np.zeros(own.shape, bool)
        reach = np.full(own.shape, -np.inf, np.float32)  # nearness to the nearest chosen one
        for j in range(own.shape[1]):
            ok = real[:, j] & (reach[:, j] < s[:, j]) & (taken.sum(1) < most)
            taken[:, j] = ok
            reach[ok] = np.maximum(reach[ok], pair[ok, j])
        place = np.argsort(np.where(taken, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
        got = np.where(np.take_along_axis(real, place, 1), np.take_along_axis(own, place, 1), -1)
        out[at : at + len(own), : got.shape[1]] = got
    return out


def link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, picked: np.ndarray) -> None:
    """Give the neighbours ``picked`` of the nodes ``new`` links to them."""
    most = links.shape[1]
    r, c = np.nonzero(picked >= 0)
    frm, to = picked[r, c], new[r]
    s = np.einsum("nd,nd->n", x[frm], x[to])
    order = np.lexsort((-s, frm))
    frm, to, s = frm[order], to[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], frm[1:] != frm[:-1]])) if len(frm) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(frm)))
    place = np.arange(len(frm)) - np.repeat(first, count)
    node, row = frm[first], np.repeat(np.arange(len(first)), count)
    few = (place < most) & (links[frm] != to[:, None]).all(1)
    cand = np.full((len(first), 2 * most), -1, np.int64)
    cand[:, :most] = links[node]
    cand[row[few], most + place[few]] = to[few]
    for at in range(0, len(node), BLOCK):
        own, who = cand[at : at + BLOCK], node[at : at + BLOCK]
        sim = np.where(own >= 0, np.einsum("ncd,nd->nc", x[own], x[who]), -np.inf).astype(np.float32)
        links[who] = chosen(x, own, sim, most)


def build_graph(x: np.ndarray, sizes: list[int], m: int = LINKS, ef: int = BUILD_EF) -> list[np.ndarray]:
    """Neighbour arrays by level for the rows of ``x`` (float32, all of one norm); level l holds the
    first ``sizes[l]`` rows."""
    links = [np.full((n, 2 * m if level == 0 else m), -1, np.int64) for level, n in enumerate(sizes)]
    levels = np.zeros(len(x), np.int64)
    for level, n in enumerate(sizes):
        levels[:n] = level
    at = 0
    while at < len(x):
        level = int(levels[at])
        to = min(at + min(BLOCK, max(16, at)), sizes[level])
        new, q = np.arange(at, to), x[at:to]
        entry = np.zeros((len(new), 1), np.int64)
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        for lv in range(len(sizes) - 1 if at else level, -1, -1):
            if lv > level:
                entry = search_level(x, links[lv], q, entry, 1)[0]
                continue
            if at:
                ids, sim = search_level(x, links[lv][:at], q, entry, ef)
                entry = ids
            else:
                ids, sim = np.full((len(new), 0), -1, np.int64), np.empty((len(new), 0), np.float32)
            few = np.argsort(-among, axis=1, kind="stable")[:, : 2 * m]
            cand = np.concatenate([ids, new[few]], 1)
            near = np.concatenate([sim, np.take_along_axis(among, few, 1)], 1)
            picked = chosen(x, cand, near, m)
            own = np.full((len(new), links[lv].shape[1]), -1, np.int64)
            own[:, :m] = picked
            links[lv][at:to] = own
            link_back(x, links[lv], new, picked)
        at = to
    return links


def draw_levels(n: int, seed: int, m: int) -> list[int]:
    """Sizes of the levels for ``n`` nodes."""
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(np.int64)
    return [n, *(int((level >= lv).sum()) for lv in range(1, int(level.max()) + 1))]


def scaled(x: np.ndarray, each: bool = False) -> np.ndarray:
    """The vectors (or ``each`` by itself) brought to components of 1 at most."""
    return (x / np.abs(x).max(axis=1 if each else None, keepdims=True)).astype(np.float32)


def levelled(x: np.ndarray) -> np.ndarray:
    """With one further coordinate that gives all rows the same norm."""
    norm = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(0, norm.max() - norm))[:, None]], 1).astype(np.float32)


# ---- index --------------------------------------------------------------------------------
INDEX = "shard long, vectors binary, ids binary, id_counts binary, sizes binary, links binary"


def _filled(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of a matrix, filled up with zeros."""
    lens = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(lens), dim))
    at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    out[np.repeat(np.arange(len(lens)), lens), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _builder(dim: int, m: int, ef: int):
    """Rows (shard, h, v, ids), sorted by shard and hash: the packed graph of each shard."""

    def packed(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        v, ids = (t[c].chunk(0) for c in ("v", "ids"))
        x = _filled(v, dim)
        sizes = draw_levels(len(x), shard, m)  # the rows are in order of a hash: any of them may be the top
        links = build_graph(levelled(scaled(x)), sizes, m, ef)
        flat = np.concatenate([lv.ravel() for lv in links]).astype(np.int32)
        counts = ids.value_lengths().to_numpy().astype(np.int64)
        cols = [pa.array([shard], pa.int64())]
        cols += [pa.array([a.tobytes()], pa.binary()) for a in (x, ids.flatten().to_numpy(), counts, np.array(sizes, np.int64), flat)]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            shard = b.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for s, e in zip(edge, edge[1:]):
                if s == e:
                    continue
                if held and int(shard[s]) != now:
                    yield packed(now, held)
                    held = []
                now = int(shard[s])
                held.append(b.slice(s, e - s))
        if held:
            yield packed(now, held)

    return run


class Shard:
    """A shard's graph, read back from its packed row."""

    def __init__(self, vectors: bytes, ids: bytes, counts: bytes, sizes: bytes, links: bytes, dim: int):
        self.x = np.frombuffer(vectors).reshape(-1, dim)
        self.ids, self.count = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.steer = scaled(self.x)
        sizes, flat, at = np.frombuffer(sizes, np.int64).tolist(), np.frombuffer(links, np.int32), 0
        width = len(flat) // (2 * sizes[0] + sum(sizes[1:]))  # twice as wide on the lowest level
        self.links = []
        for level, n in enumerate(sizes):
            w = 2 * width if level == 0 else width
            self.links.append(flat[at : at + n * w].reshape(n, w).astype(np.int64))
            at += n * w

    def nodes(self, q: np.ndarray, ef: int) -> np.ndarray:
        """The ``ef`` best nodes for each query; -1 where there are fewer."""
        q = scaled(q, each=True)
        entry = np.zeros((len(q), 1), np.int64)
        for lv in range(len(self.links) - 1, 0, -1):
            entry = search_level(self.steer, self.links[lv], q, entry, 1)[0]
        return search_level(self.steer, self.links[0], q, entry, min(ef, len(self.x)))[0]

    def best(self, qid: np.ndarray, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows for each query, -inf and -1 where there are fewer."""
        node = self.nodes(q, max(ef, k + 1))
        r, c = np.nonzero(node >= 0)
        own = node[r, c]
        score = np.concatenate([(self.x[own[s : s + 65536]] * q[r[s : s + 65536]]).sum(1) for s in range(0, len(own), 65536)] or [np.empty(0)])
        n = self.count[own]
        who = self.ids[np.repeat(self.first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        r, score = np.repeat(r, n), np.repeat(score, n)
        other = who != qid[r]
        return ranked(r[other], score[other], who[other], len(q), k)


def ranked(row: np.ndarray, score: np.ndarray, who: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each of ``n`` rows; ties to the smaller id."""
    order = np.lexsort((who, -score, row))
    row, score, who = row[order], score[order], who[order]
    first = np.searchsorted(row, np.arange(n))
    place = np.arange(len(row)) - first[row]
    few = place < k
    scores, ids = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
    scores[row[few], place[few]], ids[row[few], place[few]] = score[few], who[few]
    return scores, ids


MEET = "cell long, kind int, shard long, vectors binary, ids binary, id_counts binary, sizes binary, links binary, block long, qids binary, q binary"
FOUND = "block long, qids binary, scores binary, found binary"


def _searcher(dim: int, k: int, ef: int):
    """Rows sorted by (cell, kind): a shard's graph, then the query blocks for it."""

    def run(batches):
        shard = None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                if row.column(1)[0].as_py() == 0:
                    shard = Shard(*(row.column(c)[0].as_py() for c in range(3, 8)), dim)
                    continue
                qids, q = row.column(9)[0].as_py(), row.column(10)[0].as_py()
                scores, ids = shard.best(np.frombuffer(qids, np.int64), np.frombuffer(q).reshape(-1, dim), k, ef)
                cols = [row.column(8), pa.array([qids], pa.binary()), pa.array([scores.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "qids", "scores", "found"])

    return run


def _merger(k: int):
    """Rows sorted by block: the k best of all shards, a row for each query and rank."""

    def rows(qids, scores, ids):
        r, c = np.nonzero(ids >= 0)
        cols = [pa.array(qids[r]), pa.array((c + 1).astype(np.int32)), pa.array(ids[r, c]), pa.array(scores[r, c])]
        return pa.RecordBatch.from_arrays(cols, ["query_id", "rank", "vec_id", "score"])

    def run(batches):
        now = None
        for b in batches:
            for block, qids, scores, found in zip(*(c.to_pylist() for c in b.columns)):
                scores, found = np.frombuffer(scores).reshape(-1, k), np.frombuffer(found, np.int64).reshape(-1, k)
                if block != now:
                    if now is not None:
                        yield rows(*best)
                    now, best = block, (np.frombuffer(qids, np.int64), scores, found)
                    continue
                s, f = np.concatenate([best[1], scores], 1), np.concatenate([best[2], found], 1)
                r, c = np.nonzero(f >= 0)
                best = (best[0], *ranked(r, s[r, c], f[r, c], len(s), k))
        if now is not None:
            yield rows(*best)

    return run


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, equal rows once, without zeros at the end of v."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    fine = fine & F.exists(x, lambda c: c != 0)
    last = F.array_max(F.transform(x, lambda c, i: F.when(c != 0, i + 1)))
    rows = table.where(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.slice(x, 1, last).alias("v")).distinct()


def build_index(rows: DataFrame, dim: int, n: int, k: int, shard_rows: int, m: int, build_ef: int) -> tuple[DataFrame, int]:
    """One packed graph a shard, written to the shared folder, and the number of shards."""
    shards = partitions_for(n, shard_rows)
    nodes = classes_of(rows, k).select(F.xxhash64("v").alias("h"), "v", "ids").withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    dealt = nodes.repartitionById(shards, "shard").sortWithinPartitions("shard", "h", F.col("ids")[0])
    graphs = dealt.select(F.col("shard").cast("long"), "h", "v", "ids").mapInArrow(_builder(dim, m, build_ef), INDEX)
    return materialize(graphs, "hnsw-index"), shards


def _blocks(dim: int):
    """Packed blocks of queries (block, qids, q)."""

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                cols = [pa.array([serial]), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([_filled(part.column(1), dim).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "qids", "q"])
                serial += 1

    return run


def search(index: DataFrame, shards: int, asked: DataFrame, dim: int, k: int, ef: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows (vec_id, v) of ``asked``."""
    blocks = materialize(asked.mapInArrow(_blocks(dim), "block long, qids binary, q binary"), "hnsw-queries")
    groups = partitions_for(blocks.count() * BLOCK, QUERIES_A_TASK)  # a shard's queries are split over so many tasks
    group = F.pmod(F.xxhash64("block"), F.lit(groups))

    def upto(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    graphs = index.withColumn("part", upto(groups)).withColumn("cell", F.col("shard") * groups + F.col("part")).withColumn("kind", F.lit(0))
    sent = blocks.withColumn("part", upto(shards)).withColumn("cell", F.col("part") * groups + group).withColumn("kind", F.lit(1))
    met = graphs.unionByName(sent, allowMissingColumns=True).select(*[c.split()[0] for c in MEET.split(", ")])
    met = met.repartitionById(shards * groups, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")
    found = met.mapInArrow(_searcher(dim, k, ef), FOUND)
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(_merger(k), "query_id long, rank int, vec_id long, score double")


def rows_a_shard(n: int, dim: int) -> int:
    """Building costs a little more a row in larger shards, searching as many times less as there are fewer."""
    return max(SHARD_ROWS, min(math.isqrt(SHARD_ROOT * n), SHARD_BYTES // (8 * dim)))


def beam(ef: int, shards: int) -> int:
    """Nodes of a walk: a shard has about k / shards of the best k rows."""
    return min(ef, max(SHARD_EF, 2 * ef // shards))


def nearest(
    table: DataFrame, k: int = TOP_K, every: int = EVERY, shard_rows: int | None = None, links: int = LINKS,
    build_ef: int = BUILD_EF, ef: int = EF, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query, a row whose id is
    divisible by ``every``."""
    spark = table.sparkSession
    ship_code(spark)
    rows = materialize(usable(table, id_col, vector_col), "hnsw-rows")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, shards = build_index(rows, dim, n, k, shard_rows or rows_a_shard(n, dim), links, build_ef)
    return search(index, shards, rows.where(F.col("vec_id") % every == 0), dim, k, beam(ef, shards))
