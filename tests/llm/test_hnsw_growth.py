"""The work of a query on many shards: narrower walks and fewer shards, with the recall kept."""

import numpy as np

from emporion.llm import hnsw


def test_many_shards_share_the_walk(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 24))
    asked = []
    search = hnsw.search
    monkeypatch.setattr(hnsw, "search", lambda index, shards, q, dim, k, ef: asked.append((shards, ef)) or search(index, shards, q, dim, k, ef))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in hnsw.nearest(rows, shard_rows=300).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert asked == [(8, 96)]
    hits = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.97 * 20 * len(got) and len(got) == 120


def test_shards_and_walks_by_size():
    assert [hnsw.beam(128, s) for s in (1, 2, 3, 4, 1000)] == [128, 128, 96, 96, 96]
    assert hnsw.beam(40, 9) == 40
    assert [hnsw.rows_a_shard(n, 64) for n in (1, 51_282)] == [4096, 4096]
    few, many = (n / hnsw.rows_a_shard(n, 64) for n in (200_000, 3_200_000))
    assert many < 4.1 * few  # sixteen times the rows
    assert hnsw.rows_a_shard(10**9, 64) * 64 * 8 <= 32 << 20
    assert hnsw.rows_a_shard(10**9, 10**6) == 4096
