"""Filter audit, VA-file clustering and HNSW search against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from emporion.llm import filter_audit, hnsw, va_file

VECTORS = "vec_id long, embedding array<float>, label int"
LABELS = "doc_id long, quality int, toxic int"


# ---- operator 11 ---------------------------------------------------------------------------
def fails_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        letter for letter, bad in zip("ABCD", [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)),
        ]) if bad
    )


def audit_by_hand(docs, labels):
    least, good, toxic = {}, set(), set()
    for d, t, *_ in docs:
        least[t or ""] = min(least.get(t or "", math.inf), math.inf if d is None else d)
    for d, q, x in labels:
        good |= {d} if q == 1 and d is not None else set()
        toxic |= {d} if x == 1 and d is not None else set()
    out = {}
    shapley = defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for d, t, lang, *_ in docs:
            t, part = t or "", lang or ""
            fails = fails_of(t) + ("E" if (math.inf if d is None else d) > least[t] else "")
            gone = False
            for step, x in enumerate(order, 1):
                row = out.setdefault((part, order, step), dict(kept=0, removed=0, redundant=0, unique_fails=0, good_lost=0, toxic_lost=0))
                hit = x in fails
                row["unique_fails"] += fails == x
                row["redundant"] += hit and gone
                if hit and not gone:
                    row["removed"] += 1
                    row["good_lost"] += d in good
                    row["toxic_lost"] += d in toxic
                    shapley[part, x] += 1
                gone = gone or hit
                row["kept"] += not gone
    return {(p, o, s): (*r.values(), shapley[p, o[s - 1]]) for (p, o, s), r in out.items()}


@pytest.fixture(scope="module")
def audited(messy):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["ABCDEFGH", "a|b"]
    more = [(300 + i, " ".join(rng.sample(words, rng.randint(90, 130))), rng.choice(["en", "fr", None, ""])) for i in range(40)]
    more += [(400 + i, more[0][1], "fr") for i in range(60)] + [(None, more[1][1], "en"), (300, more[0][1], "de")]
    return [(d, t, lang) for d, t, lang, *_ in messy] + more


def test_audit_equals_counting_by_hand(spark, audited):
    labels = [(d, i % 2, i % 3 == 0) for i, (d, *_) in enumerate(audited)] + [(300, 0, 1), (300, 1, 0), (7, None, None), (None, 1, 1)]
    labels = [(d, q, None if x is None else int(x)) for d, q, x in labels]
    docs = spark.createDataFrame(audited, "doc_id long, text string, lang string")
    for clash in ("oid", "part", "mask", "digest", "n", "good", "toxic", "packed", "salt"):
        docs = docs.selectExpr("*", f"'clash' AS {clash}")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert all(r.filter_order[r.step - 1] == r["filter"] for r in got) and len(rows) == len(got)
    assert rows == audit_by_hand(audited, labels)


def test_audit_of_nothing_and_of_one_empty_text(spark, no_docs):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(no_docs, labels).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)], no_docs.schema)
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert sum(r.removed for r in rows) == 120 and {r.removed for r in rows if r["filter"] != "A"} == {0}


def test_audit_of_a_very_long_text(spark, no_docs):
    text = "Word and " * 1_000_000
    rows = filter_audit.audit(spark.createDataFrame([(1, text, "en", None, None)], no_docs.schema), spark.createDataFrame([(1, 1, 1)], LABELS)).collect()
    assert {r["filter"]: r.shapley for r in rows} == {"A": 0, "B": 60, "C": 60, "D": 0, "E": 0}


@pytest.mark.parametrize("width", [1, 7, 40])
def test_packed_fields_do_not_run_over(width):
    packed = filter_audit.outcomes("ABCDE", width)
    n = (1 << width) - 1  # the largest sum that a field may hold
    for mask, x in enumerate(packed):
        fields = filter_audit.unpacked(x * n, 601, width)
        assert fields[600] == n and sum(fields[:600]) == (120 * n if mask else 0)


# ---- operator 12 ---------------------------------------------------------------------------
def clusters_by_hand(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    name = lambda i: "z" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [list(v) for _, _, v in sorted((name(i), v, v) for i, v in kept)[:k]]
    for r in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        own = [min(range(len(centroids)), key=lambda c: (d[c], c)) for d in far]
        if r < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, own) if o == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    dist = [d[o] for d, o in zip(far, own)]
    inertia = [sum(d for d, o in zip(dist, own) if o == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, d, inertia[o], sum(dist), sha[o]) for (i, _), o, d in zip(kept, own, dist)), key=str)


def vectors(n, seed, groups=4, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, dim))
    return [(i, [float(np.float32(y)) for y in v], 0) for i, v in enumerate(x)]


ODD = [
    (9001, None, 0), (9002, [], 0), (9003, [1.0] * 63, 0), (9004, [None] * 64, 0), (9005, [float("nan")] * 64, 0),
    (9006, [float("inf")] * 64, 0), (None, [0.5] * 64, None), (9020, [0.0] * 64, 0), (9040, [-0.0] * 64, 0),
]


@pytest.mark.parametrize("bits", [2, 8])
def test_clusters_equal_brute_force(spark, bits):
    rows = vectors(300, 1) + ODD
    rows += [(500 + i, rows[3][1], 0) for i in range(150)] + [rows[5], (5, rows[6][1], 1)]  # a hot vector, repeated ids
    df = spark.createDataFrame(rows, VECTORS)
    for clash in ("rid", "v", "cells", "cluster", "distance"):
        df = df.selectExpr("*", f"'clash' AS {clash}")
    got = va_file.cluster(df, bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == clusters_by_hand(rows)


def test_clusters_of_few_and_no_vectors(spark):
    for rows in (vectors(3, 2), [], ODD[:6], [(1, [0.25] * 64, 0)] * 12):
        got = va_file.cluster(spark.createDataFrame(rows, VECTORS))
        assert sorted(map(tuple, got.collect()), key=str) == clusters_by_hand(rows)
        assert got.columns == [c.split()[0] for c in va_file.OUT.split(", ")]


def test_intervals_hold_the_distances_and_spare_vectors(spark):
    rows = vectors(2000, 3)
    c = va_file.Clustering(spark.createDataFrame(rows, VECTORS), 8, 64, 1024, 6, "3:", "vec_id", "embedding")
    assert c.round() and c.round()
    least, most = va_file.tables_of(c.low, c.width, c.centroids, c.bits)
    ref = np.rint(c.centroids.mean(0)).astype(np.int64)
    got = c.state.join(c.vectors, "rid").collect()
    v = np.array([r["v"] for r in got])
    lo, hi = va_file.intervals(np.array([list(r["cells"]) for r in got], np.uint8), least, most)
    d = ((v[:, None] - c.centroids[None]) ** 2).sum(2) - ((v - ref) ** 2).sum(1)[:, None]
    assert (lo <= d).all() and (d <= hi).all()
    marked = c.classified()
    assert marked.where("nearest = -1").count() < 1000  # grouped data: most rows need no vector
    join = marked.where("nearest <> cluster").hint("shuffle_hash").join(c.vectors, "rid")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in join and join.count("Exchange hashpartitioning") == 1  # of the codes only
    c.drop()
    with pytest.raises(ValueError, match="64 bits"):
        va_file.cluster(spark.createDataFrame([(1, [1e30] * 64, 0)], VECTORS))


# ---- operator 13 ---------------------------------------------------------------------------
def nearest_by_hand(rows, k=20, every=20):
    own = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own[i, tuple(v)] = np.array([np.float32(x) for x in v], np.float64)
    out = defaultdict(list)
    for (i, _), q in own.items():
        if i % every == 0:
            for (j, _), v in own.items():
                if i != j:
                    n = min(len(q), len(v))
                    out[i].append((-float((q[:n] * v[:n]).sum()), j))
    return {i: sorted(x)[:k] for i, x in out.items()}


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(y)) for y in v], 0) for i, v in enumerate(rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1)))]
    rows += [(1500 + i, rows[40][1], 0) for i in range(700)]  # a hot vector, far more than k rows
    rows += [(3000 + i, [y + 0.001 * (i + 1) for y in rows[60][1]], 0) for i in range(300)]  # near copies
    got = hnsw.nearest(spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS h", "2 AS shard", "3 AS block", "4 AS v"), shard_rows=400)
    by = defaultdict(list)
    for r in sorted(got.collect()):
        by[r.query_id].append((-r.score, r.vec_id))
        assert r["rank"] == len(by[r.query_id])
    want = nearest_by_hand(rows)
    assert by.keys() == want.keys() and all(len(x) == 20 and x == sorted(x) for x in by.values())
    place = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows}
    assert all(abs(-s - float((place[q] * place[j]).sum())) < 1e-9 for q, found in by.items() for s, j in found)
    hits = sum(len({j for _, j in by[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want), hits / len(want) / 20


def test_search_of_few_odd_and_no_vectors(spark):
    odd = ODD + [(20, [1.0, 2.0], 0), (21, [1.0, 2.0, 0.0], 0), (40, [1.0, 2.0, 3.0], 0), (41, [-1.0], 0), (20, [1.0, 2.0], 0), (20, [2.0], 0), (60, [1.0, 2.0], 0)]
    for rows in (odd, [], ODD[:6], [(20, [1.0], 0)], [(i, [1.0, 1.0], 0) for i in range(50)]):
        got = defaultdict(list)
        for r in hnsw.nearest(spark.createDataFrame(rows, VECTORS)).collect():
            got[r.query_id].append((-r.score, r.vec_id))
        want = nearest_by_hand(rows)
        if rows is odd:  # two vectors of id 20 are asked for
            assert sorted(got[40]) == sorted(want[40]) and len(got[20]) > len(want[60])
            assert {j for _, j in got[20]}.isdisjoint({20})
        else:
            assert got == want


def test_levels_are_flat_prefixes():
    rng = np.random.default_rng(1)
    x = hnsw.levelled(hnsw.scaled(rng.normal(size=(700, 8))))
    sizes = hnsw.draw_levels(700, 3, 4)
    links = hnsw.build_graph(x, sizes, m=4, ef=32)
    assert [len(lv) for lv in links] == sizes and sizes == sorted(sizes, reverse=True)
    assert links[0].shape[1] == 8 and all(lv.shape[1] == 4 for lv in links[1:])
    for lv in links:
        assert lv.max() < len(lv) and not (lv == np.arange(len(lv))[:, None]).any()
        assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in lv)
    assert np.allclose((x**2).sum(1), (x**2).sum(1).max(), rtol=1e-5)


def test_query_recall_on_the_driver_table(spark):
    from emporion.llm.queries import embeddings, op13_hnsw

    sf = "/root/testdata/sf0.01"
    want = nearest_by_hand([tuple(r) for r in embeddings(spark, sf).collect()])
    got = defaultdict(set)
    for r in op13_hnsw(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {j for _, j in x}) for q, x in want.items()) >= 0.95 * sum(map(len, want.values()))
