"""Exact, near and substring dedup against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from emporion.llm import components, exact_dedup, simhash, substring_dedup, suffix_dedup
from emporion.llm.passages import merged_spans

from .conftest import rows_of

LAST = 2**63 - 1
order = lambda d: LAST if d is None else d


def test_exact_dedup(docs, messy):
    groups = defaultdict(list)
    for d, t, *_ in messy:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(order(d))
    want = []
    for text, ids in groups.items():
        keep = min(ids)
        for i, d in enumerate(sorted(ids)):
            want.append((None if d == LAST else d, None if keep == LAST else keep, len(ids), i == 0, hashlib.sha256(text.encode()).hexdigest()))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(exact_dedup.exact_dedup(docs), *columns) == sorted(want, key=str)
    # One hash bit only: chains of many texts, whose bytes are compared.
    assert rows_of(exact_dedup.exact_dedup(docs, hash_bits=1), *columns) == sorted(want, key=str)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept.collect()) == sorted(groups)


def test_exact_dedup_index_is_read_by_bucket(spark, docs, monkeypatch):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = rows_of(exact_dedup.exact_dedup(docs), *columns)
    # Small buckets: a deep directory of several local depths.
    assert rows_of(exact_dedup.exact_dedup(docs, bucket_entries=3), *columns) == want
    rows = exact_dedup.hashed(docs)
    posted = exact_dedup.postings(rows)
    index, directory = exact_dedup.build_index(rows, posted, 3)
    buckets = [(r["bucket"], r["depth"]) for r in directory.collect()]
    assert len(buckets) == len(set(buckets)) and len({d for _, d in buckets}) > 1
    size = defaultdict(int)
    for r in index.collect():
        assert r["bucket"] == (r["key"] % 2**64) >> (64 - r["depth"]) and (r["bucket"], r["depth"]) in buckets
        size[r["bucket"], r["depth"]] += 1
    assert max(size.values()) <= 3
    # Without an index entry's bucket nothing is found: the lookup goes through the directory.
    moved = index.withColumn("bucket", index["bucket"] + 1)
    assert exact_dedup.probe(posted, moved, directory).count() < posted.count()
    # More shared hashes than may be sent to all tasks: the same rows.
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    assert rows_of(exact_dedup.exact_dedup(docs, hash_bits=2), *columns) == want


def test_equal_hashes_and_digests_are_not_enough(spark, monkeypatch):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(["one", "two", "three", "four", "five"] * 2)]  # two of them share a bit
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "digest", lambda: F.lit("same").alias("text_sha256"))
    with pytest.raises(PySparkException, match="other bytes"):
        exact_dedup.exact_dedup(docs, hash_bits=1).collect()


def test_exact_dedup_stays_in_the_jvm(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_extendible_directory_only_splits_overfull_buckets(spark):
    from pyspark.sql import functions as F

    from emporion.llm.extendible import split_overfull

    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("w"))
    rows = rows.unionByName(spark.range(900).select(F.lit(77).cast("long").alias("h"), F.lit(1).cast("long").alias("w")))
    got = split_overfull(rows, "h", "w", 100, doubling=30).collect()
    assert len(got) == 5900
    size = defaultdict(int)
    for r in got:
        assert r["bucket"] == ((r["h"] % 2**64) >> (64 - r["depth"]) if r["depth"] else 0) or r["depth"] == 64
        size[r["depth"], r["bucket"]] += 1
    assert all(n <= 100 for (d, _), n in size.items() if d < 64)
    assert size[64, 77] == 900 and len({d for d, _ in size}) > 2


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_dedup(docs, messy):
    fp = [brute_fingerprint(t or "") for _, t, *_ in messy]
    near = np.bitwise_count(np.array(fp, np.uint64)[:, None] ^ np.array(fp, np.uint64)[None, :]) <= 2
    reach = near
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = np.array([order(d) for d, *_ in messy])
    least = [int(ids[row].min()) for row in reach]
    want = [(m[0], f"{f:016x}", None if c == LAST else c) for m, f, c in zip(messy, fp, least)]
    assert rows_of(simhash.near_dedup(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({row.tobytes() for row in reach})


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
@pytest.mark.parametrize("n", [1, 64, 65, 700])
def test_bit_sliced_comparison(radius, n):
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(1, n, 2):
        for b in rng.integers(0, 64, 1 + i % 4):
            fp[i] = (fp[i - 1] if b else fp[i]) ^ np.uint64(1 << int(b))
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    want = {(i, j) for i, j in zip(*np.nonzero(close)) if i < j}
    assert {tuple(p) for p in simhash.linked_pairs(fp, radius, 100).tolist()} == want


def test_large_groups_are_cut_finer_without_losing_links(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (int(c) << 40) for a, b, c in rng.integers(0, 24, (600, 3))})
    place = {x: i for i, x in enumerate(fps)}
    classes = spark.createDataFrame([(x,) for x in fps], "fp long")

    def partition(edges):
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in edges:
            root[max(find(u), find(v))] = min(find(u), find(v))
        return [find(i) for i in range(len(fps))]

    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= 2
    want = partition(zip(*map(np.ndarray.tolist, np.nonzero(near))))
    for most in (4096, 50):
        got = [(place[r["u"]], place[r["v"]]) for r in simhash.links(classes, 2, most_rows=most).collect()]
        assert all(near[u, v] for u, v in got)
        assert partition(got) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 180)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 180)} | {301: 300, 302: 300}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_substrings(messy, length, words):
    least, units = {}, []
    for d, t, *_ in messy:
        u = (t or "").encode()
        u = u.split() if words else u
        units.append(u)
        for i in range(len(u) - length + 1):
            k = tuple(u[i : i + length])
            least[k] = min(order(d), least.get(k, LAST))
    out = []
    for (d, *_), u in zip(messy, units):
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if least[tuple(u[i : i + length])] < order(d):
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = [x for x, g in zip(u, gone) if not g]
        digest = hashlib.sha256(b" ".join(left) if words else bytes(left)).hexdigest()
        out.append((d, len(u), sum(gone), digest) if words else (d, len(u), sum(gone), runs, digest))
    return sorted(out, key=str)


SMALL = dict(chunk_bytes=2000, bucket_bytes=4000, most_bytes=6000)


@pytest.mark.parametrize("window, sizes", [(3, {}), (13, SMALL)])
def test_substring_dedup(docs, messy, window, sizes):
    got = rows_of(substring_dedup.substring_dedup(docs, window, **sizes), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(messy, window, True)


@pytest.mark.parametrize("length, sizes", [(50, {}), (9, {}), (50, SMALL)])
def test_suffix_dedup(docs, messy, length, sizes):
    got = rows_of(suffix_dedup.suffix_dedup(docs, length, **sizes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_substrings(messy, length, False)


def test_kept_texts(spark):
    shared = "the quick brown fox jumps over the lazy dog and runs far away home"
    df = spark.createDataFrame([(1, shared), (2, f"so {shared}  yes"), (3, None)], "doc_id long, text string")
    assert rows_of(substring_dedup.kept_texts(df), "doc_id", "text") == [(1, shared), (2, "so yes"), (3, "")]
    assert rows_of(suffix_dedup.kept_texts(df), "doc_id", "text") == [(1, shared), (2, "so   yes"), (3, "")]


def test_equal_names_of_different_windows_are_told_apart():
    big = b"abcabdabc" + b"-" * 9
    a = np.array([0, 3, 6])
    name = np.zeros(3, np.uint64)  # all collide
    got = substring_dedup._later(name, np.array([1, 2, 3]), big, a, a + 3)
    assert got.tolist() == [2]


def test_pieces_of_long_texts_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 37)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 37)
    text = " ".join(f"w{i}" for i in range(120)).encode()
    got = []
    for first, piece in substring_dedup._pieces(13)(text):
        words = piece.split()
        got += [(first + i, words[i]) for i in range(len(words) - 12)]
    assert got == [(i, f"w{i}".encode()) for i in range(108)]
    got = [(at + i, piece[i : i + 50]) for at, piece in suffix_dedup._pieces(50)(text) for i in range(len(piece) - 49)]
    assert got == [(i, text[i : i + 50]) for i in range(len(text) - 49)]


def test_merged_spans():
    got = merged_spans(np.array([1, 1, 1, 2, 1]), np.array([0, 0, 0, 0, 5]), np.array([8, 0, 2, 3, 4]), np.array([9, 5, 8, 4, 6]))
    assert [x.tolist() for x in got] == [[1, 1, 2], [0, 5, 0], [0, 4, 3], [9, 6, 4]]


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0
    assert simhash.near_dedup(no_docs).count() == 0
    assert simhash.drop_near_copies(no_docs).count() == 0
    assert substring_dedup.substring_dedup(no_docs).count() == 0
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0
