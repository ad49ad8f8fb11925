"""Bounds and brute-force versions of operators 3, 6, 7 and 8, and of the pipeline's stages."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from emporion.llm import extendible, mixing, quality_crf, secret_scan

from .test_dedup import brute_fingerprint


# ---- operator 3 ----------------------------------------------------------------------------
def labelled(n=240):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    line = lambda bad: " ".join(w.upper() + "!!" if bad else w for w in (word() for _ in range(9)))
    rows = [(d, "\n".join(line(d % 4 == 0) for _ in range(rng.randint(1, 5)))) for d in range(n)]
    return rows, [(d, int(d % 4 != 0)) for d in range(n)]


def test_document_score_is_the_length_weighted_mean_of_enumerated_marginals(spark):
    rows, labels = labelled()
    model = quality_crf.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    texts = [rows[0][1], rows[1][1], "", "One line.", rows[2][1] + "\n\n" + rows[4][1], "é\n|||\n!!!\nabc", "x " * 3000 + "\nend"]
    got = quality_crf.document_scores(model, [t.encode() for t in texts])
    for text, score in zip(texts, got):
        lines = [x.encode() for x in text.split("\n")]
        alone = [(quality_crf.line_features([x])[0][0] - model.mean) / model.scale for x in lines]
        weight = model.weight
        width = len(alone[0])
        bias = len(weight) - 3 * width
        emit = []
        for i, own in enumerate(alone):
            around = [alone[j] if 0 <= j < len(alone) else np.zeros(width) for j in (i - 1, i + 1)]
            plain = quality_crf.with_neighbours(np.array(alone), np.array([len(alone)]))[i]
            assert sorted(np.round(plain[:].tolist(), 9)) == sorted(np.round(np.concatenate([own, *around, plain[3 * width :]]).tolist(), 9)) and bias == len(plain) - 3 * width
            emit.append(float(plain @ weight))
        z, good = 0.0, [0.0] * len(lines)
        for y in itertools.product((0, 1), repeat=len(lines)):
            w = math.exp(sum(e for e, on in zip(emit, y) if on) + sum(model.moves[a, b] for a, b in zip(y, y[1:])))
            z += w
            good = [g + w * on for g, on in zip(good, y)]
        size = [len(x) + 1 for x in lines]
        assert score == pytest.approx(sum(g / z * n for g, n in zip(good, size)) / sum(size), abs=1e-9)


def test_a_repeated_id_and_long_documents_are_learned_from_once_and_bounded(spark):
    rows, labels = labelled()
    hot = next(d for d, _ in rows if d % 4 == 0 and spark.sql(f"SELECT crc32('{d}') % 5 AS f").first().f)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = lambda r: spark.createDataFrame(r, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS y", "3 AS lines", "4 AS x")
    plain = quality_crf.train(docs(rows), table)
    again = quality_crf.train(docs(rows + [(hot, dict(rows)[hot])] * 150), table)  # a third of the table
    assert np.array_equal(plain.weight, again.weight) and np.array_equal(plain.moves, again.moves)
    long = [(10_000 + i, "\n".join(["fine words here"] * 400_000)) for i in range(3)]
    marks = spark.createDataFrame(labels + [(d, 1) for d, _ in long], "doc_id long, quality int")
    bounded = quality_crf.train(docs(rows + long), marks, train_lines=2000)  # the long ones do not fit, the others do
    assert np.array_equal(plain.weight, bounded.weight)
    assert quality_crf.train(docs(rows), table, train_lines=0) is None
    scored = quality_crf.quality_scores(docs(rows + long), plain).collect()
    assert len(scored) == len(rows) + 3 and all(0 <= r.score <= 1 for r in scored)


# ---- operator 6 ----------------------------------------------------------------------------
def brute_cells(hashes, weights, limit):
    """The shortest prefix of each hash whose rows fit the limit."""
    out, todo = {}, [("", list(range(len(hashes))))]
    while todo:
        prefix, own = todo.pop()
        if sum(weights[i] for i in own) <= limit or len(prefix) == 64:
            out |= {i: prefix for i in own}
            continue
        for bit in "01":
            todo.append((prefix + bit, [i for i in own if f"{hashes[i] % 2**64:064b}"[len(prefix)] == bit]))
    return out


def test_cells_are_the_shortest_prefixes_that_fit(spark):
    rng = random.Random(9)
    h = [rng.getrandbits(64) - 2**63 for _ in range(800)] + [rng.getrandbits(40) for _ in range(300)]  # some crowd into one corner
    w = [rng.randint(1, 30) for _ in h]
    rows = spark.createDataFrame(list(zip(range(len(h)), h, w)), "i long, h long, w long")
    want = brute_cells(h, w, 200)
    got = extendible.split_overfull(rows, "h", "w", 200).collect()
    assert {r.i: (r.depth, r.bucket % 2**64) for r in got} == {i: (len(p), int(p, 2) if p else 0) for i, p in want.items()}


# ---- operator 7 ----------------------------------------------------------------------------
def test_a_scan_with_nothing_new_reads_no_text_and_a_small_one_moves_none(spark):
    docs = spark.createDataFrame([(i, f"token = abcdef{i:06d} ſ") for i in range(500)], "doc_id long, text string").selectExpr("*", "1 AS blob", "2 AS oid", "3 AS pairs")
    ledger = secret_scan.new_ledger(spark)
    first = sorted(map(tuple, secret_scan.secret_report(docs, ledger).collect()))
    batches = sorted(os.listdir(ledger))
    assert sorted(map(tuple, secret_scan.secret_report(docs, ledger).collect())) == first
    assert sorted(os.listdir(ledger)) == batches  # nothing was scanned
    one = docs.unionByName(spark.createDataFrame([(1000, "AKIA" + "B" * 20 + " " * 3_000_000)], "doc_id long, text string").selectExpr("*", "1 AS blob", "2 AS oid", "3 AS pairs"))
    seen = []
    join = type(docs).join

    def watched(self, other, *a, **k):
        out = join(self, other, *a, **k)
        if {"text", "oid"} <= set(self.columns):
            seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    type(docs).join = watched
    try:
        got = {r.doc_id: r.n_access for r in secret_scan.secret_report(one, ledger).collect()}
    finally:
        type(docs).join = join
    assert got[1000] == 1 and len(got) == 501 and len(os.listdir(ledger)) == len(batches) + 1
    assert seen and all("BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p for p in seen)


# ---- operator 8 ----------------------------------------------------------------------------
def test_thresholds_take_the_nearest_prefix_in_hash_order(spark):
    rng = random.Random(12)
    rows = [(s, rng.randint(0, 40), rng.getrandbits(mixing.HASH_BITS)) for s in ("a", "b", None) for _ in range(300)]
    rows += [("a", 7, rows[0][2])] * 5  # equal hashes go together
    budgets = [(s, e, b) for s in ("a", "b", None) for e, b in enumerate((0.0, 900.5, 3333.0, 1e9))]
    got = mixing.thresholds(spark.createDataFrame(rows, "source string, size long, h long"), spark.createDataFrame(budgets, "source string, epoch int, budget double"))
    cut = {(r.source, r.epoch): r.threshold for r in got.collect()}
    assert len(cut) == len(budgets)
    for s, e, budget in budgets:
        own = sorted((h, n) for source, n, h in rows if source == s)
        prefix = {0}
        for h in {h for h, _ in own}:
            prefix.add(sum(n for g, n in own if g <= h))
        taken = sum(n for h, n in own if h < cut[s, e])
        assert taken in prefix and abs(taken - budget) == min(abs(p - budget) for p in prefix)


def test_a_hundred_thousand_sources(spark):
    table = spark.range(100_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'w w w w' ELSE 'w' END AS text", "concat('s', id) AS source")
    got = mixing.mix(table)
    row = got.selectExpr("count(*) AS n", "count(DISTINCT source) AS s", "sum(size) AS size", "sum(target) AS target", "max(taken / size) AS most").first()
    assert (row.n, row.s, row["size"]) == (100_000, 100_000, 250_000) and row.target == pytest.approx(375_000) and row.most <= 2


# ---- the pipeline --------------------------------------------------------------------------
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def staged(spark, messy):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = list(messy)
    for g in range(12):  # groups of near copies: one word of many differs
        text = [rng.choice(words) for _ in range(300)]
        for c in range(rng.randint(2, 6)):
            other = list(text)
            other[rng.randrange(300)] = f"x{c}"
            rows.append((1000 + 10 * g + c, " ".join(other), "en", f"s{g % 3}", 0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' AS fp", "'clash' AS rk", "'clash' AS h", "'clash' AS size", "'clash' AS copies", "'clash' AS score")


def test_near_stage_keeps_the_smallest_id_of_every_brute_force_component(spark, staged):
    rows = [r for r in staged if r[0] is not None]
    fp = np.array([brute_fingerprint(t or "") for _, t, *_ in rows], np.uint64)
    reach = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    for _ in range(10):
        reach = reach.astype(int) @ reach.astype(int) > 0
    want = {min(rows[j][0] for j in np.flatnonzero(row)) for row in reach}
    got = P.near(spark, frame(spark, rows), None)
    assert Counter(r.doc_id for r in got.collect()) == Counter(want) and got.columns == frame(spark, rows).columns


def test_mixing_stage_takes_what_independent_targets_allow(spark, staged):
    rows = [(i, t, lang, s, n) for i, (_, t, lang, s, n) in enumerate(staged)]
    got = Counter(r.doc_id for r in P.mix(spark, frame(spark, rows), None).collect())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    total, largest = Counter(), Counter()
    for i, _, _, s, _ in rows:
        total[s] += size[i]
        largest[s] = max(largest[s], size[i])
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(total.values())
    while free:  # share out; what is above twice a source's size stops there
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > 2 * total[s]]
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest -= target[s]
            free.remove(s)
    for s in order:
        taken = sum(n * size[i] for i, n in got.items() if rows[i][3] == s)
        assert abs(taken - target[s]) <= largest[s], s
    assert max(got.values()) <= 2 and all(size[i] for i in got)


def test_bpe_stage_encodes_every_document_like_the_library(spark, staged):
    from emporion.llm import bpe
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = []
    for d, t, *_ in staged:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in P.tokens(spark, frame(spark, staged), None).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_of_empty_and_of_odd_tables(spark, tmp_path, staged):
    for name, rows in (("empty", []), ("odd", staged)):
        root = str(tmp_path / name)
        frame(spark, rows).write.parquet(f"{root}/documents.parquet")
        spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
        docs = frame(spark, rows)
        for stage, run in P.STAGES[:-1]:
            assert run(spark, docs, root).columns == docs.columns, stage
        got = P.run(spark, root).collect()
        assert bool(got) == bool(rows) and {r.doc_id for r in got} <= {r[0] for r in rows}
