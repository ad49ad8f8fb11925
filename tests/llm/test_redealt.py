"""Buckets over their limit: strings are cut again by longer minimisers, no window is lost."""

import random

import numpy as np
import pytest

from emporion.llm import passages, substring_dedup, suffix_dedup

from .conftest import rows_of
from .test_dedup import SMALL, brute_substrings

rng = random.Random(9)
PARTS = ["the", "ing", "er", "on", "tion", "and", "a", "sh", "ou", " ", " ", ", ", "wh", "th"]
TEXTS = ["".join(rng.choice(PARTS) for _ in range(400)) for _ in range(40)]
TEXTS += [TEXTS[3][:500] + TEXTS[4], "ab" * 300 + TEXTS[5], " the" * 200, "y z " * 90]


def shipped(method):
    cutter = passages._cutter(method, 1, 1 << 30)
    batch = passages.pa.RecordBatch.from_arrays([passages.pa.array(range(len(TEXTS))), passages.pa.array([7] * len(TEXTS)), passages.pa.array([t.encode() for t in TEXTS])], ["oid", "rk", "text"])
    return list(cutter([batch]))


def opened(batches, split):
    """Windows (document, first unit, text) that travel or are settled, and the raw bytes that travel."""
    found, raw = [], 0
    for b in batches:
        for payload, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if payload is None:
                continue
            raw += size
            (_, oid, count, rk, start, step, copies), texts = passages._unpack(payload)
            assert set(rk.tolist()) == {7}
            own = np.repeat(np.arange(len(texts)), count)
            for i, s, st, c in zip(own.tolist(), start.tolist(), step.tolist(), copies.tolist()):
                found += [(int(oid[i]), s + k * st + j, w) for k in range(c) for j, w in enumerate(split(texts[i]))]
    return found, raw


def words(text, n=13):
    w = text.split()
    return [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def letters(text, n=50):
    return [text[i : i + n] for i in range(len(text) - n + 1)]


@pytest.mark.parametrize("gram", [8, 12, 16, None])
def test_strings_dealt_out_again_hold_every_window(gram):
    method, split = (suffix_dedup.byte_method(50, gram), letters) if gram else (substring_dedup.word_method(), words)
    batches = shipped(method)
    least = {}
    for d, t in enumerate(TEXTS):
        for w in split(t.encode()):
            least.setdefault(w, d)
    before = opened(batches, split)
    size = []
    for turn in (1, 2, 3):
        kept = [b.filter(b.column(1).is_valid()) for b in batches]
        batches = list(passages._comparer(method, 1, turn, 0)(kept))
        now, raw = opened(batches, split)
        size.append(raw / before[1])
        assert len(now) == len(set(now))
        assert {x for x in now if least[x[2]] == x[0]} == {x for x in before[0] if least[x[2]] == x[0]}  # a window's first document keeps all its places
        assert set(now) <= set(before[0])
    assert {w for _, _, w in now} == set(least)
    # Single windows take fourteen times the bytes and more; cut by longer minimisers strings stay together.
    assert size[0] < 4 and size[0] < size[1] < size[2]


@pytest.mark.parametrize("more", [(0, 1 << 60), (0, 0)])
@pytest.mark.parametrize("sizes", [{}, SMALL, dict(chunk_bytes=700, bucket_bytes=500, most_bytes=300)])
def test_longer_grams_of_large_inputs_equal_brute_force(spark, monkeypatch, more, sizes):
    monkeypatch.setattr(suffix_dedup, "MORE_BYTES", more)
    rows = [*enumerate(TEXTS), (None, TEXTS[3]), (50, "ä" * 60 + TEXTS[2]), (51, None), (51, "x" * 49)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **sizes)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_substrings(rows, 50, False)


def test_first_gram_grows_with_the_text():
    assert [suffix_dedup.first_gram(n) for n in (0, 1 << 30, 2 << 30, 257 << 30)] == [8, 8, 12, 16]
    assert suffix_dedup.first_gram(257 << 30, 9) == 9
    assert [passages.longer(8, 50, turn) for turn in range(5)] == [8, 22, 36, 50, 50]
