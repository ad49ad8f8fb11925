"""Runs of few letters, which hold one string at very many places: results and memory."""

import subprocess
import sys

import numpy as np
import pytest

from emporion.llm import suffix_dedup

from .conftest import rows_of
from .test_dedup import brute_substrings

RUNS = ["a" * 900, "ab" * 400, "abc" * 300, " \n" * 300, "    \n" * 200, "x" * 49 + "y" * 60, "a" * 120 + "b" + "a" * 200, "0123456789" * 80, "-" * 51]


@pytest.mark.parametrize("slice_bytes", [64, 1 << 20])
@pytest.mark.parametrize("sizes", [{}, dict(chunk_bytes=700, bucket_bytes=500, most_bytes=300)])
def test_runs_equal_brute_force(spark, monkeypatch, slice_bytes, sizes):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)  # tasks fork this process's settings only if not yet started
    rows = [(i, t) for i, t in enumerate(RUNS)] + [(20 + i, t[7:] + "tail" + t[:300]) for i, t in enumerate(RUNS)] + [(0, RUNS[1]), (None, RUNS[2])]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **sizes)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_substrings(rows, 50, False)


@pytest.mark.parametrize("slice_bytes", [100, 1 << 20])
def test_cut_strings_hold_every_window_once(monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    texts = [t.encode() for t in RUNS if len(t) >= 50]
    one = np.arange(len(texts))
    s = suffix_dedup._cut(50)(texts, one, 0 * one, 0 * one)
    got = sorted(
        (int(d), int(a) + m * int(step) + i, t[i : i + 50])
        for t, d, a, n, step, copies in zip(s.text, s.oid, s.start, s.windows, s.step, s.copies) for m in range(int(copies)) for i in range(int(n))
    )
    assert got == [(d, i, t[i : i + 50]) for d, t in enumerate(texts) for i in range(len(t) - 49)]
    if slice_bytes > 100:
        assert len(s.text) < 100


CODE = """
import sys, resource, numpy as np
from emporion.llm import passages, suffix_dedup
text = eval(sys.argv[1])[: 8 << 20]
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
cutter = passages._cutter(suffix_dedup.byte_method(), 100, 8 << 20)
import pyarrow as pa
rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([text, text[:1000]], pa.binary())], ["oid", "rk", "text"])
out = [b for b in cutter([rows])]
kept = [(p, raw) for b in out for p, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if p]
big = pa.RecordBatch.from_arrays([pa.array([0] * len(kept)), pa.array([k[0] for k in kept], pa.binary()), pa.array([k[1] for k in kept])] + [pa.nulls(len(kept), pa.int64())] * 4, passages.NAMES)
found = [b for b in passages._comparer(suffix_dedup.byte_method(), 100, 1, 0)([big])]  # every bucket is dealt out again
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


@pytest.mark.parametrize("text", ['b"a" * (8 << 20)', 'b"        \\n" * (1 << 20)', 'b"ab" * (4 << 20)', 'b"0123456" * (2 << 20)'])
def test_memory_of_a_worker_on_eight_megabytes_of_a_run(text):
    said = subprocess.run([sys.executable, "-c", CODE, text], capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) < 300, said.stdout  # MB beside what the modules take
