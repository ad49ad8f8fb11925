"""Operator 3, quality classifier: a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad.  A line's features are simple measures of its
text (letters, symbols, repeated words, ...), and those of the lines before and after it; the
chain's transitions couple neighbouring labels.  Trained by maximum likelihood of the labelled
documents, each of whose lines carries the document's label.  The score of a document is the
mean of its lines' forward-backward marginals for "good", weighted by line length.

The model is fitted on a bounded sample of labelled documents (at most ``TRAIN_DOCS``, those with the
smallest hash of their id, one row of each id, and of these whole documents in that order that have
``TRAIN_LINES`` lines or fewer together) by a fixed number of gradient steps; features of the sample are
computed by Spark and are, with the sample's ids, the only thing that reaches the driver.  Scoring is one pass over all
documents without a shuffle; ids, sources, languages and labels are no inputs of a score.

Defined cases: a null or empty text is one empty line; documents without a label, or with a null
one, are scored but not learned from; of several labels of a document the smallest counts; with
labels of one kind only, or none, every score is 0.5; null and repeated ids give a row each, and of a
repeated id the text with the smallest hash is learned from; a document of more than ``TRAIN_LINES``
lines is scored whole but not learned from; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporion.llm.common import materialize, ship_code, text_or_empty
from emporion.llm.substring_dedup import _word_hashes

TRAIN_DOCS = 4000
TRAIN_LINES = 500_000  # 64 bytes each on the driver
STEPS = 120
CUTOFF = 0.3  # fixed value
FOLDS = 5  # fixed value
DOCS_AT_ONCE = 256
BYTES_AT_ONCE = 4 << 20

_UPPER, _LOWER, _DIGIT, _SPACE, _POINT, _BAR, _BANG, _OTHER, _HIGH = range(9)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT), (b" \t\r\v\f\n", _SPACE), (b".,;:'\"()-?", _POINT), (b"|", _BAR), (b"!", _BANG)):
        table[list(chars)] = kind
    table[128:] = _HIGH
    return table


CLASS = _classes()
MEASURES = 16


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every line of the texts, the lines' lengths (with their line feed) and the
    number of lines of each text."""
    big = b"".join(t + b"\n" for t in texts)
    at = np.frombuffer(big, np.uint8)
    stop = np.flatnonzero(at == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    length = (stop - start + 1).astype(np.float64)
    doc_stop = np.cumsum([len(t) + 1 for t in texts])
    lines = np.diff(np.concatenate([[0], np.searchsorted(stop, doc_stop - 1, side="right")]))
    kind = CLASS[at]
    share = np.stack([np.add.reduceat((kind == k).astype(np.float64), start) for k in range(9)], axis=1)
    letters = share[:, _UPPER] + share[:, _LOWER] + share[:, _HIGH]
    # Words: repeats at short distance, length, and marks at their ends.
    gap = kind == _SPACE
    clean = np.where(gap, np.uint8(32), at)
    w_start, w_stop, h = _word_hashes(clean.tobytes())
    own = np.searchsorted(stop, w_start)
    n_words = np.bincount(own, minlength=len(stop)).astype(np.float64)
    real = w_stop > w_start
    words = np.maximum(1.0, np.bincount(own[real], minlength=len(stop)))
    same = []
    for lag in (1, 2, 3):
        eq = np.zeros(len(h))
        if len(h) > lag:
            eq[lag:] = (h[lag:] == h[:-lag]) & (own[lag:] == own[:-lag]) & real[lag:]
        same.append(np.bincount(own, weights=eq, minlength=len(stop)) / words)
    tail = np.isin(kind[np.maximum(w_stop - 1, 0)], (_BANG, _OTHER)) & real
    line_hash = np.add.reduceat(h * np.uint64(0x9E3779B97F4A7C15), np.searchsorted(w_start, start))
    first = np.cumsum(lines) - lines
    again = np.zeros(len(stop))
    again[1:] = line_hash[1:] == line_hash[:-1]
    again[first[first < len(again)]] = 0
    body = np.maximum(1.0, length - 1)
    cols = [
        np.log1p(length),
        share[:, _UPPER] / np.maximum(1.0, share[:, _UPPER] + share[:, _LOWER]),
        share[:, _DIGIT] / body,
        (share[:, _SPACE] - 1) / body,
        share[:, _POINT] / body,
        share[:, _BAR] / words,
        share[:, _BANG] / words,
        share[:, _OTHER] / words,
        share[:, _HIGH] / body,
        letters / body,
        np.log1p(body / words),
        np.log1p(n_words),
        same[0],
        same[1] + same[2],
        np.bincount(own, weights=tail, minlength=len(stop)) / words,
        again,
    ]
    return np.stack(cols, axis=1), length, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's measures, those of the lines before and after it in its text, and a 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first = (np.cumsum(lines) - lines)[lines > 0]
    before[first] = 0
    after[np.cumsum(lines)[lines > 0] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


@dataclass
class Crf:
    """Standardisation, weights of "good" against "bad", and transition scores [from, to]."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    moves: np.ndarray

    def inputs(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, lines)


def forward_backward(emit: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of "good" for every line, the expected moves summed over all texts, and the sum
    of log partition functions.  ``emit`` is the score of "good"; that of "bad" is 0.

    All texts advance together, line by line; the longest come first, so those with a line
    left are always a leading part."""
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    n = lines[order]
    longest = int(n[0]) if len(n) else 0
    active = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest)]  # texts with more than t lines
    e = np.exp(moves)
    alpha = np.empty((len(emit), 2))
    total = 0.0
    score = np.stack([np.zeros_like(emit), emit], axis=1)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    total += np.maximum(emit, 0).sum()
    for t in range(longest):
        at = first[: active[t]] + t
        a = score[at] if t == 0 else (alpha[at - 1] @ e) * score[at]
        norm = a.sum(axis=1, keepdims=True)
        alpha[at] = a / norm
        total += np.log(norm).sum()
    good = np.empty(len(emit))
    pair = np.zeros((2, 2))
    beta = np.ones((len(n), 2))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        b = beta[:k].copy()
        ends = n[:k] == t + 1
        b[ends] = 1.0
        post = alpha[at] * b
        post /= post.sum(axis=1, keepdims=True)
        good[at] = post[:, 1]
        if t:
            back = score[at] * b
            joint = alpha[at - 1][:, :, None] * e[None] * back[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pair += joint.sum(axis=0)
            b = back @ e.T
            beta[:k] = b / b.sum(axis=1, keepdims=True)
    return good, pair, total


def fit(x: np.ndarray, lines: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = 0.15, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam; every text weighs the same as one of the other label's."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model = Crf(mean, scale, np.zeros(3 * x.shape[1] + 1), np.zeros((2, 2)))
    inputs = model.inputs(x, lines)
    y = np.repeat(label, lines).astype(np.float64)
    inside = np.ones(len(y), bool)
    inside[(np.cumsum(lines) - lines)[lines > 0]] = False  # lines that have one before them
    moved = np.array([[np.sum(inside & (y == 0)), 0], [0, np.sum(inside & (y == 1))]], np.float64)
    theta, m, v = np.zeros(len(model.weight) + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        weight, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, pair, _ = forward_backward(inputs @ weight, lines, moves)
        grad = np.concatenate([inputs.T @ (good - y), (pair - moved).ravel()]) / len(y) + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def document_scores(model: Crf | None, texts: list[bytes]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x, length, lines = line_features(texts)
    good, _, _ = forward_backward(model.inputs(x, lines) @ model.weight, lines, model.moves)
    first = np.cumsum(lines) - lines
    return np.clip(np.add.reduceat(good * length, first) / np.add.reduceat(length, first), 0.0, 1.0)


def held_out(id_col: str = "doc_id"):
    """The test fold: crc32 of the id as text, modulo 5, is 0."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def train(
    docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_lines: int = TRAIN_LINES,
) -> Crf | None:
    """Fit on at most ``train_docs`` labelled documents outside the test fold, ``train_lines`` lines."""
    spark = docs.sparkSession
    ship_code(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    known = known.join(own.select("id").distinct(), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(train_docs)  # the bound of the sample

    def measure(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for s, e in _groups(texts):
                part = b.slice(s, e - s)
                x, _, lines = line_features(texts[s:e])
                ends = np.cumsum(lines)
                rows = [x[e - n : e].astype(np.float32).tobytes() for e, n in zip(ends, lines)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], ["id", "y", "x"])

    # One row of each id, combined where the rows are: a repeated id costs a text a task.
    sample = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(sample.withColumn("lines", F.regexp_count(F.col("text").cast("string"), F.lit("\n")) + 1), "crf-sample")
    left, fits = train_lines, []
    for r in sample.select("id", "lines").orderBy(F.xxhash64("id"), "id").collect():  # at most train_docs rows
        if r["lines"] <= left:
            left -= r["lines"]
            fits.append((r["id"],))
    if not fits:
        return None
    sample = sample.join(F.broadcast(spark.createDataFrame(fits, "id long")), "id")
    rows = sample.select("id", "y", "text").mapInArrow(measure, "id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["x"])))
    label = np.array([r["y"] > 0 for r in rows])
    if not len(label) or label.all() or not label.any():
        return None
    parts = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, MEASURES).astype(np.float64) for r in rows]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), label)


def _groups(texts: list[bytes]):
    """Slices of texts of bounded number and size."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= BYTES_AT_ONCE or i - a + 1 >= DOCS_AT_ONCE:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def quality_scores(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for s, e in _groups(texts):
                score = document_scores(model, texts[s:e])
                cols = [b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), pa.array(score), pa.array((score >= cutoff).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_bad(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without those that score under the cutoff, all columns as they were."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    given = docs.schema
    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(place).to_pylist()]
            keep = np.concatenate([document_scores(model, texts[s:e]) for s, e in _groups(texts)] or [np.empty(0)]) >= cutoff
            if keep.any():
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, given)
