"""Repeated windows across documents: what the two substring operators share.

A window is a run of a fixed number of units (words or bytes).  Cutting: consecutive windows of
a document with the same minimiser form one packed string, a super-k-mer, which travels to the
bucket of its minimiser; equal windows have equal minimisers, so they meet there.  Each window
travels exactly once.  Of equal strings in one chunk of input only those of the smallest
document travel; the others are settled at once, since that document comes before theirs, so a
passage of very many documents sends one string a chunk.  Equal strings right after one another
in a document, as in a run of one letter, are one place: a first unit, a step and a number of copies.

Buckets: a task reads its buckets one after the other.  A bucket over its limit is not
compared: its strings are cut again by longer minimisers, in the last turn into single windows by
their whole content, with equal ones combined as before, until every bucket fits.

Finishing: texts, compressed in groups, and the covered spans meet in partitions by row.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporion.llm.common import LAST_ID, materialize, partitions_for, row_keyed, ship_code

CHUNK_BYTES = 8 << 20  # text that a task cuts at a time
BUCKET_BYTES = 6 << 20  # aimed size of a bucket, unpacked
MOST_BUCKET_BYTES = 16 << 20  # a larger bucket is dealt out again
DEAL_BYTES = 1 << 20  # text of strings that is cut again at a time
DEAL_PLACES = 1 << 17  # places of strings that are dealt out again at a time
ROUNDS = 4  # by then a bucket holds a window or two, with the places of one document each
FAN, LAST_FAN = 4, 16  # times the buckets when strings, and when single windows are dealt out again
BUCKETS_A_TASK = 3
ROW = "part long, payload binary, raw long, oid long, rk long, a long, b long"
NAMES = [c.split()[0] for c in ROW.split(", ")]


@dataclass
class Strings:
    """Super-k-mers: their bytes, minimiser hash, extra number, and row and first unit.  The same
    string may follow ``copies`` times, ``step`` units apart, at most a window."""

    text: list[bytes]
    mini: np.ndarray  # uint64
    extra: np.ndarray  # int32, for the bucket's comparison
    windows: np.ndarray  # number of windows of each
    oid: np.ndarray
    rk: np.ndarray
    start: np.ndarray
    step: np.ndarray
    copies: np.ndarray


@dataclass
class Method:
    """How one operator cuts texts, compares buckets and finishes documents."""

    window: int
    pieces: Callable[[bytes], Iterator[tuple[int, bytes]]]  # (first unit, text) of bounded size
    cut: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], Strings]  # texts, oid, rk, first unit
    repeated: Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # strings, oid, extra -> (string, window)
    recut: Callable[[int], Callable]  # turn (1, 2, ...) -> a cut by longer minimisers, from ROUNDS - 1 by whole windows; copies are 1
    expansion: float  # bytes of strings for each byte of text


def longer(least: int, window: int, turn: int) -> int:
    """Units of the minimiser of a turn: ``least`` in the first cut, a whole window in the last turn."""
    return least + (window - least) * min(turn, ROUNDS - 1) // (ROUNDS - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _batch(**cols) -> pa.RecordBatch:
    n = max(len(v) for v in cols.values())
    types = dict(part=pa.int64(), payload=pa.binary(), raw=pa.int64(), oid=pa.int64(), rk=pa.int64(), a=pa.int64(), b=pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(cols[c], types[c]) if c in cols else pa.nulls(n, types[c]) for c in NAMES], NAMES)


def _pack(numbers: list[np.ndarray], texts: list[bytes]) -> bytes:
    """Numbers (as differences, which compress well) and texts in one compressed string."""
    numbers = [np.fromiter(map(len, texts), np.int64, len(texts)), *numbers]
    head = struct.pack(f"<{len(numbers) + 1}q", len(numbers), *map(len, numbers))
    nums = b"".join(np.diff(np.asarray(x, np.int64), prepend=0).tobytes() for x in numbers)
    return zstandard.ZstdCompressor(level=3).compress(head + nums + b"".join(texts))


def _unpack(payload: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    k = struct.unpack_from("<q", data)[0]
    numbers, at = [], 8 * (k + 1)
    for n in struct.unpack_from(f"<{k}q", data, 8):
        numbers.append(np.cumsum(np.frombuffer(data, np.int64, n, at)))
        at += 8 * n
    ends = (at + np.cumsum(numbers[0])).tolist()
    return numbers[1:], [data[s:e] for s, e in zip([at, *ends[:-1]], ends)]


def merged_spans(oid: np.ndarray, rk: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Spans [a, b) of the same row that touch or overlap, as one."""
    if not len(oid):
        return [oid, rk, a, b]
    o = np.lexsort((a, rk, oid))
    oid, rk, a, b = oid[o], rk[o], a[o], b[o]
    new = np.concatenate([[True], (oid[1:] != oid[:-1]) | (rk[1:] != rk[:-1])])
    group = np.cumsum(new)
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(b + group * far) - group * far  # furthest end so far in the row
    first = new | np.concatenate([[False], a[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    return [oid[at], rk[at], a[at], reach[np.append(at[1:] - 1, len(a) - 1)]]


def _ship(s: Strings, parts: int, salt: int, window: int) -> Iterator[pa.RecordBatch]:
    """Packed strings by bucket, and the spans of those that a smaller document settles."""
    if not s.text:
        return
    first: dict[bytes, int] = {}
    code = np.fromiter((first.setdefault(t, i) for i, t in enumerate(s.text)), np.int64, len(s.text))
    least = np.full(len(s.text), LAST_ID, np.int64)
    np.minimum.at(least, code, s.oid)
    settled = np.flatnonzero(s.oid > least[code])
    if len(settled):
        end = s.start + (s.copies - 1) * s.step + s.windows + window - 1
        spans = merged_spans(s.oid[settled], s.rk[settled], s.start[settled], end[settled])
        yield _batch(part=(spans[0] % parts), oid=spans[0], rk=spans[1], a=spans[2], b=spans[3])
    go = np.flatnonzero(s.oid == least[code])
    part = (mixed(s.mini[go] ^ np.uint64(salt * 0x5851F42D4C957F2D % (1 << 64))) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((code[go], part))
    go, part = go[order], part[order]
    # A string goes once, with every place at which its document has it.
    head = np.flatnonzero(np.concatenate([[True], code[go[1:]] != code[go[:-1]]]))
    count = np.diff(np.append(head, len(go)))
    edge = np.flatnonzero(np.concatenate([[True], part[head[1:]] != part[head[:-1]]]))
    payload, raw = [], []
    for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(head)]):
        own = go[head[x:y]]
        each = go[head[x] : head[y] if y < len(head) else len(go)]
        texts = [s.text[i] for i in own.tolist()]
        payload.append(_pack([s.extra[own], s.oid[own], count[x:y], s.rk[each], s.start[each], s.step[each], s.copies[each]], texts))
        raw.append(sum(map(len, texts)) + 32 * len(texts) + 16 * len(each))
    yield _batch(part=part[head[edge]], payload=payload, raw=raw)


def _cutter(m: Method, parts: int, chunk_bytes: int):
    def run(batches):
        held, n = [], 0  # (oid, rk, first unit, text)

        def flush():
            oid, rk, first = (np.array([h[i] for h in held], np.int64) for i in range(3))
            yield from _ship(m.cut([h[3] for h in held], oid, rk, first), parts, 0, m.window)

        for b in batches:
            for oid, rk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for first, piece in m.pieces(text.as_buffer().to_pybytes()):
                    held.append((oid, rk, first, piece))
                    n += len(piece)
                    if n >= chunk_bytes:
                        yield from flush()
                        held, n = [], 0
        if held:
            yield from flush()

    return run


def _comparer(m: Method, parts: int, salt: int, most_bytes: int):
    """Compares the buckets of a partition; passes spans through, deals out what is too large."""

    def bucket(blobs: list[bytes]):
        numbers, texts = [], []
        for x in blobs:
            own, t = _unpack(x)
            numbers.append(own)
            texts += t
        return texts, *map(np.concatenate, zip(*numbers))

    def compare(blobs):
        texts, extra, oid, count, rk, start, step, copies = bucket(blobs)
        which, at = m.repeated(texts, oid, extra)
        if len(which):
            which, _, a, b = merged_spans(which, which * 0, at, at + m.window)
            n = count[which]  # the spans of a string hold wherever its document has it
            each = np.repeat(np.cumsum(count)[which] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = np.repeat(a, n) + start[each], np.repeat(b, n) + start[each] + (copies[each] - 1) * step[each]
            spans = merged_spans(np.repeat(oid[which], n), rk[each], a, b)
            yield _batch(oid=spans[0], rk=spans[1], a=spans[2], b=spans[3])

    def deal(blobs):
        """The strings cut again, at most DEAL_PLACES places of strings at a time."""
        cut, held, n = m.recut(salt), [], 0  # columns of Strings

        def flush():
            text, *cols = zip(*held)
            yield from _ship(Strings([t for own in text for t in own], *map(np.concatenate, cols)), parts, salt, m.window)

        for x in blobs:
            texts, _, oid, count, *places = bucket([x])
            rk, start, step, copies = places
            first = np.cumsum(count) - count
            size = np.cumsum([len(t) for t in texts])
            edge = [0, *(np.searchsorted(size, np.arange(DEAL_BYTES, size[-1], DEAL_BYTES)) + 1).tolist(), len(texts)]
            for lo, hi in zip(edge, edge[1:]):
                if lo == hi:
                    continue
                own = np.arange(lo, hi)
                s = cut(texts[lo:hi], own, 0 * own, 0 * own)
                some = count[s.oid]  # a new string comes wherever its document has the old one
                end = np.cumsum(some)
                for at in range(0, int(end[-1]), DEAL_PLACES):
                    each = np.arange(at, min(at + DEAL_PLACES, int(end[-1])))
                    k = np.searchsorted(end, each, side="right")
                    i = s.oid[k]
                    p = first[i] + each - (end - some)[k]
                    held.append(([s.text[j] for j in k.tolist()], s.mini[k], s.extra[k], s.windows[k], oid[i], rk[p], start[p] + s.start[k], step[p], copies[p]))
                    n += len(each)
                    if n >= DEAL_PLACES:
                        yield from flush()
                        held, n = [], 0
        if held:
            yield from flush()

    def run(batches):
        now, held, size, large = None, [], 0, False
        for b in batches:
            spans = b.filter(b.column(1).is_null())
            if spans.num_rows:
                yield spans
            for part, payload, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                if payload is None:
                    continue
                if part != now:
                    if held:
                        yield from (deal if large else compare)(held)
                    now, held, size, large = part, [], 0, False
                held.append(payload)
                size += raw
                if size > most_bytes:
                    large = True
                    yield from deal(held)
                    held, size = [], 0
        if held:
            yield from (deal if large else compare)(held)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(oid, rk, text as bytes), and the bytes of text.  ``rk`` is 0 unless some id of the table
    has several texts; then it tells them apart."""
    ship_code(docs.sparkSession)
    rows = row_keyed(docs, id_col, text_col)
    size = F.octet_length("text").cast("long")
    ids = rows.groupBy("oid").agg((F.min("rk") < F.max("rk")).alias("several"), F.sum(size).alias("size"))
    several, total = ids.agg(F.max("several"), F.sum("size")).first()
    rk = F.col("rk") if several else F.lit(0).cast("long")
    return rows.select("oid", rk.alias("rk"), F.col("text").cast("binary").alias("text")), total or 0


def covered_spans(
    rows: DataFrame, m: Method, total: int, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, most_bytes: int = MOST_BUCKET_BYTES
) -> DataFrame:
    """(oid, rk, a, b): spans of units covered by windows that also start in a document with a
    smaller id.  ``rows`` comes from :func:`keyed`; ``total`` is its bytes of text."""
    raw = int(total * m.expansion)
    parts = partitions_for(raw, bucket_bytes)
    dealt = rows.mapInArrow(_cutter(m, parts, chunk_bytes), ROW)
    found, salt = None, 0
    while True:
        salt += 1
        met = dealt.repartition(partitions_for(raw, BUCKETS_A_TASK * bucket_bytes), "part").sortWithinPartitions("part")
        out = materialize(met.mapInArrow(_comparer(m, parts * (FAN if salt + 1 < ROUNDS else LAST_FAN), salt, most_bytes if salt < ROUNDS else 1 << 62), ROW), "passages")
        spans = out.where("payload IS NULL").select("oid", "rk", "a", "b")
        found = spans if found is None else found.unionByName(spans)
        dealt = out.where("payload IS NOT NULL")
        raw = dealt.agg(F.sum("raw")).first()[0]
        if not raw:
            return found


def finish(rows: DataFrame, spans: DataFrame, per_doc, schema: str, total: int) -> DataFrame:
    """One row for each row of ``rows``: ``doc_id`` and what ``per_doc(text, spans)`` gives, with
    the merged spans of the document as a list of (a, b)."""
    n = partitions_for(total, 2 * BUCKET_BYTES)
    buckets = 4 * n

    def pack(batches):
        held, size = [], 0

        def flush():
            oid, rk = (np.array([h[i] for h in held], np.int64) for i in range(2))
            part = oid % buckets
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
            own = [order[x:y] for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(order)])]
            yield _batch(part=[int(part[i[0]]) for i in own], payload=[_pack([oid[i], rk[i]], [held[j][2] for j in i.tolist()]) for i in own])

        for b in batches:
            for oid, rk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                held.append((oid, rk, text.as_buffer().to_pybytes()))
                size += len(held[-1][2]) + 64
                if size >= CHUNK_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def join(batches):
        blobs, cols = [], []
        for b in batches:
            blobs += [p for p in b.column(1).to_pylist() if p is not None]
            own = b.filter(b.column(1).is_null())
            cols.append([own.column(i).to_numpy() for i in range(3, 7)])
        if not blobs:
            return
        oid, rk, a, b = merged_spans(*(np.concatenate(x).astype(np.int64) for x in zip(*cols)))
        edge = np.flatnonzero(np.concatenate([[True], (oid[1:] != oid[:-1]) | (rk[1:] != rk[:-1])])) if len(oid) else []
        at = {(int(oid[x]), int(rk[x])): (x, y) for x, y in zip(edge, [*edge[1:], len(oid)])}
        for blob in blobs:
            (o, r), texts = _unpack(blob)
            out = []
            for i, text in enumerate(texts):
                x, y = at.get((int(o[i]), int(r[i])), (0, 0))
                out.append((None if o[i] == LAST_ID else int(o[i]), *per_doc(text, list(zip(a[x:y].tolist(), b[x:y].tolist())))))
            cols_out = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(cols_out, names)

    full = f"doc_id long, {schema}"
    names = [c.split()[0] for c in full.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in full.split(", ")]
    packed = rows.mapInArrow(pack, ROW)
    own = spans.select((F.pmod(F.col("oid"), F.lit(buckets))).cast("long").alias("part"), F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("long").alias("raw"), "oid", "rk", "a", "b")
    return packed.unionByName(own).repartition(n, "part").mapInArrow(join, full)
