"""Operator 9, dedup of repeated byte strings by names of doubled length.

A byte string of ``length`` bytes is repeated if a document with a smaller id has it; every
byte that a repeated string covers is removed.  Whether two positions share ``length`` bytes is
decided by names of growing prefixes: the name of 2h bytes at i is a hash of the names of h
bytes at i and at i + h.  No rank is assigned or carried, and Spark does not sort the positions once a
round, as plain prefix doubling would: the README says why.

Spark deals the positions out so that this needs one shuffle: each position goes to the bucket
of the smallest hash of 8 bytes (12 or 16 of a large input) in its ``length`` bytes, and
neighbours with the same smallest place share one packed string (see ``passages``), so positions with equal strings always meet.
In a bucket strings are left out that no other document can share, judged by the 8 bytes at that
place with the 16 after, and with the 16 before; then positions whose name of 32 bytes one document
alone has; what is left is sorted by the name of ``length`` bytes.  Names are 64-bit hashes; bytes are
compared before anything is removed.

A run of few letters has the same string at very many places: a text is hashed in slices, and equal
strings right after one another travel as one place with a number of copies.

Defined cases: a null text is empty; a text shorter than ``length`` keeps all its bytes;
matches never cross documents; kept bytes need not be valid UTF-8; null ids come last and are
not smaller than one another; rows with the same id do not count as earlier documents of each
other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from emporion.llm.passages import Method, Strings, covered_spans, finish, keyed, longer, mixed
from emporion.llm.substring_dedup import _later, _sliding_min

LENGTH = 50  # fixed value
PIECE_BYTES = 8 << 20
SLICE_BYTES = 1 << 20  # places that are hashed at a time
GRAM, SIDE = 8, 16
MORE_BYTES = (1 << 30, 256 << 30)  # over so much text the first cut takes grams four bytes longer: frequent ones would overfill their bucket


def _words(big: bytes) -> np.ndarray:
    """The eight bytes from every place of ``big``, as numbers."""
    padded = big + bytes(8)
    return np.ndarray(len(big) + 1, "<u8", padded, 0, (1,))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(b))


def _pieces(length: int):
    def run(text: bytes) -> Iterator[tuple[int, bytes]]:
        for at in range(0, len(text) - length + 1, PIECE_BYTES):
            yield at, text[at : at + PIECE_BYTES + length - 1]

    return run


def _grams(part: bytes, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` bytes from every place."""
    word, n = _words(part), len(part) - gram + 1
    h = mixed(word[:n].astype(np.uint64))
    for off in [*range(GRAM, gram - GRAM, GRAM), gram - GRAM] if gram > GRAM else []:
        h = _pair(h, word[off : off + n])
    return h


def _heads(big: bytes, x: int, y: int, stop: np.ndarray, length: int, gram: int, runs: bool) -> tuple[np.ndarray, ...]:
    """The strings of the windows that start at places [x, y): first window, smallest hash, place
    of that hash, windows, and how often the string comes again right after itself (1 without ``runs``)."""
    part = big[x : y + length - 1]
    h = _grams(part, gram)
    low = _sliding_min(h, length - gram + 1)
    whole = np.ones(len(low), bool)
    for e in (stop[np.searchsorted(stop, x, side="right") : np.searchsorted(stop, y + length)] - x).tolist():
        whole[max(0, e - length + 1) : max(0, e)] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return (at,) * 5
    least = low[at]
    new = np.ones(len(at), bool)
    # A string ends where the smallest place changes: another hash, or the place is passed.
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (h[at[:-1]] == least[:-1])
    run_at = np.flatnonzero(new)
    n = np.diff(np.append(run_at, len(at)))
    head, least = at[run_at], least[run_at]
    place = head + n - 1
    left = np.flatnonzero(h[place] != least)
    while len(left):
        place[left] += 1
        left = left[h[place[left]] != least[left]]
    place -= head
    again = np.zeros(len(head), bool)  # the string before is the same, and ends where this one begins
    again[1:] = (head[1:] == head[:-1] + n[:-1]) & (n[1:] == n[:-1]) & (least[1:] == least[:-1]) & (place[1:] == place[:-1])
    byte = np.frombuffer(part, np.uint8)
    again &= runs
    for step in np.unique(n[again]).tolist():
        own = np.flatnonzero(again & (n == step))
        same = np.concatenate([[0], np.cumsum(byte[:-step] == byte[step:], dtype=np.int32)])
        before = head[own] - step
        again[own] = same[before + step + length - 1] - same[before] == step + length - 1
    kept = np.flatnonzero(~again)
    return head[kept] + x, least[kept], place[kept], n[kept], np.diff(np.append(kept, len(head)))


def _cut(length: int, gram: int = GRAM, runs: bool = True):
    def run(texts: list[bytes], oid: np.ndarray, rk: np.ndarray, first: np.ndarray) -> Strings:
        big = b"".join(texts)
        stop = np.cumsum([len(t) for t in texts])
        begin = np.concatenate([[0], stop[:-1]])
        last = len(big) - length + 1
        slices = [_heads(big, x, min(x + SLICE_BYTES, last), stop, length, gram, runs) for x in range(0, last, SLICE_BYTES)]
        head, least, place, n, copies = map(np.concatenate, zip(*slices))
        d = np.searchsorted(stop, head, side="right")
        s, e = head.tolist(), (head + n + length - 1).tolist()
        return Strings([big[x:y] for x, y in zip(s, e)], least, place, n, oid[d], rk[d], first[d] + head - begin[d], n, copies)

    return run


def _shared(key: np.ndarray, oid: np.ndarray) -> np.ndarray:
    """Which rows have a key that several documents have."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key)
        k, o = key[order], oid[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        several = np.minimum.reduceat(o, first) < np.maximum.reduceat(o, first)
        out[order] = np.repeat(several, np.diff(np.append(first, len(k))))
    return out


def _repeated(length: int):
    def run(texts: list[bytes], oid: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        big = b"".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lens) - lens
        word = _words(big)
        n = lens - length + 1

        def ranked(has: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
            own = np.flatnonzero(has)
            at = begin[own] + place[own]
            name = word[at]
            for off in offsets:
                name = _pair(name, word[at + off])
            out = np.zeros(len(texts), bool)
            out[own] = _shared(name, oid[own])
            return out

        known = place >= 0  # single windows that were dealt out again have no place
        after = ranked(known & (lens - place >= GRAM + SIDE), (8, 16))
        before = ranked(known & (place >= SIDE), (-8, -16))
        # A window with 16 bytes on a side of the place needs a partner with the same 16.
        low = np.where(known & ~before, np.maximum(0, place - SIDE + 1), 0)
        high = np.where(known & ~after, np.minimum(n - 1, place + GRAM + SIDE - 1 - length), n - 1)
        count = np.maximum(0, high - low + 1)
        which = np.repeat(np.arange(len(texts)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        pos = begin[which] + at

        def name_of(p: np.ndarray, h: int) -> np.ndarray:
            return word[p] if h == 8 else _pair(name_of(p, h // 2), name_of(p + h // 2, h // 2))

        h, name = 8, word[pos].astype(np.uint64)
        while 2 * h <= length:  # rank pairs at offset h
            name = _pair(name, name_of(pos + h, h))
            h *= 2
            if h > SIDE:
                keep = _shared(name, oid[which])
                which, at, pos, name = which[keep], at[keep], pos[keep], name[keep]
        if h < length:
            name = _pair(name, name_of(pos + length - h, h))
        order = np.argsort(name)
        hit = order[_later(name[order], oid[which[order]], big, pos[order], pos[order] + length)]
        return which[hit], at[hit]

    return run


def first_gram(total: int, length: int = LENGTH) -> int:
    """Bytes of the first cut's grams for ``total`` bytes of text."""
    return min(length, GRAM + 4 * sum(total > more for more in MORE_BYTES))


def byte_method(length: int = LENGTH, gram: int = GRAM) -> Method:
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} bytes or more")
    recut = lambda turn: _cut(length, longer(gram, length, turn), runs=False)
    return Method(length, _pieces(length), _cut(length, gram), _repeated(length), recut, 1 + 2 * (length - 1) / (length - gram + 2))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return len(text), b"".join([*kept, text[at:]])


def _digest(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    n, kept = _kept(text, spans)
    return n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()


def _kept_text(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    return (_kept(text, spans)[1].decode(errors="ignore"),)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows, total = keyed(docs, id_col, text_col)
    spans = covered_spans(rows, byte_method(length, first_gram(total, length)), total, **sizes)
    return finish(rows, spans, _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", total)


def kept_texts(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``text``, the bytes that stay; parts of characters
    that a cut leaves are dropped."""
    rows, total = keyed(docs, id_col, text_col)
    return finish(rows, covered_spans(rows, byte_method(length, first_gram(total, length)), total), _kept_text, "text string", total)
