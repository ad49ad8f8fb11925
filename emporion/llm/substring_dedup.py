"""Operator 5, substring dedup of words by super-k-mer partitioning.

A window is ``window`` consecutive words of a document.  The minimiser of a window is the
smallest hash of its words, long words before short ones; consecutive windows with the same minimiser travel as one packed
string to its bucket (see ``passages``).  In the bucket the windows are sorted by a hash of
their words, runs of equal hashes are compared byte by byte, and a window is repeated if a
document with a smaller id has it.  Words covered by repeated windows are removed.

Defined cases: a null or empty text has no words; a text shorter than a window keeps all its
words; null ids come last and are not smaller than one another; rows with the same id do not
count as earlier documents of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from emporion.llm.passages import Method, Strings, covered_spans, finish, keyed, longer, mixed

WINDOW_WORDS = 13  # fixed value
PIECE_BYTES = 8 << 20
HASH_BYTES = 2 << 20
SHORT_BYTES = 5
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MULT = np.uint64(0x100000001B3)


def _word_hashes(big: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of ``big``, which ends with a separator (one space or
    line feed after each word)."""
    at = np.frombuffer(big, np.uint8)
    ends = np.flatnonzero((at == 32) | (at == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.empty(len(ends), np.uint64)
    x = 0
    while x < len(ends):  # in slices, for the memory of eight bytes a byte
        y = max(x + 1, int(np.searchsorted(ends, starts[x] + HASH_BYTES)))
        a, b = int(starts[x]), int(ends[y - 1]) + 1
        length = (ends[x:y] - starts[x:y] + 1).astype(np.int64)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _MULT)]))
        off = np.arange(a, b) - np.repeat(starts[x:y], length)
        byte = at[a:b].astype(np.uint64)
        byte[ends[x:y] - a] = 0
        hashes[x:y] = np.add.reduceat((byte + np.uint64(1)) * power[off], starts[x:y] - a)
        x = y
    return starts, ends, mixed(hashes)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if k < width else h


def _pieces(window: int):
    def run(text: bytes) -> Iterator[tuple[int, bytes]]:
        at, first, carry = 0, 0, []
        while at < len(text):
            end = len(text)
            if end - at > PIECE_BYTES:
                gap = _SPACE.search(text, at + PIECE_BYTES)
                end = gap.start() if gap else end
            words = carry + text[at:end].split()
            if len(words) >= window:
                yield first, b" ".join(words)
            carry = words[max(0, len(words) - window + 1) :]
            first += len(words) - len(carry)
            at = end

    return run


def _names(h: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` words from every word, by the hashes of the words."""
    name = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        name = name * _MULT + h[k : k + len(name)]
    return mixed(name)


def _cut(window: int, gram: int = 1):
    def run(texts: list[bytes], oid: np.ndarray, rk: np.ndarray, first: np.ndarray) -> Strings:
        big = b"\n".join(texts) + b"\n"
        starts, ends, h = _word_hashes(big)
        line_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        last = np.searchsorted(ends, line_ends)  # last word of each text
        begin = np.concatenate([[0], last[:-1] + 1])
        doc = np.repeat(np.arange(len(texts)), last - begin + 1)
        if gram == 1:  # short words come last: they are the frequent ones, which would fill a few buckets
            short = (ends - starts <= SHORT_BYTES).astype(np.uint64) << np.uint64(63)
            low = _sliding_min((h >> np.uint64(1)) | short, window)
        else:
            low = _sliding_min(_names(h, gram), window - gram + 1)
        whole = doc[: len(low)] == doc[window - 1 :]
        at = np.flatnonzero(whole)
        new = np.ones(len(at), bool)
        if gram < window:
            new[1:] = (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
        run_at = np.flatnonzero(new)
        n = np.diff(np.append(run_at, len(at)))
        head = at[run_at]
        s, e = starts[head].tolist(), ends[head + n + window - 2].tolist()
        d, one = doc[head], np.ones(len(head), np.int64)
        return Strings([big[x:y] for x, y in zip(s, e)], low[head], 0 * one, n, oid[d], rk[d], first[d] + head - begin[d], n, one)

    return run


def _repeated(window: int):
    def run(texts: list[bytes], oid: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        big = b"\n".join(texts) + b"\n"
        starts, ends, h = _word_hashes(big)
        last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1)
        begin = np.concatenate([[0], last[:-1] + 1])
        n = last - begin + 2 - window  # windows of each string
        name = _names(h, window)
        which = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        word = begin[which] + at
        name = name[word]
        order = np.argsort(name)
        a, z = starts[word], ends[word + window - 1]
        hit = order[_later(name[order], oid[which[order]], big, a[order], z[order])]
        return which[hit], at[hit]

    return run


def _later(name: np.ndarray, oid: np.ndarray, big: bytes, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Of windows sorted by name, those whose bytes [a, z) a smaller document has too."""
    if not len(name):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.append(first, len(name)))
    least = np.minimum.reduceat(oid, first)
    most = np.maximum.reduceat(oid, first)
    keep = np.flatnonzero(np.repeat(least < most, size))
    head = np.repeat(first, size)[keep]
    differ = ~_same_bytes(big, a[keep], z[keep], a[head], z[head])
    later = oid[keep] > np.repeat(least, size)[keep]
    if differ.any():  # equal names of different windows: compare these groups by their bytes
        odd = np.isin(head, head[differ])
        seen: dict[bytes, int] = {}
        text = [big[x:y] for x, y in zip(a[keep[odd]].tolist(), z[keep[odd]].tolist())]
        own = oid[keep[odd]].tolist()
        for t, o in zip(text, own):
            seen[t] = min(o, seen.get(t, o))
        later[odd] = [o > seen[t] for t, o in zip(text, own)]
    return keep[later]


def _same_bytes(big: bytes, a: np.ndarray, z: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether bytes [a, z) and [c, y) are the same, eight bytes at a time."""
    padded = big + bytes(8)
    word = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    same = (z - a) == (y - c)
    left, at = np.flatnonzero(same), 0
    while len(left):
        rest = z[left] - a[left] - at
        shift = (8 * np.clip(8 - rest, 0, 7)).astype(np.uint64)  # bytes past the end do not count
        ok = (word[a[left] + at] << shift) == (word[c[left] + at] << shift)
        same[left[~ok]] = False
        at += 8
        left = left[ok & (rest > 8)]
    return same


def word_method(window: int = WINDOW_WORDS) -> Method:
    recut = lambda turn: _cut(window, longer(1, window, turn))
    return Method(window, _pieces(window), _cut(window), _repeated(window), recut, 1 + 2 * (window - 1) / window)


def _kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    words = text.split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _kept_text(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    words = text.split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    return ((b" ".join(kept + words[at:])).decode(),)


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``."""
    rows, total = keyed(docs, id_col, text_col)
    spans = covered_spans(rows, word_method(window), total, **sizes)
    return finish(rows, spans, _kept_words, "n_words long, n_removed long, kept_sha256 string", total)


def kept_texts(docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``text``, the words that stay joined by one space."""
    rows, total = keyed(docs, id_col, text_col)
    return finish(rows, covered_spans(rows, word_method(window), total), _kept_text, "text string", total)
