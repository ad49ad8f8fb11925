"""Operator 2, BPE encoding and decoding through a distinct-word table.

Splitting: a task cuts its documents into words with the tokenizer's own pattern (special
tokens first), numbers the distinct words of each chunk of input by falling frequency, and
keeps every document as the list of these numbers, its positions.
Encoding: the chunks' words meet by the hash of their first letters, so each distinct word of
the corpus is encoded once, wherever it stands; the ids go back to the chunks that asked.  A
bucket over its limit (many words that begin alike, such as numbers) is dealt out again by the
hash of the whole word.
Joining back: in each chunk the ids of every word are joined to the positions of its documents.
Decoding: each distinct word's ids are joined to the id-to-piece table (one row per vocabulary
entry, so its size is fixed), and the pieces are put in place by position.

Words, ids and positions are shuffled in compressed groups, because the table of all words of
all documents would be many times the input.

Defined cases: a null or empty text has no tokens and decodes to an empty text; null and
repeated ids give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporion.llm.common import materialize, partitions_for, ship_code, text_or_empty

CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 12 << 20  # text for each bucket of the distinct-word table
BUCKET_LETTERS = 5  # words that begin alike share a bucket, so that neighbours in order do
#: Fixed value: the split pattern of byte-level BPE tokenizers of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEWER = re.compile("[^\x00-\u052f]")
MOST_BUCKET_BYTES = 32 << 20  # a bucket of more words is dealt out again by the whole word
WORD_BYTES = 32  # what a word counts besides its letters
DEAL_SEED = 1  # another hash than that of the buckets
SUB = 16  # a bucket's number has so many bits; above them stands the part of a divided bucket
ROW = "chunk long, bucket long, payload binary"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 bytes stand
    for themselves, the others for the letters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    letters = byte_letters()
    table = {i: bytes(letters[c] for c in piece) for piece, i in data["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
    return [table.get(i, b"") for i in range(max(table) + 1)]


@lru_cache(maxsize=2)
def splitter(path: str):
    """The function that cuts a text into the words that are encoded one by one."""
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    fast, library = regex.compile(PATTERN).findall, _tokenizer(path).pre_tokenizer.pre_tokenize_str

    def words(text: str) -> list[str]:
        # Beyond these letters Unicode versions differ between libraries: the tokenizer's own decides.
        if text.isascii() or not _NEWER.search(text):
            return fast(text)
        return [text[s:e] for _, (s, e) in library(text)]

    if not special:
        return words
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def run(text: str) -> list[str]:
        if not any(s in text for s in special):
            return words(text)
        out = []
        for i, part in enumerate(cut.split(text)):
            out += [part] if i % 2 else words(part)
        return out

    return run


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte plane, so that they compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _pack(*parts: np.ndarray | bytes) -> bytes:
    flat = [p if isinstance(p, bytes) else _planes(p) for p in parts]
    head = struct.pack(f"<{len(parts) + 1}q", len(parts), *(len(p) for p in flat))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(flat))


def _unpack(payload: bytes, *types: str) -> list:
    data = zstandard.ZstdDecompressor().decompress(payload)
    k = struct.unpack_from("<q", data)[0]
    out, at = [], 8 * (k + 1)
    for n, t in zip(struct.unpack_from(f"<{k}q", data, 8), types):
        if t == "bytes":
            out.append(data[at : at + n])
        else:
            w = np.dtype(t).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n, at).reshape(w, -1).T).view(t).ravel())
        at += n
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Batches of ``ROW``, with the bytes of words as a fourth column where they are given."""
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(cols, ["chunk", "bucket", "payload", "raw"][: len(cols)])


def _words(lens: np.ndarray, text: bytes) -> list[str]:
    text, ends = text.decode(), np.cumsum(lens).tolist()
    return [text[s:e] for s, e in zip([0, *ends[:-1]], ends)]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _split(path: str, buckets: int, chunk_bytes: int):
    """Documents to positions (bucket -1) and the chunk's distinct words by bucket."""

    def run(batches):
        cut, task, serial = splitter(path), TaskContext.get().partitionId(), 0
        numbers, places, ids, counts, size = _Numbers(), array("I"), [], [], 0

        def flush():
            words = list(numbers)
            at = np.frombuffer(places, np.uint32) if len(places) else np.empty(0, np.uint32)
            # By falling frequency, then by spelling: the many rare words compress well in order.
            spelt = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = spelt[np.argsort(-np.bincount(at, minlength=len(words))[spelt], kind="stable")]
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            words = [words[i] for i in order.tolist()]
            own = np.fromiter((xxhash.xxh64_intdigest(w[:BUCKET_LETTERS].encode()) % buckets for w in words), np.uint16, len(words))
            chunk = (task << 24) + serial
            rows = [(chunk, -1, _pack(np.array([i is None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64), np.array(counts, np.uint32), rank[at], own), 0)]
            by = np.argsort(own, kind="stable")
            edge = np.searchsorted(own[by], np.arange(buckets + 1)).tolist()
            for b in range(buckets):
                mine = [words[i] for i in by[edge[b] : edge[b + 1]].tolist()]
                if mine:
                    text = "".join(mine).encode()
                    rows.append((chunk, b, _pack(np.fromiter(map(len, mine), np.uint32, len(mine)), text), len(text) + WORD_BYTES * len(mine)))
            return _rows(rows)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                before = len(places)
                places.extend(map(numbers.__getitem__, cut(text)))
                ids.append(doc_id)
                counts.append(len(places) - before)
                size += len(text) + 64
                if size >= chunk_bytes:
                    yield flush()
                    serial += 1
                    numbers, places, ids, counts, size = _Numbers(), array("I"), [], [], 0
        if ids:
            yield flush()

    return run


def _deal(parts: dict[int, int]):
    """Divides the words of large buckets by the hash of the whole word.  A part of a chunk's
    words goes with their places in the bucket."""

    def run(batches):
        for b in batches:
            for chunk, bucket, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                n = parts.get(bucket, 1)
                if n == 1:
                    yield _rows([(chunk, bucket, payload)])
                    continue
                lens, text = _unpack(payload, "uint32", "bytes")
                words = _words(lens, text)
                own = np.fromiter((xxhash.xxh64_intdigest(w.encode(), DEAL_SEED) % n for w in words), np.int64, len(words))
                by = np.argsort(own, kind="stable")
                edge = np.searchsorted(own[by], np.arange(n + 1)).tolist()
                for k in range(n):
                    at = by[edge[k] : edge[k + 1]]
                    if len(at):
                        text = "".join([words[i] for i in at.tolist()]).encode()
                        yield _rows([(chunk, bucket + (k + 1 << SUB), _pack(lens[at], text, at.astype(np.uint32)))])

    return run


def _encode(path: str):
    """A bucket of the distinct-word table: every word once, the ids back to each chunk."""

    def run(batches):
        tok, asked, table = _tokenizer(path), [], _Numbers()
        for b in batches:
            for chunk, bucket, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                lens, text, *at = _unpack(payload, "uint32", "bytes", "uint32")
                places = array("I", map(table.__getitem__, _words(lens, text)))
                asked.append((chunk, bucket, np.frombuffer(places, np.uint32), at))
        words, lens, flat = list(table), [], []
        for a in range(0, len(words), 4096):
            for enc in tok.encode_batch_fast(words[a : a + 4096], add_special_tokens=False):
                ids = enc.ids
                lens.append(len(ids))
                flat += ids
        lens, flat = np.array(lens, np.int64), np.array(flat, np.uint32)
        first = np.cumsum(lens) - lens
        for chunk, bucket, own, places in asked:
            n = lens[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield _rows([(chunk, bucket, _pack(n.astype(np.uint32), flat[at], *places))])

    return run


def _join_back(path: str, emit):
    """Ids and pieces of each chunk's words to the positions of its documents."""

    def chunk(docs: bytes, answers: dict[int, bytes]):
        piece = pieces(path)
        null, ids, counts, places, own = _unpack(docs, "uint8", "int64", "uint32", "uint32", "uint16")
        word_ids, word_text, lengths = [emit.word([])] * len(own), [b""] * len(own), np.zeros(len(own), np.int64)
        for bucket in list(answers):
            n, flat, *part = _unpack(answers.pop(bucket), "uint32", "uint32", "uint32")
            at, ends, flat = np.flatnonzero(own == bucket % (1 << SUB)), np.cumsum(n).tolist(), flat.tolist()
            at = at[part[0]] if part else at
            lengths[at] = n
            for w, s, e in zip(at.tolist(), [0, *ends[:-1]], ends):
                word_ids[w] = emit.word(flat[s:e])
                word_text[w] = b"".join([piece[i] for i in flat[s:e]])  # the id-to-piece join
        at, out = 0, []
        for none, i, n in zip(null.tolist(), ids.tolist(), counts.tolist()):
            words = places[at : at + n].tolist()
            at += n
            out.append((None if none else i, *emit.row(words, word_ids, word_text, lengths)))
            if len(out) == 1024:
                yield emit.batch(out)
                out = []
        if out:
            yield emit.batch(out)

    def run(batches):
        now, docs, answers = None, None, {}
        for b in batches:
            for c, bucket, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                if c != now:
                    if docs is not None:
                        yield from chunk(docs, answers)
                    now, docs, answers = c, None, {}
                if bucket < 0:
                    docs = payload
                else:
                    answers[bucket] = payload
        if docs is not None:
            yield from chunk(docs, answers)

    return run


class Digests:
    """Number of tokens and digests of the ids and of the decoded text."""

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    @staticmethod
    def word(ids):
        """What is kept of a word's ids."""
        return ",".join(map(str, ids)).encode()

    @staticmethod
    def row(words, word_ids, word_text, lengths):
        decoded = b"".join([word_text[w] for w in words]).decode(errors="replace").encode()
        ids = b",".join([word_ids[w] for w in words])
        return int(lengths[words].sum()) if words else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    @classmethod
    def batch(cls, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), cls.types)], [c.split()[0] for c in cls.schema.split(", ")])


class Tokens(Digests):
    """The ids themselves and the decoded text."""

    schema = "doc_id long, ids array<int>, decoded string"
    types = [pa.int64(), pa.list_(pa.int32()), pa.string()]

    @staticmethod
    def word(ids):
        return ids

    @staticmethod
    def row(words, word_ids, word_text, lengths):
        return [i for w in words for i in word_ids[w]], b"".join([word_text[w] for w in words]).decode(errors="replace")

    @classmethod
    def batch(cls, rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), cls.types)], ["doc_id", "ids", "decoded"])


def asked_words(split: DataFrame, buckets: int, bucket_bytes: int = BUCKET_BYTES, most_bytes: int = MOST_BUCKET_BYTES) -> tuple[DataFrame, int]:
    """The chunks' words by bucket, those of large buckets dealt out again, and the number of buckets."""
    asked = split.where("bucket >= 0").select("chunk", "bucket", "payload")
    sizes = split.where("bucket >= 0").groupBy("bucket").agg(F.sum("raw").alias("raw"))
    parts = {r["bucket"]: -(-r["raw"] // bucket_bytes) for r in sizes.where(F.col("raw") > most_bytes).collect()}
    if not parts:
        return asked, buckets
    return asked.mapInArrow(_deal(parts), ROW), buckets + sum(parts.values())


def encode(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", emit=Digests, chunk_bytes: int = CHUNK_BYTES,
    most_bytes: int = MOST_BUCKET_BYTES,
) -> DataFrame:
    """One row per document with what ``emit`` makes of its ids and decoded text: digests, or
    the ids and the text (:class:`Tokens`)."""
    ship_code(docs.sparkSession)
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = min(60_000, partitions_for(total, BUCKET_BYTES))
    split = materialize(rows.mapInArrow(_split(path, buckets, chunk_bytes), f"{ROW}, raw long"), "bpe-positions")
    chunks = split.where("bucket < 0").drop("raw")
    asked, parts = asked_words(split, buckets, min(BUCKET_BYTES, most_bytes), most_bytes)
    answers = asked.repartition(parts, "bucket").mapInArrow(_encode(path), ROW)
    met = chunks.unionByName(answers).repartition(partitions_for(total, chunk_bytes), "chunk").sortWithinPartitions("chunk", "bucket")
    return met.mapInArrow(_join_back(path, emit), emit.schema)


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with lists of ids: a join of every position with the id-to-piece
    table, put together again by position.  Unknown ids decode to nothing."""
    spark = tokens.sparkSession
    table = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(pieces(path or tokenizer_path()))], "id int, piece binary")
    rows = tokens.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    rows = materialize(rows, "bpe-ids")  # the row numbers must not change
    at = rows.select("row", F.posexplode("ids").alias("pos", "id")).join(table, "id")
    text = at.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("parts"))

    def put(batches):
        for b in batches:
            text = [b"".join(p["piece"] for p in parts or []).decode(errors="replace") for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.join(text, "row", "left").select("doc_id", "parts").mapInArrow(put, "doc_id long, text string")
