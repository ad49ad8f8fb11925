"""Operator 4, SimHash near-dedup with bit-sliced comparison.

Fingerprints: bit b is set if it is set in more than half of the 64-bit hashes of a document's
word shingles.  Equal fingerprints are one class (combined map-side), so copies are never
compared.

Candidates: two fingerprints within the radius agree on at least ``blocks - radius`` of the
``blocks`` parts of their 64 bits.  Each class is dealt out once for every such choice of
parts, and rows that agree on the chosen bits arrive sorted, one after the other.  A group of
more than ``most_rows`` rows is not compared as it stands: its remaining bits are cut into
``radius + 1`` parts, of which one must agree, and its rows are dealt out again by them; this
repeats until every group is small, so no link is lost and no task holds a large group.

Comparison: the rows of a batch of groups are stored as 64 vertical bit planes.  A block of
queries is compared with all of them, plane by plane, by carry-save counters that hold every
pair's distance in bits ones, twos, ...; once all pairs of a block exceed the radius the block
is abandoned.  Of the links found, each task passes on a spanning forest.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked
like any other; fewer words than a shingle are one shingle; null ids come last and give a null
component only if no document of it has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporion.llm.common import LAST_ID, id_order, materialize, ship_code, text_or_empty
from emporion.llm.components import components

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42  # fixed values
BLOCKS = 4
BATCH_ROWS = 1024
MOST_ROWS = 4096
QUERY_ROWS = 256
HASHES_AT_ONCE = 1 << 17
ALL = (1 << 64) - 1


def shingle_hashes(text: str, k: int):
    """XXH64 of the document's k-word shingles, in parts of bounded size."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if 0 < len(words) < k:
        yield [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    for a in range(0, len(words) - k + 1, HASHES_AT_ONCE):
        b = min(a + HASHES_AT_ONCE, len(words) - k + 1)
        yield [digest(line[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a + k - 1 : b + k - 1].tolist())]


def fingerprints(texts: list[str], k: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprints of texts (uint64)."""
    counts, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owner, n = [], [], 0

    def add() -> None:
        if held:
            bits = np.unpackbits(np.array([h for part in held for h in part], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.cumsum([0] + [len(part) for part in held[:-1]])
            np.add.at(counts, owner, np.add.reduceat(bits, first, axis=0, dtype=np.int64))

    for i, text in enumerate(texts):
        for part in shingle_hashes(text or "", k):
            held.append(part)
            owner.append(i)
            total[i] += len(part)
            n += len(part)
            if n >= HASHES_AT_ONCE:
                add()
                held, owner, n = [], [], 0
    add()
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_table(docs: DataFrame, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(oid, rk, fp) of every document: its id, a hash of its text (ids may repeat) and its
    fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fp = fingerprints(part.column(2).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], ["oid", "rk", "fp"])

    ship_code(docs.sparkSession)
    text = text_or_empty(text_col)
    return docs.select(id_order(id_col).alias("oid"), F.xxhash64(text).alias("rk"), text.alias("text")).mapInArrow(run, "oid long, rk long, fp long")


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` parts, nearly equal, of the given bit positions."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits, dtype=object), n) if len(part)]


def masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """The bits on which two fingerprints within the radius may agree: one of these masks."""
    blocks = max(blocks, radius + 1)
    parts = _parts(list(range(64)), blocks)
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def finer(mask: int, radius: int) -> list[int]:
    """Masks with more bits: rows that agree on ``mask`` and are within the radius agree on one."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | part for part in _parts(rest, radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_pairs(fp: np.ndarray, radius: int, query_rows: int = QUERY_ROWS) -> np.ndarray:
    """Pairs (i < j) of rows whose fingerprints differ in ``radius`` bits or fewer."""
    n = len(fp)
    width = -(-n // 64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.zeros((64, width * 64), np.uint8)
    planes[:, :n] = bits.T
    planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)  # plane b holds bit b of every row
    digits = (radius + 1).bit_length()
    low_bits = np.array([(1 << k) - 1 for k in range(65)], np.uint64)
    pad = np.zeros(width, np.uint64)
    pad[-1] = ~low_bits[n - (width - 1) * 64]
    found = []
    for a in range(0, n, query_rows):
        own = bits[a : a + query_rows].astype(np.uint64) * np.uint64(ALL)
        w0 = a // 64  # earlier rows have met these already
        count = [np.zeros((len(own), width - w0), np.uint64) for _ in range(digits)]
        # Only later rows count: the row itself, earlier rows and the padding exceed at once.
        over = np.broadcast_to(pad[w0:], (len(own), width - w0)).copy()
        place = np.arange(a, a + len(own))
        for word in range(w0, (place[-1] >> 6) + 1):
            upto = np.clip(place - word * 64 + 1, 0, 64)
            over[:, word - w0] |= low_bits[upto]
        for b in range(64):
            carry = planes[b, w0:][None, :] ^ own[:, b][:, None]
            for c in count:  # ripple the new bit of every distance into its counter
                c ^= carry
                carry = carry & ~c
            over |= carry
            if b % 8 == 7:
                near = ~(over | _above(count, radius))
                if not near.any():  # all pairs of the block exceed the radius
                    break
        hit_row, hit_word = np.nonzero(near)
        hits = np.unpackbits(near[hit_row, hit_word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(hits)
        i, j = hit_row[at] + a, (hit_word[at] + w0) * 64 + bit
        found.append(np.stack([i, j], axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counters' number is over the radius, bit-parallel from the highest digit."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more |= same & count[k]
            same = same & ~count[k]
    return more


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def links(classes: DataFrame, radius: int = MAX_BITS, blocks: int = BLOCKS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(u, v): pairs of the fingerprints of ``classes`` (fp, all different) that connect whatever
    the links of at most ``radius`` differing bits connect."""
    out_schema = "u long, v long, mask long, fp long"

    def compare(batches):
        fps = []  # whole groups that wait for comparison
        cur_key, cur, large = None, [], False

        def rows(u, v, mask, fp):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, mask, fp)], ["u", "v", "mask", "fp"])

        def again(mask, fp):
            for m in finer(mask & ALL, radius):
                n = len(fp)
                yield rows([None] * n, [None] * n, [_signed(m)] * n, fp)

        def settle():
            n = len(fps)
            if n > 1:
                tree = _forest(linked_pairs(np.array(fps, np.int64).view(np.uint64), radius), n)
                if tree:
                    none = [None] * len(tree)
                    yield rows([fps[i] for i, _ in tree], [fps[j] for _, j in tree], none, none)
            fps.clear()

        for b in batches:
            mask, key, fp = (b.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(mask)]):
                if e == s:
                    continue
                k = (int(mask[s]), int(key[s]))
                if k != cur_key:
                    if not large and len(cur) > 1:
                        fps += cur
                        if len(fps) >= BATCH_ROWS:
                            yield from settle()
                    cur_key, cur, large = k, [], False
                cur += fp[s:e].tolist()
                if large or len(cur) > most_rows:
                    large = True
                    yield from again(k[0], cur)
                    cur = []
        if not large and len(cur) > 1:
            fps += cur
        yield from settle()

    ship_code(classes.sparkSession)
    dealt = classes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks(radius, blocks)])).alias("mask"))
    found = None
    while True:
        keyed = dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        out = materialize(keyed.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(compare, out_schema), "simhash-links")
        got = out.where("u IS NOT NULL").select("u", "v")
        found = got if found is None else found.unionByName(got)
        dealt = out.where("mask IS NOT NULL").select("fp", "mask")
        if dealt.isEmpty():
            return found


def near_groups(docs: DataFrame, radius: int = MAX_BITS, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``oid, rk, fp`` and ``least``, the smallest (oid, rk) of its
    component."""
    prints = materialize(fingerprint_table(docs, k, id_col, text_col), "simhash-prints")
    classes = materialize(prints.groupBy("fp").agg(F.min(F.struct("oid", "rk")).alias("own")), "simhash-classes")
    root = components(links(classes, radius)).withColumnRenamed("node", "fp")
    classes = classes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("own").alias("least"))
    return prints.join(classes.join(least, "root").select("fp", "least"), "fp")


def near_dedup(docs: DataFrame, radius: int = MAX_BITS, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id`` (the smallest id reachable)."""
    back = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return near_groups(docs, radius, k, id_col, text_col).select(
        back("oid").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        back("least.oid").alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, radius: int = MAX_BITS, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (of rows with
    that id, one)."""
    given = docs.columns
    stay = near_groups(docs, radius, k, id_col, text_col).where("oid = least.oid AND rk = least.rk")
    stay = stay.groupBy("oid", "rk").agg(F.count("*").alias("n"))
    stay = materialize(stay, "simhash-kept")
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), id_order(id_col).alias("oid"), F.xxhash64(text_or_empty(text_col)).alias("rk")
    )
    kept = own.join(stay.hint("shuffle_hash"), ["oid", "rk"], "left_semi")
    if not stay.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["oid", "rk"])
    return kept.select("row.*")
