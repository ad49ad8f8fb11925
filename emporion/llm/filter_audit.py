"""Operator 11, audit of how filters act together, with wide packed counters.

Every order in which the filters can be applied is a row of steps; a document that fails some
filters is removed, in each order, by the first of them.  Which step that is depends only on the
set of filters it fails, its mask.  So each mask is mapped, once, to one big integer with a field
for every (order, step): 1 where that step removes the document, 0 elsewhere, and one last field
that counts the document itself.  Adding the integers of a part's documents counts all steps at
once.  A field is as wide as the number of rows of the whole table, so no sum can run over into
the next field.

All other figures follow from the fields: kept after a step is all less what the steps so far
removed; a filter that stands first removes whatever fails it, one that stands last removes
what fails nothing else.

Spark measures every document in one scan and keeps a narrow row of it (a digest for the text).
A document repeats another if the smallest id of its digest is below its own; rows alike in id,
digest, part, mask and labels are combined first, so a text that fills a third of the table is one
row a task, and the look-up joins on digest and id together.  Integers are added in each task,
then in two steps by part, so that no task adds up more than a share of a part's integers.

Defined cases: a null text is empty; a null part is the empty string; null ids come last and are
not smaller than one another; rows of one id are not earlier than each other; a document without
a row in ``labels``, or with null marks there, has neither mark, and of several rows one with the mark
is enough; very long texts are measured whole; other columns are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporion.llm.common import SPACE_RUN, id_order, materialize, ship_code, text_or_empty

MIN_WORDS, MIN_DISTINCT_PCT, MOST_UPPER_PCT, SYMBOLS = 100, 80, 10, "[#$%&*|]"  # fixed values
SALTS = 16
MOST_PARTS = 512  # sums that a task holds at a time
SUMS = "part string, salt int, packed binary, good binary, toxic binary"


def failures(text: Column) -> dict[str, Column]:
    """The filters A to D: whether a text fails each."""
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PCT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_UPPER_PCT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def outcomes(letters: str, width: int) -> list[int]:
    """The packed integer of each mask (bit i: fails filter i): fields of ``width`` bits by
    (order, step), then one for the document."""
    steps = [letters.index(x) for order in permutations(letters) for x in order]
    n = len(letters)
    packed = []
    for mask in range(1 << n):
        total = 1 << (width * len(steps))
        for first in range(0, len(steps), n):
            at = next((i for i in range(first, first + n) if mask >> steps[i] & 1), None)
            if at is not None:
                total += 1 << (width * at)
        packed.append(total)
    return packed


def unpacked(total: int, fields: int, width: int) -> list[int]:
    one = (1 << width) - 1
    return [total >> (width * i) & one for i in range(fields)]


def _bytes(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "little")


def _emit(sums: dict, salted: bool) -> pa.RecordBatch:
    """Sums by part.  The salt that the next step groups them by comes from the task."""
    salt = TaskContext.get().partitionId() % SALTS if salted else 0
    cols = [pa.array([part for part in sums], pa.string()), pa.array([salt] * len(sums), pa.int32())]
    cols += [pa.array([_bytes(x[i]) for x in sums.values()], pa.binary()) for i in range(3)]
    return pa.RecordBatch.from_arrays(cols, ["part", "salt", "packed", "good", "toxic"])


def _adder(packed: list[int]):
    """Adds the integers of rows (part, mask, good, toxic, rows) by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}
        for b in batches:
            for part, mask, good, toxic, n in zip(*(c.to_pylist() for c in b.columns)):
                own = sums.setdefault(part, [0, 0, 0])
                x = packed[mask] * n
                own[0] += x
                if good:
                    own[1] += x
                if toxic:
                    own[2] += x
            if len(sums) > MOST_PARTS:
                yield _emit(sums, True)
                sums = {}
        if sums:
            yield _emit(sums, True)

    return run


def _run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int]]]:
    """Rows sorted by part: one sum for each run of a part."""
    now, own = None, [0, 0, 0]
    for b in batches:
        for part, *packed in zip(b.column(0).to_pylist(), *(b.column(i).to_pylist() for i in (2, 3, 4))):
            if part != now:
                if now is not None:
                    yield now, own
                now, own = part, [0, 0, 0]
            for i, x in enumerate(packed):
                own[i] += int.from_bytes(x, "little")
    if now is not None:
        yield now, own


def _merge(batches):
    for part, own in _run_sums(batches):
        yield _emit({part: own}, False)


STEPS = (
    "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _unpacker(letters: str, width: int):
    orders = ["".join(x) for x in permutations(letters)]
    n, fields = len(letters), len(orders) * len(letters)

    def run(batches):
        for part, own in _run_sums(batches):
            removed, good, toxic = (unpacked(x, fields + 1, width) for x in own)
            by = {x: [removed[n * o + order.index(x)] for o, order in enumerate(orders)] for x in letters}
            fails = {x: next(by[x][o] for o, order in enumerate(orders) if order[0] == x) for x in letters}
            alone = {x: next(by[x][o] for o, order in enumerate(orders) if order[-1] == x) for x in letters}
            rows = []
            for o, order in enumerate(orders):
                kept = removed[fields]
                for s, x in enumerate(order):
                    gone = removed[n * o + s]
                    kept -= gone
                    rows.append((part, order, s + 1, x, kept, gone, fails[x] - gone, alone[x], good[n * o + s], toxic[n * o + s], sum(by[x])))
            names = [c.split()[0] for c in STEPS.split(", ")]
            kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in STEPS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def measured(docs: DataFrame, checks: dict[str, Column], part_col: str, id_col: str, text_col: str) -> DataFrame:
    """(oid, part, digest, mask): a narrow row for every document."""
    mask = sum((F.when(F.coalesce(fails, F.lit(False)), 1 << i).otherwise(0) for i, fails in enumerate(checks.values())), F.lit(0))
    return docs.select(
        id_order(id_col).alias("oid"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"), mask.cast("int").alias("mask"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, checks: dict[str, Column] | None = None, repeats: str = "E",
    part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each part, order of the filters and step (see ``STEPS``).

    ``checks`` maps a letter to the condition under which a document fails that filter (by default
    :func:`failures` A to D); ``repeats`` is the letter of the filter that a text fails whose equal
    has a smaller id.  ``labels`` has ``quality`` and ``toxic`` by ``id_col``."""
    spark = docs.sparkSession
    ship_code(spark)
    checks = failures(text_or_empty(text_col)) if checks is None else checks
    letters = "".join(checks) + repeats
    rows = materialize(measured(docs, checks, part_col, id_col, text_col), "audit-rows")  # later jobs read no text
    width = rows.count().bit_length() + 1
    marks = labels.groupBy(F.col(id_col).cast("long").alias("oid")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    same = ["digest", "oid", "part", "mask"]
    alike = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).join(marks, "oid", "left")
    first = rows.groupBy("digest").agg(F.min("oid").alias("oid")).withColumn("is_first", F.lit(True))
    known = alike.join(first, ["digest", "oid"], "left")
    later = F.when(F.col("is_first"), 0).otherwise(1 << len(checks))
    counted = known.select("part", (F.col("mask") + later).alias("mask"), F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False)), "n")
    sums = counted.mapInArrow(_adder(outcomes(letters, width)), SUMS)
    share = sums.repartition("part", "salt").sortWithinPartitions("part").mapInArrow(_merge, SUMS)
    return share.repartition("part").sortWithinPartitions("part").mapInArrow(_unpacker(letters, width), STEPS)
