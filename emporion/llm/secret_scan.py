"""Operator 7, secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text, its blob.  The ledger, a
table in a shared folder, has one row for each blob and rule version that was scanned, with the
spans found (also when there are none).  A scan takes one representative row of each blob,
drops the (blob, rule, version) pairs that the ledger has, reads the text of what is left, and
appends its findings as one new batch of the ledger; a batch counts only once it is completely
written.  Findings are joined back to all rows by blob.  So a text that fills a third of the
table is scanned once, and a new rule version scans each blob with that rule alone.

Spans are in code points, end exclusive.  Defined cases: a null text is an empty blob; null and
repeated ids are paths like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emporion.llm.common import id_order, materialize, ship_code, text_or_empty
from emporion.session import scratch_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches are leftmost and do not overlap; those whose ``group`` has
    fewer than ``least`` characters are dropped.  ``needs``: a text with none of these
    characters cannot match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    needs: str = ""
    version: int = 1

    def spans(self, text: str) -> Iterable[tuple[int, int]]:
        if self.needs and not any(c in text for c in self.needs):
            return []
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: The base kinds, in order.  A run shorter than its least length cannot hold a
#: longer match, so the two plain classes ask for the length in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, ":="),
    Rule("access", r"AKIA[A-Z0-9]{16,}", needs="K"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds beyond the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs="."),
)
RULES = (*BASE, *MORE)
BROADCAST_BLOBS = 10_000  # rows of a hash, an id and some rule names
LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def new_ledger(spark: SparkSession) -> str:
    """A ledger of its own, in the shared folder."""
    return scratch_dir(spark, "secret-ledger")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All complete batches of a ledger; an unused one is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    if fs.exists(path):
        at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
        done = [str(s.getPath()) for s in fs.listStatus(path) if fs.exists(at(f"{s.getPath()}/_SUCCESS"))]
    return spark.read.schema(LEDGER).parquet(*done) if done else spark.createDataFrame([], LEDGER)


def _scanner(rules: Sequence[Rule]):
    by_key = {f"{r.kind}:{r.version}": r for r in rules}
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                part = b.slice(at, 256)
                for blob, pairs, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    text = text.as_py()  # one at a time
                    for key in pairs:
                        r = by_key[key]
                        out.append((blob, r.kind, r.version, [{"start": s, "end": e} for s, e in r.spans(text)]))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32(), spans))], ["blob", "kind", "version", "spans"]
                    )

    return run


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, oid, blob) of every row."""
    blob = F.sha2(text_or_empty(text_col).cast("binary"), 256)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), id_order(id_col).alias("oid"), blob.alias("blob"))


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger has not seen of ``docs`` and return (doc_id, oid, blob) of all rows."""
    spark = docs.sparkSession
    ship_code(spark)
    paths = materialize(addressed(docs, id_col, text_col), "secret-paths")
    blobs = paths.groupBy("blob", "oid").agg(F.count("*").alias("n")).groupBy("blob").agg(F.min(F.struct("oid", "n")).alias("row")).select("blob", "row.*")
    seen = read_ledger(spark, ledger).select("blob", F.concat_ws(":", "kind", "version").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("seen"))
    pairs = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    unseen = blobs.join(seen, "blob", "left").select("blob", "oid", "n", F.array_except(pairs, F.coalesce("seen", F.array().cast("array<string>"))).alias("pairs"))
    unseen = materialize(unseen.where(F.size("pairs") > 0), "secret-unseen")
    new = unseen.count()
    if not new:  # the ledger has them all: no text is read
        return paths
    # A few new blobs go to the texts; many meet them by (id, blob).
    asked = F.broadcast(unseen) if new <= BROADCAST_BLOBS else unseen.hint("shuffle_hash")
    texts = docs.select(id_order(id_col).alias("oid"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("blob"), text_or_empty(text_col).alias("text"))
    todo = texts.join(asked, ["oid", "blob"]).select("blob", "pairs", "text", "n")
    if not unseen.where("n > 1").isEmpty():  # repeated rows: one is scanned
        todo = todo.where("n = 1").unionByName(todo.where("n > 1").dropDuplicates(["blob"]))
    todo = todo.drop("n")
    todo.mapInArrow(_scanner(rules), LEDGER).write.parquet(f"{ledger}/batch-{uuid.uuid4().hex}")
    return paths


def findings(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per path: ``doc_id, blob, spans`` (array of kind, start, end by start, then by the
    order of ``rules``), after scanning what is new."""
    paths = scan(docs, ledger, rules, id_col, text_col)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", i)])
    rows = read_ledger(docs.sparkSession, ledger).withColumn("place", order[F.concat_ws(":", "kind", "version")]).where("place IS NOT NULL")
    rows = rows.dropDuplicates(["blob", "place"])  # two scans at the same time may both have it
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), s["end"].alias("end"), F.col("kind").alias("kind")))
    by_blob = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("spans"))
    by_blob = by_blob.withColumn("spans", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return paths.join(by_blob, "blob").select("doc_id", "blob", "spans")


def secret_report(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, a count for each base kind, ``base_sha256``, ``spans``,
    ``blob``.  The strings are made once a blob."""
    found = findings(docs, ledger, rules, id_col, text_col)
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    kinds = [r.kind for r in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "blob")
