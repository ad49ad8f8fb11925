"""Every stage of the pipeline against its operator's brute-force rules, on its own input."""

import re

import corpus_pipeline as P
from emporion.llm import queries as Q
from emporion.llm.common import materialize
from emporion.plans.parity import _canon, duckdb_connection

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in P.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = (before.collect(), docs.collect())
    before, after = seen["quality"]
    kept = {r["doc_id"] for r in after}
    good = [d for d in labels if labels[d] == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and len(after) < len(before)
    before, after = seen["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in sorted(before, key=lambda r: -r["doc_id"]):
        least[norm(r["text"])] = r["doc_id"]
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())
    before, after = seen["near_dedup"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["mixing"]
    ids = [r["doc_id"] for r in after]
    assert max(ids.count(d) for d in set(ids)) <= 2 and set(ids) <= {r["doc_id"] for r in before}
    before, after = seen["bpe"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)


def test_queries_against_sql(spark):
    con = duckdb_connection(SF)
    for name, sql in Q.oracle_sql().items():
        df = Q.queries()[name](spark, SF)
        cur = con.execute(sql)
        want = _canon([c[0] for c in cur.description], cur.fetchall())
        assert _canon(df.columns, [tuple(r) for r in df.collect()]) == want, name


def test_every_operator_has_one_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in Q.queries()] == list(range(1, 14))
