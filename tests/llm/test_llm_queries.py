"""The queries of the subpackage: against their SQL on the smallest tables, the others against what must hold of their rows."""

from collections import defaultdict

import pytest

from quillspan.llm import queries
from quillspan.llm.tokens import tokens
from tests.compare import compare, connect

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    assert compare(connect(DIR), queries.QUERIES[name](spark, DIR), queries.ORACLE[name]) == ""


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_containers(spark):
    size = {k: tokens().count(t) for k, t in texts(spark).items()}
    limits = {r.limit_name: r.max_tokens for r in spark.read.parquet(f"{DIR}/size_limits.parquet").collect() if r.limit_name.startswith("pack_")}
    rows = queries.p7_containers(spark, DIR).collect()
    for name, most in limits.items():
        held, fill = defaultdict(int), defaultdict(int)
        for r in rows:
            if r.limit_name == name:
                held[r.doc_id] += r.n_tokens
                if r.container is not None:
                    fill[r.container] += r.n_tokens
                    assert r.n_tokens == most or size[r.doc_id] % most == r.n_tokens
        assert dict(held) == size and max(fill.values()) <= most
    assert {r.limit_name: r.fill > 0.9 for r in queries.p7_fill(spark, DIR).collect()} == dict.fromkeys(limits, True)


def test_mix(spark):
    rows = queries.p8_mix(spark, DIR).collect()
    known = texts(spark)
    caps = {s: c for s, _, c in queries.targets(spark, DIR)}
    used = defaultdict(int)
    for r in rows:
        assert r.n_tokens == tokens().count(known[r.doc_id]) and r.uses > 0
        used[r.doc_id] += r.uses
        assert used[r.doc_id] <= max(caps.values())
    report = queries.p8_report(spark, DIR).collect()
    assert {r.source for r in report} == set(caps) and sum(r.share for r in report) == pytest.approx(1)
    assert sum(r.n_tokens for r in report) == sum(r.uses * r.n_tokens for r in rows)
    whole = {r.source: r for r in queries.p8_report_whole(spark, DIR).collect()}
    assert sum(r.n_tokens for r in whole.values()) >= sum(r.n_tokens for r in report)


def test_pieces(spark):
    known = texts(spark)
    limits = queries.limits(spark, DIR, "cut_")
    by = defaultdict(list)
    for r in queries.p9_pieces(spark, DIR).collect():
        by[r.limit_name, r.doc_id].append(r)
    for name, most, overlap in limits:
        for k, t in known.items():
            rows = sorted(by.get((name, k), []), key=lambda r: r.piece)
            assert bool(rows) == (tokens().count(t) > most)
            for r in rows:
                assert r.text == t[r.start_char : r.end_char] and tokens().count(r.text) == r.n_tokens <= most
            for a, b in zip(rows, rows[1:]):
                assert b.start_token + b.shared_tokens == a.end_token and b.shared_tokens >= min(overlap, 1)
