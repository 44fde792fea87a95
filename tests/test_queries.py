"""Every query of the core against its SQL on the smallest tables; the core imports without the llm subpackage."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from quillspan.plans import registry
from tests.compare import compare, connect

DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert compare(con, registry.queries()[name](spark, DIR), SQL[name]) == ""


def test_queries_without_sql(spark):
    """Programs have no SQL: each block of the table has at least one step, and what it reads and writes are qualified names."""
    assert set(registry.queries()) - set(SQL) == {"lin_block_scan"}
    rows = registry.queries()["lin_block_scan"](spark, DIR).collect()
    keys = {r.block_key for r in spark.read.parquet(f"{DIR}/blocks.parquet").select("block_key").collect()}
    assert {r.block_key for r in rows} == keys
    names = [x for r in rows for x in f"{r.reads},{r.writes}".split(",") if x]
    assert names and all(x.count(".") >= 1 and x == x.lower() for x in names)
    assert {r.status for r in rows} <= {"PARSED", "PARTIAL", "NOT_MATCHED"} and any(r.status == "PARSED" and r.writes for r in rows)


def test_queries_have_rows(spark, con):
    """No query is green on nothing, but for those whose empty result is their point."""
    for name in ("grf_paged_edges", "grf_suggest_terms", "snk_upsert", "lin_scan_programs", "mac_expand", "grf_folder_links", "p1_partial"):
        assert con.execute(SQL[name]).fetchone() is not None, name


def test_set_queries_tell_sets_apart(spark):
    q = entry.queries()
    assert len({r.jaccard for r in q["grf_similar_sources"](spark, DIR).collect()}) > 5
    subs = {tuple(r) for r in q["grf_subset_terms"](spark, DIR).collect()}
    assert subs and any((b, a) not in subs for a, b in subs)
    assert len({r.dist for r in q["grf_suggest_terms"](spark, DIR).collect()}) > 1


def test_synthetic_edges_scale(spark):
    assert sum(r.n for r in entry.queries()["src_synthetic_edges_scale"](spark, DIR).collect()) == 3_000_000


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name == 'quillspan.llm':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert not any(k in e.queries() for k in ('p4_found', 'p9_pieces'))\nprint(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 100
