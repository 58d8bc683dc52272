import duckdb
import pytest

import __spark_entry__ as entry_module

SQL = entry_module.oracle_sql()
#: One query of each kind; the whole list is compared by the driver.
NAMES = [
    "language_stats", "language_confidence", "line_counts", "derived_columns", "pruned_files", "indexed_files", "ignore_verdicts", "frameworks", "package_managers", "ci_providers", "runtimes",
    "workspace_globs", "component_discovery", "component_hints_derived", "secondary_kinds", "component_languages", "component_frameworks", "monorepo_flag", "inventory_flat",
    "checkout_languages", "checkout_package_managers", "checkout_runtimes", "checkout_confidence", "checkout_report", "scan_report", "scan_report_part", "ini_entries", "files_matching", "stored_findings", "component_kinds", "stored_component_frameworks", "share_text", "test_files",
]


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    import os

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry_module.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry_module.queries())


def test_entry_runs(spark):
    assert entry_module.entry(spark).columns[:2] == ["repo_id", "language"]
