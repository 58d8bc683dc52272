import duckdb
import os
from collections import Counter
from itertools import combinations

import pytest

from arborlake.llm.queries import QUERIES, SQL


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.sql(SQL[name])
    at = [result.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", ["p4_found", "p7_found", "p8_found", "p9_found"])
def test_found_queries_have_their_columns(spark, sf_dir, name):
    columns = {"p4_found": ["repo_id", "relative_path"], "p7_found": ["doc_id"], "p8_found": ["source"], "p9_found": ["doc_id"]}
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == columns[name] and df.count() == df.distinct().count()


def test_every_pair_comes_out(spark, sf_dir):
    records = {}
    for r in spark.read.parquet(f"{sf_dir}/scan_results.parquet").select("scan_id", "inventory.frameworks", "inventory.packageManagers").collect():
        if r.scan_id is not None:
            records[r.scan_id] = {f"{c}:{v.strip(' \t').lower()}" for c in ("frameworks", "packageManagers") for v in r[c] or [] if v is not None}
    want = Counter(p for items in records.values() for p in combinations(sorted(items), 2))
    got = {(r.item_a, r.item_b): r.n_ab for r in QUERIES["p1_all_pairs"](spark, sf_dir).collect()}
    assert got == want and 1 in want.values()


def test_handwritten_files_come_out(spark, sf_dir):
    from arborlake.llm.handwritten import LANGUAGE_OF_EXTENSION

    language = {}
    for r in spark.read.parquet(f"{sf_dir}/files.parquet").select("repo_id", "relative_path", "name", "ext").collect():
        ext = (r.ext if r.ext is not None else os.path.splitext(r.name)[1]).lower()
        if ext in LANGUAGE_OF_EXTENSION:
            language[r.repo_id, r.relative_path] = LANGUAGE_OF_EXTENSION[ext]
    other = {tuple(r) for r in QUERIES["p4_found"](spark, sf_dir).collect()}
    got = [tuple(r) for r in QUERIES["p4_handwritten"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in language.items() if k not in other) and got
